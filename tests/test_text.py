from pyspark.sql import functions as F

from lernwerk.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_hyphen_chain_needs_two_passes(spark):
    assert one(spark, tx.join_hyphens(F.col("t")), t="a-\nb-\nc") == "abc"
    assert one(spark, tx.join_hyphens(F.col("t")), t="x- \n Y") == "xY"


def test_normalize(spark):
    assert one(spark, tx.normalize(F.col("t")), t="a  .\n\n\n\nb   c \t\nd  ") == "a.\n\nb c\nd"


def test_repeated_lines(spark):
    keep = "this repeated line is content"
    lines = ["Page 1", keep, "more text"] * 4
    assert one(spark, tx.drop_repeated_lines(F.col("t")), t="\n".join(lines)) == "\n".join([keep, "more text"] * 4)
    nine = "\n".join(["7"] * 9)
    assert one(spark, tx.drop_repeated_lines(F.col("t")), t=nine) == nine
    thrice = "\n".join(["7"] * 3 + [f"line {i}" for i in range(9)])
    assert one(spark, tx.drop_repeated_lines(F.col("t")), t=thrice) == thrice


def test_clean_text_of_nothing(spark):
    assert one(spark, tx.clean_text(F.col("t")), t=None) == ""
    assert one(spark, tx.content_hash(F.col("t")), t="") == ""


def test_header_shapes(spark):
    for line, expected in (("12", True), ("Page 3 of 9", True), ("3 of 9", True), ("2024-01-02", True), ("Confidential draft", True), ("abcd", True), ("ordinary line", False), ("© 2020 copyright", True)):
        assert one(spark, tx.is_header_footer(F.col("t")), t=line) is expected, line


def test_stats(spark):
    s = one(spark, tx.text_stats(F.col("t")), t="a b\n\nc")
    assert (s["words"], s["characters"], s["lines"], s["paragraphs"]) == (3, 6, 3, 2)
    s = one(spark, tx.text_stats(F.col("t")), t="")
    assert tuple(s) == (0, 0, 0, 0)


def test_size_display_ties_to_even(spark):
    for n, shown in ((0, "0.0 B"), (1023, "1023.0 B"), (1280, "1.2 KB"), (1792, "1.8 KB"), (5 * 1024 ** 3, "5.0 GB")):
        assert one(spark, tx.size_display(F.col("n")), n=n) == shown


def test_goal_title(spark):
    assert one(spark, tx.goal_title(F.col("t")), t="Students will understand the chain rule, then more") == "The chain rule"
    assert one(spark, tx.goal_title(F.col("t")), t="x" * 80) == "X" + "x" * 56 + "..."


def test_retitle_goal_cuts_between_words(spark):
    goal = "you will " + " ".join(["word"] * 20) + "."
    got = one(spark, tx.retitle_goal(F.col("t")), t=goal)
    assert got == "Word " + " ".join(["word"] * 11) and len(got) <= 60
    assert one(spark, tx.retitle_goal(F.col("t")), t="Learn maps..") == "Maps"


def test_content_type_order(spark):
    cases = {"`x`\n- a": "code", "- a\n**T**: b": "list", "**T**: b": "definition", "a -- b": "definition", "for instance": "example", "the next one": "procedure", "plain": "concept"}
    for content, kind in cases.items():
        assert one(spark, tx.content_type(F.col("t")), t=content) == kind


def test_strip_migration(spark):
    assert one(spark, tx.strip_migration(F.col("t")), t="[MIGRATED→ab12] 3. A   title") == "A title"


def test_common_title(spark):
    df = spark.createDataFrame([(1, 1, "Graph search"), (1, 2, "Search graph"), (2, 3, "One title"), (3, 4, "a b"), (3, 5, "c d")], "g long, block_id long, title string")
    got = {r["g"]: r["suggested_title"] for r in tx.common_title(df, "g").collect()}
    assert got == {1: "Understanding Graph", 2: "One title", 3: "Combined Concept Study"}


def test_a_first_letter_stays_one_letter(spark):
    from lernwerk.functions.common import upper_first

    df = spark.createDataFrame([("ßheit",), ("ähre",), ("ﬁn",), ("ᾳx",), ("1a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(upper_first(F.col("t"))).collect()] == ["ẞheit", "Ähre", "ﬁn", "ᾼx", "1a", "", None]
