"""Scalar text functions: cleaning, statistics, fingerprints, titles, previews (TXT1-TXT21).

All are built-in expressions over one row, so they fuse into the scan stage and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WS, let, n_words, squeeze, strip, upper_first, words

# What a running header, footer or page number looks like (on the lower-cased line).
HEADER_PATTERNS = (
    r"^\d+$",
    r"^page \d+",
    r"^\d+ of \d+$",
    r"^chapter \d+",
    r"©.*copyright",
    r"^\d{4}-\d{2}-\d{2}$",
    r"^confidential|^proprietary",
)

# Leading phrases and verbs dropped when a goal becomes a title.
GOAL_PREFIXES = ("Understand ", "Learn about ", "Explain ", "Students will ", "The student will ")
GOAL_VERBS = ("understand", "learn", "know", "identify", "explain", "describe", "analyze")

# Leading phrases of the title regeneration variant, tried in this order.
RETITLE_PREFIXES = (
    "Understand ", "Learn about ", "Explore ", "Study ", "Differentiate ", "Identify ",
    "Analyze ", "The goal is to ", "Students will ", "You will ", "Learn ", "Master ",
)

# Words that mark a passage as an example or a procedure.
EXAMPLE_WORDS = ("example", "for instance", "such as", "like")
PROCEDURE_WORDS = ("step", "first", "then", "next", "finally")

MIGRATED_PREFIX = "[MIGRATED→"


# --- cleaning ---------------------------------------------------------------------------------

def is_header_footer(line: Column) -> Column:
    """TXT3: header, footer or page-number shape; lines under five characters count too."""
    shapes = "(?U)" + "|".join(HEADER_PATTERNS)
    return let(F.lower(strip(line)), lambda low: (F.length(low) < 5) | low.rlike(shapes))


def drop_repeated_lines(text: Column, min_lines: int = 10, min_count: int = 4, max_len: int = 100) -> Column:
    """TXT2: drop header-like lines that occur at least ``min_count`` times in one text.

    The candidates of a row are sorted once; a line occurs ``min_count`` times exactly when the
    sorted array holds it again ``min_count - 1`` places further.  No shuffle, no quadratic count.
    """
    ahead = min_count - 1

    def prune(lines: Column) -> Column:
        shaped = F.filter(
            F.transform(lines, strip),
            lambda x: (x != "") & (F.length(x) < max_len) & is_header_footer(x),
        )
        repeated = let(
            F.array_sort(shaped),
            lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + ahead) == x)),
        )
        return let(
            repeated,
            lambda r: F.when(F.size(r) == 0, F.array_join(lines, "\n")).otherwise(
                F.array_join(F.filter(lines, lambda x: ~F.array_contains(r, strip(x))), "\n")
            ),
        )

    lines = F.split(text, "\n")
    return F.when(F.size(lines) < min_lines, text).otherwise(let(lines, prune))


def join_hyphens(text: Column) -> Column:
    """TXT4: undo line-break hyphenation; the second pass catches chains such as ``a-\\nb-\\nc``."""
    once = F.regexp_replace(text, rf"(?U)(\w)-{WS}*\n{WS}*(\w)", "$1$2")
    return F.regexp_replace(once, rf"(?U)(\w)-{WS}*\n+{WS}*([a-z])", "$1$2")


def normalize(text: Column) -> Column:
    """TXT5: paragraph breaks, space before punctuation, runs of spaces, trailing white space."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, rf"(?U){WS}+([.!?])", "$1")
    out = F.regexp_replace(out, r" {2,}", " ")
    return F.regexp_replace(out, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")


def clean_text(text: Column) -> Column:
    """TXT1: repeated lines, hyphens, normalisation, strip; a missing text becomes empty."""
    return F.coalesce(strip(normalize(join_hyphens(drop_repeated_lines(text)))), F.lit(""))


def text_stats(text: Column) -> Column:
    """TXT6: struct of words, characters, lines and paragraphs; all zero for an empty text."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.struct(
        n_words(t).alias("words"),
        F.length(t).cast("long").alias("characters"),
        F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "\n"))).cast("long").alias("lines"),
        F.size(paragraphs(t)).cast("long").alias("paragraphs"),
    ))


def paragraphs(text: Column) -> Column:
    """Stripped, non-blank parts between blank lines."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


# --- identity ---------------------------------------------------------------------------------

def content_hash(text: Column) -> Column:
    """TXT7: SHA-256 of the UTF-8 text as hex; empty text has an empty hash."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("")).otherwise(F.sha2(text, 256))


def any_text_hash(text: Column) -> Column:
    """TXT7 as the upload tasks have it: SHA-256 of every text, an empty one too; null for a missing text."""
    return F.sha2(text, 256)


def fingerprint(cleaned: Column, sentences: int | None = None, length: int | None = None) -> Column:
    """TXT8: a cleaned text re-joined at full stops; with ``sentences`` or ``length`` only its head."""
    parts = F.split(cleaned, r"\.")
    text = F.array_join(parts if sentences is None else F.slice(parts, 1, sentences), ". ")
    return text if length is None else F.substring(text, 1, length)


def size_display(n_bytes: Column) -> Column:
    """TXT9: B, KB, MB, GB or TB with one decimal (ties to even, as C formatting does)."""
    value = n_bytes.cast("double")

    def show(factor: int, unit: str) -> Column:
        return F.format_string("%.1f " + unit, F.bround(value / float(1024 ** factor), 1))

    out = F.when(value < 1024, show(0, "B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(value < float(1024 ** (power + 1)), show(power, unit))
    return out.otherwise(show(4, "TB"))


def preview(c: Column, n: int) -> Column:
    """TXT21: the first ``n`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


# --- block texts (columns: title, objectives array, segments array<struct>) -------------------

def embedding_text(title: Column, objectives: Column, segments: Column, cap: int | None = None) -> Column:
    """TXT10: one text per block from title, objectives, tag-free content and question/answer pairs."""
    def part(s: Column) -> Column:
        question, answer = F.coalesce(s["question"], F.lit("")), F.coalesce(s["answer"], F.lit(""))
        qa = F.when((question != "") & (answer != ""), F.concat(F.lit("Q: "), question, F.lit(" A: "), answer))
        return F.when(F.coalesce(s["type"], F.lit("content")) == "knowledge_check", qa).otherwise(
            F.when(F.coalesce(s["content"], F.lit("")) != "", strip_tags(s["content"]))
        )

    head = F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")))
    goals = F.when(F.size(objectives) > 0, F.concat(F.lit("Objectives: "), F.array_join(objectives, " ")))
    body = F.filter(F.transform(segments, part), lambda x: x.isNotNull())
    full = F.array_join(F.concat(F.array_compact(F.array(head, goals)), F.coalesce(body, F.array().cast("array<string>"))), " ")
    return full if cap is None else preview(full, cap)


def relation_text(title: Column, objectives: Column, segments: Column, part: int | None = None) -> Column:
    """TXT11: title, each content and explanation (or its first ``part`` characters), objectives."""
    head = (lambda c: c) if part is None else (lambda c: F.substring(c, 1, part))
    cuts = F.flatten(
        F.transform(
            segments,
            lambda s: F.array_compact(
                F.array(head(s["content"]), head(s["explanation"]))
            ),
        )
    )
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(title), F.coalesce(cuts, none), F.coalesce(objectives, none)), " ")


def key_concepts(objectives: Column, segments: Column, per_segment: int | None = None, cap: int | None = None) -> Column:
    """TXT12: objectives, segment titles and capitalised runs; distinct in first-seen order.

    ``per_segment`` and ``cap`` keep only so many runs of a segment and terms of a block."""
    def terms(s: Column) -> Column:
        runs = F.regexp_extract_all(
            F.coalesce(strip_tags(s["content"]), F.lit("")),
            F.lit(rf"(?U)\b[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*\b"), F.lit(0),
        )
        titles = F.filter(F.array(s["title"]), lambda t: t.isNotNull() & (t != ""))
        return F.concat(titles, runs if per_segment is None else F.slice(runs, 1, per_segment))

    none = F.array().cast("array<string>")
    found = F.coalesce(F.flatten(F.transform(segments, terms)), none)
    terms_ = F.array_distinct(F.concat(F.coalesce(objectives, none), found))
    return terms_ if cap is None else F.slice(terms_, 1, cap)


# --- titles -----------------------------------------------------------------------------------

def goal_title(goal: Column, cap: int = 60) -> Column:
    """TXT13: a short title from a learning goal."""
    out = goal
    for prefix in GOAL_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    out = strip(F.element_at(F.split(out, "[.;,]"), 1))
    out = F.regexp_replace(out, rf"(?iU)^({'|'.join(GOAL_VERBS)}){WS}+", "")
    return F.coalesce(let(let(out, upper_first), lambda t: cut_at(t, cap)), F.lit(""))


def cut_at(c: Column, cap: int) -> Column:
    """At most ``cap`` characters, the last three being dots when something was cut."""
    return F.when(F.length(c) > cap, F.concat(F.substring(c, 1, cap - 3), F.lit("..."))).otherwise(c)


def _first_title(candidates: list[Column], order: Column, cap: int, last: Column) -> Column:
    """The first candidate longer than five characters, numbered and cut at ``cap``."""
    good = F.filter(F.array(*candidates), lambda t: t.isNotNull() & (F.length(strip(t)) > 5))
    full = F.concat(order.cast("string"), F.lit(". "), F.get(good, F.lit(0)))
    return F.coalesce(let(full, lambda t: cut_at(t, cap)), last)


def _label_title(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.concat(F.lit("Learn "), F.array_join(F.slice(labels, 1, 2), " & ")))


def block_title(goal: Column, first_segment: Column, unit_title: Column, labels: Column, order: Column, cap: int = 100) -> Column:
    """TXT14: goal, first segment, unit title, labels, then a constant."""
    unit = strip(F.replace(unit_title, F.lit("Combined Concept"), F.lit("")))
    session = F.concat(F.lit("Focus Session "), order.cast("string"))
    return _first_title([goal_title(goal), first_segment, unit, _label_title(labels), session], order, cap, session)


def retitle_goal(goal: Column, cap: int = 60) -> Column:
    """Goal cleaning of TXT15: one known prefix is dropped, the cut falls on a word boundary."""
    def without_prefix(text: Column) -> Column:
        chain = F
        for prefix in RETITLE_PREFIXES:
            hit = F.startswith(F.lower(text), F.lit(prefix.lower()))
            chain = chain.when(hit, strip(F.substring(text, len(prefix) + 1, 2_000_000_000)))
        return chain.otherwise(text)

    def shorten(title: Column, ws: Column) -> Column:
        # words that fit, each with one separator; the fold stops adding at the first that does not
        start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        fit = F.aggregate(ws, start, lambda acc, w: let(
            acc["open"] & (acc["used"] + F.length(w) + 1 <= cap),
            lambda ok: F.struct(
                F.when(ok, acc["used"] + F.length(w) + 1).otherwise(acc["used"]).alias("used"),
                F.when(ok, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                ok.alias("open"),
            ),
        ))
        return let(fit["n"], lambda n: F.when(n > 0, F.array_join(F.slice(ws, 1, n), " ")).otherwise(title))

    plain = F.regexp_replace(let(let(strip(goal), without_prefix), upper_first), r"\.+\z", "")
    return F.coalesce(let(plain, lambda t: F.when(
        F.length(t) > cap, let(words(t), lambda ws: shorten(t, ws))
    ).otherwise(t)), F.lit(""))


def retitle(df: DataFrame, cap: int = 250) -> DataFrame:
    """TXT15: new titles for blocks; input has block_id, block_order, title, body_goal,
    first_segment, unit_title, labels.  Only rows whose title changes are returned."""
    unit = F.col("unit_title")
    for phrase in ("Combined Concept", "Concept Unit", ":"):
        unit = strip(F.replace(unit, F.lit(phrase), F.lit("")))
    order = F.col("block_order")
    new = _first_title(
        [retitle_goal(F.col("body_goal")), F.col("first_segment"), unit, _label_title(F.col("labels")),
         F.concat(F.lit("Focus Session "), order.cast("string"))],
        order, cap, F.concat(order.cast("string"), F.lit(". Focus Session")),
    )
    return (
        df.select("block_id", F.col("title").alias("old_title"), new.alias("new_title"))
        .where(~F.col("new_title").eqNullSafe(F.col("old_title")))
    )


def strip_migration(title: Column) -> Column:
    """TXT16: drop the migration mark and a leading number, squeeze white space."""
    out = F.regexp_replace(title, rf"(?U)\[MIGRATED→[a-fA-F0-9]+\]{WS}*", "")
    return squeeze(F.regexp_replace(out, rf"(?U)^\d+\.?{WS}*", ""))


def common_title(df: DataFrame, group_col: str, order_col: str = "block_id", title_col: str = "title") -> DataFrame:
    """TXT17: suggested title per group: its single title, else the most common longer word.

    Words are counted with map-side combine; ties go to the word seen first.
    """
    titles = df.select(group_col, order_col, strip_migration(F.col(title_col)).alias("clean"))
    sizes = titles.groupBy(group_col).agg(
        F.count("*").alias("n_titles"), F.min_by("clean", order_col).alias("only_title")
    )
    spread = titles.select(
        group_col, order_col, F.posexplode(words(F.lower("clean"))).alias("pos", "word")
    ).where(F.length("word") > 3)
    counted = spread.groupBy(group_col, "word").agg(
        F.count("*").alias("n"), F.min(F.struct(order_col, "pos")).alias("seen")
    )
    best = counted.groupBy(group_col).agg(F.min_by("word", F.struct(-F.col("n"), F.col("seen"))).alias("word"))
    suggestion = F.when(F.col("n_titles") == 1, F.col("only_title")).when(
        F.col("word").isNotNull(), F.concat(F.lit("Understanding "), F.initcap("word"))
    ).otherwise(F.lit("Combined Concept Study"))
    return sizes.join(best, group_col, "left").select(group_col, "n_titles", suggestion.alias("suggested_title"))


# --- markdown ---------------------------------------------------------------------------------

def clean_markdown(content: Column) -> Column:
    """TXT18: blank-line runs, HTML comments, fence languages."""
    out = F.regexp_replace(content, rf"(?U)\n{WS}*\n{WS}*\n", "\n\n")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    return strip(F.regexp_replace(out, r"(?U)```(\w+)?\n", "```\n"))


def content_type(content: Column) -> Column:
    """TXT19: code > list > definition > example > procedure > concept."""
    low = F.lower(content)

    def any_of(options: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for option in options:
            hit = hit | F.contains(low, F.lit(option))
        return hit

    return (
        F.when(F.contains(content, F.lit("`")), "code")
        .when(content.rlike(rf"(?mU)^{WS}*[-*+]{WS}") | content.rlike(rf"(?mU)^{WS}*\d+\.{WS}"), "list")
        .when(content.rlike(rf"(?mU)^{WS}*\*\*[^*]+\*\*:{WS}") | F.contains(content, F.lit("--")), "definition")
        .when(any_of(EXAMPLE_WORDS), "example")
        .when(any_of(PROCEDURE_WORDS), "procedure")
        .otherwise("concept")
    )


def duration_display(segments: Column, total: Column, target: Column, has_body: Column) -> Column:
    """TXT20: ``Xm Ys`` from segment seconds, else the stored total, else the target duration."""
    listed = F.aggregate(
        segments,
        F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(s["time_sec"], F.lit(0)),
    )
    listed = F.coalesce(listed, F.lit(0).cast("long"))
    seconds = F.when(
        has_body, F.when(listed == 0, F.coalesce(total.cast("long"), F.lit(0).cast("long"))).otherwise(listed)
    ).otherwise(target.cast("long"))
    return F.concat(
        F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")
    )
