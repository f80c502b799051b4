"""Personal data by candidate gradient boosting (operator 3), with DataFrame functions only.

Generators propose spans: the base patterns of the four kinds, and broader ones with high recall (addresses written
with "(at)" and "dot", telephone numbers without a plus, cards with other separators, numbers of seven digits and
more).  One pass over the texts yields the candidates with the text around them; their places follow from the lengths
of the gaps between matches.  Boosted trees score candidates by format and context.  They learn from the base
patterns, whose validity (Luhn, ranges, digit counts) labels a bounded sample of ``TRAIN_ROWS`` candidates; one fifth
of the candidates is left out and sets the threshold of each kind, the lowest score at which ``PRECISION`` of those
left out above it are valid.  All valid base spans stay; of the broader ones those at or above the threshold that
overlap no base span are added, the best first where they overlap each other.

Defined results: a null or empty text has no spans; equal rows get equal results; extra columns are ignored; without
any valid or any invalid candidate there is nothing to learn and only base spans are returned.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import Shared, documents

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 20_000
PRECISION = 0.98
CONTEXT = 30
TREES, DEPTH = 12, 3

#: (kind, broad, what a text must contain, pattern).  A match of the first four starts where a run of its letters
#: starts, or right after the match before, so that the search is linear; the matches are those of the plain patterns.
LOCAL = "A-Za-z0-9._%+-"
GENERATORS = (
    ("email", 0, lambda t: t.contains("@"), rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", 0, lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", 0, lambda t: t.rlike(r"(?:[0-9][ -]?){11}[0-9]"), r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){11}[0-9])[0-9]++(?:[ -][0-9]++)*+"),
    ("phone", 0, lambda t: t.rlike(r"\+[0-9]"), r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", 1, lambda t: t.rlike(r"(?i)[(\[{]at[)\]}]| at "), r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:[(\[{]at[)\]}] ?[a-z0-9-]{1,64}+(?: ?(?:\.|[(\[{]dot[)\]}]| dot ) ?[a-z0-9-]{1,64}+){1,8}+| at [a-z0-9-]{1,64}+(?: dot [a-z0-9-]{1,64}+){1,8}+)"),
    ("ip", 1, lambda t: t.contains("[.]"), r"(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9])"),
    ("card", 1, lambda t: t.rlike(r"[0-9]{4}[ ./_-]{1,3}[0-9]{4}[ ./_-]"), r"(?<![0-9])[0-9]{4}([ ./_-]{1,3})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", 1, lambda t: t.rlike(r"[0-9]{3}[) .-]{1,2}[0-9]{3}[ .-][0-9]{4}"), r"(?<![0-9.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    # numbers that the trees learn to tell from the kinds
    ("card", 2, lambda t: t.rlike(r"[0-9]{5}"), r"(?<![0-9])[0-9]{7,11}+(?![0-9])"),
    ("phone", 2, lambda t: t.rlike(r"[0-9][ .-][0-9]"), r"(?<![0-9])(?<![0-9][ .-])[0-9]{1,6}+(?:[ .-][0-9]{1,6}+){1,3}+(?![0-9])"),
)


def _found(kind: str, broad: int, has, pattern: str) -> Column:
    """The matches of one generator with the length and the ends of the gap before each, and the start of the next."""
    text = F.col("text")
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    near = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("left"), F.left(g, F.lit(CONTEXT)).alias("right")))
    rows = F.transform(
        F.arrays_zip(F.slice(near, 1, F.size(hits)).alias("a"), hits.alias("hit"), F.slice(near, 2, F.size(hits)).alias("b")),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(broad).alias("broad"), x["hit"].alias("hit"), x["a"]["gap"].alias("gap"), x["a"]["left"].alias("left"), x["b"]["right"].alias("right")),
    )
    return F.when(has(text), rows)


def candidates(docs: DataFrame, shared: Shared) -> tuple[DataFrame, DataFrame]:
    """Two tables: (uid, doc_id) of all rows, and the candidates (uid, kind, broad, hit, left, right, start, end)."""
    none = F.array().cast("array<struct<kind:string,broad:int,hit:string,gap:int,left:string,right:string>>")
    found = F.concat(*[F.coalesce(_found(*g), none) for g in GENERATORS])
    raw = shared.put(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), found.alias("found")))
    rows = raw.where(F.size("found") > 0).select("uid", F.posexplode("found").alias("i", "c")).select("uid", "i", "c.*")
    before = W.partitionBy("uid", "kind", "broad").orderBy("i")
    end = F.sum(F.col("gap") + F.length("hit")).over(before)
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("hit"))
    return raw.select("uid", "doc_id"), rows.drop("i", "gap")


def _digits() -> Column:
    return F.regexp_replace("hit", "[^0-9]", "")


def _luhn() -> Column:
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    figures = F.transform(F.filter(F.split(F.reverse(_digits()), ""), lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(F.transform(figures, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def valid() -> Column:
    """Whether the candidate meets the rule of its kind."""
    n = F.length(_digits())
    part = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.regexp_replace("hit", r"[\[\]()]", "").rlike(rf"^{part}(\.{part}){{3}}$"))
        .when(F.col("kind") == "card", n.between(12, 19) & F.when(n <= 19, _luhn()).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    count = lambda c, p: F.length(F.regexp_replace(c, f"[^{p}]", ""))
    longest = F.array_max(F.transform(F.split("hit", "[^0-9]+"), lambda s: F.length(s)))
    cue = r"(?i)mail|contact|write|phone|tel|call|fax|mobile|card|visa|credit|pay|ip|addr|host|server"
    cols = {
        "f_len": F.length("hit"), "f_digits": count("hit", "0-9"), "f_letters": count("hit", "A-Za-z"), "f_groups": F.size(F.split("hit", "[^0-9]+")),
        "f_longest": longest, "f_plus": F.col("hit").startswith("+").cast("int"), "f_at": F.col("hit").rlike("@|(?i)at").cast("int"), "f_dots": count("hit", "."),
        "f_dashes": count("hit", "-"), "f_spaces": count("hit", " "), "f_brackets": count("hit", "()"), "f_luhn": F.coalesce(F.when(F.col("f_digits").between(2, 40), _luhn()).cast("int"), F.lit(0)),
        "f_left": F.right("left", F.lit(1)).rlike("[A-Za-z0-9]").cast("int"), "f_right": F.left("right", F.lit(1)).rlike("[A-Za-z0-9]").cast("int"),
        "f_sign": F.right("left", F.lit(2)).rlike("[=\"':/#]").cast("int"), "f_cue": F.col("left").rlike(cue).cast("int"), "f_near": count("left", "0-9") + count("right", "0-9"),
        "f_kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")),
    }
    for name, c in cols.items():
        rows = rows.withColumn(name, c.cast("double"))
    return rows, list(cols)


def scored(rows: DataFrame, shared: Shared) -> DataFrame:
    """The candidates with valid, score and threshold."""
    rows, names = _features(rows.withColumn("valid", valid()))
    # what overlaps a valid base span is no case against it
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("hit", "start"), F.lit(5))).withColumn(
        "label", F.when((F.col("broad") == 0) | (F.col("broad") == 2), (F.col("valid") & (F.col("broad") == 0)).cast("double"))
    )
    base = F.max(F.when((F.col("broad") == 0) & F.col("valid"), F.col("end"))).over(W.partitionBy("uid").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("inside", (F.col("broad") > 0) & (F.coalesce(base, F.lit(-1)) > F.col("start")))
    rows = shared.put(rows)
    learn = rows.where("label is not null and not inside and fold > 0").orderBy(F.xxhash64("hit", "uid", "start")).limit(TRAIN_ROWS)
    learn = shared.put(learn.select("label", *names).coalesce(1))
    kinds = learn.agg(F.sum("label"), F.count("*")).first()
    if not kinds[1] or kinds[0] in (0, kinds[1]):
        return rows.withColumn("score", F.lit(0.0)).withColumn("threshold", F.lit(2.0))
    pack = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7).fit(pack.transform(learn).select("label", "features"))
    out = model.transform(pack.transform(rows)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    out = shared.put(out)
    steps = out.where("label is not null and not inside and fold = 0").groupBy("kind", F.floor(F.col("score") * 50).alias("step")).agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    above = W.partitionBy("kind").orderBy(F.desc("step"))  # at most 51 rows a kind
    steps = steps.withColumn("share", F.sum("good").over(above) / F.sum("n").over(above))
    cuts = {r[0]: r[1] / 50 for r in steps.where(F.col("share") >= PRECISION).groupBy("kind").agg(F.min("step")).collect()}
    cut = F.lit(2.0)
    for kind in KINDS:
        cut = F.when(F.col("kind") == kind, F.lit(max(0.5, cuts.get(kind, 0.9)))).otherwise(cut)
    return out.withColumn("threshold", cut)


def found_spans(docs: DataFrame, shared: Shared) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id) of all rows, and (uid, kind, start, end, base, score) of all selected spans."""
    ids, rows = candidates(docs, shared)
    rows = scored(rows, shared)
    base = rows.where("broad = 0 and valid").select("uid", "kind", "start", "end", F.lit(True).alias("base"), "score")
    more = rows.where("broad = 1 and valid and score >= threshold").select("uid", "kind", "start", "end", F.lit(False).alias("base"), "score")
    return ids, resolved(base.union(more))


def resolved(both: DataFrame) -> DataFrame:
    """(uid, kind, start, end, base, score) without the added spans that overlap a base span or a better added one."""
    order = W.partitionBy("uid").orderBy("start", "end")
    prior = order.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("uid").orderBy(F.desc("start"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(prior)
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(later)
    both = both.withColumn("clear", F.col("base") | ((F.coalesce(base_end, F.lit(-1)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))))
    both = both.where("clear").drop("clear")
    # added spans that overlap in a chain are an island; the best of an island go in first, the others where they still fit
    added = both.where("not base").withColumn("far", F.max("end").over(prior))
    added = added.withColumn("island", F.sum(F.when(F.col("far") > F.col("start"), 0).otherwise(1)).over(order))
    one = F.struct((-F.col("score")).alias("rank"), "start", "end", "kind", "score")
    ranked = added.groupBy("uid", "island").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    clash = lambda kept, x: F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    fit = F.aggregate("spans", F.slice("spans", 1, 1), lambda kept, x: F.when(clash(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    chosen = ranked.select("uid", F.explode(fit).alias("x")).select("uid", "x.kind", "x.start", "x.end", F.lit(False).alias("base"), "x.score")
    return both.where("base").unionByName(chosen)


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    shared = Shared(spark)
    ids, spans = found_spans(documents(spark, folder), shared)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    named = spans.withColumn("s", F.struct("start", place.alias("k"), "end", "kind", "base"))
    of = named.groupBy("uid").agg(F.sort_array(F.collect_list("s")).alias("s"), *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS])
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = ids.join(of, "uid", "left")
    none = F.array().cast("array<struct<start:bigint,k:bigint,end:bigint,kind:string,base:boolean>>")
    s = F.coalesce("s", none)
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.filter(s, lambda x: x["base"])), 256).alias("base_sha256"), text(s).alias("spans"),
    )


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
