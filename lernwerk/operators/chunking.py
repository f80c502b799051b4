"""Chunkers and card generators (CHK1-CHK9).

A document is one row, so cutting it needs no shuffle: the folds run over the arrays of that row and
the chunks are exploded at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import let, strip, words
from ..functions.text import clean_markdown, content_type, paragraphs, preview


def fixed_chunks(docs: DataFrame, size: int = 300) -> DataFrame:
    """CHK1: chunks of ``size`` words; order and word positions are 1-based."""
    def cut(ws: Column) -> Column:
        starts = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1, F.lit(size)))
        return F.transform(starts, lambda s, i: F.struct(
            (i + 1).cast("long").alias("chunk_order"),
            F.array_join(F.slice(ws, s + 1, F.lit(size)), " ").alias("chunk_text"),
            (s + 1).cast("long").alias("word_start"),
            F.least(s + size, F.size(ws)).cast("long").alias("word_end"),
        ))

    rest = [c for c in docs.columns if c != "text"]
    pieces = docs.select(*rest, F.explode(let(words(F.col("text")), cut)).alias("c"))
    return pieces.select(*rest, "c.*", (F.col("c.word_end") - F.col("c.word_start") + 1).alias("word_count"))


def sentence_chunks(docs: DataFrame, size: int = 350, lookback: int = 50, min_keep: int = 100) -> DataFrame:
    """CHK2: chunks that end at a sentence where one ends near the limit.

    Each cut depends on the one before it, so the cuts are a fold whose steps jump from cut to cut: a step
    looks only at the ``lookback`` words before its limit.  There is no overlap.
    """
    ends = lambda w: F.substring(w, -1, 1).isin(".", "!", "?")
    advance = max(1, min(min_keep + 1, size))  # words between two cuts, at least

    def cuts(ws: Column) -> Column:
        total = F.size(ws)

        def cut(at: Column) -> Column:
            def within(limit: Column) -> Column:
                floor = F.greatest(limit - lookback, at + min_keep)
                near = F.slice(ws, floor + 1, F.greatest(limit - floor, F.lit(0)))
                last = F.array_max(F.transform(near, lambda w, i: F.when(ends(w), i + 1)))
                return F.when(limit < total, F.coalesce(floor + last, limit)).otherwise(limit)

            return let(F.least(at + size, total), within)

        step = lambda found, _: let(F.element_at(found, -1), lambda at: F.when(at >= total, found).otherwise(F.concat(found, F.array(cut(at)))))
        return F.aggregate(F.sequence(F.lit(1), F.ceil(total / advance).cast("int")), F.array(F.lit(0)), step)

    split = docs.select("doc_id", "text", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    short = split.where(F.size("ws") <= size).select(
        "doc_id", F.lit(0).cast("long").alias("chunk_order"), F.col("text").alias("chunk_text"),
        F.lit(0).cast("long").alias("word_start"), F.size("ws").cast("long").alias("word_end"),
    )
    cut = split.where(F.size("ws") > size).select("doc_id", "ws", cuts(F.col("ws")).alias("cuts"))
    pieces = F.transform(
        F.slice(F.col("cuts"), F.lit(1), F.size("cuts") - 1),
        lambda s, i: F.struct(
            i.cast("long").alias("chunk_order"),
            F.array_join(F.slice(F.col("ws"), s + 1, F.get(F.col("cuts"), i + 1) - s), " ").alias("chunk_text"),
            s.cast("long").alias("word_start"),
            F.get(F.col("cuts"), i + 1).cast("long").alias("word_end"),
        ),
    )
    long = cut.select("doc_id", F.explode(pieces).alias("c")).select("doc_id", "c.*")
    return short.unionByName(long).withColumn("word_count", F.col("word_end") - F.col("word_start"))


def pack(items: Column, weight, joins) -> Column:
    """Greedy packing of an array: the 0-based start of each group, as array<int>.

    ``joins(total, members, w)`` says whether an item of weight w may join the open group.  The
    accumulator holds the starts only, never the items.
    """
    start = F.struct(
        F.lit(0.0).alias("total"), F.lit(0).alias("members"), F.lit(0).alias("pos"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, item: Column) -> Column:
        w = weight(item).cast("double")
        return let((acc["members"] > 0) & joins(acc["total"], acc["members"], w), lambda stay: F.struct(
            F.when(stay, acc["total"] + w).otherwise(w).alias("total"),
            F.when(stay, acc["members"] + 1).otherwise(F.lit(1)).alias("members"),
            (acc["pos"] + 1).alias("pos"),
            F.when(stay, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["pos"]))).alias("starts"),
        ))

    return F.aggregate(items, start, step)["starts"]


def groups_of(items: Column, starts: Column) -> Column:
    """The items cut at ``starts``: array<array<item>>."""
    return F.transform(starts, lambda s, i: F.slice(
        items, s + 1, F.coalesce(F.get(starts, i + 1), F.size(items)) - s
    ))


def pack_paragraphs(docs: DataFrame, lo: int = 100, hi: int = 800, keep_tail: bool = True) -> DataFrame:
    """CHK3: paragraphs packed into chunks of ``lo`` to ``hi`` words.

    A trailing chunk below ``lo``, or a whole document below it, stays a chunk; without ``keep_tail`` it is dropped.
    """
    sized = docs.select("doc_id", F.transform(
        paragraphs(F.col("text")), lambda p: F.struct(p.alias("text"), F.size(words(p)).alias("n"))
    ).alias("ps"))
    cut = sized.select("doc_id", "ps", pack(
        F.col("ps"), lambda p: p["n"], lambda total, members, w: (total + w <= hi) | (total < lo)
    ).alias("starts"))
    rows = cut.select("doc_id", F.posexplode(groups_of(F.col("ps"), F.col("starts"))).alias("chunk_order", "g")).select(
        "doc_id", F.col("chunk_order").cast("long").alias("chunk_order"),
        F.array_join(F.transform("g", lambda p: p["text"]), "\n\n").alias("chunk_text"),
        F.aggregate("g", F.lit(0).cast("long"), lambda acc, p: acc + p["n"]).alias("word_count"),
    )
    return rows if keep_tail else rows.where(F.col("word_count") >= lo)


def split_large(communities: DataFrame, words_limit: int = 1500, chunk_limit: int = 6, cap: int = 800) -> DataFrame:
    """CHK4: communities above either limit are re-packed greedily to ``cap`` words.

    Input: doc_id, community_id, word_count and chunks, an array of {chunk_order, chunk_text, n_words}.
    """
    large = (F.col("word_count") > words_limit) | (F.size("chunks") > chunk_limit)
    starts = F.when(large, pack(F.col("chunks"), lambda c: c["n_words"], lambda total, members, w: total + w <= cap)).otherwise(
        F.array(F.lit(0))
    )
    parts = communities.withColumn("starts", starts).select(
        "doc_id", "community_id", F.posexplode(groups_of(F.col("chunks"), F.col("starts"))).alias("part", "g")
    )
    return parts.select(
        "doc_id", "community_id", F.col("part").cast("long").alias("part"), F.size("g").cast("long").alias("n_chunks"),
        F.aggregate("g", F.lit(0).cast("long"), lambda acc, c: acc + c["n_words"]).alias("word_count"),
        F.array_join(F.transform("g", lambda c: c["chunk_text"]), "\n\n").alias("combined_text"),
    )


def split_even(groups: DataFrame, max_groups: int = 4, single: int = 3) -> DataFrame:
    """CHK5: an oversized group is cut evenly into min(max_groups, (n+2)//3) parts; the last takes the rest.

    Input: group_id, pos (0-based inside the group) and n (its size).  Pure index arithmetic.
    """
    n, parts = F.col("n"), F.least(F.lit(max_groups).cast("long"), F.floor((F.col("n") + 2) / 3))
    size = F.floor(n / parts)
    part = F.when(n <= single, F.lit(0).cast("long")).otherwise(F.least(F.floor(F.col("pos") / size), parts - 1))
    return groups.withColumn("part", part)


# --- markdown ---------------------------------------------------------------------------------


def markdown_sections(files: DataFrame, compat: bool = False) -> DataFrame:
    """CHK6: sections of markdown files as (path, section_order, heading, level, content, content_type).

    ``compat`` keeps two quirks: text before the first heading is lost, and the body of the last section
    comes back once more under the heading ``Introduction``.  Without it the preamble is kept as the
    introduction and every section appears once.
    """
    body = F.col("content")
    head = "(?m)^(#{1,2})\\s+(.+)$"
    split = files.select(
        "path",
        F.split(body, "(?m)^#{1,2}\\s+.+$").alias("parts"),
        F.regexp_extract_all(body, F.lit(head), F.lit(1)).alias("marks"),
        F.regexp_extract_all(body, F.lit(head), F.lit(2)).alias("titles"),
    )
    count = F.size("titles")
    intro = F.lit("Introduction")
    section = F.transform(F.col("titles"), lambda t, i: F.struct(
        i.alias("section_order"), strip(t).alias("heading"), F.length(F.get(F.col("marks"), i)).alias("level"),
        clean_markdown(F.get(F.col("parts"), i + 1)).alias("content"),
        clean_markdown(F.get(F.col("parts"), i + 1)).alias("basis"),
    ))
    loose_part = F.when(count == 0, F.get(F.col("parts"), F.lit(0))).otherwise(
        F.get(F.col("parts"), count) if compat else F.get(F.col("parts"), F.lit(0))
    )
    loose = F.struct(
        (count if compat else F.lit(-1)).alias("section_order"), intro.alias("heading"), F.lit(1).alias("level"),
        clean_markdown(strip(loose_part)).alias("content"), strip(loose_part).alias("basis"),
    )
    rows = split.select("path", F.explode(F.concat(section, F.array(loose))).alias("s")).select("path", "s.*")
    kept = rows.where(F.when(F.col("heading") == intro, F.length("basis") > 0).otherwise(F.length("content") > 0))
    return kept.select(
        "path", F.col("section_order").cast("long").alias("section_order"), "heading",
        F.col("level").cast("long").alias("level"), "content", content_type(F.col("basis")).alias("content_type"),
    )


def card_candidates(sections: DataFrame) -> DataFrame:
    """CHK7: question/answer candidates per section; example and procedure sections give none."""
    c, heading = F.col("content"), F.col("heading")

    def card(question: Column, answer: Column) -> Column:
        return F.struct(question.alias("question"), answer.alias("answer"))

    bold = r"\*\*([^*]+)\*\*:[\s]*([^\n]+)"
    terms, meanings = (F.regexp_extract_all(c, F.lit("(?U)" + bold), F.lit(g)) for g in (1, 2))
    definitions = F.transform(F.arrays_zip(terms.alias("t"), meanings.alias("m")), lambda z: card(
        F.concat(F.lit("What is "), z["t"], F.lit("?")), strip(z["m"])))
    items = F.regexp_extract_all(c, F.lit(r"(?mU)^\s*[-*+]\s*(.+)$"), F.lit(1))
    listing = let(items, lambda xs: F.when(F.size(xs) > 1, F.array(card(
        F.concat(F.lit("List the main points about "), heading),
        F.array_join(F.transform(xs, lambda x: F.concat(F.lit("• "), strip(x))), "\n")))))
    fences = F.regexp_extract_all(c, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    code = F.transform(fences, lambda x: card(
        F.concat(F.lit("How do you implement "), heading, F.lit("? (Code example)")),
        F.concat(F.lit("```\n"), strip(x), F.lit("\n```"))))
    plain = F.regexp_replace(F.regexp_replace(c, r"\*\*([^*]+)\*\*", "$1"), r"`([^`]+)`", "$1")
    concept = let(plain, lambda p: F.when(F.length(strip(p)) > 50, F.array(card(
        F.concat(F.lit("Explain "), heading),
        F.concat(F.substring(strip(p), 1, 500), F.when(F.length(p) > 500, "...").otherwise(""))))))
    kind = F.col("content_type")
    cards = (
        F.when(kind == "definition", definitions).when(kind == "list", listing)
        .when(kind == "code", code).when(kind == "concept", concept)
    )
    return sections.select(
        "path", "section_order", F.posexplode(cards).alias("card_order", "card"),
        heading.alias("context"), preview(c, 200).alias("original_content"), kind.alias("content_type"),
    ).select(
        F.col("path").alias("source_file"), "section_order", F.col("card_order").cast("long").alias("card_order"),
        "card.question", "card.answer", "context", "original_content", "content_type",
    )


def folder_cards(files: DataFrame, compat: bool = False) -> DataFrame:
    """CHK8: all card candidates of a folder of markdown files; narrow from scan to cards."""
    return card_candidates(markdown_sections(files, compat))


def cards_by_type(cards: DataFrame) -> DataFrame:
    """CHK8 summary: cards and source files per content type."""
    return cards.groupBy("content_type").agg(
        F.count("*").alias("n_cards"), F.count_distinct("source_file").alias("n_files")
    )


def basic_cards(candidates: DataFrame) -> DataFrame:
    """CHK9: candidates as plain cards of medium difficulty, tagged with their context."""
    return candidates.withColumn("difficulty", F.lit("medium")).withColumn(
        "tags", F.array(F.replace(F.lower("context"), F.lit(" "), F.lit("_")))
    )
