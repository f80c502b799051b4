"""Spaced-repetition state, due lists, plans and sequences (SRS1-SRS17).

Times: ``ts`` columns are timestamps without zone; "now" is always the parameter ``as_of``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed values of the two schedules.
FIRST_DAYS, SECOND_DAYS, LAPSE_HOURS = 1, 6, 6
BLOCK_INTERVALS = (1, 3, 7, 15, 30)
RATING_FACTORS = {1: 0.5, 2: 0.7, 3: 1.0, 4: 1.3, 5: 1.5}
FIXED_DAYS = (1, 3, 7, 21, 52)
EASE_START, EASE_MIN, EASE_MAX = 2.5, 1.3, 4.0
MAX_DAYS = 2_900_000          # about the end of year 9999
MINUTES_PER_BLOCK = 7
PRESETS = {
    "quick": (20, 0.8), "balanced": (45, 0.4), "deep": (90, 0.2),
    "offline_quick": (20, 0.8), "offline_balanced": (60, 0.3), "offline_deep": (120, 0.2),
}

STATE_FIELDS = (
    "status string, review_count long, lapses long, time_s long, avg_rating double, qa_score double, ease double, "
    "stability double, interval long, due_after_s long"
)


# --- state update -----------------------------------------------------------------------------

def step_sync(s: dict, rating: int, time_s: int, correct: int, total: int) -> None:
    """Offline sync: a first report is stored as completed; later ones go through the day schedule."""
    if s["review_count"] == 0:
        s.update(status="completed", review_count=1, avg_rating=float(rating), time_s=s["time_s"] + time_s)
    else:
        step_day(s, rating, time_s, 0, 0)


def step_sync_enhanced(s: dict, rating: int, time_s: int, correct: int, total: int) -> None:
    """Offline sync, enhanced variant: every report goes through the day schedule and ends as completed."""
    step_day(s, rating, time_s, 0, 0)
    s["status"] = "completed"


def fresh_state() -> dict:
    return {
        "status": "new", "review_count": 0, "lapses": 0, "time_s": 0, "avg_rating": None, "qa_score": None,
        "ease": EASE_START, "stability": 1.0, "interval": 0, "due_after_s": None,
    }


def _common(s: dict, rating: int, time_s: int, correct: int, total: int) -> None:
    s["review_count"] += 1
    s["time_s"] += time_s
    s["avg_rating"] = float(rating) if s["avg_rating"] is None else s["avg_rating"] * 0.7 + rating * 0.3
    if total > 0:
        share = correct / total
        s["qa_score"] = share if s["qa_score"] is None else s["qa_score"] * 0.6 + share * 0.4


def _ease_after(s: dict, rating: int) -> None:
    gain = {5: 0.15, 4: 0.1}.get(rating)
    if gain:
        s["ease"] = min(EASE_MAX, s["ease"] + gain)


def _lapse(s: dict) -> None:
    s["lapses"] += 1
    s["status"] = "lapsed"
    s["ease"] = max(EASE_MIN, s["ease"] - 0.2)
    s["stability"] = max(1.0, s["stability"] * 0.8)


def step_day(s: dict, rating: int, time_s: int, correct: int, total: int) -> None:
    """SRS1: one review on the day schedule.  ``due_after_s`` counts seconds from the review.

    A review that would fall due beyond the calendar counts like any other; its interval ends with the calendar,
    at ``MAX_DAYS`` days, by which such states can be told."""
    grown = s["status"] not in ("new", "learning")
    days = {"new": FIRST_DAYS, "learning": SECOND_DAYS}.get(s["status"]) or min(MAX_DAYS, max(1, int(s["stability"] * s["ease"])))
    _common(s, rating, time_s, correct, total)
    if rating < 3:
        _lapse(s)
        s["due_after_s"] = LAPSE_HOURS * 3600
        return
    if grown:
        s["stability"] = float(days)
    else:
        s["status"] = "learning" if s["status"] == "new" else "review"
    s["due_after_s"] = days * 86400
    _ease_after(s, rating)


def step_block(s: dict, rating: int, time_s: int, correct: int, total: int) -> None:
    """SRS2: one review on the block schedule; ``interval`` is the number of other reviews until due."""
    _common(s, rating, time_s, correct, total)
    if rating < 3:
        _lapse(s)
        s["interval"] = 1
        return
    if s["status"] == "new":
        s["status"], s["interval"] = "learning", BLOCK_INTERVALS[0]
    elif s["status"] == "learning":
        s["status"], s["interval"] = "review", BLOCK_INTERVALS[1]
    else:
        level = min(s["review_count"] - 1, len(BLOCK_INTERVALS) - 1)
        s["interval"] = max(1, int(BLOCK_INTERVALS[level] * RATING_FACTORS.get(rating, 1.0) * s["ease"]))
        s["stability"] = float(s["interval"])
    _ease_after(s, rating)


STATE_NAMES = [f.split()[0] for f in STATE_FIELDS.split(", ")]
_REVIEW = ["rating", "time_s", "qa_correct", "qa_total"]


def fold_reviews(reviews: DataFrame, step: Callable, first_review: str = "new", initial: DataFrame | None = None, late: bool = False) -> DataFrame:
    """State per (user_id, block_id) after all its reviews in (ts, event_id) order.

    The recurrence truncates and clamps, so it is sequential per key.  The rows are partitioned by key and
    sorted, and each task streams them in Arrow batches with one state carried over batch borders: memory
    is one batch and one state, however long a key is, and no group is collected.  Stored states
    (``initial``) enter the same sort in front of the reviews of their key.  With ``late`` a state also tells whether a review
    older than one already applied has reached it.
    """
    keys = ["user_id", "block_id"]
    rows = reviews.select(*keys, "ts", "event_id", *[F.col(c).cast("long").alias(c) for c in _REVIEW])
    if initial is not None:
        seeds = initial.select(*keys, F.col("last_reviewed_at").alias("ts"), *STATE_NAMES, *(["late"] if late else []), F.lit(True).alias("seed"))
        rows = rows.withColumn("seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    seeded = initial is not None
    order = [*keys, *([F.desc("seed")] if seeded else []), "ts", "event_id"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*order)

    def start(rating: int) -> dict:
        s = fresh_state()
        if first_review == "completed":
            s.update(status="completed", review_count=1, avg_rating=float(rating))
        return s

    def stored(row: dict) -> dict:
        s = {n: (None if pd.isna(row[n]) else row[n]) for n in STATE_NAMES}
        return {n: int(v) if v is not None and n in ("review_count", "lapses", "time_s", "interval", "due_after_s") else v for n, v in s.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last, behind = None, None, None, False
        for batch in batches:
            out = []
            seeds = batch["seed"].tolist() if seeded else [False] * len(batch)
            columns = [batch[c].tolist() for c in (*keys, *_REVIEW)]
            times = list(batch["ts"])
            for at, (user, block, rating, time_s, correct, total) in enumerate(zip(*columns)):
                now = times[at]
                if key != (user, block):
                    if key is not None:
                        out.append((*key, last, *[state[n] for n in STATE_NAMES], *([behind] if late else [])))
                    key, last, behind = (user, block), now, False
                    state = stored(batch.iloc[at]) if seeds[at] else start(int(rating))
                    if seeds[at] and late:
                        behind = bool(batch["late"].iloc[at])
                if not seeds[at]:
                    step(state, int(rating), int(time_s), int(correct), int(total))
                if now < last:
                    behind = True
                else:
                    last = now
            if out:
                yield frame(out)
        if key is not None:
            yield frame([(*key, last, *[state[n] for n in STATE_NAMES], *([behind] if late else []))])

    def frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=[*keys, "last_reviewed_at", *STATE_NAMES, *(["late"] if late else [])])

    kind = dict(reviews.dtypes)["ts"]
    return ordered.mapInPandas(run, f"user_id long, block_id long, last_reviewed_at {kind}, {STATE_FIELDS}" + ", late boolean" * late)


def day_state(reviews: DataFrame) -> DataFrame:
    """SRS1: state per learner and block on the day schedule."""
    state = fold_reviews(reviews, step_day)
    due = F.col("last_reviewed_at") + F.make_dt_interval(secs=F.col("due_after_s").cast("decimal(18,6)"))
    return state.withColumn("next_due_at", due).drop("interval")


def block_state(reviews: DataFrame, first_review: str = "learning") -> DataFrame:
    """SRS2: state on the block schedule; ``first_review="completed"`` seeds a first review as completed."""
    state = fold_reviews(reviews, step_block, first_review)
    return state.withColumnRenamed("interval", "next_due_after").drop("due_after_s").withColumn("studied_count", F.lit(0).cast("long"))


def review_counter(reviews: DataFrame, states: DataFrame) -> DataFrame:
    """SRS3: ``states`` with studied_count = min(due, the learner's reviews after the state's last one).

    Reviews are counted per (learner, day) first.  A state then adds the later days and the later
    reviews of its own day, so a learner with a large share of all reviews is spread over days.
    """
    r = reviews.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id")
    days = r.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    later = W.partitionBy("user_id").orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)
    day_sums = days.select("user_id", "day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("after_day"))
    inside = r.withColumn("rest_of_day", F.row_number().over(W.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("event_id"))) - 1)
    # the rank of a state's own last review inside its day; equal times count from the latest
    last = inside.groupBy("user_id", "day", F.col("ts").alias("last_reviewed_at")).agg(F.min("rest_of_day").alias("rest_of_day"))
    keyed = states.drop("studied_count").withColumn("day", F.to_date("last_reviewed_at"))
    joined = keyed.join(last, ["user_id", "day", "last_reviewed_at"], "left").join(day_sums, ["user_id", "day"], "left")
    seen = (F.coalesce("after_day", F.lit(0)) + F.coalesce("rest_of_day", F.lit(0))).cast("long")
    return joined.withColumn("studied_count", F.least("next_due_after", seen)).drop("day", "rest_of_day", "after_day")


# --- lists over stored states -----------------------------------------------------------------

def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def due_flags(states: DataFrame, as_of: str) -> DataFrame:
    """SRS4: is_due, blocks_until_due and days_until_due (floored, negative when overdue)."""
    by_block = F.col("next_due_after").isNotNull()
    due = F.when(by_block, F.col("studied_count") >= F.col("next_due_after")).when(
        F.col("next_due_at").isNull(), F.col("status") == "new").otherwise(F.col("next_due_at") <= _at(as_of))
    seconds = F.timestamp_diff("SECOND", _at(as_of), F.col("next_due_at").cast("timestamp_ntz"))
    return states.withColumn("is_due", due).withColumn(
        "blocks_until_due", F.when(by_block, F.col("next_due_after") - F.col("studied_count")).otherwise(0).cast("long")
    ).withColumn("days_until_due", F.coalesce(F.floor(seconds / 86400), F.lit(0)).cast("long"))


def due_list(states: DataFrame, as_of: str, include_overdue: bool = True) -> DataFrame:
    """SRS5: due states with their place in the learner's list (due blocks, due time, status; nulls last).

    Without ``include_overdue`` a timed state counts on its due date only."""
    timed = F.col("next_due_at") <= _at(as_of) if include_overdue else F.to_date("next_due_at") == F.to_date(_at(as_of))
    due = (
        (F.col("status") == "new")
        | (F.col("next_due_after").isNotNull() & (F.col("studied_count") >= F.col("next_due_after")))
        | (F.col("next_due_after").isNull() & timed)
    )
    order = W.partitionBy("user_id").orderBy(
        F.asc_nulls_last("next_due_after"), F.asc_nulls_last("next_due_at"), "status", "block_id")
    return states.where(due).withColumn("place", F.row_number().over(order).cast("long"))


def struggling(states: DataFrame, rating: float = 2.5) -> DataFrame:
    """SRS6: states with a low mean rating, a lapse as status, or two lapses; with their place per learner."""
    weak = (F.col("avg_rating") < rating) | (F.col("status") == "lapsed") | (F.col("lapses") >= 2)
    order = W.partitionBy("user_id").orderBy(F.asc_nulls_last("avg_rating"), F.desc("lapses"), "block_id")
    return states.where(weak).withColumn("place", F.row_number().over(order).cast("long"))


def new_blocks(candidates: DataFrame, states: DataFrame, completed: DataFrame | None) -> DataFrame:
    """SRS7: the blocks of a learner's catalogue without a state and not completed in a session.

    ``candidates(user_id, block_id, ...)`` is the catalogue per learner; two anti-joins on its key."""
    keys = ["user_id", "block_id"]
    out = candidates.join(states.select(*keys), keys, "left_anti")
    return out if completed is None else out.join(completed.select(*keys), keys, "left_anti")


def fixed_schedule(attempts: DataFrame) -> DataFrame:
    """SRS8: interval of each completed attempt on the fixed day schedule, by the completions before it.

    ``attempts(attempt_id, block_id, completed_at, proficiency)``.  Only the first completions of a block
    differ, so a level needs the first five per block: these are found with a group limit, and every
    later attempt is at the top level without being counted.
    """
    top = len(FIXED_DAYS)
    place = F.row_number().over(W.partitionBy("block_id").orderBy("completed_at", "attempt_id"))
    early = attempts.select("attempt_id", "block_id", "completed_at").withColumn("level", place - 1).where(F.col("level") < top)
    joined = attempts.join(early.select("attempt_id", "level"), "attempt_id", "left")
    level = F.coalesce("level", F.lit(top - 1))
    days = F.element_at(F.array(*[F.lit(float(d)) for d in FIXED_DAYS]), (level + 1).cast("int"))
    return joined.withColumn("level", level.cast("long")).withColumn("interval_days", F.floor(days * rating_factor(F.col("proficiency"))).cast("long"))


def rating_factor(rating: Column) -> Column:
    out = F
    for value, factor in RATING_FACTORS.items():
        out = out.when(rating == value, F.lit(factor))
    return out.otherwise(F.lit(1.0))


class FreePlaces:
    """The places 0, 1, 2, ... and which of them are free: a tree of counts (Fenwick) that doubles when it must."""

    def __init__(self) -> None:
        self.size, self.free = 1, [0, 1]

    def take(self, p: int) -> int:
        """The p-th free place, from 0; it is free no longer."""
        free = self.free
        while free[self.size] <= p:
            size = self.size
            free += [i & -i for i in range(size + 1, 2 * size)] + [free[size] + size]
            self.size = 2 * size
        at, step = 0, self.size
        while step:
            if free[at + step] <= p:
                at += step
                p -= free[at]
            else:
                free[at + step] -= 1
            step >>= 1
        return at


# --- sequences and plans (per learner; frames carry master_pos, the place in the catalogue order) ---

def dynamic_sequence(master: DataFrame, states: DataFrame, completed: DataFrame) -> DataFrame:
    """SRS9: the learner's sequence with completed blocks inserted where they fall due.

    ``master(user_id, block_id, master_pos)``.  In master order, each completed block is inserted at
    min(max(due - studied, 0), length).  An insertion shifts everything behind it, so the final places are
    filled from the last insertion back: an item takes the p-th place that is still free.  Only completed
    blocks go through that step; it streams them sorted and keeps a count tree over as many places as the
    largest place taken needs, so that each costs a logarithm of these.  New blocks fill the remaining places by one window.
    """
    keys = ["user_id", "block_id"]
    s = states.select(*keys, "status", "next_due_after", "studied_count")
    flagged = master.join(s, keys, "left").join(completed.select(*keys).distinct().withColumn("_c", F.lit(True)), keys, "left")
    is_done = F.coalesce(F.col("status").isin("completed", "review", "learning"), F.lit(False)) | F.coalesce("_c", F.lit(False))
    flagged = flagged.withColumn("done", is_done)
    new = flagged.where(~F.col("done")).select(*keys, "master_pos")
    counts = new.groupBy("user_id").agg(F.count("*").alias("n_new"))
    review = flagged.where(F.col("done") & F.col("next_due_after").isNotNull()).join(counts, "user_id", "left")
    before = F.row_number().over(W.partitionBy("user_id").orderBy("master_pos")) - 1
    wanted = F.greatest(F.col("next_due_after") - F.coalesce("studied_count", F.lit(0)), F.lit(0))
    placed = review.withColumn("p", F.least(wanted, F.coalesce("n_new", F.lit(0)) + before).cast("long"))
    ordered = placed.select("user_id", "block_id", "master_pos", "p").repartition("user_id").sortWithinPartitions("user_id", F.desc("master_pos"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, free = None, FreePlaces()
        for batch in batches:
            slots = []
            for u, p in zip(batch["user_id"].tolist(), batch["p"].tolist()):
                if u != user:
                    user, free = u, FreePlaces()
                slots.append(free.take(p))
            yield batch[["user_id", "block_id"]].assign(slot=slots)

    slots = ordered.mapInPandas(fill, "user_id long, block_id long, slot long")
    # a review at slot x with j reviews before it follows x - j new blocks
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("slot")) - 1
    reviews = slots.select(*keys, (F.col("slot") - rank).alias("after_new"), F.col("slot").alias("tie"), F.lit("review").alias("type"))
    k = F.row_number().over(W.partitionBy("user_id").orderBy("master_pos")) - 1
    news = new.select(*keys, k.cast("long").alias("after_new"), F.lit(None).cast("long").alias("tie"), F.lit("new").alias("type"))
    both = reviews.unionByName(news)
    place = F.row_number().over(W.partitionBy("user_id").orderBy("after_new", F.asc_nulls_last("tie")))
    return both.select(*keys, "type", place.cast("long").alias("position"))


def interleave(new: DataFrame, review: DataFrame, total: int | None = None) -> DataFrame:
    """SRS10: three new blocks, then one review; all of them, or the first ``total``.

    ``new(user_id, block_id, master_pos)``; ``review(user_id, block_id, blocks_until_due, master_pos)`` in
    order of urgency.  Closed form on ranks; with ``total`` only the first so many of each side can appear,
    so the ranks come from a group limit.
    """
    n = new.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("master_pos")) - 1)
    r = review.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("blocks_until_due", "master_pos")) - 1)
    if total is not None:
        n, r = n.where(F.col("k") < total), r.where(F.col("k") < total)
    n_new = n.groupBy("user_id").agg(F.count("*").alias("n_new"))
    n_rev = r.groupBy("user_id").agg(F.count("*").alias("n_rev"))
    a = n.join(n_rev, "user_id", "left").select(
        "user_id", "block_id", F.lit("new").alias("type"),
        (F.col("k") + F.least(F.floor(F.col("k") / 3), F.coalesce("n_rev", F.lit(0)))).alias("at"))
    b = r.join(n_new, "user_id", "left").select(
        "user_id", "block_id", F.lit("review").alias("type"),
        (F.col("k") + F.least(3 * (F.col("k") + 1), F.coalesce("n_new", F.lit(0)))).alias("at"))
    both = a.unionByName(b)
    if total is not None:
        both = both.where(F.col("at") < total)
    return both.select("user_id", "block_id", "type", (F.col("at") + 1).cast("long").alias("position"))


def quota_plan(master: DataFrame, completed: DataFrame, minutes: int = 60, ratio: float = 0.3) -> DataFrame:
    """SRS11: the first blocks in master order within the review and new quotas, then topped up in order."""
    total = max(1, minutes // MINUTES_PER_BLOCK)
    review_quota = int(total * ratio)
    done = completed.select("user_id", "block_id").distinct().withColumn("is_review", F.lit(True))
    flagged = master.select("user_id", "block_id", "master_pos").join(done, ["user_id", "block_id"], "left").withColumn(
        "is_review", F.coalesce("is_review", F.lit(False)))
    rank = F.row_number().over(W.partitionBy("user_id", "is_review").orderBy("master_pos"))
    quota = F.when(F.col("is_review"), F.lit(review_quota)).otherwise(F.lit(total - review_quota))
    # nobody below the total inside its kind can be chosen, so each kind is limited before the second sort
    head = flagged.withColumn("r", rank).where(F.col("r") <= total).withColumn("over", F.col("r") > quota)
    place = F.row_number().over(W.partitionBy("user_id").orderBy("over", "master_pos"))
    return head.withColumn("place", place.cast("long")).where(F.col("place") <= total).select("user_id", "block_id", "is_review", "place")


def simple_plan(master: DataFrame, completed: DataFrame, minutes: int = 60) -> DataFrame:
    """SRS12: the first blocks not yet completed."""
    left = master.select("user_id", "block_id", "master_pos").join(completed.select("user_id", "block_id"), ["user_id", "block_id"], "left_anti")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("master_pos"))
    return left.withColumn("place", place.cast("long")).where(F.col("place") <= minutes // MINUTES_PER_BLOCK).select("user_id", "block_id", "place")


def preset_plans(master: DataFrame, completed: DataFrame) -> DataFrame:
    """SRS13: the plans of all presets; the ranks are taken once for the largest preset."""
    out = None
    for name, (minutes, ratio) in PRESETS.items():
        plan = quota_plan(master, completed, minutes, ratio).withColumn("preset", F.lit(name))
        out = plan if out is None else out.unionByName(plan)
    return out


def next_block(plan: DataFrame, completed: DataFrame, position: Column | int = -1) -> DataFrame:
    """SRS14: (user_id, next_block_id, next_place, status): the first planned block after ``position``
    that is not completed; a learner without one has a completed session."""
    keys = ["user_id", "block_id"]
    after = position if isinstance(position, Column) else F.lit(position)
    left = plan.where(F.col("place") > after).join(completed.select(*keys), keys, "left_anti")
    first = left.groupBy("user_id").agg(F.min(F.struct("place", "block_id")).alias("f"))
    return plan.select("user_id").distinct().join(first, "user_id", "left").select(
        "user_id", F.col("f.block_id").alias("next_block_id"), F.col("f.place").alias("next_place"),
        F.when(F.col("f").isNull(), "completed").otherwise("active").alias("status"))


def unlock_status(master: DataFrame, completed: DataFrame) -> DataFrame:
    """SRS15: completed, available (everything before it completed) or locked.

    The first uncompleted place per learner is an aggregate; it decides every row without a running
    window."""
    keys = ["user_id", "block_id"]
    done = completed.select(*keys).distinct().withColumn("done", F.lit(True))
    flagged = master.select(*keys, "master_pos").join(done, keys, "left")
    first = flagged.where(F.col("done").isNull()).groupBy("user_id").agg(F.min("master_pos").alias("open_at"))
    status = F.when(F.col("done").isNotNull(), "completed").when(F.col("master_pos") == F.col("open_at"), "available").otherwise("locked")
    return flagged.join(first, "user_id", "left").select(*keys, "master_pos", status.alias("status"))


def unlock_counts(unlocked: DataFrame) -> DataFrame:
    """SRS15 counts per learner."""
    return unlocked.groupBy("user_id").agg(*[
        F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("completed", "available", "locked")])


def suspend(states: DataFrame, ids: DataFrame) -> DataFrame:
    """SRS16: the states of ``ids(user_id, block_id)`` suspended."""
    return _rewrite(states, ids, {"status": F.lit("suspended")})


def reset_new(states: DataFrame, ids: DataFrame) -> DataFrame:
    """SRS16: the states of ``ids`` back to new: default ease, counters zero, nothing due."""
    return _rewrite(states, ids, {
        "status": F.lit("new"), "ease": F.lit(EASE_START), "review_count": F.lit(0).cast("long"), "lapses": F.lit(0).cast("long"),
        "next_due_at": F.lit(None).cast("timestamp_ntz"), "next_due_after": F.lit(None).cast("long"), "studied_count": F.lit(0).cast("long"),
    })


def _rewrite(states: DataFrame, ids: DataFrame, changes: dict[str, Column]) -> DataFrame:
    keys = ["user_id", "block_id"]
    marked = states.join(ids.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return marked.select(*[
        F.when(F.col("_hit").isNotNull(), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in states.columns])


def backfill(completions: DataFrame, states: DataFrame, blocks: DataFrame, as_of: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRS17: (states, counts) after taking over session completions.

    ``completions(user_id, block_id, rating, time_s)``, one row per key; a missing rating counts as 3.  A
    missing state is seeded as one review under way and then takes the rating on the day schedule.  An
    existing one whose mean differs takes the rating as its mean and adds the time, otherwise the row is
    skipped, as are unknown blocks.  A dry run changes nothing and reports every existing state as updated.
    """
    keys = ["user_id", "block_id"]
    known = completions.select(*keys, F.coalesce("rating", F.lit(3)).alias("rating"), F.coalesce("time_s", F.lit(0)).alias("time_s")).join(
        blocks.select("block_id", F.lit(True).alias("_known")), "block_id", "left")
    old = states.select(*keys, F.coalesce("avg_rating", F.lit(0.0)).alias("_avg"), F.lit(True).alias("_has"))
    differs = F.lit(True) if dry_run else F.col("_avg") != F.col("rating")
    kind = F.when(F.col("_known").isNull(), "skipped").when(F.col("_has").isNull(), "created").when(differs, "updated").otherwise("skipped")
    joined = known.join(old, keys, "left").withColumn("_kind", kind)
    counts = joined.groupBy(F.col("_kind").alias("kind")).agg(F.count("*").alias("n"))
    if dry_run:
        return states, counts
    good, r = F.col("rating") >= 3, F.col("rating").cast("double")
    ease = F.when(~good, EASE_START - 0.2).when(r == 5, EASE_START + 0.15).when(r == 4, EASE_START + 0.1).otherwise(EASE_START)
    days = int(EASE_START)
    due = _at(as_of) + F.when(good, F.make_dt_interval(days=F.lit(days))).otherwise(F.make_dt_interval(hours=F.lit(LAPSE_HOURS)))
    created = joined.where("_kind = 'created'").select(
        *keys, F.when(good, "review").otherwise("lapsed").alias("status"), (r * 0.7 + r * 0.3).alias("avg_rating"),
        F.when(good, 0).otherwise(1).cast("long").alias("lapses"), F.lit(2).cast("long").alias("review_count"),
        (F.col("time_s") * 2).alias("time_s"), ease.alias("ease"), F.when(good, float(days)).otherwise(1.0).alias("stability"),
        due.alias("next_due_at"), _at(as_of).alias("last_reviewed_at"))
    news = joined.where("_kind = 'updated'").select(*keys, r.alias("_r"), F.col("time_s").alias("_t"))
    changes = {"avg_rating": F.coalesce("_r", "avg_rating"), "time_s": F.col("time_s") + F.coalesce("_t", F.lit(0))}
    kept = states.join(news, keys, "left").select(*[changes.get(c, F.col(c)).alias(c) for c in states.columns])
    return kept.unionByName(created, allowMissingColumns=True), counts
