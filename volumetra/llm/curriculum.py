"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the training run, given at equally
spaced knots and linear between them. Its integral is the source's cumulative
demand. A source's documents are laid out in a fixed pseudo-random order; the
place of a document in it, in words, is a demand, and the time at which the
source's cumulative demand reaches it is the document's training position.
Documents are range-sorted by position.

Running totals inside a source are taken in two levels (buckets of the
pseudo-random order, then rows of a bucket), so a source may hold any share of
the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import WORD, cut, drop, partitions

#: Production parameters: weights by turns, words to take in parts of all words, and most repeats of a source.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Relative weight at the start, middle and end of the run, by turns; each averages 1, so totals follow WEIGHTS.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))
#: Rows of one bucket, about.
BUCKET_ROWS = 5_000


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def time_of(demand: Column, schedule: Column, knots: int) -> Column:
    """Invert a schedule's integral: the time in 0..1 at which it reaches `demand` (a part of its whole)."""
    step = 1.0 / (knots - 1)
    weight = [F.get(schedule, F.lit(k)) for k in range(knots)]
    areas = [(a + b) * (step / 2) for a, b in zip(weight, weight[1:])]
    whole = sum(areas[1:], areas[0])
    goal, so_far, found = demand * whole, F.lit(0.0), F.lit(None).cast("double")
    for k, area in enumerate(areas):
        rest = F.greatest(goal - so_far, F.lit(0.0))
        slope = (weight[k + 1] - weight[k]) / step
        # weight*t + slope*t*t/2 = rest, in the form that stays exact for a small slope
        t = 2 * rest / (weight[k] + F.sqrt(F.greatest(weight[k] * weight[k] + 2 * slope * rest, F.lit(0.0))))
        inside = k * step + F.least(F.coalesce(t, F.lit(0.0)), F.lit(step))
        found = F.coalesce(found, F.when((goal <= so_far + area) | F.lit(k == knots - 2), inside))
        so_far = so_far + area
    return found


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """skey, nth source, rows, source_size and target. Sources that reach `repeats` times their size stop there, and the
    excess goes to the others by weight: with sources in order of cap / weight, the common level is the largest of
    (total - caps before) / (weights from here on)."""
    by = sized.groupBy("skey").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    by = by.withColumn("nth", F.row_number().over(Window.orderBy("skey")) - 1)
    by = by.withColumn("weight", _pick([float(w) for w in weights], F.col("nth"))).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - before) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return by.select("skey", "nth", "n_rows", "source_size", F.round(F.least("cap", F.col("weight") * F.col("level")), 6).alias("target"))


def curriculum(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules=SCHEDULES, *, carry: bool = False, whole: bool = False, made: list | None = None) -> DataFrame:
    """The mix's decision on each row of docs: doc_id, size, source_size, target, taken and placements, an array of
    (position in 0..1, words) with an element for each time that the document is read; with carry, also row, all of docs'
    columns. Where a source's last pass ends within a document, only its first words are taken; with whole, all or none of
    them, whichever lies nearer the target. A list `made` is given the tables that can go once the result is written.

    Takes doc_id, source and text. Null and empty texts have size 0 and are taken 0 times; a null source is a source of
    its own, ordered last; null ids may all lie in one bucket. Every row gets one row back, equal rows too; ties in the
    pseudo-random order go by doc_id. An empty table gives an empty one; other columns, whatever their names, are ignored.
    """
    skey = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", skey.alias("skey"), size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), *([F.struct("*").alias("row")] if carry else []))
    sized = cut(sized)
    targets = cut(source_targets(sized, weights, share, repeats))
    if made is not None:
        made += [sized, targets]
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n_rows") / BUCKET_ROWS) / 2**32)
    placed = sized.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, "skey").withColumn("bucket", bucket)
    sums = placed.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    base = sums.select("skey", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(base, ["skey", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("passes", passes.cast("long")).withColumn("goal", goal)
    last = F.least("size", F.greatest(F.col("goal") - F.col("passes") * F.col("source_size") - F.col("before"), F.lit(0)))
    rows = rows.withColumn("last", last)
    if whole:
        rows = rows.withColumn("last", F.when(2 * F.col("last") >= F.col("size"), F.col("size")).otherwise(0))
    schedule = _pick_schedule(schedules, F.col("nth"))
    words = F.transform(F.sequence(F.lit(0), F.col("passes").cast("int")), lambda p: F.struct(p.alias("p"), F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("last")).alias("words")))
    placements = F.transform(
        F.filter(words, lambda x: x["words"] > 0),
        lambda x: F.struct(F.round(time_of((x["p"] * F.col("source_size") + F.col("before") + x["words"] / 2) / F.col("goal"), schedule, len(schedules[0])), 12).alias("position"), x["words"].alias("words")),
    )
    taken = (F.col("size") * F.col("passes") + F.col("last")).alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", taken, placements.alias("placements"), *(["row"] if carry else []))


def _pick_schedule(schedules, at: Column) -> Column:
    return F.element_at(F.array(*(F.array(*(F.lit(float(w)) for w in s)) for s in schedules)), (at % len(schedules) + 1).cast("int"))


def range_sorted(rows: DataFrame, *by) -> DataFrame:
    return rows.repartitionByRange(partitions(rows), *by).sortWithinPartitions(*by)


def training_order(docs: DataFrame, **parameters) -> DataFrame:
    """docs as the run reads them: a row for each placement, range-sorted by position, all columns kept. Documents are read
    whole. Rows without words are read by nobody; see curriculum() for nulls, ties and repeats."""
    columns = docs.columns
    made: list[DataFrame] = []
    one = curriculum(docs, **parameters, carry=True, whole=True, made=made).select("row", F.explode("placements").alias("at"))
    one = cut(one)  # the texts have moved for the running totals: those files go before they move for the order
    drop(*made)
    rows = one.select(*(F.col("row").getField(c).alias(c) for c in columns), F.col("at.position").alias("_position"))
    return range_sorted(rows, "_position", "doc_id").drop("_position")


def with_place(docs: DataFrame, name: str = "place") -> DataFrame:
    """docs with each row's place, in 0..1, in the order in which they were written (files in order of their names, as
    Spark numbers the partitions of a sorted table), or in which they come, if they were not read from files."""
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        rows.schema
    except AnalysisException:  # no files
        rows = docs.select("*", F.shiftright(F.monotonically_increasing_id(), 33).alias("_file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    files = rows.groupBy("_file").agg((F.max("_at") + 1).alias("_rows"))
    numbered = files.withColumn("_nth", F.row_number().over(Window.orderBy("_file")) - 1).withColumn("_files", F.count("*").over(Window.partitionBy()))
    return rows.join(F.broadcast(numbered), "_file").select(*(docs[c] for c in docs.columns), ((F.col("_nth") + F.col("_at") / F.col("_rows")) / F.col("_files")).alias(name))
