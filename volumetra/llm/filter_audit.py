"""What each of several document filters does next to the others, whatever the order they are applied in.

Failures are found once for each document and kept as a mask, a bit for each filter. Equal texts are found by sorting:
rows are range-sorted by a fingerprint of the text, by the full text and by doc_id, and a row is a copy if a predecessor
in its run of equal texts has a smaller doc_id. Runs lie within a range, but for texts with more copies than a quarter of
a mean partition's rows: these are dealt out over ranges, and the smallest ids of their runs are merged at the boundaries
(there are fewer than four such texts for each partition, so the merge takes a few rows). Masks are counted by part before
anything else happens to them; counts add up, and every figure of every order is a sum over the 2 ** filters counts of a
part, so that orders cost nothing that grows with the documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import cut, partitions

#: White space between words, and the filters' letters in the order of their bits.
SPACE, SPACES, FILTERS = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r", "ABCDE"
#: Limits of the filters A to C: words, distinct words in per cent of words, capitals in per cent of code points.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: Copies of a text that always stay together.
LEAST_ROWS = 256


def sorted_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null as empty) and the columns `keep` of docs, with what the range sort says of each row's run of equal
    texts: _least (the smallest doc_id in its range; null ids are larger than all others), _first (whether it begins the
    run), _hot (whether the text's run goes over several ranges) and, for these, _sha (of the text)."""
    parts = partitions(docs)
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text")).withColumn("_print", F.xxhash64("text"))
    counts = cut(rows.groupBy("_print").agg(F.count("*").alias("_c")).where(F.col("_c") > LEAST_ROWS))
    often = max(LEAST_ROWS, docs.count() // (4 * parts))
    hot = counts.where(F.col("_c") > often).select("_print", F.ceil(F.col("_c") / often).alias("_salts"))
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("_salts"))).otherwise(F.lit(0).cast("long"))
    place = ["_print", "_salt"]
    run = Window.partitionBy(*place, "text").orderBy(F.col("doc_id").asc_nulls_last())
    found = (
        rows.join(F.broadcast(hot), "_print", "left").withColumn("_hot", F.col("_salts").isNotNull()).withColumn("_salt", salt).drop("_salts")
        .repartitionByRange(parts, *place).sortWithinPartitions(*place, "text", F.col("doc_id").asc_nulls_last())
        .withColumn("_least", F.first("doc_id").over(run)).withColumn("_first", F.row_number().over(run) == 1)
    )
    return found.withColumn("_sha", F.when(F.col("_hot"), F.sha2("text", 256)))


def bit(condition: Column, k: int) -> Column:
    return F.when(condition, 1 << k).otherwise(0)


def failures(text: Column) -> Column:
    """The mask of filters A to D, as bits 0 to 3."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    conditions = (n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(SYMBOLS))
    return sum((bit(c, k) for k, c in enumerate(conditions)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask, a row for each row of docs. Null texts are empty, null parts the empty string; rows may be
    equal; other columns, whatever their names, are ignored; an empty table gives an empty one."""
    part = F.coalesce("lang", F.lit("")).alias("part")
    found = sorted_runs(docs.select("doc_id", "text", "lang"), "lang")
    rows = cut(found.select("doc_id", part, failures(F.col("text")).alias("_mask"), "_least", "_first", "_hot", "_sha"))
    ends = rows.where("_hot AND _first").groupBy(F.col("_sha").alias("_text")).agg(F.min("_least").alias("_all_least"))
    joined = rows.join(F.broadcast(ends), F.col("_sha") == F.col("_text"), "left")
    least = F.when(F.col("_hot"), F.col("_all_least")).otherwise(F.col("_least"))
    # coalesce: with ids in the run, a null id is larger than the smallest of them
    copy = F.coalesce(F.col("doc_id") > least, F.col("doc_id").isNull() & least.isNotNull())
    return joined.select("doc_id", "part", (F.col("_mask") + bit(copy, 4)).alias("mask"))


def tallies(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: the documents of each part and mask, and those among them that a label calls good
    (quality 1) or toxic (toxic 1). A doc_id may have several labels; null ids and labels say nothing."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.where("good = 1 OR toxic = 1")
    rows = masks.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(tallies: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from tallies by part and mask."""
    many = 1 << len(filters)
    at = lambda name, k: F.sum(F.when(F.col("mask") == k, F.col(name)).otherwise(0))
    parts = tallies.groupBy("part").agg(*(F.array(*(at(c, k) for k in range(many))).alias(c) for c in ("n", "good", "toxic")))
    orders = F.array(*(F.lit("".join(o)) for o in permutations(filters)))
    bits = {f: 1 << k for k, f in enumerate(filters)}
    rows = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    own = F.create_map(*(F.lit(x) for pair in bits.items() for x in pair))
    rows = rows.withColumn("_own", F.element_at(own, F.substr("filter_order", "step", F.lit(1))))
    before = F.aggregate(F.transform(F.split(F.expr("left(filter_order, step - 1)"), ""), lambda f: F.coalesce(F.try_element_at(own, f), F.lit(0))), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("_before", before)

    def total(name: str, keep) -> Column:
        """The sum of the counts of those masks that keep(mask) says."""
        each = F.zip_with(F.col(name), F.sequence(F.lit(0), F.lit(many - 1)), lambda v, m: F.when(keep(m), v).otherwise(0))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    fails, early = (lambda m: m.bitwiseAND(F.col("_own")) != 0), (lambda m: m.bitwiseAND(F.col("_before")) != 0)
    removed = lambda m: fails(m) & ~early(m)
    # In 1/s of all orders a given one of a document's s failing filters comes first.
    share = F.array(*(F.lit(factorial(len(filters)) // max(1, m.bit_count())).cast("long") for m in range(many)))
    shapley = F.aggregate(F.zip_with(F.zip_with("n", share, lambda v, s: v * s), F.sequence(F.lit(0), F.lit(many - 1)), lambda v, m: F.when(fails(m), v).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~fails(m) & ~early(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & early(m)).alias("redundant"),
        total("n", lambda m: m == F.col("_own")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step's filter does there: kept, removed, redundant (failing, but removed
    earlier), unique_fails (failing no other), good_lost, toxic_lost and shapley (removed, summed over all orders).

    Takes doc_id, text and lang of docs; null texts are empty texts, null langs the part '', null ids larger than all
    others; equal rows are no copies of each other, as neither has the smaller id. Empty tables give an empty result.
    """
    return audit(tallies(masks(docs), labels))
