"""Exact de-duplication by content sort, in DataFrame operations only.

Sampled splitters range-partition normalised texts by their first bytes (and, behind
those, by a hash of all of them, so that splitters are short whatever the texts'
length), Spark's external sort puts equals side by side, and a window over the sorted
rows compares neighbours in full and names the row that stays. The ranges a text's
copies lie in settle it alone, but for texts with more copies than a quarter of a
mean partition's rows: these are counted beforehand, their copies are dealt out over
ranges by doc_id, and what each range found is merged. There are fewer than four such
texts for each partition, so the merge takes a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import ascii_lower, cut, partitions

#: Characters of a text that a splitter holds, and copies of a text that always stay together.
HEAD, LEAST_ROWS = 32, 256
#: What a range is sorted by; equal texts agree in all of it but the salt, which is 0 unless the text is frequent.
PLACE = ("_head", "_hash", "_salt")


def _sorted(docs: DataFrame) -> DataFrame:
    """docs with _rank and _n among the copies in their range, _keep (the largest doc_id of these), _hot and _sha."""
    parts = partitions(docs)
    normal = docs.withColumn("_norm", ascii_lower(F.col("text"))).withColumn("_hash", F.xxhash64("_norm"))
    counts = normal.groupBy("_hash").agg(F.count("*").alias("_c"))
    counts = cut(counts.where(F.col("_c") > LEAST_ROWS))
    often = max(LEAST_ROWS, docs.count() // (4 * parts))
    hot = counts.where(F.col("_c") > often).select("_hash", F.ceil(F.col("_c") / often).alias("_salts"))
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("_salts"))).otherwise(F.lit(0).cast("long"))
    equal = Window.partitionBy(*PLACE, "_norm").orderBy(F.col("doc_id").desc_nulls_last())
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        normal.join(F.broadcast(hot), "_hash", "left").withColumn("_hot", F.col("_salts").isNotNull()).withColumn("_salt", salt).drop("_salts")
        .withColumn("_head", F.substring("_norm", 1, HEAD))
        .repartitionByRange(parts, *PLACE).sortWithinPartitions(*PLACE, "_norm", F.col("doc_id").desc_nulls_last())
        .withColumn("_rank", F.row_number().over(equal)).withColumn("_n", F.count("*").over(whole)).withColumn("_keep", F.first("doc_id").over(whole))
        .withColumn("_sha", F.sha2("_norm", 256)).drop("_norm", "_head", "_hash")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, a row for each row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id
    stays, nulls last; of rows equal in doc_id too, one stays. Other columns, whatever their names, are ignored; an empty
    table gives an empty one.
    """
    rows = cut(_sorted(docs.select("doc_id", "text")).select("doc_id", "_sha", "_rank", "_n", "_keep", "_hot"))
    groups = rows.where("_hot AND _rank = 1").groupBy("_sha").agg(F.max("_keep").alias("_all_keep"), F.sum("_n").alias("_all_n"))
    merged = rows.where("_hot").join(F.broadcast(groups), "_sha").withColumn("_keep", F.col("_all_keep")).withColumn("_n", F.col("_all_n")).select(rows.columns)
    return rows.where("NOT _hot").unionByName(merged).select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), ((F.col("_rank") == 1) & F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the copies that exact_duplicates() would drop, all columns kept, whatever their names. Of rows equal in
    doc_id and text one stays; null ids and texts, and empty tables, count as there."""
    held = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    first = cut(_sorted(held).where("_rank = 1").select("_row", "_sha", "doc_id", "_hot"))
    best = first.where("_hot").groupBy("_sha").agg(F.max("doc_id").alias("_keep")).withColumnRenamed("_sha", "_text")
    kept = first.join(F.broadcast(best), (F.col("_sha") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
    return first.where("NOT _hot").unionByName(kept).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
