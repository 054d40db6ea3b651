"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import curriculum, exact_dedup, jaccard_join, pattern_packing, toxicity
from volumetra.llm.common import cut
from volumetra.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts, null and repeated ids are judged like any other
    row; without labels to learn from, every row gets the same verdict. An empty table stays empty."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest doc_id; null texts count as empty, null
    ids come last, and of rows with one id one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id, nulls last, ties by a hash of the text. Ids may
    repeat or be null, as rows are told apart by a key of their own; rows without words are no copies of each other here."""
    rows = cut(docs.withColumns({"_row": F.monotonically_increasing_id(), "_hash": F.xxhash64("text")}))
    found = jaccard_join.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"))
    later = cut(found.where("doc_id != component_id").select(F.col("doc_id").alias("_row"), "component_id"))
    members = later.union(later.select("component_id", "component_id").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row")
    members = cut(members.join(rows.select("_row", "doc_id", "_hash"), "_row").select("_row", "component_id", order.alias("place")))
    kept = members.groupBy("component_id").agg(F.min("place")["_row"].alias("_kept"))
    gone = cut(members.join(kept, "component_id").where("_row != _kept").select("_row"))
    return rows.join(F.broadcast(gone) if gone.count() <= jaccard_join.BROADCAST_ROWS else gone, "_row", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix reads them, each whole. Rows without words (null, empty, blank) are
    never read; a null source is a source of its own; null and repeated ids are rows like others."""
    return curriculum.training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, and by place and sequence_place where in the training order the row and its
    sequence stand. Null and empty texts give one piece, null and repeated ids pieces of their own."""
    return pattern_packing.packed_documents(curriculum.with_place(docs.select("doc_id", "text")), tokenizer_path("word_bpe_49k.json"), place="place")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("pattern_packing", pack_sequences),
]

#: The toxicity model, hashed shingles and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = cut(docs)
    return docs
