"""Toxicity classifier: a logistic model over character n-grams that are scaled by naive Bayes log-count ratios.

The model is trained on a bounded sample of labelled rows; every text is scored as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import cut

#: Production parameters: n-gram lengths, hashed n-grams told apart (as bits), labelled rows to learn from at most,
#: n-grams that the model keeps (the others tell too little, or stand in fewer than LEAST of the texts learnt from; no row
#: is left out for them), and the score from which a text is rejected.
ORDERS, BITS, TRAIN_ROWS, FEATURES, LEAST, THRESHOLD = (4, 5), 20, 8000, 2048, 3, 0.5
#: Bytes of text worked on together; longer texts are taken in parts of as many characters.
SLICE_BYTES = 1 << 18


@dataclass(frozen=True)
class Model:
    slot: np.ndarray  # of a hashed n-gram among the weights, or -1
    weights: np.ndarray
    bias: float


def _grams(padded: list[str], slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, A-Z lower-cased: text number, and hashed n-gram or its slot (only those with one)."""
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    chars = np.where((chars >= 65) & (chars <= 90), chars + 32, chars).astype(np.uint32)
    ends = np.cumsum([len(t) for t in padded])
    docs, grams = [], []
    for order in ORDERS:
        h = np.zeros(max(0, len(chars) - order + 1), np.uint32)
        for k in range(order):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + chars[k : k + len(h)] * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        g = (h >> np.uint32(32 - BITS)).astype(np.int64)
        if slot is not None:
            g = slot[g]
        at = np.flatnonzero(g >= 0)
        doc = np.searchsorted(ends, at, "right")
        inside = at + order <= ends[doc]
        docs.append(doc[inside])
        grams.append(g[at[inside]].astype(np.int64))
    return np.concatenate(docs), np.concatenate(grams)


def _hits(texts: pa.Array, slot: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts k..e of about SLICE_BYTES, and their distinct n-grams (see _grams). A space stands around each text."""
    size = np.cumsum([0, *pc.fill_null(pc.binary_length(texts), 0).to_pylist()])
    k, n = 0, len(texts)
    while k < n:
        e = min(n, max(k + 1, int(np.searchsorted(size, size[k] + SLICE_BYTES, "right")) - 1))
        padded = [f" {t or ''} " for t in texts.slice(k, e - k).to_pylist()]
        if len(padded[0]) > SLICE_BYTES:  # one long text: parts that overlap by all but one character of an n-gram
            grams = np.zeros(0, np.int64)
            for at in range(0, len(padded[0]), SLICE_BYTES):
                grams = np.union1d(grams, _grams([padded[0][at : at + SLICE_BYTES + max(ORDERS) - 1]], slot)[1])
            yield k, e, np.zeros(len(grams), np.int64), grams
        else:
            doc, grams = _grams(padded, slot)
            both = np.unique(doc << BITS | grams)
            yield k, e, both >> BITS, both & ((1 << BITS) - 1)
        k = e


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Learn from at most `rows` labelled doc_ids that are not held out, one text of each (repeated labels: toxic if any
    says so). Null ids, labels and texts teach nothing or count as empty. Without rows of both classes, or with empty
    tables, every text gets the score of the class that there is. Other columns are ignored."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # One row for each label, so that repeated ids do not lift the bound: the one whose text hashes lowest.
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64("text"))
    sample = cut(own.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.struct("h", "text")).alias("text")).select("toxic", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            toxic = batch["toxic"].to_numpy()
            for k, _, doc, gram in _hits(batch["text"]):
                for label in (0, 1):
                    seen[label] += np.bincount(gram[toxic[k + doc] == label], minlength=1 << BITS)
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1][some]), pa.array(seen[0][some])], ["gram", "p", "q"])

    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), 4.0 if pos else -4.0)
    p, q = F.sum("p"), F.sum("q")
    rate_p, rate_q, rate = p / pos, q / neg, (p + q) / (pos + neg)
    table = sample.mapInArrow(count, "gram long, p long, q long").groupBy("gram").agg(
        F.log(((p + 1) / (pos + 2)) / ((q + 1) / (neg + 2))).alias("r"), F.abs((rate_p - rate_q) / F.sqrt(rate * (1 - rate) + 1e-9)).alias("z"), (p + q).alias("n")
    ).where(F.col("n") >= LEAST)
    top = table.orderBy(F.desc("z"), "gram").limit(features).select("gram", "r").collect()
    slot = np.full(1 << BITS, -1, np.int32)
    slot[[t.gram for t in top]] = np.arange(len(top))
    ratio = np.array([t.r for t in top], np.float64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, e, doc, own in _hits(batch["text"], slot):
                cuts = np.searchsorted(doc, np.arange(e - k + 1))
                each = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["toxic"].slice(k, e - k), each], ["toxic", "own"])

    got = sample.mapInArrow(found, "toxic int, own array<long>").toArrow()
    y = got["toxic"].to_numpy().astype(np.float64)
    own = got["own"].combine_chunks()
    row = np.repeat(np.arange(len(y)), own.value_lengths().to_numpy())
    col = own.flatten().to_numpy()
    x = np.zeros((len(y), len(top) + 1), np.float32)
    x[row, col] = ratio[col]
    x[:, -1] = 1
    w = _logistic(x, y)
    return Model(slot, w[:-1] * ratio, float(w[-1]))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 300) -> np.ndarray:
    """L2-penalised logistic regression by accelerated gradient steps; the last column is the intercept.
    Products with x are taken in its own type, so that x is never converted."""
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 0
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(x.T @ (x @ v)) * 1.1 + penalty)
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-np.clip(x @ z.astype(x.dtype), -30, 30))) - y
        gradient = x.T @ wrong.astype(x.dtype) + ridge * z
        new = z - step * gradient
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        w, z = new, new + (was - 1) / t * (new - w)
    return w


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for k, e, doc, own in _hits(texts, model.slot):
        total = model.bias + np.bincount(doc, weights=model.weights[own] if len(own) else None, minlength=e - k)
        out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
    return np.concatenate(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs. Null and empty texts get the score of a text
    without any known n-gram. A null doc_id stays null and is not held out; equal rows get a row each, an empty table
    gives an empty one. Takes doc_id and text; other columns, whatever their names, are never seen."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(_scores(shared.value, batch["text"]))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that the model rejects, all columns kept. Null and empty texts, null ids and repeated rows are
    judged like any other row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(_scores(shared.value, texts) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
