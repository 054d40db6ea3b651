"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each of
several codebooks, found by beam search; its code is stored with the norm of
the sum. Queries in blocks meet parts of the index, both of bounded size, as
groups of one join; a query scores the part's codes by table look-up, and the
best of each part are ranked again by their exact cosine. Codebooks are trained
on a bounded sample; every valid row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import cut, hash_sample

#: Production parameters: codebooks, codewords of each, beam, sampled rows, queries of a block and rows of a part (about),
#: and for each query and part the candidates that are ranked again.
BOOKS, WORDS, BEAM, TRAIN_ROWS, BLOCK, PART, RERANK = 8, 256, 4, 20_000, 4096, 16_384, 1024
#: Queries scored together, to bound a task's memory.
TOGETHER = 64


def valid(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector can take part: not null, no null or non-finite component, not zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _rows(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1)), kind)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: cosines stay the same to the last bit, and no
    product of very small or large components leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def train_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """(books, words, dimensions): k-means of what the books before have left over."""
    rng, rest, out = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = (np.square(c).sum(1)[None] - 2 * rest @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, near, rest)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        rest -= c[(np.square(c).sum(1)[None] - 2 * rest @ c.T).argmin(1)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes and norms of the sums, by beam search over the books."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d).astype(np.float32)
    inner, dots, n = flat @ flat.T, x.astype(np.float32) @ flat.T, len(x)
    codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
    for b in range(m):
        own = slice(b * k, (b + 1) * k)
        new = cost[:, :, None] + (np.diag(inner)[own] - 2 * dots[:, own])[:, None]
        twice = 2 * inner[: b * k, own]
        for j in range(b):
            new += twice[j * k + codes[:, :, j]]
        new = new.reshape(n, -1)
        keep = min(beam, new.shape[1])
        best = np.argpartition(new, keep - 1, 1)[:, :keep]
        cost = np.take_along_axis(new, best, 1)
        codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
    best = codes[np.arange(n), cost.argmin(1)]
    sums = flat[best + np.arange(m) * k].sum(1)
    return best.astype(np.uint8), np.maximum(np.linalg.norm(sums.astype(np.float64), axis=1), 1e-9)


def build_index(table: DataFrame, vector: str = "embedding", train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, np.ndarray | None]:
    """Every valid row with its code, its norm and a number of its own (`row`), and the codebooks. Rows with a null id, a
    null, zero or non-finite vector, or a vector of another length than most of the sample, take no part; ids may repeat;
    other columns, whatever their names, are ignored. Without a valid row there are no codebooks."""
    rows = valid(table.select("vec_id", F.col(vector).cast("array<double>").alias("v")), "v")
    sample = hash_sample(rows, "vec_id", train_rows).select("v").toArrow()["v"].combine_chunks()
    if not len(sample):
        return cut(rows.select("vec_id", "v", F.lit(b"").alias("code"), F.lit(0.0).alias("norm"), F.lit(0).cast("long").alias("row"))), None
    sizes = np.bincount(sample.value_lengths().to_numpy())
    d = int(sizes.argmax())
    books = train_books(_unit(_rows(sample.filter(pa.compute.equal(sample.value_lengths(), d)))))
    shared = table.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                codes, norms = encode(_unit(_rows(part["v"])), shared.value)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], ["vec_id", "v", "code", "norm"])

    coded = rows.where(F.size("v") == d).mapInArrow(run, "vec_id long, v array<double>, code binary, norm double")
    return cut(coded.withColumn("row", F.monotonically_increasing_id())), books


FOUND = "query long, query_id long, vec_id long, score double"


def _best(part: pa.Table, block: pa.Table, books: np.ndarray, k: int, rerank: int) -> pa.Table:
    """The part's k rows nearest to each query of the block: guessed by look-up, then ranked by exact cosine."""
    ids, own, v = part["vec_id"].to_numpy(), part["row"].to_numpy(), _rows(part["v"].combine_chunks())
    m, words, d = books.shape
    codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(len(ids), m)
    norms, keep = part["norm"].to_numpy().astype(np.float32), min(rerank, len(ids))
    v = _scaled(v)
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    out: tuple[list, ...] = ([], [], [], [])
    for at in range(0, len(block), TOGETHER):
        some = block.slice(at, TOGETHER)
        q_row, q_id, q = some["q_row"].to_numpy(), some["q_id"].to_numpy(), _scaled(_rows(some["q"].combine_chunks()))
        tables = (_unit(q) @ books.reshape(m * words, d).T).reshape(len(q), m, words).astype(np.float32)
        guess = np.zeros((len(q), len(ids)), np.float32)
        for j in range(m):
            guess += np.take(np.ascontiguousarray(tables[:, j]), codes[:, j], 1)
        guess /= norms
        guess[q_row[:, None] == own] = -np.inf
        best = np.argpartition(-guess, keep - 1, 1)[:, :keep]
        for i, near in enumerate(best):
            near = near[own[near] != q_row[i]]
            exact = np.einsum("ij,j->i", v[near], q[i]) / (length[near] * np.sqrt(np.einsum("i,i->", q[i], q[i])))
            top = np.lexsort((ids[near], -exact))[:k]
            for x, values in zip(out, (np.full(len(top), q_row[i]), np.full(len(top), q_id[i]), ids[near][top], exact[top])):
                x.append(values)
    return pa.table({name: np.concatenate(x) for name, x in zip(("query", "query_id", "vec_id", "score"), out)})


def search(index: DataFrame, books: np.ndarray | None, queries: DataFrame, k: int, rerank: int = RERANK, block: int = BLOCK, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id and score: for each of the queries (rows of the index), its k nearest other rows by cosine.

    Ties go to the smaller vec_id. A query's own row alone is left out, so rows that share its vec_id are candidates like
    any other; each query row has a list of its own, repeated ones too. Without valid rows or queries the result is empty.
    """
    spark = index.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(books)
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (index, part)))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = index.select(deal(parts).alias("part"), every(blocks).alias("block"), "row", "vec_id", "v", "code", "norm")
    asked = queries.select(every(parts).alias("part"), deal(blocks).alias("block"), *(F.col(c).alias(a) for c, a in (("row", "q_row"), ("vec_id", "q_id"), ("v", "q"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _best(left, right, shared.value, k, rerank)

    found = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.select("query", "query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k).drop("query")
