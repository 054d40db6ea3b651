"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it, and the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may name none: it gets one below /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "/tmp/checkpoints"


#: Spark removes a query's shuffle files as soon as it ends: what cut() has written stands in for them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends, lost executors
    cost nothing. The files go with drop(), or when the driver's JVM ends. There is no _SUCCESS mark, which nobody reads: on
    a local disk Hadoop starts a chmod for each file it makes, and until that child runs it shares the driver's memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        spark.conf.set(_CLEAN, was) if was is not None else spark.conf.unset(_CLEAN)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df (at most), those whose hashed key is smallest; only hashes are sorted, never the rows."""
    small = df.select(F.xxhash64(key).alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(F.xxhash64(key) <= F.lit(small if small is not None else 0)).limit(rows)


def join_split(rows: DataFrame, table: DataFrame, keys: list[str], many: str, how: str = "inner") -> DataFrame:
    """rows joined with table, whose keys are distinct. Keys that `many`, a condition on table, names (there have to be
    few of them by its terms) are broadcast, so that no task gets all rows of such a key; rows are read twice."""
    hot = table.where(many)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(f"NOT ({many})"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and where each text starts and the last ends; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def byte_slices(bounds: np.ndarray, most: int):
    """Runs of texts of about that many bytes, at least one text each."""
    k, n = 0, len(bounds) - 1
    while k < n:
        e = max(k + 1, int(np.searchsorted(bounds, bounds[k] + most, "right")) - 1)
        yield k, min(e, n)
        k = min(e, n)


# --- rolling hashes: sums of symbol * BASE**i modulo 2**64 ---------------------------------
# Long sequences of few symbols can be made to collide, so these only choose anchors and
# candidates; no result rests on them.

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols + np.uint64(1)) * powers(BASE, len(symbols)), out=out[1:])
    return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(mix(a.copy()) + (b ^ np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9FB21C651E98DF25))


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], the same wherever the span lies."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


def fixed_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k symbols."""
    n = len(sums) - k
    return mix((sums[k:] - sums[:n]) * powers(_INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and for each text the number of words before it (and all at the end)."""
    solid = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Hash of each word: a sum of well-mixed (byte, place in the word), mixed with the length. No power series, whose sums
    collide for some long words whatever the base."""
    out = np.zeros(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        e = max(k + 1, int(np.searchsorted(ends, starts[k] + most, "right")))
        if ends[k] - starts[k] > most:  # one very long word
            for a in range(int(starts[k]), int(ends[k]), most):
                part = data[a : min(a + most, int(ends[k]))].astype(np.uint64)
                out[k] += mix((np.arange(a - starts[k], a - starts[k] + len(part), dtype=np.uint64) << np.uint64(8) | part) + np.uint64(1)).sum(dtype=np.uint64)
        else:
            a, b = int(starts[k]), int(ends[e - 1])
            own = starts[k:e] - a
            place = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
            code = place.astype(np.uint64) << np.uint64(8) | data[a:b]
            each = mix(code + np.uint64(1))
            each[_SPACES[data[a:b]]] = 0
            out[k:e] = np.add.reduceat(each, own)
        k = e
    return pair_hash(out, (ends - starts).astype(np.uint64))
