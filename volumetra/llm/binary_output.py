"""Token-id output: documents packed into id matrices by best fit decreasing.

All pieces of the corpus are packed at once, however the rows are ordered or
batched. Only the histogram of piece lengths (at most `capacity` numbers)
reaches the driver, which fits it by best fit decreasing; pieces of a length
are numbered where they are written, task by task, and their numbers say where
they go. Ids are shuffled once, by sequence.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import cut
from volumetra.llm.pattern_packing import token_pieces

#: Production parameters.
CAPACITY, END_ID, PAD_ID = 4096, 1, 0
#: Sequences of one output batch.
OUT_ROWS = 512
#: Pairs of a length and a task up to which their running totals are broadcast (some 40 MB); beyond, they are joined by shuffle.
BROADCAST_ROWS = 250_000
SCHEMA = "input_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, pieces array<int>"


class RoomTree:
    """Segment tree over the rooms 0..capacity: how many runs of open sequences have each, and the least room of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, n: int) -> int:
        """-1 if there is none."""
        k, count = n + self.size, self.count
        if count[k]:
            return n
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.size:
                    k *= 2
                    if not count[k]:
                        k += 1
                return k - self.size
            k >>= 1
        return -1


def best_fit_runs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit decreasing over lengths 1..capacity and how many pieces have each: runs as placed() takes them, and the
    number of sequences. Sequences that are filled alike stay together, so the work follows the number of lengths."""
    tree, open_, runs, sequences = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            open_.setdefault(room, []).append((first, many))
            tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.least(length)
            if room < 0:
                room, first, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            else:
                first, many = open_[room].pop()
                tree.add(room, -1)
            # One piece after another goes into the same sequence as long as it fits: its room is then the least.
            times = room // length
            full = min(many, left // times)
            rest = left - full * times if full < many else 0
            for at, n, k in ((first, full, times), (first + full, min(rest, 1), rest)):
                if n:
                    runs.append((length, rank, at, k, capacity - room))
                    rank += n * k
                    left -= n * k
                    put(room - k * length, at, n)
            used = full + min(rest, 1)
            put(room, first + used, many - used)
    return runs, sequences


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the lengths in each sequence. Lengths are 1..capacity; ties go by index."""
    each, counts = np.unique(lengths, return_counts=True)
    runs, sequences = best_fit_runs(dict(zip(each.tolist(), counts.tolist())), capacity)
    runs, out, rank = sorted(runs), [[] for _ in range(sequences)], Counter()
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        _, before, first, times, _ = runs[bisect(runs, (n, rank[n], sequences)) - 1]
        out[first + (rank[n] - before) // times].append(k)
        rank[n] += 1
    return out


def id_type(tokenizer: str) -> str:
    """Little-endian unsigned ids: 16 bits if all of the tokenizer's fit, else 32."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def _seat(runs: list[tuple[int, int, int, int, int]], length: Column, rank: Column) -> Column:
    """sequence_id and offset of a piece, by its number among those of its length. Only both numbers go to Python."""
    table = np.array(sorted(runs) or np.zeros((0, 5)), np.int64)

    @F.arrow_udf("sequence_id long, offset long")
    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, k = (x.to_numpy(zero_copy_only=False) for x in (length, rank))
        _, before, first, times, at = table[np.searchsorted(table[:, 0] << 44 | table[:, 1], n << 44 | k, "right") - 1].T
        return pa.StructArray.from_arrays([pa.array(first + (k - before) // times), pa.array(at + (k - before) % times * n)], ["sequence_id", "offset"])

    return seat(length, rank)


def packed_matrices(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, pad_id: int = PAD_ID, kind: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each packed sequence: input_ids (`capacity` ids of `kind`, by default id_type()'s, padded behind), n_tokens,
    cu_seqlens (0 and where each segment ends), position_ids (of the same kind, starting again with each segment; 0 in
    the padding), doc_ids and pieces of the segments.

    A document is its ids followed by end_id; overlong ones are cut into several pieces without loss. Null and empty
    texts have end_id alone (without end_id: nothing). A null doc_id stays null, equal rows are packed each, an empty table
    gives an empty one. Other columns, whatever their names, are ignored. The order of rows in their files decides which
    of the pieces of one length goes where, and nothing else.
    """
    kind = kind or id_type(tokenizer)
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id, kind, numbered=True).drop("start").withColumn("part", F.spark_partition_id()))
    counts = cut(pieces.groupBy("length", "part").count())
    runs, _ = best_fit_runs({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(F.broadcast(base) if counts.count() <= broadcast_rows else base, ["length", "part"])
    dealt = ranked.withColumn("seat", _seat(runs, F.col("length"), F.col("base") + F.col("nth"))).select("doc_id", "piece", "ids", "seat.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            sequence = rows[0]["sequence_id"].to_numpy()
            last = int(np.searchsorted(sequence, sequence[-1]))  # may go on in the next batch
            yield from _matrices(rows[0].slice(0, last), capacity, pad_id, kind)
            held = rows[0].slice(last)
        if held is not None:
            yield from _matrices(held, capacity, pad_id, kind)

    return dealt.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(run, f"sequence_id long, {SCHEMA}")


def _matrices(rows: pa.RecordBatch, capacity: int, pad_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Whole sequences, their pieces in order."""
    sequence = rows["sequence_id"].to_numpy()
    firsts = np.flatnonzero(np.diff(sequence, prepend=-1)).tolist()
    for at in range(0, len(firsts), OUT_ROWS):
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for a, b in zip(firsts[at : at + OUT_ROWS], [*firsts[at + 1 : at + OUT_ROWS + 1], len(sequence)]):
            own = [np.frombuffer(x, kind) for x in rows["ids"].slice(a, b - a).to_pylist()]
            cu = np.cumsum([0, *map(len, own)])
            matrix, places = np.full(capacity, pad_id, kind), np.zeros(capacity, kind)
            matrix[: cu[-1]] = np.concatenate(own)
            places[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
            for x, v in zip(out, (int(sequence[a]), matrix.tobytes(), int(cu[-1]), cu, places.tobytes(), rows["doc_id"].slice(a, b - a).to_pylist(), rows["piece"].slice(a, b - a).to_pylist())):
                x.append(v)
        yield _batch(out)


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["sequence_id", "input_ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "pieces"])


def write_matrices(packed: DataFrame, path: str) -> None:
    """Packed sequences as Parquet: one file a task, committed by Spark, so that a retried task leaves no half file."""
    packed.write.parquet(path)
