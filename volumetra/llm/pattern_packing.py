"""Packing pieces into sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the
driver. There, patterns of few lengths that fill a sequence are enumerated on a
coarse grid, and their repeat counts are fitted to the histogram by
non-negative least squares and rounded down. Each pattern is then realised
with actual lengths, the last one filling the sequence as far as it can, and
what is left over is packed largest first, each gap by the largest length that
fits. The plan says for each length which runs of its pieces go where; its size
follows the number of lengths, never the number of pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from volumetra.llm.common import cut
from volumetra.llm.tokens import encoder, parts

#: Production parameters: tokens of a sequence, and the id behind each document.
CAPACITY, END_ID = 4096, 1
#: Steps of the coarse grid, lengths of a pattern, and pieces of a length that are numbered together.
GRID, DEPTH, BUCKET_ROWS = 64, 3, 20_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, kind: str = "<u4", carry: tuple[str, ...] = (), numbered: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids (of that kind: little-endian unsigned 32-bit), a row for each piece of each document.

    A document is its ids followed by end_id; longer ones than the capacity are cut, none is dropped. Null and empty
    texts give one piece with end_id alone. A null doc_id stays null, equal rows give pieces of their own, an empty
    table gives an empty one. Takes doc_id and text; columns that carry names come along, others are ignored.
    numbered adds `nth`: how many pieces of its length the task has made before.
    """
    more = ["nth"] if numbered else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer, False).encode, Counter()
        for batch in batches:
            none, at, held, made = np.zeros(0, kind), 0, np.zeros(0, kind), 0  # the row at hand, its ids not put out yet, and its pieces so far
            row, piece, data = [], [], []

            def put(part: np.ndarray) -> None:
                nonlocal made
                for x, v in zip((row, piece, data), (at, made, part)):
                    x.append(v)
                made += 1

            def close() -> None:
                nonlocal held, made
                whole = np.append(held, np.array([] if end_id is None else [end_id], kind))
                for s in range(0, len(whole), capacity):
                    put(whole[s : s + capacity])
                held, made = none, 0

            def batch_of() -> pa.RecordBatch:
                own = pa.array(row, pa.int64())
                out = [batch["doc_id"].take(own), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * capacity)]
                out += [pa.array([len(p) for p in data], pa.int64()), pa.array([p.tobytes() for p in data], pa.binary()), *(batch[c].take(own) for c in carry)]
                if numbered:
                    nth = []
                    for p in data:
                        nth.append(seen[len(p)])
                        seen[len(p)] += 1
                    out.append(pa.array(nth, pa.int64()))
                for x in (row, piece, data):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids", *carry, *more])

            for rows, texts in parts(batch["text"], False):
                ids, ends = encode(texts)
                for k, a, b in zip(rows, [0, *ends.tolist()], ends.tolist()):
                    if k != at:
                        close()
                        at = k
                    held = np.concatenate([held, ids[a:b].astype(kind)])
                    while len(held) > capacity:  # the end belongs to the last piece
                        put(held[:capacity])
                        held = held[capacity:]
                yield batch_of()
            if batch.num_rows:
                close()
                yield batch_of()

    schema = StructType.fromDDL("doc_id long, piece int, start long, length long, ids binary")
    return docs.select("doc_id", "text", *carry).mapInArrow(run, StructType([*schema, *(docs.schema[c] for c in carry), *(StructField(c, LongType()) for c in more)]))


def patterns(grid: int = GRID, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Largest first, all that add up to the grid."""

    def below(total: int, most: int, parts: int):
        if total and total <= most:
            yield (total,)
        if parts > 1:
            for x in range(min(most, total - 1), 0, -1):
                for rest in below(total - x, min(x, total - x), parts - 1):
                    yield (x, *rest)

    return list(below(grid, grid, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that brings a @ x near b in least squares: projected gradient steps with momentum."""
    gram, goal = a.T @ a, a.T @ b
    step = 1 / np.linalg.norm(gram, 2)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * (gram @ y - goal))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = z, z + (was - 1) / t * (z - x)
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, times in each)]): every piece of the histogram in exactly one place."""
    left = np.zeros(capacity + 2, np.int64)
    for n, c in histogram.items():
        left[n] += c
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def largest(most: int) -> int:
        found = np.flatnonzero(left[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def place(lengths: list[int], most: int | None = None) -> None:
        each, times = np.unique(lengths, return_counts=True)
        n = int((left[each] // times).min())
        n = n if most is None else min(n, most)
        left[each] -= n * times
        out.append((n, [(int(a), int(k)) for a, k in zip(each[::-1], times[::-1])]))

    grid = min(grid, capacity)
    width = capacity / grid
    bin_of = np.ceil(np.arange(capacity + 2) / width).astype(int)
    shapes = [p for p in patterns(grid) if len(p) > 1]
    if shapes and left.sum() > grid:
        binned = np.bincount(bin_of[: capacity + 1], weights=left[: capacity + 1], minlength=grid + 1)[1 : grid + 1]
        a = np.zeros((grid, len(shapes)))
        for k, p in enumerate(shapes):
            for x in p:
                a[x - 1, k] += 1
        counts = np.floor(nnls(a, binned)).astype(int)
        for k in np.argsort(-counts, kind="stable").tolist():
            todo = int(counts[k])
            while todo > 0:
                used: list[int] = []
                for x in shapes[k][:-1]:
                    own = [n for n in range(int(x * width), int((x - 1) * width), -1) if left[n] > used.count(n)]
                    if not own:
                        break
                    used.append(own[0])
                rest = capacity - sum(used)
                last = next((n for n in range(rest, 0, -1) if left[n] > used.count(n)), 0)
                if len(used) < len(shapes[k]) - 1 or not last or sum(used) + last < capacity - width / 8:
                    break  # the residuals' turn
                before = len(out)
                place([*used, last], todo)
                todo -= out[before][0]
    while top := largest(capacity):
        used, room = [top], capacity - top
        taken = {top: 1}
        while room and (n := next((int(x) for x in np.flatnonzero(left[: room + 1])[::-1] if left[x] > taken.get(int(x), 0)), 0)):
            k = int(min(left[n] - taken.get(n, 0), room // n))
            taken[n] = taken.get(n, 0) + k
            used += [n] * k
            room -= n * k
        place(used)
    return [x for x in out if x[0]]


def pack(pieces: DataFrame, capacity: int = CAPACITY, place: str | None = None) -> DataFrame:
    """pieces (with doc_id, piece and length in 1..capacity) and where each goes: sequence_id, offset.

    Any other columns come along; place names one, in 0..1, that pieces of one length are taken in order of. Equal rows
    are pieces of their own. An empty table gives an empty table.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, at, sequences = [], {}, 0
    for n, slots in plan(histogram, capacity):
        offset = 0
        for length, times in slots:
            first = at.get(length, 0)
            runs.append((length, first, sequences, times, offset))
            at[length] = first + n * times
            offset += length * times
        sequences += n
    return placed(pieces, runs, sum(histogram.values()), place=place)


def placed(pieces: DataFrame, runs: list[tuple[int, int, int, int, int]], total: int, *ties: str, place: str | None = None) -> DataFrame:
    """pieces with the sequence_id and offset that runs give them: (length, rank of its first piece, first sequence, pieces
    in each sequence, offset of the first). Pieces of one length are ranked by doc_id, piece and ties, inside hashed
    buckets, or else by place, inside ranges of it; total is the number of pieces."""
    table = np.array(sorted(runs) or np.zeros((0, 5)), np.int64)
    schema = pieces.schema.jsonValue()

    buckets = max(1, -(-total // BUCKET_ROWS))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)) if place is None else F.floor(F.col(place) * buckets)
    salted = pieces.withColumn("_salt", salt)
    base = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base")
    )
    order = Window.partitionBy("length", "_salt").orderBy(*([place] if place else []), "doc_id", "piece", *ties)
    ranked = salted.withColumn("_n", F.row_number().over(order) - 1).join(base, ["length", "_salt"]).select(*pieces.columns, (F.col("_n") + F.col("_base")).alias("_rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            done = rank - row[:, 1]
            columns = {c: batch[c] for c in batch.schema.names if c != "_rank"}
            columns |= {"sequence_id": pa.array(row[:, 2] + done // row[:, 3]), "offset": pa.array(row[:, 4] + done % row[:, 3] * length)}
            yield pa.RecordBatch.from_pydict(columns)

    out = type(pieces.schema).fromJson(schema).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(put, out)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, place: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece. See
    token_pieces() for nulls, repeats and empty tables.

    place: a column of docs, in 0..1, that says where in the training run a row is read. It comes along, tells rows of one
    document apart, and gives sequence_place, the mean of a sequence's pieces: sequences are to be read in its order."""
    carry = () if place is None else (place,)
    pieces = token_pieces(docs, tokenizer, capacity, end_id, carry=carry).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = pack(cut(pieces), capacity, place)
    if place is None:
        return packed
    packed = cut(packed)
    return packed.join(packed.groupBy("sequence_id").agg(F.avg(place).alias("sequence_place")), "sequence_id")
