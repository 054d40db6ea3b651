"""Byte-exact removal of repeated passages with sorted suffixes.

Suffixes that can repeat travel in blocks that share their anchor, the leading
gram by which Spark's sampled splitters range-partition them (see repeats.py).
A bucket's suffixes are dealt by leading gram and distance to it, and then
sorted by multikey quicksort, eight bytes a key: a segment's suffixes are parted
into those below, equal to and above a pivot's key, and the equal ones go on to
the next key. All segments of a bucket take a step together, in numpy. Suffixes
that agree in all `length` bytes end side by side; where a gram's suffixes lie on
both sides of a bucket's boundary, they are compared across it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from volumetra.llm.common import utf8
from volumetra.llm.repeats import CHUNK_SYMBOLS, Bytes, covered, repeated, runs

#: Production parameters: bytes of a repeated string, and of an anchor's gram.
LENGTH, GRAM = 200, 80


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, length: int, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sort data[s : s + length] of order[low:high] for each segment, in place. Returns where in order a suffix differs
    from the one before it; segments' starts count. data goes on for 8 bytes behind the last suffix."""
    differs = np.zeros(len(order) + 1, bool)
    differs[low] = True
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    depth = np.zeros(len(low), np.int64)
    while True:
        live = (high - low > 1) & (depth < length)
        low, high, depth = low[live], high[live], depth[live]
        if not len(low):
            return differs[:-1]
        size = high - low
        first = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(seg)) + (low - first)[seg]
        own = order[at]
        key = np.ascontiguousarray(words[starts[own] + depth[seg]]).view(">u8").ravel().astype(np.uint64)
        past = np.maximum(depth + 8 - length, 0).astype(np.uint64) * np.uint64(8)  # bits behind the suffix's end
        if past.any():
            key >>= past[seg]
        pivot = key[first + size // 2][seg]
        below, same = key < pivot, key == pivot
        if same.all():
            depth = depth + 8
            continue
        n_below, n_same = np.add.reduceat(below.astype(np.int64), first), np.add.reduceat(same.astype(np.int64), first)
        rank = lambda flags, n: np.cumsum(flags) - (np.cumsum(n) - n)[seg] - 1
        above = ~(below | same)
        place = np.where(below, rank(below, n_below), np.where(same, n_below[seg] + rank(same, n_same), (n_below + n_same)[seg] + rank(above, size - n_below - n_same)))
        order[low[seg] + place] = own
        mid, end = low + n_below, low + n_below + n_same
        differs[mid] = differs[end[end < high]] = True
        low, high, depth = np.concatenate([low, mid, end]), np.concatenate([mid, end, high]), np.concatenate([depth, depth + 8, depth])


def solve(gh: np.ndarray, contents: list[bytes], anchor: np.ndarray, n: np.ndarray, copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """See repeats.repeated(): equal windows share their place among the sorted ones."""
    data = np.frombuffer(b"".join(contents) + bytes(8), np.uint8)
    ends = np.cumsum(n + window - 1)
    block = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(block)) - (np.cumsum(n) - n)[block]
    starts = (ends - (n + window - 1))[block] + off
    gram = np.cumsum(np.concatenate([[0], gh[1:] != gh[:-1]]))[block]
    lead = gram * 4096 + (anchor[block] - off)
    order = np.argsort(lead, kind="stable")
    low = np.flatnonzero(np.diff(lead[order], prepend=-1))
    differs = multikey_quicksort(data, starts, window, order, low, np.append(low[1:], len(order)))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(differs) - 1
    return group, np.bincount(group, weights=copies[block])[group]


def dedup_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK_SYMBOLS) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts elsewhere in the corpus.

    Takes `doc_id` and `text` (other columns are ignored). Returns, a row for each row of docs:
    doc_id, n_bytes, n_removed, spans (start and end by turns of each maximal removed run) and kept (binary).
    Null and empty texts give 0 bytes; a null doc_id stays null; equal rows count as occurrences of each other; an empty
    table gives an empty one. Very long texts are searched in parts that overlap.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch["text"])
            out: tuple[list, ...] = ([], [], [], [])
            for k, ranges in enumerate(batch["ranges"].to_pylist()):
                own = data[bounds[k] : bounds[k + 1]]
                gone = covered(len(own), ranges, length)
                for x, v in zip(out, (len(own), int(gone.sum()), runs(gone), own[~gone].tobytes() if ranges else own.tobytes())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return repeated(docs, Bytes, length, gram, solve, chunk).mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary")
