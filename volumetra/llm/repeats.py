"""Which windows of a fixed number of symbols start more than once in a corpus.

Symbols are bytes or words. Working with every window would shuffle many times
the corpus, so windows travel in blocks: each window belongs to the leftmost
smallest hash among its grams (its anchor), hence equal windows have equal
anchors at equal places, and a block holds the consecutive windows of one anchor.

1. Anchors' gram hashes are counted (map-side combined). A gram met once cannot
   lie in a repeated window, so its block goes no further; counting decides nothing else.
2. Blocks of the other grams are read from the texts. Equal ones travel once, with
   the number of their copies.
3. Sampled splitters range-partition the blocks by what stands at their anchor,
   first bytes first, so that all blocks of a gram are neighbours; those of a gram with
   very many are dealt over several buckets. In each bucket a solver (sorted suffixes, or
   automata) compares the windows of a bounded number of blocks at a time.
4. Where a gram's blocks lie on both sides of a boundary, its distinct windows are
   compared across it.

Keys that may hold any share of the rows (a gram, a block with very many copies) are
dealt out by salt, or joined by broadcasting the few of them there can be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import byte_slices, cut, drop, fixed_hash, mix, pair_hash, partitions, prefix_sums, utf8, word_hashes, word_spans

#: Bytes of text worked on at a time, symbols of blocks that a solver holds at a time, and blocks whose content a task
#: remembers to have sent.
SLICE_BYTES, CHUNK_SYMBOLS, SENT = 1 << 20, 2_500_000, 100_000
#: Bytes of the leading gram that blocks are ordered by before its hash.
LEAD = 16
#: A key met this often, and in more than a quarter of a mean partition's share, is dealt out; a gram's distinct blocks
#: are from this many on.
HOT_LEAST, HOT_BLOCKS = 1000, 4000


class Bytes:
    """Texts as sequences of bytes."""

    @staticmethod
    def symbols(data: np.ndarray, bounds: np.ndarray):
        return mix(data.astype(np.uint64) + np.uint64(1)), bounds

    @staticmethod
    def spans(data: np.ndarray):
        return None

    @staticmethod
    def content(data, spans, a: int, b: int) -> bytes:
        return data[a:b].tobytes()

    @staticmethod
    def window(content: bytes, off: int, length: int) -> bytes:
        return content[off : off + length]


class Words:
    """Texts as sequences of words."""

    @staticmethod
    def symbols(data: np.ndarray, bounds: np.ndarray):
        starts, ends, firsts = word_spans(data, bounds)
        return word_hashes(data, starts, ends), firsts

    @staticmethod
    def spans(data: np.ndarray):
        return word_spans(data, np.array([0, len(data)]))[:2]

    @staticmethod
    def content(data, spans, a: int, b: int) -> bytes:
        return b" ".join(data[spans[0][a] : spans[1][b - 1]].tobytes().split())

    @staticmethod
    def window(content: bytes, off: int, length: int) -> bytes:
        return b" ".join(content.split(b" ")[off : off + length])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def blocks(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts' symbols: each block's text, first window, number of windows, anchor and gram hash."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(symbols) < window:
        return none
    grams = fixed_hash(prefix_sums(symbols), gram)
    low = np.uint64(0xFFFFFFFF)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_min(key, window - gram + 1) & low).astype(np.int64)
    inside = np.zeros(len(symbols) + 1, np.int32)
    long = np.diff(bounds) >= window
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(owner)] > 0)
    if not len(at):
        return none
    own = owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    a, n = at[first], np.diff(np.append(first, len(at)))
    return np.searchsorted(bounds, a, "right") - 1, a, n, own[first], grams[own[first]]


def text_blocks(kind, texts: pa.Array, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, first window, number of windows, anchor (from the first window) and gram hash of the texts' blocks.
    Very long texts are worked on in parts that overlap by a window."""
    data, bounds = utf8(texts)
    for k, e in byte_slices(bounds, SLICE_BYTES):
        own, step = data[bounds[k] : bounds[e]], SLICE_BYTES
        whole = e > k + 1 or len(own) <= 2 * step
        if whole or kind is not Bytes:
            every, firsts = kind.symbols(own, bounds[k : e + 1] - bounds[k])
            parts = [(every, 0)] if whole else ((every[at : at + step + window - 1], at) for at in range(0, len(every), step))
        else:
            parts = ((kind.symbols(own[at : at + step + window - 1], None)[0], at) for at in range(0, len(own), step))
        for symbols, at in parts:
            edges = firsts if whole else np.array([0, len(symbols)])
            doc, a, n, anchor, grams = blocks(symbols, edges, window, gram)
            yield doc + k, a - edges[doc] + at, n, anchor - a, grams


def salted(grams: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Another key for each salt from 1 on; 0 leaves the gram as it is."""
    return np.where(salt > 0, pair_hash(grams, salt.astype(np.uint64)), grams)


def _gram_rows(kind, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, grams in text_blocks(kind, batch["text"], window, gram):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    return run


def _placed_rows(kind, window: int, gram: int, hot: np.ndarray, salts: np.ndarray):
    """key (the gram, salted if it is hot), the text's two ids, and the block's place: first window, windows and anchor in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = batch["r1"].to_numpy(), batch["r2"].to_numpy()
            for doc, a, n, anchor, grams in text_blocks(kind, batch["text"], window, gram):
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                    spread = mix(r1[doc].view(np.uint64) + a.astype(np.uint64)) % salts[k].astype(np.uint64) + np.uint64(1)
                    grams = salted(grams, np.where(hot[k] == grams, spread, np.uint64(0)))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(r1[doc]), pa.array(r2[doc]), pa.array(a << 24 | n << 12 | anchor)], ["key", "r1", "r2", "place"])

    return run


BLOCKS = "c1 long, c2 long, r1 long, r2 long, a long, lead binary, gh long, p int, n int, content binary"


def _block_rows(kind, window: int, gram: int):
    """The blocks at the places given: a 128-bit digest of the content, and the content where the task has not sent it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        out: tuple[list, ...] = tuple([] for _ in kinds)
        digests, sent, size = [], set(), 0

        def batch_of() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [pa.array(ids[:, 0]), pa.array(ids[:, 1]), *(pa.array(x, t) for x, t in zip(out, kinds))]
            for x in (digests, *out):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["c1", "c2", "r1", "r2", "a", "lead", "gh", "p", "n", "content"])

        for batch in batches:
            data, bounds = utf8(batch["text"])
            r1, r2 = batch["r1"].to_pylist(), batch["r2"].to_pylist()
            for k in range(batch.num_rows):
                own = data[bounds[k] : bounds[k + 1]]
                spans = kind.spans(own)
                for place in batch["places"][k].as_py():
                    a, n, p = place >> 24, place >> 12 & 4095, place & 4095
                    content = kind.content(own, spans, a, a + n - 1 + window)
                    digest = blake2b(content, digest_size=16).digest()
                    digests.append(digest)
                    row = (r1[k], r2[k], a, None, None, None, None, None)
                    if digest not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(digest)
                        lead = kind.content(own, spans, a + p, a + p + gram)
                        row = (r1[k], r2[k], a, lead[:LEAD], int.from_bytes(blake2b(lead, digest_size=8).digest(), "little", signed=True), p, n, content)
                        size += len(content)
                    for x, v in zip(out, row):
                        x.append(v)
                    if size >= SLICE_BYTES or len(digests) >= 20_000:
                        yield batch_of()
                        size = 0
        if digests:
            yield batch_of()

    return run


def runs(flags: np.ndarray) -> list[int]:
    """Start and end, by turns, of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


SETTLED = "c1 long, c2 long, copies long, marked array<int>, open array<struct<off: int, h1: long, h2: long, times: long>>"


def _settled(kind, solve: Callable, window: int, chunk_symbols: int):
    """Run the solver over a bucket sorted by gram, about chunk_symbols at a time. Chunks end between grams if they can;
    `open` holds the distinct windows of grams that may go on in another chunk or bucket. Only grams with a salt may be
    in several buckets."""

    def done(rows: pa.Table, open_first: bool, open_last: bool) -> pa.RecordBatch:
        gh, content, n, copies = rows["gh"].to_numpy(), rows["content"].to_pylist(), rows["n"].to_numpy().astype(np.int64), rows["copies"].to_numpy()
        group, times = solve(gh, content, rows["p"].to_numpy().astype(np.int64), n, copies, window)
        ends = np.cumsum(n)
        firsts = ends - n
        opened: list[list] = [[] for _ in content]
        wide = np.zeros(len(gh), bool)
        if open_first:
            wide |= gh == gh[0]
        if open_last:
            wide |= gh == gh[-1]
        wide |= rows["salt"].to_numpy() > 0
        if wide.any():
            at = np.flatnonzero(np.repeat(wide, n))
            at = at[np.unique(group[at], return_index=True)[1]]
            for k, w in zip((np.searchsorted(ends, at, "right")).tolist(), at.tolist()):
                off = w - int(firsts[k])
                h1, h2 = np.frombuffer(blake2b(kind.window(content[k], off, window), digest_size=16).digest(), np.int64).tolist()
                opened[k].append({"off": off, "h1": h1, "h2": h2, "times": int(times[w])})
        often = times > 1
        marked = [runs(often[a:b]) for a, b in zip(firsts.tolist(), ends.tolist())]
        keep = pa.array([bool(m or o) for m, o in zip(marked, opened)], pa.bool_())
        types = pa.list_(pa.int32()), pa.list_(pa.struct([("off", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("times", pa.int64())]))
        columns = [*(rows[c].combine_chunks() for c in ("c1", "c2", "copies")), pa.array(marked, types[0]), pa.array(opened, types[1])]
        return pa.RecordBatch.from_arrays(columns, ["c1", "c2", "copies", "marked", "open"]).filter(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_first = None, False
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            while True:
                size = np.cumsum(held["n"].to_numpy() + np.int64(window - 1))
                fit = int(np.searchsorted(size, chunk_symbols, "right"))
                if fit >= len(held):
                    break
                g = held["gh"].to_numpy()
                ends = np.flatnonzero(g[1 : fit + 1] != g[:fit]) + 1
                end = int(ends[-1]) if len(ends) else max(1, fit)
                inside = end == len(g) or bool(g[end] == g[end - 1])
                yield done(held.slice(0, end), open_first, inside)
                held, open_first = held.slice(end), inside
        if held is not None and len(held):
            yield done(held, open_first, False)

    return run


def repeated(docs: DataFrame, kind, window: int, gram: int, solve: Callable, chunk_symbols: int = CHUNK_SYMBOLS) -> DataFrame:
    """doc_id and text of docs with `ranges`: windows start, end by turns, of windows that start more than once.

    solve(gram hashes, contents, anchors, windows, copies, window) gives for every window of the blocks, in order, a
    number that equal windows share, and how often the window stands in these blocks.
    Rows that agree in doc_id and text share a 128-bit id; each still counts as an occurrence.
    """
    if window >= 4096:
        raise ValueError("windows of up to 4095 symbols")
    parts = partitions(docs)
    keyed = docs.select("doc_id", "text", *(F.xxhash64(F.lit(k), "doc_id", "text").alias(f"r{k}") for k in (1, 2)))
    found = cut(keyed.select("text").mapInArrow(_gram_rows(kind, window, gram), "gram long").groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"))
    many = max(HOT_LEAST, (found.agg(F.sum("c")).first()[0] or 0) // (4 * parts))  # fewer than 4 * parts grams can be met more often
    hot = sorted(((int(np.int64(r.gram).view(np.uint64)), -(-r.c // many)) for r in found.where(F.col("c") > many).collect()))
    hots, salts = np.array([g for g, _ in hot], np.uint64), np.array([s for _, s in hot], np.int64)
    keys = found.where(F.col("c") <= many).select(F.col("gram").alias("key"))
    if hot:
        spread = salted(np.repeat(hots, salts), np.concatenate([np.arange(1, s + 1) for s in salts]))
        keys = keys.union(docs.sparkSession.createDataFrame([(k,) for k in spread.view(np.int64).tolist()], "key long"))
    placed = keyed.select("r1", "r2", "text").mapInArrow(_placed_rows(kind, window, gram, hots, salts), "key long, r1 long, r2 long, place long")
    places = placed.join(keys, "key", "left_semi").groupBy("r1", "r2").agg(F.collect_set("place").alias("places"))
    dealt = keyed.repartition(parts, "r1", "r2")
    candidates = cut(dealt.join(places, ["r1", "r2"]).select("text", "r1", "r2", "places").mapInArrow(_block_rows(kind, window, gram), BLOCKS))
    drop(found)
    columns = ("lead", "gh", "p", "n", "content")
    distinct = candidates.groupBy("c1", "c2").agg(F.count("*").alias("copies"), *(F.first(c, True).alias(c) for c in columns))
    sent = cut(candidates.where("gh is not null").groupBy("gh").agg(F.count("*").alias("blocks")))  # a block counts once a task at most
    wide = max(HOT_BLOCKS, (sent.agg(F.sum("blocks")).first()[0] or 0) // (4 * parts))
    large = sent.where(F.col("blocks") > wide).select("gh", F.ceil(F.col("blocks") / wide).alias("salts"))  # fewer than 4 * parts
    dealt_out = distinct.join(F.broadcast(large), "gh", "left").withColumn("salt", F.coalesce(F.pmod("c1", "salts") + 1, F.lit(0)))
    order = ("lead", "gh", "salt")
    settled = cut(
        dealt_out.repartitionByRange(parts, *order).sortWithinPartitions(*order, "c1").select("gh", "p", "n", "copies", "c1", "c2", "salt", "content")
        .mapInArrow(_settled(kind, solve, window, chunk_symbols), SETTLED)
    )
    opened = settled.select("c1", "c2", F.explode("open").alias("w")).groupBy("w.h1", "w.h2").agg(
        F.sum("w.times").alias("all"), F.collect_list(F.when(F.col("w.times") == 1, F.struct("c1", "c2", "w.off"))).alias("single")
    )
    across = opened.where("all > 1").select(F.explode("single").alias("w")).groupBy("w.c1", "w.c2").agg(F.collect_set(F.array("w.off", F.col("w.off") + 1)).alias("pairs"))
    marked = cut(
        settled.where(F.size("marked") > 0).select("c1", "c2", "copies", "marked")
        .unionByName(across.select("c1", "c2", F.lit(1).cast("long").alias("copies"), F.flatten("pairs").alias("marked")))
    )
    members = candidates.select("c1", "c2", "r1", "r2", "a")
    often = marked.where(F.col("copies") > many)  # again fewer than 4 * parts
    rest = members.join(F.broadcast(often.select("c1", "c2")), ["c1", "c2"], "left_anti").join(marked.where(F.col("copies") <= many), ["c1", "c2"])
    marks = cut(
        members.join(F.broadcast(often), ["c1", "c2"]).unionByName(rest)
        .select("r1", "r2", F.transform("marked", lambda m: m + F.col("a")).alias("m")).groupBy("r1", "r2").agg(F.flatten(F.collect_set("m")).alias("ranges"))
    )
    drop(candidates, sent, settled, marked)
    return dealt.join(marks, ["r1", "r2"], "left").select("doc_id", "text", F.coalesce("ranges", F.array().cast("array<long>")).alias("ranges"))


def covered(n: int, ranges: list[int], window: int) -> np.ndarray:
    """Which of n symbols lie in a marked window."""
    step = np.zeros(n + 1, np.int32)
    r = np.asarray(ranges, np.int64).reshape(-1, 2)
    np.add.at(step, r[:, 0], 1)
    np.add.at(step, r[:, 1] - 1 + window, -1)
    return np.cumsum(step[:-1]) > 0
