"""Near-duplicates by SimHash, found by the generalised pigeonhole principle.

Equal fingerprints are one node. Bits that go together (in a bounded sample) are put into the same partition, so that a
fingerprint is rare in some partition even if it is common in others. Thresholds of the partitions add up to the distance
less the number of partitions, plus one, and may be -1: then of two fingerprints within the distance, at least one
partition differs by no more than its own threshold. Dynamic programming chooses the thresholds, and among several numbers
of partitions the cheapest, by what candidates and keys each would give, estimated from the sample and the number of
nodes. Fingerprints meet by a partition's value: each sends its own, and those that lie within the threshold and below it.

What meets is verified on all 64 bits. Small groups compare all members in one task, which gives no more links than it
has members. Members of large groups first link by keys that all fingerprints within one bit share: those that share one
lie within two bits, so that a chain along each key is right and needs no comparison. In each large group, only members
that do not belong to the group's main component by then are compared with the others, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import byte_slices, cut, hash_sample, join_split, partitions, utf8, word_spans
from volumetra.llm.dual_tree import spread
from volumetra.llm.graph import components

#: Production parameters: words of a shingle, seed of the hash, differing bits that still link.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints sampled for partitions and thresholds, on which no result depends.
SAMPLE_ROWS = 20_000
#: Sampled fingerprints whose pairs are looked at.
PAIRS = 4096
#: Members up to which all pairs of a group are compared at once, and pairs compared at once.
FEW, AT_ONCE = 24, 1 << 20
#: Members up to which a group is compared in one task; rows up to which a table is broadcast.
GROUP, BROADCAST_ROWS = 8192, 1_000_000
#: What a key costs in comparisons.
KEY_COST = 50
#: Shingles hashed together, and bytes of text taken together.
TOGETHER, SLICE_BYTES = 100_000, 1 << 20

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start:end] for each pair: those under 32 bytes all together, longer ones by the library."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h, at = np.uint64(seed) + P5 + size.astype(np.uint64), start.copy()
    for _ in range(3):
        k = np.flatnonzero(end - at >= 8)
        lane = _turn(eight[at[k]] * P2, 31) * P1
        h[k] = _turn(h[k] ^ lane, 27) * P1 + P4
        at[k] += 8
    k = np.flatnonzero(end - at >= 4)
    h[k] = _turn(h[k] ^ (eight[at[k]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at[k] += 4
    for _ in range(3):
        k = np.flatnonzero(end > at)
        h[k] = _turn(h[k] ^ padded[at[k]].astype(np.uint64) * P5, 11) * P1
        at[k] += 1
    for shift, prime in ((33, P2), (29, P3)):
        h = (h ^ h >> np.uint64(shift)) * prime
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]], seed)
    return h


def fingerprints(data: np.ndarray, bounds: np.ndarray, words: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text: bit b is 1 if it is set in over half of the shingles' hashes."""
    starts, ends, firsts = word_spans(data, bounds)
    sizes = ends - starts
    after = np.cumsum(sizes + 1)  # words joined by a space each: where each word and its space end
    joined = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    joined[spread(after - sizes - 1, sizes)] = _FOLD[data[spread(starts, sizes)]]
    many = np.diff(firsts)
    shingles = np.where(many >= words, many - words + 1, (many > 0).astype(np.int64))
    first = spread(firsts[:-1], shingles)
    last = first + np.minimum(np.repeat(many, shingles), words) - 1
    owner = np.repeat(np.arange(len(many)), shingles)
    counts = np.zeros((len(many), 64), np.int64)
    for k in range(0, len(first), TOGETHER):
        f, e, o = first[k : k + TOGETHER], last[k : k + TOGETHER], owner[k : k + TOGETHER]
        begin, end = after[f] - sizes[f] - 1, after[e] - 1
        h = xxh64(joined[begin[0] : end[-1]], begin - begin[0], end - begin[0])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        runs = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        counts[o[runs]] += np.add.reduceat(bits, runs, dtype=np.int32)
    over = 2 * counts > shingles[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprinted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch["text"])
            for k, e in byte_slices(bounds, SLICE_BYTES):
                found = fingerprints(data[bounds[k] : bounds[e]], bounds[k : e + 1] - bounds[k], words)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(k, e - k), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return run


def bits_of(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """The bits' numbers in partitions of about one size; each takes the bit that goes best with those it has."""
    x = bits - (bits.mean(0) if len(bits) else 0)
    scale = np.sqrt(np.square(x).sum(0))
    together = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(together, 0)
    left, out = list(range(bits.shape[1])), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(left, key=lambda b: together[b, left].max())]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: together[b, own].sum()))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def masks(width: int, threshold: int) -> np.ndarray:
    """All changes of at most `threshold` bits."""
    return np.array([sum(1 << b for b in c) for n in range(threshold + 1) for c in combinations(range(width), n)], np.int64)


def costs(bits: np.ndarray, part: list[int], nodes: int, distance: int) -> list[float]:
    """What the partition would cost a node at each threshold from -1 on: candidates, by the sample's pairs and by what
    even values would give, and keys."""
    own, rows = values(bits[:PAIRS], part), max(min(len(bits), PAIRS), 1)
    near = np.zeros(distance + 1)
    for k in range(0, len(own), 256):
        near += np.bincount(np.bitwise_count(own[k : k + 256, None] ^ own).ravel(), minlength=distance + 1)[: distance + 1]
    shares, out = (np.cumsum(near) / rows - 1) / rows, [0.0]  # of pairs of different nodes
    for t in range(distance + 1):
        keys = sum(comb(len(part), n) for n in range(t + 1))
        out.append(nodes * (shares[t] + keys / 2 ** len(part)) + KEY_COST * (1 + keys / 2) if keys <= 5000 else float("inf"))
    return out


def allocated(bits: np.ndarray, nodes: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds (those of -1 left out), cheapest by dynamic programming over the partitions."""
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for many in range(2, distance + 3):
        parts = correlated_parts(bits, many)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of thresholds plus one of each partition
        for part in parts:
            cost, new = costs(bits, part, nodes, distance), {}
            for used, (c, chosen) in table.items():
                for t in range(-1, distance + 1):
                    to = used + t + 1
                    if to <= distance + 1 and (to not in new or c + cost[t + 1] < new[to][0]):
                        new[to] = (c + cost[t + 1], [*chosen, t])
            table = new
        c, chosen = table[distance + 1]  # the sum of thresholds is then distance + 1 - many
        if c < best[0]:
            best = (c, [(p, t) for p, t in zip(parts, chosen) if t >= 0])
    return best[1]


def _keys(plan: list[tuple[list[int], int]]):
    """Rows part, value and print: a partition's own value, and smaller ones within the threshold."""
    changes = [masks(len(p), t) for p, t in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                prints = batch["print"].slice(k, 2000).to_numpy()
                bits = bits_of(prints.view(np.uint64))
                for number, ((part, _), change) in enumerate(zip(plan, changes)):
                    own = values(bits, part)
                    near = own[:, None] ^ change
                    at, which = np.nonzero(near <= own[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(near[at, which]), pa.array(prints[at])], ["part", "value", "print"])

    return run


def spanning(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what lies within the distance, fewer than there are prints: each print that is reached looks for
    those that are not, so that a dense group takes few comparisons."""
    left, out = prints, []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            some, wave = wave[:256], wave[256:]
            x, y = np.nonzero(np.bitwise_count(some[:, None] ^ left) <= distance)
            new, at = np.unique(y, return_index=True)
            out += zip(some[x[at]].tolist(), left[new].tolist())
            wave, left = np.r_[wave, left[new]], np.delete(left, new)
    return out


def _links(distance: int):
    """Over rows task, side, root and print, sorted by task: links u, v. Without sides (0) all prints of a task are
    compared; else those of side 1 with those of side 2, and roots are linked. Equal prints of a task stand once."""

    def groups(task: np.ndarray, side: np.ndarray, root: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        size = np.diff(np.r_[begins, len(task)])
        u, v = [], []
        few = (size <= FEW) & (side[begins] == 0)
        a = spread(begins[few], size[few])  # each row of these groups meets the rows behind it
        behind = np.repeat(begins[few] + size[few], size[few]) - a - 1
        steps = np.searchsorted(np.cumsum(behind), np.arange(0, behind.sum() + AT_ONCE, AT_ONCE), "right")
        for k, e in zip(np.r_[0, steps[1:-1]], np.r_[steps[1:-1], len(a)]):
            x, y = np.repeat(a[k:e], behind[k:e]), spread(a[k:e] + 1, behind[k:e])
            near = np.bitwise_count(prints[x] ^ prints[y]) <= distance
            u.append(prints[x[near]])
            v.append(prints[y[near]])
        for k, e in zip(begins[~few].tolist(), (begins + size)[~few].tolist()):
            if side[k] == 0:
                if pairs := spanning(np.unique(prints[k:e]), distance):
                    x, y = np.array(pairs, np.uint64).T
                    u.append(x)
                    v.append(y)
                continue
            one, other = (np.flatnonzero(side[k:e] == i) + k for i in (1, 2))
            for n in range(0, len(one), 256):
                x, y = np.nonzero(np.bitwise_count(prints[one[n : n + 256], None] ^ prints[other]) <= distance)
                pairs = np.unique(np.stack([root[one[n + x]], root[other[y]]], 1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                u.append(pairs[:, 0])
                v.append(pairs[:, 1])
        both = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch[c].to_numpy(zero_copy_only=False) for c in ("task", "side", "root", "print")]
            new[2:] = [x.view(np.uint64) for x in new[2:]]
            rows = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = int(np.flatnonzero(rows[0] != rows[0][-1])[-1] + 1) if rows[0][0] != rows[0][-1] else 0
            if last:
                yield groups(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
        if held:
            yield groups(*held)

    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each print with itself and all prints one bit away."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            prints = batch["print"].slice(k, 1000).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((prints[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(prints, 65).view(np.int64))], ["key", "print"])


def _in_large_groups(members: DataFrame, distance: int, group: int) -> DataFrame:
    """Links of groups (task, print) too large for one task."""
    parts = partitions(members)
    prints = members.select("print").distinct()
    labelled = members.withColumn("root", F.col("print"))
    stars = None
    if distance >= 2:  # prints that share a key lie within two bits
        keys = cut(prints.mapInArrow(_around, "key long, print long"))
        first = keys.groupBy("key").agg(F.min("print").alias("u"), F.count("*").alias("m")).where("m > 1").select("key", "u")
        stars = cut(keys.join(first, "key").where("print != u").select("u", F.col("print").alias("v")).distinct())
        labelled = members.join(components(stars).withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    placed = cut(labelled.select("task", "print", "root"))
    sizes = placed.groupBy("task", "root").agg(F.count("*").alias("n")).groupBy("task").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / group)
    main = cut(sizes.select("task", F.col("main.root").alias("main"), blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("main.n")).alias("others")).where("others > 0"))
    dealt = placed.join(F.broadcast(main) if main.count() <= BROADCAST_ROWS else main, "task").withColumn("h", F.xxhash64("print"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    other = dealt.where("root != main").select("task", F.pmod("h", "others").alias("i"), every("blocks").alias("j"), F.lit(1).alias("side"), "root", "print")
    whole = dealt.select("task", every("others").alias("i"), F.pmod("h", "blocks").alias("j"), F.lit(2).alias("side"), "root", "print")
    tasks = other.unionByName(whole).select(F.xxhash64("task", "i", "j").alias("task"), "side", "root", "print")
    found = tasks.repartition(parts, "task").sortWithinPartitions("task", "side").mapInArrow(_links(distance), "u long, v long")
    return found if stars is None else found.union(stars)


def simhash_components(docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, a row for each row of docs.

    Takes doc_id and text; other columns, whatever their names, are ignored. Null, empty and blank texts have fingerprint
    zero and link like any other; a null doc_id counts only where all ids of a component are null; equal rows get a row
    each; an empty table gives an empty one.
    """
    parts = partitions(docs)
    rows = cut(docs.select("doc_id", "text").mapInArrow(_fingerprinted(words), "doc_id long, print long"))
    nodes = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")))
    many = nodes.count()
    sample = hash_sample(nodes.select("print"), "print", SAMPLE_ROWS).toArrow()["print"].to_numpy().view(np.uint64)
    plan = allocated(bits_of(sample), many, distance)
    keys = nodes.select("print").mapInArrow(_keys(plan), "part int, value long, print long")
    keyed = cut(keys.select(F.xxhash64("part", "value").alias("task"), "print"))  # keys that share a hash only add candidates
    sizes = cut(keyed.groupBy("task").agg(F.count("*").alias("n")).where("n > 1"))
    large = sizes.where(F.col("n") > group).select("task")
    small = keyed.join(sizes.where(F.col("n") <= group).select("task"), "task", "left_semi")
    one = small.select("task", F.lit(0).alias("side"), F.col("print").alias("root"), "print").repartition(parts, "task").sortWithinPartitions("task")
    links = one.mapInArrow(_links(distance), "u long, v long").where("u != v")
    if n := large.count():
        members = cut(keyed.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "task").distinct())
        links = links.union(_in_large_groups(members, distance, group))
    joined = components(cut(links.distinct())).withColumnRenamed("node", "print")
    placed = cut(nodes.join(joined, "print", "left").withColumn("root", F.coalesce("root", "print")))
    often = max(1000, rows.count() // (4 * parts))
    smallest = cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("m").alias("m_root")))
    placed = cut(join_split(placed, smallest, ["root"], f"m_root > {often}").select("print", "m", "component_id"))
    out = join_split(rows, placed, ["print"], f"m > {often}")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
