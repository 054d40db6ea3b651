"""Exact Jaccard self-join of documents on word n-grams, by T-occurrence search.

Documents with equal shingle sets form a class, and classes are joined. Two
classes that link share one of the first |A| - T + 1 shingles of either in any
fixed order; the order puts shingles of rare words first and shingles that are
frequent in a sample last, which changes the work but no result. Inverted lists
over these shingles are short or long. Where short ones hold too many pairs, as
those of many near copies of each text do, classes are first linked within two
lists each, those of smallest hash, which near copies mostly have in common; lists
of one component then need no pairs. Short lists are merged: pairs that meet
in them are counted, and a pair goes on if its count, with all long lists it
might share, reaches what the required overlap leaves to these shingles, and if
bitmaps of both sets allow the overlap. Classes that meet in long lists, and
pairs that went on, come together in groups; within a group, an inverted index
answers each class's T-occurrence query as DivideSkip does: short lists are
merged, long ones are probed by binary search, overlaps are exact. A large group
is linked in blocks by set size, each with a few classes of the next one; after
that, only classes outside the group's main component still have to meet the
other blocks, so a group of near copies costs in proportion to its size.

Shingles are compared by 64-bit hashes, which mix every word's bytes with their places. Classes have a 128-bit digest
of their set and travel by its first 64 bits; should those of two classes agree, one of them is renamed before any join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import byte_slices, cut, drop, join_split, pair_hash, partitions, utf8, word_hashes, word_spans
from volumetra.llm.graph import components

#: Production parameters: words of a shingle, similarity in per cent.
SHINGLE, PERCENT = 5, 75
#: Documents, and characters of each, sampled for the order of shingles, which no result depends on.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT_MOST, TABLE_BITS = 8192, 6000, 200_000, 18
#: Of a larger corpus, a document of so many is sampled, so that the shingles of long lists are met in it at any size.
SAMPLE_EVERY = 32
#: Tasks that count the sample at least, and documents of it that one counts.
SAMPLE_TASKS, SAMPLE_TASK_DOCS = 8, 1024
#: Lists of more documents than this are long; words of 64 bits in a set's bitmap.
SHORT_LIST, BITMAP = 256, 32
#: Shingles of a group that one task links first, and shingles of each of the two blocks that one task compares after that.
BLOCK_SHINGLES, GROUP_SHINGLES = 250_000, 1_000_000
#: Classes of a block that the block before also holds, so that what both have linked comes together.
BRIDGES = 8
#: Rows up to which the classes that have candidates are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Pairs from short lists, for each class, beyond which near copies are linked first; smallest lists that they meet in then.
MOST_PAIRS, FIRST_LIST = 200, 8
#: Sets with most copies of which only one text goes on to the lists; of all others every copy does, which costs work only.
COPIED = 100_000
#: Shingles that are dealt to tasks at once, or half of all that the texts have, if these are more; beyond, tasks go in rounds.
ROUND_SHINGLES = 20_000_000
SLICE_BYTES = 400_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each text its distinct shingles' hashes, sorted, and for each the index of its first word's hash; then the word hashes."""
    data = _FOLD[data]
    starts, ends, firsts = word_spans(data, bounds)
    hashes = word_hashes(data, starts, ends)
    grams = hashes[: max(0, len(hashes) - words + 1)]
    for k in range(1, words):
        grams = pair_hash(grams, hashes[k : k + len(grams)])
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= words:
            out, at = np.unique(grams[a : b - words + 1], return_index=True)
            yield out, hashes, at + a
        elif b > a:
            whole = hashes[a : a + 1]
            for k in range(a + 1, b):
                whole = pair_hash(whole, hashes[k : k + 1])
            yield whole, hashes, np.array([a])
        else:
            yield grams[:0], hashes, np.zeros(0, np.int64)


class Classes:
    """Names of shingle sets: the first `bits` bits of a 128-bit digest, but those in `moved` go by another name."""

    def __init__(self, bits: int, moved: dict[tuple[int, int], int] | None = None):
        self.bits, self.moved = bits, moved or {}

    def both(self, s: np.ndarray) -> tuple[int, int]:
        if not len(s):
            return 0, 0
        d = blake2b(s.tobytes(), digest_size=16).digest()
        return int.from_bytes(d[:8], "little", signed=True) >> (64 - self.bits), int.from_bytes(d[8:], "little", signed=True)

    def name(self, s: np.ndarray) -> int:
        both = self.both(s)
        return self.moved.get(both, both[0]) if self.moved else both[0]


def _parts(batch: pa.RecordBatch, words: int):
    """The batch in parts of about SLICE_BYTES of text, each with its rows' shingle sets."""
    data, bounds = utf8(batch["text"])
    for k, e in byte_slices(bounds, SLICE_BYTES):
        yield batch.slice(k, e - k), shingle_sets(data[bounds[k] : bounds[e]], bounds[k : e + 1] - bounds[k], words)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each shingle, as BITMAP words; different shingles may share one."""
    bits = np.zeros(BITMAP * 64, np.uint8)
    bits[(s % np.uint64(BITMAP * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _classes(words: int, classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _parts(batch, words):
                rows = [(len(s), *classes.both(s), bitmap(s)) for s, _, _ in sets]
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BITMAP, pa.int32()), pa.array(np.concatenate([r[3] for r in rows])))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), bits], ["doc_id", "n_shingles", "cls", "cls2", "bits"])

    return run


def _words_used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of word hashes, and how many words each has."""
    used = np.zeros(1 << TABLE_BITS, np.int64)
    for batch in batches:
        data, bounds = utf8(batch["text"])
        for k, e in byte_slices(bounds, SLICE_BYTES):
            part = _FOLD[data[bounds[k] : bounds[e]]]
            starts, ends, _ = word_spans(part, bounds[k : e + 1] - bounds[k])
            used += np.bincount((word_hashes(part, starts, ends) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=1 << TABLE_BITS)
    some = np.flatnonzero(used)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], ["key", "n"])


def _sampled_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Classes(64)
        for batch in batches:
            for _, sets in _parts(batch, words):
                rows = [(*names.both(s), s.tobytes()) for s, _, _ in sets if len(s)]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)), pa.array([r[2] for r in rows], pa.binary())], ["cls", "cls2", "shingles"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the sets, and in how many of a batch each is."""
    for batch in batches:
        token, n = np.unique(np.frombuffer(b"".join(batch["shingles"].to_pylist()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["key", "n"])


def sampled_order(texts: DataFrame, words: int, tasks: int = SAMPLE_TASKS, most: int = FREQUENT_MOST) -> "Order":
    """The order that a sample of texts gives. Tasks count; the driver gets the counts of buckets of words and of `most`
    shingles in three different sets or more, and no text."""
    sample = cut(texts.repartition(tasks))
    total = lambda rows: rows.groupBy("key").agg(F.sum("n").alias("n"))
    used = total(sample.mapInArrow(_words_used, "key long, n long")).toArrow()
    sets = sample.mapInArrow(_sampled_sets(words), "cls long, cls2 long, shingles binary").groupBy("cls", "cls2").agg(F.first("shingles").alias("shingles"))
    often = cut(total(sets.select("shingles").mapInArrow(_tokens, "key long, n long")).where("n >= 3"))
    if often.count() > most:
        times, above = 0, 0
        for times, m in often.groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).toLocalIterator():
            if above + m > most:
                break
            above += m
        often = often.where(F.col("n") > times).union(often.where(F.col("n") == times).limit(most - above))
    often = often.toArrow()
    return Order(*(t[c].to_numpy() for t in (often, used) for c in ("key", "n")))


class Order:
    """A fixed order of shingles: unusual words first, shingles frequent in the sample last. Takes shingles in several sets
    of the sample with their counts, and buckets of word hashes with theirs."""

    def __init__(self, shingles: np.ndarray, times: np.ndarray, buckets: np.ndarray, used: np.ndarray):
        shingles, self.table = shingles.view(np.uint64), np.zeros(1 << TABLE_BITS, np.int64)
        self.frequent = np.sort(shingles[np.lexsort((shingles, -times))[:FREQUENT_MOST]])
        self.table[buckets] = np.log2(1 + used).astype(np.int64)

    def first(self, s: np.ndarray, hashes: np.ndarray, at: np.ndarray, words: int, many: int) -> np.ndarray:
        n = len(s)
        own = at[:, None] + (np.arange(words) if at.max(initial=0) + words <= len(hashes) else 0)
        score = self.table[(hashes[own] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].sum(1)
        if len(self.frequent):
            k = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
            score = score + 1000 * (self.frequent[k] == s)
        return s[np.lexsort((s, score))[:many]] if many < n else s


def _postings(words: int, percent: int, order, names: Classes, copied):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _parts(batch, words):
                tokens, classes, sizes = [np.zeros(0, np.uint64)], [], []
                for doc, (s, hashes, at) in zip(part["doc_id"].to_pylist(), sets):
                    if (n := len(s)) and copied.value.get(c := names.name(s), doc) == doc:
                        tokens.append(order.value.first(s, hashes, at, words, n + (-n * percent // 100) + 1))
                        classes.append(c)
                        sizes.append(len(tokens[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), np.array(sizes, np.int64)))], ["token", "cls"])

    return run


def _sets(words: int, names: Classes, copied):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _parts(batch, words):
                rows = [(c, s.tobytes()) for doc, (s, _, _) in zip(part["doc_id"].to_pylist(), sets) if len(s) and copied.value.get(c := names.name(s), doc) == doc]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["cls", "shingles"])

    return run


def _once(sets):
    """Of the rows of one class that a task's `sets` give, the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sets(batches):
            new = [c not in seen and not seen.add(c) for c in batch["cls"].to_pylist()]
            yield batch.filter(pa.array(new, pa.bool_()))

    return run


def divide_skip(sets: list[np.ndarray], percent: int, known: list | None = None) -> list[int]:
    """Join the sets; each one's root after all links (a member's index). Sets with equal `known` are linked already."""
    first: dict = {}
    root = [first.setdefault(c, k) for k, c in enumerate(known)] if known else list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def linked(a: int, b: int) -> bool:
        x, y = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
        if 100 * len(x) < percent * len(y):
            return False
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    # Most of a group of near copies links to its first or previous member; then only the others have to search.
    for k in range(1, len(sets)):
        for other in {0, k - 1}:
            if find(k) != find(other) and linked(k, other):
                root[find(k)] = find(other)
    roots = np.array([find(k) for k in range(len(sets))])
    main = np.bincount(roots).argmax()
    queries = np.flatnonzero(roots != main).tolist()
    if not queries:
        return roots.tolist()
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, lists = np.unique(np.concatenate(sets), return_inverse=True)  # the list that each shingle of each set is in
    length = np.bincount(lists)
    owner, first = np.repeat(np.arange(len(sets)), sizes)[np.argsort(lists, kind="stable")], np.cumsum(length) - length
    for q in queries:
        own = lists[ends[q] - sizes[q] : ends[q]]
        need = -(-percent * len(own) // 100)
        long = min(need - 1, int(need / (1 + 0.01 * np.log2(1 + length[own].max()))))
        short = own[np.argsort(length[own], kind="stable")[: len(own) - long]]
        size = length[short]
        runs = owner[np.repeat(first[short] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        met, times = np.unique(np.sort(runs, kind="stable"), return_counts=True)  # a merge of sorted runs, one a list
        fit = (times >= need - long) & (100 * sizes[met] >= percent * len(own)) & (100 * len(own) >= percent * sizes[met])
        for c in met[fit].tolist():  # linked() probes the long lists
            if find(c) != find(q) and linked(q, c):
                root[find(c)] = find(q)
    return [find(k) for k in range(len(sets))]


def _links(percent: int):
    """Over rows (task, cls, known, shingles) sorted by task and cls: links (u, v) between the known components that the
    task's classes have linked. Of rows with one task and cls, one counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, held = None, None, []

        def done() -> pa.RecordBatch:
            known = [k for k, _ in held]
            roots = divide_skip([s for _, s in held], percent, known) if len(set(known)) > 1 else []
            pairs = sorted({(known[k], known[r]) for k, r in enumerate(roots) if known[k] != known[r]})
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            for t, c, k, s in zip(*(batch[x].to_pylist() for x in ("task", "cls", "known", "shingles"))):
                if t != task and held:
                    yield done()
                    held = []
                if (t, c) != (task, last):
                    held.append((k, np.frombuffer(s, np.uint64)))
                task, last = t, c
        if held:
            yield done()

    return run


def _dealt(groups: DataFrame, group_shingles: int, parts: int) -> DataFrame:
    """cls, root, n and block: a group's classes by set size, about group_shingles in a block. Running totals are taken
    over sizes (and salts of one size) first, so that no task has to see a whole group."""
    salts = max(1, -(-groups.count() // (20_000 * parts)))
    salted = groups.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(salts)))
    sums = salted.groupBy("root", "n", "_salt").agg(F.sum("n").alias("all"))
    before = Window.partitionBy("root").orderBy("n", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("root", "n", "_salt", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("root", "n", "_salt").orderBy("cls")) - 1
    return salted.withColumn("_rank", rank).join(base, ["root", "n", "_salt"]).select("cls", "root", "n", F.floor((F.col("base") + F.col("_rank") * F.col("n")) / group_shingles).alias("block"))


def jaccard_components(
    docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, group_shingles: int = GROUP_SHINGLES, broadcast_rows: int = BROADCAST_ROWS, short_list: int = SHORT_LIST, bits: int = 64,
    block_shingles: int = BLOCK_SHINGLES, bridge: int = BRIDGES, most_pairs: int = MOST_PAIRS, copied_sets: int = COPIED, round_shingles: int = ROUND_SHINGLES,
) -> DataFrame:
    """doc_id, n_shingles, cls (equal for equal shingle sets) and component_id, a row for each row of docs.

    Takes `doc_id` and `text` (other columns, whatever their names, are ignored). Null, empty and blank texts have no
    shingles and link with nothing, so each is its own component; a null doc_id counts only where all ids of a component
    are null. Equal rows get a row each; an empty table gives an empty one.
    """
    read, spark = docs.select("doc_id", "text"), docs.sparkSession
    parts = partitions(docs)
    rows = cut(read.mapInArrow(_classes(words, Classes(bits)), "doc_id long, n_shingles long, cls long, cls2 long, bits array<long>"))
    # Expected are (number of sets) ** 2 / 2 ** 65 pairs of sets with the same 64 bits: none but in the largest corpora.
    clash = rows.groupBy("cls").agg(F.min("cls2").alias("lo"), F.max("cls2").alias("hi")).where("lo < hi").select("cls", "lo")
    moved = {(r.cls, r.cls2): r.cls2 for r in rows.join(F.broadcast(clash), "cls").where("cls2 != lo").select("cls", "cls2").distinct().collect()}
    names = Classes(bits, moved)
    if moved:
        table = spark.createDataFrame([(*k, v) for k, v in moved.items()], "cls long, cls2 long, other long")
        rows = rows.join(F.broadcast(table), ["cls", "cls2"], "left").withColumn("cls", F.coalesce("other", "cls"))
    rows = rows.select("doc_id", "n_shingles", "cls", "bits")
    copies = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("kept"), F.count("*").alias("m")).where("m > 1 AND kept IS NOT NULL")
    copied = spark.sparkContext.broadcast({r.cls: r.kept for r in copies.orderBy(F.desc("m"), "cls").limit(copied_sets).select("cls", "kept").toLocalIterator()})
    every = max(1, min(SAMPLE_EVERY, rows.count() // SAMPLE_DOCS))
    sample = read.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    order = spark.sparkContext.broadcast(sampled_order(sample, words, max(SAMPLE_TASKS, rows.count() // every // SAMPLE_TASK_DOCS)))
    postings = read.mapInArrow(_postings(words, percent, order, names, copied), "token long, cls long")
    # A table of its own, so that its shuffle is gone before the postings are dealt again.
    lists = cut(postings.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("m")).where("low < high").select("token", "low", "m"))
    met = cut(postings.join(lists, "token").groupBy("token", "cls").agg(F.first("low").alias("low"), F.first("m").alias("m")))
    met = met.withColumn("long", F.col("m") > short_list)
    sets = rows.where("n_shingles > 0").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    size = met.groupBy("cls").agg(F.sum(F.col("long").cast("int")).alias("longs")).join(sets.select("cls", "n"), "cls")
    whole = read.mapInArrow(_once(_sets(words, names, copied)), "cls long, shingles binary")

    at_once = max(round_shingles, (rows.agg(F.sum("n_shingles")).first()[0] or 0) // 2)

    def linked(tasks: DataFrame) -> DataFrame:
        """Links found by tasks (task, cls, known, n). Sets are shuffled once for each task that a class is in; where that is
        much, tasks go in rounds, and a round's shuffle is gone before the next one's."""
        work = tasks.agg(F.count("*").alias("m"), F.sum("n").alias("n")).first()
        rounds = -(-(work.n or 0) // at_once)
        join = lambda table, side, many, how="inner": table.join(F.broadcast(side) if many <= broadcast_rows else side, "cls", how)
        held = cut(join(whole, tasks.select("cls").distinct(), work.m, "left_semi")) if rounds > 1 else whole
        found = []
        for k in range(max(1, rounds)):
            own = tasks.where(F.pmod(F.xxhash64("task"), F.lit(rounds)) == k) if rounds > 1 else tasks
            dealt = join(held, own, work.m // max(1, rounds)).select("task", "cls", "known", "shingles").repartition(parts, "task").sortWithinPartitions("task", "cls")
            found.append(cut(dealt.mapInArrow(_links(percent), "u long, v long")))
        if rounds > 1:
            drop(held)
        return reduce(DataFrame.unionByName, found)

    listed, near_links = met.where("NOT long").select("token", "cls"), None
    work = met.where("NOT long").agg(F.sum((F.col("m") - 1) / 2).alias("pairs"), F.approx_count_distinct("cls").alias("n")).first()
    if (work.pairs or 0) > most_pairs * work.n:
        first = [F.min_by("token", F.xxhash64("token", F.lit(k))) for k in (1, 2)]
        chosen = met.where(f"NOT long AND m >= {FIRST_LIST}").groupBy("cls").agg(F.array_distinct(F.array(*first)).alias("tokens"))
        near_links = linked(cut(chosen.join(size, "cls").select(F.explode("tokens").alias("task"), "cls", F.col("cls").alias("known"), "n")))
        known = components(near_links).select(F.col("node").alias("cls"), F.col("root").alias("known"))
        listed = cut(listed.join(known, "cls", "left").withColumn("known", F.coalesce("known", "cls")))
        mixed = listed.groupBy("token").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo < hi").select("token")
        listed = cut(listed.join(mixed, "token"))
    short = listed.join(size, "cls")
    side = lambda table, k, *more: table.select(*(F.col(c).alias(f"{c}{k}") for c in ("cls", *more)))
    more = ("cls", "n", "longs", *(["known"] if near_links is not None else []))
    a, b = (short.select("token", *(F.col(c).alias(f"{c}{k}") for c in more)) for k in (1, 2))
    near = (F.col("cls1") < F.col("cls2")) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    if near_links is not None:
        near = near & (F.col("known1") != F.col("known2"))
    pairs = a.join(b, "token").where(near).groupBy("cls1", "cls2").agg(*(F.first(c).alias(c) for c in ("n1", "n2", "longs1", "longs2")), F.count("*").alias("c"))
    overlap = F.ceil(F.lit(percent) * (F.col("n1") + F.col("n2")) / (100 + percent) - 1e-9)
    left = overlap - F.ceil(percent * F.greatest("n1", "n2") / 100 - 1e-9) + 1
    pairs = pairs.where(F.col("c") + F.least("longs1", "longs2") >= left)
    pairs = pairs.join(side(sets, 1, "bits"), "cls1").join(side(sets, 2, "bits"), "cls2")
    lone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
    pairs = pairs.where((F.col("n1") - lone("bits1", "bits2") >= overlap) & (F.col("n2") - lone("bits2", "bits1") >= overlap))
    shared = pairs.select(F.col("cls1").alias("u"), F.col("cls2").alias("v")).union(met.where("long AND cls != low").select("low", "cls")).distinct()
    groups = components(shared)
    grouped = cut(sets.select("cls", "n").join(groups.withColumnRenamed("node", "cls"), "cls"))
    members = cut(_dealt(grouped, block_shingles, parts))
    last = members.groupBy("root").agg(F.max("block").alias("last"), F.count("*").alias("m_group")).where("last > 0")
    later = members.where("block > 0").withColumn("_k", F.row_number().over(Window.partitionBy("root", "block").orderBy(F.xxhash64("cls"))))
    bridges = later.where(F.col("_k") <= bridge).select("cls", "root", (F.col("block") - 1).alias("block"), "n")
    tasks = members.select("cls", "root", "block", "n").unionByName(bridges).select(F.xxhash64("root", "block").alias("task"), "cls", F.col("cls").alias("known"), "n")
    links = linked(cut(tasks))
    if near_links is not None:
        links = links.unionByName(near_links)
    # Groups of several blocks: their classes by what is linked so far, and which of these components is the group's largest.
    many = max(1000, grouped.count() // (4 * parts))
    wide = join_split(members, cut(last), ["root"], f"m_group > {many}").select("cls", "n", "root")
    so_far = components(links).select(F.col("node").alias("cls"), F.col("root").alias("known"))
    wide = cut(wide.join(so_far, "cls", "left").withColumn("known", F.coalesce("known", "cls")))
    mains = wide.groupBy("root", "known").agg(F.count("*").alias("m")).groupBy("root").agg(F.max_by("known", F.struct("m", "known")).alias("main"), F.sum("m").alias("m_group"))
    wide = cut(join_split(wide, cut(mains), ["root"], f"m_group > {many}").select("cls", "n", "root", "known", (F.col("known") == F.col("main")).alias("inside")))
    if not wide.where("NOT inside").isEmpty():
        sides = [cut(_dealt(wide.where(c).select("cls", "n", "root"), group_shingles, parts)).withColumn("inside", F.lit(c == "inside")) for c in ("NOT inside", "inside")]
        placed = sides[0].unionByName(sides[1])
        spans = cut(placed.groupBy("root", "inside", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")))
        span = lambda k: spans.select("root", *(F.col(c).alias(f"{c}{k}") for c in ("inside", "block", "least", "most")))
        fit = (100 * F.col("most1") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least1"))
        both = span(1).where("NOT inside1").join(span(2), "root").where(fit & (F.col("inside2") | (F.col("block1") <= F.col("block2"))))
        name = F.xxhash64("root", "block1", "inside2", "block2").alias("task")
        ends = both.select("root", name, F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"inside{k}").alias("inside"), F.col(f"block{k}").alias("block")) for k in (1, 2))))).alias("end")).select("root", "task", "end.*")
        again = placed.join(ends, ["root", "inside", "block"]).select("cls", "task", "n").join(wide.select("cls", "known"), "cls")
        links = links.unionByName(linked(cut(again)))
    joined = components(links).withColumnRenamed("node", "cls")
    # Components of classes, then of rows; roots and classes that hold very many are broadcast.
    classes = cut(rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).join(joined, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("m").alias("m_root"))
    many = max(1000, rows.count() // (4 * parts))
    smallest = cut(smallest)
    classes = cut(join_split(classes, smallest, ["root"], f"m_root > {many}").select("cls", "m", "component_id"))
    narrow = rows.select("doc_id", "n_shingles", "cls")
    placed = join_split(narrow.where("n_shingles > 0"), classes, ["cls"], f"m > {many}")
    single = narrow.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", "cls", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(single)
