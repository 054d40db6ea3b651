"""Dual-tree clustering, SimHash components and the filter audit against plain Python versions."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.brute import FOLD, WORD, exact, sha
from tests.llm.test_operators import SCHEMA, awkward, plain, rows_of, same
from volumetra.llm import curriculum, dual_tree, exact_dedup, filter_audit, simhash, toxicity
from volumetra.llm.common import byte_slices, utf8

# --- clusters ---------------------------------------------------------------------------------


def lloyd(rows, dimensions, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and abs(x) <= 131072 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c)) for _, v in kept]
        if n < rounds:
            for c in set(own):
                mine = [v for o, (_, v) in zip(own, kept) if o == c]
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [square(v, centroids[o]) for o, (_, v) in zip(own, kept)]
    inertia = Counter()
    for o, x in zip(own, d):
        inertia[o] += x
    return [(i, o, x, inertia[o], sum(d), sha(",".join(map(str, centroids[o])).encode())) for (i, _), o, x in zip(kept, own, d)]


@pytest.mark.parametrize("block,leaf,k", [(2048, 8, 8), (7, 1, 5), (1, 1, 300)])
def test_clusters(spark, block, leaf, k):
    r, nan = np.random.default_rng(2), float("nan")
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 3)) + 3 * r.integers(0, 3, (60, 1)))]
    rows += [(i, [0.5, -0.5, 0.25]) for i in range(60, 90)] + [(None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (5, [1.0, 1.0, -1.0]), (5, [-131072.0, 131072.0, 4.0])]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [nan, 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1e30, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(3)
    got = dual_tree.clusters(table, dimensions=3, k=k, rounds=4, block=block, leaf=leaf)
    same(rows_of(got), lloyd(rows, 3, k, 4))
    assert dual_tree.clusters(table.limit(0), dimensions=3).schema == got.schema and dual_tree.clusters(table.limit(0)).count() == 0


def test_trees_cover_and_prune():
    r = np.random.default_rng(1)
    for trial in range(60):
        n, d, k, far = r.integers(1, 200), r.integers(1, 5), r.integers(1, 12), 1 << (24 if trial % 3 == 0 else 0)
        x, c = r.integers(-6, 6, (n, d)) * far, r.integers(-6, 6, (k, d)) * far
        tree = dual_tree.cover_tree(x, int(r.integers(1, 6)))
        assert sorted(tree.order) == list(range(n))
        x = x[tree.order]
        for q, children in enumerate(tree.children):
            own = x[tree.first[q] : tree.end[q]]
            assert np.sqrt(((own - x[tree.centre[q]]) ** 2).sum(1)).max() <= tree.radius[q] * (1 + 1e-12)
            if children:
                heads = x[tree.centre[tree.child[q] : tree.child[q] + children]]
                gaps = ((heads[:, None] - heads) ** 2).sum(2) + np.eye(children) * 1e30
                assert (heads[0] == x[tree.centre[q]]).all() and np.sqrt(gaps.min()) > tree.radius[q] / 2 * (1 - 1e-12)
        got, _ = dual_tree.nearest(tree, x, c)
        assert (got == ((x[:, None] - c) ** 2).sum(2).argmin(1)).all()
    # Close groups far from each other: whole nodes are settled, and almost nothing is compared one by one.
    centres = r.integers(-10_000, 10_000, (8, 16))
    x = np.repeat(centres, 250, 0) + r.integers(-20, 20, (2000, 16))
    tree = dual_tree.cover_tree(x, 8)
    assert dual_tree.nearest(tree, x[tree.order], centres)[1] < 2000


# --- fingerprints -----------------------------------------------------------------------------


def print_of(text):
    w = WORD.findall((text or "").translate(FOLD))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(ids, prints, distance):
    """The smallest id of each row's component; nulls are larger than all others."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    p = np.array(prints, np.uint64)
    for k in range(len(p)):
        for o in np.flatnonzero(np.bitwise_count(p[:k] ^ p[k]) <= distance).tolist():
            root[find(k)] = find(o)
    low = defaultdict(list)
    for k, d in enumerate(ids):
        low[find(k)].append(d)
    least = {c: min((d for d in x if d is not None), default=None) for c, x in low.items()}
    return [least[find(k)] for k in range(len(p))]


def test_fingerprints_of_many_texts(monkeypatch):
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abcdefgäÜZ", k=r.randint(1, 14))) for _ in range(r.randint(0, 60))) for _ in range(200)]
    texts += [None, "", " \t", "A b", "x" * 5000, "a " * 500, " lead  and\ttrail "]
    want = [print_of(t) for t in texts]
    data, bounds = utf8(pa.array(texts))
    for many in (100_000, 7):
        monkeypatch.setattr(simhash, "TOGETHER", many)
        assert simhash.fingerprints(data, bounds).tolist() == want
    got = [simhash.fingerprints(data[bounds[k] : bounds[e]], bounds[k : e + 1] - bounds[k]) for k, e in byte_slices(bounds, 300)]
    assert np.concatenate(got).tolist() == want
    edges = np.cumsum([0, *range(1, 70)])
    noise = np.random.default_rng(1).integers(0, 256, edges[-1]).astype(np.uint8)
    assert simhash.xxh64(noise, edges[:-1], edges[1:]).tolist() == [xxhash.xxh64_intdigest(noise[a:b], 42) for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_simhash_of_documents(spark, kind):
    rows = awkward() if kind == "awkward" else []
    rows += [(None, t, *rest) for _, t, *rest in rows[:14]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("print", F.lit(1)).repartition(3)
    prints = [print_of(t) for _, t in plain(docs)]
    want = near([d for d, _ in plain(docs)], prints, 3)
    same(rows_of(simhash.simhash_components(docs)), [(d, f"{p:016x}", c) for (d, _), p, c in zip(plain(docs), prints, want)])


@pytest.mark.parametrize("distance,group,key_cost,few", [(3, 8192, 50, 24), (3, 20, 50, 2), (3, 20, 0, 24), (2, 30, 0, 1), (1, 20, 50, 24), (0, 20, 50, 24), (4, 40, 0, 5)])
def test_components_of_given_prints(spark, monkeypatch, distance, group, key_cost, few):
    """Dense balls of fingerprints, chains and noise, in groups that one task compares and in groups that it may not."""
    monkeypatch.setattr(simhash, "KEY_COST", key_cost)
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(4)
    change = lambda p, n: p ^ sum(1 << b for b in r.sample(range(64), n))
    heart, prints = r.getrandbits(64), [0, 0, (1 << 64) - 1]
    prints += [change(heart, r.randint(0, 4)) for _ in range(150)] + [heart] * 20
    for _ in range(40):
        prints.append(change(prints[-1], r.randint(1, 4)))
    prints += [change(heart, 6) for _ in range(20)] + [r.getrandbits(64) for _ in range(60)]
    ids = [None if k % 17 == 0 else r.randint(0, 300) for k in range(len(prints))]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    given = spark.createDataFrame([(i, str(p)) for i, p in zip(ids, signed)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "_fingerprinted", lambda words: lambda batches: (pa.RecordBatch.from_arrays([b["doc_id"], b["text"].cast(pa.int64())], ["doc_id", "print"]) for b in batches))
    got = simhash.simhash_components(given, distance=distance, group=group)
    same(rows_of(got), [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, near(ids, prints, distance))])


def test_thresholds_add_up():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 500).astype(np.uint64)
    base |= np.uint64(0xFFFF)  # sixteen bits that say nothing
    bits = simhash.bits_of(base)
    for nodes in (10, 10**5, 10**10):
        for distance in (0, 1, 2, 3, 5):
            plan = simhash.allocated(bits, nodes, distance)
            parts = next(m for m in range(2, distance + 3) if all(p in simhash.correlated_parts(bits, m) for p, _ in plan))
            assert sum(t + 1 for _, t in plan) == distance + 1 and len(plan) <= parts
    plan = simhash.allocated(bits, 10**5)
    assert all(len(set(p) & set(range(16))) < len(p) for p, _ in plan)  # the dead bits are no partition that is looked at


# --- filters ----------------------------------------------------------------------------------


def audit(rows, labels):
    """Rows of doc_id, text and lang; labels of doc_id, quality and toxic."""
    smallest, known = {}, defaultdict(lambda: [False, False])
    for d, t, _ in rows:
        t = t or ""
        smallest[t] = min(smallest.get(t, (True, 0)), (d is None, d or 0))
    for d, q, x in labels:
        if d is not None:
            known[d] = [known[d][0] or q == 1, known[d][1] or x == 1]
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": (d is None, d or 0) > smallest[t]}
        docs.append((lang or "", {f for f, x in fails.items() if x}, *(known[d] if d is not None else (False, False))))
    out, shapley = [], Counter()
    for part in {p for p, *_ in docs}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                own, gone = [x for x in docs if x[0] == part], set(order[: step - 1])
                removed = [x for x in own if f in x[1] and not x[1] & gone]
                shapley[part, f] += len(removed)
                out.append((part, order, step, sum(not x[1] & set(order[:step]) for x in own), len(removed), sum(f in x[1] and bool(x[1] & gone) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)))
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


@pytest.mark.parametrize("least", [256, 1])
@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_filter_audit(spark, monkeypatch, kind, least):
    monkeypatch.setattr(filter_audit, "LEAST_ROWS", least)
    rows, r = [], random.Random(6)
    if kind == "awkward":
        rows = [(d, t, (None, "", "en", "de")[k % 4]) for k, (d, t, *_) in enumerate(awkward(many=15))]
        rows += [(d, t, lang) for d, t, lang in rows[::3]] + [(None, t, lang) for _, t, lang in rows[::5]] + [(500 + k % 30, t, "de") for k, (_, t, _) in enumerate(rows[::2])]
        rows += [(k % 40, "the SAME hot text", "en") for k in range(90)] + [(None, "hot | too", "en")] * 40
        rows += [(700 + k, " ".join(f"{r.choice('abcDE')}{r.randint(0, n)}" for _ in range(260)) + end, "fr") for k, (n, end) in enumerate([(5, ""), (900, ""), (900, " %"), (40, " $ é")])]
    labels = [(d, r.choice((0, 1, None)), r.choice((0, 1, None))) for d, *_ in rows if r.random() < 0.6] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, 1, 1) for x in rows], "doc_id long, text string, lang string, part int, mask int, n int").repartition(4)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    same(rows_of(got), audit(rows, labels))


# --- very long texts, and many rows without an id ----------------------------------------------


def test_very_long_texts_and_many_null_ids(spark):
    """Texts of a megabyte, one of them a single word, copies of them, and a hot text whose rows have no id."""
    r = random.Random(8)
    long = " ".join(f"W{r.randint(0, 30_000)}é" for _ in range(120_000))
    rows = [(1, long, "en"), (2, long.lower(), "en"), (3, long, None), (4, "x" * 1_000_000, "de"), (5, "\t" * 300_000, "de"), (6, "short one", "de")]
    rows += [(None, "a hot text without ids", "fr")] * 700 + [(7, "a hot text without ids", "fr")]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, source string").repartition(4)
    pairs = [(d, t) for d, t, _ in rows]
    prints = {t: print_of(t) for _, t in pairs}
    want = near([d for d, _ in pairs], [prints[t] for _, t in pairs], 3)
    same(rows_of(simhash.simhash_components(docs)), [(d, f"{prints[t]:016x}", c) for (d, t), c in zip(pairs, want)])
    same(rows_of(filter_audit.filter_audit(docs, spark.createDataFrame([(1, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int"))), audit(rows, [(1, 1, 0), (6, 0, 1)]))
    same(rows_of(exact_dedup.exact_duplicates(docs)), exact(pairs))
    got = {(x.doc_id, x["size"]) for x in curriculum.curriculum(docs).collect()}
    assert got == {(d, len(WORD.findall(t))) for d, t in pairs}
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 0), (4, 1), (6, 0)], "doc_id long, toxic int"))
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= x.score <= 1 for x in scored)
