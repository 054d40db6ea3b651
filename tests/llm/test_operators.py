import json
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from volumetra.llm import additive_search, automaton_dedup, binary_output, curriculum, exact_dedup, jaccard_join, pattern_packing, queries, repeats, suffix_dedup, token_counts, toxicity
from volumetra.llm.common import cut
from volumetra.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, _norm string, hits int"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def awkward(seed=3, many=60):
    """Nulls, empty, blank and long texts, copies, near copies, periodic texts, and columns with clashing names."""
    r = random.Random(seed)
    vocab = [f"w{k}é" if k % 9 == 0 else f"w{k}" for k in range(400)]
    passage = " ".join(r.choices(vocab, k=60))
    texts = [None, "", " \t\n", "a", "A", "one two three", "One two  three", "x" * 900, "ab " * 500, "ab " * 90, passage, passage.upper(), "tab\tnew\nline\x0bv\x0cf\rr  end ", "<|endoftext|> don't  stop 123 áé İ \x1c ß"]
    for _ in range(many):
        w = r.choices(vocab, k=r.randint(1, 300))
        texts.append(" ".join(w))
        if r.random() < 0.5:
            texts.append(" ".join(v if r.random() > 0.02 else "edit" for v in w))
        if r.random() < 0.3:
            k = r.randint(0, len(w))
            texts.append(" ".join(w[:k] + passage.split()[: r.randint(20, 60)] + w[k:]))
    texts.append(" ".join(r.choices(vocab, k=9000)))
    out = [(k, t, "en", None if k % 11 == 0 else f"s{k % 4}", len(t or ""), k, t, 1) for k, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module", params=["awkward", "small", "hot", "empty"])
def docs(request, spark, sf):
    if request.param == "small":
        return spark.read.parquet(f"{sf}/documents.parquet")
    rows = [] if request.param == "empty" else awkward()
    if request.param == "hot":
        r = random.Random(5)
        base = " ".join(f"v{r.randint(0, 300)}" for _ in range(120)).split()
        rows = [(k, " ".join(v if r.random() > 0.01 else f"e{k}" for v in base), "en", "src0", 1, k, "", 1) for k in range(80)]
        rows += [(100 + k, " ".join([f"p{k}{j}" for j in range(50)] + base[:60] + [f"q{k}{j}" for j in range(50)]), "en", "src0", 1, k, "", 1) for k in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("length,gram,chunk,hot", [(200, 80, 400_000, 1000), (41, 16, 400, 3), (40, 16, 1, 1000)])
def test_suffix_dedup(docs, length, gram, chunk, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_LEAST", hot)
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    got = suffix_dedup.dedup_passages(docs, length, gram, chunk)
    same([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, brute.sha(bytes(r.kept))) for r in got.collect()], brute.passages(plain(docs), length))


def test_blocks_of_long_texts(monkeypatch):
    texts = [t for _, t, *_ in awkward()]
    for kind, window, gram in ((repeats.Bytes, 40, 16), (repeats.Words, 6, 3)):
        found = []
        for most in (1 << 20, 150):
            monkeypatch.setattr(repeats, "SLICE_BYTES", most)
            rows = (zip(*(x.tolist() for x in part)) for part in repeats.text_blocks(kind, pa.array(texts), window, gram))
            found.append({(d, a + k, a + p, g) for part in rows for d, a, n, p, g in part for k in range(n)})
        assert found[0] == found[1] and len(found[0]) > 1000


def thue_morse(k, flip=0):
    return "".join("ab"[bin(i).count("1") + flip & 1] for i in range(k))


@pytest.mark.parametrize("size", [1024, 4096])
def test_long_words_that_fool_power_sums(spark, size):
    words = [thue_morse(size, flip) for flip in (0, 1)]
    docs = spark.createDataFrame([(k, f"w x y z {words[k % 2]}") for k in range(3)] + [(10 + k, " ".join([*(f"v{j}" for j in range(34)), w, w[::-1] + w[:7]])) for k, w in enumerate(words)], "doc_id long, text string")
    same(rows_of(jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")), brute.jaccard(plain(docs)))
    got = automaton_dedup.dedup_word_windows(docs)
    same([(r.doc_id, r.n_words, r.n_removed, brute.sha(bytes(r.kept))) for r in got.collect()], brute.word_windows(plain(docs), 35))


@pytest.mark.parametrize("window,gram,chunk,hot", [(35, 15, 50_000, 1000), (6, 3, 60, 3), (6, 3, 1, 1000)])
def test_automaton_dedup(docs, window, gram, chunk, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_LEAST", hot)
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    got = automaton_dedup.dedup_word_windows(docs, window, gram, chunk)
    same([(r.doc_id, r.n_words, r.n_removed, brute.sha(bytes(r.kept))) for r in got.collect()], brute.word_windows(plain(docs), window))


def test_null_ids_and_equal_rows(spark):
    text = "some words that repeat " * 30
    df = spark.createDataFrame([(None, text), (None, text), (1, "alone"), (1, "alone")], "doc_id long, text string")
    got = suffix_dedup.dedup_passages(df).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(5, 0), (5, 0), (690, 690), (690, 690)]
    same(rows_of(exact_dedup.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept")), [(None, None, 2, True), (None, None, 2, False), (1, 1, 2, True), (1, 1, 2, False)])
    assert exact_dedup.drop_exact_duplicates(df).count() == 2
    assert jaccard_join.jaccard_components(df).count() == 4


@pytest.mark.parametrize("group,block,bridge,most,short,bits", [(4_000_000, 4_000_000, 8, 2_000_000, 64, 64), (300, 150, 2, 0, 64, 5), (300, 300, 8, 0, 3, 64), (100, 60, 0, 2_000_000, 3, 64)])
def test_jaccard(docs, group, block, bridge, most, short, bits):
    got = jaccard_join.jaccard_components(docs, group_shingles=group, block_shingles=block, bridge=bridge, broadcast_rows=most, short_list=short, bits=bits)
    same(rows_of(got.select("doc_id", "n_shingles", "component_id")), brute.jaccard(plain(docs)))


def pair_rows(spark, docs, monkeypatch, **how):
    """Components of docs, and the candidate pairs that the search put into groups."""
    edges, real = [], jaccard_join.components
    with monkeypatch.context() as m:
        m.setattr(jaccard_join, "components", lambda e: edges.append(e) or real(e))
        got = rows_of(jaccard_join.jaccard_components(docs, **how).select("doc_id", "n_shingles", "component_id"))
    return got, [e.count() for e in edges]


def test_jaccard_of_many_near_copies_makes_no_pair_for_each_two_of_them(spark, monkeypatch):
    r = random.Random(8)
    bases = [[f"w{r.randrange(5000)}" for _ in range(80)] for _ in range(6)]
    for n in (20, 40):
        rows = [(100 * b + k, " ".join([*base, "copy", str(k)])) for b, base in enumerate(bases) for k in range(n)]
        rows += [(1000 + k, " ".join(base[:60] + [f"v{r.randrange(5000)}" for _ in range(20)])) for k, base in enumerate(bases)]
        got, edges = pair_rows(spark, spark.createDataFrame(rows, "doc_id long, text string"), monkeypatch, most_pairs=5)
        same(got, brute.jaccard(rows))
        assert len(edges) == 4 and edges[1] < 6 * n  # links of near copies first, then pairs: before, 6 * n * (n - 1) / 2


def test_jaccard_reads_one_text_of_each_set(spark):
    rows = [(k, f"a b c d e f g h {k % 5}") for k in range(60)] + [(3, "a b c d e f g h 3"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(rows_of(jaccard_join.jaccard_components(docs, copied_sets=2).select("doc_id", "n_shingles", "component_id")), brute.jaccard(rows))
    names, batch = jaccard_join.Classes(64), pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in rows])
    ones = {r["cls"] for r in pa.Table.from_batches(jaccard_join._sets(5, names, spark.sparkContext.broadcast({}))([batch])).to_pylist()}
    kept = spark.sparkContext.broadcast({c: k for c in ones for k in range(5) if names.name(next(jaccard_join.shingle_sets(*jaccard_join.utf8(batch["text"][k : k + 1]), 5))[0]) == c})
    assert len(ones) == len(kept.value) == 5
    sent = pa.Table.from_batches(jaccard_join._sets(5, names, kept)([batch])).to_pylist()
    assert len(sent) == 6 and {r["cls"] for r in sent} == ones  # 5 sets, and a row that has the same id and text as another


def test_jaccard_order_comes_from_counts_and_no_text_reaches_the_driver(spark, monkeypatch):
    texts = ["A b c d e f g", "a b c d e f g", "x a b c d e f", "y z a b c d e f", "q a b c d e", "one", None, "", "k l m n o p", "k l m n o p q"]
    rows = [(d, t) for d, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taken, orders, real = [], [], jaccard_join.Order.__init__
    with monkeypatch.context() as m:
        m.setattr(jaccard_join.Order, "__init__", lambda own, *given: taken.append(given) or orders.append(own) or real(own, *given))
        same(rows_of(jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")), brute.jaccard(rows))
    assert all(a.dtype.kind in "iu" for a in taken[0])  # counts
    sets, words = Counter(), Counter()
    named = lambda t: [(s, h) for s, h, _ in jaccard_join.shingle_sets(*jaccard_join.utf8(pa.array([t])), 5)]
    for s in {named(t)[0][0].tobytes() for t in texts}:
        sets.update(np.frombuffer(s, np.uint64).tolist())
    for t in texts:
        words.update((named(t)[0][1] >> np.uint64(64 - jaccard_join.TABLE_BITS)).tolist())
    often = sorted(s for s, n in sets.items() if n >= 3)
    assert often and orders[0].frequent.tolist() == often
    assert {k: v for k, v in enumerate(orders[0].table.tolist()) if v} == {k: int(np.log2(1 + n)) for k, n in words.items() if n}


def test_jaccard_sample_grows_so_that_passages_make_no_large_group(spark, monkeypatch):
    # Each passage stands in one of 20 texts, too seldom for a sample of fixed size; rare words would put it into the prefixes.
    r = random.Random(9)
    passages = [[f"p{k}-{i}" for i in range(9)] for k in range(20)]
    rows = [(k, " ".join([f"v{r.randrange(400)}" for _ in range(60)] + r.choice(passages))) for k in range(600)]
    rows += [(600 + k, rows[k][1] + " end") for k in range(0, 600, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, n in (("SAMPLE_DOCS", 16), ("SAMPLE_EVERY", 3)):
        monkeypatch.setattr(jaccard_join, name, n, raising=False)
    got, edges = pair_rows(spark, docs, monkeypatch, short_list=12)
    same(got, brute.jaccard(rows))
    assert edges[0] < 100  # near copies, of which there are 20; with a sample of 16 texts, a link for most texts


def test_jaccard_order_holds_no_more_shingles_than_it_may(spark):
    texts = spark.createDataFrame([(f"a b c d e f g {k}" if k < 9 else f"h i j k l m {k}",) for k in range(14)], "text string")
    assert [len(jaccard_join.sampled_order(texts, 5, 2, most).frequent) for most in (9, 4, 3, 2)] == [5, 4, 3, 2]


def test_jaccard_links_in_rounds(spark, monkeypatch):
    # Most of every text is one passage, so all are one group; its blocks meet each other and hold each text several times.
    rows = [(k, " ".join([f"p{i}" for i in range(12)] + [f"u{k % 50}-{i}" for i in range(2)] + ["end"] * (k % 3))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, rounds, real = brute.jaccard(rows), [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda percent: rounds.append(1) or real(percent))
    for most, at_once, jobs in ((2_000_000, 20_000_000, {2}), (0, 1, range(5, 40))):
        rounds.clear()
        got = jaccard_join.jaccard_components(docs, group_shingles=200, block_shingles=150, bridge=2, short_list=4, broadcast_rows=most, round_shingles=at_once)
        same(rows_of(got.select("doc_id", "n_shingles", "component_id")), want)
        assert len(rounds) in jobs


def test_cut_leaves_no_mark(spark):
    at = cut(spark.range(5))
    assert at.count() == 5 and not [f for f in os.listdir(at._cut_path.removeprefix("file:")) if "_SUCCESS" in f]


def test_jaccard_of_one_large_group(spark):
    # All share a passage, so they are one group; it holds a chain of near copies, families of their own and lone texts.
    r, rows, chain = random.Random(6), [], [f"c{k}" for k in range(60)]
    passage = [f"p{k}" for k in range(8)]
    for k in range(40):
        rows.append((k, " ".join(passage + chain)))
        chain[r.randrange(60)] = f"x{k}"
    for k in range(40, 70):
        family = k % 6
        rows.append((k, " ".join(passage + [f"f{family}-{i}" for i in range(20 + 9 * family)] + [f"t{k}"] * (k % 2))))
    rows += [(k, " ".join(passage + [f"u{k}-{i}" for i in range(k - 60)])) for k in range(70, 110)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.jaccard(rows)
    for group, block, bridge in ((400, 200, 2), (5000, 150, 1), (150, 100, 0)):
        got = jaccard_join.jaccard_components(docs, group_shingles=group, block_shingles=block, bridge=bridge, short_list=4)
        same(rows_of(got.select("doc_id", "n_shingles", "component_id")), want)


def test_divide_skip():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(120)]
    root = jaccard_join.divide_skip(sets, 50)
    want = list(range(120))
    for a in range(120):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 50 * (len(sets[a]) + len(sets[b]) - i):
                x, y = want[a], want[b]
                want = [x if v == y else v for v in want]
    pairs = {(root[a] == root[b], want[a] == want[b]) for a in range(120) for b in range(a)}
    assert pairs <= {(True, True), (False, False)}
    # Sets known to be linked stay so, and the rest comes out as before.
    again = jaccard_join.divide_skip(sets, 50, [want[k] if k % 3 else 1000 + k for k in range(120)])
    assert {(again[a] == again[b], want[a] == want[b]) for a in range(120) for b in range(a)} <= {(True, True), (False, False)}


@pytest.mark.parametrize("rows", [256, 1])
def test_exact(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_ROWS", rows)
    many = [(1000 + k % 90, "A hot text", "en", "s", 10, k, "", 1) for k in range(100)] + [(None, "a Hot text", "en", "s", 10, 1, "", 1)]
    docs = docs.union(spark.createDataFrame(many if docs.head(1) else [], SCHEMA).select(docs.columns))
    want = brute.exact(plain(docs))
    same(rows_of(exact_dedup.exact_duplicates(docs)), want)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()], [w[0] for w in want if w[3]])


def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for d, text in plain(docs):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((d, len((text or "").encode()), n, n > 512))
    same(rows_of(token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"))), want)


def _ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return {d: t.encode(text or "", add_special_tokens=False).ids + [1] for d, text in plain(docs)}


def test_packing(docs):
    want, got = _ids(docs), pattern_packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"))
    places, found = defaultdict(list), Counter()
    for r in got.collect():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.start == 4096 * r.piece and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        found[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert found == {d: len(i) for d, i in want.items()}
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
    if want:
        total = sum(map(len, want.values()))
        assert len(places) <= 1.01 * total / 4096 + 2


def test_plan_places_all_and_is_tight():
    r = np.random.default_rng(2)
    lengths = np.clip(r.lognormal(6.5, 1.1, 40_000).astype(int), 1, 4096)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    out, used = pattern_packing.plan(histogram), Counter()
    for n, slots in out:
        assert sum(a * k for a, k in slots) <= 4096
        for a, k in slots:
            used[a] += n * k
    assert used == histogram
    assert sum(n for n, _ in out) <= 1.01 * lengths.sum() / 4096 + 1
    assert len(out) < 3 * 4096


@pytest.mark.parametrize("broadcast_rows", [0, binary_output.BROADCAST_ROWS])
def test_matrices(docs, broadcast_rows):
    want, got = _ids(docs), defaultdict(dict)
    rows = binary_output.packed_matrices(docs.repartition(5), tokenizer_path("word_bpe_49k.json"), broadcast_rows=broadcast_rows).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 4096 and r.cu_seqlens[-1] == r.n_tokens
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            got[d][p] = ids[a:b].tolist()
            assert places[a:b].tolist() == list(range(b - a))
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in got.items()} == want


def test_matrices_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a few words"), (1, "a few words"), (None, None)], "doc_id long, text string")
    made = binary_output.packed_matrices(docs, tokenizer_path("word_bpe_49k.json"), 16, kind="<u4")
    binary_output.write_matrices(made, str(tmp_path / "m"))
    row = spark.read.schema(made.schema).parquet(str(tmp_path / "m")).first()
    ids = np.frombuffer(row.input_ids, "<u4")
    assert len(ids) == 16 and row.n_tokens == 9 and row.cu_seqlens == [0, 4, 8, 9] and row.doc_ids == [1, 1, None] and ids[8] == 1
    assert np.frombuffer(row.position_ids, "<u4").tolist() == [0, 1, 2, 3] * 2 + [0] * 8


def test_matrices_pack_sorted_runs_as_one(spark):
    # Runs of long and of medium documents, each in batches of its own: only across runs do they fill sequences.
    texts = [" ".join(["the"] * n) for n in [2500 + k % 97 for k in range(60)] + [1300 + k % 89 for k in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(2, "doc_id").cache()
    lengths = np.array([len(i) for _, i in sorted(_ids(docs).items())])
    rows = binary_output.packed_matrices(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert len(rows) == len(binary_output.best_fit_decreasing(lengths, 4096)) == 60
    assert sorted(d for r in rows for d in r.doc_ids) == list(range(120))


def test_best_fit_decreasing_runs():
    r = random.Random(4)
    for capacity, most, many in ((50, 50, 400), (50, 9, 400), (4096, 4096, 3000), (7, 7, 1)):
        lengths = [r.randint(1, most) for _ in range(many)]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = min((x for x in rooms if x >= n), default=capacity)
            if fit in rooms:
                rooms.remove(fit)
            rooms.append(fit - n)
        got = binary_output.best_fit_decreasing(np.array(lengths), capacity)
        assert sorted(k for x in got for k in x) == list(range(many))
        assert sorted(capacity - sum(lengths[k] for k in x) for x in got) == sorted(rooms)


def test_best_fit_decreasing():
    r = random.Random(1)
    lengths = [r.randint(1, 50) for _ in range(300)]
    rooms, want = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(50 - n)
    assert len(binary_output.best_fit_decreasing(np.array(lengths), 50)) == len(rooms)


def test_curriculum(docs):
    rows = curriculum.curriculum(docs).collect()
    texts = {d: len(brute.WORD.findall(t or "")) for d, t in plain(docs)}
    assert {r.doc_id: r["size"] for r in rows} == texts
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 2 * r["size"] and r.taken == sum(p.words for p in r.placements)
        assert all(0 <= p.position <= 1 for p in r.placements)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    free, left, want = set(names), 1.5 * sum(size.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
        free -= over
    for s in names:
        assert abs(target[s] - want[s]) < 1e-5 and abs(taken[s] - want[s]) <= 1
    order = curriculum.training_order(docs)
    assert order.columns == docs.columns
    read = Counter()
    for r in order.select("source", "text").collect():
        read[r.source] += len(brute.WORD.findall(r.text))
    longest = Counter()
    for r in docs.select("source", "text").collect():
        longest[r.source] = max(longest[r.source], len(brute.WORD.findall(r.text or "")))
    assert all(abs(read[s] - target[s]) <= longest[s] / 2 + 1 for s in names)
    assert {r.text for r in order.select("text").collect()} <= {t for _, t in plain(docs)}


def test_curriculum_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(k, "w " * 10, f"s{k % 3}") for k in range(3000)], "doc_id long, text string, source string")
    at = {(r.doc_id % 3): [] for r in docs.collect()}
    for r in curriculum.curriculum(docs).collect():
        at[r.doc_id % 3] += [p.position for p in r.placements]
    grid = np.linspace(0, 1, 21)
    for s, (a, _, b) in enumerate(curriculum.SCHEDULES):
        demand = a * grid + (b - a) * grid**2 / 2
        assert np.abs(np.searchsorted(np.sort(at[s]), grid) / len(at[s]) - demand).max() < 0.01


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    own = [(got[d].score, t) for d, t in truth.items() if got[d].held_out]
    pos, neg = [s for s, t in own if t], [s for s, t in own if not t]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert auc > 0.75
    assert np.mean([(s >= 0.5) == t for s, t in own]) > 0.85


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.clean(docs, model).columns == docs.columns


def test_search(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    nan = float("nan")
    extra = [(1000, None), (1050, [0.0] * 64), (1100, [nan] * 64), (1150, [None] * 64), (1200, []), (1201, [1.0] * 64), (1202, [1.0] * 64), (1250, [2.0] * 64)]
    table = table.select("vec_id", "embedding").union(spark.createDataFrame(extra, "vec_id long, embedding array<float>"))
    index, books = additive_search.build_index(table)
    got = defaultdict(list)
    for r in sorted(additive_search.search(index, books, index.where("vec_id % 50 = 0"), 5, block=3, part=200).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    hit = n = 0
    for q, v in rows:
        if q % 50 == 0:
            want = sorted(((-float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), i) for i, u in rows if i != q))[:5]
            assert [k for k, _ in got[q]] and len(got[q]) == 5
            hit += len({i for _, i in want} & {i for i, _ in got[q]})
            n += 5
            for (i, s) in got[q]:
                assert abs(s - next(-w for w in [-float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)) for k, u in rows if k == i])) < 1e-12
    assert hit / n >= 0.9
    assert [i for i, _ in got[1250]][:2] == [1201, 1202]
    empty, none = additive_search.build_index(table.limit(0))
    assert additive_search.search(empty, none, empty, 5).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, sf)
        if k < 4:
            assert out.columns == docs.columns, name
            seen.append([(r.doc_id, r.text) for r in out.collect()])
    first, exact, near, mixed = seen
    same(exact, [(d, texts[d]) for d in {w[1] for w in brute.exact(first)}])
    same([d for d, _ in near], sorted({c for _, _, c in brute.jaccard(exact)}))
    assert {d for d, _ in mixed} <= {d for d, _ in near}
    packed = out.collect()
    assert {r.doc_id for r in packed} == {d for d, _ in mixed}
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_search_repeated_queries(spark):
    r = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(r.normal(size=(40, 8)))]
    table = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>")
    index, books = additive_search.build_index(table)
    got = rows_of(additive_search.search(index, books, index.where("vec_id = 0"), 5))
    x = np.array([v for _, v in rows])
    cosine = x @ x[0] / np.linalg.norm(x, axis=1)
    want = [(rank, int(k)) for rank, k in enumerate([0, *np.argsort(-cosine)[1:5]], 1)]  # the other row with its id comes first
    same([(rank, k) for _, rank, k, _ in got], want * 2)


def test_cosines_of_tiny_and_huge_vectors(spark):
    """Scores hold however small or large a vector's components are, down to subnormal and up to the largest doubles."""
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 8))
    scales = np.ones(60)
    scales[[3, 7, 50]], scales[[4, 8]], scales[[5]] = 1e-200, 1e200, 1e300
    rows = [(k, (v * s).tolist()) for k, (v, s) in enumerate(zip(x, scales))]
    table = spark.createDataFrame([*rows, (60, [5e-324, 0.0] * 4), (61, [1.7e308] * 8)], "vec_id long, embedding array<double>")
    index, books = additive_search.build_index(table)
    got = defaultdict(list)
    for r in additive_search.search(index, books, index.where("vec_id % 50 = 0 OR vec_id IN (3, 4, 60, 61)"), 5).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.vstack([x, [1.0, 0.0] * 4, np.ones(8)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == {0, 3, 4, 50, 60, 61}
    for q, own in got.items():
        s = u @ u[q]
        s[q] = -9
        want = np.argsort(-s, kind="stable")[:5]
        assert [k for k, _ in own] == want.tolist() and np.allclose([v for _, v in own], s[want], rtol=0, atol=1e-12)


def test_near_copies_go_by_row(spark):
    import corpus_pipeline

    words = lambda k, n=60: [f"{k}w{j}" for j in range(n)]
    near = lambda k, *edits: " ".join([*words(k), *edits])
    rows = [(3, near("a")), (5, near("a", "x")), (5, near("b")), (7, near("c")), (7, near("c", "y")), (None, near("d")), (None, near("d", "z")), (None, ""), (None, ""), (9, near("d", "q"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    got = rows_of(got)
    assert {(3, near("a")), (5, near("b")), (9, near("d", "q"))} <= set(got) and got.count((None, "")) == 2
    assert len([d for d, _ in got if d == 7]) == 1 and len(got) == 6


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        same(rows_of(got.select(*want.columns)), want.fetchall())


def test_recall_on_50000_rows(spark):
    """In the query's own settings, on copies of the real vectors moved by noise (50,000 rows, more than one part)."""
    r = np.random.default_rng(8)
    base = np.array([x.embedding for x in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("embedding is not null").collect()], float)
    x = np.repeat(base, -(-50_000 // len(base)), 0)[:50_000]
    x = x + r.normal(size=x.shape) * 0.5 * np.abs(base).mean()
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": column})).repartition(4)
    index, books = additive_search.build_index(table)
    got = additive_search.search(index, books, index.where("vec_id % 500 = 0"), 5).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, own in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        hit += (own["score"] >= np.sort(s)[-5] - 1e-12).sum()
    assert got["query_id"].nunique() == 100 and hit / 500 >= 0.9


def test_order_reaches_the_packed_rows(spark, tmp_path):
    words = [" ".join(f"t{k}x{j}" for j in range(30 + k % 7)) for k in range(400)]
    docs = spark.createDataFrame([(k, t, f"s{k % 3}") for k, t in enumerate(words)], "doc_id long, text string, source string")
    curriculum.training_order(docs).write.parquet(str(tmp_path / "mix"))
    mixed = spark.read.parquet(str(tmp_path / "mix"))
    position = {}
    for r in curriculum.curriculum(docs, whole=True).collect():
        position[r.doc_id] = sorted(p.position for p in r.placements)
    placed = curriculum.with_place(mixed)
    got = defaultdict(list)
    for r in placed.collect():
        got[r.doc_id].append(r.place)
    assert {d: len(p) for d, p in got.items()} == {d: len(p) for d, p in position.items() if p}
    pairs = sorted((p, q) for d in got for p, q in zip(position[d], sorted(got[d])))
    assert all(a[1] < b[1] for a, b in zip(pairs, pairs[1:]) if a[0] < b[0])
    out = pattern_packing.packed_documents(placed, tokenizer_path("word_bpe_49k.json"), place="place").collect()
    assert sorted((r.doc_id, r.place) for r in out if r.piece == 0) == sorted((d, p) for d, x in got.items() for p in x)
    of = defaultdict(list)
    for r in out:
        of[r.sequence_id].append(r.place)
    assert all(abs(r.sequence_place - np.mean(of[r.sequence_id])) < 1e-9 for r in out)


AWKWARD = [(None, "same text here", "a"), (None, "same text here", "a"), (4, None, None), (4, None, None), (5, "", "b"), (6, "One two", "b"), (6, "one TWO", "b"), (7, "w " * 30_000, "c")]


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_null_ids_repeats_and_clashing_columns(spark, rows):
    """The operators that the tables above do not show null and repeated ids."""
    schema = "doc_id long, text string, source string, size long, piece int, length long, _h long, place double, row long, n_bytes long"
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, 0.5, 1, 1) for r in rows], schema).repartition(3)
    tokenizer = tokenizer_path("word_bpe_49k.json")
    count = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    want = Counter(d for d, *_ in rows)
    assert count(curriculum.curriculum(docs)) == want
    mixed = curriculum.training_order(docs)
    assert mixed.columns == docs.columns and not rows or mixed.where("text is null or text = ''").isEmpty()
    pieces = pattern_packing.packed_documents(docs, tokenizer)
    assert count(pieces.where("piece = 0")) == want
    assert sum((Counter(r.doc_ids) for r in binary_output.packed_matrices(docs, tokenizer).collect()), Counter()) == count(pieces)
    counted = token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"))
    assert count(counted) == want and all(r.n_bytes == 60_000 and r.n_tokens > 30_000 for r in counted.where("doc_id = 7").collect())
    model = toxicity.train(docs, spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1)], "doc_id long, toxic int"))
    assert count(toxicity.score(docs, model)) == want and toxicity.clean(docs, model).columns == docs.columns
    assert count(jaccard_join.jaccard_components(docs)) == want
    table = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("embedding"), F.lit(1).alias("row"), F.lit(1).alias("norm"))
    index, books = additive_search.build_index(table)
    got = additive_search.search(index, books, index, 3)
    assert got.count() == (6 * 3 if rows else 0)


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_stages_on_awkward_tables(spark, sf, rows):
    import corpus_pipeline

    schema = "doc_id long, text string, source string, _row long, _hash long, _norm string, _sha string, hits int, row int, place double"
    docs = spark.createDataFrame([(*r, 1, 1, "", "", 1, 1, 0.5) for r in rows], schema).repartition(3)
    out, sizes = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        out = stage(spark, out, sf)
        sizes.append(out.count())
        assert k == 5 or out.columns == docs.columns, name
    if rows:  # the toxic model keeps plain words; copies of a null text, a repeated id and repeated words go
        assert sizes[:2] == [8, 4] and sizes[2] == 4
    else:
        assert sizes == [0] * 5
