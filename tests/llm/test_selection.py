"""Best-fit packing, whitening and importance resampling against brute-force versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bestfit, importance, whitening
from tests.llm import corpus

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    """By trying every open sequence, and a new one, for each item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def counted(items):
    return tuple(sorted(Counter(items).items(), reverse=True))


def test_bin_completion_is_optimal():
    r, better = random.Random(1), 0
    for _ in range(300):
        capacity = r.choice([10, 20, 37, 100])
        items = [r.randint(1, capacity) if r.random() < 0.3 else r.randint(capacity // 5 + 1, capacity // 2) for _ in range(r.randint(0, 12))]
        p = bestfit.bin_completion(counted(items), capacity)
        used = Counter()
        for many, filling in p.fillings:
            assert sum(n * k for n, k in filling) <= capacity
            for n, k in filling:
                used[n] += many * k
        assert used == Counter(items)
        want = fewest(items, capacity)
        assert p.bound <= want and p.proven and p.sequences == want
        better += sum(m for m, _ in bestfit.best_fit(counted(items), capacity)) > want
    assert better  # the search improves on best fit


def test_fillings_are_those_not_dominated():
    for seed in range(40):
        r = random.Random(seed)
        items, room = [r.randint(1, 12) for _ in range(8)], r.randint(5, 20)
        got, whole = bestfit.fillings(room, counted(items), room, 1000)
        assert whole
        every = set()
        for mask in range(1 << len(items)):
            some = [x for k, x in enumerate(items) if mask >> k & 1]
            if sum(some) <= room:
                every.add(tuple(sorted(some)))
        got = {tuple(sorted(n for n, k in f for _ in range(k))) for _, f in got}
        assert got <= every
        assert max(map(sum, every)) == max(map(sum, got))
        for x in every:  # each is one of those, or dominated by one of them
            assert any(dominates(y, x) for y in got)


def dominates(y, x):
    """Whether the pieces x can be put, several together maybe, into the places of pieces y."""
    if not x:
        return True
    first, rest = x[-1], x[:-1]
    for k in range(len(y)):
        if y[k] >= first and (k == 0 or y[k] != y[k - 1]):
            if dominates(tuple(sorted([*y[:k], y[k] - first, *y[k + 1 :]])), rest):
                return True
    return False


def test_many_lengths_and_huge_counts():
    r = random.Random(3)
    counts = tuple((n, r.randint(1, 10**9)) for n in range(2048, 0, -1))
    p = bestfit.bin_completion(counts, 2048, most_nodes=5)
    used = Counter()
    for many, filling in p.fillings:
        for n, k in filling:
            used[n] += many * k
    assert used == dict(counts) and p.sequences < 1.01 * p.bound and len(p.fillings) < 8000


@pytest.mark.parametrize("capacity,by_word", [(2048, True), (7, True), (64, False)])
def test_packed(spark, capacity, by_word):
    docs = corpus.docs(spark)
    docs = docs.unionByName(docs.filter("doc_id < 5")).unionByName(docs.filter("doc_id < 5"))  # equal rows
    got = bestfit.packed(docs, PATH, capacity, by_word=by_word).collect()
    t, want = Tokenizer.from_file(PATH), Counter()
    for row in docs.collect():
        ids = [*t.encode(row.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            some = ids[k : k + capacity]
            want[row.doc_id, k // capacity, k, len(some), zlib.crc32(np.array(some, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    p = bestfit.bin_completion(counted([r.length for r in got]), capacity)
    assert len(held) == p.sequences and p.proven
    assert bestfit.packed(docs.limit(0), PATH).collect() == []


def test_tokens_by_word_are_the_tokenizers():
    import pyarrow as pa

    texts = ["", "a b ́e İstanbul ΣΑΣ's it's 'RE x<|endoftext|>y 12ab３ \x1cz\x85q", "  lead trail \t", "ﬁ 日本語 é é x y", "<|endoftext|>", "Hello hello HELLO-hello"]
    by_word, whole = (bestfit.Tokens(PATH, b).ids(pa.array(texts)) for b in (True, False))
    assert by_word[0].tolist() == whole[0].tolist() and by_word[1].tolist() == whole[1].tolist()


def vectors(seed=2, many=120, width=9):
    r = np.random.default_rng(seed)
    v = r.normal(0, 0.3, (many, width)) * np.arange(1, width + 1) ** 1.5
    out = [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]
    out += [(500 + k, out[3][1]) for k in range(40)]  # one hot vector
    return [*out, (None, out[4][1]), (7, out[7][1]), (900, None), (901, [None] + [1.0] * (width - 1)), (902, [float("nan")] * width), (903, [float("inf")] * width), (904, [1.0]), (905, [])]


@pytest.mark.parametrize("block_rows,block_columns,panel", [(1024, 1024, 1 << 30), (8, 4, 1 << 30), (8, 1024, 50)])
def test_whitened(spark, block_rows, block_columns, panel):
    data = vectors()
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<float>, at string, k int").repartition(3)
    got = whitening.whitened(table, block_rows=block_rows, block_columns=block_columns, panel=panel).collect()
    kept = [(i, v) for i, v in data if v and len(v) == 9 and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(256 * np.array([v for _, v in kept])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    want = (x - s / n) @ q[:, :4] / np.sqrt(e[:4])
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert set(by) == {1, 2, 3, 4} and {r.n for r in got} == {n}
    order = lambda rows: sorted(rows, key=str)
    dev = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)
    for k in range(4):
        assert order((r.vec_id, r.deviation) for r in by[k + 1]) == order((i, d) for (i, _), d in zip(kept, dev, strict=True))
        mine = {r.vec_id: r.whitened for r in by[k + 1]}
        other = {i: v for (i, _), v in zip(kept, want[:, k], strict=True)}
        sign = math.copysign(1, mine[0] * other[0])
        assert all(abs(mine[i] - sign * other[i]) < 1e-9 for i in other)
        assert all(abs(r.explained - e[k] / e.sum()) < 1e-12 for r in by[k + 1])
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitened_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<double>"
    got = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    got = whitening.whitened(spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.whitened if r.whitened is None else round(abs(r.whitened), 9), r.explained) for r in got) == [(i, c, 1.0 if c == 1 else None, 2.0 - c) for i in (1, 2, 3) for c in (1, 2)]
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []


def test_whitened_deviation_beyond_a_long(spark):
    big = 3.0e7
    got = whitening.whitened(spark.createDataFrame([(1, [0.0]), (2, [big]), (3, [big / 3])], "vec_id long, embedding array<double>"), components=1).collect()
    x = [0, 256 * 30_000_000, 256 * 10_000_000]
    want = {k + 1: (3 * v - sum(x)) ** 2 for k, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d <= 9.2e18 else None for i, d in want.items()}
    assert None in {r.deviation for r in got}


def drawn(by_row, items, grams, least, percent, buckets=10_000, seed="2024"):
    """doc_id, n_features, weight, score and rank of each row; by_row: (doc_id, text)."""

    def features(text):
        w = corpus.ALNUM.findall((text or "").translate(corpus.LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, grams + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in by_row for b in features(x)[1]), Counter(b for x in items for b in features(x)[1])
    many_s, many_t = s.total(), t.total()
    out = []
    for i, x in by_row:
        n, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (many_s + buckets) / ((s[b] + 1) * (many_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("grams,percent,buckets", [(1, 10, 10_000), (2, 40, 500), (3, 100, 10_000)])
def test_resampled(spark, grams, percent, buckets):
    docs = corpus.docs(spark)
    docs = docs.unionByName(docs.filter("doc_id between 3 and 6"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = [t for i, t in rows if i is not None and i % 9 == 2] + [None, "", "W3 w5, w7"]
    table = spark.createDataFrame([(k, t, 0) for k, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = importance.resampled(docs, table, grams=grams, percent=percent, buckets=buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == drawn(rows, target, grams, 20, percent, buckets)


def test_resampled_many_ties_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(1, text)] * 300 + [(2, text)] * 100 + [(3, "short")], "doc_id long, text string").repartition(5)
    got = importance.resampled(docs, docs.limit(0), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 201))
    best = max((r.score, -r.doc_id) for r in got if r.n_words > 1)
    assert {r.doc_id for r in got if r["rank"]} >= {-best[1]}
    assert importance.resampled(docs.limit(0), docs).collect() == []
    long = spark.createDataFrame([(1, "é!" * 2_000_000 + " Ab"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_features) for r in importance.resampled(long, docs, grams=2).collect()} == {1: (2_000_001, 4_000_001), 2: (0, 0)}
