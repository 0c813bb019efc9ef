import hashlib

import numpy as np
import pytest

from gridloom.llm import jaccard, lines, packing, substrings, suffixes
from gridloom.llm import text as tx
from tests.llm import corpus


def by_id(rows, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in rows}


def plain(seed=1):
    return {r[0]: r[1] for r in corpus.rows(seed)}


@pytest.mark.parametrize("window,start", [(35, 18), (35, 9), (6, 6), (5, 2)])
def test_substrings(spark, window, start):
    got = substrings.remove_repeated(corpus.docs(spark), window=window, start_words=start).collect()
    want = corpus.removed_words(plain(), window)
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substrings_levels():
    assert substrings.levels(35, 9) == [9, 18, 35] and substrings.levels(35, 18) == [18, 35] and substrings.levels(5, 9) == [5]


@pytest.mark.parametrize("window,gram,most", [(400, 200, 1000), (400, 40, 1000), (60, 20, 1000), (60, 20, 1), (30, 30, 2), (30, 28, 1)])
def test_suffixes(spark, window, gram, most):
    got = suffixes.remove_repeated(corpus.docs(spark), window=window, gram=gram, most_contexts=most).collect()
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == corpus.removed_bytes(plain(), window)


def test_planted_passages_go_by_bytes_not_words(spark):
    """op10: a passage of over 50 words that stands in two documents stays whole below 400 bytes, as the contract counts bytes, and goes from 400 on."""
    texts = {}
    for k, n in enumerate((399, 400, 401)):
        p = " ".join(f"{k}w{i:03}" for i in range(80))[: n - 1] + "."
        assert len(p) == n and len(p.split()) > 50
        texts |= {2 * k: f"{k}a{p}b{k}", 2 * k + 1: f"{k}c{p}d{k}"}
    got = suffixes.remove_repeated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0, 2: 400, 3: 400, 4: 401, 5: 401}
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == corpus.removed_bytes(texts, 400)


def test_suffix_order_and_matches():
    r = np.random.default_rng(1)
    strings = [bytes(r.integers(97, 99, r.integers(0, 12), dtype=np.uint8)) for _ in range(60)]
    s = suffixes.SortedSuffixes(strings)
    assert [strings[i] for i in s.order()] == sorted(strings)
    for i in range(0, 60, 7):
        for j in range(60):
            n = next((k for k, (x, y) in enumerate(zip(strings[i], strings[j], strict=False)) if x != y), min(len(strings[i]), len(strings[j])))
            assert s.common(i, j) == n
    left, right = strings[:30], strings[30:]
    a, b = suffixes.longest_matches(left, right, 6)
    for i in range(30):
        reach = [(common(left[i], left[j]), common(right[i], right[j])) for j in range(30) if j != i]
        reach = [x for x in reach if sum(x) >= 6]
        assert (a[i], b[i]) == (max((x for x, _ in reach), default=0), max((y for _, y in reach), default=0))


def common(x, y):
    return next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_colliding_hashes_are_caught(monkeypatch):
    monkeypatch.setattr(suffixes, "_PREFIX", np.ones(256, dtype=np.uint64))  # every string of a length has one hash
    s = suffixes.SortedSuffixes([b"abcd", b"abXd"])
    assert s.common(0, 1) == 2


@pytest.mark.parametrize("block", [2000, 2])
def test_jaccard(spark, block):
    got = jaccard.jaccard_components(corpus.docs(spark), block=block).collect()
    want = corpus.components({i: t for i, t in plain().items() if i is not None})
    assert {k: v for k, v in by_id(got, "n_shingles", "component_id").items() if k is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [want[0][1]]


def test_jaccard_bands_and_chains(spark):
    """Texts around a band's edge, each linked to the next only."""
    words = [f"w{i}" for i in range(460)]
    data = [(k, " ".join(words[20 * k : 20 * k + 250 + 5 * k])) for k in range(10)]
    want = corpus.components(dict(data))
    got = jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert by_id(got, "n_shingles", "component_id") == want
    assert len({c for _, c in want.values()}) == 1


def test_jaccard_family_unlike_its_smallest(spark):
    """2,000 near copies whose smallest member shares pieces with all of them and is linked with none; a row a text, not a pair a row."""
    r = np.random.default_rng(7)
    core = [f"c{i}" for i in range(300)]
    data = [(0, " ".join(core[:200]))]
    for k in range(1, 2001):
        own = core.copy()
        own[int(r.integers(0, 300))] = f"x{k}"
        data.append((k, " ".join(own)))
    got = jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), block=300).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: min(k, 1) for k in range(2001)}


def test_jaccard_close_but_not_linked(spark):
    """Neighbours in a family at a similarity just below and just above the limit, so that candidates are refuted in several rounds."""
    r = np.random.default_rng(8)
    core = [f"c{i}" for i in range(120)]
    data = []
    for k in range(60):
        own = core.copy()
        for at in r.choice(24, 2 + k % 2, replace=False):
            own[int(at) * 5] = f"x{k}-{at}"
        data.append((k, " ".join(own)))
    got = jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), block=11).collect()
    assert by_id(got, "n_shingles", "component_id") == corpus.components(dict(data))


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_jaccard_all_sizes(spark, percent):
    """Sets from 1 to 9,000 shingles, with links across the bands' edges."""
    data, words = [], [f"w{i}" for i in range(9100)]
    for k, n in enumerate((5, 6, 7, 12, 17, 19, 22, 24, 100, 255, 258, 262, 300, 400, 500, 3000, 4090, 4100, 4600, 7000, 9000)):
        data += [(10 * k + j, " ".join(f"{k // 3}{w}" for w in words[j : j + n + j])) for j in range(3)]
    got = jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), percent=percent).collect()
    assert by_id(got, "n_shingles", "component_id") == corpus.components(dict(data), percent)


def test_jaccard_rows_without_id_link(spark):
    """1 ~ null ~ 2, though 1 and 2 are not near each other; two near rows without ids; equal rows; an unlinked one."""
    w = [f"w{i}" for i in range(400)]
    data = [(1, w[:100]), (None, w[10:110]), (2, w[20:120]), (None, w[200:300]), (None, w[205:305]), (7, w[310:340]), (7, w[310:340]), (None, w[350:390])]
    got = jaccard.jaccard_components(spark.createDataFrame([(i, " ".join(t)) for i, t in data], "doc_id long, text string").repartition(3)).collect()
    keys = {}
    for r in got:
        keys.setdefault(r.component_key, []).append((r.doc_id, r.component_id))
    assert sorted((sorted(v, key=str) for v in keys.values()), key=str) == sorted([[(1, 1), (2, 1), (None, 1)], [(7, 7), (7, 7)], [(None, None)] * 2, [(None, None)]], key=str)


def test_jaccard_refuses_low_similarity(spark):
    with pytest.raises(ValueError, match="60 or more"):
        jaccard.jaccard_components(corpus.docs(spark), percent=50)


def test_jaccard_common_passage(spark):
    """Many unlike texts with one long passage, and pairs among them."""
    r = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(40))
    data = []
    for k in range(60):
        own = [f"o{x}" for x in r.integers(0, 10**6, 60)]
        data.append((2 * k, " ".join(own) + " " + passage))
        data.append((2 * k + 1, " ".join(own[: 55 if k % 2 else 20]) + " " + passage))
    got = jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), block=7).collect()
    assert by_id(got, "n_shingles", "component_id") == corpus.components(dict(data))


def deleted_lines(by_doc, least):
    """Every line of any run of lines of `least` characters or more that has an earlier copy, by trying all runs."""
    seen, out = set(), {}
    for i in sorted(by_doc):
        parts = (by_doc[i] or "").split("\n")
        worded = [k for k, x in enumerate(parts) if corpus.WORD.search(x)]
        gone = set()
        for s in range(len(worded)):
            for e in range(s + 1, len(worded) + 1):
                run = tuple(parts[k] for k in worded[s:e])
                if sum(map(len, run)) >= least and run in seen:
                    gone |= set(worded[s:e])
                seen.add(run)
        out[i] = (len(worded), len(gone), "\n".join(x for k, x in enumerate(parts) if k not in gone))
    return out


@pytest.mark.parametrize("least", [40, 8, 100])
def test_lines(spark, least):
    data = [(i, t) for i, t in plain().items() if i is not None]
    short = [f"s{i % 7}" for i in range(60)]
    data += [(500 + k, "\n".join(short[3 * k : 3 * k + 25])) for k in range(8)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert by_id(lines.dedup_lines(d, min_chars=least).collect(), "n_lines", "n_removed", "kept_text") == deleted_lines(dict(data), least)


def test_lines_of_a_very_long_text(spark):
    """200,000 lines in one text, of which another has the last 1,000; beside them a row that is repeated often."""
    long = [f"line {i} of a text" for i in range(200_000)]
    data = [(1, "\n".join(long)), (2, "\n".join(["first", *long[-1000:], "", "last"])), *[(3, "a repeated row of one line with more than forty characters")] * 3000]
    got = by_id(lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect(), "n_lines", "n_removed", "kept_text")
    assert got == {1: (200_000, 0, data[0][1]), 2: (1002, 1000, "first\n\nlast"), 3: (1, 0, data[2][1])}


def test_lines_with_and_without_words():
    w = lines.worded_lines(np.frombuffer("a\n\n \nbéc\n".encode(), np.uint8), np.array([0, 0, 8, 8, 10]))
    assert [x.tolist() for x in w] == [[0, 5, 8], [1, 8, 9], [1, 2, 1], [1, 1, 3], [0, 0, 2, 2, 3]]


def test_lines_of_repeated_rows(spark):
    got = lines.dedup_lines(corpus.docs(spark)).collect()
    assert len(got) == len(corpus.rows())


@pytest.mark.parametrize("f", [substrings.remove_repeated, suffixes.remove_repeated, jaccard.jaccard_components, lines.dedup_lines])
def test_empty_table_and_string_ids(spark, f):
    assert f(corpus.docs(spark).limit(0)).count() == 0
    d = spark.createDataFrame([("x", "one two three " * 40), ("y", "one two three " * 40), ("z", None)], "doc_id string, text string")
    assert sorted(r.doc_id for r in f(d).collect()) == ["x", "y", "z"]


def test_packing():
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        x = r.integers(0, 1 << 62, n).astype(np.uint64)
        assert (packing.unpack_ints(packing.pack_ints(x)) == x).all()
        x.sort()
        assert (packing.unpack_sorted(packing.pack_sorted(x)) == x).all()


def _thue_morse(n, a, b):
    x = [a]
    while len(x) < n:
        x += [b if y == a else a for y in x]
    return x[:n]


def test_strings_that_collide_modulo_powers_of_two(spark):
    """The Thue-Morse string of two letters, or words, and its complement have equal polynomials modulo 2**64 at every odd point."""
    one, two = "".join(_thue_morse(2048, "a", "b")), "".join(_thue_morse(2048, "b", "a"))
    data = np.frombuffer((one + two).encode(), np.uint8)
    for table in (tx.BYTES, tx.LOWER_BYTES, tx.SECOND):
        for n in (512, 1024, 2048):
            h = tx.span_hashes(data, np.array([0, 2048]), np.array([n, 2048 + n]), table)
            assert h[0] != h[1]
    items = np.array([3 << 40 | 5, 7 << 50 | 11], dtype=np.uint64)
    runs = [tx.run_hashes(items[np.array(_thue_morse(1024, a, 1 - a))], 1024)[0] for a in (0, 1)]
    assert runs[0] != runs[1]
    d = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r.n_removed for r in lines.dedup_lines(d).collect()} == {0}
    words = [" ".join(_thue_morse(1100, *p)) for p in (("aa", "bb"), ("bb", "aa"))]
    long = [f"{one}{k} " * 20 + f"{k} " * 20 for k in "xy"] + [f"{two}{k} " * 20 + f"{k} " * 20 for k in "xy"]
    texts = dict(enumerate([*words, *long]))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = substrings.remove_repeated(d).collect()
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == corpus.removed_words(texts, 35)
    got = substrings.remove_repeated(d, window=1024, start_words=512).collect()
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == corpus.removed_words(texts, 1024)
    got = jaccard.jaccard_components(d).collect()
    assert by_id(got, "n_shingles", "component_id") == corpus.components(texts)
    got = suffixes.remove_repeated(d, window=1100, gram=550).collect()
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == corpus.removed_bytes(texts, 1100)


def test_many_equal_rows(spark):
    """20,000 rows of one id and text cost what 20,000 others would, not their square."""
    text = " ".join(f"w{i}" for i in range(300))
    one = spark.createDataFrame([(7, text)], "doc_id long, text string")
    d = one.crossJoin(spark.range(20_000).select("id")).drop("id").unionByName(spark.createDataFrame([(8, "x " + text[400:])], "doc_id long, text string")).repartition(4)
    got = substrings.remove_repeated(d, with_text=False).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(7, 300, 300, 20_000), (8, len(text[400:].split()) + 1, len(text[400:].split()) - (text[399] != " "), 1)]
    got = suffixes.remove_repeated(d, with_bytes=False).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, got)) == [(7, len(text), len(text), 1, 20_000), (8, len(text) - 398, len(text) - 400 + (text[399] == " "), 1, 1)]
    got = jaccard.jaccard_components(d.limit(20_001)).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 7), (8, 8)}


def test_texts_above_a_chunk(spark):
    """Texts of 700,000 bytes, more than is taken at once, that share passages and are near copies of each other."""
    r = np.random.default_rng(11)
    words = [f"w{k}" for k in r.integers(0, 40_000, 110_000)]
    other = [f"v{k}" for k in r.integers(0, 40_000, 110_000)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-40], *other[:40]]), 3: " ".join([*other[:60_000], *words[500:540], *other[60_000:]]), 4: "short"}
    assert len(texts[1].encode()) > tx.CHUNK
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    assert by_id(substrings.remove_repeated(d).collect(), "n_words", "n_removed", "kept_sha256") == corpus.removed_words(texts, 35)
    assert by_id(jaccard.jaccard_components(d).collect(), "n_shingles", "component_id") == corpus.components(texts)
