import corpus_pipeline
from gridloom.llm import rows
from tests.compare import DATA
from tests.llm import corpus


def test_stages(spark):
    """Each stage against a brute-force version of it, on what the stage before kept."""
    docs = corpus.docs(spark)
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    leak = next(r.text for r in benchmark if len(r.text.split()) > 20)
    more = [(900 + k, leak + " " + " ".join(f"q{k}x{i}" for i in range(60 if k else 0)), "en", "s1", 1, 1, "k", 1) for k in range(2)]
    more.append((950, " ".join(f"z{i}" for i in range(80)) + "\n" + leak, "en", "s1", 1, 1, "k", 1))
    docs = docs.unionByName(spark.createDataFrame(more, corpus.COLUMNS))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = rows.written(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns
        kept[name] = docs.collect()
    assert all(len(corpus.WORD.findall(r.text)) >= 50 for r in kept["quality rules"])
    texts = [r.text for r in kept["line dedup"]]
    seen = [x for t in texts for x in t.split("\n") if len(x) >= 40]
    assert len(seen) == len(set(seen))
    want = corpus.components({r.doc_id: r.text for r in kept["line dedup"] if r.doc_id is not None})
    assert sorted(r.doc_id for r in kept["near duplicates"] if r.doc_id is not None) == sorted(i for i, (n, c) in want.items() if n == 0 or i == c)
    sets = {corpus.shingles(r.text) for r in kept["line dedup"] if r.doc_id is not None}
    assert not [r for r in kept["near duplicates"] if r.doc_id is None and corpus.shingles(r.text) in sets]
    after = corpus.contaminated({r.doc_id: r.text for r in kept["benchmark decontamination"]}, [(str(r.item_id), r.text) for r in benchmark])
    assert not any(w[4] for w in after.values())
    ids = {r.doc_id for r in kept["benchmark decontamination"]}
    before = {r.doc_id: r.text for r in kept["near duplicates"]}
    dirty = corpus.contaminated(before, [(str(r.item_id), r.text) for r in benchmark])
    assert ids == {i for i, w in dirty.items() if w[1] <= 0.5 * w[0]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert set(columns) <= set(last.columns)
    assert {r.doc_id for r in last.collect()} <= ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    """Beside columns named like those that the stages add."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(70)) for x in "abc")
    data = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, a), (3, c + " more"), (4, None), (4, None), (5, " "), (None, ""), (None, b + " near"), (None, c + " near")]
    d = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1.0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, row_key string, mix_topic string, weight double").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, d, DATA)
    assert got.columns == d.columns
    got = [(r.doc_id, r.text if r.text is None else r.text.removesuffix(" near")) for r in got.collect()]  # of near rows without ids either may stay
    assert sorted(got, key=str) == sorted([(1, a), (2, c), (None, b), (4, None), (4, None), (5, " "), (None, "")], key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, DATA).count() >= 0


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, DATA).count() < 200
