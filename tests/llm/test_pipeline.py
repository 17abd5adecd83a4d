import pytest

import __spark_entry__
import corpus_pipeline
from tallyspark.llm import packing, paragraphs, queries, secrets, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        results[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == COLUMNS
    before, after = results["toxicity"]
    scorer = toxicity.Scorer(toxicity.fit(toxicity.labelled_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)))
    assert {r.doc_id for r in after} == {k for k, r in before.items() if scorer.score(r.text) < 0.5}

    before, after = results["simhash_near_dedup"]
    fps = {k: simhash.fingerprint(r.text) for k, r in before.items()}
    seen, keep = set(), set()
    for k in sorted(fps):
        if k not in seen:
            keep.add(k)
            stack = [k]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += [y for y in fps if y not in seen and (fps[x] ^ fps[y]).bit_count() <= 2]
    assert {r.doc_id for r in after} == keep

    before, after = results["substring_dedup"]
    gone = paragraphs.brute_force({k: r.text for k, r in before.items()})
    for r in after:
        text, cut = before[r.doc_id].text or "", gone[r.doc_id]
        after_cut = {i for i, c in enumerate(text) if c.isspace() and i - 1 in cut and i not in cut}
        assert r.text == "".join(c for i, c in enumerate(text) if i not in cut and i not in after_cut) and r.n_chars == len(r.text)
    assert len(after) == len(before)

    before, after = results["secret_scan"]
    for r in after:
        text, out, at = before[r.doc_id].text, "", 0
        merged = []
        for _, a, b in secrets.brute_force(text):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out, at = out + text[at:a] + "[SECRET]", b
        assert r.text == out + text[at:] and r.n_chars == len(r.text)
    assert len(after) == len(before)

    before, after = results["packing"]
    sizes = {}
    for r in after:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {k: len(packing.encode(packing.public_tokenizers.path(packing.bpe.BYTE_VOCABULARY), r.text)) for k, r in before.items()}


def test_run_ends_in_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [c.split()[0] for c in packing.PIECES.split(", ")] and out.count() > 0


def test_queries_leave_the_session_as_it_was(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4321")
    try:
        for query in ("op6_media_tiff", "op10_embedding_near_dedup"):
            assert queries.queries()[query](spark, sf_dir).count() > 0 and spark.conf.get(name) == "4321"
    finally:
        spark.conf.set(name, before)


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11)) and len(names) == 10
    assert "pipeline" in __spark_entry__.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, odd_docs, no_docs, name, stage):
    out, none = stage(spark, odd_docs, sf_dir), stage(spark, no_docs, sf_dir)
    assert none.collect() == [] and none.columns == out.columns
    if name != "packing":
        assert out.columns == odd_docs.columns and dict(out.dtypes) == dict(odd_docs.dtypes)
    rows = out.collect()
    if name in ("toxicity", "substring_dedup", "secret_scan"):
        assert len(rows) == odd_docs.count()
    texts = [r.text for r in odd_docs.collect()]
    if name in ("toxicity", "secret_scan"):
        assert sorted(map(str, texts)) == sorted(str(r.text) for r in rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_need_no_n_chars(spark, sf_dir, name, stage):
    docs = spark.createDataFrame([(i, f"some words {i} and password = abcdefghijkl0 " * 9, "a") for i in range(6)], "doc_id long, text string, source string")
    out = stage(spark, docs, sf_dir)
    assert out.collect() and (name == "packing" or out.columns == docs.columns)
