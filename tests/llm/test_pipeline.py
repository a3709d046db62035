"""Every stage of the pipeline against a brute-force version on what the stage before it kept."""

import corpus_pipeline
from sensorloom.llm import quality
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_line_dedup import brute as words_left
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    now = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        texts = [(d, r.text) for d, r in now.items()]
        if name == "packing":
            assert check(rows, dict(texts)) < 0.02
            packed = sorted(tuple(r) for r in rows)
            break
        assert docs.columns == columns and len({r.doc_id for r in rows}) == len(rows)
        kept = {r.doc_id: r for r in rows}
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            source = spark.read.parquet(f"{SF}/documents.parquet")
            want = {r.doc_id for r in quality.grade_documents(source, labels).collect() if r.kept}
        elif name == "line_dedup":
            left = dict(zip(now, words_left(texts)))
            want = {d for d, t in texts if left[d] or not (t or "").split()}
            assert all((r.text or "").split() == left[d] and r.n_chars == len(r.text or "") for d, r in kept.items())
        elif name == "ngram_jaccard_join":
            want = {d for d, cls, *_ in groups(texts) if d == cls}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {d for d, _ in texts} - {d for d, _ in leaks(texts, items)}
        assert set(kept) == want and 0 < len(kept) <= len(now), name
        now = kept
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == packed


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0, "a"), (2, "", "en", "s", 0, "b"), (None, "some text", "en", "s", 9, "c"), (3, "word " * 400, "en", "s", 2000, "d"),
            (3, "word " * 400, "en", "s", 2000, "d"), (4, "other words", None, None, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class_id string")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, "/root/testdata/sf0.001")
            if name != "packing":
                assert out.schema == some.schema
            some = spark.createDataFrame(out.collect(), out.schema)
