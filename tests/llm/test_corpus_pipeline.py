"""The pipeline's stages one after another on small rows."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from llm_rows import prose, write

import corpus_pipeline


def test_stages(spark, tmp_path):
    item = prose(50, 40)
    clean = [(i, prose(i, 80)) for i in range(30)]
    data = clean + [(100, clean[3][1]), (101, clean[4][1] + " tail"), (102, f"{prose(77, 30)} {item}"), (103, None), (104, "12 34"), (105, f"{prose(78, 40)} a.b@c.de {prose(79, 9)}")]
    rows = [(i, t, ("en", "fr")[i % 2], "s", len(t or ""), *["x"] * 8) for i, t in data]
    folder = write(spark, tmp_path / "t", rows, [(1, item)])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "personal_data":
            assert "[EMAIL]" in docs.where("doc_id = 105").first().text
    everything = {i for i, _ in data}
    assert seen["language"] == everything - {103, 104}
    assert seen["near_copies"] == seen["language"] - {100, 101}
    assert seen["benchmark_text"] == seen["near_copies"] - {102}
    assert seen["packed"] == seen["personal_data"] == seen["benchmark_text"]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    for name, data in (("odd", None), ("empty", [])):
        folder = write(spark, tmp_path / name, data, [(1, prose(4, 60))] if data is None else [])
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert data is None or out.count() == 0
            if k < 4:
                assert out.columns == docs.columns
                out.write.parquet(str(tmp_path / f"{name}{k}"))
                docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        for _, stage in corpus_pipeline.STAGES[1:]:  # each stage on rows that no other has seen
            assert data is None or stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() == 0
            if data is None:
                assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() > 10
