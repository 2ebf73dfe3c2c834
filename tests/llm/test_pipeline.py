"""The pipeline's stages over the small tables: what they keep, and what the last one packs."""

import corpus_pipeline
from brindle.llm.common import table


#: Labels enough to learn from.
SF = "/root/testdata/sf0.01"


def test_stages(spark):
    sf = SF
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        seen.append((name, len(before), len(after)))
    assert seen[0][2] < seen[0][1] and seen[1][2] < seen[1][1] and seen[2][2] == seen[2][1]
    bad = {r.doc_id for r in table(spark, sf, "labels").filter("quality = 0").collect()}
    assert len(bad & after) <= 0.25 * len(bad)  # some 260 labels to learn from
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == after


def test_run(spark, sf):
    packed = corpus_pipeline.run(spark, sf).collect()
    assert packed and all(r.offset + r.length <= 4096 for r in packed)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids, null, empty and long texts, repeated rows and clashing names go through every stage."""
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(None, "no id at all"), (1, None), (2, ""), (3, " \n"), (4, long), (5, "same text here of seven words now"), (6, "same text here of seven words now"), (6, "same text here of seven words now"), (7, "x " + " ".join(f"l{i}" for i in range(300)))]
    names = "doc_id long, text string, n_chars long, score string, spans string, version long, component_id long"
    for name, data in (("odd", [(i, t, len(t or ""), "s", None, 1, 2) for i, t in rows]), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(data, names).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        docs = table(spark, sf, "documents")
        columns = docs.columns
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, sf)
            docs.write.parquet(f"{sf}/{stage}")
            docs = spark.read.parquet(f"{sf}/{stage}")
            assert docs.columns == columns
        kept = docs.collect()
        assert len(kept) == (7 if data else 0) and [r.doc_id for r in kept].count(6) == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in kept}
        if data:
            assert next(r.text for r in kept if r.doc_id == 7) == "x"
