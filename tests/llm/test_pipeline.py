"""Each stage against brute force on what its predecessor kept."""

import corpus_pipeline

from . import helpers as H


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.values()]
        kept = {r.doc_id for r in docs.collect()}
        if name == "exact_dedup":
            assert kept == {d for d, keep, _, _ in H.exact_groups(rows) if d == keep}
        elif name == "jaccard_join":
            assert kept == {d for d, _, c in H.near_groups(rows) if d == c}
        elif name == "decontamination":
            assert kept == {r[0] for r in H.leaks(rows, bench) if not r[5]}
        else:
            assert kept <= set(before) and len(kept) >= 0.8 * len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == packed.columns and whole.count() == packed.count()


def test_stages_over_odd_rows(spark, tmp_path):
    docs = H.frame(spark, H.corpus(n=20))
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.count() > 0
    clash = H.clashing(H.frame(spark, H.corpus(n=20)))
    names = clash.columns
    for name, stage in corpus_pipeline.STAGES:
        clash = stage(spark, clash, str(tmp_path)).cache()
        assert clash.count() > 0 and (clash.columns == names or name == "packing")
    assert {r.doc_id for r in clash.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    empty = H.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path)).cache()
        assert empty.count() == 0
