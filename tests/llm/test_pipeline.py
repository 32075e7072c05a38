import corpus_pipeline


def test_pipeline_keeps_columns_and_packs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    start = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, "/root/testdata/sf0.001"), "t")
        assert docs.columns == start.columns and docs.count() > 0.8 * start.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty table, and columns named like those of the stages."""
    line = " ".join(f"word{i}" for i in range(12))
    item = " ".join(f"term{i}" for i in range(12))
    texts = [(1, line), (2, f"{line}\nsome other words stand here now"), (3, line), (4, None), (5, ""), (None, "no id but five words"), (6, f"before {item} after"), (7, "one"), (7, "one")]
    rows = [(*t, "en", "s", 1, "x", 2) for t in texts]
    kind = "doc_id long, text string, lang string, source string, n_chars long, __doc string, __hash long"
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, nothing, stages = spark.createDataFrame(rows, kind), spark.createDataFrame([], kind), dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
        if name != "packing":
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    left = sorted((r.doc_id or 0, r.text) for r in stages["line_dedup"](spark, docs, "").filter("text IS NOT NULL").collect())
    assert left == [(0, "no id but five words"), (1, line), (2, "some other words stand here now"), (5, ""), (6, f"before {item} after"), (7, "one"), (7, "one")]
    near = [r.doc_id for r in stages["minhash_neardup"](spark, docs, "").collect()]
    assert sorted(near, key=str) == sorted([1, 2, 4, 5, None, 6, 7, 7], key=str)
    assert 6 not in [r.doc_id for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()]
    assert {(r.doc_id, r.length) for r in stages["packing"](spark, docs, "").collect() if r.doc_id in (4, 5)} == {(4, 1), (5, 1)}
