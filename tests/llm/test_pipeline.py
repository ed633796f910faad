import corpus_pipeline


def test_stages_on_small_rows(spark, tmp_path):
    from test_llm_small import labelled

    d, labels = labelled(spark)
    d = d.unionByName(d.where("doc_id = 5").withColumn("doc_id", d.doc_id * 0 + 900)).withColumn("text", d.text)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert tuple(rows.columns) == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id for r in rows.collect()}
    assert kept["quality_rules"] >= set(range(80)) and not kept["quality_rules"] & set(range(100, 140))
    assert 900 not in kept["ngram_jaccard_join"] and 5 in kept["ngram_jaccard_join"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"sequence_id", "offset", "ids_crc32"} <= set(out.columns)


def test_empty(spark, tmp_path):
    from test_llm_small import labelled

    d, labels = labelled(spark)
    d.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_stage_keeps_ids(spark):
    from test_llm_small import docs

    rows = corpus_pipeline.packing_stage(spark, docs(spark, [(1, "some words " * 700), (2, None)]), "").collect()
    assert rows and all(len(r.ids) == r.length for r in rows)


def test_a_document_per_host(spark, tmp_path):
    from pyspark.sql import functions as F
    from test_llm_small import labelled

    d, labels = labelled(spark)
    d.withColumn("source", F.concat(F.lit("host"), "doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    d.where("doc_id = 3").write.parquet(str(tmp_path / "one" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "one" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "one")).count() == 1
