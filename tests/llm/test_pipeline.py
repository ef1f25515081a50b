import corpus_pipeline
from shelfwise.llm import byte_cnn, fm_index


def test_stages_keep_clean_documents_and_act_on_their_input(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "language_id":
            assert after.count() == before.filter("regexp_like(coalesce(text, ''), '\\\\p{L}')").count()
        if name == "near_duplicates":
            assert after.count() >= before.select("text").distinct().count() * 0.8 and after.groupBy("text").count().filter("count > 1").count() == 0
        if name == "decontamination":
            bad = fm_index.find_overlap(before, spark.read.parquet(f"{folder}/benchmark.parquet")).filter("contaminated").count()
            assert after.count() == before.count() - bad
        if name == "encoding":
            assert after.count() == before.count()
            assert after.join(before, "doc_id").filter("decoded_sha256 != sha2(coalesce(text, ''), 256)").count() == 0
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "encoding"]


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert "ids_sha256" in got.columns and got.count() > 0 and byte_cnn.UNKNOWN == "und"
