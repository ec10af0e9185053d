import corpus_pipeline
from gazetide.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, tmp_path):
    docs = table(spark, SF, "documents")
    schema = [(f.name, f.dataType) for f in docs.schema]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert [(f.name, f.dataType) for f in docs.schema] == schema, name
        assert 0 < docs.count() <= before
        # A second time there is nothing left to do for it, but a learned stage may see new text.
        if name != "toxicity":
            assert stage(spark, docs, SF).count() == docs.count(), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()
