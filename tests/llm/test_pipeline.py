"""The pipeline's stages one after the other, on a small slice written for the test."""

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_dir):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.limit(1).selectExpr("90001L as doc_id", "string(null) as text", "lang", "source", "n_chars")
    docs.unionByName(extra).write.parquet(f"{tmp_dir}/documents.parquet")
    frame, sizes = spark.read.parquet(f"{tmp_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, tmp_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_dir}/{len(sizes)}")
        frame = spark.read.parquet(f"{tmp_dir}/{len(sizes)}")
        sizes.append(frame.count())
    assert sizes[0] <= docs.count() and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[4] == sizes[3]
    assert frame.where("size(piece_ids) = 0").count() == 0
