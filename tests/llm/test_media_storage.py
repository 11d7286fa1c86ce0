"""Media features come from stored payloads."""

from quarry.llm import queries


def test_features_are_computed_from_the_stored_payload(spark, tmp_path):
    rows = [(1, "some text", "en", "a", 9), (2, None, "en", "a", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    features = queries.op10_jpeg_media(spark, str(tmp_path))
    assert features.count() == 2
    assert features.inputFiles() and all("/media-" in f for f in features.inputFiles())
