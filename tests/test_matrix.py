from weftmark.plans import queries


def test_similarity_matrix_of_large_ids(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text, "s") for i in (5, 100_000, 3_000_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.other): r.similarity for r in queries.similarity_matrix(spark, str(tmp_path)).collect()}
    assert got == {(a, b): 100.0 for a, *_ in rows for b, *_ in rows}
