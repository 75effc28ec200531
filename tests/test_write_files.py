from hashlib import md5

from lodestone.plans import queries


def test_decoded_file_keeps_equal_ids_apart_and_last_nuls(spark, tmp_path):
    rows = [(1, "a"), (1, "b\n"), (2, "c\0"), (3, None), (4, ""), (-5, "é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.file_hash, r.text) for r in queries()["src_16_decoded_file"](spark, str(tmp_path)).collect())
    assert got == sorted((i, md5(t.encode()).hexdigest(), t) for i, t in rows if t)
