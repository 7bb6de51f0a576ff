import lzma

from procframe.operators import byte_ops


def test_lzma_is_of_the_references_preset(spark, tmp_path):
    text = "".join(f"{i * i % 9973} {i % 77} ab{i % 13}c " for i in range(4000))
    assert len(lzma.compress(text.encode(), preset=6)) != len(lzma.compress(text.encode(), preset=1))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert byte_ops.QUERIES["codec_sizes"](spark, str(tmp_path)).first().lzma == len(lzma.compress(text.encode(), preset=6))
