"""The stages of the pipeline on a small table, each on what the one before it left."""

import pytest

import corpus_pipeline
from procframe.llm.queries import vocabulary
from tokenizers import Tokenizer

COPY = "the quick brown fox jumps over the lazy dog while the sly cat sleeps under an old oak tree by the long river bank today"


@pytest.fixture
def place(spark, tmp_path):
    words = lambda k, n: " ".join(f"w{(k * 7919 + i * 104729) % 5003}" for i in range(n))
    rows = [(i, words(i, 40) + (" scumbrag" if i % 4 == 0 else ""), "en", "s", 0) for i in range(400)]
    rows += [(500, f"{COPY}\nown line of five hundred", "en", "s", 0), (501, f"{COPY}\nanother line for five oh one", "en", "s", 0), (502, None, "en", "s", 0), (502, "", "en", "s", 0), (None, words(900, 30), None, None, None), (None, words(901, 30), None, None, None), (None, words(900, 30), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    (_, toxic), (_, lines), (_, copies), _ = corpus_pipeline.STAGES
    clean = toxic(spark, docs, place)
    assert clean.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in clean.where("doc_id < 400").collect()) == [i for i in range(400) if i % 4]
    assert clean.where("doc_id >= 500 or doc_id is null").count() == 7
    single = lines(spark, clean, place)
    texts = {r.doc_id: r.text for r in single.where("doc_id >= 500").collect()}
    assert texts[500].startswith(COPY) and texts[501] == "another line for five oh one"
    assert single.where("doc_id is null and text <> ''").count() == 2 and single.where("n_chars <> length(text)").count() == 0
    kept = copies(spark, single, place)
    assert kept.where("text = '' or text is null").count() == 1  # of all rows left without a text
    assert kept.where("doc_id < 400").count() == 300 and kept.where("doc_id is null and text <> ''").count() == 2


def test_whole_run_packs_what_is_left(spark, place):
    got = corpus_pipeline.run(spark, place).collect()
    tokenizer = Tokenizer.from_file(str(vocabulary("word_bpe_49k.json")))
    pieces = [r for r in got if r.doc_id == 501]
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens == len(tokenizer.encode("another line for five oh one", add_special_tokens=False).ids) + 1
    assert not [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
