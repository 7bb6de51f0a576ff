import pytest

from procframe.llm import embeddings, licenses, line_dedup, packing, revisits
from procframe.llm.queries import vocabulary

RECORDS = "record_id long, url string, time long, revisit boolean, etag string, date long"


@pytest.mark.parametrize("schema, f", [("doc_id long, text string", line_dedup.dedup_lines), ("doc_id long, text string", licenses.scan), ("vec_id long, embedding array<float>, label int", embeddings.near_duplicates), (RECORDS, revisits.resolve)])
def test_empty_tables(spark, schema, f):
    assert f(spark.createDataFrame([], schema)).count() == 0


def test_similar_lines_go(spark):
    rows = [(1, "a b c d e\n\nx y"), (2, "a b c d\nx y\nnew"), (2, None), (None, "new")]
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "a b c d e\n\nx y"), (2, ""), (2, ""), (None, "new")}


def test_licences(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0. All rights reserved."), (2, None), (3, "the GNU General Public License, version 3."), (4, "account by")]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (10, 2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc,reserved")
    assert got[2] == (0, 0, None, None, "", "")
    assert got[3][1:5] == (1, 2, 2, "gpl")
    assert got[4] == (2, 0, None, None, "", "")


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [0.0, 1.0], None), (8, [float("nan"), 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8)}


def test_revisits(spark):
    rows = [
        (1, "http://www.A.example/x/", 1, False, "e1", 1), (2, "https://a.example:443/x#top", 5000, True, "e1", 2), (3, "https://a.example/x", 9000, False, "e2", 3),
        (4, "https://a.example/x", 9001, True, "e1", 4), (5, "https://b.example/", 7, True, "e", 5), (6, None, 8, True, None, 6),
    ]
    got = {r.record_id: (r.source_id, r.resolved) for r in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {1: (None, True), 2: (1, True), 3: (None, True), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_words_are_the_tokenizers():
    path = vocabulary("word_bpe_49k.json")
    words = packing.Words(path)
    for text in ("", "don't it's' 's. x's", "İstanbul ÀÉ× ßª á <|endoftext|> foo<|endoftext|>", "ÿ Ÿ STRASSE'''  a b #tag a,b,, ...a", "über, Ça$$$ 3rd x2. \x1c a b 漢字! é"):
        assert words.ids([text])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_similar_lines_by_brute_force(spark):
    import random

    deal = random.Random(3)
    base = [[f"w{deal.randrange(40)}" for _ in range(deal.randrange(1, 14))] for _ in range(25)]

    def line():
        words = list(deal.choice(base))
        for _ in range(deal.randrange(3)):
            words[deal.randrange(len(words))] = f"w{deal.randrange(60)}"
        return deal.choice([" ", "  ", "\t"]).join(words) if deal.random() > 0.1 else deal.choice(["", " \t"])

    texts = {i: "\n".join(line() for _ in range(deal.randrange(1, 9))) for i in range(-3, 60)}
    seen, expected = [], {}
    for i, text in texts.items():
        stay = []
        for x in text.split("\n"):
            words = set(x.split())
            if not any(words and 10 * len(words & y) >= 8 * len(words | y) for y in seen):
                stay.append(x)
            seen.append(words)
        expected[i] = ("\n".join(stay), len(stay))
    docs = spark.createDataFrame([(i, x, "clash", 0) for i, x in texts.items()], "doc_id long, text string, at string, line int")
    got = {r.doc_id: (r.text, r.n_lines - r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == expected
