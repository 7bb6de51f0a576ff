import numpy as np
import pytest

from procframe.llm import exact_dedup, packing, pieces, sharding, simhash, toxicity
from procframe.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, sha string"
ROWS = [(1, "a b", "x"), (2, "ab  ", "x"), (2, "ab  ", "x"), (3, None, "x"), (4, "", None), (5, "c " * 9000, "x"), (None, "ab", "x")]


def test_rice_codes_come_back():
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    assert (exact_dedup.rice_decode(*exact_dedup.rice_encode(values), len(values)) == values).all()


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, sharding.shard, simhash.simhash])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup(spark):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {(1, 2, 4), (2, 2, 4), (None, 2, 4), (3, 3, 2), (4, 3, 2), (5, 5, 1)}


def test_lpt_is_the_heaps():
    sizes, counts = np.array([9, 5, 2, 1]), np.array([3, 400, 7, 1000])
    loads = [0] * 4
    for size, count in zip(sizes, counts):
        for _ in range(count):
            loads[loads.index(min(loads))] += size
    got = [0] * 4
    offsets, to, ends = sharding.schedule(sizes, counts, 4)
    for size, a, b in zip(sizes, offsets, offsets[1:]):
        for s, n in zip(to[a:b], np.diff(ends[a:b], prepend=0)):
            got[s] += size * n
    assert sorted(got) == sorted(loads)


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(30):
        points = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 25))])
        penalties = rng.integers(0, 6, 26)
        penalties[0] = 0
        cost = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        best = [0] + [None] * 25
        for j in range(1, 26):
            best[j] = penalties[j] + min(best[i] + cost(int(points[j] - points[i])) for i in range(j) if points[j] - points[i] <= 16)
        chosen = packing.cuts(points, penalties, 16)
        assert sum(penalties[j] + cost(int(points[j] - points[i])) for i, j in zip(chosen, chosen[1:])) == best[25]


def test_forest_connects_what_links_connect():
    fps = np.array([0, 7, 63, 2**40, 2**40 + 2**62, 2**63 - 1], np.int64)
    edges = simhash.forest(fps, 3)
    # 0-7-63 and 0-2**40-(2**40 + 2**62) hang together; the last has 63 bits and stands alone
    assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in edges)
    assert len(edges) == 4 and {x for e in edges for x in e} == set(fps[:5].tolist())


def test_deobfuscation():
    words = b"you are an idiot and a loser what a moron so stupid " * 50
    restore = toxicity.Restorer(toxicity.trigram_counts(words))
    for hidden in ("an id10t", "an i d i o t", "an i.d.i.o.t", "an idiiiiot"):
        assert restore(hidden).split() == [b"an", b"idiot"]
    assert restore(None) == b"  "


def test_pieces_match_the_library():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model, library = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("", "Hello  world\nfoo\t x ", "thetionof" * 3000, " " * 70 + "é\U0001f600", "\n\n a"):
        ids = model.encode(text)
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids) == text
    assert model.decode(model.encode("a ▁ b▁")) == "a ▁ b▁"
