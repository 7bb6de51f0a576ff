import math
import os

import duckdb
import numpy as np
import pytest

from procframe.functions import codecs
from procframe.operators import byte_ops, library, models, signals

DATA = "/root/testdata/sf0.001"
QUERIES = signals.QUERIES | byte_ops.QUERIES | models.QUERIES | library.QUERIES
ORACLES = signals.ORACLES | byte_ops.ORACLES | models.ORACLES | library.ORACLES


def plain(row):
    return tuple(str(round(v, 5) + 0.0) if isinstance(v, float) and math.isfinite(v) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    db = duckdb.connect()
    for table in ("events", "lineitem", "documents", "embeddings"):
        place = f"{DATA}/{table}.parquet"
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{place}{'/*.parquet' if os.path.isdir(place) else ''}'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = db.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(plain, map(tuple, got.collect()))) == sorted(map(plain, want))


def test_top_pair_prefers_the_largest():
    assert byte_ops.top_pair(b"aa") is None
    assert byte_ops.top_pair(b"aaa") == (97, 97, 2)
    assert byte_ops.top_pair(b"") is None


def test_entropy_bounds():
    assert byte_ops.entropy(bytes(range(256))) == 8
    assert byte_ops.entropy(b"") == 0
    assert byte_ops.entropy(b"**") == 0


@pytest.mark.parametrize("name", sorted(set(models.QUERIES) - set(models.ORACLES)))
def test_runs_without_sql(spark, name):
    rows = models.QUERIES[name](spark, DATA).collect()
    assert rows and all(getattr(r, "exact", 1) == 1 for r in rows)


@pytest.mark.parametrize("data", [b"", b"x", b"abcabcabcabc", b"a" * 100, bytes(range(256)) * 2])
@pytest.mark.parametrize("window, lookahead", [(256, 32), (0, 32), (256, 0)])
def test_lz77_comes_back(data, window, lookahead):
    tokens = codecs.lz77_encode(data, window, lookahead)
    assert codecs.lz77_decode(tokens, len(data)) == data
    if not window or not lookahead:
        assert tokens == [(0, 0, b) for b in data]


def test_phrases_and_pairs():
    assert codecs.recent_phrases([b"a", b"b", b"a", b"c", b"d"], 3) == [b"b", b"c", b"d"]
    assert codecs.replace_pair(b"ababab", (97, 98), 88) == b"XXX"


def test_residuals_come_back():
    values = (100 * np.sin(np.arange(1000))).astype(np.float32)
    assert (codecs.unpack_lossless(codecs.pack_lossless(values)) == values).all()
    assert abs(codecs.unpack_quantised(codecs.pack_quantised(values)) - values).max() < 1
    assert abs(codecs.unpack_quantised(codecs.pack_quantised(values, 16)) - values).max() < 0.01
    assert len(codecs.unpack_quantised(codecs.pack_quantised(values[:0]))) == 0
    for bad, f in ((b"\x00abcdef", codecs.unpack_lossless), (b"abc", codecs.unpack_quantised)):
        with pytest.raises(ValueError):
            f(bad)
