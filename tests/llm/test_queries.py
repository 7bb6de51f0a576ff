"""Whole operators against plain Python: sharding, toxicity, packing, SimHash, licences, and the stages of the pipeline.

Every table holds nulls, empty and very long texts, ties, repeated rows and columns whose names clash with inner ones.
"""

import heapq
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from procframe.llm import exact_dedup, licenses, near_copies, packing, pieces, sharding, simhash, toxicity
from procframe.llm.queries import vocabulary

EXTRA = ["key", "size", "rank", "fp", "sha", "node", "hash", "body", "held", "component", "shard", "row", "first"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} int" for c in EXTRA)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *range(len(EXTRA))) for r in rows], SCHEMA)


def texts(seed, n, words=400, low=3, high=60):
    pick = random.Random(seed)
    return [" ".join(f"w{int(pick.random() ** 2 * words)}" for _ in range(pick.randrange(low, high))) for _ in range(n)]


def corpus(seed=1, n=80):
    made = texts(seed, n)
    pick = random.Random(seed)
    near = []
    for t in made[:30]:
        words = t.split()
        words[pick.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    rows = list(enumerate(made + near + made[:10] + ["", "  \n\t", "one", "ONE", "\x1fx\x0b y\x0c", "é ü 漢字", "long " * 20_000]))
    return rows + [(200, None), (None, None), (None, made[3]), (3, made[3]), (3, made[3]), (201, made[-1] * 2)]


@pytest.mark.parametrize("f, schema", [(toxicity.score, "label"), (packing.pack, "vocabulary"), (pieces.round_trip, "model"), (near_copies.near_copies, ""), (near_copies.keep_one, "")])
def test_empty_tables(spark, f, schema):
    empty = spark.createDataFrame([], SCHEMA)
    more = {"label": [spark.createDataFrame([], "doc_id long, toxic int")], "vocabulary": [vocabulary("word_bpe_49k.json")], "model": [vocabulary("piece_bpe_32k.model")], "": []}[schema]
    assert f(empty, *more).count() == 0


def test_sharding(spark):
    rows = corpus()
    got = sharding.shard(frame(spark, rows), 5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    by_text = {}
    for r in got:
        by_text.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    heap = [0] * 5
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert sorted(sum(r["size"] for r in shards.get(s, [])) for s in range(5)) == sorted(heap)


def test_exact_dedup_by_brute_force(spark):
    rows = corpus(2)
    bare = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for found in groups.values():
        best = min(found)[3]
        want.update((i, best, len(found)) for *_, i in found)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()) == want


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash(spark):
    rows = corpus(3, 60)
    fps = [plain_fingerprint(t) for _, t in rows]
    # a chain of fingerprints beside the texts' own: words whose shingle hashes are what they are
    group = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, f"{fp:016x}", least.get(g)) for (i, _), fp, g in zip(rows, fps, group, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash(frame(spark, rows)).collect()) == want


def test_simhash_links_chosen_fingerprints(spark):
    """Links among fingerprints at distances 0 to 5 in both halves, with a signature beyond one block."""
    pick = random.Random(7)
    base = [pick.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for d in range(1, 6):
            fps.add(b ^ sum(1 << k for k in pick.sample(range(64), d)))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame_ = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.links(frame_).collect()]
    at = {f: i for i, f in enumerate(signed)}
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = roots(len(fps), [(at[a], at[b]) for a, b in links])
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a in range(len(fps)) for b in range(a))


def test_packing(spark):
    path = vocabulary("word_bpe_49k.json")
    rows = corpus(4)
    ids = {}
    tokenizer = Tokenizer.from_file(str(path))
    want = Counter((i, t or "") for i, t in rows)
    for t in {t or "" for _, t in rows}:
        ids[t] = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    got = packing.pack(frame(spark, rows), path).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == list(np.cumsum([0, *[r.length for r in held]])[:-1]) and sum(r.length for r in held) <= 4096
    assert sum(r.length for r in got) == sum(len(ids[t]) * n for (_, t), n in want.items())
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (i, t), n in want.items():
        whole = ids[t]
        mine = [r for r in by_doc[i] if r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *whole[r.start : r.start + r.length]))]
        for at in range(len(whole)):
            assert sum(r.start <= at < r.start + r.length for r in mine) >= n
    sizes = [sum(r.length for r in held) for held in by_sequence.values()]
    padded = [0 if s & (s - 1) == 0 else 4096 - s for s in sizes]
    assert sum(sorted(padded)[:-8]) < 0.02 * sum(sizes)


def test_licences_base_columns(spark):
    phrases = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
    said = ["CC BY", "cc-by 4.0", "General Public\nLicense", "ALL RIGHTS RESERVED.", "all rights all rights reserved", "xcc by", "cc by cc by cc by", "Licensed under the MIT license"]
    pick = random.Random(8)
    rows = corpus(5, 40) + [(300 + i, " ".join(pick.choice([*said, "word", "été", "1.0"]) for _ in range(pick.randrange(1, 9)))) for i in range(60)]
    rows.append((400, "filler " * 30_000 + "all rights reserved"))
    want = Counter()
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(at, label) for phrase, label in phrases for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        starts = [at for at, _ in places]
        want[(i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))] += 1
    got = licenses.scan(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_toxicity_learns_and_restores(spark):
    pick = random.Random(9)
    clean, bad = ["".join(pick.choice("abdefghiklmnoprstu") for _ in range(6)) for _ in range(60)], ["scumbrag", "vilejerk"]
    rows, labels = [], []
    for i in range(900):
        words = [pick.choice(clean) for _ in range(20)]
        toxic = i % 6 == 0
        if toxic:
            word = pick.choice(bad)
            words[pick.randrange(20)] = word if i % 12 else "".join({"e": "3", "u": "u", "i": "1", "a": "4"}.get(c, c) for c in word)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "scumbrag"), (2002, f"{clean[0]} " * 30_000), (0, rows[0][1])]
    marks = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(frame(spark, rows), marks, carry=("rank",)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r["rank"] == EXTRA.index("rank") for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    wrong = [r for r in held if r.predicted != truth[r.doc_id]]
    assert len(held) > 100 and len(wrong) <= 0.02 * len(held)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (2000, 2001, 2002)} == {2000: 0, 2001: 0, 2002: 0}
    assert [r.predicted for r in got if r.doc_id is None] == [1]


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset([b" ".join(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) > 5 else [b" ".join(words)] if words else [])


def test_keep_one_of_near_copies(spark):
    rows = corpus(6, 60)
    sets = [shingles(t) for _, t in rows]
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    group = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])])
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64) if t is not None else 42
    best = {}
    for (i, t), g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, (True, 0, 0, "")), (i is None, i or 0, int(signed(t)), t or ""))
    got = near_copies.keep_one(frame(spark, rows)).collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(b[:2] for b in best.values())
    assert all(r.asDict()[c] == i for r in got for i, c in enumerate(EXTRA))
