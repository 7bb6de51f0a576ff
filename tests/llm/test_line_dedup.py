"""Line dedup against every pair of lines, with repeated ids, nulls, ties, long lines and clashing columns."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from procframe.llm import line_dedup

BLANK = re.compile(r"[ \t\x0b\f\r]+")


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def expected(rows):
    """(text, n_lines, n_removed) of each row by comparing every line with every earlier one."""
    texts = [t or "" for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (-(2**63) if rows[r][0] is None else rows[r][0], signed(texts[r])))
    seen, copies, out = [], set(), {}
    for r in order:
        lines = texts[r].split("\n")
        copy = (rows[r][0], texts[r]) in copies
        copies.add((rows[r][0], texts[r]))
        stays = []
        for line in lines:
            words = {w for w in BLANK.split(line) if w}
            if not words:
                stays.append(line)
                continue
            similar = copy or any(5 * len(words & s) >= 4 * len(words | s) for s in seen)
            if not similar:
                stays.append(line)
            seen.append(words)
        out[r] = ("\n".join(stays), len(lines), len(lines) - len(stays))
    return sorted((-(2**63) if rows[r][0] is None else rows[r][0], *out[r]) for r in range(len(rows)))


def got(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame).collect())


def deal(seed, n, base=25, words=40):
    pick = random.Random(seed)
    bases = [[f"w{pick.randrange(words)}" for _ in range(pick.randrange(1, 14))] for _ in range(base)]

    def line():
        found = list(pick.choice(bases))
        for _ in range(pick.randrange(3)):
            found[pick.randrange(len(found))] = f"w{pick.randrange(60)}"
        return pick.choice([" ", "  ", "\t", "\r "]).join(found)

    return ["\n".join(line() for _ in range(pick.randrange(5))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    texts = deal(seed, 60)
    rows = [(i // 2, t) for i, t in enumerate(texts)]  # two texts to an id
    rows += [(None, texts[0]), (None, None), (3, None), (7, ""), (8, "\n \n\t"), rows[5], rows[5], (99, " ".join(f"w{i}" for i in range(5000)) + "\nend")]
    assert got(spark, rows) == expected(rows)


def test_hot_group(spark, monkeypatch):
    """Over HOT lines of one group, most found in the first round, and lines beyond its hubs."""
    monkeypatch.setattr(line_dedup, "HOT", 64)
    pick = random.Random(5)
    base = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(3 * line_dedup.HOT):
        words = list(base)
        for _ in range(pick.randrange(4)):
            words[pick.randrange(20)] = f"x{pick.randrange(500)}"
        rows.append((i, " ".join(words)))
    assert got(spark, rows) == expected(rows)


def test_repeated_ids(spark):
    rows = [(1, "p q r"), (2, "p q r\nzzz"), (2, "k l m\np q r")]
    assert got(spark, rows) == expected(rows)
    assert sum(r[1].count("p q r") for r in got(spark, rows)) == 1


def test_clashing_columns(spark):
    names = ["doc", "tag", "kept", "row", "lines", "id", "no", "at", "__kept"]
    frame = spark.createDataFrame([(1, "a b\na b", 9, *range(len(names)))], "doc_id long, text string, n_lines int, " + ", ".join(f"{c} int" for c in names))
    (found,) = line_dedup.dedup_lines(frame).collect()
    assert found.asDict() == {"doc_id": 1, "text": "a b", "n_lines": 2, "n_removed": 1, **{c: i for i, c in enumerate(names)}}


def test_the_table_of_ranks_stays_short_in_the_plan(spark, monkeypatch):
    """The driver keeps the text of each plan, in several forms."""
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: df)
    docs = spark.createDataFrame([(i, f"w{i} some words of a line\nw{i} of another") for i in range(200)], "doc_id long, text string")
    plan = line_dedup._classes(docs)._jdf.queryExecution().toString()
    assert len(plan) < 40 * line_dedup.CELLS


def test_rounds_by_size_find_each_pair_once(spark):
    """Sets around the border of the two rounds; none shuffles the prefixes of all sizes."""
    pick = random.Random(9)
    texts = []
    for _ in range(30):
        words = [f"w{i}" for i in pick.sample(range(4000), 50)]
        texts += [" ".join(words[:n]) for n in (40, 44, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = line_dedup._classes(docs).withColumn("open", F.lit(True))
    middle = line_dedup._middle(classes)
    assert 40 < middle <= 60
    for border in (middle, 44, 45):
        rounds = [[tuple(sorted(r)) for r in line_dedup._rest(classes, *sizes).collect()] for sizes in ((1, border), (border, 1 << 40))]
        found = [pair for pairs in rounds for pair in pairs]
        assert len(found) == len(set(found))
        sets = [set(t.split()) for t in texts]
        ids = [signed(t) for t in texts]
        similar = {tuple(sorted((ids[i], ids[j]))) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        assert len(similar) >= 90 and similar <= set(found)


def test_a_text_is_joined_with_its_kept_lines_once(spark):
    """The shuffle to the kept lines holds the row, which has the text, and no second copy of it."""
    plan = line_dedup.dedup_lines(spark.createDataFrame([(1, "a b\na b")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert plan.left().output().size() == 3  # row, doc, tag


def test_words_are_taken_from_a_text_made_flat_once(spark):
    docs = spark.createDataFrame([(1, "a b\nc\td\x0b \r\n")], "doc_id long, text string")
    words = line_dedup._words(docs)
    assert sorted(r.w for r in words.collect()) == ["a", "b", "c", "d"]
    assert words._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 1
