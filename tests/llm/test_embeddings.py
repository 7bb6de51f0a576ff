"""Embedding near-duplicates against all pairs: recall, candidates, lengths, sizes of numbers, and components."""

import numpy as np
import pytest

from procframe.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label int"


def made(seed, n, d, mean, noise, labels):
    """Vectors around a shared mean, a third of them near copies of others."""
    deal = np.random.default_rng(seed)
    x = deal.normal(size=(n, d)) / np.sqrt(d)
    x += mean * np.ones(d) / np.sqrt(d)
    copies = n // 3
    x[:copies] = x[copies : 2 * copies] + noise * np.linalg.norm(x[copies : 2 * copies], axis=1, keepdims=True) * deal.normal(size=(copies, d)) / np.sqrt(d)
    return x, deal.integers(0, labels, n)


def pairs_of(x, label):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = np.triu((u @ u.T >= 0.98) & (label[:, None] == label[None]), 1)
    return set(zip(*(i.tolist() for i in np.nonzero(close)), strict=True))


def candidates(x, label):
    """Pairs that the keys bring together, without Spark."""
    coder, met = embeddings.Coder(embeddings.unit(x), len(x)), set()
    for one in set(label.tolist()):
        at = np.flatnonzero(label == one)
        width = int(embeddings.segment_width(np.array([len(at)]))[0])
        signs = coder.signs(embeddings.unit(x[at]))[:, : embeddings.SEGMENTS * width]
        for column in embeddings.keys(signs, width).T:
            order = np.argsort(column, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(column[order])) + 1):
                far = (signs[run][:, None] != signs[run][None]).sum(axis=2)
                met |= {tuple(sorted((int(at[run[i]]), int(at[run[j]])))) for i, j in zip(*np.nonzero(far < int(embeddings.FAR * signs.shape[1])), strict=True) if i < j}
    return met


@pytest.mark.parametrize("mean, noise", [(0.0, 0.14), (0.0, 0.18), (1.0, 0.1), (2.0, 0.08)])
def test_recall_and_candidates(mean, noise):
    x, label = made(1, 3000, 64, mean, noise, 2)
    wanted, met = pairs_of(x, label), candidates(x, label)
    assert len(wanted) > 200
    assert len(wanted & met) >= 0.9 * len(wanted)
    assert len(met) - len(wanted & met) < 0.02 * len(x) ** 2 / 4


def test_recall_where_most_are_linked():
    """The centre would leave noise alone."""
    deal = np.random.default_rng(3)
    x = np.ones(64) + 0.1 * deal.normal(size=(600, 64))
    wanted = pairs_of(x, np.zeros(600, int))
    assert len(wanted) > 100_000 and len(wanted & candidates(x, np.zeros(600, int))) >= 0.9 * len(wanted)


def test_the_query_finds_links_and_components(spark):
    x, label = made(2, 1200, 32, 0.5, 0.1, 3)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    wanted = pairs_of(x, label)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(wanted) and sum(r.n_links for r in got.values()) <= 2 * len(wanted)
    assert all(got[i].component_id <= i and (got[i].component_id == i) == got[i].kept for i in got)
    linked = {i for pair in wanted for i in pair}
    assert all(got[i].component_id == i and got[i].n_links == 0 for i in got if i not in linked)


def test_lengths_and_large_numbers(spark):
    rows = [(1, [1e300, 0.0], 1), (2, [1e200, 1e198], 1), (3, [0.0, 1e-300], 1), (4, [1.0, 0.0, 0.0], 1), (5, [1.0, 0.001, 0.0], 1), (6, [1.0, 0.0, 0.0], 1), (7, [1.0], 1), (8, [2.0], 1), (9, [-1.0], 1), (10, [], 1), (11, [None, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (2, 4, True), 5: (2, 4, False), 6: (2, 4, False), 7: (1, 7, True), 8: (1, 7, False), 9: (0, 9, True), 10: (0, 10, True), 11: (0, 11, True)}


def test_nulls_and_clashing_columns(spark):
    rows = [(None, [1.0, 0.0], "x", 1, 2), (3, [1.0, 0.0], "x", 1, 2), (3, [1.0, 0.0], "x", 1, 2), (4, None, "x", 1, 2), (5, [1.0, 0.0], None, 1, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, node int, v int")
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect())
    assert got == [(-1, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4), (5, 0, 5)]
