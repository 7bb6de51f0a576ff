"""Order-preserving packing by dynamic programming.

Documents stay in the order of their rows. In each partition the token stream is cut into windows of at most `length`
tokens, at document ends, sentence ends or, where a stretch has neither, inside a sentence. A window costs its padding
(none if its length is a power of two, else up to `length`) and the penalty of the cut that ends it:

    best[j] = penalty[j] + min over i, pos[j] - length <= pos[i] < pos[j], of best[i] + padding(pos[j] - pos[i])

As padding is length - pos[j] + pos[i] outside the powers of two, the minimum of best[i] + pos[i] over a sliding window
is kept in a monotone queue; the powers of two are looked up one by one. So each cut point costs amortised O(1) plus the
powers, and the stream is handled in blocks of about `BLOCK` tokens whose last window may end anywhere.

Null texts count as empty: they have the end token alone. Repeated rows are packed each. Extra columns are ignored. An
empty table gives no piece. A document that lies in several windows gives a piece for each.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

LENGTH = 4096
END = 2
#: What a cut costs, in tokens of padding: behind a sentence, and inside one. Behind a document it costs nothing.
SENTENCE_CUT, INNER_CUT = 24, 192
#: Tokens that are cut up at once; bounds the memory of a task whatever its partition holds.
BLOCK = 1 << 18
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 1 << 20
CACHE_TAILS = 1 << 14
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_workers: dict[str, tuple] = {}


#: A word of one pre-token of Latin-1 letters, and the run of ASCII punctuation behind it, if any: another pre-token.
SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*)")


class Words:
    """Token ids of whole texts by a vocabulary whose pre-tokeniser never joins what ASCII white space parts.

    A text's ids are then those of its white-space-separated words, which are remembered as little-endian uint32. Words
    that are letters and then punctuation go to the merges directly, part by part, past the normaliser and pre-tokeniser.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.enders = np.zeros(max(vocabulary.values()) + 1, bool)
        self.enders[[i for piece, i in vocabulary.items() if piece.endswith("</w>") and piece[:-4].rstrip(".!?") != piece[:-4] and not piece[:-4].rstrip(".!?\"')]}").isalnum()]] = True
        self.known: dict[bytes, bytes] = {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(33, 256) if chr(c).isprintable()]
        self.spelt = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.merged = self.tokenizer.model.tokenize
        self.tails: dict[str, bytes] = {}

    def _part(self, text: str) -> bytes:
        return np.array([t.id for t in self.merged(text.lower().translate(self.spelt))], "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        known, tails, others = self.known, self.tails, []
        for word in new:
            if (m := SIMPLE.fullmatch(word.decode())) is None:
                others.append(word)
                continue
            core, tail = m.groups()
            ids = self._part(core)
            if tail:
                if tail not in tails:
                    if len(tails) > CACHE_TAILS:
                        tails.clear()
                    tails[tail] = self._part(tail)
                ids += tails[tail]
            known[word] = ids
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[word] = np.array(found.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [text.encode().split() for text in texts]
        if len(self.known) > CACHE_WORDS:  # common words come early: forget those that came last
            self.known = dict(islice(self.known.items(), CACHE_WORDS // 2))
        self._learn(list(set().union(*split).difference(self.known)))
        found = self.known.__getitem__
        return [np.frombuffer(b"".join(map(found, words)), "<u4") for words in split]


def words_of(path: str) -> Words:
    if path not in _workers:
        _workers[path] = Words(path)
    return _workers[path]


def cuts(positions: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indices of the chosen cut points; positions rise from 0 by steps of at most `length`, and both ends are chosen."""
    n = len(positions)
    pos, pen = positions.tolist(), penalties.tolist()
    exact: list[list[int]] = [[] for _ in range(n)]
    power = 1
    while power <= length:
        at = np.searchsorted(positions, positions - power)
        hit = np.flatnonzero((positions >= power) & (positions[np.minimum(at, n - 1)] == positions - power))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            exact[j].append(i)
        power *= 2
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    keys = [0] * n
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        value = keys[i] + length - p
        for x in exact[j]:
            if best[x] <= value:
                value, i = best[x], x
        best[j], back[j] = value + pen[j], i
        key = keys[j] = best[j] + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def cut_points(ids: np.ndarray, ends: np.ndarray, enders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, and what it costs; ends: rising positions behind documents, the last behind all."""
    sentence = np.flatnonzero(enders[np.minimum(ids, len(enders) - 1)]) + 1
    natural = np.union1d(sentence, ends)
    if not len(natural) or natural[0] != 0:
        natural = np.concatenate([[0], natural])
    # inside a sentence: every `length` / 2 tokens from its start, and the powers of two before the next natural cut
    gaps = np.diff(natural)
    long = np.flatnonzero(gaps > length // 2)
    inner = [np.arange(natural[g] + length // 2, natural[g + 1], length // 2) for g in long]
    last = int(ends[-1])
    tail = last - np.cumsum([0, *[1 << b for b in range(length.bit_length() - 1)]])
    points = np.unique(np.concatenate([natural, *inner, tail[tail > 0]]))
    penalties = np.full(len(points), INNER_CUT)
    penalties[np.isin(points, sentence)] = SENTENCE_CUT
    penalties[np.isin(points, ends)] = 0
    penalties[0] = 0
    return points, penalties


def _pack(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int) -> Iterator[pa.RecordBatch]:
    words = words_of(path)
    held: list[tuple[int | None, np.ndarray, int]] = []  # id, tokens still to place, tokens placed before
    total = sequences = 0
    partition = TaskContext.get().partitionId()

    def place() -> pa.RecordBatch:
        nonlocal total, sequences
        ids = np.concatenate([x for _, x, _ in held])
        ends = np.cumsum([len(x) for _, x, _ in held])
        points, penalties = cut_points(ids, ends, words.enders, length)
        chosen = points[cuts(points, penalties, length)]
        bounds = np.union1d(chosen, ends)
        bounds = bounds[bounds > 0]
        starts = np.concatenate([[0], bounds[:-1]])
        window = np.searchsorted(chosen, starts, "right") - 1
        owner = np.searchsorted(ends, starts, "right")
        first = np.concatenate([[0], ends[:-1]])
        whole = [len(x) + before for _, x, before in held]
        raw = ids.astype("<u4")
        out = pa.record_batch(
            [
                pa.array([held[o][0] for o in owner.tolist()], pa.int64()), pa.array(starts - first[owner] + np.array([before for _, _, before in held])[owner]), pa.array(bounds - starts),
                pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts.tolist(), bounds.tolist(), strict=True)], pa.int64()), pa.array(np.array(whole)[owner]),
                pa.array((partition << 40) + sequences + window), pa.array(starts - chosen[window]),
            ],
            names=[x.split()[0] for x in PIECES.split(", ")],
        )
        sequences += len(chosen) - 1
        held.clear()
        total = 0
        return out

    for batch in batches:
        texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
        for doc, ids in zip(batch.column(0).to_pylist(), words.ids(texts), strict=True):
            held.append((doc, np.append(ids, np.uint32(end)), 0))
            total += len(ids) + 1
            if total >= BLOCK:
                yield place()
    if held:
        yield place()


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece of a document in a window: see PIECES. sequence_id rises with the order of the rows."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _pack(batches, tokenizer, length, end), PIECES)
