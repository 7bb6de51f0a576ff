"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model's pieces were merged pair by pair, best score first and leftmost on ties. A sequence of pieces is what merging
yields exactly if each neighbouring pair is (merging the pair's own text gives that pair back). So the one admissible
path to each position follows from the positions at most the longest piece before it: among the pieces that end there,
the one that may stand behind the path's last piece. The pass keeps a backpointer for each position of a window of that
length. As soon as the backpointer paths of all positions that a later piece can still start from run through one
boundary, the ids before it are committed and forgotten; memory doesn't grow with the text.

No piece crosses from another character to a word mark, so every path runs through each word's start, and through both
sides of a character that the model lacks (which is coded as bytes). Stretches between such boundaries are encoded each
on its own, short ones once per worker.

Decoding returns the text exactly. The word mark itself (U+2581) in a text is coded as bytes, so that it isn't taken for
a blank. Null texts count as empty and have no ids. Extra columns are ignored; repeated rows are coded each.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
#: Stretches that a Python worker remembers.
CACHE = 1 << 20

_workers: dict[str, Model] = {}


class Model:
    """Pieces, scores and byte ids of a SentencePiece model of type BPE."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.out: list[bytes] = []
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                self.piece[piece] = i
                self.score[piece] = sp.get_score(i)
                self.out.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("a piece holds a word mark behind another character")
        self.longest = max(map(len, self.piece))
        self.chars = {x for x in self.piece if len(x) == 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spines: dict[str, tuple[list[str], list[str]] | None] = {}
        self.starts: dict[str, bytes] = {}  # at a line's start, without a word mark
        self.words: dict[str, bytes] = {}  # behind one blank

    def merged(self, text: str) -> tuple[list[str], list[str], list[str]]:
        """Merge a short text pair by pair: its pieces, and the first and the last piece after each change to them."""
        parts = list(text)
        first, last = [parts[0]], [parts[-1]]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts, first, last
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                first.append(parts[0])
            if at == len(parts) - 1:
                last.append(parts[-1])

    def spine(self, piece: str) -> tuple[list[str], list[str]] | None:
        """How a piece's first and last part grow as it's merged; none if merging its text doesn't give the piece."""
        if piece not in self.spines:
            parts, first, last = self.merged(piece)
            self.spines[piece] = (first, last) if len(parts) == 1 else None
        return self.spines[piece]

    def may_follow(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.stays(a, b)
        return found

    def stays(self, a: str, b: str) -> bool:
        """Whether no merge across the boundary of a and b comes before the merges that make them up."""
        if MARK * 2 in a or MARK * 2 in b:  # marks in a row share one score, so there position decides as well
            return self.merged(a + b)[0] == [a, b]
        left, right = self.spine(a), self.spine(b)
        if left is None or right is None:
            return False
        score, ends, starts = self.score, left[1], right[0]
        i = j = 0
        none = float("-inf")
        while True:
            next_a = score[ends[i + 1]] if i + 1 < len(ends) else none
            next_b = score[starts[j + 1]] if j + 1 < len(starts) else none
            across = score.get(ends[i] + starts[j])
            if across is not None and across > next_a and across >= next_b:
                return False
            if next_a == next_b == none:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def extend(self, window: str, last: list[str], behind: str) -> None:
        """The piece that ends the path to each further position of the window; "" where none does."""
        piece, pairs, longest = self.piece, self.pairs, self.longest
        for n in range(len(last), len(window) + 1):
            found = ""
            for at in range(n - longest if n > longest else 0, n):
                candidate = window[at:n]
                if candidate in piece:
                    before = last[at] if at else behind
                    if before:
                        good = pairs.get((before, candidate))
                        if self.may_follow(before, candidate) if good is None else good:
                            found = candidate
                            break
                    elif not at and self.spine(candidate) is not None:
                        found = candidate
                        break
            last.append(found)

    def stream(self, blocks: Iterable[str]) -> Iterator[int]:
        """Ids of blocks of text (blanks as word marks), committed as early as the paths allow."""
        longest, piece = self.longest, self.piece
        window, last, behind = "", [""], ""  # what isn't committed, its paths' last pieces, the last committed piece
        for block in blocks:
            at = 0
            while at < len(block):
                end = at
                while end < len(block) and end < at + 2 * longest and block[end] in piece:
                    end += 1
                window += block[at:end]
                self.extend(window, last, behind)
                if end == at:  # a character that the model lacks
                    yield from self.path(window, last)
                    yield from self.bytes_of(block[at])
                    window, last, behind, end = "", [""], "", at + 1
                elif len(window) > longest and (start := self.common(last, len(window) - longest + 1)):
                    yield from self.path(window[:start], last[: start + 1])
                    behind, window, last = last[start], window[start:], ["", *last[start + 1 :]]
                at = end
        yield from self.path(window, last)

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[x] for x in char.encode()]

    def common(self, last: list[str], least: int) -> int:
        """The latest boundary that the paths to all positions from `least` on run through."""
        at = {i for i in range(least, len(last)) if last[i]}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - len(last[far]))
        return at.pop() if at else 0

    def path(self, window: str, last: list[str]) -> list[int]:
        out, i = [], len(window)
        while i:
            if not last[i]:
                raise ValueError(f"no path to the end of {window!r}")
            out.append(self.piece[last[i]])
            i -= len(last[i])
        return out[::-1]

    def code(self, stretch: str) -> bytes:
        """Ids of a stretch as bytes; one that the window holds whole needs no commit before its end."""
        if len(stretch) <= self.longest and self.chars.issuperset(stretch):
            last = [""]
            self.extend(stretch, last, "")
            return array("I", self.path(stretch, last)).tobytes()
        return array("I", self.stream((stretch,))).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text with a blank put in front."""
        if not text:
            return np.zeros(0, "<u4")
        parts: list[bytes] = []
        newline = self.code("\n")
        for known in (self.starts, self.words):
            if len(known) > CACHE:
                known.clear()
        words = self.words
        for i, line in enumerate(text.split("\n")):
            if i:
                parts.append(newline)
            found = line.split(" ")
            if MARK in line or "" in found:
                parts += self.slowly(line if i else " " + line)
                continue
            first = self.starts if i else words
            if (word := found[0]) not in first:
                first[word] = self.code(word if i else MARK + word)
            parts.append(first[word])
            if len(found) > 1:
                rest = found[1:]
                for word in set(rest).difference(words):
                    words[word] = self.code(MARK + word)
                parts += [words[w] for w in rest]
        return np.frombuffer(b"".join(parts), "<u4")

    def slowly(self, line: str) -> list[bytes]:
        """A line with blanks in a row or word marks of its own, which are coded as bytes."""
        out = []
        for blanks, word, mark in re.findall(rf"( *)([^ {MARK}]*)({MARK}?)", line):
            out.append(self.code(MARK * len(blanks) + word) if blanks or word else b"")
            if mark:
                out.append(array("I", self.bytes_of(MARK)).tobytes())
        return out

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        return b"".join([out[i] for i in ids.tolist()]).decode()[1:]


def model_of(path: str) -> Model:
    if path not in _workers:
        _workers[path] = Model(path)
    return _workers[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            ids = [m.encode(x or "").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    bounded_batches(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            texts = [m.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


ROUND_TRIP = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, exact boolean"


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode each whole text in one pass: see ROUND_TRIP; crc32 of little-endian uint32 ids and of UTF-8."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                ids = m.encode(x or "")
                text = m.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(text.encode()), text == (x or "")))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "exact"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROUND_TRIP)
