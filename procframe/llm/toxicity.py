"""Toxicity by noisy-channel deobfuscation.

Writers hide words behind digits and signs (id10t), spacing (i d i o t, i.d.i.o.t) and repetition (idiiiot). A token that
shows such signs is a noisy observation: each of its characters may stand for itself, for letters that look like it, for
a repeated letter, or for nothing. These choices form a lattice; Viterbi decoding under a character trigram model picks
the likeliest word. The model's counts come from all texts, so they grow with the corpus; its table has a fixed size.

The restored text is scored by a ridge logistic regression over character 5-grams within words and the first bytes of words
(abuse in some languages is marked by how words begin, and by their number): a feature is that a text holds such a string
once, or LEVELS times. It is fitted on a sample of at most about SAMPLE_ROWS labelled rows whose crc32(doc_id) mod 5 isn't 0;
which strings it may use follows from their likelihood ratio there. Score 0 to 1; predicted is score >= 0.5.

Null and empty texts hold no such string and get the score of the intercept. Rows without an id are scored and count as not
held out. Repeated label rows count once, the largest label. Without labels of both kinds every score is the share of
toxic labels. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import bounded_batches, materialise

#: Labelled rows that the classifier is fitted on, about; drawn by a hash of the id.
SAMPLE_ROWS = 20_000
#: Strings that the classifier may use, and the likelihood ratio (G squared) that each needs.
FEATURES, LEAST_RATIO = 384, 30.0
GRAM, START = 5, 6
LEVELS = (1, 3)
RIDGE = 0.05
#: Tokens that a Python worker remembers.
CACHE = 1 << 20
#: Letters that a sign is written for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h",
}
#: Costs (minus log probabilities) of the channel.
LEET, SEPARATOR, UNREAD, TRAILING, REPEAT, DOUBLE = 0.7, 0.3, 9.0, 1.0, 0.2, 6.0
SIZE = 28  # boundary, a to z, any other byte
_CODE = np.full(256, 0, np.int64)
_CODE[np.arange(97, 123)] = _CODE[np.arange(65, 91)] = np.arange(1, 27)
_CODE[128:] = 27
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_SIGNS = re.escape("".join(x for x in LOOKS_LIKE if not x.isdigit())).encode()
_ODD = re.compile(rb"[a-z][0-9%s*._~\-]+[a-z]|([a-z])\1\1|([a-z])\2([a-z])\3([a-z])\4|^[0-9%s]+[a-z]{2}|[a-z]{2}[0-9@$|+]+$" % (_SIGNS, _SIGNS))
_EDGES = b"\"'.,;:?*%&#()[]{}<>~_-=/\\"
_SPACED = re.compile(rb"(?<![^ ])(?:[a-z0-9%s][.*~_\-]? ){3,}[a-z0-9%s](?![^ ])" % (_SIGNS, _SIGNS))


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of character trigrams, with boundaries around words."""
    codes = _CODE[np.frombuffer(b" " + text + b" ", np.uint8)]
    return np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3) if len(codes) > 2 else np.zeros(SIZE**3, np.int64)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Minus log P(c | a, b), interpolated with the bigram and the letter."""
    n3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + SIZE)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


def decode(token: str, cost: list[list[list[float]]]) -> str:
    """The likeliest word behind a lower-case token; characters above ASCII stand for themselves."""
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before, run, letters_end = "", 0, len(token.rstrip("".join(LOOKS_LIKE)))
    for i, c in enumerate(token):
        run = run + 1 if c == before else 1
        after = token[i + 1 : i + 2]
        before = c
        if c.isalpha():
            choices = [(c, 0.0)]
            if run > 1:
                choices.append(("", REPEAT if run > 2 or after == c else DOUBLE))
        else:
            choices = [(x, LEET) for x in LOOKS_LIKE.get(c, "")]
            if c.isdigit() or c in LOOKS_LIKE:
                choices.append(("", TRAILING if i >= letters_end else UNREAD if run == 1 else REPEAT))
            else:
                choices.append(("", SEPARATOR))
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (so_far, word) in paths.items():
            row = cost[a][b]
            for x, penalty in choices:
                if x:
                    code = ord(x) - 96 if "a" <= x <= "z" else 27
                    key, value, out = (b, code), so_far + penalty + row[code], word + x
                else:
                    key, value, out = (a, b), so_far + penalty, word
                if key not in new or value < new[key][0]:
                    new[key] = (value, out)
        paths = new
    return min((value + cost[a][b][0], word) for (a, b), (value, word) in paths.items())[1]


class Restorer:
    """Texts with their obfuscated tokens decoded: lower case, words parted by one blank, a blank at either end."""

    def __init__(self, counts: np.ndarray):
        self.cost = language_model(counts).tolist()
        self.seen: set[bytes] = set()
        self.restored: dict[bytes, bytes] = {}

    def learn(self, tokens: set[bytes]) -> None:
        if len(self.seen) > CACHE:
            self.seen.clear()
            self.restored.clear()
        new = tokens.difference(self.seen)
        self.seen |= new
        for token in new:
            core = token.strip(_EDGES).rstrip(b"!")
            if _ODD.search(core):
                self.restored[token] = decode(core.decode(errors="replace"), self.cost).encode()

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").encode().lower().split()
        unique = set(words)
        self.learn(unique)
        if not self.restored.keys().isdisjoint(unique):
            restored = self.restored
            words = [restored.get(w, w) for w in words]
        joined = b" ".join(words)
        joined = _SPACED.sub(lambda m: decode(m[0].decode(), self.cost).encode(), joined)
        return b" " + joined.translate(_PLAIN) + b" "


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += trigram_counts((x.as_py() or "").encode())
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; the table that reaches the driver has 28^3 numbers whatever the corpus."""
    found = docs.select("text").mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3, np.int64)
    out[found["gram"]] = found["n"]
    return out


def grams(text: bytes) -> set[bytes]:
    """5-grams that lie within a word and its boundaries, and the first START bytes of words after a boundary."""
    inner = {g for g in {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} if b" " not in g[1:-1]}
    return inner | {b" " + w[:START] for w in set(text.split()) if len(w) >= START}


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(grams(text))
    names = list(toxic.keys() | clean.keys())
    for at in range(0, len(names), 100_000):
        part = names[at : at + 100_000]
        yield pa.record_batch([pa.array(part, pa.binary()), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], names=["gram", "t", "c"])


class Features:
    """Indices of the features of a restored text: of the known strings, by how often it holds each."""

    def __init__(self, lexicon: list[bytes]):
        import ahocorasick

        self.automaton, self.n = ahocorasick.Automaton(), len(lexicon)
        for i, gram in enumerate(lexicon):
            self.automaton.add_word(gram.decode("latin-1"), i)
        if lexicon:
            self.automaton.make_automaton()

    def __call__(self, text: bytes) -> list[int]:
        if not self.n:
            return []
        found = Counter(i for _, i in self.automaton.iter(text.decode("latin-1")))
        return [level * self.n + i for level, least in enumerate(LEVELS) for i, held in found.items() if held >= least]


def fit(row: np.ndarray, feature: np.ndarray, labels: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps: weights and intercept. `row` has `feature`, pair by pair, of n features."""
    x = np.zeros((len(labels), n + 1), np.float32)
    x[:, n] = 1
    x[row, feature] = 1
    share = (labels.sum() + 0.5) / (len(labels) + 2)
    w = np.zeros(n + 1)
    w[n] = np.log(share / (1 - share))
    if n and 0 < labels.sum() < len(labels):
        ridge = np.append(np.full(n, RIDGE * max(1.0, np.sqrt(len(labels) / 1000))), 1e-6)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(float)))
            curved = ((x * (p * (1 - p) + 1e-9)[:, None].astype(np.float32)).T @ x).astype(float) + np.diag(ridge)
            step = np.linalg.solve(curved, x.T @ (labels - p).astype(np.float32) - ridge * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-3:
                break
    return w[:n], float(w[n])


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels has doc_id and toxic.

    Columns named in `carry` come along, each row with its own, so that a filter by score needs no join.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    counts = spark.sparkContext.broadcast(corpus_counts(rows))

    known = labels.where("doc_id is not null and toxic is not null").where(remainder != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialise(known, "labels")
    share = min(1.0, sample_rows / max(1, known.count()))
    drawn = F.broadcast(known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)))

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([restorer(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["toxic", "body"])

    sample = rows.join(drawn, "doc_id").select("toxic", "text").mapInArrow(restore, "toxic int, body binary").dropDuplicates(["body"])
    sample = materialise(sample, "sample")
    total = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = float(total.t), float(total.n - total.t)
    found = sample.mapInArrow(_gram_counts, "gram binary, t long, c long").groupBy("gram").agg(F.sum("t").cast("double").alias("t"), F.sum("c").cast("double").alias("c"))
    term = lambda seen, of, base: F.when(seen > 0, seen * F.log(seen / (of * base))).otherwise(0.0)
    base_t, base_c = max(toxic, 0.5) / max(1.0, toxic + clean), max(clean, 0.5) / max(1.0, toxic + clean)
    t, c = F.col("t"), F.col("c")
    absent = F.lit(toxic + clean) - t - c
    ratio = 2 * (term(t, t + c, base_t) + term(c, t + c, base_c) + term(F.lit(toxic) - t, absent, base_t) + term(F.lit(clean) - c, absent, base_c))
    chosen = found.where(t * clean > c * toxic).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "gram").limit(FEATURES)
    lexicon = [bytes(r.gram) for r in chosen.select("gram").collect()]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([features(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["toxic", "found"])

    train = sample.mapInArrow(featured, "toxic int, found array<int>").toArrow()
    row, feature = pc.list_parent_indices(train.column("found").combine_chunks()).to_numpy(), pc.list_flatten(train.column("found").combine_chunks()).to_numpy()
    weights, intercept = fit(row, feature, train.column("toxic").to_numpy().astype(float), len(LEVELS) * len(lexicon))
    del train, row, feature

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, features = Restorer(counts.value), Features(lexicon)
        for batch in batches:
            z = np.array([intercept + weights[features(restorer(x))].sum() for x in batch.column(1).to_pylist()], float)
            along = [batch.column(2)] if carry else []
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50)))), *along], names=["doc_id", "score", "along"][: 2 + len(along)])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*carry).alias("along")] if carry else []))
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *own.schema.fields[2:]])
    out = own.mapInArrow(scored, schema)
    return out.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"along.`{c}`").alias(c) for c in carry])
