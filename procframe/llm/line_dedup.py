"""Line deduplication by an exact set-similarity join.

A line is the set of its words (parts between the six ASCII blanks). Lines of equal text are one class, placed at its first
line. The words of a class are ordered by rarity: the logarithm of their cell's count, in a table of CELLS counts over all
lines of the corpus, then their hash. Two sets of Jaccard similarity 0.8 or more share a word in their prefixes of
n - ceil(0.8 n) + 1 words. Classes meet on those words, in two
rounds by the size of the smaller set, are held to the length and positional filters, to a parity map of 64
bits, 128 for long ones (the sets differ in at least as many words as their maps differ in bits) and to the number of words their prefixes
share, and the pairs left are verified on the words of the lines themselves. A line goes if an earlier line is similar to
it, whether or not that one stays.

One earlier line is enough. In a large group of similar lines many share one of the FEW words that a hash picks from each
prefix; where more than HOT classes do, each first meets the earliest classes (PARTS at most) under that word. Classes found
gone there need no further look; the others meet all classes, so a large group isn't compared pair by pair.

All of it is DataFrame operations; coding lines in Arrow batches instead took more CPU (figures in the README).

Null texts count as empty. Lines without words stay. Order is by doc_id (null first), then by a hash of the text among rows
that share an id, then by line; of rows with equal id and text one keeps the lines that stay, the others lose every line with
words. Extra columns pass through, but an input column n_lines or n_removed gives way to the result's. An empty table stays
empty. Lines are told apart by 96 bits of two hashes.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

#: Cells of the table of counts: a literal of so many short numbers in the plan, whatever the corpus.
CELLS = 1 << 16
#: Ranks to a doubling of a cell's count.
STEPS = 16
#: Words from which a set has a parity map of 128 bits instead of 64.
LONG = 96
#: Words of a class by which hot groups are found, classes that make one, and earliest classes that each then meets.
FEW, HOT, PARTS = 3, 512, 8
#: The id that stands for null.
NULL = -(2**63)
#: Hot words, or ids of lines to verify, up to which their list is broadcast; beyond, a shuffled join.
BROADCAST = 1 << 20
#: Blanks within a line, but for the plain one.
ODD = "\t\x0b\f\r"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keys() -> list[Column]:
    """A row's place in the order: id, then a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("doc"), F.xxhash64(_text()).alias("tag")]


def _worded(line: Column) -> Column:
    return F.btrim(line, F.lit(" " + ODD)) != ""


def _split(line: Column) -> Column:
    """Words of a line, and empty ones."""
    odd = F.contains(line, F.lit(ODD[0]))
    for blank in ODD[1:]:
        odd |= F.contains(line, F.lit(blank))
    return F.split(F.when(odd, F.translate(line, ODD, " " * len(ODD))).otherwise(line), " ")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, tag, no, line, id, id2) of every line with words."""
    each = docs.select(*_keys(), F.posexplode(F.split(_text(), "\n")).alias("no", "line"))
    return each.where(_worded(F.col("line"))).select("*", F.xxhash64("line").alias("id"), F.hash("line").alias("id2"))


def _words(docs: DataFrame) -> DataFrame:
    """(w): every word of every text."""
    # exploded from an array of one, as `_split` looks at its argument several times
    flat = docs.select(F.explode(F.array(F.replace(_text(), F.lit("\n"), F.lit(" ")))).alias("flat"))
    return flat.select(F.explode(_split(F.col("flat"))).alias("w")).where("w <> ''")


def _ranks(docs: DataFrame) -> list[int]:
    """For each cell of words its place in the order of counts: STEPS to a doubling, so that a table in the plan stays short."""
    cells = _words(docs).groupBy(F.xxhash64("w").bitwiseAND(CELLS - 1).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    found = cells.toArrow()  # CELLS rows at most, whatever the corpus
    ranks = [0] * CELLS
    for cell, n in zip(found["cell"].to_pylist(), found["n"].to_pylist(), strict=True):
        ranks[cell] = int(STEPS * math.log2(n))
    return ranks


def _classes(docs: DataFrame) -> DataFrame:
    """(id, id2, at, n, map, map2, prefix): each line text once, with its first place (doc, tag, no)."""
    ranks, zero, one = _ranks(docs), F.lit(0).cast("long"), F.lit(1).cast("long")
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<long>")
    left = lambda x, by: F.call_function("shiftleft", x, by)
    # the rank stands for the hash's low 16 bits: a code names its hash
    rank = lambda h: left(F.coalesce(F.get(table, h.bitwiseAND(CELLS - 1).cast("int")), zero), F.lit(48))
    codes = F.transform(F.transform(_split(F.col("line")), lambda w: F.xxhash64(w)), lambda h: F.shiftrightunsigned(h, 16).bitwiseOR(rank(h)))
    none = xxhash.xxh64_intdigest(b"", 42)
    # each exploded from an array of one, so that what follows doesn't compute it again, and sorts and sets are compiled code
    coded = _lines(docs).select("doc", "tag", "no", "id", "id2", F.explode(F.array(codes)).alias("c"))
    ordered = F.array_remove(F.array_distinct(F.sort_array("c")), F.lit(none >> 16 | ranks[none % CELLS] << 48))
    coded = coded.select("doc", "tag", "no", "id", "id2", F.explode(F.array(ordered)).alias("s")).withColumn("n", F.size("s"))
    # XOR of a bit for each code: of all of them, and, for sets that are LONG, of those that have bit 6
    every = F.aggregate("s", zero, lambda a, x: a.bitwiseXOR(left(one, x.bitwiseAND(63).cast("int"))))
    high = F.aggregate("s", zero, lambda a, x: a.bitwiseXOR(left(F.shiftright(x, 6).bitwiseAND(one), x.bitwiseAND(63).cast("int"))))
    prefix = F.transform(F.expr("slice(s, 1, n - cast(ceil(0.8 * n) as int) + 1)"), lambda x: F.hash(x))
    coded = coded.select("doc", "tag", "no", "id", "id2", "n", every.alias("map"), F.when(F.col("n") >= LONG, high).otherwise(zero).alias("map2"), prefix.alias("prefix"))
    same = [F.first(c).alias(c) for c in ("n", "map", "map2", "prefix")]
    return materialise(coded.groupBy("id", "id2").agg(F.min(F.struct("doc", "tag", "no")).alias("at"), *same), "classes")


def _later(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, id2): the later class of each pair (x, y) of ids that is similar. `pairs` must be written already."""
    ids = materialise(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "ids")
    ids = small(ids, ids.count(), BROADCAST)
    texts = _lines(docs).join(ids, "id", "left_semi").groupBy("id", "id2").agg(F.min("line").alias("line"))
    placed = classes.select("id", "id2", "at").join(ids, "id", "left_semi")
    lines = texts.join(placed, ["id", "id2"]).select("id", "id2", "at", F.array_remove(F.array_distinct(_split(F.col("line"))), "").alias("words"))
    lines = materialise(lines, "lines")
    x, y = (lines.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("id2", "words", "at")]) for k in "xy")
    similar = pairs.join(x, "x").join(y, "y").where(9 * F.size(F.array_intersect("x_words", "y_words")) >= 4 * (F.size("x_words") + F.size("y_words")))
    first = F.col("x_at") < F.col("y_at")
    return similar.select(F.when(first, F.col("y")).otherwise(F.col("x")).alias("id"), F.when(first, F.col("y_id2")).otherwise(F.col("x_id2")).alias("id2")).distinct()


def _near(a: str, b: str, an: str, bn: str) -> str:
    """Length filter and parity maps: the map of all, then, where both sets are LONG, its two halves."""
    halves = f"bit_count({a}.map ^ {a}.map2 ^ {b}.map ^ {b}.map2) + bit_count({a}.map2 ^ {b}.map2)"
    return f"""5 * {an} >= 4 * {bn} AND 5 * {bn} >= 4 * {an} AND 9 * bit_count({a}.map ^ {b}.map) <= {an} + {bn}
        AND ({an} < {LONG} OR {bn} < {LONG} OR 9 * ({halves}) <= {an} + {bn})"""


def _hot_round(classes: DataFrame) -> DataFrame | None:
    """(x, y): under words that over HOT classes pick, each class y with the earliest classes x, past the filters."""
    picked = F.explode(F.slice(F.sort_array("prefix"), 1, FEW)).alias("key")  # hashes, so that similar sets mostly choose alike
    hot = materialise(classes.select(picked).groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HOT).select("key"), "hot")
    held = hot.count()
    if not held:
        return None
    keyed = classes.select("id", "at", "n", "map", "map2", picked)
    keyed = materialise(keyed.join(small(hot, held, BROADCAST), "key", "left_semi"), "keyed")
    hubs = keyed.groupBy("key", F.pmod("id", F.lit(PARTS)).alias("part")).agg(F.min(F.struct("at", "id", "n", "map", "map2")).alias("hub"))
    hubs = small(hubs.select("key", "hub.*"), held * PARTS, BROADCAST // 8).alias("a")
    return keyed.alias("b").join(hubs, F.expr(f"a.key = b.key AND a.id <> b.id AND a.at < b.at AND {_near('a', 'b', 'a.n', 'b.n')}")).selectExpr("a.id AS x", "b.id AS y").distinct()


def _middle(classes: DataFrame) -> int:
    """The size below which lie about half of all prefix words."""
    step = F.floor(4 * F.log2(F.col("n")))
    found = sorted(classes.groupBy(step.alias("step")).agg(F.sum(F.size("prefix")).alias("held")).collect())  # some 100 rows
    half, seen = sum(r.held for r in found) / 2, 0
    for r in found:
        seen += r.held
        if seen >= half:
            return math.ceil(2 ** ((r.step + 1) / 4))
    return 1


def _rest(classes: DataFrame, low: int, high: int) -> DataFrame:
    """(x, y): every two classes of which one is still open that share a word of their prefixes and pass the filters, if the smaller has low <= n < high."""
    within = classes.where(f"n >= {low} AND 4 * cast(n as long) <= {5 * high}")
    each = within.select("id", "map", "map2", "n", "open", F.posexplode("prefix").alias("p", "w"))
    # n and p share a long, below 0 for the closed
    at = F.shiftleft(F.col("n").cast("long"), 31) + F.col("p")
    posted = each.select("id", "map", "map2", "w", F.when(F.col("open"), at).otherwise(-at).alias("np"))
    a, b = posted.alias("a"), posted.alias("b")
    # the whole condition looks at both sides, so that both read one exchange
    an, bn, ap, bp = "shiftright(abs(a.np), 31)", "shiftright(abs(b.np), 31)", "(abs(a.np) & 2147483647)", "(abs(b.np) & 2147483647)"
    same = F.expr(f"""
        a.w = b.w AND {an} <= {bn} AND ({an} < {bn} OR a.id < b.id) AND greatest(a.np, b.np) > 0 AND least({an}, {bn}) < {high}
        AND {_near('a', 'b', an, bn)}""")
    least = F.expr(f"(4 * ({an} + {bn}) + 8) div 9")  # words that similar sets share
    # the set whose prefix ends on the rarer word has all shared words in both prefixes, or behind its own
    behind = F.expr(f"(4 * greatest({an}, {bn}) + 4) div 5 - 1")
    met = a.join(b, same).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), least.alias("least"), behind.alias("behind"), F.expr(f"least({an} - {ap}, {bn} - {bp})").alias("left"))
    shared = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"), F.max("behind").alias("behind"), F.max("left").alias("left"))
    return shared.where("left >= least AND n + behind >= least").select("x", "y")


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc, tag, no): the lines with words that stay."""
    classes = _classes(docs)
    gone = classes.sparkSession.createDataFrame([], "id long, id2 int")
    if (hot := _hot_round(classes)) is not None:
        gone = materialise(_later(materialise(hot, "hot_pairs"), docs, classes), "hot_gone")
    closed = small(gone.withColumn("gone", F.lit(True)), gone.count(), BROADCAST // 8)
    marked = classes.join(closed, ["id", "id2"], "left").withColumn("open", F.col("gone").isNull())
    middle = _middle(classes)
    # by size of the smaller set, so that the shuffle's files are about half as large at once
    below, above = (materialise(_rest(marked, *sizes), "pairs") for sizes in ((1, middle), (middle, 1 << 40)))
    pairs = below.union(above)
    gone = materialise(gone.union(_later(pairs, docs, classes)), "gone")
    return classes.select("id", "id2", "at").join(gone, ["id", "id2"], "left_anti").select("at.*")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text rebuilt from the lines that stay, and n_lines and n_removed."""
    # a document's kept lines as 64 to a word of bits
    bits = kept_lines(docs).groupBy("doc", "tag", F.shiftright("no", 6).alias("part")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("no").bitwiseAND(63))).alias("bits"))
    kept = materialise(bits.groupBy("doc", "tag").agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("kept")), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_keys())
    joined = rows.join(kept, ["doc", "tag"], "left")
    if not rows.groupBy("doc", "tag").count().where("count > 1").isEmpty():  # of equal rows the first keeps its lines
        ordinal = F.row_number().over(Window.partitionBy("doc", "tag").orderBy(F.lit(1)))
        joined = joined.withColumn("kept", F.when(ordinal == 1, F.col("kept")))
    # the text is taken out of the row past the shuffle, which so holds it once
    joined = joined.select("row", "kept", F.split(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "\n").alias("lines"))
    held = lambda i: F.coalesce(F.getbit(F.element_at("kept", F.shiftright(i, 6)), i.bitwiseAND(63)) == 1, F.lit(False))
    stays = F.filter("lines", lambda line, i: held(i) | ~_worded(line))
    out = joined.select("row", F.size("lines").alias("n_lines"), stays.alias("stays"))
    own = [F.array_join("stays", "\n").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.select(*own, "n_lines", (F.col("n_lines") - F.size("stays")).alias("n_removed"))
