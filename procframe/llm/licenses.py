"""Licence scan by ordered signature rules, in DataFrame operations alone and within each row.

A text becomes its words (A-Z lowered; letters, digits and anything above ASCII), one blank between. Rules are regexes
over that, each with keywords, a priority (0 first), a label and a confidence; only rules whose keywords all occur among
the words are tried, and a keyword occurs in its spellings with a version joined on, too (JOINED). Of the detections, ordered by start, one that lies within an earlier one of the same or a better
priority is suppressed. Base phrases are counted at all their places and keep their labels, suppressed or not.

score is 1 less the product of (1 - confidence) over the detections that stay. Null and blank texts have no word and
score 0. Repeated rows are scanned each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import COMMON, RULES

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BASE = [("cc by", "cc-by", "by cc"), ("general public license", "gpl", "license public general"), ("all rights reserved", "reserved", "all reserved rights")]
#: words that the rules read as a keyword with something joined on
JOINED = {f"{name}{v}{n}": name for name, versions in (("gpl", "123"), ("lgpl", "23"), ("agpl", "3"), ("mpl", "2"), ("epl", "12")) for v, numbers in (("", versions), ("v", ["", *versions])) for n in numbers}


def _starts(body: Column, pattern: Column) -> Column:
    """(start, stop) in words of each match of a pattern in ' word word '."""
    whole = F.concat(F.lit("(?<= )("), pattern, F.lit(")(?= )"))
    marked = F.when(F.regexp_like(body, whole), F.split(F.regexp_replace(body, whole, F.lit("\x01$1\x02")), " ")).otherwise(F.array().cast("array<string>"))
    at = F.transform(marked, lambda w, i: F.struct(w.startswith("\x01").alias("first"), w.endswith("\x02").alias("last"), (i - 1).alias("i")))
    first = F.transform(F.filter(at, lambda x: x["first"]), lambda x: x["i"])
    last = F.transform(F.filter(at, lambda x: x["last"]), lambda x: x["i"])
    return F.arrays_zip(first.alias("start"), last.alias("stop"))


def _places(phrase: str, label: str, keywords: str) -> Column:
    """(start, label) of each place of a base phrase; none where one of its keywords is absent."""
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    every = F.transform(_starts(F.col("body"), F.lit(phrase)), lambda d: F.struct(d["start"].cast("long").alias("start"), F.lit(label).alias("label")))
    return F.coalesce(F.when(F.size(F.array_except(F.array(*map(F.lit, keywords.split())), F.col("held"))) == 0, every), none)


def scan(docs: DataFrame, gated: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text).

    Without the gate all rules are tried on all texts, to the same result.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce("text", F.lit(""))
    words = sorted({w for *_, k, _ in RULES for w in k.split()} | {*JOINED})
    keywords = {max(k.split(), key=lambda w: (w not in COMMON, len(w))) for *_, k, _ in RULES}  # mostly the rarest of a rule's
    keywords = sorted(keywords | {w for w, bare in JOINED.items() if bare in keywords})
    rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c"), F.lit(label).alias("label"), F.array(*map(F.lit, k.split())).alias("k"), F.lit(x).alias("x")) for p, c, label, k, x in RULES])
    gate = f"(?i)(?<![0-9a-z\\x80-\\x{{10FFFF}}])(?:{'|'.join(keywords)})(?![0-9a-z\\x80-\\x{{10FFFF}}])"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.regexp_count(text, F.lit("[0-9A-Za-z\\x80-\\x{10FFFF}]+")).cast("long").alias("n_words"), (text.rlike(gate) if gated else F.lit(True)).alias("open"))
    body = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", upper, lower), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))
    rows = rows.withColumn("body", F.when(F.col("open"), body)).drop("text")
    held = F.array_intersect(F.split("body", " "), F.array(*map(F.lit, words)))
    bare = F.create_map(*[F.lit(x) for pair in JOINED.items() for x in pair])
    held = F.array_distinct(F.transform(held, lambda w: F.coalesce(F.element_at(bare, w), w))) if gated else F.array(*map(F.lit, words))
    rows = rows.withColumn("held", held)
    tried = F.filter(rules, lambda r: F.size(F.array_except(r["k"], F.col("held"))) == 0)
    found = F.flatten(F.transform(tried, lambda r: F.transform(_starts(F.col("body"), r["x"]), lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("stop"), r["p"].alias("p"), r["label"].alias("label"), r["c"].alias("c")))))
    base = F.flatten(F.array(*[_places(phrase, label, keyword) for phrase, label, keyword in BASE]))
    rows = rows.withColumn("base", base).withColumn("found", F.array_sort(F.coalesce(found, F.array().cast("array<struct<start:int,stop:int,p:int,label:string,c:double>>"))))
    empty = F.struct(F.array(*[F.lit(-1)] * 4).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("miss"))

    def step(acc: Column, d: Column) -> Column:
        inside = F.exists(F.slice(acc["reach"], F.lit(1), d["p"] + 1), lambda e: e >= -d["stop"])
        reach = F.transform(acc["reach"], lambda e, i: F.when(i == d["p"], F.greatest(e, -d["stop"])).otherwise(e))
        return F.struct(reach.alias("reach"), F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"), F.when(inside, acc["miss"]).otherwise(acc["miss"] * (F.lit(1.0) - d["c"])).alias("miss"))

    rows = rows.withColumn("kept", F.aggregate("found", empty, step))
    starts, own = F.transform("base", lambda x: x["start"]), F.array_distinct(F.transform("base", lambda x: x["label"]))
    join = lambda labels: F.array_join(F.sort_array(labels), ",")
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), join(own).alias("base_labels"), join(F.array_union(own, F.col("kept.labels"))).alias("labels"), (F.lit(1.0) - F.col("kept.miss")).alias("score"))
