"""Series as streams: fits and statistics by event-time window, differences, and phrase lists that live in state.

Inputs are streaming DataFrames; nothing here starts a query. Windows close by the watermark, so state is bounded by the
lateness that is waited for; the stateful operators hold one value, or `capacity` phrases, for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.codecs import PhraseList


def windowed_fit(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Line and spread of each series and window of events (series_id, ts timestamp, value).

    x runs over the window from 0 to 1. Columns: series_id, start, end, n, slope, intercept, variance, amplitude.
    """
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    marked = events.withWatermark("ts", late).select("series_id", "value", span.alias("w"), "ts")
    seconds = lambda c: F.unix_micros(c).cast("double") / 1e6
    x = (seconds(F.col("ts")) - seconds(F.col("w.start"))) / (seconds(F.col("w.end")) - seconds(F.col("w.start")))
    fitted = marked.select("series_id", "w", "value", x.alias("x")).groupBy("w", "series_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"),
        F.var_pop("value").alias("variance"), ((F.max("value") - F.min("value")) / 2).alias("amplitude"),
    )
    return fitted.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "slope", "intercept", "variance", "amplitude")


def deltas(events: DataFrame) -> DataFrame:
    """(series_id, pos, delta): each value less the one before it in arrival order; the first less 0.

    Within a micro-batch the order is by pos; a late pos counts where it arrives.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("pos", kind="stable")
        out = rows["value"].diff()
        out.iloc[0] = rows["value"].iloc[0] - last
        state.update((float(rows["value"].iloc[-1]),))
        yield pd.DataFrame({"series_id": key[0], "pos": rows["pos"], "delta": out})

    rows = events.select(F.col("series_id").cast("long"), F.col("pos").cast("long"), F.col("value").cast("double"))
    return rows.groupBy("series_id").applyInPandasWithState(step, "series_id long, pos long, delta double", "last double", "append", GroupStateTimeout.NoTimeout)


def phrase_lists(phrases: DataFrame, capacity: int) -> DataFrame:
    """(key, phrase, index, size) for each phrase of (key, phrase string) as it comes: its place in the key's phrase list."""
    if capacity < 1:
        raise ValueError("a phrase list holds one phrase at least")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = PhraseList(capacity, state.get[0] if state.exists else [])
        for rows in batches:
            places = [(held.add(p), len(held)) for p in rows["phrase"]]
            yield pd.DataFrame({"key": key[0], "phrase": rows["phrase"], "index": [i for i, _ in places], "size": [n for _, n in places]})
        state.update((held.phrases(),))

    rows = phrases.select(F.col("key").cast("string"), F.coalesce("phrase", F.lit("")).alias("phrase"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, phrase string, index int, size int", "phrases array<string>", "append", GroupStateTimeout.NoTimeout)
