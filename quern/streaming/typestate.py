"""Structured Streaming: a protocol over an event stream, windowed counts with late data, incremental refresh of facts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Transitions = dict[tuple[str, str], str]


def protocol_stream(events: DataFrame, by: str, at: str, tie: str, symbol: str, transitions: Transitions, initial: str, errors: set[str], late: str = "1 day", keep_ms: int | None = None) -> DataFrame:
    """by, state, violations, last_us whenever a subject has had new events, in the order of (at, tie) over all triggers.

    Events wait until the watermark has passed them, so one that arrives late, within `late`, still takes its place; what is
    given out counts the waiting ones in. State is a word, two numbers and the waiting events: those of one subject within `late`. With
    keep_ms, a subject's state is removed once the watermark is so far past its last event."""

    def run(now: str, bad: int, rows: list) -> tuple[str, int]:
        for _, _, s in rows:
            now = transitions.get((now, s), now)
            bad += now in errors
        return now, bad

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, bad, done, waiting = state.get if state.exists else (initial, 0, -(1 << 62), "[]")
        mark = state.getCurrentWatermarkMs() * 1000
        rows = [tuple(r) for r in json.loads(waiting)]
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            rows += [(t, int(i), s) for t, i, s in zip(pdf[at].astype("datetime64[us]").astype("int64").tolist(), pdf[tie], pdf[symbol]) if t > done]
        rows.sort()
        sure = [r for r in rows if r[0] <= mark]
        now, bad = run(now, bad, sure)
        done = max([done, *(r[0] for r in sure)])
        rest = rows[len(sure) :]
        state.update((now, bad, done, json.dumps(rest)))
        last = max([done, *(r[0] for r in rest)])
        if keep_ms is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last // 1000 + keep_ms))
        now, bad = run(now, bad, rest)
        yield pd.DataFrame({by: [key[0]], "state": [now], "violations": [bad], "last_us": [last]})

    kind = dict(events.dtypes)[by]
    kept = events.select(by, at, tie, symbol).withWatermark(at, late)
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.EventTimeTimeout
    return kept.groupBy(by).applyInPandasWithState(fold, f"{by} {kind}, state string, violations long, last_us long", "state string, violations long, done_us long, waiting string", "update", timeout)


def windowed_counts(events: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def refresh(spark: SparkSession, changed: DataFrame, target: str, key: str = "path") -> None:
    """Replaces the rows of the touched keys in a Parquet table of facts: readers see the old or the new generation, since
    the new one is written beside the old and then named in `current`."""
    generation = f"{target}/g{spark.range(1).select(F.unix_micros(F.current_timestamp())).head()[0]}"
    old = current(spark, target)
    rows = changed if old is None else old.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)
    rows.write.parquet(generation)
    spark.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("append").parquet(f"{target}/current")


def current(spark: SparkSession, target: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        named = spark.read.parquet(f"{target}/current").agg(F.max("generation")).head()[0]
    except AnalysisException:
        return None
    return spark.read.parquet(named)


def refresh_stream(files: DataFrame, target: str, checkpoint: str):
    """Every batch of changed files replaces their rows."""
    return files.writeStream.foreachBatch(lambda batch, _: refresh(batch.sparkSession, batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
