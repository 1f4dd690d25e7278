"""The library's live figures as Structured Streaming queries; each works on a batch DataFrame as well."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP_S, LONGEST_S, MOST_CHARS = 0.8, 6.0, 84


def rates(reads: DataFrame, late: str = "1 minute") -> DataFrame:
    """Amount per second over 60 s, every 10 s: reads (ts, source, amount)."""
    rows = reads.withWatermark("ts", late) if reads.isStreaming else reads
    return rows.groupBy(F.window("ts", "60 seconds", "10 seconds"), "source").agg((F.sum("amount") / 60).alias("rate"), F.count("*").alias("reads")).select("source", F.col("window.end").alias("end"), "rate", "reads")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with no gap as long as that: events (ts, key)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("events")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def latest(statuses: DataFrame, now: Column | None = None, stale_s: int = 30) -> DataFrame:
    """The last status of each source: statuses (ts, source, status); given now, with stale, whether it is too old to count."""
    rows = statuses.groupBy("source").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))
    return rows if now is None else rows.withColumn("stale", F.unix_micros(now) - F.unix_micros("ts") > stale_s * 1_000_000)


def split_words(words: list[tuple[float, float, str]], held: list[tuple[float, float, str]]) -> tuple[list[list[tuple[float, float, str]]], list[tuple[float, float, str]]]:
    """Cues that the words (start, end, word) close, and the words of the one still open: a pause, the span or the length of a cue ends it."""
    cues, now = [], list(held)
    for start, end, word in words:
        if now and (start - now[-1][1] > GAP_S or end - now[0][0] > LONGEST_S or sum(len(w) + 1 for _, _, w in now) + len(word) > MOST_CHARS):
            cues.append(now)
            now = []
        now.append((start, end, word))
    return cues, now


def cue_row(key: Any, cue: list[tuple[float, float, str]]) -> dict[str, Any]:
    return {"key": key, "start": cue[0][0], "end": cue[-1][1], "cue": " ".join(w for _, _, w in cue)}


CUES = "key long, start double, end double, cue string"


def cues(words: DataFrame) -> DataFrame:
    """Cues of all words (key, start, end, word) of each key, the last one too."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "word"], kind="stable")
        closed, rest = split_words(list(zip(pdf.start, pdf.end, pdf.word)), [])
        return pd.DataFrame([cue_row(pdf.key.iloc[0], c) for c in [*closed, *([rest] if rest else [])]], columns=["key", "start", "end", "cue"])

    return words.groupBy("key").applyInPandas(work, CUES)


def streaming_cues(words: DataFrame, late: str = "10 seconds", rest_s: int = 30) -> DataFrame:
    """Cues of a stream of words (…, ts) as they close; the open one of a key waits in state and comes out when the watermark is rest_s past its last word."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([cue_row(key[0], held)] if held else [], columns=["key", "start", "end", "cue"])
            return
        new = pd.concat(list(batches)).sort_values(["start", "end", "word"], kind="stable")
        closed, rest = split_words(list(zip(new.start, new.end, new.word)), held)
        state.update(tuple(list(x) for x in zip(*rest)))
        last = int(new.ts.max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1000 * rest_s)
        yield pd.DataFrame([cue_row(key[0], c) for c in closed], columns=["key", "start", "end", "cue"])

    rows = words.withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(work, CUES, "start array<double>, end array<double>, word array<string>", "append", GroupStateTimeout.EventTimeTimeout)
