"""Structured Streaming forms: running pooled rates, and clips merged across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scoring import error_counts, pooled


def streaming_report(pairs: DataFrame, bucket: str) -> DataFrame:
    """Pooled rates by bucket over a stream of pairs; run it in complete or update mode. State is one row for each bucket."""
    return pooled(error_counts(pairs), bucket, rollup=False)


def deduplicated(clips: DataFrame, key: str = "clip_id") -> DataFrame:
    return clips.dropDuplicates([key])


class RegionMerger(StatefulProcessor):
    """Merges a recording's speech regions as they arrive in order of time; the open clip is the state. A null start closes the recording."""

    def __init__(self, max_seconds: float = 10.0, min_seconds: float = 1.0, max_gap_s: float = 0.6):
        self.bounds = max_seconds, min_seconds, max_gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start_s double, end_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top, least, gap = self.bounds
        now = tuple(self.open.get()) if self.open.exists() else None
        done: list[tuple[float, float]] = []
        regions = [(a, b) for part in rows for a, b in zip(part["start_s"], part["end_s"], strict=True)]
        for a, b in sorted(regions, key=lambda r: (pd.isna(r[0]), r[0])):
            if pd.isna(a):
                done += [now] if now else []
                now = None
            elif b <= a:
                continue
            elif b - a > top:
                done += [now] if now else []
                now, t = None, a
                while t < b:
                    done.append((t, min(t + top, b)))
                    t += top
            elif now and a - now[1] <= gap and b - now[0] <= top:
                now = (now[0], b)
            else:
                done += [now] if now else []
                now = (a, b)
        if now:
            self.open.update(now)
        else:
            self.open.clear()
        clips = [(key[0], float(a), float(b)) for a, b in done if b - a >= least]
        yield pd.DataFrame(clips, columns=["recording", "start_s", "end_s"])

    def close(self) -> None:
        pass


def streaming_clips(regions: DataFrame, key: str = "recording", **bounds) -> DataFrame:
    """(recording, start_s, end_s) of closed clips; needs the RocksDB state store."""
    kind = regions.schema[key].dataType.simpleString()
    return regions.groupBy(F.col(key).alias("recording")).transformWithStateInPandas(
        statefulProcessor=RegionMerger(**bounds), outputStructType=f"recording {kind}, start_s double, end_s double", outputMode="Append", timeMode="None"
    )
