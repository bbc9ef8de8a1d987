"""Signatures kept up to date by Structured Streaming.

``upsert_stream`` folds each micro-batch into a stored map; the batch number is kept with it, so a batch that runs again
after a failure is not folded twice. ``live_counts`` keeps per-key state in the state store. ``windowed`` adds event-time
windows with a watermark; that is an extension, the batch engine has no such notion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import MapStore


def upsert_stream(events: DataFrame, store: MapStore, measures: dict[str, Column], combine: Callable[[Column, Column], Column], checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    keys = store.map.spec.key_names

    def fold(batch: DataFrame, number: int) -> None:
        if number <= int(store.note or -1):
            return
        rows = batch.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
        # The pointer names version and batch in one step: a batch is folded wholly or not at all.
        store.save(store.map.fold(rows, combine), note=str(number))

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_counts(events: DataFrame, key: str) -> DataFrame:
    """(key, n) after each batch that touches the key, from state."""
    kind = dict(events.dtypes)[key]

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(map(len, batches))
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    return events.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, n bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, late: str, measures: dict[str, Column], slide: str | None = None) -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(*[c.alias(n) for n, c in measures.items()])


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str, measures: dict[str, Column]) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*[c.alias(n) for n, c in measures.items()])
