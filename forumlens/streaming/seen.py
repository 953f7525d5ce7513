"""Posts of a stream that no earlier run has stored, with state that starts full and empties itself."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from forumlens.functions.columns import present
from forumlens.session import SETTINGS, STATE_STORE

#: Columns that make up the key of a post.
KEY = ["group_key", "post_key"]


class SeenPosts(StatefulProcessor):
    """One value per post: that it was seen. It is forgotten ``ttl_ms`` after that."""

    def __init__(self, ttl_ms: int | None, order: str | None):
        self.ttl_ms, self.order = ttl_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]), self.ttl_ms)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        best = None
        for part in rows:
            # Rows of a post come in pieces; one row is held.
            part = part if best is None else pd.concat([best, part])
            best = part.iloc[:1] if self.order is None else part.sort_values(self.order, kind="stable").iloc[:1]
        if best is not None:
            self.seen.update((True,))
            yield best.drop(columns=KEY)

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, group: str, post_id: str) -> DataFrame:
    return rows.filter(present(F.col(post_id))).withColumn(KEY[0], F.lower(group)).withColumn(
        KEY[1], F.col(post_id).cast("string"))


def once_per_new_post(
    feed: DataFrame, stored: DataFrame | None = None, ttl_ms: int | None = None, group: str = "subreddit",
    post_id: str = "id", order: str | None = None,
) -> DataFrame:
    """Rows of a stream whose post is neither in ``stored`` nor was emitted before.

    ``stored`` (with the columns ``group`` and ``post_id``) fills the state when the
    stream starts with a new checkpoint, so that it knows what batch runs or a lost
    checkpoint have brought; Spark ignores it when it goes on from an old one. Without
    ``ttl_ms`` a post is never forgotten; with it, that long after it was seen or the
    stream began, by the clock of the executors, and then it may be emitted again; a stream
    that forgets asks for batches without data, so one that is to end by itself
    (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled=false``. Of a
    post that comes several times in one batch the row with the smallest ``order`` is
    emitted, any of them without it. Rows without an id are dropped.

    Such state needs RocksDB, so the session's state store is set to it; a stream that has a
    checkpoint goes on with the store it began with.

    The feed's columns must not be called ``group_key`` or ``post_key``. Unlike ``once_per_post``
    this asks Python once per post of a batch; the state lies in RocksDB either way.
    """
    out = T.StructType(feed.schema.fields)
    # Read when the stream starts; a session that was not made by ``configure`` has a store that cannot hold this state.
    feed.sparkSession.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    initial = None
    if stored is not None:
        # One row per post: copies would be handed over as separate values of a key.
        initial = _keyed(stored, group, post_id).select(*KEY).distinct().groupBy(*KEY)
    return _keyed(feed, group, post_id).groupBy(*KEY).transformWithStateInPandas(
        SeenPosts(ttl_ms, order), out, "Append", "ProcessingTime" if ttl_ms else "None", initial)
