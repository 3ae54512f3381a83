"""Streams into and out of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.merge import lww
from tidemark.store import Store


def upsert_stream(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None, filter_late: bool = True) -> StreamingQuery:
    """Upserts each micro-batch of (key, ts_ns, value, seq). No state and no watermark are kept: the merge does not depend
    on the order of arrival, and a batch that is run again after a failure changes nothing."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: store.upsert(batch, filter_late) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def running_winners(stream: DataFrame, order: tuple[str, ...] = ("ts_ns", "seq")) -> DataFrame:
    """The merge as a streaming aggregate, for output modes complete and update; state has one row a key."""
    return lww(stream, order=order)


def changes(store: Store, since: int | None) -> tuple[DataFrame, int | None]:
    """What is newer than a cutoff, and the cutoff for the next call."""
    newest = max((c["max_ts_ns"] for c in store.components()), default=since)
    return store.stream_all(since), newest
