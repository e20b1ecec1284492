"""Changes as a stream: micro-batches are coalesced and applied to the index, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.embed import embed
from quarry.operators.changes import apply_changes, coalesce_changes
from quarry.operators.chunking import chunks
from quarry.sources.store import IndexStore

CHANGE = "project string, path string, op string, text string, event_time timestamp, event_id bigint"


def apply_batch(store: IndexStore, batch: DataFrame, batch_id: int, source: str, embedder: str = "hashing") -> None:
    """Changed files are chunked and embedded anew.  A batch that was applied before, and comes again after a failure, is left out."""
    if store.applied([source, batch_id]):
        return
    last = coalesce_changes(batch).persist()
    try:
        projects = [r["project"] for r in last.select("project").distinct().collect()]
        store.replace(apply_changes(store.chunks_of(projects), last, lambda files: embed(chunks(files), embedder)), projects, [source, batch_id])
    finally:
        last.unpersist()


def stream_changes(changes: DataFrame, store: IndexStore, checkpoint: str, debounce: str = "5 seconds", once: bool = False, embedder: str = "hashing") -> StreamingQuery:
    """Applies a stream of CHANGE rows; the trigger's interval gathers a burst of events into one batch.  embedder: that of the index."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_batch(store, df, i, checkpoint, embedder))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()
