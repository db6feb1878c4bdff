"""Incremental enrichment: new claims arrive in micro-batches, are merged by id, and what they touch is judged anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from attestor.operators import conflicts
from attestor.sources.tables import Versions, merge


def apply_batch(store: Versions, batch: DataFrame, batch_id: str) -> int:
    """Merges a batch of claims into the store and reconciles the conflict edges; a batch that was applied is left alone."""
    if store.done(batch_id):
        return store.version()
    rows = batch.dropDuplicates(["claim_id"])
    known = store.read("claim")
    claims = rows if known is None else merge(known, rows.select(*known.columns), "claim_id", [c for c in known.columns if c != "claim_id"])
    claims = claims.cache()
    persisted = store.read("conflicts_with")
    fresh = conflicts.edges(claims) if persisted is None else conflicts.reconcile(claims, rows.select("dsid"), persisted)
    version = store.commit(batch_id, claim=claims, conflicts_with=fresh)
    claims.unpersist()
    return version


def start(stream: DataFrame, store: Versions, checkpoint: str) -> StreamingQuery:
    """Runs until the source is drained; a restart goes on from the checkpoint, and replayed batches change nothing."""
    def each(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch, f"stream-{batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
