"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mergewell.operators.cut import checkpointed
from mergewell.operators.incremental import advance, split_late
from mergewell.operators.persist import Store, upsert
from mergewell.operators.prune import meeting
from mergewell.plans.engine import State, ingest_play_events
from mergewell.sources.translate import scrobble_claims

#: What has a watermark of its own.
OWNER = ("user_id", "source")


def distinct_events(stream: DataFrame, delay: str = "0 seconds", at: str = "played_at") -> DataFrame:
    """First event of each user, source and time; what comes later than the watermark is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["user_id", "source", at])


def run(scrobbles: DataFrame, store: Store, checkpoint: str, available_now: bool = True, seen: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Reconciles each micro-batch of scrobbles into the store. The latest time of each user and
    source is stored with the events, in the same commit; a batch stores what comes after it, as a
    run over landed pages does. What comes late and is not stored is kept apart, as late_events.
    Batches that are replayed after a failure, or from a new checkpoint, find their events stored
    and change nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        claims, rels, events = scrobble_claims(rows)
        state = State.load(store)
        ours = meeting(state.watermarks, events, list(OWNER))
        fresh, behind = split_late(events, ours, meeting(state.play_events, events, [*OWNER, "played_at"]))
        at = [*OWNER, "played_at"]
        behind = checkpointed(behind.join(meeting(state.late_events, events, at).select(*at), at, "left_anti"))
        fresh = checkpointed(fresh)
        out = ingest_play_events(claims, rels, fresh, state)
        moved = checkpointed(advance(ours, fresh))
        out.state = out.state.grown("watermarks", upsert(state.watermarks, moved, list(OWNER)), put=moved, by=OWNER)
        out.state = out.state.add("late_events", behind)
        out.state.save(store)
        if seen is not None:
            seen(number, out.counters)

    writer = scrobbles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
