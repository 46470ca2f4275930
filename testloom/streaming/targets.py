"""Bazel targets of event files that are still growing: the fold of A1 as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from testloom.operators.bazel import FILE_PREFIX, build_result, known_status

#: State groups of a bundle, so that one large bundle spreads over tasks.
BUCKETS = 16
EVENTS = "array<struct<seq:long,cached:boolean,status:string,attempt:int,file:string>>"
TARGET = "bundle_id string, label string, version long, present boolean, cached boolean, status string, max_attempt int, xml_files array<string>"


class TargetFold(StatefulProcessor):
    """Events of a bucket's labels, in order, and where the file ended; a label's target is made of its events anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "seq long")
        self.labels = handle.getMapState("labels", "label string", f"version long, events {EVENTS}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.ended.get()[0] if self.ended.exists() else None
        end, new = before, {}
        for r in rows:
            if r.kind == "error":
                end = r.seq if end is None else min(end, r.seq)
            else:
                # a null label has a place of its own
                new.setdefault("" if r.label is None else f"={r.label}", []).append((r.seq, r.cached, r.status, r.attempt, r.file))
        changed = set(new)
        if end != before:
            self.ended.update((end,))
            # a bad line that comes late takes back what follows it
            changed |= {k[0] for k in self.labels.keys()}
        for name in sorted(changed):
            version, events = self.labels.getValue((name,)) if self.labels.containsKey((name,)) else (0, [])
            every = [tuple(e) for e in events] + new.get(name, [])
            kept = sorted((e for e in every if end is None or e[0] < end), key=lambda e: (e[0], e[4] is not None, e[4] or ""))
            if len(kept) == len(events) and name not in new:
                continue
            if not kept and not version:
                continue
            self.labels.updateValue((name,), (version + 1, kept))
            yield self.target(key[0], name[1:] if name else None, version + 1, kept)

    @staticmethod
    def target(bundle_id: str, label: str | None, version: int, events: list[tuple]) -> Row:
        first, last = (events[0], events[-1]) if events else ((None,) * 5, (None,) * 5)
        attempts = [e[3] for e in events if e[3] is not None]
        files = [e[4] for e in events if e[4] is not None]
        return Row(bundle_id=bundle_id, label=label, version=version, present=bool(events), cached=first[1], status=last[2], max_attempt=max(attempts) - 1 if attempts else None, xml_files=files)

    def close(self) -> None:
        pass


def merge_targets_stream(events: DataFrame) -> DataFrame:
    """A1 over a stream of the rows of S3: a row for each label that a batch changes, in output mode `update`.

    A label's last row (greatest version) is its target as `merge_targets` gives it for all events so far, in whatever
    batches and order they came. Events behind the first error of their bundle don't count, also where the error comes
    later; a label that loses all its events so is not `present`. Needs the RocksDB state store. State grows with the
    results of a bundle; a bundle's labels are dealt over BUCKETS groups, and its errors go to each of them.
    """
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
    buckets = F.when(F.col("kind") == "error", F.sequence(F.lit(0), F.lit(BUCKETS - 1))).otherwise(F.array(bucket))
    file = F.when(F.col("uri").endswith(".xml"), F.regexp_replace("uri", FILE_PREFIX, ""))
    rows = events.where("kind in ('result', 'error')").select(F.col("bundle_id").cast("string").alias("bundle_id"), F.explode(buckets).alias("bucket"), "kind", "label", F.col("seq").cast("long").alias("seq"), "cached", "status", F.col("attempt").cast("int").alias("attempt"), file.alias("file"))
    out = rows.groupBy("bundle_id", "bucket").transformWithState(TargetFold(), TARGET, "Update", "None")
    status = F.when(F.col("present"), known_status(F.col("status")))
    return out.withColumn("build_status", status).withColumn("build_result", F.when(F.col("present"), build_result(status))).drop("status")
