"""Streaming flows: vector uploads in chunks into a table with a transaction log, and retry counters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import lifecycle as L

MAX_ATTEMPTS = 4
COMMITS = 10


class IntegrityError(RuntimeError):
    """A batch did not come out as it went in; its offset is not committed."""


class ConflictError(RuntimeError):
    """Another writer kept committing first."""


class VectorTable:
    """A vector table in buckets of its key, with a transaction log.

    A write makes new versions of the buckets that it touches, in a folder of its own, and then commits: it creates the
    next numbered file of the log, which says where each bucket lies, which batch each writer committed last, and where
    rejected rows are.  The number is the log's own.  Creating a file that exists fails, so of two writers one commits and
    the other starts again from what it sees then.  A batch that its writer has committed is not written again.  Readers
    take the last file (or an older one: a snapshot); a write that died half way is in no file and is never seen."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    # ---- files

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one already."""
        fs, path = self._fs(name)
        fs.mkdirs(path.getParent())
        temporary = self._fs(f"log/.{uuid.uuid4().hex}")[1]
        out = fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.exists(path):  # a local file system would rename over it
                return False
            return bool(fs.rename(temporary, path))
        finally:
            fs.delete(temporary, False)

    # ---- log

    def history(self) -> list[int]:
        """Committed versions that are still in the log."""
        return sorted(int(n[:-5]) for n in self._names("log") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> dict:
        """version, buckets (where each lies), writers (the last batch of each), rejected (folders) of a version, the last
        by default; of an empty table version 0."""
        known = self.history()
        if not known and version is None:
            return {"version": 0, "buckets": {}, "writers": {}, "rejected": []}
        if version is not None and version not in known:
            raise ValueError(f"version {version} is not in the log")
        rows = self.spark.read.text(f"{self.path}/log/{version or known[-1]:020d}.json", wholetext=True).collect()  # one small file
        return json.loads(rows[0][0])

    def versions(self) -> dict[int, str]:
        """The folder of each bucket that was ever written: at most `buckets` entries."""
        return {int(b): v for b, v in self.snapshot()["buckets"].items()}

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The table, or some of its buckets, as of a version."""
        found = self.snapshot(version)["buckets"]
        paths = [f"{self.path}/{v}/bucket={b}" for b, v in found.items() if only is None or int(b) in only]
        return self.spark.read.parquet(*paths) if paths else None

    def rejected(self) -> DataFrame | None:
        """The rows that were not written, with reject_reason and the version that tells it."""
        paths = [f"{self.path}/{p}" for p in self.snapshot()["rejected"]]
        return self.spark.read.parquet(*paths) if paths else None

    # ---- writes

    def merge(self, new: DataFrame, seq: int, writer: str = "", bad: DataFrame | None = None) -> bool:
        """Write a batch (and its rejected rows) as one transaction.  False: this writer had committed it before."""
        for _ in range(COMMITS):
            seen = self.snapshot()
            if seen["writers"].get(writer, -1) >= seq and writer:
                return False
            name = f"v{seen['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
            after = {"version": seen["version"] + 1, "buckets": dict(seen["buckets"]), "writers": seen["writers"] | ({writer: seq} if writer else {}), "rejected": list(seen["rejected"])}
            touched = self._rewrite(new, seen["buckets"], name, seq)
            after["buckets"] |= {str(b): name for b in touched}
            if bad is not None and not bad.isEmpty():
                bad.withColumn("version", F.lit(after["version"]).cast("long")).write.parquet(f"{self.path}/rejected-{name}")
                after["rejected"].append(f"rejected-{name}")
            if after["buckets"] == seen["buckets"] and after["rejected"] == seen["rejected"] and not writer:
                return True
            if self._create(f"log/{after['version']:020d}.json", json.dumps(after)):
                return True
        raise ConflictError(f"batch {seq}: {COMMITS} commits were taken by others")

    def _rewrite(self, new: DataFrame, before: dict[str, str], name: str, seq: int) -> list[int]:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return []
        paths = [f"{self.path}/{v}/bucket={b}" for b, v in before.items() if int(b) in touched]
        old = self.spark.read.parquet(*paths) if paths else new.limit(0)
        merged = L.upserted(old, new, self.key).withColumn("bucket", bucket)
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        written = self.spark.read.parquet(f"{self.path}/{name}")
        expected, kept = new.select(*self.key).distinct(), old.select(*self.key).distinct()
        found = written.select(*self.key).distinct()
        lost = expected.unionByName(kept).distinct().join(found, self.key, "left_anti").count()
        if lost:
            raise IntegrityError(f"batch {seq}: {lost} keys not written")
        return touched

    def compact(self) -> None:
        """One folder for all buckets and one for all rejected rows; what readers see stays the same."""
        seen = self.snapshot()
        table, bad = self.read(), self.rejected()
        name = f"v{seen['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        after = seen | {"version": seen["version"] + 1}
        if table is not None:
            bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
            table.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
            after["buckets"] = {b: name for b in seen["buckets"]}
        if bad is not None:
            bad.write.parquet(f"{self.path}/rejected-{name}")
            after["rejected"] = [f"rejected-{name}"]
        if not self._create(f"log/{after['version']:020d}.json", json.dumps(after)):
            raise ConflictError("another writer committed during the compaction")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last `keep` versions: their log files, and the folders that no kept version names, dead
        writes among them.  Run it when no writer is at work.  Returns the deleted folders."""
        known = self.history()
        kept, gone = known[-keep:], known[:-keep]
        states = [self.snapshot(v) for v in kept]
        alive = {v for s in states for v in s["buckets"].values()} | {p for s in states for p in s["rejected"]}
        dead = [n for n in self._names("") if (n.startswith("v0") or n.startswith("rejected-")) and n not in alive]
        for name in [f"log/{v:020d}.json" for v in gone] + dead:
            fs, path = self._fs(name)
            fs.delete(path, True)
        return dead


def upsert_stream(source: DataFrame, target: VectorTable, checkpoint: str, dim: int | None = None, profile: tuple[str, ...] | None = None, upload: str = "upload", order: str = "seq") -> StreamingQuery:
    """Merge each micro-batch of vectors; the stream's checkpoint is the cursor and moves only after the commit.  The
    writer's name is the query's id, which a new checkpoint renews: its batches are new ones then.  With `dim` and
    `profile` the rows of an upload go in chunks of 20, checked; what is not written is told in the table's rejected
    rows."""

    def write(batch: DataFrame, seq: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if dim is None:
            target.merge(batch, seq, writer)
            return
        sent = L.sent_chunks(batch, upload, order, dim, profile).persist()
        good = sent.where("reject_reason IS NULL").drop("chunk", "reject_reason", upload, order)
        target.merge(good, seq, writer, sent.where("reject_reason IS NOT NULL"))
        sent.unpersist()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_states(attempts: DataFrame) -> DataFrame:
    """attempts (job, seq, ok) as a stream to job, failures, state (retry, failed, done): a failure counts up to
    MAX_ATTEMPTS, a success clears."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        for ok in rows["ok"]:
            failures = 0 if ok else failures + 1
        state.update((failures,))
        name = "done" if failures == 0 else "failed" if failures >= MAX_ATTEMPTS else "retry"
        yield pd.DataFrame({"job": [key[0]], "failures": [failures], "state": [name]})

    return attempts.groupBy("job").applyInPandasWithState(update, "job long, failures long, state string", "failures long", "update", GroupStateTimeout.NoTimeout)


RETRY_MS = (1_000, 2_000, 4_000)


def retry_queue(attempts: DataFrame, waits_ms: tuple[int, ...] = RETRY_MS, most: int = MAX_ATTEMPTS) -> DataFrame:
    """attempts (job, payload, ts, ok) as a stream with a watermark on ts, to job, payload, failures, event, at.

    A failure queues the job's last payload; when its wait is over in event time, `send` is told once and the next failure
    counts on.  After `most` failures in a row the row is told as `failed` and is queued no more; a success clears
    (`done`).  Attempts of one job are taken by ts; the state of a job is its failures, last payload and due time."""
    layout = "job long, payload string, failures long, event string, at timestamp"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = []
        failures, payload, due, told_failed = state.get if state.exists else (0, None, None, False)
        if due is not None and (state.hasTimedOut or due <= state.getCurrentWatermarkMs()):
            told.append((key[0], payload, failures, "send", pd.Timestamp(due, unit="ms")))
            due = None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts", "ok"])
            for row in rows.itertuples():
                at = int(row.ts.timestamp() * 1000)
                if row.ok:
                    if failures:
                        told.append((key[0], row.payload, failures, "done", row.ts))
                    failures, due, told_failed = 0, None, False
                elif not told_failed:
                    failures, payload = failures + 1, row.payload
                    if failures >= most:
                        told.append((key[0], payload, failures, "failed", row.ts))
                        due, told_failed = None, True
                    else:
                        due = at + waits_ms[min(failures, len(waits_ms)) - 1]
        if due is not None and due <= state.getCurrentWatermarkMs():
            told.append((key[0], payload, failures, "send", pd.Timestamp(due, unit="ms")))
            due = None
        if failures or told_failed:
            state.update((failures, payload, due, told_failed))
            if due is not None:
                state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(told, columns=["job", "payload", "failures", "event", "at"])

    return attempts.groupBy("job").applyInPandasWithState(update, layout, "failures long, payload string, due long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def fresh_responses(responses: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """responses (query_id, ts, expected, actual, ..) as a stream: one response of each query within the delay, late and
    stale ones dropped.  expected, actual: structs of query_id and image_hash."""
    return L.stale_responses(responses.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["query_id"])).where("error IS NULL")
