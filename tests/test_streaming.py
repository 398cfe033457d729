"""Streams end in the state of the batch."""

import os

import pytest
from pyspark.sql import functions as F

from gearfinch.operators import lifecycle as L
from gearfinch.operators import vectors as V
from gearfinch.sources import fixtures as X
from gearfinch.streaming import upserts as U

KEY = ["record_id", "asset_type", "object_key", "view_variant", *V.PROFILE_COLUMNS]


def test_upsert_stream_is_idempotent(spark, small, tmp_path):
    rows = X.image_vectors(spark, small).where("id < 90")
    for part in (0, 1):
        rows.where(F.col("id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    target = U.VectorTable(spark, f"{tmp_path}/table", KEY)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    U.upsert_stream(source, target, f"{tmp_path}/cp").awaitTermination(120)
    assert target.read().count() == 90
    target.merge(rows.withColumn("quality_score", F.lit(9.0)), 99)
    target.merge(rows.withColumn("quality_score", F.lit(9.0)), 99)
    assert target.read().count() == 90 and target.read().where("quality_score = 9.0").count() == 90


def test_a_write_touches_its_buckets_only(spark, small, tmp_path):
    rows = X.image_vectors(spark, small).where("id < 200")
    target = U.VectorTable(spark, f"{tmp_path}/table", KEY, 16)
    target.merge(rows, 1)
    before = target.versions()
    one = rows.where("id = 5").withColumn("quality_score", F.lit(7.0))
    target.merge(one, 2)
    after = target.versions()
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    target.merge(one.limit(0), 3)
    assert target.versions() == after
    assert target.read().count() == 200 and [r["id"] for r in target.read().where("quality_score = 7.0").collect()] == [5]


def test_a_failed_write_changes_nothing(spark, small, tmp_path, monkeypatch):
    rows = X.image_vectors(spark, small).where("id < 50")
    target = U.VectorTable(spark, f"{tmp_path}/table", KEY, 4)
    target.merge(rows.where("id < 20"), 1)
    monkeypatch.setattr(U.L, "upserted", lambda old, new, key: old.unionByName(new).where("id <> 30"))
    with pytest.raises(U.IntegrityError):
        target.merge(rows.where("id >= 20"), 2)
    assert target.read().count() == 20 and target.history() == [1]


def test_versions_are_the_logs_own(spark, small, tmp_path):
    """A smaller batch number is no older version; a batch that its writer has committed is not written again."""
    rows = X.image_vectors(spark, small).where("id < 30")
    score = lambda n: rows.withColumn("quality_score", F.lit(float(n)))
    target = U.VectorTable(spark, f"{tmp_path}/table", KEY, 4)
    assert target.merge(score(1), 99, "a") and target.merge(score(2), 1, "b") and not target.merge(score(3), 1, "b")
    assert {r[0] for r in target.read().select("quality_score").distinct().collect()} == {2.0}
    assert {r[0] for r in target.read(version=1).select("quality_score").distinct().collect()} == {1.0}
    assert target.history() == [1, 2] and target.snapshot()["writers"] == {"a": 99, "b": 1}
    target.compact()
    assert target.vacuum() and target.history() == [3] and target.read().count() == 30
    with pytest.raises(ValueError):
        target.read(version=1)


def test_of_two_writers_one_starts_again(spark, small, tmp_path, monkeypatch):
    rows = X.image_vectors(spark, small).where("id < 40")
    target, other = (U.VectorTable(spark, f"{tmp_path}/table", KEY, 4) for _ in range(2))
    rewrite, first = target._rewrite, []

    def late(*given):
        if not first:
            first.append(other.merge(rows.where("id >= 20"), 0, "other"))
        return rewrite(*given)

    monkeypatch.setattr(target, "_rewrite", late)
    assert target.merge(rows.where("id < 20"), 0, "own")
    assert target.read().count() == 40 and target.history() == [1, 2]


def test_a_log_that_cannot_be_read_is_no_empty_table(spark, small, tmp_path):
    rows = X.image_vectors(spark, small).where("id < 5")
    target = U.VectorTable(spark, f"{tmp_path}/table", KEY, 4)
    target.merge(rows, 0)
    with open(f"{tmp_path}/table/log/{1:020d}.json", "w") as f:
        f.write("not json")
    for crc in (tmp_path / "table/log").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        target.merge(rows, 1)


def in_order(folder):
    """Files f0, f1, .. get times one minute apart, so that a stream takes them in this order."""
    for i, f in enumerate(sorted(p for p in folder.iterdir())):
        for part in f.glob("part-*"):
            os.utime(part, (1_700_000_000 + 60 * i,) * 2)


def uploads(spark, small, sizes):
    """Uploads of so many rows."""
    numbers = [(u, i) for u, n in enumerate(sizes) for i in range(n)]
    asked = spark.createDataFrame([(k, u, i) for k, (u, i) in enumerate(numbers)], "id long, upload long, seq long")
    rows = X.image_vectors(spark, small).withColumn("preprocess_version", F.lit("canon_v2"))
    return rows.join(asked, "id")


def test_chunks_of_an_upload(spark, small):
    rows = uploads(spark, small, (1, 20, 21, 43, 107))
    sent = L.sent_chunks(rows, "upload", "seq", 64, X.PROFILE)
    per = {r["upload"]: (r["n"], r["bad"]) for r in sent.groupBy("upload").agg(F.max("chunk").alias("n"), F.count("reject_reason").alias("bad")).collect()}
    assert per == {0: (0, 0), 1: (0, 0), 2: (1, 0), 3: (2, 0), 4: (5, 0)}
    broken = rows.withColumn("embedding", F.when((F.col("upload") == 4) & (F.col("seq") == 25), F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    told = L.sent_chunks(broken, "upload", "seq", 64, X.PROFILE).where("upload = 4").groupBy("chunk", "reject_reason").count().collect()
    assert {(r["chunk"], r["reject_reason"]): r["count"] for r in told} == {(0, None): 20, (1, "dimension"): 1, (1, "chunk_failed"): 19, **{(c, "not_sent"): 20 for c in (2, 3, 4)}, (5, "not_sent"): 7}


def test_a_chunked_stream_and_its_restart(spark, small, tmp_path):
    """The second chunk of one upload fails: the first is there, the rest is in the rejected rows.  A restart with a new
    checkpoint and mended rows writes them."""
    rows = uploads(spark, small, (21, 43))
    broken = rows.withColumn("embedding", F.when((F.col("upload") == 1) & (F.col("seq") == 22), F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    broken.coalesce(1).write.parquet(f"{tmp_path}/in")
    target = U.VectorTable(spark, f"{tmp_path}/table", KEY, 4)
    run = lambda folder, checkpoint: U.upsert_stream(spark.readStream.schema(rows.schema).parquet(folder), target, f"{tmp_path}/{checkpoint}", 64, X.PROFILE).awaitTermination(120)
    run(f"{tmp_path}/in", "cp")
    assert target.read().count() == 41 and target.rejected().count() == 23
    run(f"{tmp_path}/in", "cp")  # nothing new
    assert target.history() == [1]
    rows.coalesce(1).write.parquet(f"{tmp_path}/again")
    run(f"{tmp_path}/again", "cp2")
    assert target.read().count() == 64 and target.rejected().count() == 23 and len(target.snapshot()["writers"]) == 2


def test_retry_queue(spark, tmp_path):
    """Due retries are sent once, four failures end a job, a success clears."""
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    files = [[(1, "a", at(0), False), (2, "b", at(0), False), (3, "c", at(0), False)], [(9, "z", at(5), True)], [(1, "a2", at(6), False), (2, "b", at(6), True), (3, "c", at(6), False), (3, "c", at(7), False), (3, "c", at(8), False)], [(9, "z", at(60), True)], [(3, "c", at(61), False), (9, "z", at(90), True)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "job long, payload string, ts timestamp, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/f{i}")
    in_order(tmp_path / "in")
    source = spark.readStream.schema("job long, payload string, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    U.retry_queue(source).writeStream.outputMode("append").format("memory").queryName("queue").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    told = sorted((r["job"], r["failures"], r["event"]) for r in spark.table("queue").collect())
    assert told == [(1, 1, "send"), (1, 2, "send"), (2, 1, "done"), (2, 1, "send"), (3, 1, "send"), (3, 4, "failed")]


def test_fresh_responses_as_a_stream(spark, tmp_path):
    """Stream and batch agree on shuffled input; a second answer of a query and a late one are dropped."""
    from datetime import datetime, timedelta

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    good = [(f"q{i}", at(i % 7), (f"q{i}", "h"), (f"q{i}", "h")) for i in range(20)]
    stale = [(f"s{i}", at(i % 5), (f"s{i}", "h"), (f"q{i}", "h")) for i in range(5)]
    layout = "query_id string, ts timestamp, expected struct<query_id:string,image_hash:string>, actual struct<query_id:string,image_hash:string>"
    first = (good + stale)[::-1] + good[:3]
    for i, rows in enumerate((first, [("x", at(60), ("x", "h"), ("x", "h"))], [("y", at(61), ("y", "h"), ("x", "h"))], [("late", at(1), ("late", "h"), ("late", "h"))])):
        spark.createDataFrame(rows, layout).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    in_order(tmp_path / "in")
    source = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    U.fresh_responses(source).writeStream.outputMode("append").format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    batch = {r["query_id"] for r in L.stale_responses(spark.createDataFrame(first, layout)).where("error IS NULL").collect()}
    assert sorted(r["query_id"] for r in spark.table("fresh").collect()) == sorted(batch | {"x"})


def test_retry_stream(spark, tmp_path):
    attempts = [(1, 1, False), (1, 2, False), (2, 1, False), (2, 2, True)] + [(3, i, False) for i in range(4)]
    spark.createDataFrame(attempts, "job long, seq long, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job long, seq long, ok boolean").parquet(f"{tmp_path}/in")
    q = U.retry_states(stream).writeStream.outputMode("update").format("memory").queryName("retries").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["job"]: r["state"] for r in spark.table("retries").collect()} == {1: "retry", 2: "done", 3: "failed"}
