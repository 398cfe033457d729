"""Importance resampling towards a target corpus: array-scored weights, then parallel sorting by regular sampling.

Features are runs of 1 and 2 words, in BUCKETS buckets by crc32.  A bucket's gain is the logarithm of its smoothed share
of the target over its share of the corpus; a document's weight is the floored mean gain of its features, and its score
adds a Gumbel draw fixed by its id and the seed.  The highest scores are drawn.

Counts of a task are one array, summed by bucket; the gains are one array of BUCKETS numbers that every task holds, and
scoring is a sum over it.  Exact ranks of all eligible rows come from parallel sorting by regular sampling: every task
sorts its own scored rows and stores the run; each run gives every `spacing`-th row as a sample; the sorted samples give
regularly placed splitters; rows are exchanged into the segments between splitters, each segment is merged by itself,
and prefix counts of the segments turn places into ranks.  A segment holds at most about twice its fair share, ties
included: the key ends with a row's place, so equal scores and ids are cut too.  Where runs are many, samples are first
merged and thinned in groups, so that no task and not the driver ever sorts more than SAMPLES of them.

Null text has no words: no features, weight 0, never drawn.  A null id has the draw of an empty one and stands behind
others in ties; repeated rows are separate rows.  Very long texts are read in blocks of about BLOCK_BYTES that end between
words.  Empty tables have no rows; an empty target counts nothing.  Columns are taken by name; others are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .texts import CRC_SQL, CRC_TABLE_SQL, partitions, stored, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_BYTES = 1 << 20
#: Rows of a sorted segment, about; samples of a run for each segment; samples that are sorted in one place at most.
SEGMENT_ROWS, OVERSAMPLING, SAMPLES = 1_000_000, 4, 200_000
#: Runs whose samples are merged and thinned together.
GROUP = 16


def blocks(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end behind a byte that no word has, or at its end."""
    first = 0
    while first < len(text):
        last = min(first + BLOCK_BYTES, len(text))
        if last < len(text):
            end = re.compile(rb"[^0-9A-Za-z\x80-\xff]").search(text, last)
            last = end.end() if end else len(text)
        yield text[first:last]
        first = last


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Words and buckets of the features of each block; a feature across blocks belongs to the later one."""
    before = None
    for block in blocks(text):
        words = WORD.findall(block.lower())  # bytes.lower() lowers A-Z alone
        if not words:
            continue
        single = [crc32(w) for w in words]
        # crc32 goes on where the word before, and a space, ended
        first = [] if before is None else [crc32(b" " + words[0], before)]
        pairs = [crc32(b" " + w, c) for w, c in zip(words[1:], single, strict=False)]
        before = single[-1]
        yield len(words), np.array(single + first + pairs, np.int64) % BUCKETS


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py() or b""


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket's features stand in all texts: one array, of BUCKETS numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in _texts(batch, "text"):
                for _, found in features(text):
                    total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long")
    counts = np.zeros(BUCKETS, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of target share over corpus share, both with one more of each bucket, floored."""
    s_all, t_all = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def draw(seed: int, doc_id: object) -> int:
    """1000 times a Gumbel number, floored, fixed by seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, carry: list[str], seed: int) -> DataFrame:
    """doc_id, row (the carried columns), n_words, n_features, weight, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("__none"), *carry).alias("row"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch, "text"), strict=True):
                n_words = n = total = 0
                for words, found in features(text):
                    n_words, n, total = n_words + words, n + len(found), total + int(gain[found].sum())
                weight = total // n if n else 0
                numbers.append((n_words, n, weight, weight + draw(seed, doc_id)))
            own = [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)] if numbers else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *own], ["doc_id", "row", "n_words", "n_features", "weight", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(weigh, f"doc_id {kinds['doc_id']}, row {kinds['row']}, n_words long, n_features long, weight long, score long")


# ---- parallel sorting by regular sampling


def runs(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows, sorted within each task and stored, with place: the run in its high bits, the row's number in the low 33."""
    return stored(rows.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "sorted-runs")


def splitters(sorted_runs: DataFrame, key: Column, segments: int) -> list[tuple]:
    """segments - 1 keys, at regular places of the sorted samples.  Every run gives each `spacing`-th row."""
    run, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    n, n_runs = sorted_runs.agg(F.count("*"), F.count_distinct(run)).first()
    if not n or segments < 2:
        return []
    spacing = max(1, n // (segments * OVERSAMPLING * n_runs))
    samples = sorted_runs.where(at % spacing == spacing // 2).select(run.alias("node"), key.alias("key"))
    total = n // spacing
    while total > SAMPLES and n_runs > 1:  # merge the samples of a group of runs, and thin them regularly
        nth = F.row_number().over(Window.partitionBy("node").orderBy("key"))
        samples = samples.withColumn("node", F.floor(F.col("node") / GROUP)).withColumn("nth", nth).where(f"nth % {GROUP} = {GROUP // 2}").drop("nth")
        samples, total, n_runs = stored(samples, "samples"), total // GROUP, -(-n_runs // GROUP)
    found = sorted(tuple(r["key"]) for r in samples.select("key").collect())  # SAMPLES rows about
    return [found[i * len(found) // segments] for i in range(1, segments) if found] if found else []


def ranked(rows: DataFrame, keys: list[str], segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, int]:
    """rows with rank: 1, 2, .. in ascending order of keys (longs, not null), where `eligible`; else null.  And how many
    are eligible."""
    spark = rows.sparkSession
    every = runs(rows, [F.desc("eligible"), *keys])
    order = [*keys, "place"]
    key = F.struct(*order)
    chosen = every.where("eligible")
    n = chosen.count()
    segments = max(1, min(partitions(spark), n), -(-n // segment_rows))
    cuts = splitters(chosen, key, segments)
    columns = np.array(cuts, np.int64).reshape(-1, len(order)).T

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(cuts)
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in order]
            # cuts stand before equal keys: a row's segment is the number of cuts up to it
            both = [np.concatenate([c, x]) for c, x in zip(columns, own, strict=True)] if m else own
            tie = np.concatenate([np.zeros(m, np.int8), np.ones(len(batch), np.int8)])
            sorted_at = np.lexsort([tie, *both[::-1]])
            segment = np.empty(len(sorted_at), np.int64)
            segment[sorted_at] = np.cumsum(sorted_at < m)
            yield batch.append_column("segment", pa.array(segment[m:], pa.int32()))

    dealt = chosen.mapInArrow(deal, StructType([*chosen.schema.fields, StructField("segment", IntegerType())]))
    dealt = stored(dealt.withColumn("nth", F.row_number().over(Window.partitionBy("segment").orderBy(*order))), "merged-segments")
    sizes = {r["segment"]: r["n"] for r in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # one row a segment
    before, total = [], 0
    for s in range(segments):
        before.append(total)
        total += sizes.get(s, 0)
    offsets = spark.createDataFrame(list(enumerate(before)), "segment int, before long")
    first = dealt.join(offsets, "segment").select(*rows.columns, (F.col("before") + F.col("nth")).alias("rank"))
    return first.unionByName(every.where("NOT eligible").select(*rows.columns, F.lit(None).cast("long").alias("rank"))), n


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", carry: tuple[str, ...] = (), percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, the carried columns of docs, n_features, weight, score and rank of every row; rank is null for what is not
    drawn.  `carry` gives the drawn rows whole, texts included: resampled(..., carry=docs.columns).where("rank > 0")."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    rows = scored(docs, gain, id_col, text_col, list(carry), seed)
    least = -(1 << 63)
    numeric = F.col("doc_id").cast("long")
    rows = rows.select(
        "*", (F.col("n_words") >= least_words).alias("eligible"), (-F.col("score")).alias("low"), numeric.isNull().cast("long").alias("no_id"), F.coalesce(numeric, F.lit(least)).alias("by_id"),
    )
    found, eligible = ranked(rows, ["low", "no_id", "by_id", "n_features", "weight"])
    rank = F.when(F.col("rank") <= eligible * percent // 100, F.col("rank")).cast("long").alias("rank")
    return found.select("doc_id", *(F.col("row").getField(c).alias(c) for c in carry if c != id_col), "n_features", "weight", "score", rank)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Buckets are computed once for each distinct feature.
OP11_SQL = f"""
WITH {CRC_TABLE_SQL},
w AS (SELECT 1 corpus, row_number() OVER () rn, doc_id, text FROM documents UNION ALL SELECT 0, row_number() OVER (), NULL, text FROM benchmark),
l AS (SELECT corpus, rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM w),
f AS (SELECT corpus, rn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f FROM l),
b AS (SELECT f, {CRC_SQL.format("f")} % {BUCKETS} b FROM (SELECT DISTINCT f FROM f), crc),
c AS (SELECT b, count(*) FILTER (WHERE corpus = 1) s, count(*) FILTER (WHERE corpus = 0) t FROM f JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM c) + {BUCKETS}) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM c) + {BUCKETS})))) gain FROM c),
x AS (SELECT rn, count(*) n, floor(sum(gain) / count(*)) weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE corpus = 1 GROUP BY rn),
y AS (SELECT rn, doc_id, len(w) n_words, coalesce(n, 0) n_features, coalesce(weight, 0) weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) score
  FROM l LEFT JOIN x USING (rn) WHERE corpus = 1),
z AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) r, count(*) OVER () n FROM y WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) n_features, CAST(weight AS BIGINT) weight, CAST(score AS BIGINT) score, CAST(CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS BIGINT) rank
FROM y LEFT JOIN z USING (rn)
"""
