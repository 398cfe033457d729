"""Shared helpers of the training-data operators: byte-level words, hashes and scratch folders.

Texts are handled as UTF-8 bytes inside tasks.  All separators are ASCII, so word borders found on bytes are the
borders found on code points.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Words are runs of digits, letters a-z (A-Z are lowered) and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
PIECES = 8


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024, 2 * len(_powers)), _MULTIPLIER, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that every bit of a hash depends on every bit of its input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Words:
    """Words of several texts: byte spans in `buf`, `bounds[i]:bounds[i + 1]` being the words of text i."""

    def __init__(self, texts: list[bytes], separator: np.ndarray = BLANK, lower: bool = False):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        inside = np.concatenate([[False], ~separator[self.buf]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)])[: len(texts) + 1]
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self._separator = separator

    def __len__(self) -> int:
        return len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        value = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value[self._separator] = 0
        out = np.empty(len(self), np.uint64)
        for first in range(0, len(self), 32768):  # blocks that stay in the processor's cache
            last = min(first + 32768, len(self))
            begin, end = int(self.starts[first]), int(self.ends[last - 1])
            starts = self.starts[first:last] - begin
            gaps = np.diff(np.append(starts, end - begin))
            at = np.arange(end - begin) - np.repeat(starts, gaps)
            terms = value[self.buf[begin:end]]
            terms *= powers(int(gaps.max()))[at]
            out[first:last] = np.add.reduceat(terms, starts)
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def piece_hashes(self) -> np.ndarray:
        """Like hashes, other values, from eight bytes at a time: a step for each word instead of each byte.  Words of more
        than PIECES such pieces are rare, and get theirs from hashes."""
        pieces = np.ndarray(len(self.buf), "<u8", np.append(self.buf, np.zeros(8, np.uint8)), strides=(1,))
        inside = (np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1)
        inside = np.append(inside, ~np.uint64(0))
        size = self.ends - self.starts
        out = mix((pieces[self.starts] & inside[np.minimum(size, 8)]) * _MULTIPLIER + size.astype(np.uint64))
        which = np.flatnonzero((size > 8) & (size <= 8 * PIECES))
        at, left = self.starts[which] + 8, size[which] - 8
        while len(which):
            out[which] = mix(out[which] * _MULTIPLIER + (pieces[at] & inside[np.minimum(left, 8)]))
            more = left > 8
            which, at, left = which[more], at[more] + 8, left[more] - 8
        which = np.flatnonzero(size > 8 * PIECES)
        if len(which):
            out[which] = Words([self.buf[self.starts[i] : self.ends[i]].tobytes() for i in which], self._separator).hashes()
        return out


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive items, ignoring text borders; len(hashes) - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Doubling: hash of 2m items from hashes of m items; any k is a sum of powers of two.
    total, done, block, size = None, 0, hashes, 1
    while True:
        if k & size:
            part = block[done : done + n]
            total = part if total is None else mix(total * _MULTIPLIER + part)
            done += size
        if done == k:
            return total
        block = mix(block[:-size] * _MULTIPLIER + block[size:] + np.uint64(size))
        size *= 2


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values; len(values) - w + 1 of them."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    size = 1
    while 2 * size <= w:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[w - size : w - size + n])


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut and keep batches so that each holds about `limit` bytes of `column`, or one longer text."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.fromiter((x or 0 for x in pc.binary_length(batch.column(at)).to_pylist()), np.int64, batch.num_rows)
        total = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) for all pairs."""
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return np.zeros(0, np.int64)
    out = np.ones(int(lengths.sum()), np.int64)
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


def spans_of(positions: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) covered by windows of `reach` items that start at the sorted positions."""
    if not len(positions):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], np.diff(positions) > reach]))
    return positions[new], positions[np.append(new[1:], len(positions)) - 1] + reach


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  A local session has one process, so there alone
    an own folder is made where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: later steps don't depend on the executors that made it."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by one aggregate over that column alone."""
    from pyspark.sql import functions as F

    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (long) and text (string) of docs.  Columns that have these names and types are taken as they are, so that
    two uses in one plan look alike and share their shuffle of the texts."""
    from pyspark.sql import functions as F

    kinds = dict(docs.dtypes)
    as_is = lambda c, name, kind: F.col(c) if (c, kinds.get(c)) == (name, kind) else F.col(c).cast("long" if kind == "bigint" else kind).alias(name)
    return docs.select(as_is(id_col, "doc_id", "bigint"), as_is(text_col, "text", "string"))


def text_key(docs: DataFrame, text) -> object:
    """A digest of 64 bits of a text column (not null) by which different texts of docs surely differ: digests of another
    64 bits tell whether any two collide, and then the next seed is taken."""
    from pyspark.sql import functions as F

    seed = 0
    while True:
        key = F.xxhash64(F.lit(seed), text) if seed else F.xxhash64(text)
        other = docs.select(key.alias("key"), F.xxhash64(F.lit(-1), text).alias("other")).groupBy("key").agg(F.min("other").alias("least"), F.max("other").alias("most"))
        if other.where("least <> most").isEmpty():
            return key
        seed += 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """key (long), text (string) and row (all columns of docs, as one struct, so that no name can clash), and the number
    of low bits in which keys of one id differ.

    A key stands for an id and a text, in the order of ids, and is null for a null id.  Where no id is repeated it is
    the id itself and there are 0 such bits; so it is where only whole rows are repeated.  Else ids are numbered in their order and the texts of an id by digest."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    if rows.where("key IS NOT NULL").groupBy("key").count().where("count > 1").isEmpty():
        return rows, 0
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    own = rows.where("key IS NOT NULL").select("key", digest.alias("digest")).distinct()
    own = stored(own.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("digest")) - 1), "row-keys")
    bits = int(own.agg(F.max("nth")).first()[0]).bit_length()
    if not bits:  # whole rows are repeated, but no id has two texts
        return rows, 0
    ids = own.select("key").distinct().repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    place = F.monotonically_increasing_id()
    ids = stored(ids.withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND((1 << 33) - 1)), "row-ids")
    most = ids.agg(F.max("at")).first()[0] + 1
    number = own.join(ids, "key").select("key", "digest", F.shiftleft(F.col("part") * most + F.col("at"), bits).bitwiseOR(F.col("nth").cast("long")).alias("number"))
    joined = rows.withColumn("digest", digest).join(stored(number, "row-numbers"), ["key", "digest"], "left")
    return joined.select(F.col("number").alias("key"), "text", "row"), bits


def with_ids(found: DataFrame, rows: DataFrame, bits: int, id_col: str) -> DataFrame:
    """found with the id in doc_id instead of the key."""
    from pyspark.sql import functions as F

    if not bits:
        return found
    ids = rows.where("key IS NOT NULL").select(F.col("key").alias("__key"), F.col("row").getField(id_col).cast("long").alias("__id")).distinct()
    return found.join(ids, F.col("doc_id") == F.col("__key"), "left").withColumn("doc_id", F.col("__id")).select(*found.columns)


FILTER_BITS, FILTER_BLOCK = 24, 18


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int32)


def id_filter(ids: DataFrame) -> object:
    """A broadcast bitmap of 2 MB, whatever the number of ids (one column of longs, not null): it tells ids that are
    surely not among them.  It only saves work; what passes it is still joined."""
    from pyspark.sql import functions as F

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(batch.column(0).to_numpy(zero_copy_only=False)))], ["slot"])

    def bits(group: pa.Table) -> pa.Table:
        on = np.zeros(1 << FILTER_BLOCK, bool)
        on[group.column("slot").to_numpy() & ((1 << FILTER_BLOCK) - 1)] = True
        return pa.table({"block": group.column("block")[:1], "bits": [np.packbits(on).tobytes()]})

    found = ids.mapInArrow(slots, "slot int").distinct().withColumn("block", F.shiftright("slot", FILTER_BLOCK))
    whole = np.zeros((1 << (FILTER_BITS - FILTER_BLOCK), (1 << FILTER_BLOCK) // 8), np.uint8)
    for r in found.groupBy("block").applyInArrow(bits, "block int, bits binary").collect():  # at most 64 rows of 32 KB
        whole[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole.ravel())


def may_hold(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be among those of a filter's bitmap."""
    at = _slots(ids)
    return (bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def held(known: object, ids: pa.Array) -> np.ndarray:
    """As may_hold, of a filter and a column; false for null.  Made for a step that does something to the texts as well:
    a filter of its own would be a second Python worker beside that step's in each task."""
    return may_hold(known.value, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)) & pc.is_valid(ids).to_numpy(zero_copy_only=False)


def pack(texts: pa.Array) -> pa.Array:
    """Texts with their lengths in front, compressed: this is what is shuffled."""
    codec = pa.Codec("zstd", 1)
    return pa.array([None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unpack(column: pa.Array) -> list[bytes | None]:
    codec = pa.Codec("zstd")
    return [None if x is None else codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in column.to_pylist()]


#: Rows in a batch that goes to Python: texts can be long, and a batch is held whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB has no crc32: a table of its 256 steps, and the sum over the bytes of a text {0} with that table, t.
CRC_TABLE_SQL = """crc AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) c FROM range(256) r(i)))"""
CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen({0}) + 1), lambda k: CAST('0x' || substr(hex({0}), 2 * k - 1, 2) AS BIGINT))),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""
