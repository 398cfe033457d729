"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in segments of a few megabytes, each one row: sorted term digests, and for every term the
ascending list of its word positions.  A test phrase is matched inside each segment by intersecting the position lists
of its terms, moved by their offsets, from the rarest term (by corpus-wide count) on.  The index is stored, so any
number of test sets can be run against it; building it and matching are both narrow, only term counts are shuffled.

Null and empty texts have no words and match nothing; null document ids are kept; repeated rows are separate documents.
Words are compared by 64-bit digests.  A text of any length is indexed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import NOT_ALNUM, Words, as_bytes, chunks, ranges, stored, table

SEGMENT_BYTES = 4 << 20
ITEMS_A_BLOCK = 5000
#: Above this many bytes of test items, blocks of items are paired with segments without a broadcast.
BROADCAST_BYTES = 32 << 20
WINDOW = 13

_INDEX = "segment long, doc_ids array<long>, bounds binary, terms binary, firsts binary, positions binary"
_HITS = "segment long, row int, doc_id long, n_words long, at array<int>, items array<string>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the positional index of `docs` and return it: a row for each segment."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, "text", SEGMENT_BYTES):
            words = Words(as_bytes(batch.column(1)), NOT_ALNUM, lower=True)
            hashes = words.hashes()
            order = np.argsort(hashes, kind="stable")
            sorted_ = hashes[order]
            firsts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) | serial]),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (words.bounds.astype(np.int64), sorted_[firsts], firsts.astype(np.int32), order.astype(np.int32))),
                ],
                ["segment", "doc_ids", "bounds", "terms", "firsts", "positions"],
            )
            serial += 1

    built = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(index, _INDEX)
    spark = docs.sparkSession
    from .texts import scratch

    built.write.option("parquet.block.size", 16 << 20).parquet(path := scratch(spark, "postings"))
    return spark.read.schema(_INDEX).parquet(path)


class Segment:
    """One row of the index, with membership tests on its position lists."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        self.size = max(1, len(positions))
        self.firsts = np.append(np.frombuffer(row["firsts"], np.int32).astype(np.int64), len(positions))
        #: term number * words + position, ascending: one searchsorted tests many (term, position) pairs
        self.lists = np.repeat(np.arange(len(self.terms)), np.diff(self.firsts)) * self.size + positions
        self.positions = positions

    def term_numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == hashes, at, -1) if len(self.terms) else np.full(len(hashes), -1)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = term * self.size + position
        at = np.minimum(np.searchsorted(self.lists, wanted), len(self.lists) - 1)
        return (self.lists[at] == wanted) & (position >= 0) & (position < self.size)

    def next_position(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first position of term at or after position, or a large number."""
        at = np.searchsorted(self.lists, term * self.size + position)
        found = self.lists[np.minimum(at, len(self.lists) - 1)]
        return np.where((at < len(self.lists)) & (found // self.size == term), found % self.size, np.int64(1) << 60)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, "right") - 1


class Items:
    """A block of test items: word digests with their corpus-wide counts."""

    def __init__(self, row: dict):
        self.ids = row["item_ids"] or []
        self.words = np.frombuffer(row["words"] or b"", np.uint64)
        self.bounds = np.frombuffer(row["item_bounds"] or bytes(8), np.int64)
        self.counts = np.frombuffer(row["counts"] or b"", np.int64)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, first word and width of each window; an item of fewer words is one window."""
        sizes = np.diff(self.bounds)
        many = np.where(sizes == 0, 0, np.maximum(1, sizes - width + 1))
        item = np.repeat(np.arange(len(sizes)), many)
        return item, ranges(self.bounds[:-1], many), np.minimum(sizes, width)[item]


def phrase_hits(segment: Segment, items: Items, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of a window: item, first word position, length."""
    item, first, length = items.windows(width)
    none = np.zeros(0, np.int64)
    if not len(first) or not len(segment.terms):
        return none, none, none
    number = segment.term_numbers(items.words)
    offsets = np.minimum(np.arange(width)[None, :], length[:, None] - 1)  # short windows repeat their last word
    at = first[:, None] + offsets
    there = (number[at] >= 0).all(axis=1)
    item, length, at, offsets = item[there], length[there], at[there], offsets[there]
    order = np.argsort(items.counts[at], axis=1, kind="stable")
    terms, offsets = np.take_along_axis(number[at], order, 1), np.take_along_axis(offsets, order, 1)
    many = segment.firsts[terms[:, 0] + 1] - segment.firsts[terms[:, 0]]
    window = np.repeat(np.arange(len(item)), many)
    start = segment.positions[ranges(segment.firsts[terms[:, 0]], many)] - offsets[window, 0]
    for k in range(1, width):
        if not len(window):
            return none, none, none
        keep = segment.holds(terms[window, k], start + offsets[window, k])
        window, start = window[keep], start[keep]
    last = start + length[window] - 1
    keep = segment.doc_of(start) == segment.doc_of(last)
    return item[window[keep]], start[keep], length[window[keep]]


def proximity_hits(segment: Segment, items: Items, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of an item's rarest term with all its other terms within `slop` words of it, in the same document:
    item, position of the rarest term, 1."""
    none = np.zeros(0, np.int64)
    if not len(segment.terms) or not len(items.words):
        return none, none, none
    number, found = segment.term_numbers(items.words), []
    for i in range(len(items.bounds) - 1):
        span = slice(items.bounds[i], items.bounds[i + 1])
        terms, at = np.unique(number[span], return_index=True)
        if not len(terms) or terms[0] < 0:
            continue
        terms = terms[np.argsort(items.counts[span][at], kind="stable")]
        position = segment.positions[segment.firsts[terms[0]] : segment.firsts[terms[0] + 1]]
        for t in terms[1:]:
            doc = segment.doc_of(position)
            low, high = np.maximum(position - slop, segment.bounds[doc]), np.minimum(position + slop, segment.bounds[doc + 1] - 1)
            position = position[segment.next_position(np.full(len(position), t), low) <= high]
        found.append((np.full(len(position), i), position))
    if not found:
        return none, none, none
    item, position = (np.concatenate(x) for x in zip(*found, strict=True))
    return item, position, np.ones(len(position), np.int64)


def item_blocks(index: DataFrame, items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Test items in blocks, each word with its count in the corpus; the number of blocks and of bytes."""
    items = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_A_BLOCK))

    def tokens(group: pa.Table) -> pa.Table:
        words = Words(as_bytes(group.column("text")), NOT_ALNUM, lower=True)
        return pa.table(
            {"block": group.column("block")[:1], "item_ids": pa.array([[x or "" for x in group.column("item_id").to_pylist()]]), "words": [words.hashes().tobytes()], "item_bounds": [words.bounds.astype(np.int64).tobytes()]},
            pa.schema([("block", pa.int64()), ("item_ids", pa.list_(pa.string())), ("words", pa.binary()), ("item_bounds", pa.binary())]),
        )

    layout = "block long, item_ids array<string>, words binary, item_bounds binary"
    spark = index.sparkSession
    cut = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).groupBy("block").applyInArrow(tokens, layout)
    cut = stored(spark.range(blocks).withColumnRenamed("id", "block").join(cut, "block", "left"), "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.unique(np.frombuffer(row["words"] or b"", np.uint64))
                terms = np.frombuffer(row["terms"], np.uint64)
                if len(terms) and len(words):
                    many = np.diff(np.append(np.frombuffer(row["firsts"], np.int32), row["n"]))
                    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
                    hit = terms[at] == words
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), row["block"])), pa.array(words[hit].view(np.int64)), pa.array(many[at[hit]].astype(np.int64))], ["block", "term", "n"])

    lists = index.select("terms", "firsts", (F.octet_length("positions") / 4).cast("long").alias("n"))
    counts = paired(lists, cut.select("block", "words"), size).mapInArrow(count, "block long, term long, n long").groupBy("block", "term").agg(F.sum("n").alias("n"))

    def with_counts(key: tuple, block: pa.Table, counted: pa.Table) -> pa.Table:
        words = np.frombuffer(block.column("words")[0].as_py() or b"", np.uint64)
        term = counted.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        term, n = term[order], counted.column("n").to_numpy()[order]
        at = np.minimum(np.searchsorted(term, words), max(0, len(term) - 1))
        own = np.where(term[at] == words, n[at], 0) if len(term) else np.zeros(len(words), np.int64)
        return block.append_column("counts", pa.array([own.astype(np.int64).tobytes()], pa.binary()))

    full = cut.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(with_counts, layout + ", counts binary")
    return stored(full, "items-counted"), blocks, size


def paired(index: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Each segment with each block of test items (a stated query set, in blocks)."""
    return index.crossJoin(F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks)


def matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW, slop: int | None = None) -> DataFrame:
    """A row for each document row of the index: doc_id, n_words, `at` (its words that matches cover, from 0) and
    `items` (ids of matching items, distinct).  Exact phrases of `width` words, or, if slop is given, proximity
    matches: `at` then holds places of an item's rarest term.  With no items or an empty one there are no matches."""
    blocks, n_blocks, size = item_blocks(index, items, id_col, text_col)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                segment, block = Segment(row), Items(row)
                item, start, length = phrase_hits(segment, block, width) if slop is None else proximity_hits(segment, block, slop)
                docs = len(segment.ids)
                at = np.unique(ranges(start, length))
                rows = np.unique(segment.doc_of(start) * max(1, len(block.ids)) + item)
                doc_of_item, item = np.divmod(rows, max(1, len(block.ids)))
                doc = segment.doc_of(at)
                cut, cut_items = np.searchsorted(doc, np.arange(docs + 1)), np.searchsorted(doc_of_item, np.arange(docs + 1))
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(docs, row["segment"])),
                        pa.array(np.arange(docs, dtype=np.int32)),
                        pa.array(segment.ids, pa.int64()),
                        pa.array(np.diff(segment.bounds)),
                        pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((at - segment.bounds[doc]).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cut_items.astype(np.int32)), pa.array([block.ids[x] for x in item], pa.string())),
                    ],
                    ["segment", "row", "doc_id", "n_words", "at", "items"],
                )
                yield out if row["block"] == 0 else out.filter(pa.array(np.diff(cut_items) > 0))

    found = paired(index, blocks, size).mapInArrow(match, _HITS)
    if n_blocks > 1:
        found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.flatten(F.collect_list("items")).alias("items"))
    return found.select("doc_id", "n_words", "at", F.array_distinct("items").alias("items"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit (words inside a match), n_items, items_sha256 and contaminated (hit words make up
    a twentieth of the document or more)."""
    found = matches(build_index(docs), items)
    n_hit = F.size("at").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) n, array_to_string(w[i:i + 12], ' ') s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
