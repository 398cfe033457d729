"""Substring dedup by seed and extend, on words.

Documents are joined on winnowed anchors (`repeats`).  Matches are extended both ways from each shared anchor by the
128-bit digests of all windows of `reach` words around it: inside the anchor's bucket equal windows find their least
document, and neighbouring windows with neighbouring sources are chained into maximal repeats over the length threshold.
No pairs of documents are made: an anchor of n documents costs n rows at most, and copies within a chunk send one.

Null and empty texts have no words.  Documents without an id are neither compared nor changed.  Rows of one id never
remove each other's words, but each is judged by its own text.  A text of any length is handled whole.  Words
are compared by digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .texts import Words, as_bytes, chunks, keyed, mix, plain, ranges, rolling, spans_of, table, with_ids

REACH, SEED = 50, 20
BUCKET_BYTES = 16 << 20


def _units(texts: list[bytes], reach: int, seed: int) -> R.Units:
    words = Words(texts)
    return R.words_units(words.hashes(), words.bounds, seed, reach)


def repeated_runs(docs: DataFrame, reach: int = REACH, seed: int = SEED, bits: int = 0) -> DataFrame:
    """doc_id, runs: windows of `reach` words that also start in a document with a smaller id, as runs of
    (starts, lengths, sources, source_starts).  docs: doc_id, text, ids not null; ids that differ in their low bits
    alone are equal."""
    n = R.n_buckets_for(docs, BUCKET_BYTES)
    shared = R.shared_anchors(docs, lambda texts: _units(texts, reach, seed), n)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, batch in enumerate(chunks(batches, "text", R.CHUNK_BYTES)):
            words = Words(as_bytes(batch.column(1)))
            hashes = words.hashes()
            units = R.words_units(hashes, words.bounds, seed, reach)
            keep = R.candidate(units, batch.column(2).to_pylist())
            at, text, anchor = units.at[keep], units.text[keep], units.anchor[keep]
            window = _digests(hashes, reach, at)
            doc, at = batch.column(0).to_numpy()[text], at - words.bounds[text]
            order = np.lexsort((at, doc, window[:, 1], window[:, 0]))
            first = R.first_of_runs(window[order, 0], window[order, 1])
            least = np.repeat(order[first], np.diff(np.append(first, len(order))))
            later = doc[order] >> bits != doc[least] >> bits
            again, source = order[later], least[later]
            if len(again):  # a copy in this chunk is earlier: surely removed
                yield from _blocks(np.full(len(again), R.aside(n, serial)), doc[again], at[again], window[again], doc[source], at[source])
            sent = np.sort(order[~later])
            yield from _blocks((anchor[sent] >> np.uint64(48)).astype(np.int64) % n, doc[sent], at[sent], window[sent], None, None)

    def earliest(group: pa.Table) -> pa.Table:
        doc, at, window = _unpacked(group)
        if group.column("bucket")[0].as_py() >= n:
            source, source_at, lengths = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("sources", "source_starts", "lengths"))
            return R.run_rows(n, doc, at, np.repeat(source, lengths), ranges(source_at, lengths))
        order = np.lexsort((at, doc, window[:, 1], window[:, 0]))
        doc, at, window = doc[order], at[order], window[order]
        first = R.first_of_runs(window[:, 0], window[:, 1])
        least = np.repeat(first, np.diff(np.append(first, len(window))))
        later = doc >> bits != doc[least] >> bits
        return R.run_rows(n, doc[later], at[later], doc[least[later]], at[least[later]])

    layout = "bucket int, docs binary, starts binary, lengths binary, windows binary, sources binary, source_starts binary"
    found = docs.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "anchors").mapInArrow(windows, layout)
    return R.by_doc(found.groupBy("bucket").applyInArrow(earliest, R._RUNS))


def _digests(hashes: np.ndarray, reach: int, at: np.ndarray) -> np.ndarray:
    """Two digests of the `reach` words from each place on, of 64 bits each: equal windows are told by both."""
    if not len(at):
        return np.zeros((0, 2), np.uint64)
    return np.stack([rolling(hashes, reach)[at], rolling(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), reach)[at]], axis=1)


def _blocks(bucket, doc, at, window, source, source_at) -> Iterator[pa.RecordBatch]:
    """Windows in runs of consecutive ones, a row for each bucket."""
    if not len(doc):
        return
    order = np.lexsort((at, doc, bucket))
    bucket, doc, at, window = bucket[order], doc[order], at[order], window[order]
    line = np.arange(len(at))
    keys = [bucket, doc, at - line]
    if source is not None:
        source, source_at = source[order], source_at[order]
        keys += [source, source_at - line]
    begin = R.first_of_runs(*keys)
    lengths = np.diff(np.append(begin, len(at))).astype(np.int64)
    blocks = R.first_of_runs(bucket[begin])
    edges = np.append(blocks, len(begin))
    at_edges = np.append(begin, len(at))[edges]
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    none = [b""] * len(blocks)
    columns = [
        cut(doc[begin].astype(np.int64)),
        cut(at[begin].astype(np.int64)),
        cut(lengths),
        [window[a:b].tobytes() for a, b in zip(at_edges[:-1], at_edges[1:], strict=True)] if source is None else none,
        none if source is None else cut(source[begin].astype(np.int64)),
        none if source is None else cut(source_at[begin].astype(np.int64)),
    ]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[begin][blocks].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "docs", "starts", "lengths", "windows", "sources", "source_starts"])


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, at, lengths = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("docs", "starts", "lengths"))
    return np.repeat(doc, lengths), ranges(at, lengths), np.frombuffer(b"".join(group.column("windows").to_pylist()), np.uint64).reshape(-1, 2)


def deduplicated(docs: DataFrame, reach: int = REACH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words that stay, joined by blanks) and repeats: maximal repeats as
    (start, n_words, source, source_start) in words.  A source is an id; where ids repeat, it is the number of an id and
    text (see texts.keyed)."""
    rows, bits = keyed(docs, id_col, text_col)
    docs = rows.select(F.col("key").alias("doc_id"), "text") if bits else plain(docs, id_col, text_col)
    known = docs.where("doc_id IS NOT NULL")
    runs = repeated_runs(known, reach, seed, bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs_ in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()  # bytes split at ASCII white space only
                starts, lengths, sources, source_starts = R.read_runs(runs_)
                begin, end = spans_of(np.unique(ranges(starts, lengths)), reach)
                kept, last = [], 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                found = [{"start": a, "n_words": n + reach - 1, "source": s, "source_start": t} for a, n, s, t in zip(starts.tolist(), lengths.tolist(), sources.tolist(), source_starts.tolist(), strict=True)]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), found))
            if out:
                n, r, k, f = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.string()), pa.array(f, kind)], ["doc_id", "n_words", "n_removed", "kept_text", "repeats"])

    layout = "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<start:long,n_words:long,source:long,source_start:long>>"
    joined = known.join(runs.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "runs")
    nameless = docs.where("doc_id IS NULL").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    return with_ids(joined.unionByName(nameless).mapInArrow(cut, layout), rows, bits, id_col)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) first FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, list(DISTINCT p) gone FROM (SELECT doc_id, unnest(range(i, i + 50)) p FROM s JOIN f USING (h) WHERE doc_id > first) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) n, w, coalesce(gone, []) gone FROM d LEFT JOIN r USING (doc_id)),
t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) kept FROM (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p FROM d) a
      ANTI JOIN (SELECT doc_id, unnest(gone) p FROM r) b USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) n_words, CAST(len(gone) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM k LEFT JOIN t USING (doc_id)
"""
