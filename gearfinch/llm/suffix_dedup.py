"""Suffix-array dedup of byte strings.

Bytes covered by a string of `reach` bytes that also starts in a document with a smaller id are removed.

1. Anchors (`repeats`) leave the windows that can repeat at all; each is dealt by its anchor, so that equal windows meet.
   What is dealt are fragments: runs of windows of one anchor, with their bytes.  Equal fragments in a chunk, or in a
   shard, are one: the least document keeps it.
2. Each shard sorts the suffixes of its fragments by external induced sorting (`induced_sort`: disk-backed queues,
   recursion on names), walks the suffix array with the common prefixes of neighbours, cut at `reach`, and gives every
   run of equal prefixes its least document.  Neighbours' common prefixes are compared, up to `reach`, on the finished
   array rather than carried through the queues: only whether they get to `reach` matters here.
3. Windows with an earlier document go back to their documents as runs.

Matches never cross documents.  Null counts as empty.  Documents without an id are neither compared nor changed.  Rows
of one id never remove each other's bytes, but each is judged by its own text.  A text of any length is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .induced_sort import suffix_array
from .texts import as_bytes, chunks, keyed, mix, plain, ranges, spans_of, table, with_ids

REACH, SEED = 50, 24
SHARD_BYTES = 8 << 20

_FRAGMENTS = "bucket int, n int, size long, docs binary, starts binary, lengths binary, anchors binary, bytes binary, sources binary, source_starts binary"


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts) + bytes(8), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def _units(texts: list[bytes], reach: int, seed: int) -> R.Units:
    buf, bounds = _joined(texts)
    return R.bytes_units(buf, bounds, seed, reach)


def _digest(buf: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """A digest of the `reach` bytes from each place on."""
    words = np.ndarray((max(0, len(buf) - 7),), "<u8", buf.tobytes(), 0, (1,))
    h = np.full(len(at), reach, np.uint64)
    for shift in [*range(0, reach - 7, 8), reach - 8]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + shift])
    return h


def _equal_fragments(buf, at, lengths, doc, place, reach, bits) -> tuple[np.ndarray, np.ndarray]:
    """For fragments (lengths: windows in each) the index of the least-document equal one, and whether that is of a
    smaller id.  Digests of the first and last window propose it, all bytes decide."""
    digest = mix(_digest(buf, at, reach) * np.uint64(3) + mix(_digest(buf, at + lengths - 1, reach)) + lengths.astype(np.uint64))
    order = np.lexsort((place, doc, digest))
    first = R.first_of_runs(digest[order])
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
    copy = doc >> bits != doc[least] >> bits
    own = np.flatnonzero(copy)
    for a in range(0, len(own), 1 << 14):
        part = own[a : a + (1 << 14)]
        sizes = lengths[part] + reach - 1
        differ = (buf[ranges(at[part], sizes)] != buf[ranges(at[least[part]], sizes)]) | np.repeat(lengths[part] != lengths[least[part]], sizes)
        copy[part] = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
    return least, copy


def repeated_runs(docs: DataFrame, reach: int = REACH, seed: int = SEED, bits: int = 0) -> DataFrame:
    """doc_id, runs of windows of `reach` bytes that also start in a document with a smaller id.  Ids that differ in
    their low bits alone are equal."""
    n = R.n_buckets_for(docs, SHARD_BYTES)
    shared = R.shared_anchors(docs, lambda texts: _units(texts, reach, seed), n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, batch in enumerate(chunks(batches, "text", R.CHUNK_BYTES)):
            buf, bounds = _joined(as_bytes(batch.column(1)))
            units = R.bytes_units(buf, bounds, seed, reach)
            keep = R.candidate(units, batch.column(2).to_pylist())
            at, text, anchor = units.at[keep], units.text[keep], units.anchor[keep]
            first = R.first_of_runs(anchor, text, at - np.arange(len(at)))
            # an anchor that recurs makes longer runs: they are cut so that a fragment's first and last window cover it
            nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            first = np.flatnonzero(nth % reach == 0)
            lengths = np.diff(np.append(first, len(at)))
            at, text, anchor = at[first], text[first], anchor[first]
            doc, place = batch.column(0).to_numpy()[text], at - bounds[text]
            least, copy = _equal_fragments(buf, at, lengths, doc, place, reach, bits)
            gone = np.flatnonzero(copy)
            yield from _rows(np.full(len(gone), R.aside(n, serial)), doc[gone], place[gone], lengths[gone], None, None, None, doc[least[gone]], place[least[gone]], reach)
            sent = np.flatnonzero(~copy)
            yield from _rows((anchor[sent] >> np.uint64(48)).astype(np.int64) % n, doc[sent], place[sent], lengths[sent], anchor[sent], buf, at[sent], None, None, reach)

    def sort(group: pa.Table) -> pa.Table:
        doc, place, lengths = (_opened(group, c) for c in ("docs", "starts", "lengths"))
        if group.column("bucket")[0].as_py() >= n:
            source, source_at = _opened(group, "sources"), _opened(group, "source_starts")
            return R.run_rows(n, np.repeat(doc, lengths), ranges(place, lengths), np.repeat(source, lengths), ranges(source_at, lengths))
        buf = np.concatenate([_opened(group, "bytes"), np.zeros(8, np.uint8)])
        sizes = lengths + reach - 1
        at = np.cumsum(sizes) - sizes
        least, copy = _equal_fragments(buf, at, lengths, doc, place, reach, bits)
        known = np.flatnonzero(copy)
        found = [(np.repeat(doc[known], lengths[known]), ranges(place[known], lengths[known]), np.repeat(doc[least[known]], lengths[known]), ranges(place[least[known]], lengths[known]))]
        # an anchor with one distinct fragment left has nothing to be compared with
        own = np.flatnonzero(~copy)
        _, which, many = np.unique(_anchors(group)[own], return_inverse=True, return_counts=True)
        own = own[many[which] > 1]
        text = buf[ranges(at[own], sizes[own])]
        starts = np.cumsum(sizes[own]) - sizes[own]
        valid = np.zeros(len(text), bool)
        valid[ranges(starts, lengths[own])] = True
        order = suffix_array(text, 256, reach=reach)
        order = np.asarray(order)[valid[order]]
        if len(order):
            fragment = np.searchsorted(starts, order, "right") - 1
            own_doc, own_place = doc[own][fragment], place[own][fragment] + order - starts[fragment]
            equal = _same_prefix(text, order, reach)
            group_of = np.cumsum(np.concatenate([[False], ~equal]))
            rank = np.lexsort((own_place, own_doc, group_of))
            first = R.first_of_runs(group_of[rank])
            source = np.repeat(rank[first], np.diff(np.append(first, len(rank))))
            later = own_doc[rank] >> bits != own_doc[source] >> bits
            rank, source = rank[later], source[later]
            found.append((own_doc[rank], own_place[rank], own_doc[source], own_place[source]))
        return R.run_rows(n, *(np.concatenate(x) for x in zip(*found, strict=True)))

    found = docs.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "anchors").mapInArrow(cut, _FRAGMENTS)
    return R.by_doc(found.groupBy("bucket").applyInArrow(sort, R._RUNS))


def _same_prefix(text: np.ndarray, order: np.ndarray, reach: int) -> np.ndarray:
    """Whether neighbours in the suffix array have a common prefix of `reach` bytes or more."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
    words = np.ndarray((len(text) + 1,), "<u8", padded, 0, (1,))
    equal = np.ones(max(0, len(order) - 1), bool)
    for shift in [*range(0, reach - 7, 8), reach - 8]:
        w = words[order + shift]
        equal &= w[1:] == w[:-1]
    return equal


_KINDS = {"docs": np.int64, "starts": np.int32, "lengths": np.int32, "bytes": np.uint8, "sources": np.int64, "source_starts": np.int32}


def _opened(group: pa.Table, column: str) -> np.ndarray:
    """A compressed column of all rows of a shard, as one array."""
    codec, kind = pa.Codec("zstd"), np.dtype(_KINDS[column])
    sizes = group.column("size").to_pylist() if column == "bytes" else [kind.itemsize * k for k in group.column("n").to_pylist()]
    parts = [np.frombuffer(codec.decompress(x, size), kind) for x, size in zip(group.column(column).to_pylist(), sizes, strict=True)]
    return np.concatenate(parts) if column == "bytes" else np.concatenate(parts).astype(np.int64)


def _anchors(group: pa.Table) -> np.ndarray:
    three = np.frombuffer(b"".join(group.column("anchors").to_pylist()), np.uint8).reshape(-1, 3)
    return three[:, 0].astype(np.uint32) | three[:, 1].astype(np.uint32) << 8 | three[:, 2].astype(np.uint32) << 16


def _rows(bucket, doc, place, lengths, anchor, buf, at, source, source_at, reach) -> Iterator[pa.RecordBatch]:
    """A row for each bucket; columns compressed, three bytes of each anchor."""
    if not len(doc):
        return
    codec = pa.Codec("zstd", 3)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, place, lengths = bucket[order], doc[order], place[order], lengths[order]
    edges = np.append(R.first_of_runs(bucket), len(bucket)).tolist()
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    pack = lambda x, name: [codec.compress(x[a:b].astype(_KINDS[name]).tobytes(), asbytes=True) for a, b in spans]
    none, total = [b""] * len(spans), [0] * len(spans)
    content = anchors = sources = source_starts = none
    if buf is not None:
        sizes = lengths + reach - 1
        whole = buf[ranges(at[order], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        total = [ends[b] - ends[a] for a, b in spans]
        content = [codec.compress(whole[ends[a] : ends[b]].tobytes(), asbytes=True) for a, b in spans]
        low = np.ascontiguousarray(anchor[order]).view(np.uint8).reshape(-1, 8)[:, :3]
        anchors = [low[a:b].tobytes() for a, b in spans]
    else:
        sources, source_starts = pack(source[order], "sources"), pack(source_at[order], "source_starts")
    columns = [pack(doc, "docs"), pack(place, "starts"), pack(lengths, "lengths"), anchors, content, sources, source_starts]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array([b - a for a, b in spans], pa.int32()), pa.array(total, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)],
        ["bucket", "n", "size", "docs", "starts", "lengths", "anchors", "bytes", "sources", "source_starts"],
    )


def deduplicated(docs: DataFrame, reach: int = REACH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs as start, end), kept (bytes that stay) and repeats (maximal
    repeats as start, n_bytes, source, source_start).  A source is an id; where ids repeat, it is the number of an id
    and text (see texts.keyed)."""
    rows, bits = keyed(docs, id_col, text_col)
    docs = rows.select(F.col("key").alias("doc_id"), "text") if bits else plain(docs, id_col, text_col)
    known = docs.where("doc_id IS NOT NULL")
    runs = repeated_runs(known, reach, seed, bits)
    span, repeat = pa.struct([("start", pa.int64()), ("end", pa.int64())]), pa.struct([("start", pa.int64()), ("n_bytes", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                starts, lengths, sources, source_starts = R.read_runs(own)
                begin, end = (x.tolist() for x in spans_of(np.unique(ranges(starts, lengths)), reach))
                kept = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in zip(begin, end, strict=True)], kept, [{"start": a, "n_bytes": n + reach - 1, "source": s, "source_start": t} for a, n, s, t in zip(starts.tolist(), lengths.tolist(), sources.tolist(), source_starts.tolist(), strict=True)]))
            if out:
                types = (pa.int64(), pa.int64(), pa.list_(span), pa.binary(), pa.list_(repeat))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "repeats"])

    layout = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, repeats array<struct<start:long,n_bytes:long,source:long,source_start:long>>"
    joined = known.join(runs.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "runs")
    nameless = docs.where("doc_id IS NULL").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    return with_ids(joined.unionByName(nameless).mapInArrow(cut, layout), rows, bits, id_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) m FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 49)) i FROM d WHERE len(h) >= 100)),
f AS (SELECT m, min(doc_id) first FROM s GROUP BY m HAVING min(doc_id) < max(doc_id)),
w AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL new FROM s JOIN f USING (m) WHERE doc_id > first),
g AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) g FROM w),
r AS (SELECT doc_id, g, min(i) a, max(i) + 50 b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) n FROM r),
t AS (SELECT d.doc_id, count(*) n_spans, sum(b - a) n_removed, any_value(substr(h, 1, CAST(2 * first_a AS BIGINT))) || string_agg(substr(h, CAST(2 * b + 1 AS BIGINT), CAST(coalesce(2 * (n - b), len(h)) AS BIGINT)), '' ORDER BY a) kept
  FROM (SELECT *, min(a) OVER (PARTITION BY doc_id) first_a FROM k) k JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
