"""Seeds shared by the repeat finders: winnowed anchors, joined across documents without pairs.

Every window of `reach` consecutive units (words or bytes) picks the k-gram with the least hash inside it, its anchor.
Equal windows pick equal anchors, so only windows whose anchor also stands in another document can repeat.

1. `shared_anchors`: documents send their anchors, dealt by hash in blocks; per chunk of documents a hash is sent at
   most twice (least and largest document), so that an anchor of a third of all rows stays small.
2. Anchors of two documents or more go back to their documents.
3. Documents cut the candidate windows around these anchors (see `windows_of`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import as_bytes, chunks, mix, partitions, ranges, rolling, sliding_min

CHUNK_BYTES = 2 << 20
#: Bytes of an anchor's hash that are sent beside its bucket.
KEPT = 5


class Units:
    """Sequences of units of several texts, one after the other: `bounds[i]:bounds[i + 1]` is text i."""

    def __init__(self, grams: np.ndarray, bounds: np.ndarray, k: int, reach: int):
        """grams: hash of the k units from each position on (positions too near the end are left out)."""
        starts, sizes = bounds[:-1], np.diff(bounds)
        #: positions of windows inside one text, and their texts
        self.at = ranges(starts, sizes - reach + 1)
        self.text = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - reach + 1))
        self.anchor = sliding_min(grams, reach - k + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)


def words_units(hashes: np.ndarray, bounds: np.ndarray, k: int, reach: int) -> Units:
    return Units(rolling(hashes, k), bounds, k, reach)


def eight_bytes(buf: np.ndarray, n: int, shift: int) -> np.ndarray:
    """The eight bytes from each of the first n positions + shift on, as one number."""
    return np.ndarray((n,), "<u8", buf.data if buf.flags.c_contiguous else buf.tobytes(), shift, (1,)).astype(np.uint64)


def bytes_units(buf: np.ndarray, bounds: np.ndarray, k: int, reach: int) -> Units:
    """k: a multiple of eight."""
    n = max(0, len(buf) - k + 1)
    total = np.zeros(n, np.uint64)
    for shift in range(0, k, 8):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + eight_bytes(buf, n, shift)) if n else total
    return Units(total, bounds, k, reach)


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Indexes where any of the keys changes."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


_SEEDS = "bucket int, ids binary, counts binary, hashes binary"


def shared_anchors(docs: DataFrame, units, n_buckets: int) -> DataFrame:
    """doc_id, anchors (hashes) of documents with anchors that another document has too.

    docs: doc_id, text.  units: texts -> Units.  Hashes of a bucket keep their low five bytes, and go back to a document as
    four: two that are confused only cost work, as windows are compared anew."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, batch in enumerate(chunks(batches, "text", CHUNK_BYTES)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            u = units(as_bytes(batch.column(1)))
            if not len(u.anchor):
                continue
            first = first_of_runs(u.anchor, u.text)
            anchor, doc = u.anchor[first], ids[u.text[first]]
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            keep = first_of_runs(anchor, doc)
            anchor, doc = anchor[keep], doc[keep]
            begin = first_of_runs(anchor)
            end = np.append(begin[1:], len(anchor)) - 1
            shared = np.repeat(end > begin, np.diff(np.append(begin, len(anchor))))
            # known here to be shared: go straight back to their documents
            known, known_doc = anchor[shared], doc[shared]
            yield from rows(np.full(len(known), aside(n_buckets, serial)), known_doc, known)
            sent = np.unique(np.concatenate([begin, end]))
            anchor, doc = anchor[sent], doc[sent]
            yield from rows((anchor >> np.uint64(48)).astype(np.int64) % n_buckets, doc, anchor)

    def rows(bucket: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(doc):
            return
        order = np.lexsort((doc, bucket))
        bucket, doc, anchor = bucket[order], doc[order], anchor[order]
        runs = first_of_runs(bucket, doc)
        counts = np.diff(np.append(runs, len(doc))).astype(np.int32)
        blocks = first_of_runs(bucket)
        low = anchor.view(np.uint8).reshape(-1, 8)[:, :KEPT]
        edges, run_edges = np.append(blocks, len(doc)), np.append(np.searchsorted(runs, blocks), len(runs))
        out = [(int(bucket[a]), doc[runs[i:j]].tobytes(), counts[i:j].tobytes(), low[a:b].tobytes()) for a, b, i, j in zip(edges[:-1], edges[1:], run_edges[:-1], run_edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "ids", "counts", "hashes"])

    def join(group: pa.Table) -> pa.Table:
        doc, h = unpacked(group)
        if group.column("bucket")[0].as_py() >= n_buckets:
            return per_part(n_buckets, doc, {"anchors": h.astype(np.uint32)})
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        begin = first_of_runs(h)
        sizes = np.diff(np.append(begin, len(h)))
        several = np.repeat(doc[begin] != doc[begin + sizes - 1], sizes) if len(h) else np.zeros(0, bool)
        return per_part(n_buckets, doc[several], {"anchors": h[several].astype(np.uint32)})

    sent = docs.mapInArrow(seeds, _SEEDS)
    joined = sent.groupBy("bucket").applyInArrow(join, "part int, docs binary, anchors binary")
    return of_each_doc(joined, {"anchors": np.uint32})


def aside(n_buckets: int, serial: int) -> int:
    """A bucket, beyond those that compare, for what a chunk knows by itself."""
    return n_buckets + (TaskContext.get().partitionId() * 31 + serial) % n_buckets


def unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, counts, hashes = (b"".join(group.column(c).to_pylist()) for c in ("ids", "counts", "hashes"))
    low = np.zeros((len(hashes) // KEPT, 8), np.uint8)
    low[:, :KEPT] = np.frombuffer(hashes, np.uint8).reshape(-1, KEPT)
    return np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32)), low.view(np.uint64).ravel()


def per_part(n: int, doc: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """What a bucket knows of many documents, dealt to n parts by document: a row for each part, not for each document."""
    part = (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    edges = np.append(first_of_runs(part[order]), len(order)).tolist()
    cut = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    return pa.table({"part": pa.array(part[order][edges[:-1]], pa.int32()), "docs": cut(doc.astype(np.int64))} | {c: cut(x) for c, x in columns.items()})


def of_each_doc(parts: DataFrame, kinds: dict[str, type]) -> DataFrame:
    """doc_id and the bytes of each column's values, a row for each document."""

    def collect(group: pa.Table) -> pa.Table:
        doc = np.frombuffer(b"".join(group.column("docs").to_pylist()), np.int64)
        order = np.argsort(doc, kind="stable")
        begin = first_of_runs(doc[order])
        edges = np.append(begin, len(doc)).tolist()
        out = {"doc_id": pa.array(doc[order][begin], pa.int64())}
        for c, kind in kinds.items():
            x = np.frombuffer(b"".join(group.column(c).to_pylist()), kind)[order]
            out[c] = pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        return pa.table(out)

    return parts.groupBy("part").applyInArrow(collect, "doc_id long, " + ", ".join(f"{c} binary" for c in kinds))


def candidate(units: Units, anchors: list) -> np.ndarray:
    """Which windows have an anchor that their document shares; anchors: per text, the bytes of their hashes."""
    sets = [np.frombuffer(x or b"", np.uint32) for x in anchors]
    text = np.repeat(np.arange(len(sets)), [len(x) for x in sets]).astype(np.uint64)
    salt = lambda t: mix(t.astype(np.uint64) + np.uint64(1))
    known = np.unique(np.concatenate(sets).astype(np.uint64) ^ salt(text)) if len(text) else np.zeros(0, np.uint64)
    own = units.anchor.astype(np.uint32).astype(np.uint64) ^ salt(units.text)
    first = first_of_runs(own)
    hit = np.isin(own[first], known)
    return np.repeat(hit, np.diff(np.append(first, len(own))))


def n_buckets_for(docs: DataFrame, bytes_a_bucket: int) -> int:
    from .texts import text_bytes

    return int(min(1 << 16, max(partitions(docs.sparkSession), -(-text_bytes(docs) // bytes_a_bucket))))


_RUN = {"starts": np.int32, "lengths": np.int32, "sources": np.int64, "source_starts": np.int32}
_RUNS = "part int, docs binary, starts binary, lengths binary, sources binary, source_starts binary"


def run_rows(n: int, doc: np.ndarray, at: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> pa.Table:
    """Windows that repeat one of an earlier document, as runs of consecutive windows with consecutive sources."""
    order = np.lexsort((at, doc))
    doc, at, source, source_at = doc[order], at[order], source[order], source_at[order]
    line = np.arange(len(at))
    begin = first_of_runs(doc, source, at - line, source_at - line)
    lengths = np.diff(np.append(begin, len(at)))
    columns = zip(_RUN, (at[begin], lengths, source[begin], source_at[begin]), strict=True)
    return per_part(n, doc[begin], {c: v.astype(_RUN[c]) for c, v in columns})


def by_doc(runs: DataFrame) -> DataFrame:
    """All runs of a document in one row."""
    return of_each_doc(runs, _RUN).select("doc_id", F.struct(*_RUN).alias("runs"))


def read_runs(runs: dict | None) -> list[np.ndarray]:
    """starts, lengths, sources, source_starts of a document's runs, by start; touching runs of one source joined."""
    out = [np.frombuffer(runs[c] if runs else b"", kind).astype(np.int64) for c, kind in _RUN.items()]
    order = np.lexsort((out[3], out[2], out[0]))
    starts, lengths, sources, source_starts = (x[order] for x in out)
    if len(starts):
        begin = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + lengths[:-1]) | (sources[1:] != sources[:-1]) | (source_starts[1:] - starts[1:] != source_starts[:-1] - starts[:-1])]))
        ends = (starts + lengths)[np.append(begin[1:], len(starts)) - 1]
        return [starts[begin], ends - starts[begin], sources[begin], source_starts[begin]]
    return [starts, lengths, sources, source_starts]
