"""Line dedup as an exact set-similarity join over the words of lines.

A line is the set of its words.  It is removed if an earlier line, by (doc_id, line number), has Jaccard similarity of
`threshold` or more with it; lines are judged on the input, so an earlier line counts even if it goes itself.

1. Words are counted into a fixed table of counters (a one-row count-min sketch, SLOTS bytes after scaling, so small
   enough to send to every task at any scale).  It gives one total order of words, rarest first.
2. Every line sends its prefix, the n - ceil(t n) + 1 rarest words, dealt by word; words that occur once send nothing.
   A very frequent word's entries are dealt by word and length band: each line also goes, as a guest, to the next band,
   the only other one with lines that it may be similar to.  Equal lines meet by a 128-bit digest: all but the earliest
   go, and send nothing more where they are equal within a chunk.
3. Of the entries of a word only pairs that pass the length, positional and parity filters are proposed.  All three are
   bounds that no similar pair misses: the parity bitmap of a set (one bit flipped by each word) differs from another
   one's in at most as many bits as the sets differ in words.
   In a large group lines are first held against its earliest lines, so that a group of near copies makes a pair for
   each line; of other lines the PROPOSED likeliest partners are told.
4. Proposed pairs are verified on the words of both lines: of each later line its likeliest partner first, then the
   others.  A line whose partners all fail, though a word has more of them than were told, is compared with every
   partner that it has by such words; only lines that hold one of these words are cut to sets once more.

Lines without words are never removed.  Null and empty texts have none.  Documents without an id are neither compared
nor changed.  Rows of one id and different texts are different documents, ordered by the texts' digests; rows that
repeat both are one document.  A text of any length is handled whole.  Words are compared by 64-bit digests before they
are verified; digests only propose pairs, but for equal lines, where the digest has 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import CHUNK_BYTES, first_of_runs, n_buckets_for
from .texts import Words, as_bytes, chunks, held, id_filter, keyed, may_hold, mix, pack, ranges, stored, table, unpack

THRESHOLD = 0.8
SLOT_BITS, BLOCK_BITS = 24, 16
BUCKET_BYTES = 8 << 20
#: Partners that are told of each line and word.
PROPOSED = 8
#: In groups of more than LARGE entries lines are first held against the LEADERS earliest ones.
LARGE, LEADERS = 64, 8
#: Level (see word_levels) of words whose entries are dealt by length too: 131,072 occurrences.
FREQUENT = 167
#: Pairs that are filtered at a time.
PAIRS = 1 << 20
#: Marks beside an entry's place in its line: a guest, and an entry of a frequent word.
GUEST, OFTEN = 1 << 30, 1 << 29
#: In the filter of open words: this and a token are the entries of a word (in a band, if frequent), a token alone is the word.
BAND = np.uint64(1 << 32)

LOW = np.uint64(0xFFFFFFFF)
_ENTRY = [("token", np.uint32), ("prev", np.uint32), ("digest", np.uint32), ("bits", np.uint64), ("more_bits", np.uint64), ("doc", np.int64), ("line", np.int32), ("n", np.int32), ("pos", np.int32)]
_DIGEST = [("low", np.uint64), ("high", np.uint64), ("doc", np.int64), ("line", np.int32)]
_FOUND = [("doc", np.int64), ("line", np.int32), ("a_doc", np.int64), ("a_line", np.int32), ("apart", np.int16), ("more", np.uint64)]
_LAYOUT = "bucket int, size int, columns array<binary>"


def at_least(share: float, n: np.ndarray) -> np.ndarray:
    """ceil(share * n), safe against rounding."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def band_key(n: np.ndarray, guest: np.ndarray, threshold: float) -> np.ndarray:
    """A number of 64 bits for the band of a frequent word where lines of n words stand; guests stand in the next band."""
    return mix(np.floor(np.log(n) / np.log(1 / threshold) + 1e-9).astype(np.uint64) + guest.astype(np.uint64) + np.uint64(1))


def word_levels(docs: DataFrame) -> np.ndarray:
    """The scaled counters: exact to 127, then four steps an octave, to 255."""
    slots = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            slot = np.sort((Words(as_bytes(batch.column(0))).piece_hashes() >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
            first = first_of_runs(slot)
            n, slot = np.diff(np.append(first, len(slot))), slot[first]
            block = (slot >> np.uint32(BLOCK_BITS)).astype(np.int32)
            edges = np.append(first_of_runs(block), len(block))
            low = (slot & np.uint32(slots - 1)).astype(np.uint16)
            out = [(int(block[a]), low[a:b].tobytes(), n[a:b].astype(np.int32).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "slots", "counts"])

    def add(group: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(group.column("slots").to_pylist()), np.uint16)
        n = np.bincount(low, np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int32), slots)
        level = np.where(n <= 127, n, np.minimum(255, 127 + 4 * (np.log2(np.maximum(n, 1)) - 7)))
        return pa.table({"block": group.column("block")[:1], "levels": [level.astype(np.uint8).tobytes()]})

    rows = docs.select("text").mapInArrow(count, "block int, slots binary, counts binary").groupBy("block").applyInArrow(add, "block int, levels binary").collect()
    levels = np.zeros((1 << (SLOT_BITS - BLOCK_BITS), slots), np.uint8)  # a fixed number of rows of fixed size
    for r in rows:
        levels[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return levels.ravel()


class Lines:
    """Word sets of the lines of several texts, words in order of rarity."""

    def __init__(self, texts: list[bytes], levels: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None = None):
        """wanted tells of words whether lines that hold them are wanted; else all lines are."""
        words = Words(texts)
        hashes, starts = words.piece_hashes(), words.starts
        breaks = np.flatnonzero(words.buf == 10)
        # grows by one at each break and each text
        line = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1)[: len(starts)]) + words.text_of_word()
        if wanted is not None and len(starts):
            some = np.zeros(line[-1] + 1, bool)
            some[line[wanted(hashes)]] = True
            some = some[line]
            hashes, starts, line = hashes[some], starts[some], line[some]
        # words are numbered in order of rarity, so that one sort of numbers orders the words of all lines
        known, number = np.unique(hashes, return_inverse=True)
        level = levels[known >> np.uint64(64 - SLOT_BITS)]
        order = np.argsort(level, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        both = np.sort(line.astype(np.int64) << 32 | rank[number])
        both = both[first_of_runs(both)]
        of, which = both >> 32, order[both & 0xFFFFFFFF] if len(both) else both
        self.tokens, self.levels = known[which], level[which]
        self.first = first_of_runs(of)
        place = starts[np.searchsorted(line, of[self.first])] if len(of) else of
        self.text = np.searchsorted(words.text_starts, place, "right") - 1
        self.number = np.searchsorted(breaks, place) - np.searchsorted(breaks, words.text_starts[self.text])
        self.n = np.diff(np.append(self.first, len(of)))
        add = lambda x: np.add.reduceat(x, self.first) if len(x) else x
        self.low, self.high = add(mix(self.tokens)), add(mix(self.tokens ^ np.uint64(0xA0761D6478BD642F)))
        flip = lambda shift: np.bitwise_xor.reduceat(np.uint64(1) << (self.tokens >> np.uint64(shift) & np.uint64(63)), self.first) if len(of) else self.tokens
        self.bits, self.more_bits = flip(20), np.zeros(len(self.n), np.uint64)
        # sets of more than 64 words have 128 bits: half of the words flip bits of the second half
        second = self.tokens >> np.uint64(26) & np.uint64(1) == 1
        long_ = self.n > 64
        if long_.any():
            one = np.uint64(1) << (self.tokens >> np.uint64(20) & np.uint64(63))
            self.bits = np.where(long_, np.bitwise_xor.reduceat(np.where(second, np.uint64(0), one), self.first), self.bits)
            self.more_bits = np.where(long_, np.bitwise_xor.reduceat(np.where(second, one, np.uint64(0)), self.first), self.more_bits)


def _rows(bucket: np.ndarray, columns: list[np.ndarray], kinds: list) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, columns compressed."""
    if not len(bucket):
        return
    codec = pa.Codec("zstd", 1)
    order = np.argsort(bucket, kind="stable")
    edges = np.append(first_of_runs(bucket[order]), len(bucket)).tolist()
    parts = [c[order].astype(t) for c, (_, t) in zip(columns, kinds, strict=True)]
    cut = [[codec.compress(c[a:b].tobytes(), asbytes=True) for c in parts] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    sizes = np.diff(edges).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[order][edges[:-1]].astype(np.int32)), pa.array(sizes), pa.array(cut, pa.list_(pa.binary()))], ["bucket", "size", "columns"])


def _read(group: pa.Table, kinds: list) -> list[np.ndarray]:
    codec, sizes, columns = pa.Codec("zstd"), group.column("size").to_pylist(), group.column("columns").to_pylist()
    return [np.concatenate([np.frombuffer(codec.decompress(x[k], n * np.dtype(t).itemsize), t) for x, n in zip(columns, sizes, strict=True)]) for k, (_, t) in enumerate(kinds)]


def _found(n_parts: int, doc, line, a_doc, a_line, apart, more) -> pa.Table:
    """What is known of later lines, dealt to n_parts by document.  a_line is -1 for a line that surely goes."""
    part = (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n_parts)).astype(np.int32)
    batches = list(_rows(part, [doc, line, a_doc, a_line, apart, more], _FOUND))
    return pa.Table.from_batches(batches, pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("columns", pa.list_(pa.binary()))]))


def _sure(n_parts: int, doc, line) -> pa.Table:
    zero = np.zeros(len(doc), np.int64)
    return _found(n_parts, doc, line, zero, zero - 1, zero, zero)


class Entries:
    """Entries of words, sorted by word and length of line; no two of one word have equal sets."""

    def __init__(self, token, prev, bits, more_bits, doc, line, n, pos, threshold: float):
        self.token, self.prev, self.bits, self.more_bits, self.doc, self.line, self.n = token, prev, bits, more_bits, doc, line, n
        self.guest, self.often, self.rest = pos & GUEST > 0, pos & OFTEN > 0, (n - pos % OFTEN).astype(np.int32)
        self.share, self.threshold = threshold / (1 + threshold), threshold
        self.key = token.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)
        self.low_key = token.astype(np.uint64) << np.uint64(32) | at_least(threshold, n).astype(np.uint64)

    def named(self, i) -> np.ndarray:
        """The word of i and, in the high half, the token under which its entries of this band stand."""
        band = np.where(self.often[i], band_key(self.n[i], self.guest[i], self.threshold), np.uint64(0)) & LOW
        return self.token[i].astype(np.uint64) << np.uint64(32) | self.token[i].astype(np.uint64) ^ band

    def need(self, i, j) -> np.ndarray:
        """Words that similar lines share at least."""
        return at_least(self.share, self.n[i] + self.n[j])

    def later(self, i, j) -> np.ndarray:
        """Whether i's line comes after j's."""
        return (self.doc[i] > self.doc[j]) | ((self.doc[i] == self.doc[j]) & (self.line[i] > self.line[j]))

    def apart(self, i, j) -> np.ndarray:
        """Bits in which the bitmaps differ; 1,000 where no pair of different sets can be similar."""
        count = lambda x: np.bitwise_count(x).astype(np.int16)
        low, high = self.bits[i] ^ self.bits[j], self.more_bits[i] ^ self.more_bits[j]
        wide = (self.n[i] > 64) == (self.n[j] > 64)
        # where one bitmap has 128 bits and the other 64, both halves together are the short one
        found = np.where(wide, count(low) + count(high), count(low ^ high))
        most = self.n[i] + self.n[j] - 2 * self.need(i, j)
        same_size = self.n[i] == self.n[j]
        # different sets differ in a word, those of equal size in two
        return np.where((found > most) | (most < 1 + same_size) | ((self.doc[i] == self.doc[j]) & (self.line[i] == self.line[j])), 1000, found)

    def near_leader(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of large groups that may be similar to one of the group's LEADERS earliest lines, with the likeliest of
        these and the bits in which they differ."""
        first = first_of_runs(self.token)
        size = np.diff(np.append(first, len(self.token)))
        large = np.flatnonzero(size > LARGE)
        if not len(large):
            return (np.zeros(0, np.int64),) * 3
        member = ranges(first[large], size[large])
        begin = np.cumsum(size[large]) - size[large]
        order = member[np.lexsort((self.line[member], self.doc[member], np.repeat(large, size[large])))]
        best, least = np.zeros(len(member), np.int64), np.full(len(member), 1000, np.int16)
        for k in range(LEADERS):
            leader = np.repeat(order[begin + k], size[large])
            fit = np.minimum(self.n[member], self.n[leader]) >= at_least(self.threshold, np.maximum(self.n[member], self.n[leader]))
            d = np.where(fit & self.later(member, leader), self.apart(member, leader), 1000)
            best, least = np.where(d < least, leader, best), np.minimum(least, d)
        near = least < 1000
        return member[near], best[near], least[near]

    def pairs(self, linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (later, earlier, bits apart) that pass all filters and whose later entry isn't linked.  A similar pair
        passes at the rarest word that it shares: there all shared words stand at or after both places."""
        every, free = np.arange(len(self.key)), np.flatnonzero(~linked)
        host = ~self.guest
        for i, others in ((free[host[free]], every), (np.flatnonzero(linked & host), free)):
            # the shorter line of a pair stands in the window before the longer one
            low, high = np.searchsorted(self.key[others], self.low_key[i]), np.searchsorted(others, i)
            many = np.maximum(0, high - low)
            ends, first = np.cumsum(many), 0
            while first < len(i):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                x, y = np.repeat(i[first:last], many[first:last]), others[ranges(low[first:last], many[first:last])]
                first = last
                keep = np.flatnonzero((np.minimum(self.rest[x], self.rest[y]) >= self.need(x, y)) & ((self.prev[x] == 0) | (self.prev[x] != self.prev[y])))
                x, y = x[keep], y[keep]
                d = self.apart(x, y)
                keep = np.flatnonzero(d < 1000)
                x, y, d = x[keep], y[keep], d[keep]
                swap = self.later(y, x)
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                keep = ~linked[x]
                yield x[keep], y[keep], d[keep]


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, line (from 0) of lines to remove, each once.  docs: key (not null), text."""
    spark = docs.sparkSession
    n_buckets = n_buckets_for(docs, BUCKET_BYTES)
    levels = spark.sparkContext.broadcast(word_levels(docs))

    def prefixes(batches: Iterator[pa.RecordBatch], only=None) -> Iterator[pa.RecordBatch]:
        """Entries, digests and copies in a chunk; or entries alone, of words that may be in the filter `only`."""
        for serial, batch in enumerate(chunks(batches, "text", CHUNK_BYTES)):
            ids = batch.column(0).to_numpy()
            # lines that hold no word of the filter have no entries to send
            wanted = None if only is None else lambda hashes: may_hold(only.value, hashes & LOW)
            lines = Lines(as_bytes(batch.column(1)), levels.value, wanted)
            if not len(lines.n):
                continue
            doc = ids[lines.text]
            order = np.lexsort((lines.number, doc, lines.high, lines.low))
            first = first_of_runs(lines.low[order], lines.high[order])
            least = np.repeat(order[first], np.diff(np.append(first, len(order))))
            gone = order[(doc[order] != doc[least]) | (lines.number[order] != lines.number[least])]
            stays = np.zeros(len(doc), bool)
            stays[order[first]] = True
            # what a chunk knows by itself, dealt evenly
            aside = 2 * n_buckets + (TaskContext.get().partitionId() * 31 + serial) % n_buckets
            zero = np.zeros(len(gone), np.int64)
            own = order[first]
            if only is None:
                yield from _rows(np.full(len(gone), aside), [doc[gone], lines.number[gone], zero, zero - 1, zero, zero], _FOUND)
                yield from _rows(n_buckets + (lines.low[own] % np.uint64(n_buckets)).astype(np.int64), [lines.low[own], lines.high[own], doc[own], lines.number[own]], _DIGEST)
            size = np.where(stays, lines.n - at_least(threshold, lines.n) + 1, 0)
            of = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            at = lines.first[of] + pos
            some = lines.levels[at] > 1
            of, pos, at = of[some], pos[some], at[some]
            token, level = lines.tokens[at], lines.levels[at]
            # four bytes of the line's word sent before this one; 0 for the first
            prev = np.zeros(len(token), np.uint32)
            prev[1:] = np.where(of[1:] == of[:-1], token[:-1] % np.uint64(0xFFFFFFFF) + np.uint64(1), np.uint64(0))
            often = np.flatnonzero(level >= FREQUENT)
            mark = np.where(level >= FREQUENT, OFTEN, 0)
            home, guest = (token[often] ^ band_key(lines.n[of[often]], np.full(len(often), x), threshold) for x in (0, 1))
            token[often] = home
            token, mark = np.append(token, guest), np.append(mark, np.full(len(often), GUEST | OFTEN))
            which = np.append(np.arange(len(of)), often)
            of, pos, prev = of[which], pos[which] + mark, prev[which]
            if only is not None:
                some = may_hold(only.value, token & LOW | BAND)
                token, of, pos, prev = token[some], of[some], pos[some], prev[some]
            bucket = (token >> np.uint64(40)).astype(np.int64) % n_buckets
            yield from _rows(bucket, [token & LOW, prev, lines.low[of] & LOW, lines.bits[of], lines.more_bits[of], doc[of], lines.number[of], lines.n[of], pos], _ENTRY)

    def propose(later_docs=None):
        """later_docs: a filter of the documents whose lines seek all their partners; else all lines seek some."""
        every = later_docs is not None

        def run(group: pa.Table) -> pa.Table:
            bucket = group.column("bucket")[0].as_py()
            if bucket >= 2 * n_buckets:
                doc, line, *_ = _read(group, _FOUND)
                return _sure(n_buckets, doc, line)
            if bucket >= n_buckets:
                low, high, doc, line = _read(group, _DIGEST)
                order = np.lexsort((line, doc, high, low))
                doc, line = doc[order], line[order]
                first = first_of_runs(low[order], high[order])
                least = np.repeat(first, np.diff(np.append(first, len(order))))
                copy = (doc != doc[least]) | (line != line[least])  # a repeated row is not its own copy
                return _sure(n_buckets, doc[copy], line[copy])
            token, prev, digest, bits, more_bits, doc, line, n, pos = _read(group, _ENTRY)
            # equal sets: the earliest stands for all, which go by their digests
            order = np.argsort(mix(mix(token.astype(np.uint64) << np.uint64(32) | digest) + bits))
            begin = first_of_runs(*(x[order] for x in (token, n, bits, more_bits, digest, pos)))
            size = np.diff(np.append(begin, len(order)))
            many = np.flatnonzero(np.repeat(size, size) > 1)
            member = order[many]
            order[many] = member[np.lexsort((line[member], doc[member], np.repeat(np.arange(len(size)), size)[many]))]
            kept = order[begin]
            kept = kept[np.argsort(token[kept].astype(np.uint64) << np.uint64(32) | n[kept].astype(np.uint64))]
            e = Entries(*(x[kept] for x in (token, prev, bits, more_bits, doc, line, n, pos)), threshold)
            member, leader, d = (np.zeros(0, np.int64),) * 3 if every else e.near_leader()
            linked = ~may_hold(later_docs.value, e.doc) if every else np.zeros(len(e.key), bool)
            linked[member] = True
            out = [(member, leader, d, e.named(member))]
            parts = list(e.pairs(linked))
            if parts:
                later, earlier, d = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((earlier, d, later))
                later, earlier, d = later[order], earlier[order], d[order]
                begin = first_of_runs(later)
                size = np.diff(np.append(begin, len(later)))
                told = np.full(len(later), every) | (np.arange(len(later)) - np.repeat(begin, size) < PROPOSED)
                more = np.where(np.repeat(size > PROPOSED, size) & (not every), e.named(later), 0)
                out.append((later[told], earlier[told], d[told], more[told]))
            later, earlier, d, more = (np.concatenate(x) for x in zip(*out, strict=True))
            return _found(n_buckets, e.doc[later], e.line[later], e.doc[earlier], e.line[earlier], d, more)

        return run

    def settle(group: pa.Table) -> pa.Table:
        """A row for each line: its likeliest partner (line -1: it surely goes), the others, and words with more."""
        doc, line, a_doc, a_line, apart, more = _read(group, _FOUND)
        order = np.lexsort((a_line, a_doc, apart, a_line >= 0, line, doc))
        doc, line, a_doc, a_line, more = (x[order] for x in (doc, line, a_doc, a_line, more))
        begin = first_of_runs(doc, line)
        edges = np.append(begin, len(doc)).tolist()
        others, words = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a_line[a] < 0 or b == a + 1:
                others.append(None)
            else:
                rest = sorted(set(zip(a_doc[a:b].tolist(), a_line[a:b].tolist(), strict=True)) - {(int(a_doc[a]), int(a_line[a]))})
                others.append([{"a_doc": x, "a_line": y} for x, y in rest])
            words.append(np.unique(more[a:b][more[a:b] > 0]).view(np.int64).tolist() if a_line[a] >= 0 else None)
        kinds = (pa.list_(pa.struct([("a_doc", pa.int64()), ("a_line", pa.int32())])), pa.list_(pa.int64()))
        return pa.table({"b_doc": doc[begin], "b_line": line[begin], "a_doc": a_doc[begin], "a_line": a_line[begin], "others": pa.array(others, kinds[0]), "words": pa.array(words, kinds[1])})

    def proposals(only=None, later_docs=None) -> DataFrame:
        sent = docs.select("key", "text").mapInArrow(lambda batches: prefixes(batches, only), _LAYOUT)
        found = sent.groupBy("bucket").applyInArrow(propose(later_docs), _LAYOUT).groupBy("bucket")
        return found.applyInArrow(settle, "b_doc long, b_line int, a_doc long, a_line int, others array<struct<a_doc:long,a_line:int>>, words array<long>")

    told = stored(proposals(), "line-pairs")
    line = [F.col("b_doc").alias("key"), F.col("b_line").alias("line")]
    gone = told.where("a_line < 0").select(*line)
    failed = told.where("a_line >= 0")
    pair = ["b_doc", "b_line", "a_doc", "a_line"]

    def tried(pairs: DataFrame) -> bool:
        """Verify pairs; lines that have a similar one are gone and no longer failed."""
        nonlocal gone, failed
        pairs = stored(pairs, "line-open")
        if pairs.isEmpty():
            return False
        verified = stored(verify(docs, pairs, threshold), "line-verified")
        gone = gone.unionByName(verified.select(*line))
        failed = failed.join(verified, ["b_doc", "b_line"], "left_anti")
        return True

    # the likeliest partner of each line first, then the others
    exploded = lambda df: df.select("b_doc", "b_line", F.explode("others").alias("a")).select("b_doc", "b_line", "a.*")
    if tried(failed.select(*pair)):
        tried(exploded(failed))
        left = stored(failed.where("size(words) > 0"), "line-left")
        if not left.isEmpty():
            # every partner that these lines have by words of which not all were told
            open_words = left.select(F.explode("words").alias("word"))
            words = id_filter(open_words.select(F.explode(F.array(F.expr("word & 4294967295"), F.expr("shiftrightunsigned(word, 32) | 4294967296"))).alias("word")))
            own = id_filter(left.select("b_doc"))
            every = proposals(words, own).where("a_line >= 0").join(left.select("b_doc", "b_line"), ["b_doc", "b_line"], "left_semi")
            every = stored(every, "line-every")
            words.destroy()
            own.destroy()
            tried(every.select(*pair).unionByName(exploded(every)))
    levels.destroy()
    return gone


def verify(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """b_doc, b_line, each once, of pairs whose word sets are similar.  Only documents with such lines are sent, and
    only these lines of them are compared.  pairs: a stored table."""
    wanted = pairs.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")).union(pairs.select("b_doc", "b_line")).distinct()
    wanted = wanted.groupBy("doc").agg(F.collect_list("line").alias("lines"))
    known = id_filter(pairs.select(F.explode(F.array("a_doc", "b_doc")).alias("doc")))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(held(known, batch.column(0))))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(0), pack(own.column(1))], ["doc", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, lines in zip(batch.column(0).to_pylist(), unpack(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = (text or b"").split(b"\n")
                out += [(doc, k, own[k]) for k in lines]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc", "line", "words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = set(x.split()), set(y.split())
                both = len(x & y)
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    packed = docs.select("key", "text").mapInArrow(sent, "doc long, z binary")
    lines = packed.join(wanted.hint("shuffle_hash"), "doc").select("doc", "z", "lines").mapInArrow(cut, "doc long, line int, words binary")
    lines = stored(lines, "line-words")
    known.destroy()  # no later step needs it
    side = lambda c: lines.select(F.col("doc").alias(f"{c}_doc"), F.col("line").alias(f"{c}_line"), F.col("words").alias(f"{c}_words"))
    joined = pairs.join(side("b"), ["b_doc", "b_line"]).join(side("a"), ["a_doc", "a_line"]).select("b_doc", "b_line", "a_words", "b_words")
    return joined.mapInArrow(compare, "b_doc long, b_line int").distinct()


def _counts(text: bytes | None) -> int:
    return sum(1 for line in (text or b"").split(b"\n") if line.strip())


def without_lines(rows: DataFrame, gone: DataFrame, text_col: str) -> DataFrame:
    """row with the text that stays, n_lines and n_removed (lines with words).  rows: as `keyed` makes them."""
    by_doc = gone.groupBy("key").agg(F.collect_set("line").alias("gone"))
    known = id_filter(gone.select("key"))
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(z: pa.Array, gone: pa.Array) -> pa.Array:
        texts, n_lines, n_removed = [], [], []
        for x, own in zip(unpack(z), gone.to_pylist(), strict=True):
            n_lines.append(_counts(x))
            n_removed.append(len(own or ()))
            if own:
                drop = set(own)
                x = b"\n".join(line for i, line in enumerate((x or b"").split(b"\n")) if i not in drop)
            texts.append(x)
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], ["text", "n_lines", "n_removed"])

    def packed(keys: pa.Array, texts: pa.Array) -> pa.Array:
        """Null where surely no line goes."""
        return pack(pc.if_else(pa.array(held(known, keys)), texts, None))

    def count(keys: pa.Array, texts: pa.Array) -> pa.Array:
        """Null where `packed` is not."""
        return pa.array([None if may and x is not None else _counts(x) for may, x in zip(held(known, keys).tolist(), texts.cast(pa.binary()).to_pylist(), strict=True)], pa.int64())

    # not deterministic, as Spark knows it: else the filters on their results would run them once more, in further workers
    once = lambda f, kind: F.arrow_udf(f, kind).asNondeterministic()("key", "text")
    sent = rows.select("key", F.col("row").dropFields(f"`{text_col}`").alias("others"), once(packed, T.BinaryType()).alias("z")).where("z IS NOT NULL")
    sent = sent.join(by_doc.hint("shuffle_hash"), "key", "left").withColumn("cut", F.arrow_udf(cut, kind)("z", "gone"))
    fields = [F.col("cut.text").alias(c) if c == text_col else F.col("others").getField(c).alias(c) for c in rows.schema["row"].dataType.names]
    sent = sent.select(F.struct(*fields).alias("row"), "cut.n_lines", "cut.n_removed")
    whole = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in rows.schema["row"].dataType.names]
    stay = rows.select("row", "text", once(count, T.LongType()).alias("n_lines")).where("n_lines IS NOT NULL")
    return sent.unionByName(stay.select(F.struct(*whole).alias("row"), "n_lines", F.lit(0).cast("long").alias("n_removed")))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of docs, with the text that stays), n_lines and n_removed (lines with words)."""
    rows, _ = keyed(docs, id_col, text_col)
    return without_lines(rows, removed_lines(rows.where("key IS NOT NULL").select("key", "text"), threshold), text_col)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (SELECT doc_id, len(ls) n, unnest(ls) l, unnest(range(0, len(ls))) i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents)),
w AS (SELECT doc_id, i, list_distinct(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) w FROM l),
s AS (SELECT list_sort(w) w, min((doc_id, i)) f FROM w WHERE len(w) > 0 GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY f) k, f, w, len(w) c FROM s),
t AS (SELECT k, c, unnest(w) x FROM n),
o AS (SELECT a.k ka, b.k kb, any_value(a.c) ca, any_value(b.c) cb, count(*) c2 FROM t a JOIN t b ON a.x = b.x AND a.k < b.k AND 5 * least(a.c, b.c) >= 4 * greatest(a.c, b.c) GROUP BY a.k, b.k),
g AS (SELECT DISTINCT kb k FROM o WHERE 5 * c2 >= 4 * (ca + cb - c2)),
r AS (SELECT w.doc_id, w.i FROM w JOIN n ON list_sort(w.w) = n.w WHERE (w.doc_id, w.i) <> n.f OR n.k IN (SELECT k FROM g))
SELECT l.doc_id, count(*) FILTER (WHERE regexp_matches(l.l, '[^\\x20\\x09-\\x0D]')) n_lines, count(r.i) n_removed,
  sha256(coalesce(string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE r.i IS NULL), '')) kept_sha256
FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY l.doc_id
"""
