"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Every text is a sequence of k-mers of WORDS words (FEW_WORDS in a short text), each labelled with its occurrence number.  For each of SKETCHES hash
functions the SAMPLES least labelled k-mers are kept in text order; documents that agree in one such tuple are
candidates.  As the order is kept, the sketch follows edit similarity rather than set similarity.  Short texts have few
k-mers, so they are candidates by their words too: a text of at most SHORT words that may have at most EDITS edits also
sends what is left of it without up to that many words.  Two such texts within the distance share one of these, so a
pair of short texts is never missed.  Candidates are verified by aligning their words inside a band: the edit distance
must be at most (1 - similarity) of the longer text.

Equal texts are one node.  In each group of nodes with the same key the most central node is the hub.  First each node
is held against the most central of its hubs.  Then, in up to ROUNDS rounds, a group is one row for each class that it
has members of, and each class is held against the first of one of its groups; so a group of near copies that are
near to different ones of their kind makes about as many pairs as it has members.  Only nodes that are not in their
hub's class then are compared with the members of their groups outside their class, in blocks, after an exact lower
bound on the edit distance (word histograms); of these pairs, too, those go whose ends have been joined meanwhile.
Classes are the connected components, found by label passing over stored tables.

Null text counts as empty; texts without words are duplicates only of equal texts.  Ids may be null or repeated: a class
is named by its least id, null if all are null.  A text shorter than a k-mer is one k-mer.  Equal texts are recognised by
digests that are checked for collisions.  Texts of any length are sketched and compared whole; a pair is compared only if
its lengths allow the similarity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .repeats import CHUNK_BYTES, first_of_runs
from .texts import Words, as_bytes, chunks, mix, partitions, ranges, rolling, stored, table, text_key

WORDS, SAMPLES, SKETCHES = 5, 2, 96
SIMILARITY = 0.8
#: Texts of so many words at most have k-mers of FEW_WORDS in FEW_SKETCHES too, as an edit breaks many of their k-mers; those of
#: less than the similar share of it have these alone.
FEW, FEW_WORDS, FEW_SKETCHES = 80, 3, 48
#: Texts of so many words, in which so many edits are allowed, are found surely.
SHORT, EDITS = 14, 2
#: Rounds in which classes are joined by single pairs before what is left is compared in full.
ROUNDS = 6
#: A round of which fewer than one in so many pairs are links is the last.
FEW_LINKS = 10
#: Failed members for each part into which the pairs of all groups are dealt.
FAILED_A_PART = 20_000
#: Bins of word histograms, and those of coarser looks before.
BINS, COARSE = 4096, (64, 512)
BLOCK = 4096


def order_minhash(hashes: np.ndarray, bounds: np.ndarray, k: int = WORDS, sketches: int = SKETCHES) -> np.ndarray:
    """For each text a key of each sketch, over k-mers of k words; 0 for a text without words."""
    sizes = np.diff(bounds)
    many = np.where(sizes == 0, 0, np.maximum(1, sizes - k + 1))
    starts = np.cumsum(many) - many
    text = np.repeat(np.arange(len(many)), many)
    grams = np.zeros(len(text), np.uint64)
    whole = rolling(hashes, k)
    at = ranges(bounds[:-1], np.where(sizes >= k, many, 0))
    long_ = sizes[text] >= k
    grams[long_] = whole[at] if len(at) else 0
    for i in np.flatnonzero((sizes > 0) & (sizes < k)):
        h = sizes[i : i + 1].astype(np.uint64)
        for w in hashes[bounds[i] : bounds[i + 1]]:
            h = mix(h * np.uint64(3) ^ w)
        grams[starts[i]] = h[0]
    # occurrence numbers inside each text
    key = grams ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    first = first_of_runs(key[order])
    nth = np.empty(len(key), np.int64)
    nth[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    labelled = mix(grams + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    out = np.zeros((len(sizes), sketches), np.uint64)
    some = np.flatnonzero(many)
    if not len(some):
        return out
    begin, lengths = starts[some], many[some]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    multipliers = mix((np.arange(sketches, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for s in range(sketches):
        v = labelled * multipliers[s]  # odd, so distinct labels stay distinct
        places = []
        for _ in range(SAMPLES):
            least = np.repeat(np.minimum.reduceat(v, begin), lengths)
            hit = np.flatnonzero((v == least) & (v != top))
            hit = hit[first_of_runs(text[hit])]
            place = np.full(len(sizes), -1)
            place[text[hit]] = hit
            v[hit] = top
            places.append(place[some])
        places = np.sort(np.stack(places), axis=0)  # text order
        h = np.full(len(some), 1000 * k + s, np.uint64)
        for p in places:
            h = mix(h * np.uint64(31) + np.where(p >= 0, labelled[p], np.uint64(7)))
        out[some, s] = np.maximum(h, np.uint64(1))
    return out


def candidate_keys(hashes: np.ndarray, bounds: np.ndarray, similarity: float = SIMILARITY) -> list[np.ndarray]:
    """The keys of each text: two similar texts have sketches over the same k-mers, whatever their lengths."""
    n = np.diff(bounds)
    out = [[] for _ in n]
    for chosen, k, sketches_ in ((n >= np.floor(similarity * FEW), WORDS, SKETCHES), ((n > 0) & (n <= FEW), FEW_WORDS, FEW_SKETCHES)):
        own = np.flatnonzero(chosen)
        if len(own):
            keys = order_minhash(hashes[ranges(bounds[:-1][own], n[own])], np.concatenate([[0], np.cumsum(n[own])]), k, sketches_)
            for i, x in zip(own.tolist(), keys, strict=True):
                out[i].append(x)
    for i, x in short_keys(hashes, bounds, similarity).items():
        out[i].append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def most_edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def short_keys(hashes: np.ndarray, bounds: np.ndarray, similarity: float) -> dict[int, np.ndarray]:
    """For each short text (by index) a key for every text that is left without up to most_edits of its words."""
    out = {}
    sizes = np.diff(bounds)
    for n in range(1, SHORT + 1):
        most = most_edits(n, similarity)
        own = np.flatnonzero(sizes == n)
        if most > EDITS or not len(own):
            continue
        words = hashes[bounds[own][:, None] + np.arange(n)]
        parts = []
        for gone in range(min(most, n - 1) + 1):
            stay = np.array(list(combinations(range(n), n - gone)))
            h = np.full((len(own), len(stay)), n - gone, np.uint64)
            for j in range(n - gone):
                h = mix(h * np.uint64(3) ^ words[:, stay[:, j]])
            parts.append(h)
        for i, keys in zip(own.tolist(), np.concatenate(parts, axis=1), strict=True):
            out[i] = np.unique(keys)
    return out


def histograms(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.minimum(np.bincount(text * BINS + (hashes >> np.uint64(52)).astype(np.int64), minlength=(len(bounds) - 1) * BINS), 255).reshape(-1, BINS).astype(np.uint8)


def read_histograms(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def coarse(hists: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum(hists.reshape(-1, bins, BINS // bins).sum(axis=2, dtype=np.uint16), 255).astype(np.uint8)


def surplus(hist: np.ndarray, hists: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance: words that either side has too many are edits."""
    less = np.minimum(hists, hist)  # what both have
    both = less.sum(axis=-1, dtype=np.int64)
    return np.maximum(hists.sum(axis=-1, dtype=np.int64), hist.sum(axis=-1, dtype=np.int64)) - both


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is larger: bit-parallel alignment inside a band of 2 most + 1
    diagonals that slides along the main one."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    i = 0
    while i < m and a[i] == b[i]:
        i += 1
    while m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[i:n], b[i:m]
    n, m = len(a), len(b)
    if not m:
        return n if n <= most else most + 1
    if n <= 64 or 2 * most + 2 >= n:
        return _whole_distance(a, b, most)
    for band in (8, 64, 512, 4096):
        if band < most and band > n - m and (d := _band(a, b, band)) <= band:
            return d
    return _band(a, b, most)


def _whole_distance(a: list, b: list, most: int) -> int:
    n = len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    for x in b:
        eq = places.get(x, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(d0 | up)
        hn = d0 & up
        score += bool(hp & top) - bool(hn & top)
        hp = (hp << 1) | 1
        hn <<= 1
        up = (hn | ~(d0 | hp)) & mask
        down = hp & d0 & mask
    return score if score <= most else most + 1


def _band(a: list, b: list, most: int) -> int:
    """Columns are the places of b; the band holds rows j - most .. j + most of a in column j."""
    n, m, width = len(a), len(b), 2 * most + 1
    mask, bottom = (1 << width) - 1, 1 << (2 * most)
    at: dict = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    # bit r of the band in column j is row j - most + r (0-based, of a); rows below 0 never match and cost as borders
    up, down, score = (mask >> most) << most, 0, most
    # score is the distance in the band's lowest row of the current column
    for j, x in enumerate(b):
        low = j - most
        eq = 0
        own = at.get(x)
        if own:
            for k in range(bisect_left(own, low), bisect_right(own, low + 2 * most)):
                eq |= 1 << (own[k] - low)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & mask
        hp = (down | ~(d0 | up)) & mask
        hn = d0 & up
        if not d0 & bottom:  # along the band's lower border the distance grows by one unless the diagonal is free
            score += 1
        up = (hn | ~((d0 >> 1) | hp)) & mask
        down = (d0 >> 1) & hp
    # walk up the last column from the band's lowest row to row n - 1
    row = m - 1 + most
    # vertical differences of the last column, already moved to the next column's rows
    for r in range(2 * most - 1, -1, -1):
        if row <= n - 1:
            break
        score += bool(down >> r & 1) - bool(up >> r & 1)
        row -= 1
    return score if score <= most else most + 1


def sketches(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node and keys (a key for each hash function, and those of a short text; none without words).  texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            words = Words(as_bytes(batch.column(1)))
            lists = pa.array([k.view(np.int64) for k in candidate_keys(words.hashes(), words.bounds, similarity)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "keys"])

    return texts.select("node", "text").mapInArrow(run, "node long, keys array<long>")


def described(texts: DataFrame) -> DataFrame:
    """node, n (words), hist, text.  texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            words = Words(as_bytes(batch.column(1)))
            hist = histograms(words.hashes(), words.bounds)
            n = np.diff(words.bounds).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([h.tobytes() for h in hist], pa.binary()), batch.column(1)], ["node", "n", "hist", "text"])

    return texts.select("node", "text").mapInArrow(run, "node long, n int, hist binary, text string")


def aligned(texts: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts are similar.  texts: node, text (a node stands once)."""
    need = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = texts.join(need.hint("shuffle_hash"), "node", "left_semi").select("node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                x, y = x.split(), y.split()
                most = most_edits(max(len(x), len(y)), similarity)
                keep.append(banded_distance(x, y, most) <= most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # the hub of a large group is a: its text joins last, and a skewed join is split by Spark
    left = edges.join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    joined = left.join(own.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(compare, "a long, b long")


def close_enough(edges: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges that the histograms don't rule out."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hist").alias("ha"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hist").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.maximum(batch.column(2).to_numpy(), batch.column(4).to_numpy())
                yield batch.select([0, 1]).filter(pa.array(surplus(read_histograms(batch.column(3)), read_histograms(batch.column(5))) <= (1 - similarity) * n + 1e-9))

    return edges.join(a, "a").join(b, "b").select("a", "b", "na", "ha", "nb", "hb").mapInArrow(run, "a long, b long")


def links(texts: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Stored nodes (node, n, hist, text) that share a key with another, and roots (node, root) of the classes.
    texts: node, text (rows of a node are equal)."""
    bands = sketches(texts, similarity).dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    # most keys stand once: they are moved once, and a group is counted where its rows lie
    grouped = stored(bands.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"), "near-grouped")
    # only nodes of groups are ever compared: their texts are kept once for all rounds
    shared = grouped.select("node").distinct()
    whole = texts.join(shared.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    nodes = stored(described(whole), "near-nodes")
    texts = nodes.select("node", "text")
    # the hub of a group is its most central node: the one that stands in the most and largest groups, such as the text
    # that others are edits of
    weight = grouped.groupBy("node").agg(F.sum(F.col("size") - 1).alias("weight"))
    weighed = grouped.join(weight, "node")
    hubs = weighed.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("order"), "node")).alias("hub"))
    member = stored(weighed.join(hubs, "key").select("key", "node", "size", F.col("hub.node").alias("hub"), F.col("hub.order").alias("hub_order")), "near-members")
    # first every node with the most central of its hubs, which joins most classes
    best = member.where("node <> hub").groupBy(F.col("node").alias("b")).agg(F.min(F.struct("hub_order", "hub")).alias("best"))
    first = stored(best.select(F.col("best.hub").alias("a"), "b"), "near-tried")
    found = stored(aligned(texts, close_enough(first, nodes, similarity), similarity), "near-links")
    roots, tried = forest(found), first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # then groups that are in several classes: in each round, a class is a row of each such group and is held against the
    # first class of one of them, in an order that changes with the round
    rooted = lambda rows: rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted(member).groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    member = stored(member.join(several, "key"), "near-members")
    for salt in range(ROUNDS):
        sides = rooted(member).groupBy("key", "root").agg(F.min_by("node", F.xxhash64("node", F.lit(salt))).alias("b"))
        leader = F.first("b").over(Window.partitionBy("key").orderBy(F.xxhash64("root", F.lit(salt)), "root"))
        pairs = sides.withColumn("a", leader).where("a <> b")
        one = pairs.groupBy("root").agg(F.min_by(F.struct("a", "b"), F.xxhash64("key", F.lit(salt))).alias("p"))
        now = one.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        now = stored(now, "near-tried")
        if now.isEmpty():
            break
        tried = tried.unionByName(now)
        more = stored(aligned(texts, close_enough(now, nodes, similarity), similarity), "near-links")
        if more.isEmpty():
            break
        roots = merged(roots, more)
        if more.count() * FEW_LINKS < now.count():
            break
    # the rest: members that are not in their hub's class meet the others of their group that aren't in theirs, in blocks;
    # a group's hub is one of its rows, and groups that are in one class by now are done
    own = rooted(member)
    theirs = F.max(F.when(F.col("node") == F.col("hub"), F.col("root")))
    apart = own.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), theirs.alias("hub_root")).where("least <> most")
    failed = stored(own.join(apart, "key").where("root <> hub_root").select("key", "node"), "near-failed")
    n = failed.groupBy("key").agg(F.count("*").alias("n_failed"))
    queries = failed.join(n, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n_failed") / BLOCK)))
    others = member.join(n, "key").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_failed") / BLOCK) - 1)))
    others = others.withColumn("slice", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / (4 * BLOCK))))
    queries = queries.join(member.where("node = hub").select("key", "size"), "key").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / (4 * BLOCK)) - 1)))
    facts = nodes.join(roots, "node", "left").select("node", "n", "hist", F.coalesce("root", "node").alias("root"))
    on = ["key", "block", "slice"]
    both = others.select(*on, "node", F.lit(False).alias("query")).unionByName(queries.select(*on, "node", F.lit(True).alias("query"))).join(facts, "node")

    n_parts = max(16, failed.count() // FAILED_A_PART)

    def compare(group: pa.Table) -> pa.Table:
        query = group.column("query").to_numpy()
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        hist = read_histograms(group.column("hist"))
        looks = [*(coarse(hist, bins) for bins in COARSE), hist]
        root = group.column("root").to_numpy()
        rest = np.flatnonzero(~query)
        a, b = [], []
        for i in np.flatnonzero(query):
            most = (1 - similarity) * np.maximum(n[rest], n[i]) + 1e-9
            fits = np.flatnonzero((np.abs(n[rest] - n[i]) <= most) & (root[rest] != root[i]))
            for look in looks:
                parts = [fits[c : c + 512] for c in range(0, len(fits), 512)]
                fits = np.concatenate([part[surplus(look[i], look[rest[part]]) <= most[part]] for part in parts] or [fits])
            hit = rest[fits]
            a.append(np.minimum(node[hit], node[i]))
            b.append(np.maximum(node[hit], node[i]))
        # a group's pairs in a few rows: the same pair comes from many groups
        none = np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([none, *a]), np.concatenate([none, *b])], axis=1), axis=0)
        part = (mix(pairs[:, 0].view(np.uint64) ^ mix(pairs[:, 1].view(np.uint64))) % np.uint64(n_parts)).astype(np.int64)
        own = np.unique(part)
        return pa.table({"part": own, "pairs": pa.array([pairs[part == k].tobytes() for k in own], pa.binary())})

    def once(group: pa.Table) -> pa.Table:
        pairs = np.unique(np.frombuffer(b"".join(group.column("pairs").to_pylist()), np.int64).reshape(-1, 2), axis=0)
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    packed = both.groupBy(*on).applyInArrow(compare, "part long, pairs binary")
    rest = packed.groupBy("part").applyInArrow(once, "a long, b long").join(tried, ["a", "b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b")))
    rest = stored(rest.withColumn("nth", nth), "near-rest")
    # one partner of each node first; then all that still lie in two classes
    for now in ("nth = 1", "nth > 1"):
        ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
        apart = rest.where(now).join(ends[0], "a", "left").join(ends[1], "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)")
        pairs = stored(apart.select("a", "b"), "near-tried")
        if not pairs.isEmpty():
            more = stored(aligned(texts, pairs, similarity), "near-links")
            if not more.isEmpty():
                roots = merged(roots, more)
    return nodes, roots


def forest(edges: DataFrame) -> DataFrame:
    """node, root for edges (a, b) in which every b stands once and is greater than its a: pointers are doubled."""
    label = stored(edges.select(F.col("b").alias("node"), F.col("a").alias("root")), "near-labels")
    while True:
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stored(label.join(jump, "root", "left").select("node", F.col("root").alias("old"), F.coalesce("far", "root").alias("root")), "near-labels")
        label = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return label


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots after joining the classes of the ends of edges."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    ends = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
    top = components(ends)
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    # ends are roots, or nodes of no class yet: neither has a row in roots
    return stored(moved.unionByName(top.where("node <> root")), "near-labels")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, for nodes with links."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "near-labels")
    while True:
        # the least label of the neighbours, then the label's own label: paths are halved
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stored(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "near-labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        label = new.select("node", "root")


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (digest of the text), class_id (least id of the class), class_size, first (whether this row's node
    is the one that stays), for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    node = text_key(docs, text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), node.alias("node"))
    _, root = links(docs.select(node.alias("node"), text.alias("text")), similarity)
    labelled = rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = labelled.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return labelled.join(per, "root").select("doc_id", "node", "class_id", "class_size")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns: of each class the one with the least id (null last)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    node = text_key(docs, text)
    _, root = links(docs.select(node.alias("node"), text.alias("text")), similarity)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), node.alias("node"))
    per = rows.join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "node")).alias("best"))
    keep = stored(per.select(F.col("best.id").alias("__id"), F.col("best.node").alias("__node")), "near-kept")
    joined = docs.withColumn("__key", node).join(keep, (F.col("__key") == F.col("__node")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")))
    # equal rows of one id: the first stays
    nth = F.row_number().over(Window.partitionBy("__node", "__id").orderBy("__node"))
    return joined.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
