"""Merkle manifest of a dataset as an SHA-256 midstate tree, in stored tables.

Leaf of a row: sha256 of its fields, each `-` if null, else its UTF-8 byte count, `:` and its value.  The leaves of a
source, in the order of their ids (null ids first, equal ids by leaf), are nodes; every FAN consecutive nodes become the
sha256 of their hex digests, until one is left: the source's subroot.  The subroots, null source first and the others
bytewise, become the root in the same way.  A hex digest is one block of SHA-256, so a parent's hash state before each
child slot is a whole state of 32 bytes: the manifest retains it beside the child.  Folding a changed leaf resumes its
parent's state there, feeds the replacement and its right siblings, and climbs; left siblings are never hashed again.

Leaves are hashed by Spark.  They are numbered within their source by a range sort and prefix counts; runs of BLOCK of
them become one row of a tier (a subtree of DEPTH levels, digests and states packed), the subtrees' tops the next tier's
leaves, and so on: no group has more than BLOCK rows, whatever a source's share.  Going down again, each subtree gets
the path above it.  A row of the manifest's first tier then meets the changed leaves below it.

Null text stays `-`; empty and very long texts are hashed whole by Spark, and only digests are shuffled.  Repeated rows
are separate leaves.  Other columns are ignored.  An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .texts import CRC_SQL, CRC_TABLE_SQL, partitions, stored, table

FAN, DEPTH = 3, 6
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- SHA-256 over many messages of whole blocks at once


def _root_bits(n: int, root: int) -> int:
    """The first 32 bits behind the point of n ** (1 / root)."""
    scaled, low, high = n << (32 * root), 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**root <= scaled else (low, mid)
    return low & 0xFFFFFFFF


@cache
def _constants() -> tuple[np.ndarray, np.ndarray]:
    primes = [n for n in range(2, 312) if all(n % d for d in range(2, int(n**0.5) + 1))]
    return np.array([_root_bits(p, 2) for p in primes[:8]], np.uint32), np.array([_root_bits(p, 3) for p in primes[:64]], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states (m x 8) after one more block each (m x 16 words)."""
    w = list(words.T.copy())
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        small = _turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))
        w.append(w[i - 16] + small + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = states.T.copy()
    for k, x in zip(_constants()[1], w, strict=True):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + k + x
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def start(m: int) -> np.ndarray:
    return np.tile(_constants()[0], (m, 1))


_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def hex_words(digests: np.ndarray) -> np.ndarray:
    """The hex text of each digest (m x 8), as the 16 words of a block."""
    text = _HEX[np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(len(digests), 32)]
    return text.reshape(len(digests), 64).view(">u4").astype(np.uint32)


def last_words(children: np.ndarray) -> np.ndarray:
    """The padding block behind so many hex digests."""
    words = np.zeros((len(children), 16), np.uint32)
    words[:, 0], words[:, 15] = 0x80000000, children * 512
    return words


def packed(digests: np.ndarray) -> bytes:
    return digests.astype(">u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)


# ---- subtrees


def level_sizes(nodes: int, first: int) -> list[int]:
    """Nodes in each level of the subtree that begins at node `first` of `nodes`: DEPTH levels up, or to the root."""
    sizes = [min(BLOCK, nodes - first)]
    while sizes[-1] > 1 if nodes <= BLOCK else len(sizes) <= DEPTH:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def subtree(leaves: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all nodes, level by level, and each node's midstate: its parent's state before its slot."""
    nodes, midstates = [leaves], []
    for m, parents in zip(sizes, sizes[1:], strict=False):
        children, state, before = nodes[-1], start(parents), np.empty((m, 8), np.uint32)
        for slot in range(FAN):
            own = children[slot::FAN]
            before[slot::FAN] = state[: len(own)]
            state[: len(own)] = compress(state[: len(own)], hex_words(own))
        nodes.append(compress(state, last_words(np.minimum(FAN, m - FAN * np.arange(parents)))))
        midstates.append(before)
    return np.concatenate(nodes), np.concatenate(midstates) if midstates else start(0)


def fold(digests: np.ndarray, midstates: np.ndarray, right: list[np.ndarray], left: np.ndarray | int) -> np.ndarray:
    """The parents' digests: resumed from the midstates, with the digests and then their right siblings.  right[i]: the
    rows that have an i-th right sibling, and these; left: how many siblings stand before."""
    state = compress(midstates, hex_words(digests))
    children = np.broadcast_to(np.asarray(left) + 1, len(digests)).copy()
    for rows, siblings in right:
        state[rows] = compress(state[rows], hex_words(siblings))
        children[rows] += 1
    return compress(state, last_words(children))


def _siblings(level: np.ndarray, at: np.ndarray) -> tuple[list, np.ndarray]:
    """fold's `right` and `left` for nodes `at` of a level."""
    slot = at % FAN
    right = []
    for step in range(1, FAN):
        rows = np.flatnonzero((slot + step < FAN) & (at + step < len(level)))
        right.append((rows, level[at[rows] + step]))
    return right, slot


def step(midstate: np.ndarray, left: np.ndarray, right: np.ndarray) -> bytes:
    """One level of a path: the midstate, the number of left siblings, these, and the right ones."""
    return packed(midstate) + bytes([len(left)]) + packed(left) + packed(right)


def unstep(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = 33 + 32 * raw[32]
    return unpacked(raw[:32]), unpacked(raw[33:cut]), unpacked(raw[cut:])


def local_path(nodes: np.ndarray, midstates: np.ndarray, sizes: list[int], at: int) -> list[bytes]:
    """The path of leaf `at` to the subtree's top."""
    path, base = [], 0
    for size in sizes[:-1]:
        first = at // FAN * FAN
        path.append(step(midstates[base + at], nodes[base + first : base + at], nodes[base + at + 1 : base + min(first + FAN, size)]))
        base, at = base + size, at // FAN
    return path


# ---- tiers

TIER = "tree string, n long, block long, digest binary, nodes binary, midstates binary"


def _build(group: pa.Table) -> pa.Table:
    at = group.column("at").to_numpy()
    order = np.argsort(at, kind="stable")
    n, block = group.column("n")[0].as_py(), int(at[0]) // BLOCK
    leaves = unpacked(b"".join(group.column("digest").to_pylist()))[order]
    nodes, midstates = subtree(leaves, level_sizes(n, block * BLOCK))
    return pa.table({"tree": group.column("tree")[:1], "n": pa.array([n], pa.int64()), "block": pa.array([block], pa.int64()), "digest": [packed(nodes[-1:])], "nodes": [packed(nodes)], "midstates": [packed(midstates)]})


def tiers(leaves: DataFrame) -> list[DataFrame]:
    """Stored tiers of subtrees.  leaves: tree, n (leaves of the tree), at (0, 1, ..), digest."""
    found, rows = [], leaves.select("tree", "n", "at", "digest")
    while True:
        found.append(stored(rows.groupBy("tree", F.expr(f"at div {BLOCK}")).applyInArrow(_build, TIER), "merkle-tier"))
        rows = found[-1].where(F.col("n") > BLOCK).select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("at"), "digest")
        if rows.isEmpty():
            return found


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf of each subtree: tree, block (the leaf's number), subroot, path."""
    for batch in batches:
        for row in batch.to_pylist():
            first = row["block"] * BLOCK
            sizes, nodes, midstates = level_sizes(row["n"], first), unpacked(row["nodes"]), unpacked(row["midstates"])
            paths = [local_path(nodes, midstates, sizes, at) + row["path"] for at in range(sizes[0])]
            yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * sizes[0]), pa.array(range(first, first + sizes[0]), pa.int64()), pa.array([row["subroot"]] * sizes[0], pa.binary()), pa.array(paths, pa.list_(pa.binary()))], ["tree", "block", "subroot", "path"])


def with_paths(found: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first tier with subroot and path to the root.  tops: tree, subroot, path of each tree's top."""
    above = None
    for tier in reversed(found):
        own = tier.where(F.col("n") <= BLOCK).join(tops, "tree")
        if above is not None:
            own = own.unionByName(tier.where(F.col("n") > BLOCK).join(above, ["tree", "block"]))
        own = stored(own, "merkle-paths") if len(found) > 1 else own
        above = own.mapInArrow(_down, "tree string, block long, subroot binary, path array<binary>")
    return own


# ---- the manifest


@dataclass
class Manifest:
    """leaves: tree (of the source), at, n, row (what the caller carries), digest, other (the leaf after changes, or null
    where nothing changed); found: the sources' tiers; sources: tree, subroot, path to the root; root: hex, or None."""

    leaves: DataFrame
    found: list[DataFrame]
    sources: DataFrame
    root: str | None


def leaf(fields: list[Column]) -> Column:
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, fields)), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at (0, 1, .. within `tree`, by `order`) and n (rows of the tree), by a range sort and prefix counts."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    place = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumn("__part", F.shiftright(place, 33)).withColumn("__place", place), "merkle-ranged")
    runs = ranged.groupBy("tree", "__part").agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "__part", (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(tree).alias("n"))
    joined = ranged.join(runs, ["tree", "__part"])
    return joined.withColumn("at", F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")


def build(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, changes: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs.  changes: fields as they are after tampering."""
    changes = changes or {}
    own, other = [F.col(c) for c in fields], [changes.get(c, F.col(c)) for c in fields]
    same = F.lit(True)
    for c, new in changes.items():
        same = same & F.col(c).eqNullSafe(new)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("tree"),
        F.col(id_col).alias("id"),
        leaf(own).alias("digest"),
        F.when(~same, leaf(other)).alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = stored(numbered(stored(rows, "merkle-leaves"), ["id", "digest", "tie"]).drop("tie"), "merkle-numbered")
    found = tiers(leaves)
    tops = found[0].where(F.col("n") <= BLOCK)
    for tier in found[1:]:
        tops = tops.unionByName(tier.where(F.col("n") <= BLOCK))
    tops = tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = stored(numbered(tops, ["source"]), "merkle-sources")
    upper = tiers(sources)
    top = upper[-1].where(F.col("n") <= BLOCK).select("digest").first()  # one row: the root
    root = bytes(top[0]).hex() if top else None
    none = F.array().cast("array<binary>")
    above = with_paths(upper, upper[-1].where(F.col("n") <= BLOCK).select("tree", F.col("digest").alias("subroot"), none.alias("path")))
    paths = above.mapInArrow(_down, "tree string, block long, subroot binary, path array<binary>")
    paths = sources.select("source", "at", "digest").join(paths.select(F.col("block").alias("at"), "path"), "at")
    return Manifest(leaves, found, stored(paths.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "path"), "merkle-source-paths"), root)


PROOF = "doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"


def _fold_block(group: pa.Table, tier: pa.Table) -> pa.Table:
    row = tier.to_pylist()[0]
    first = row["block"] * BLOCK
    sizes, nodes, midstates = level_sizes(row["n"], first), unpacked(row["nodes"]), unpacked(row["midstates"])
    at = group.column("at").to_numpy() - first
    leaves = nodes[at]
    other = group.column("other").to_pylist()
    current, changed = leaves.copy(), [i for i, x in enumerate(other) if x is not None]
    if changed:
        current[changed] = unpacked(b"".join(other[i] for i in changed))
    proofs, base = [hashlib.sha256() for _ in at], 0
    for size in sizes[:-1]:
        level = nodes[base : base + size]
        right, left = _siblings(level, at)
        current = fold(current, midstates[base + at], right, left)
        text = hex_words(level).astype(">u4").tobytes()
        for proof, x in zip(proofs, at.tolist(), strict=True):
            begin = x // FAN * FAN
            proof.update(text[64 * begin : 64 * x] + text[64 * (x + 1) : 64 * (begin + FAN)])
        base, at = base + size, at // FAN
    above = []
    for midstate, left, right in map(unstep, row["path"]):
        above.append(packed(left).hex() + packed(right).hex())
        every = np.arange(len(current))
        current = fold(current, np.repeat(midstate, len(current), axis=0), [(every, np.repeat(r[None], len(current), axis=0)) for r in right], len(left))
    rest = "".join(above).encode()
    for proof in proofs:
        proof.update(rest)
    text = lambda x: [packed(r).hex() for r in x]
    return pa.table({"doc_id": group.column("id"), "leaf": text(leaves), "subroot": [row["subroot"].hex()] * len(group), "proof_sha256": [p.hexdigest() for p in proofs], "folded_root": text(current)})


def verified(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of each row, folded_root from its changed leaf, and verified."""
    tier = with_paths(manifest.found, manifest.sources).select("tree", "n", "block", "nodes", "midstates", "subroot", "path")
    leaves = manifest.leaves.select("tree", F.expr(f"at div {BLOCK}").alias("block"), "at", "id", "other")
    kind = dict(leaves.dtypes)["id"]
    folded = leaves.groupBy("tree", "block").cogroup(tier.groupBy("tree", "block")).applyInArrow(_fold_block, PROOF.format(kind=kind))
    root = F.lit(manifest.root).cast("string")
    return folded.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def without_line_feeds(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without line feeds where 2 divides the id's crc32; else, and for null ids, as it is."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verified(build(docs, changes={"text": without_line_feeds()}))


def _leaf_sql(text: str) -> str:
    parts = (text if c == "text" else f"CAST({c} AS VARCHAR)" for c in FIELDS)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in parts) + ")"


#: Levels of every source's tree, and of the tree of subroots; then each leaf climbs through both.
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () rn, coalesce('s' || source, 'n') tree, doc_id, {_leaf_sql("text")} leaf,
  CASE WHEN {CRC_SQL.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END other FROM documents, crc),
e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 i FROM d),
v AS (SELECT tree, 0 l, i, leaf h FROM e
  UNION ALL SELECT tree, l + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) n FROM v) WHERE n > 1 GROUP BY tree, l, i // {FAN}),
tops AS (SELECT tree, max(l) l, arg_max(h, l) h, row_number() OVER (ORDER BY tree) - 1 i FROM v GROUP BY tree),
u AS (SELECT 0 l, i, h FROM tops
  UNION ALL SELECT l + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () n FROM u) WHERE n > 1 GROUP BY l, i // {FAN}),
f AS (SELECT rn, tree, 0 l, i, other h, '' proof FROM e
  UNION ALL SELECT f.rn, f.tree, f.l + 1, f.i // {FAN}, sha256(string_agg(CASE WHEN v.i = f.i THEN f.h ELSE v.h END, '' ORDER BY v.i)),
    f.proof || coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (WHERE v.i <> f.i), '')
  FROM f JOIN tops USING (tree) JOIN v ON v.tree = f.tree AND v.l = f.l AND v.i // {FAN} = f.i // {FAN} WHERE f.l < tops.l GROUP BY f.rn, f.tree, f.l, f.i, f.h, f.proof),
g AS (SELECT rn, 0 l, tops.i, f.h, proof FROM f JOIN tops USING (tree) WHERE f.l = tops.l
  UNION ALL SELECT g.rn, g.l + 1, g.i // {FAN}, sha256(string_agg(CASE WHEN u.i = g.i THEN g.h ELSE u.h END, '' ORDER BY u.i)),
    g.proof || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i <> g.i), '')
  FROM g JOIN u ON u.l = g.l AND u.i // {FAN} = g.i // {FAN} WHERE g.l < (SELECT max(l) FROM u) GROUP BY g.rn, g.l, g.i, g.h, g.proof),
r AS (SELECT max(l) l, arg_max(h, l) h FROM u)
SELECT doc_id, leaf, tops.h subroot, r.h root, sha256(proof) proof_sha256, g.h folded_root, g.h = r.h verified
FROM e JOIN g USING (rn) JOIN tops USING (tree), r WHERE g.l = r.l
"""
