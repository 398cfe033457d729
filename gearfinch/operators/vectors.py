"""Vector operators: contract checks, normalisation, exact cosine top-k, multi-probe fusion, best view per record."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 20
TOP_K = (1, 60, 100)
MIN_SIMILARITY = 0.55
PROFILE_COLUMNS = ("embedding_model", "embedding_model_version", "preprocess_version", "embedding_profile")
#: Probes and rows that are multiplied at once, and the bytes of a block of probes that is sent to every task.
BLOCK, STRIP, BROADCAST_BYTES = 1024, 2048, 32 << 20


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(0.0))))


def rounded(x: Column) -> Column:
    """To six digits, as the queries' SQL does it: halves of the product go up, not those of the printed digits, which
    F.round goes by."""
    return F.round(x * 1e6) / 1e6


def clamped_top_k(k: int | None) -> int:
    low, default, high = TOP_K
    return max(low, min(high, default if k is None else int(k)))


def contract_error(embedding: Column, dim: int, *keys: Column) -> Column:
    """Why a vector breaks the contract, or null."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    missing = F.lit(False)
    for k in keys:
        missing = missing | k.isNull() | (k == "")
    return F.when(embedding.isNull(), "not_an_array").when(F.size(embedding) != dim, "dimension").when(~finite, "not_finite").when(missing, "version_key_missing")


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def cls_pooled(matrix: Column, dim: int) -> Column:
    """The first token of a flattened token matrix, normalised; null if the matrix is no multiple of dim."""
    return F.when((F.size(matrix) >= dim) & (F.size(matrix) % dim == 0), l2_normalized(F.slice(matrix, 1, dim)))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return dot / F.sqrt(square(a) * square(b))


def in_profile(vectors: DataFrame, profile: tuple[str, ...]) -> DataFrame:
    for c, v in zip(PROFILE_COLUMNS, profile, strict=True):
        vectors = vectors.where(F.col(c) == v)
    return vectors.where("is_active")


HITS = pa.schema([("query_id", pa.string()), ("probe_id", pa.int32()), ("id", pa.int64()), ("record_id", pa.string()), ("asset_type", pa.string()), ("similarity", pa.float64())])


class Probes(NamedTuple):
    query_id: list[str]
    probe_id: list[int]
    matrix: np.ndarray


def _merged(state: list[np.ndarray], lo: int, who: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
    """Put hits (similarity, id, place) of the probes lo + who into the state's rows, which keep the best, ties by id."""
    k = state[0].shape[1]
    own, back = np.unique(who, return_inverse=True)
    whose = np.concatenate([np.repeat(np.arange(len(own)), k), back])
    s, ids, at = (np.concatenate([part[lo + own].ravel(), x]) for part, x in zip(state, found, strict=True))
    order = np.lexsort((ids, -s, whose))
    first = np.searchsorted(whose[order], np.arange(len(own)))
    best = order[first[:, None] + np.arange(k)[None, :]]
    for part, x in zip(state, (s, ids, at), strict=True):
        part[lo + own] = x[best]


def nearest(probes: Probes, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of all rows (id, record_id, asset_type, embedding) for each probe, ties by id, as HITS.

    BLOCK probes meet STRIP rows at once.  Beside that product, three numbers are held for each of a probe's k hits, and the
    names of the rows seen, without their vectors."""
    q, n = probes.matrix, len(probes.matrix)
    norms, rows, seen = (q * q).sum(1), [], 0
    # similarity, id and place (among the rows seen) of the best of each probe
    state = [np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)]
    for batch in batches:
        if not batch.num_rows or not n:
            continue
        rows.append(pa.table([batch.column(1), batch.column(2)], ["record_id", "asset_type"]))
        flat, ids = batch.column(3), batch.column(0).to_numpy()
        m = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64, copy=False)
        squares = (m * m).sum(1)
        for lo in range(0, n, BLOCK):
            for at in range(0, len(m), STRIP):
                with np.errstate(divide="ignore", invalid="ignore"):
                    sim = q[lo : lo + BLOCK] @ m[at : at + STRIP].T
                    sim /= np.sqrt(norms[lo : lo + BLOCK, None] * squares[None, at : at + STRIP])
                sim[np.isnan(sim)] = -np.inf
                least = state[0][lo : lo + BLOCK, -1]
                if sim.shape[1] > k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(sim, -k, axis=1)[:, -k])
                # they are ranked as rounded; ties of the last one stay in
                who, which = np.nonzero((sim >= least[:, None] - 1e-6) & (sim > -np.inf))
                if len(who):
                    _merged(state, lo, who, (np.round(sim[who, which], 6), ids[at + which], seen + at + which))
        seen += len(m)
    names = pa.concat_tables(rows).combine_chunks() if rows else None
    for lo in range(0, n if rows else 0, BLOCK):
        who, which = np.nonzero(state[2][lo : lo + BLOCK] >= 0)
        if len(who):
            who += lo
            own = names.take(pa.array(state[2][who, which])).combine_chunks()
            columns = [pa.array([probes.query_id[i] for i in who], pa.string()), pa.array([probes.probe_id[i] for i in who], pa.int32()), pa.array(state[1][who, which]), own.column(0).combine_chunks(), own.column(1).combine_chunks(), pa.array(state[0][who, which])]
            yield pa.RecordBatch.from_arrays(columns, schema=HITS)


def _nearest_of(known: object, k: int):
    return lambda batches: nearest(known.value, batches, k)


def top_hits(vectors: DataFrame, probes: DataFrame, profile: tuple[str, ...], k: int | None = None) -> DataFrame:
    """query_id, probe_id, id, record_id, asset_type, similarity and rank of the k nearest vectors of each probe in one
    profile: exact, by cosine, ties by vector id.

    Probes are a stated query set, sent to every task in blocks.  Each task multiplies matrices and keeps its own top k,
    and a window merges these."""
    k = clamped_top_k(k)
    own = in_profile(vectors, profile).select("id", "record_id", "asset_type", "embedding")
    asked = probes.select("query_id", "probe_id", "embedding")
    n, dim = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    layout = "query_id string, probe_id int, id long, record_id string, asset_type string, similarity double"
    # probes are dealt to blocks of BROADCAST_BYTES; each block is sent to every task, so vectors never move
    blocks = max(1, -(-n * (dim or 0) * 8 // BROADCAST_BYTES))
    block = F.pmod(F.xxhash64("query_id", "probe_id"), F.lit(blocks))
    parts = []
    for i in range(blocks):
        rows = (asked if blocks == 1 else asked.where(block == i)).collect()  # about BROADCAST_BYTES
        matrix = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))
        known = probes.sparkSession.sparkContext.broadcast(Probes([r["query_id"] for r in rows], [r["probe_id"] for r in rows], matrix))
        parts.append(own.mapInArrow(_nearest_of(known, k), layout))
    scored = reduce(DataFrame.unionByName, parts)
    # one exchange, by query: the windows and sums by query, probe and record that follow need no other
    w = Window.partitionBy("query_id", "probe_id").orderBy(F.desc("similarity"), "id")
    return scored.repartition("query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_hits_by_expressions(vectors: DataFrame, probes: DataFrame, profile: tuple[str, ...], k: int | None = None) -> DataFrame:
    """As top_hits, in column expressions alone."""
    own = in_profile(vectors, profile).select("id", "record_id", "asset_type", F.col("embedding").alias("v"))
    pairs = own.join(probes.select("query_id", "probe_id", F.col("embedding").alias("q")))
    scored = pairs.select("query_id", "probe_id", "id", "record_id", "asset_type", F.round(cosine(F.col("q"), F.col("v")), 6).alias("similarity"))
    w = Window.partitionBy("query_id", "probe_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= clamped_top_k(k))


def fused_probes(hits: DataFrame, probe_counts: DataFrame, k: int | None = None) -> DataFrame:
    """One row for each query and record over all probes: reciprocal rank sum, consensus, best similarity with its hit
    (first wins), and the fused similarity; the best k of each query.  probe_counts: query_id, n_probes."""
    ranked = hits.where("record_id IS NOT NULL AND record_id <> ''").withColumn("s", clamp(F.col("similarity")))
    per = ranked.groupBy("query_id", "record_id").agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf_sum"),
        F.count_distinct("probe_id").alias("probe_count"),
        F.max("s").alias("raw_vector_similarity"),
        F.max_by(F.struct("id", "asset_type"), F.struct(F.col("s"), -F.col("probe_id"), -F.col("rank"))).alias("hit"),
    )
    per = per.join(probe_counts, "query_id")
    consensus = F.col("probe_count") / F.col("n_probes")
    rrf = clamp(F.col("rrf_sum") / (F.col("n_probes") / (RRF_K + 1.0)))
    out = per.select("query_id", "record_id", F.col("hit.id").alias("best_id"), F.col("hit.asset_type").alias("asset_type"), "probe_count", "raw_vector_similarity", consensus.alias("probe_consensus"), rounded(rrf).alias("probe_rrf"), rounded(clamp(0.82 * F.col("raw_vector_similarity") + 0.12 * rrf + 0.06 * consensus)).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.col("record_id").cast("long"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= clamped_top_k(k))


def best_view_per_record(hits: DataFrame, limit: int = 100) -> DataFrame:
    """The best hit of each record for each query (single probe), at most `limit` records."""
    per = Window.partitionBy("query_id", "record_id").orderBy(F.desc("similarity"), "rank")
    best = hits.withColumn("view", F.row_number().over(per)).where("view = 1").drop("view")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "rank")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
