"""Hybrid retrieval: vector hits, hydrated with catalogue rows, scored, fused, pooled and gated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored
from . import scoring as S
from . import vectors as V


def hydrated(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits with their catalogue row; hits without one stay, their record id is their id.  The hit's similarity is the
    row's vector_similarity.  A single probe counts as no consensus."""
    joined = hits.join(rows.withColumnRenamed("id", "row_id"), F.col("record_id") == F.col("row_id"), "left")
    multi = F.col("n_probes") > 1
    return joined.withColumns({"id": F.coalesce("row_id", "record_id"), "vector_similarity": F.col("similarity"), "probe_consensus": F.when(multi, F.col("probe_consensus")).otherwise(0.0), "ordinal": F.coalesce("ordinal", F.col("record_id").cast("long"))}).drop("row_id")


def parsed_messages(queries: DataFrame) -> DataFrame:
    return S.with_constraints(queries).withColumn("requested_holes", T.loose_hole_count(F.col("message")))


def parsed_rows(rows: DataFrame) -> DataFrame:
    features = F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in S.FIRST_FEATURES))
    return S.with_row_text(rows).withColumn("candidate_holes", T.loose_hole_count(features))


def fused(hydrated_hits: DataFrame) -> DataFrame:
    """Adds metadata, structural and final scores; differing hole counts are one conflict, the only one that fusion knows
    (those of the metadata are in metadata_conflicts).  Needs message."""
    pairs = hydrated_hits if "c" in hydrated_hits.columns else parsed_messages(hydrated_hits)
    pairs = pairs.withColumn("row_text", F.coalesce("row_text", F.lit(""))) if "row_text" in pairs.columns else parsed_rows(pairs)
    evident = S.evidence(pairs).withColumn("metadata_score", S.metadata_score()).withColumn("metadata_available", S.metadata_available())
    known = F.col("requested_holes").isNotNull() & F.col("candidate_holes").isNotNull()
    scored = evident.withColumn("structural_score", F.when(known, (F.col("requested_holes") == F.col("candidate_holes")).cast("double")))
    final = S.fused_score(F.col("similarity"), F.col("probe_consensus"), F.col("metadata_score"), F.col("metadata_available"), F.col("structural_score"), F.coalesce(F.col("structural_score") == 0, F.lit(False)).cast("int"))
    own = F.when(F.col("structural_score") == 0, F.array(F.lit("structural_conflict"))).otherwise(F.array().cast("array<string>"))
    return scored.withColumns({"final_score": V.rounded(final), "metadata_conflicts": F.col("conflicts"), "conflicts": own})


def pooled(scored: DataFrame, limit: int = 10) -> DataFrame:
    """The pool of each query: first wins among equal ids, by final score, with its rank and the pool's hash."""
    first = Window.partitionBy("query_id", "id").orderBy("rank")
    kept = scored.repartition("query_id").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "ordinal")
    kept = kept.withColumn("pool_rank", F.row_number().over(w)).where(F.col("pool_rank") <= limit)
    item = F.concat("id", F.lit(":"), F.format_string("%.6f", F.round("final_score", 6)))
    return kept.withColumn("pool_hash", F.sha2(F.array_join(F.array_sort(F.collect_list(item).over(Window.partitionBy("query_id"))), "|"), 256))


def hybrid(vectors: DataFrame, probes: DataFrame, rows: DataFrame, profile: tuple[str, ...], k: int | None = None, floor: float = V.MIN_SIMILARITY) -> DataFrame:
    """The whole chain down to fused candidates above the similarity floor.  probes: query_id, message, probe_id, embedding."""
    counts = probes.groupBy("query_id").agg(F.count("*").alias("n_probes"), F.first("message").alias("message"))
    hits = V.fused_probes(V.top_hits(vectors, probes, profile, k), counts.select("query_id", "n_probes"), k)
    # each message is parsed once, and each row that was found once; hits are few beside the catalogue
    hits = stored(hits.where(F.col("similarity") >= floor), "fused-hits").join(parsed_messages(counts), "query_id")
    found = rows.join(hits.select(F.col("record_id").alias("id")).distinct(), "id", "left_semi")
    return fused(hydrated(hits, parsed_rows(found)))


def first_gate(scored: DataFrame, has_image: bool = True, gap: float = 0.06, quality: float = 0.72, risk: float = 0.55, raw: float = 0.86, consensus: float = 0.5) -> DataFrame:
    """Per query: number of candidates, gap of the two best, raw similarity of the best, and whether a reranking is
    needed.  Optional columns query_quality, angle_risk, lighting_risk are read if there."""
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "ordinal")
    placed = scored.withColumn("place", F.row_number().over(w))
    first = lambda c, n: F.max(F.when(F.col("place") == n, F.col(c)))
    per = placed.groupBy("query_id").agg(
        F.count("*").alias("n"),
        first("final_score", 1).alias("top1"),
        first("final_score", 2).alias("top2"),
        first("raw_vector_similarity", 1).alias("raw"),
        first("probe_consensus", 1).alias("consensus"),
        F.count_if(F.col("structural_score") == 0).alias("conflicts"),
        *((F.max(c) if c in scored.columns else F.lit(d)).alias(c) for c, d in (("query_quality", 1.0), ("angle_risk", 0.0), ("lighting_risk", 0.0))),
    )
    difference = F.round(F.col("top1") - F.coalesce("top2", F.lit(0.0)), 6)
    image = F.lit(has_image) & ((F.coalesce("raw", F.lit(0.0)) < raw) | (F.coalesce("consensus", F.lit(0.0)) < consensus))
    need = (F.col("n") >= 2) & ((difference < gap) | (F.col("query_quality") < quality) | (F.col("conflicts") > 0) | (F.col("angle_risk") > risk) | (F.col("lighting_risk") > risk) | image)
    return per.select("query_id", "n", difference.alias("gap"), "conflicts", need.alias("needs_rerank"))
