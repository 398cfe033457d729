"""Registered queries of the approximate vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann as A
from ..operators import vectors as V
from ..sources import fixtures as X
from ..sources.store import scratch, stored
from .catalogue_queries import query


def _index(spark: SparkSession, sf_dir: str) -> A.VectorIndex:
    return A.build_index(X.image_vectors(spark, sf_dir), scratch(spark, "vector-index"), X.PROFILE)


@query(
    f"""WITH {X.VEC_SQL}, {X.PROBES_SQL}
SELECT query_id, probe_id, v.id, record_id, round(list_cosine_similarity(p.embedding, v.embedding), 6) similarity FROM probes p, vec v
WHERE preprocess_version = 'canon_v2' AND is_active AND round(list_cosine_similarity(p.embedding, v.embedding), 6) >= 0.55"""
)
def n6_index_floor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors above the floor, through the index: exact by the bounds of cells and codes."""
    found = A.within(_index(spark, sf_dir), X.probes(spark, sf_dir))
    return found.select("query_id", "probe_id", "id", "record_id", "similarity")


@query(None)
def n6_approximate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the exact 60 nearest, and the shares of vectors compared by code and scored, for each probe."""
    index, probes = _index(spark, sf_dir), X.probes(spark, sf_dir)
    exact = V.top_hits(X.image_vectors(spark, sf_dir), probes, X.PROFILE)
    return A.evaluation(index, probes, stored(A.search(index, probes), "approximate-hits"), exact)


@query(None)
def e1_approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: mean and least recall@60 of the index, and the mean shares compared and scored."""
    per = n6_approximate_search(spark, sf_dir)
    return per.agg(
        F.count("*").alias("probes"),
        F.round(F.avg("recall"), 6).alias("recall_60"),
        F.min("recall").alias("least_recall_60"),
        F.round(F.avg("codes_share"), 6).alias("codes_share"),
        F.round(F.avg("scored_share"), 6).alias("scored_share"),
    )
