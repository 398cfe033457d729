"""The image flow whole: each branch decides some queries, and only the others reach the next, dearer one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from . import lifecycle as L
from . import rerank as K
from . import retrieval as R

RESOLVED, SHOWN = 10, 5
RESULT = ("query_id", "mode", "place", "id", "code", "final_score")


def _placed(rows: DataFrame, mode: str, *order) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    own = rows.withColumns({"mode": F.lit(mode), "place": F.row_number().over(w)}).where(F.col("place") <= SHOWN)
    return own.select(*RESULT)


def _undecided(queries: DataFrame, decided: DataFrame, name: str) -> DataFrame:
    return stored(queries.join(decided.select("query_id").distinct(), "query_id", "left_anti"), name)


def routed(probes: DataFrame, vectors: DataFrame, rows: DataFrame, profile: tuple[str, ...], rankings: DataFrame, judgements: DataFrame, orientation: DataFrame | None = None) -> DataFrame:
    """query_id, mode, decision, place, id, code, final_score: what each image query shows, one row with a null place if
    nothing.

    EXACT: the message is a key; CLEAR: the vectors alone are clear; RERANKED: a model's rankings of the pool, in its order;
    JUDGED: where these are close, unsure or in conflict, a judge's five with its decision (`ambiguous` if it gave none);
    NO_MATCH: no vector above the floor.  Ids outside the pool and repeated ones never count.
    probes: query_id, probe_id, embedding, message; rankings: query_id, candidate_id, score, seq, ambiguous; judgements:
    the same with decision instead of ambiguous; orientation: query_id and orientation_conflict."""
    queries = probes.groupBy("query_id").agg(F.first("message").alias("message"))
    exact = stored(L.exact_lookup(queries, rows).select("query_id", "id").join(rows.select("id", "code", "ordinal"), "id").withColumn("final_score", F.lit(None).cast("double")), "flow-exact")
    rest = _undecided(queries, exact, "flow-images")
    fused = stored(R.hybrid(vectors, probes.join(rest.select("query_id"), "query_id", "left_semi"), rows, profile), "flow-fused")
    gate = stored(R.first_gate(fused), "flow-gate")
    clear = fused.join(gate.where("NOT needs_rerank").select("query_id"), "query_id", "left_semi")
    unclear = gate.where("needs_rerank").select("query_id", (F.col("conflicts") > 0).alias("hole_conflict"))
    pool = stored(R.pooled(fused.join(unclear.select("query_id"), "query_id", "left_semi"), RESOLVED).select("query_id", "id", "code"), "flow-pool")
    safe = stored(K.inside_pool(rankings, pool, RESOLVED), "flow-rankings")
    conflicts = unclear if orientation is None else unclear.join(orientation, "query_id", "left")
    second = K.second_gate(safe, conflicts).select("query_id", "needs_judge")
    state = unclear.join(second, "query_id", "left").select("query_id", F.coalesce("needs_judge", "hole_conflict").alias("needs_judge"))
    state = stored(state, "flow-second-gate")
    code = pool.select("query_id", F.col("id").alias("candidate_id"), "code")
    as_rows = lambda answers: answers.join(code, ["query_id", "candidate_id"]).withColumnsRenamed({"candidate_id": "id", "score": "final_score"})
    judged_queries = state.where("needs_judge").select("query_id")
    judged = K.inside_pool(judgements.join(judged_queries, "query_id", "left_semi"), pool, SHOWN)
    parts = [
        _placed(exact, "EXACT", "ordinal"),
        _placed(clear, "VECTOR_CLEAR", F.desc("final_score"), "ordinal"),
        _placed(as_rows(safe.join(judged_queries, "query_id", "left_anti")), "VECTOR_RERANKED", "seq"),
        _placed(as_rows(judged), "VECTOR_RERANKED_JUDGED", "seq"),
    ]
    shown = reduce(DataFrame.unionByName, parts)
    own_mode = F.when(F.col("needs_judge"), "VECTOR_RERANKED_JUDGED").when(~F.col("needs_judge"), "VECTOR_RERANKED").when(F.col("needs_rerank").isNotNull(), "VECTOR_CLEAR").otherwise("VECTOR_NO_MATCH")
    modes = rest.select("query_id").join(gate.select("query_id", "needs_rerank"), "query_id", "left").join(state, "query_id", "left").select("query_id", own_mode.alias("mode"))
    modes = modes.unionByName(exact.select("query_id", F.lit("EXACT").alias("mode")).distinct())
    decisions = judgements.groupBy("query_id").agg(F.min_by("decision", "seq").alias("decision"))
    out = modes.join(decisions, "query_id", "left").withColumn("decision", F.when(F.col("mode") == "VECTOR_RERANKED_JUDGED", F.coalesce("decision", F.lit("ambiguous"))))
    return out.join(shown.drop("mode"), "query_id", "left")
