"""Registered queries over the catalogue, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators import vectors as V
from ..sources import fixtures as X
from . import duck as D

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def joined(array: Column, by: str = "|") -> Column:
    return F.array_join(array, by)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid(X.image_vectors(spark, sf_dir), X.probes(spark, sf_dir), X.catalogue(spark, sf_dir), X.PROFILE)


_POOL = ", pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, ordinal) pool_rank FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, ordinal) <= 10)"


@query(f"WITH {D.HYBRID}{_POOL} SELECT query_id, id, code, similarity, metadata_score, structural_score, final_score, pool_rank FROM pool WHERE pool_rank <= 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes against all vectors, fused, hydrated, scored and cut to the five best of each query."""
    return R.pooled(_hybrid(spark, sf_dir)).where("pool_rank <= 5").select("query_id", "id", "code", "similarity", "metadata_score", "structural_score", "final_score", F.col("pool_rank").cast("long").alias("pool_rank"))


@query(f"WITH {D.HYBRID}{_POOL} SELECT query_id, count(*) n, sha256(string_agg(id || ':' || format('{{:.6f}}', final_score), '|' ORDER BY id || ':' || format('{{:.6f}}', final_score))) pool_hash FROM pool GROUP BY query_id")
def k2_candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pooled(_hybrid(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"), F.first("pool_hash").alias("pool_hash"))


@query(f"""WITH {D.HYBRID}, g AS (SELECT query_id, count(*) n, max(final_score) top1, arg_max(raw_vector_similarity, (final_score, -ordinal)) raw, arg_max(probe_consensus, (final_score, -ordinal)) consensus,
  coalesce(list_sort(list(final_score), 'DESC')[2], 0) top2, count(*) FILTER (WHERE structural_score = 0) conflicts FROM scored GROUP BY query_id)
SELECT query_id, n, round(top1 - top2, 6) gap, conflicts, n >= 2 AND (round(top1 - top2, 6) < 0.06 OR conflicts > 0 OR raw < 0.86 OR consensus < 0.5) needs_rerank FROM g""")
def d1_first_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_gate(_hybrid(spark, sf_dir))


@query(f"WITH {D.HYBRID} SELECT query_id, id, similarity, structural_score, requested_holes, candidate_holes, final_score FROM scored")
def f4_f5_structural_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", "id", "similarity", "structural_score", "requested_holes", "candidate_holes", "final_score")


@query(f"WITH {D.HYBRID} SELECT query_id, id, record_id, code, probe_consensus, similarity FROM hyd")
def j4_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", "id", "record_id", "code", "probe_consensus", "similarity")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_hits(X.image_vectors(spark, sf_dir), X.probes(spark, sf_dir), X.PROFILE)


@query(f"WITH {D.HITS} SELECT query_id, probe_id, id, record_id, similarity, rank FROM hits")
def n2_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "probe_id", "id", "record_id", "similarity", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {D.HITS} SELECT query_id, probe_id, id, similarity FROM hits WHERE similarity >= 0.55")
def p5_similarity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).where(F.col("similarity") >= V.MIN_SIMILARITY).select("query_id", "probe_id", "id", "similarity")


@query(f"WITH {D.FUSED} SELECT query_id, record_id, best_id, asset_type, probe_count, raw_vector_similarity, probe_consensus, probe_rrf, similarity, rank FROM fused")
def a1_f6_multi_probe_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = X.probes(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n_probes"))
    return V.fused_probes(_hits(spark, sf_dir), counts).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {D.HITS}, b AS (SELECT * FROM hits WHERE probe_id = 1 QUALIFY row_number() OVER (PARTITION BY query_id, record_id ORDER BY similarity DESC, rank) = 1)
SELECT query_id, record_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) place FROM b""")
def w2_best_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.best_view_per_record(_hits(spark, sf_dir).where("probe_id = 1"))
    return found.select("query_id", "record_id", "id", "similarity", F.col("place").cast("long").alias("place"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 5 = 0 THEN 'not_finite' WHEN vec_id % 3 = 0 THEN 'version_key_missing' END reject_reason FROM embeddings")
def n1_vector_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    broken = F.when(F.col("vec_id") % 7 == 0, F.slice(v, 1, 63)).when(F.col("vec_id") % 5 == 0, F.concat(F.array(F.lit(float("nan"))), F.slice(v, 1, 63))).otherwise(v)
    return e.select("vec_id", V.contract_error(broken, 64, F.when(F.col("vec_id") % 3 != 0, F.lit("canon_v2"))).alias("reject_reason"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 5) total, round(v[1] / n, 6) head FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) n FROM embeddings)")
def n3_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.l2_normalized(F.col("embedding").cast("array<double>"))
    return X.table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(v[0], 6).alias("head"))


@query(f"WITH {X.VEC_SQL} SELECT id, preprocess_version = 'canon_v2' same_profile, CASE WHEN preprocess_version <> 'canon_v2' THEN 'preprocess_version' END reject_reason FROM vec")
def n4_profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(*(F.when(F.col(c) != v, F.lit(c)) for c, v in zip(V.PROFILE_COLUMNS, X.PROFILE, strict=True)))
    return X.image_vectors(spark, sf_dir).select("id", reason.isNull().alias("same_profile"), reason.alias("reject_reason"))


@query("SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) head FROM (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] v FROM embeddings)")
def n5_cls_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.cls_pooled(F.col("embedding").cast("array<double>"), 16)[0], 6).alias("head"))


# ---- text -------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({D.norm_v5('text')}) v5, md5({D.norm_v4('text')}) v4, md5({D.norm_v1('text')}) v1 FROM documents")
def t1_t2_t3_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return X.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm_v5(t)).alias("v5"), F.md5(T.norm_v4(t)).alias("v4"), F.md5(T.norm_v1(t)).alias("v1"))


@query(f"WITH {X.TEXTS_SQL}, {D.constraints('texts')} SELECT query_id, n normalized, hole hole_count, shape, side, color, array_to_string(terms, '|') terms FROM c")
def t4_constraints_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.constraints_v5(F.col("message"))
    return X.text_messages(spark, sf_dir).select("query_id", c.alias("c")).select("query_id", "c.normalized", "c.hole_count", "c.shape", "c.side", "c.color", joined(F.col("c.terms")).alias("terms"))


_ANCHORS = f"""list_concat(CASE WHEN hole IS NOT NULL THEN [hole || ' lỗ', hole || ' lo'] ELSE [] END,
  [CASE shape {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ANCHOR_SHAPES.items())} END, CASE side {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ANCHOR_SIDES.items())} END,
   CASE color {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ANCHOR_COLORS.items())} END], terms[1:4])"""


@query(f"WITH {X.TEXTS_SQL}, {D.constraints('texts')}, a AS (SELECT query_id, list_filter({_ANCHORS}, lambda x: x IS NOT NULL) a FROM c) SELECT query_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:6], '|') anchors FROM a")
def t7_search_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_messages(spark, sf_dir).select("query_id", T.constraints_v5(F.col("message")).alias("c")).select("query_id", joined(T.anchors(F.col("c"))).alias("anchors"))


@query(f"WITH {X.TEXTS_SQL}, n AS (SELECT query_id, {D.norm_v1('message')} n FROM texts) SELECT query_id, array_to_string(list_filter([{', '.join('CASE WHEN ' + ' OR '.join(f'contains(n, {D.q(k)})' for k in keys) + f' THEN {D.q(label)} END' for label, keys in T.HINTS.items())}], lambda x: x IS NOT NULL), '|') hints FROM n")
def t9_domain_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_messages(spark, sf_dir).select("query_id", joined(T.hints(F.col("message"))).alias("hints"))


# the terms as they look without marks, in lower case; some stand twice and count twice
_TERMS = "catalogue|catalog|ma|ma hang|ma hang|linh kien|con hang|id|code|part|bushing|bracket|clip|hook|ngam|ngam|lo|lo|hole|oval|tron|tron|trai|trai|phai|phai|left|right|lhf|rhf|mau|mau|xam|xam|đen|den|hinh dang|hinh dang|đac điem|dac diem|vi tri|vi tri|giong|giong|tuong tu|tuong tu"
_HITS = " + ".join(f"CAST(contains(n, {D.q(t)}) AS INT)" for t in _TERMS.split("|"))


@query(f"""WITH {X.TEXTS_SQL}, n AS (SELECT query_id, coalesce(message, '') message, trim(lower(strip_accents(coalesce(message, '')))) n FROM texts), h AS (SELECT *, regexp_replace(message, '[\\s\\v\\x{{A0}}\\x{{3000}}]+', '', 'g') packed, {_HITS} hits FROM n)
SELECT query_id, CASE WHEN packed = '' THEN 'unsupported' WHEN regexp_matches(packed, '\\d{{5}}') OR hits > 0 THEN 'catalogue' ELSE 'unknown' END kind, hits,
CASE WHEN packed = '' THEN 1.0 WHEN regexp_matches(packed, '\\d{{5}}') THEN 0.95 WHEN hits > 0 THEN round(least(1.0, CAST(0.55 AS DOUBLE) + CAST(0.12 AS DOUBLE) * hits), 6) ELSE 0.55 END confidence,
CASE WHEN packed = '' THEN 'empty' WHEN regexp_matches(packed, '\\d{{5}}') THEN 'code_like' WHEN hits > 0 THEN 'catalogue_terms' ELSE 'no_catalogue_signal' END reason FROM h""")
def t10_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_messages(spark, sf_dir).select("query_id", T.intent(F.col("message"), F.lit(False)).alias("i")).select("query_id", "i.*")


@query(f"WITH {X.TEXTS_SQL} SELECT query_id, regexp_matches({D.norm_v1('message')}, {D.q(T.GREETING)}) greeting FROM texts")
def t11_greeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_messages(spark, sf_dir).select("query_id", T.is_greeting(F.col("message")).alias("greeting"))


# ---- metadata ---------------------------------------------------------------------------------------------------
_PAIRS = f"{X.CAT_SQL}, {X.MSGS_SQL}, {D.ROWS}, {D.constraints('msgs')}, pairs AS (SELECT c.*, r.* FROM c, rws r), {D.evidence('pairs')}"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored_metadata(X.messages(spark), X.catalogue(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT query_id, id, array_to_string(evidence, '|') evidence, array_to_string(conflicts, '|') conflicts, metadata_score FROM ev")
def f1_f2_metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "id", joined(F.col("evidence")).alias("evidence"), joined(F.col("conflicts")).alias("conflicts"), "metadata_score")


_STRICT = "(hole IS NOT NULL OR shape IS NOT NULL OR side IS NOT NULL OR color IS NOT NULL) AND len(conflicts) = 0 AND (hole IS NULL OR coalesce(ok_hole, false)) AND (shape IS NULL OR coalesce(ok_shape, false))"


@query(f"WITH {_PAIRS} SELECT query_id, id, metadata_score FROM ev WHERE {_STRICT}")
def p10_strict_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(S.is_strict()).select("query_id", "id", "metadata_score")


@query(f"""WITH {_PAIRS}, f AS (SELECT *, {_STRICT} strict, coalesce(metadata_score >= 0.45, false) strong FROM ev), n AS (SELECT query_id, count(*) FILTER (WHERE strict) ns, count(*) FILTER (WHERE strong) ng FROM f GROUP BY query_id)
SELECT query_id, id, metadata_score, CASE WHEN ns > 0 THEN 'strict_constraints' ELSE 'metadata_rank' END source, CASE WHEN ns > 0 THEN ns <= 5 ELSE ng BETWEEN 1 AND 5 END sufficient,
row_number() OVER (PARTITION BY query_id ORDER BY coalesce(metadata_score, 0) DESC, ordinal) rank FROM f JOIN n USING (query_id) WHERE CASE WHEN ns > 0 THEN strict WHEN ng > 0 THEN strong ELSE true END
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(metadata_score, 0) DESC, ordinal) <= 20""")
def f3_strong_text_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strong_text_result(_scored(spark, sf_dir)).select("query_id", "id", "metadata_score", "source", "sufficient", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_PAIRS} SELECT query_id, id, metadata_score FROM ev WHERE metadata_score >= 0.2")
def p6_metadata_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("metadata_score >= 0.2").select("query_id", "id", "metadata_score")


@query(f"WITH {X.CAT_SQL}, {D.ROWS} SELECT id, row_text, row_holes FROM rws")
def p1_t12_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_row_text(X.catalogue(spark, sf_dir)).select("id", "row_text", "row_holes")
