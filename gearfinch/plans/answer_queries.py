"""Registered queries of model answers under their schemas, vectors stored by profile, readiness, keys and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import lifecycle as L
from ..operators import scoring as S
from ..sources import fixtures as X
from ..sources import paged as P
from ..sources.store import scratch
from . import duck as D
from .catalogue_queries import _hybrid, query

_STATUS = "CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'enum' WHEN 2 THEN 'unknown_property' WHEN 3 THEN 'required' WHEN 4 THEN 'type' WHEN 5 THEN 'invalid_json' ELSE CASE WHEN n > 5 THEN 'too_many' WHEN k = 6 THEN 'range' ELSE 'ok' END END"


@query(f"""WITH o AS (SELECT l_orderkey query_id, l_orderkey % 8 k, count(*) n FROM lineitem GROUP BY ALL)
SELECT query_id, CASE WHEN k = 0 AND n > 5 THEN 'too_many' ELSE {_STATUS} END status, CASE WHEN k = 5 THEN NULL ELSE len(list_filter([k = 1, k = 2, k = 3, k = 4, k = 6, n > 5], lambda x: x)) END n_issues FROM o""")
def s8_judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a judge's answer: good, or with a decision, property, field, type, score or length that the
    schema forbids, or cut off; some fenced."""
    l, k = X.table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 8
    row = F.struct(F.col("l_partkey").cast("string").alias("candidate_id"), F.when(k == 6, 1.5).otherwise(F.col("l_discount").cast("double")).alias("score"), F.lit("").alias("reason"))
    per = l.groupBy("l_orderkey").agg(F.collect_list(row).alias("top5"))
    fields = {
        "decision": F.when(k == 1, "maybe").otherwise("accept"),
        "summary": F.when(k != 3, "s"),
        "warnings": F.array(F.lit("w")),
        "top5": F.col("top5"),
        "extra": F.when(k == 2, 1),
    }
    body = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    body = F.when(k == 4, F.replace(body, F.lit('["w"]'), F.lit('"w"'))).when(k == 5, F.substring(body, 1, 30)).when(k == 7, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    checked = A.checked(per.select(F.col("l_orderkey").alias("query_id"), body.alias("answer")), A.JUDGEMENT)
    return checked.select("query_id", "status", F.when(F.col("issues").isNotNull(), F.size("issues")).cast("long").alias("n_issues"))


@query("""SELECT p_partkey part, CASE WHEN p_partkey % 6 = 1 THEN 'range' WHEN p_partkey % 6 = 2 THEN 'type' WHEN p_partkey % 6 = 3 THEN 'enum' WHEN p_partkey % 6 = 4 THEN 'required' WHEN p_partkey % 6 = 5 THEN 'too_many' ELSE 'ok' END status,
CASE WHEN p_partkey % 6 = 1 THEN '$.hole_count:range' WHEN p_partkey % 6 = 2 THEN '$.hole_count:type' WHEN p_partkey % 6 = 3 THEN '$.symmetry:enum' WHEN p_partkey % 6 = 4 THEN '$.confidence:required' WHEN p_partkey % 6 = 5 THEN '$.dominant_colors:too_many' ELSE '' END issues FROM part""")
def s8_signature_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a visual signature: good, or with one fault."""
    k = F.col("p_partkey") % 6
    words = F.split("p_name", " ")
    fields = {name: F.array().cast("array<string>") for name in ("hole_layout", "material_appearance", "silhouette", "mounting_features", "distinctive_features", "orientation_cues", "uncertainties")}
    fields |= {"object_family": F.col("p_type"), "dominant_colors": F.when(k == 5, F.array_repeat(F.lit("red"), 6)).otherwise(words), "slot_count": F.lit(-1), "notch_count": F.lit(0)}
    fields |= {"hole_count": F.when(k == 1, F.lit(101.0)).when(k == 2, F.lit(2.5)).otherwise((F.col("p_size") % 8).cast("double"))}
    fields |= {name: F.lit("unknown") for name in ("has_flange", "has_rim", "has_hook_or_clip")} | {"symmetry": F.when(k == 3, "maybe").otherwise("symmetric"), "confidence": F.when(k != 4, 0.5)}
    body = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    checked = A.checked(X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), body.alias("answer")), A.SIGNATURE)
    return checked.select("part", "status", F.array_join("issues", "|").alias("issues"))


def by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, stored by profile."""
    X.image_vectors(spark, sf_dir).write.partitionBy("preprocess_version").parquet(path := scratch(spark, "vectors-by-profile"))
    return spark.read.parquet(path)


@query(f"""WITH {X.VEC_SQL} SELECT 1 version, id, record_id FROM vec WHERE preprocess_version = 'canon_v1' AND is_active UNION ALL SELECT 2, id, record_id FROM vec WHERE preprocess_version = 'canon_v2' AND is_active""")
def s5_profile_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored by profile; a control table's flip (version 1 to 2) moves searches to the files of the other."""
    vectors = by_profile(spark, sf_dir)
    states = lambda version, active: spark.createDataFrame([(version, active, "active"), (version, "canon_v0", "retired")], "version int, preprocess_version string, state string")
    seen = (L.searchable(vectors, states(v, active), ["preprocess_version"]).select("version", "id", "record_id") for v, active in ((1, "canon_v1"), (2, "canon_v2")))
    before, after = seen
    return before.unionByName(after)


@query(f"""WITH {X.VEC_SQL}, p AS (SELECT * FROM (VALUES ('canon_v1', true), ('canon_v2', true), ('canon_v3', true), ('canon_v2b', false), ('canon_v1', false)) t(preprocess_version, search_enabled)),
c AS (SELECT preprocess_version, count(DISTINCT record_id) r, count(*) n FROM vec WHERE is_active GROUP BY preprocess_version)
SELECT preprocess_version, search_enabled, coalesce(r, 0) distinct_records, coalesce(n, 0) active_vectors, search_enabled AND coalesce(n, 0) > 0 vector_ready FROM p LEFT JOIN c USING (preprocess_version)""")
def a2_vector_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that are on or off, one of them without vectors."""
    rows = [("m1", "r1", p, "cls_l2", on) for p, on in (("canon_v1", True), ("canon_v2", True), ("canon_v3", True), ("canon_v2b", False), ("canon_v1", False))]
    profiles = spark.createDataFrame(rows, "embedding_model string, embedding_model_version string, preprocess_version string, embedding_profile string, search_enabled boolean")
    return L.vector_readiness(profiles, X.image_vectors(spark, sf_dir)).select("preprocess_version", "search_enabled", "distinct_records", "active_vectors", "vector_ready")


@query(f"""WITH {D.HYBRID} SELECT query_id, id, round(greatest(0, least(1, CASE WHEN ordinal % 2 = 0 THEN CAST(0.65 AS DOUBLE) * similarity + CAST(0.1 AS DOUBLE) * probe_consensus ELSE CAST(0.75 AS DOUBLE) * similarity END
  + CAST(0.15 AS DOUBLE) * coalesce(metadata_score, 0) + CAST(0.1 AS DOUBLE) * coalesce(structural_score, 0))), 6) score FROM scored""")
def f5_fixed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed profile; rows of even ordinal have a masked vector (the consensus stands for its similarity)."""
    score = S.fixed_score(F.col("similarity"), F.col("probe_consensus"), F.col("metadata_score"), F.col("structural_score"), F.col("ordinal") % 2 == 0)
    return _hybrid(spark, sf_dir).select("query_id", "id", F.round(score, 6).alias("score"))


@query("""WITH p AS (SELECT page_id, ['thumb', 'front', 'back'][page_id % 3 + 1] kind, coalesce(url, '') url, ['image/webp', 'image/jpeg', 'image/png', 'text/html'][page_id % 4 + 1] mime FROM pages),
s AS (SELECT *, upper(regexp_replace(regexp_replace(regexp_replace(url, '\\.[^.]+$', ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) file_code, CASE WHEN page_id % 5 = 0 THEN ' /// ' ELSE 'up ' || url END up FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(upper(trim(url)), '[^A-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')[1:120] code0, regexp_replace(trim(up), '[^A-Za-z0-9_-]+', '', 'g')[1:100] own FROM s),
d AS (SELECT *, CASE WHEN code0 = '' THEN 'UNKNOWN' ELSE code0 END code FROM c)
SELECT page_id, file_code, kind || '/' || code || '/' || CASE WHEN own <> '' THEN own ELSE md5(kind || '|' || code || '|' || mime) END || '.' || CASE mime WHEN 'image/webp' THEN 'webp' WHEN 'image/png' THEN 'png' WHEN 'image/jpeg' THEN 'jpg' ELSE 'bin' END object_key FROM d""")
def t13_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address as a file name; every fifth upload names no usable id."""
    key, url = F.col("page_id"), F.coalesce("url", F.lit(""))
    upload = F.when(key % 5 == 0, " /// ").otherwise(F.concat(F.lit("up "), url))
    own = T.object_key(X.pick(key % 3, "thumb", "front", "back"), url, upload, X.pick(key % 4, "image/webp", "image/jpeg", "image/png", "text/html"))
    return X.table(spark, sf_dir, "pages").select("page_id", T.code_from_file(F.col("url")).alias("file_code"), own.alias("object_key"))


@query(f"""WITH {X.CAT_SQL}, {X.VEC_SQL}, b AS (SELECT * FROM (SELECT * FROM cat ORDER BY ordinal LIMIT 25 OFFSET 7)), v AS (SELECT DISTINCT record_id FROM vec)
SELECT b.id record_id, CASE WHEN b.ordinal % 10 = 0 THEN 'missing_image_path' WHEN v.record_id IS NULL THEN 'image_unavailable' ELSE 'ok' END status FROM b LEFT JOIN v ON v.record_id = b.id""")
def l6_reindex_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of more rows than are allowed, from the eighth on; every tenth part has no image."""
    none = F.col("ordinal") % 10 == 0
    rows = X.catalogue(spark, sf_dir).withColumns({c: F.when(~none, F.col(c)) for c in ("thumb_path", "front_path", "fallback_path")})
    return L.reindex_batch(rows, X.image_vectors(spark, sf_dir), 64, 100, 7).select("record_id", "status")


@query(f"""WITH {X.CAT_SQL}, f AS (SELECT id, ordinal, code, usage_side, view_mode FROM cat WHERE contains(lower(concat_ws(chr(1), code, coalesce(part_id, ''), coalesce(identifying_features, ''), usage_side, view_mode)), 'holes'))
SELECT 1 request, id, code FROM f UNION ALL SELECT 2, id, code FROM f WHERE usage_side = 'left' AND view_mode = 'single_face' UNION ALL SELECT 3, id, code FROM (SELECT * FROM cat ORDER BY ordinal LIMIT 150)""")
def s1_paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests to the paged source: a text, a text on one side in one view, and a capped scan."""
    rows = P.paged(spark, P.stored_rows(X.catalogue(spark, sf_dir), scratch(spark, "catalogue-pages")))
    found = (P.search(rows, "Holes"), P.search(rows, "holes", "left", "single_face"), P.search(rows, cap=150))
    first, second, third = (f.select(F.lit(i).alias("request"), "id", "code") for i, f in enumerate(found, 1))
    return first.unionByName(second).unionByName(third)
