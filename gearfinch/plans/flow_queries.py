"""Registered queries of whole flows: the second search flow with observations and verified rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import image_flow as I
from ..operators import second_flow as W
from ..sources import fixtures as X
from . import duck as D
from .catalogue_queries import query
from .legacy_queries import _HINTS, _ROW, _SPLIT1, _first
from .rerank_queries import RANKINGS, _tables

#: What a vision model might see in the images beside three messages.
SEEN = (("m02", ["gear", "xám"]), ("m03", ["Widget", "red", " "]), ("m15", ["bolt"]))

_SEEN_SQL = "seen AS (SELECT * FROM (VALUES ('m02', ['gear', 'xám']), ('m03', ['Widget', 'red', ' ']), ('m15', ['bolt'])) t(query_id, seen))"
_CLEAN = "list_filter(list_transform({0}, lambda x: trim(x)), lambda x: x <> '')"
_SECOND = f"""{X.CAT_SQL}, {X.MSGS_SQL}, {_SEEN_SQL},
a0 AS (SELECT query_id, message, {D.norm_v1('message')} n, coalesce(seen, []) seen FROM msgs LEFT JOIN seen USING (query_id)),
a1 AS (SELECT *, {_HINTS} hints, list_filter({_SPLIT1}, lambda x: length(x) >= 3) words FROM a0),
a2 AS (SELECT *, {_CLEAN.format("list_concat(hints, seen, [left(coalesce(message, ''), 120)])")} tx, {_CLEAN.format("list_concat(hints, seen, words)")} tm FROM a1),
a3 AS (SELECT query_id, n phrase, ({_first('tx')})[1:8] tx, list_filter(list_transform({_first('tm')}, lambda x: {D.norm_v1('x')}), lambda x: length(x) >= 2) terms,
  regexp_extract_all(coalesce(message, ''), '(?i)(\\d+)\\s*(?:lỗ|lo|hole|holes)', 1) holes FROM a2),
nd AS (SELECT query_id, unnest(CASE WHEN len(tx) > 0 THEN tx ELSE [''] END) needle, unnest(range(0, greatest(1, len(tx)))) k FROM a3),
h AS (SELECT query_id, k, id FROM nd JOIN cat ON contains(lower(code), lower(needle)) OR contains(lower(coalesce(part_id, '')), lower(needle)) OR contains(lower(coalesce(identifying_features, '')), lower(needle))
  OR contains(lower(coalesce(usage_side, '')), lower(needle)) OR contains(lower(coalesce(view_mode, '')), lower(needle)) QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY ordinal) <= 40),
few AS (SELECT query_id FROM a3 WHERE (SELECT count(*) FROM h WHERE h.query_id = a3.query_id) < 12),
f AS (SELECT query_id, id FROM h UNION SELECT query_id, id FROM few, (SELECT id FROM cat ORDER BY ordinal LIMIT 1500)),
p AS (SELECT a3.*, cat.*, count(*) OVER (PARTITION BY query_id) retrieved, {D.norm_v1(_ROW)} t, {D.norm_v1('code')} c1, {D.norm_v1('part_id')} p1 FROM f JOIN a3 USING (query_id) JOIN cat USING (id)),
g AS (SELECT *, list_filter(holes, lambda x: contains(' ' || t || ' ', ' ' || x || ' ') AND (contains(t, 'lo') OR contains(t, 'hole'))) yes,
  list_filter(holes, lambda x: NOT (contains(' ' || t || ' ', ' ' || x || ' ') AND (contains(t, 'lo') OR contains(t, 'hole')))) no, phrase <> '' AND contains(t, phrase) whole FROM p),
s AS (SELECT *, coalesce(list_sum(list_transform(terms, lambda x: CASE WHEN x IN (c1, p1) THEN 80 WHEN contains(t, x) THEN 16 ELSE 0 END)), 0) + CASE WHEN whole THEN 35 ELSE 0 END + 25 * len(yes)
    + CASE WHEN trim(coalesce(identifying_features, '')) <> '' THEN 4 ELSE 0 END + CASE WHEN trim(coalesce(confusing_note, '')) <> '' THEN 3 ELSE 0 END score,
  list_concat(list_transform(list_filter(terms, lambda x: coalesce(x IN (c1, p1), false) OR contains(t, x)), lambda x: CASE WHEN coalesce(x IN (c1, p1), false) THEN 'khớp mã/ID: ' ELSE 'metadata có: ' END || x),
    CASE WHEN whole THEN ['khớp cụm mô tả'] ELSE [] END, list_transform(yes, lambda x: 'khớp số lỗ: ' || x)) m,
  list_concat(list_transform(list_filter(terms, lambda x: NOT (coalesce(x IN (c1, p1), false) OR contains(t, x))), lambda x: 'chưa thấy trong metadata: ' || x), list_transform(no, lambda x: 'số lỗ ' || x || ' chưa xác nhận trong metadata')) u FROM g),
r AS (SELECT *, ({_first('m')})[1:8] matched, ({_first('u')})[1:6] unknown, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) place FROM s WHERE score > 0 OR retrieved <= 30
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) <= 15),
v AS (SELECT query_id, id, CASE place WHEN 1 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END match_score, CASE place WHEN 2 THEN 'same rim' ELSE '' END reason FROM r SEMI JOIN seen USING (query_id) WHERE place IN (1, 2, 4)),
w AS (SELECT r.* EXCLUDE place, match_score, reason, row_number() OVER (PARTITION BY r.query_id ORDER BY match_score IS NULL, match_score DESC, place) place FROM r LEFT JOIN v ON v.query_id = r.query_id AND v.id = r.id)
"""


@query(
    f"""WITH {_SECOND} SELECT a3.query_id, CASE WHEN id IS NULL THEN 'NONE' ELSE 'FOUND' END "mode", CAST(place AS INT) place, id, code, round(coalesce(match_score, greatest(0, least(1, score / 100))), 6) score,
coalesce(nullif(reason, ''), nullif(array_to_string(matched, ', '), ''), CASE WHEN id IS NOT NULL THEN 'được chọn bởi metadata + đặc điểm ảnh' END) match_reason, array_to_string(unknown, '|') unknown, retrieved
FROM a3 LEFT JOIN (SELECT * FROM w WHERE place <= 5) w ON w.query_id = a3.query_id"""
)
def d8_second_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, three of them with an image: its observation takes part in the search, and a model verified the first,
    second and fourth row."""
    seen = spark.createDataFrame(SEEN, "query_id string, seen array<string>")
    queries, rows = X.messages(spark).join(seen, "query_id", "left"), X.catalogue(spark, sf_dir)
    best = W.stored(W.ranked(queries, rows), "second-flow-ranked")
    verified = best.where(F.col("place").isin(1, 2, 4)).join(seen, "query_id", "left_semi")
    verified = verified.select("query_id", "id", F.col("place").alias("seq"), F.when(F.col("place") == 1, 0.4).otherwise(0.9).alias("match_score"), F.when(F.col("place") == 2, "same rim").otherwise("").alias("reason"))
    shown = W.shown(best, verified)
    out = queries.select("query_id").join(shown, "query_id", "left")
    mode = F.when(F.col("id").isNull(), "NONE").otherwise("FOUND").alias("mode")
    return out.select("query_id", mode, "place", "id", "code", F.round("score", 6).alias("score"), "match_reason", F.array_join("unknown", "|").alias("unknown"), "retrieved")


_NUMBER = "CAST(query_id[2:] AS BIGINT) // 10"


@query(
    f"""WITH {RANKINGS}, ask AS (SELECT query_id, CASE WHEN {_NUMBER} % 7 = 0 THEN ' prt000012' ELSE message END message FROM counts),
ex AS (SELECT query_id, id, code, ordinal FROM ask JOIN cat ON trim(lower(message)) IN (lower(code), lower(part_id), lower(id))),
judgements AS (SELECT query_id, ['accept', 'ambiguous', 'abstain'][{_NUMBER} % 3 + 1] decision, id candidate_id, CAST(0.9 AS DOUBLE) score, 10 - pool_rank seq FROM pool WHERE pool_rank <= 7 AND {_NUMBER} % 5 <> 0
  UNION ALL SELECT DISTINCT query_id, ['accept', 'ambiguous', 'abstain'][{_NUMBER} % 3 + 1], 'outside', CAST(1 AS DOUBLE), 0 FROM pool WHERE {_NUMBER} % 5 <> 0),
safe AS (SELECT r.*, code FROM rankings r JOIN pool p ON p.query_id = r.query_id AND p.id = r.candidate_id QUALIFY row_number() OVER (PARTITION BY r.query_id, candidate_id ORDER BY seq) = 1),
g AS (SELECT query_id, count(*) n, max(final_score) top1, arg_max(raw_vector_similarity, (final_score, -ordinal)) raw, arg_max(probe_consensus, (final_score, -ordinal)) consensus,
  coalesce(list_sort(list(final_score), 'DESC')[2], 0) top2, count(*) FILTER (WHERE structural_score = 0) conflicts FROM scored GROUP BY query_id),
b AS (SELECT query_id, list_sort(list(score), 'DESC') b, bool_or(ambiguous) a FROM safe GROUP BY query_id),
md AS (SELECT k.query_id, CASE WHEN k.query_id IN (SELECT query_id FROM ex) THEN 'EXACT' WHEN g.n IS NULL THEN 'VECTOR_NO_MATCH'
  WHEN NOT (g.n >= 2 AND (round(top1 - top2, 6) < 0.06 OR conflicts > 0 OR raw < 0.86 OR consensus < 0.5)) THEN 'VECTOR_CLEAR'
  WHEN a OR conflicts > 0 OR (len(b) >= 2 AND round(b[1] - b[2], 6) < 0.05) THEN 'VECTOR_RERANKED_JUDGED' ELSE 'VECTOR_RERANKED' END "mode" FROM ask k LEFT JOIN g USING (query_id) LEFT JOIN b USING (query_id)),
every AS (SELECT query_id, 'EXACT' "mode", id, code, CAST(NULL AS DOUBLE) final_score, ordinal o FROM ex
  UNION ALL SELECT query_id, 'VECTOR_CLEAR', id, code, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, ordinal) FROM scored
  UNION ALL SELECT query_id, 'VECTOR_RERANKED', candidate_id, code, score, seq FROM safe
  UNION ALL SELECT j.query_id, 'VECTOR_RERANKED_JUDGED', j.candidate_id, p.code, j.score, j.seq FROM judgements j JOIN pool p ON p.query_id = j.query_id AND p.id = j.candidate_id),
shown AS (SELECT every.*, row_number() OVER (PARTITION BY every.query_id ORDER BY o) place FROM every JOIN md ON md.query_id = every.query_id AND md."mode" = every."mode" QUALIFY row_number() OVER (PARTITION BY every.query_id ORDER BY o) <= 5)
SELECT md.query_id, md."mode", CASE WHEN md."mode" = 'VECTOR_RERANKED_JUDGED' THEN CASE WHEN CAST(md.query_id[2:] AS BIGINT) // 10 % 5 = 0 THEN 'ambiguous' ELSE ['accept', 'ambiguous', 'abstain'][CAST(md.query_id[2:] AS BIGINT) // 10 % 3 + 1] END END decision,
  CAST(place AS INT) place, id, code, final_score FROM md LEFT JOIN shown ON shown.query_id = md.query_id"""
)
def d6_image_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image queries, every seventh with an exact code; the judge names an id outside the pool, and says nothing to some."""
    number = F.floor(F.substring("query_id", 2, 20).cast("long") / 10)
    rankings, pool = _tables(spark, sf_dir)
    pool = W.stored(pool, "flow-given-pool").where(number % 5 != 0)
    decision = X.pick(number % 3, "accept", "ambiguous", "abstain").alias("decision")
    inside = pool.where("pool_rank <= 7").select("query_id", decision, F.col("id").alias("candidate_id"), F.lit(0.9).alias("score"), (10 - F.col("pool_rank")).alias("seq"))
    outside = pool.select("query_id", decision).distinct().select("query_id", "decision", F.lit("outside").alias("candidate_id"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("seq"))
    probes = X.probes(spark, sf_dir).withColumn("message", F.when(number % 7 == 0, " prt000012").otherwise(F.col("message")))
    return I.routed(probes, X.image_vectors(spark, sf_dir), X.catalogue(spark, sf_dir), X.PROFILE, W.stored(rankings, "flow-given-rankings"), inside.unionByName(outside))
