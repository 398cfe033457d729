"""Registered queries of text candidates, routing, public projections, model answers and later gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import rerank as K
from ..operators import retrieval as R
from ..operators import routing as Q
from ..operators import scoring as S
from ..sources import fixtures as X
from . import duck as D
from .catalogue_queries import _ANCHORS, _POOL, _STRICT, ORACLE, _hybrid, query
from .legacy_queries import F7, L as V4, _pairs, _V1P
from .rerank_queries import RANKINGS, _tables

CANDIDATES = f"""{X.CAT_SQL}, {D.ROWS}, {X.MSGS_SQL}, {D.constraints('msgs')}, n0 AS (SELECT query_id, message, list_filter({_ANCHORS}, lambda x: x IS NOT NULL) a FROM c),
n1 AS (SELECT query_id, list_concat([message], list_filter(a, lambda x, i: list_position(a, x) = i)[1:4]) a FROM n0), nd AS (SELECT query_id, unnest(a) needle, unnest(range(0, len(a))) source FROM n1),
th AS (SELECT query_id, source, id FROM nd JOIN cat ON contains(lower(code), lower(needle)) OR contains(lower(coalesce(part_id, '')), lower(needle)) OR contains(lower(coalesce(identifying_features, '')), lower(needle))
  OR contains(lower(coalesce(usage_side, '')), lower(needle)) OR contains(lower(coalesce(view_mode, '')), lower(needle)) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY ordinal) <= 80),
tf AS (SELECT query_id, id, min(source) source FROM th GROUP BY ALL), tc AS (SELECT query_id, source, sum(count(*)) OVER (PARTITION BY query_id ORDER BY source) - count(*) before FROM tf GROUP BY query_id, source),
cand AS (SELECT tf.* FROM tf JOIN tc USING (query_id, source) WHERE source <= 1 OR before < 80)"""
FALLBACK = f"""{CANDIDATES}, cp AS (SELECT c.*, r.* FROM cand JOIN c USING (query_id) JOIN rws r USING (id)), {D.evidence('cp', 'ce')},
cs AS (SELECT query_id, count(*) nc, count(*) FILTER (WHERE {_STRICT}) ns FROM ce GROUP BY query_id),
wk AS (SELECT c.query_id FROM c LEFT JOIN cs USING (query_id) WHERE coalesce(nc, 0) < 8 OR ((hole IS NOT NULL OR shape IS NOT NULL) AND coalesce(ns, 0) = 0)),
fb AS (SELECT query_id, id, min(source) source FROM (SELECT * FROM cand UNION ALL SELECT query_id, id, 5 FROM wk, (SELECT id FROM cat ORDER BY ordinal LIMIT 1500)) GROUP BY ALL)"""
ROUTED = f"""{FALLBACK}, fp AS (SELECT c.*, r.*, fb.source FROM fb JOIN c USING (query_id) JOIN rws r USING (id)), {D.evidence('fp', 'fe')}, fs AS (SELECT *, {_STRICT} strict FROM fe),
ex AS (SELECT DISTINCT query_id, id FROM msgs t JOIN cat c ON trim(lower(t.message)) IN (lower(c.code), lower(c.part_id), lower(c.id))),
st AS (SELECT m.query_id, (SELECT count(*) FROM ex WHERE ex.query_id = m.query_id) ne, count(*) FILTER (WHERE strict) ns, count(*) FILTER (WHERE metadata_score >= 0.2) nr, count(*) FILTER (WHERE metadata_score >= 0.45) ng FROM msgs m LEFT JOIN fs ON fs.query_id = m.query_id GROUP BY m.query_id),
md AS (SELECT query_id, CASE WHEN ne > 0 THEN 'EXACT' WHEN ns > 0 THEN 'TEXT_STRICT' WHEN nr = 0 THEN 'TEXT_NO_MATCH' WHEN ng BETWEEN 1 AND 5 THEN 'TEXT_STRONG' ELSE 'TEXT_METADATA' END "mode" FROM st),
rt AS (SELECT query_id, id, source, ordinal, code, part_id, metadata_score FROM fs JOIN md USING (query_id) WHERE ("mode" = 'TEXT_STRICT' AND strict) OR ("mode" = 'TEXT_STRONG' AND metadata_score >= 0.45) OR ("mode" = 'TEXT_METADATA' AND metadata_score >= 0.2)
  UNION ALL SELECT query_id, id, 0, ordinal, code, part_id, NULL FROM ex JOIN cat USING (id)),
routed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY metadata_score DESC NULLS LAST, source, ordinal) place FROM rt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY metadata_score DESC NULLS LAST, source, ordinal) <= 5)"""

ROUTED = ROUTED.replace(X.MSGS_SQL, X.ROUTED_SQL)


@query(f"WITH {CANDIDATES} SELECT query_id, id, CAST(source AS INT) source FROM cand")
def u1_text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.text_candidates(X.messages(spark), X.catalogue(spark, sf_dir))


_SIDE = "['all', 'left', 'right'][CAST(substr(query_id, 2) AS INT) % 3 + 1]"
_VIEW = "['all', 'single_face'][CAST(substr(query_id, 2) AS INT) % 2 + 1]"
_FILTERED = CANDIDATES.replace(
    "contains(lower(coalesce(view_mode, '')), lower(needle)) QUALIFY",
    f"contains(lower(coalesce(view_mode, '')), lower(needle)) WHERE ({_SIDE} = 'all' OR usage_side = {_SIDE}) AND ({_VIEW} = 'all' OR view_mode = {_VIEW}) QUALIFY",
)


@query(f"WITH {_FILTERED} SELECT query_id, id, CAST(source AS INT) source FROM cand")
def u1_filtered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of requests that ask for a side or a view."""
    number = F.substring("query_id", 2, 9).cast("int")
    asked = X.messages(spark).withColumns({"usage_side": X.pick(number % 3, "all", "left", "right"), "view_mode": X.pick(number % 2, "all", "single_face")})
    return Q.text_candidates(asked, X.catalogue(spark, sf_dir))


@query(f"WITH {FALLBACK} SELECT query_id, id, CAST(source AS INT) source FROM fb")
def u2_fallback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_fallback_scan(X.messages(spark), X.catalogue(spark, sf_dir))


@query(f"WITH {ROUTED} SELECT md.query_id, \"mode\", id, CAST(place AS INT) place, metadata_score FROM md LEFT JOIN routed USING (query_id)")
def d6_routed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of each text query, with its five best candidates."""
    modes, found = Q.routed_texts(X.routed_messages(spark), X.catalogue(spark, sf_dir))
    return modes.join(found, "query_id", "left").select("query_id", "mode", "id", "place", "metadata_score")


@query(f"""WITH {ROUTED}, l AS (SELECT query_id, count(*) n, string_agg(place || '. ' || code, chr(10) ORDER BY place) l FROM routed GROUP BY query_id)
SELECT query_id, "mode", coalesce(n, 0) n, CASE WHEN n > 0 THEN 'Em tìm thấy ' || n || ' mã phù hợp:' || chr(10) || l ELSE 'Xin lỗi anh, em không tìm thấy kết quả phù hợp với yêu cầu này trong catalogue.' END user_message FROM md LEFT JOIN l USING (query_id)""")
def p8_user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.user_messages(*Q.routed_texts(X.routed_messages(spark), X.catalogue(spark, sf_dir)))


@query(f"""WITH {RANKINGS}, safe AS (SELECT r.* FROM rankings r SEMI JOIN pool p ON p.query_id = r.query_id AND p.id = r.candidate_id QUALIFY row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY seq) = 1),
g AS (SELECT query_id, count(*) n, max(final_score) top1, arg_max(raw_vector_similarity, (final_score, -ordinal)) raw, arg_max(probe_consensus, (final_score, -ordinal)) consensus, coalesce(list_sort(list(final_score), 'DESC')[2], 0) top2, count(*) FILTER (WHERE structural_score = 0) conflicts FROM scored GROUP BY query_id),
j AS (SELECT query_id, list_sort(list(score), 'DESC') b, bool_or(ambiguous) a FROM safe GROUP BY query_id)
SELECT c.query_id, CASE WHEN g.n IS NULL THEN 'VECTOR_NO_MATCH' WHEN NOT (g.n >= 2 AND (round(top1 - top2, 6) < 0.06 OR conflicts > 0 OR raw < 0.86 OR consensus < 0.5)) THEN 'VECTOR_CLEAR'
  WHEN a OR conflicts > 0 OR (len(b) >= 2 AND round(b[1] - b[2], 6) < 0.05) THEN 'VECTOR_RERANKED_JUDGED' ELSE 'VECTOR_RERANKED' END "mode" FROM counts c LEFT JOIN g USING (query_id) LEFT JOIN j USING (query_id)""")
def d6_routed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of each image query: no hit, clear, reranked, or reranked and judged."""
    scored = _hybrid(spark, sf_dir)
    first = R.first_gate(scored)
    rankings, pool = _tables(spark, sf_dir)
    second = K.second_gate(K.inside_pool(rankings, pool, 1 << 30), first.select("query_id", (F.col("conflicts") > 0).alias("hole_conflict")))
    state = X.probes(spark, sf_dir).select("query_id").distinct().join(first, "query_id", "left").join(second.select("query_id", "needs_judge"), "query_id", "left")
    mode = F.when(F.col("n").isNull(), "VECTOR_NO_MATCH").when(~F.col("needs_rerank"), "VECTOR_CLEAR").when(F.col("needs_judge"), "VECTOR_RERANKED_JUDGED").otherwise("VECTOR_RERANKED")
    return state.select("query_id", mode.alias("mode"))


@query(f"""WITH {D.HYBRID}{_POOL} SELECT query_id, id, code, part_id, usage_side, similarity vector_similarity, raw_vector_similarity, CAST(probe_consensus AS DOUBLE) probe_consensus, metadata_score, structural_score, final_score,
final_score match_score, 0 n_matched, CASE WHEN structural_score = 0 THEN 1 ELSE 0 END n_conflicts FROM pool""")
def p2_public_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool rows as the asker sees them: the hit's similarity, the fused score, and the structural conflict."""
    public = Q.public_candidates(R.pooled(_hybrid(spark, sf_dir)))
    return public.select("query_id", "id", "code", "part_id", "usage_side", "vector_similarity", "raw_vector_similarity", "probe_consensus", "metadata_score", "structural_score", "final_score", "match_score", F.size("matched").alias("n_matched"), F.size("conflicts").alias("n_conflicts"))


@query(f"""WITH {F7} SELECT query_id, id, CASE WHEN ordinal % 3 = 0 THEN 0.9 WHEN ordinal % 3 = 1 AND ordinal % 2 = 0 THEN 0.4 ELSE greatest(0, least(1, score / 100)) END score FROM v4 WHERE ordinal % 5 = 0""")
def p3_public_scores_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence first, then the ranking's score, then the metadata score over 100."""
    rows = V4.scored_v4(_pairs(spark, sf_dir, V4.pairs_v4)).where("ordinal % 5 = 0")
    ranked = rows.withColumns({"confidence": F.when(F.col("ordinal") % 3 == 0, 0.9), "ranking": F.when(F.col("ordinal") % 3 != 2, F.when(F.col("ordinal") % 2 == 0, 0.4))})
    return ranked.select("query_id", "id", Q.legacy_public_score(["confidence", "ranking"], "score", 100).alias("score"))


@query(f"""WITH {_V1P}, s AS (SELECT *, CASE WHEN ex = '' THEN 0 WHEN c1 = ex THEN 120 WHEN p1 = ex THEN 110 WHEN contains(c1, ex) OR contains(p1, ex) THEN 70 ELSE 0 END
  + coalesce(list_sum(list_transform(terms, lambda x: CASE WHEN x IN (c1, p1) THEN 45 WHEN contains(t, x) THEN 12 ELSE 0 END)), 0) + CASE WHEN raw <> '' AND contains(t, raw) THEN 30 ELSE 0 END
  + CASE WHEN side = 'all' THEN 0 WHEN usage_side IN (side, 'both') THEN 18 WHEN usage_side <> 'unknown' THEN -35 ELSE 0 END score FROM p WHERE ordinal % 5 = 0)
SELECT query_id, id, round(CASE WHEN ordinal % 2 = 0 THEN 0.7 ELSE greatest(0, least(1, score / 120)) END, 9) score FROM s""")
def p3_public_scores_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V4.scored_v1(_pairs(spark, sf_dir, V4.pairs_v1).where("ordinal % 5 = 0")).withColumn("verified", F.when(F.col("ordinal") % 2 == 0, 0.7))
    return rows.select("query_id", "id", F.round(Q.legacy_public_score(["verified"], "score", 120), 9).alias("score"))


@query(f"WITH {F7}, g AS (SELECT query_id, count(*) FILTER (WHERE score > 0) n, list_sort(list(score) FILTER (WHERE score > 0), 'DESC') b FROM v4 GROUP BY query_id) SELECT query_id, CASE WHEN n BETWEEN 1 AND 5 AND b[1] - coalesce(b[2], 0) >= 12 THEN 'signature_sufficient' ELSE 'needs_resolver' END \"mode\" FROM g")
def d4_gate_after_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V4.gate_after_signature(V4.scored_v4(_pairs(spark, sf_dir, V4.pairs_v4)))


_ORDERS = "rk AS (SELECT l_orderkey query_id, CAST(l_linenumber AS INT) seq, CAST(l_discount AS DOUBLE) * 10 score, CAST(l_linenumber % 3 AS INT) n_conflicts, l_orderkey % 11 = 0 AND l_linenumber = 1 flag FROM lineitem)"


def _order_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a query, its lines as ranked candidates."""
    l = X.table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("seq"), (F.col("l_discount").cast("double") * 10).alias("score"), (F.col("l_linenumber") % 3).cast("int").alias("n_conflicts"), ((F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") == 1)).alias("flag"))


@query(f"""WITH {_ORDERS}, o AS (SELECT query_id, bool_or(flag) f, count(*) n, list_sort(list({{'s': -score, 'q': seq, 'k': n_conflicts}})) o FROM rk GROUP BY query_id),
p AS (SELECT *, -o[1].s top, n > 1 AND round(-o[1].s + o[2].s, 6) < 0.08 close, o[1].k >= 2 torn FROM o)
SELECT query_id, f OR (n >= 2 AND (close OR torn OR top < 0.65)) ambiguous, f OR top < 0.68 OR close OR torn ambiguous_v1 FROM p""")
def d5_resolver_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.resolver_ambiguity(_order_rankings(spark, sf_dir))


@query("""WITH v AS (SELECT l_orderkey query_id, l_linenumber ordinal, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS DOUBLE) * 10 END verified, CAST(l_quantity AS DOUBLE) score FROM lineitem)
SELECT query_id, CAST(ordinal AS INT) ordinal, row_number() OVER (PARTITION BY query_id ORDER BY verified IS NULL, verified DESC, CASE WHEN verified IS NULL THEN score END DESC, ordinal) place FROM v""")
def j8_verified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = X.table(spark, sf_dir, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("ordinal"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("double") * 10).alias("verified"), F.col("l_quantity").cast("double").alias("score"))
    return Q.verified_order(rows).select("query_id", "ordinal", F.col("place").cast("long").alias("place"))


@query("""WITH r AS (SELECT l_orderkey query_id, l_orderkey % 5 k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), l_discount) seq, CAST(l_partkey AS VARCHAR) candidate_id, CAST(l_discount AS DOUBLE) * 10 score FROM lineitem),
o AS (SELECT query_id, CASE WHEN k = 3 THEN 'invalid_json' WHEN k = 4 OR count(*) > 10 THEN 'schema' ELSE 'ok' END status FROM r GROUP BY query_id, k)
SELECT query_id, status, CAST(seq AS INT) place, candidate_id, score FROM o LEFT JOIN r USING (query_id) WHERE status = 'ok' UNION ALL SELECT query_id, status, NULL, NULL, NULL FROM o WHERE status <> 'ok'""")
def s8_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a model's JSON answer: plain, fenced, amid prose, cut off, or with a score out of range."""
    l = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("candidate_id"), (F.col("l_discount").cast("double") * 10 + F.when(F.col("l_orderkey") % 5 == 4, 7.0).otherwise(0.0)).alias("score")).alias("x"))
    per = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    none = F.array().cast("array<string>")
    body = F.to_json(F.struct(F.lit(False).alias("ambiguous"), F.lit("").alias("summary"), F.transform("x", lambda v: F.struct(v["candidate_id"].alias("candidate_id"), v["score"].alias("score"), none.alias("matched"), none.alias("conflicts"), none.alias("unknown"), F.lit("").alias("reason"))).alias("rankings")))
    kind = F.col("l_orderkey") % 5
    answer = F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is:\n"), body, F.lit("\nThat is all."))).when(kind == 3, F.expr("substring(b, 1, cast(length(b) / 2 as int))")).otherwise(body)
    answers = per.withColumn("b", body).select(F.col("l_orderkey").alias("query_id"), answer.alias("answer"))
    read = Q.parsed_rankings(answers)
    rows = F.when(F.col("status") == "ok", F.col("ranking.rankings"))
    return read.select("query_id", "status", F.posexplode_outer(rows).alias("place", "r")).select("query_id", "status", (F.col("place") + 1).cast("int").alias("place"), "r.candidate_id", "r.score")


@query(f"""WITH {X.CAT_SQL}, {X.MSGS_SQL}, pairs AS (SELECT * FROM msgs, cat), {D.structural('pairs')} SELECT query_id, count(*) n, count(*) FILTER (WHERE structural_score = 0) conflicts, count(*) FILTER (WHERE structural_score = 0) > 0 hole_conflict FROM st GROUP BY query_id""")
def a7_structural_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.structural_totals(S.structural(S.paired(X.catalogue(spark, sf_dir), X.messages(spark))))


@query(f"""WITH {CANDIDATES}, k AS (SELECT query_id, message, cat.*, CASE WHEN ordinal % 20 <> 3 THEN usage_side END side FROM cand JOIN msgs USING (query_id) JOIN cat USING (id)),
g AS (SELECT query_id, list_concat(CASE WHEN regexp_matches(lower(any_value(message)), '\\b(left|lhf|trai)\\b') AND regexp_matches(lower(any_value(message)), '\\b(right|rhf|phai)\\b') THEN ['Query chứa đồng thời left và right; không suy luận bằng mirror.'] ELSE [] END,
  coalesce(list('Candidate ' || id || ': thiếu usage_side cho vật thể bất đối xứng.' ORDER BY ordinal) FILTER (WHERE NOT is_symmetric AND coalesce(side, '') = ''), [])) w FROM k GROUP BY query_id)
SELECT query_id, array_to_string(w[1:10], '|') warnings FROM g""")
def a8_orientation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each message, some of them without a side."""
    rows = X.catalogue(spark, sf_dir)
    found = Q.text_candidates(X.messages(spark), rows).join(X.messages(spark), "query_id").join(rows, "id").withColumns({"usage_side": F.when(F.col("ordinal") % 20 != 3, F.col("usage_side")), "place": F.col("ordinal")})
    return Q.orientation_warnings(found).select("query_id", F.array_join("warnings", "|").alias("warnings"))


@query("""WITH o AS (SELECT page_id, url, html, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' END mime FROM pages WHERE page_id % 6 <> 5)
SELECT a.page_id, CASE WHEN o.page_id IS NULL THEN 'missing' WHEN strlen(coalesce(o.html, '')) > 2000 THEN 'too_large' END skipped, CASE WHEN o.page_id IS NOT NULL AND strlen(coalesce(o.html, '')) <= 2000 THEN md5('data:' || coalesce(mime, 'image/webp') || ';base64,' || to_base64(encode(coalesce(o.html, '')))) END data_url FROM pages a LEFT JOIN o ON o.page_id = a.page_id""")
def s6_data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects (the pages) named by paths with and without a leading slash, as data URLs up to 2,000 bytes."""
    p = X.table(spark, sf_dir, "pages")
    key = F.concat(F.col("page_id").cast("string"), F.lit(".webp"))
    objects = p.where("page_id % 6 <> 5").select(key.alias("object_key"), F.when(F.col("page_id") % 4 == 0, "image/png").when(F.col("page_id") % 4 == 1, "image/jpeg").alias("mime"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    asked = p.select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "/").otherwise(""), key).alias("path"))
    return L.data_urls(asked, objects, 2000).select("page_id", "skipped", F.md5("data_url").alias("data_url"))


@query(f"""WITH {X.VEC_SQL}, c AS (SELECT * FROM (VALUES (1, 'canon_v1', 'active'), (1, 'canon_v2', 'building'), (2, 'canon_v1', 'retired'), (2, 'canon_v2', 'active')) t(version, preprocess_version, state))
SELECT version, count(*) vectors, count(DISTINCT record_id) records, min(id) first_id, max(id) last_id FROM vec JOIN c USING (preprocess_version) WHERE is_active AND state = 'active' GROUP BY version""")
def l8_profile_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches see before (1) and after (2) the switch from one profile to the next: never both."""
    control = spark.createDataFrame([(1, "canon_v1", "active"), (1, "canon_v2", "building"), (2, "canon_v1", "retired"), (2, "canon_v2", "active")], "version int, preprocess_version string, state string")
    seen = L.searchable(X.image_vectors(spark, sf_dir), control, ["preprocess_version"])
    return seen.groupBy("version").agg(F.count("*").alias("vectors"), F.count_distinct("record_id").alias("records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_TQ4 = "list_filter(list_concat(tokens, CASE WHEN left(message, 140) <> '' THEN [left(message, 140)] ELSE [] END, terms[1:5]), lambda x: trim(x) <> '')"
_D7 = f"""{F7}, tq AS (SELECT query_id, {_TQ4} l FROM k4), tl AS (SELECT query_id, (list_filter(list_transform(l, lambda x: trim(x)), lambda x, i: list_position(list_transform(l, lambda y: trim(y)), x) = i))[1:6] l FROM tq),
tn AS (SELECT query_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE [''] END) needle, unnest(range(0, greatest(1, len(l)))) seq FROM tl),
ti AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, seq, id FROM tn JOIN cat ON contains(lower(code), lower(needle)) OR contains(lower(coalesce(part_id, '')), lower(needle)) OR contains(lower(coalesce(identifying_features, '')), lower(needle)) OR contains(lower(coalesce(usage_side, '')), lower(needle)) OR contains(lower(coalesce(view_mode, '')), lower(needle))
  QUALIFY row_number() OVER (PARTITION BY query_id, seq ORDER BY ordinal) <= 50)),
sc AS (SELECT v4.*, ti.id IS NOT NULL initial, ordinal <= 1500 scanned, hole_count >= 0 AND list_contains(matched, hole_count || ' holes') bh, len(colors) > 0 AND strong_count >= 2 AND len(list_filter(colors, lambda x: NOT list_contains(matched, 'color:' || x))) = 0 bc FROM v4 LEFT JOIN ti ON ti.query_id = v4.query_id AND ti.id = v4.id),
fl AS (SELECT query_id, count(*) FILTER (WHERE initial) ni, count(*) FILTER (WHERE initial AND (bh OR bc)) si, count(*) FILTER (WHERE scanned AND (bh OR bc)) ss, count(*) FILTER (WHERE initial AND score > 0) pi, count(*) FILTER (WHERE scanned AND score > 0) ps,
  count(*) FILTER (WHERE initial AND (list_contains(matched, 'exact code') OR list_contains(matched, 'exact part_id'))) ne FROM sc GROUP BY query_id)"""


@query(f"""WITH {_D7} SELECT query_id, CASE WHEN si > 0 OR (ni < 6 AND ss > 0) THEN 'EASY_STRONG_FILTER' WHEN ne > 0 THEN 'EASY_EXACT' WHEN pi BETWEEN 1 AND 5 THEN 'EASY_FILTER' WHEN pi < 6 AND ps = 0 THEN 'NO_MATCH' ELSE 'TEXT_FILTER_FALLBACK' END "mode" FROM fl""")
def d7_routed_texts_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of each text query in the earlier flow, where no model is at hand."""
    return V4.routed_texts_v4(X.messages(spark), X.catalogue(spark, sf_dir))


@query(f"""WITH {_V1P}, w0 AS (SELECT query_id, side, act, terms, list_filter(list_concat(token, list_filter(terms, lambda x: true), [trim(left(message, 120))]), lambda x: trim(x) <> '') l FROM i1),
w1 AS (SELECT query_id, side, act, terms, (list_filter(l, lambda x, i: list_position(l, x) = i))[1:5] l FROM w0),
w2 AS (SELECT query_id, side, act, CASE WHEN act = 'count' THEN [array_to_string(terms[1:3], ' ')] WHEN len(l) > 0 THEN l ELSE [''] END l FROM w1),
w3 AS (SELECT query_id, side, act, unnest(l) needle, unnest(range(0, len(l))) seq FROM w2),
hit AS (SELECT query_id, seq, act, id FROM w3 JOIN cat ON (contains(lower(code), lower(needle)) OR contains(lower(coalesce(part_id, '')), lower(needle)) OR contains(lower(coalesce(identifying_features, '')), lower(needle)) OR contains(lower(coalesce(usage_side, '')), lower(needle)) OR contains(lower(coalesce(view_mode, '')), lower(needle))) AND (side = 'all' OR usage_side = side)
  QUALIFY row_number() OVER (PARTITION BY query_id, seq ORDER BY ordinal) <= CASE WHEN act = 'count' THEN 1500 ELSE 30 END) SELECT DISTINCT query_id, id FROM hit""")
def u3_v1_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.retrieved_v1(X.messages(spark), X.catalogue(spark, sf_dir))


_U3 = ORACLE["u3_v1_retrieval"].replace(" SELECT DISTINCT query_id, id FROM hit", "")


@query(f"""{_U3}, f AS (SELECT DISTINCT query_id, id FROM hit), n AS (SELECT query_id, count(*) n_rows, count(*) FILTER (WHERE ex <> '' AND (c1 = ex OR p1 = ex)) ne FROM f JOIN p USING (query_id, id) GROUP BY query_id)
SELECT i1.query_id, CASE WHEN regexp_matches({D.norm_v1('message')}, '^(hello|hi|hey|xin chao|chao|chao em|hello em|alo|good (morning|afternoon|evening))( (em|denis|anh|ban))?$') THEN 'GREETING'
  WHEN NOT (length(message) > 120 OR act = 'compare' OR regexp_matches(i1.n, '\\b(?:tai sao|giai thich|phan tich|de xuat|thong ke)\\b')) AND act <> 'count' AND coalesce(ne, 0) > 0 THEN 'EXACT' WHEN act = 'count' THEN 'COUNT' ELSE 'RANKED' END "mode", coalesce(n_rows, 0) n_rows FROM i1 LEFT JOIN n ON n.query_id = i1.query_id""")
def d8_routed_texts_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.routed_texts_v1(X.messages(spark), X.catalogue(spark, sf_dir))


@query("""WITH e AS (SELECT vec_id, vec_id % 9 k, CAST(embedding AS DOUBLE[]) v FROM embeddings)
SELECT vec_id, CASE WHEN k = 0 THEN 'empty' WHEN k = 1 THEN 'image_too_large' WHEN k IN (2, 4, 8) THEN 'embedding' END reject_reason, CASE WHEN vec_id % 2 = 0 THEN 'query_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') END query_id,
CASE WHEN k = 5 THEN 'probe_1|' || repeat('x', 40) || '|probe_3' WHEN k = 4 THEN 'probe_1' ELSE '' END probes, CASE WHEN k = 6 THEN 'left' ELSE 'all' END usage_side, 'all' view_mode, CASE WHEN k IN (6, 7) THEN 'red gear' ELSE '' END message,
CASE WHEN k = 3 THEN round(list_sum(v[1:63]), 5) WHEN k = 5 THEN round(3 * list_sum(v), 5) END total, CASE WHEN k = 5 THEN 'p0|own|p0' END profiles FROM e""")
def s7_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON: empty ones, images too large, vectors of a wrong size, with a gap, or with an infinite number."""
    e, v = X.table(spark, sf_dir, "embeddings"), F.col("embedding").cast("array<double>")
    k = F.col("vec_id") % 9
    probe = lambda name, x, own=None: F.struct(F.lit(name).cast("string").alias("probe_id"), x.alias("embedding"), F.lit(own).cast("string").alias("embedding_profile"))
    fields = {
        "query_id": F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("query_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"))).otherwise(F.lit("no id!")),
        "message": F.when(k.isin(6, 7), "  red gear ").when(k == 0, "  "),
        "image_data_url": F.when(k == 1, F.repeat(F.lit("A"), 101)).when(k == 8, "data:x"),
        "query_embedding": F.when(k == 2, F.slice(v, 1, 63)).when(k == 3, F.concat(F.slice(v, 1, 63), F.array(F.lit(None).cast("double")))).when(k == 8, F.concat(F.slice(v, 1, 63), F.array(F.lit(999999.5)))),
        "embedding_profile": F.lit("p0"),
        "query_embeddings": F.when(k == 5, F.array(probe(None, v), probe("x" * 50, v, "own"), probe("", v), probe("fourth", v))).when(k == 4, F.array(probe(None, F.slice(v, 1, 10)))),
        "filters": F.when(k == 6, F.struct(F.lit("left").alias("usage_side"), F.lit("").alias("view_mode"))),
    }
    requests = e.select("vec_id", F.replace(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"}), F.lit("999999.5"), F.lit("1e999")).alias("body"))
    checked = Q.checked_queries(requests, 64, most_image=100)
    sum_ = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    total = F.when(k == 3, sum_(F.col("query_embedding"))).when(k == 5, sum_(F.flatten(F.transform("probes", lambda p: p["embedding"]))))
    profiles = F.when(k == 5, F.array_join(F.transform("probes", lambda p: p["embedding_profile"]), "|"))
    names = F.array_join(F.transform("probes", lambda p: p["probe_id"]), "|")
    return checked.select("vec_id", "reject_reason", "query_id", names.alias("probes"), "usage_side", "view_mode", "message", F.round(total, 5).alias("total"), profiles.alias("profiles"))


#: Signatures as a vision model might give them, one for each of three messages.
SIGNATURES = (("m02", "gear", ["xám"], ["4 lỗ"], ["go"], ["round"], 4), ("m03", "Widget!", ["red", "black"], [], ["oval"], ["left", "steel"], -1), ("m05", "", None, None, ["square"], None, 2))


def _signed(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SIGNATURES, "query_id string, f string, c array<string>, h array<string>, s array<string>, d array<string>, n long")
    none = F.lit(None).cast("array<string>")
    signature = F.struct(F.col("f").alias("object_family"), F.col("c").alias("dominant_colors"), F.col("h").alias("hole_layout"), none.alias("material_appearance"), F.col("s").alias("silhouette"), none.alias("mounting_features"), F.col("d").alias("distinctive_features"), F.col("n").alias("hole_count"))
    return X.messages(spark).join(rows, "query_id").select("query_id", "message", signature.cast(V4.SIGNATURE).alias("signature"))


@query("""WITH s AS (SELECT p_partkey, list_filter(list_concat([CASE WHEN p_partkey % 4 <> 0 THEN p_brand END], ['size ' || p_size, ''], string_split(p_name, ' '), CASE WHEN p_partkey % 3 = 0 THEN [] ELSE string_split(p_type, ' ') END, ['last']), lambda x: coalesce(x, '') <> '')[1:8] l FROM part)
SELECT p_partkey, array_to_string(l, '|') queries FROM s""")
def t8_signature_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's fields as a visual signature: some without a family, some without mounting features."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("array<string>")
    signature = F.struct(F.when(k % 4 != 0, F.col("p_brand")).alias("object_family"), F.array(F.concat(F.lit("size "), F.col("p_size").cast("string")), F.lit("")).alias("dominant_colors"), none.alias("hole_layout"), none.alias("material_appearance"), F.split("p_name", " ").alias("silhouette"), F.when(k % 3 != 0, F.split("p_type", " ")).alias("mounting_features"), F.array(F.lit("last")).alias("distinctive_features"), F.lit(-1).cast("long").alias("hole_count"))
    return X.table(spark, sf_dir, "part").select("p_partkey", signature.cast(V4.SIGNATURE).alias("signature")).select("p_partkey", F.array_join(V4.signature_queries(), "|").alias("queries"))


_SIGNED = f"""{F7}, sg AS (SELECT * FROM (VALUES ('m02', ['gear', 'xam', '4 lo', 'round'], 'gear', 'gear', 4), ('m03', ['widget', 'red', 'black', 'oval', 'left', 'steel'], 'widget', 'Widget!', -1), ('m05', ['square'], '', '', 2)) t(query_id, seen, family, family_as_is, n)),
g0 AS (SELECT p1.*, CASE WHEN sg.n >= 0 THEN sg.n ELSE hole_count END asked, list_filter(seen, lambda x: contains(text4, x)) vt, family <> '' AND contains(text4, family) fam, family_as_is FROM p1 JOIN sg USING (query_id)),
g1 AS (SELECT *, CASE WHEN asked < 0 THEN NULL WHEN list_contains(counts, asked) THEN 1 WHEN len(counts) > 0 THEN -1 ELSE 0 END hv FROM g0),
g2 AS (SELECT *, coalesce(list_sum(list_transform(tk, lambda s: s.p)), 0) + 12 * len(tm) + 10 * len(vt) + CASE WHEN fam THEN 22 ELSE 0 END + CASE hv WHEN 1 THEN 32 WHEN -1 THEN -28 ELSE 0 END + 10 * coalesce(list_sum(list_transform(cv, lambda s: s.v)), 0) + CASE sv WHEN 1 THEN 18 WHEN -1 THEN -25 ELSE 0 END
  + CASE WHEN trim(coalesce(identifying_features, '')) <> '' THEN 3 ELSE 0 END + CASE WHEN trim(coalesce(confusing_note, '')) <> '' THEN 2 ELSE 0 END score,
  list_concat(list_transform(tk, lambda s: s.tag), list_transform(tm, lambda x: 'metadata:' || x), list_transform(vt, lambda x: 'visual-term:' || x), CASE WHEN hv = 1 THEN [asked || ' holes'] ELSE [] END, list_transform(list_filter(cv, lambda s: s.v = 1), lambda s: 'color:' || s.c), CASE WHEN sv = 1 THEN ['side:' || side] ELSE [] END, CASE WHEN fam THEN ['family:' || family_as_is] ELSE [] END) m FROM g1)"""


@query(f"WITH {_SIGNED} SELECT query_id, id, CAST(score AS BIGINT) score, array_to_string((list_filter(m, lambda x, i: list_position(m, x) = i))[1:10], '|') matched FROM g2")
def f7_scores_with_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = V4.scored_v4(V4.pairs_v4(_signed(spark), X.catalogue(spark, sf_dir)))
    return scored.select("query_id", "id", F.col("score").cast("long").alias("score"), F.array_join("matched", "|").alias("matched"))


@query(f"WITH {F7} SELECT query_id, id, CAST(score AS BIGINT) score FROM v4 WHERE score > 0")
def p6_positive_scores_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V4.scored_v4(_pairs(spark, sf_dir, V4.pairs_v4)).where("score > 0").select("query_id", "id", F.col("score").cast("long").alias("score"))
