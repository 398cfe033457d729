"""Registered queries: sources, lookups, assets, vector lifecycle, sessions, evaluation and pixel jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle as L
from ..operators import pixels as P
from ..operators import vectors as V
from ..sources import fixtures as X
from . import duck as D
from .catalogue_queries import _hits, joined, query


@query(f"WITH {X.CAT_SQL} SELECT id, code, part_id, identifying_features, usage_side, view_mode, is_symmetric FROM cat")
def s1_catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.catalogue(spark, sf_dir).select("id", "code", "part_id", "identifying_features", "usage_side", "view_mode", "is_symmetric")


@query(f"WITH {X.CAT_SQL} SELECT id, code FROM cat WHERE (contains(lower(code), 'red') OR contains(lower(part_id), 'red') OR contains(lower(coalesce(identifying_features, '')), 'red')) AND usage_side = 'left'")
def s2_p4_catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(X.catalogue(spark, sf_dir), "red", side="left").select("id", "code")


_FOUND = "(contains(lower(code), t) OR contains(lower(coalesce(part_id, '')), t) OR contains(lower(coalesce(identifying_features, '')), t) OR contains(lower(usage_side), t) OR contains(lower(view_mode), t))"


@query(f"""WITH {X.CAT_SQL}, a AS (SELECT 1 search, id, ordinal FROM (SELECT *, 'gear' t FROM cat) WHERE {_FOUND} ORDER BY ordinal LIMIT 20 OFFSET 5),
b AS (SELECT 2 search, id, ordinal FROM (SELECT *, '3 HOLES' t0, '3 holes' t FROM cat) WHERE {_FOUND} AND usage_side = 'right' AND view_mode = 'dual_face' ORDER BY ordinal LIMIT 10), c AS (SELECT 3 search, id, ordinal FROM cat WHERE view_mode = 'detail_set' ORDER BY ordinal LIMIT 7 OFFSET 30)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def s2_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of searches by text, by text with side and view, and by view alone."""
    rows = X.catalogue(spark, sf_dir)
    pages = [L.search(rows, "gear", limit=20, offset=5), L.search(rows, "3 HOLES", "right", "dual_face", 10), L.search(rows, view="detail_set", limit=7, offset=30)]
    own = [p.select(F.lit(i + 1).alias("search"), "id", "ordinal") for i, p in enumerate(pages)]
    return own[0].unionByName(own[1]).unionByName(own[2])


@query(f"WITH {X.CAT_SQL}, {X.ASSETS_SQL} SELECT record_id, CASE WHEN lower(asset_type) IN ('thumb', 'front', 'back', 'detail', 'compare') THEN lower(asset_type) ELSE 'detail' END asset_type, ltrim(image_path, '/') object_key, sort_order FROM assets WHERE ltrim(image_path, '/') <> ''")
def s4_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.normalized_assets(X.raw_assets(spark, sf_dir)).select("record_id", "asset_type", "object_key", "sort_order")


@query(f"WITH {X.CAT_SQL} SELECT id, coalesce(nullif(front_path, ''), nullif(thumb_path, ''), nullif(fallback_path, '')) v5_path, coalesce(nullif(thumb_path, ''), nullif(front_path, ''), nullif(fallback_path, '')) v1_path FROM cat")
def p7_preferred_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = lambda *c: F.coalesce(*(F.when(F.col(x) != "", F.col(x)) for x in c))
    return X.catalogue(spark, sf_dir).select("id", filled("front_path", "thumb_path", "fallback_path").alias("v5_path"), filled("thumb_path", "front_path", "fallback_path").alias("v1_path"))


@query(f"WITH {X.CAT_SQL}, {X.TEXTS_SQL} SELECT DISTINCT query_id, id FROM texts t JOIN cat c ON trim(lower(t.message)) IN (lower(c.code), lower(c.part_id), lower(c.id))")
def j1_exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exact_lookup(X.text_messages(spark, sf_dir), X.catalogue(spark, sf_dir)).select("query_id", "id")


@query(f"""WITH {X.CAT_SQL}, {D.ROWS}, {X.MSGS_SQL}, {D.constraints('msgs')}, a AS (SELECT query_id, unnest(terms[1:4]) anchor FROM c)
SELECT query_id, id, count(*) n FROM a JOIN rws ON contains(row_text, anchor) GROUP BY query_id, id""")
def j2_text_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.text_retrieval(X.messages(spark), X.catalogue(spark, sf_dir))


@query("SELECT p_partkey, CASE WHEN c = '' THEN 'UNKNOWN' ELSE c END code FROM (SELECT p_partkey, left(regexp_replace(regexp_replace(strip_accents(upper(trim(p_name))), '[^A-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) c FROM part)")
def t13_safe_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "part").select("p_partkey", T.safe_code(F.col("p_name")).alias("code"))


@query("SELECT conv_id, sha256(string_agg(CAST(turn AS VARCHAR), '|' ORDER BY CAST(turn AS VARCHAR))) pool_hash, min(sha256(text)) first_hash FROM conversations GROUP BY conv_id")
def t14_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("turn").cast("string"))), "|"), 256).alias("pool_hash"), F.min(F.sha2("text", 256)).alias("first_hash"))


# ---- assets and vectors -----------------------------------------------------------------------------------------
_A = f"WITH {X.CAT_SQL}, {X.ASSETS_SQL}, na AS (SELECT record_id, ltrim(image_path, '/') object_key FROM assets WHERE ltrim(image_path, '/') <> '')"


@query(f"{_A} SELECT id, object_key FROM cat LEFT JOIN na ON record_id = id")
def j9_catalogue_with_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_assets(X.catalogue(spark, sf_dir), X.raw_assets(spark, sf_dir)).select("id", "object_key")


@query(f"""{_A}, j AS (SELECT c.ordinal // 100 batch, id, ordinal, count(object_key) n FROM cat c LEFT JOIN na ON record_id = id GROUP BY ALL)
SELECT batch, count(*) row_count, count(*) FILTER (WHERE n > 0) rows_with_assets, coalesce(string_agg(id, '|' ORDER BY ordinal) FILTER (WHERE n = 0), '') rows_without_assets, CAST(sum(n) AS BIGINT) asset_count, batch * 100 + count(*) next_offset, count(*) = 100 has_more FROM j GROUP BY batch""")
def a3_l1_asset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.asset_batches(X.catalogue(spark, sf_dir), X.raw_assets(spark, sf_dir), 100)
    return found.withColumn("rows_without_assets", F.array_join("rows_without_assets", "|"))


@query(f"WITH {X.VEC_SQL} SELECT preprocess_version, count(DISTINCT record_id) distinct_records, count(*) active_vectors, epoch(max(updated_at)) latest FROM vec WHERE is_active GROUP BY preprocess_version")
def a2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.image_vectors(spark, sf_dir)
    return L.coverage(v).select("preprocess_version", "distinct_records", "active_vectors", F.unix_timestamp(F.col("latest_updated_at").cast("timestamp")).cast("double").alias("latest"))


_REQ = f"WITH {X.VEC_SQL}, r AS (SELECT *, id // 60 * 3 + CASE WHEN id % 60 < 21 THEN 0 WHEN id % 60 < 41 THEN 1 ELSE 2 END request FROM vec), g AS (SELECT request, count(*) n, count(*) FILTER (WHERE preprocess_version <> 'canon_v2') bad FROM r GROUP BY request)"


@query(f"{_REQ} SELECT request, CASE WHEN n > 20 THEN 0 ELSE n END accepted, CASE WHEN n > 20 OR bad > 0 THEN 0 ELSE n END written, CASE WHEN n > 20 OR bad > 0 THEN n ELSE 0 END failed, CASE WHEN n > 20 THEN 'too_many_vectors' WHEN bad > 0 THEN 'profile_mismatch' END first_error, CASE WHEN n > 20 OR bad > 0 THEN 'failed' ELSE 'ok' END status FROM g")
def l3_a4_upsert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors sent in requests of 21, 20 and 19: whole requests are refused."""
    rows = X.image_vectors(spark, sf_dir).withColumn("request", F.floor(F.col("id") / 60) * 3 + F.when(F.col("id") % 60 < 21, 0).when(F.col("id") % 60 < 41, 1).otherwise(2))
    return L.request_totals(L.checked_requests(rows, X.PROFILE, 64))


@query(f"""WITH {X.VEC_SQL}, r AS (SELECT asset_type, id // 60 chunk, preprocess_version = 'canon_v2' ok FROM vec WHERE preprocess_version = 'canon_v2' OR (asset_type = 'back' AND id > 200)),
k AS (SELECT asset_type, chunk, count(*) n, count(*) FILTER (WHERE ok) w FROM r GROUP BY ALL), l AS (SELECT *, min(CASE WHEN w < n THEN chunk END) OVER (PARTITION BY asset_type) last FROM k), s AS (SELECT *, chunk <= coalesce(last, chunk) sent FROM l)
SELECT asset_type, count(*) chunks, count(*) FILTER (WHERE sent) sent, CAST(sum(n) FILTER (WHERE sent) AS BIGINT) accepted, CAST(sum(w) FILTER (WHERE sent) AS BIGINT) written, CAST(sum(n - w) FILTER (WHERE sent) AS BIGINT) failed, coalesce(sum(w) FILTER (WHERE sent), 0) = sum(n) integrity FROM s GROUP BY asset_type""")
def a5_chunked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each view in chunks of 20; the backs meet a foreign profile after the third chunk."""
    own = F.col("preprocess_version") == "canon_v2"
    rows = X.image_vectors(spark, sf_dir).where(own | ((F.col("asset_type") == "back") & (F.col("id") > 200)))
    return L.chunk_totals(rows.select("asset_type", F.floor(F.col("id") / 60).alias("chunk"), own.alias("ok")), "asset_type")


@query(f"WITH {X.VEC_SQL}, u AS (SELECT record_id, asset_type, id, quality_score, 1 seq FROM vec UNION ALL SELECT record_id, asset_type, id, quality_score + 1, 2 FROM vec WHERE id % 3 = 0) SELECT record_id, asset_type, arg_max(quality_score, seq) quality_score FROM u GROUP BY record_id, asset_type")
def l3_s9_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = X.image_vectors(spark, sf_dir)
    new = old.where("id % 3 = 0").withColumn("quality_score", F.col("quality_score") + 1)
    return L.upserted(old, new, ["record_id", "asset_type", "object_key", "view_variant", *V.PROFILE_COLUMNS]).select("record_id", "asset_type", "quality_score")


@query(f"""WITH {X.VEC_SQL}, u AS (SELECT id, id // 107 upload, (row_number() OVER (PARTITION BY id // 107 ORDER BY id) - 1) // 20 chunk,
  CASE WHEN id % 331 = 90 THEN 'dimension' WHEN id % 17 = 0 AND id % 5 = 0 AND id // 107 % 3 = 0 THEN 'profile_preprocess_version' END own FROM vec),
f AS (SELECT *, min(CASE WHEN own IS NOT NULL THEN chunk END) OVER (PARTITION BY upload) broken FROM u)
SELECT id, upload, CAST(chunk AS INT) chunk, CASE WHEN chunk = broken THEN coalesce(own, 'chunk_failed') WHEN chunk > broken THEN 'not_sent' END reject_reason FROM f""")
def l4_chunked_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of 107 vectors in chunks of 20; some hold a vector that is too short or of another profile."""
    upload = F.floor(F.col("id") / 107)
    other = (F.col("id") % 17 == 0) & (F.col("id") % 5 == 0) & (upload % 3 == 0)
    broken = F.when(F.col("id") % 331 == 90, F.slice("embedding", 1, 5)).otherwise(F.col("embedding"))
    rows = X.image_vectors(spark, sf_dir).withColumns({"upload": upload, "embedding": broken, "preprocess_version": F.when(other, "canon_v1").otherwise("canon_v2")})
    return L.sent_chunks(rows, "upload", "id", 64, X.PROFILE).select("id", "upload", "chunk", "reject_reason")


@query(f"""WITH {X.CAT_SQL}, {X.VEC_SQL} SELECT 'vector_without_part' issue, count(*) n FROM vec WHERE record_id NOT IN (SELECT id FROM cat) UNION ALL SELECT 'part_without_vector', count(*) FROM cat WHERE id NOT IN (SELECT record_id FROM vec)
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT record_id, asset_type, object_key, view_variant, preprocess_version FROM vec GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'wrong_dimension', count(*) FROM vec WHERE len(embedding) <> 64""")
def l9_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.integrity(X.catalogue(spark, sf_dir), X.image_vectors(spark, sf_dir), 64)


@query("WITH c AS (SELECT o_custkey part, o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'delete' ELSE 'upsert' END op FROM orders) SELECT part, o_totalprice price FROM c QUALIFY row_number() OVER (PARTITION BY part ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AND op = 'upsert'")
def l7_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("part"), "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price"), F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 == 0), "delete").otherwise("upsert").alias("op"))
    return L.applied_changes(o, "part", ["o_orderdate", "o_orderkey"]).select("part", "price")


@query("""WITH a AS (SELECT l_partkey part, l_orderkey version, l_linenumber seq, ['thumb', 'front', 'back', 'detail'][l_linenumber % 4 + 1] kind FROM lineitem), m AS (SELECT *, max(version) OVER (PARTITION BY part) latest FROM a)
SELECT part, count(*) assets, CAST(min({'r': CASE kind WHEN 'thumb' THEN 0 WHEN 'front' THEN 1 ELSE 2 END, 'o': seq}).o AS INT) "primary" FROM m WHERE version = latest GROUP BY part""")
def l7_asset_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as saves of their parts' assets: the latest order of a part has its set."""
    l = X.table(spark, sf_dir, "lineitem")
    rows = l.select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("version"), F.col("l_linenumber").cast("int").alias("seq"), X.pick(F.col("l_linenumber") % 4, "thumb", "front", "back", "detail").alias("asset_type"))
    return L.primary_assets(L.replaced_sets(rows, "part", "version"), "part", "seq")


@query(f"WITH {X.CAT_SQL}, {X.ASSETS_SQL}, v AS (SELECT record_id, count(*) n FROM ({'WITH ' + X.VEC_SQL + ' SELECT * FROM vec'}) GROUP BY record_id) SELECT a.record_id, a.sort_order, CASE WHEN ltrim(image_path, '/') = '' THEN 'missing_image_path' WHEN v.n IS NULL THEN 'image_unavailable' WHEN CAST(a.record_id AS BIGINT) % 5 = 0 THEN 'encode_error' ELSE 'ok' END status FROM assets a LEFT JOIN v USING (record_id)")
def l6_reindex_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every fifth part are too short; of every fifth of the others, one of three is."""
    record = F.col("record_id").cast("long")
    short = (record % 5 == 0) | ((record % 5 == 1) & (F.col("id") % 3 == 0))
    v = X.image_vectors(spark, sf_dir).withColumn("embedding", F.when(short, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return L.reindex_report(X.raw_assets(spark, sf_dir), v, 64).select("record_id", "sort_order", "status")


@query(f"WITH {X.CAT_SQL} SELECT id, code, (SELECT count(*) FROM cat) > 75 has_more FROM cat ORDER BY ordinal LIMIT 25 OFFSET 50")
def k1_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page(X.catalogue(spark, sf_dir).select("id", "code", "ordinal"), "ordinal", 25, 50).select("id", "code", "has_more")


_NAMELESS = "SELECT *, CASE WHEN ordinal % 3 <> 0 THEN CAST(ordinal // 2 AS VARCHAR) END i, CASE WHEN ordinal % 6 <> 0 THEN 'C' || ordinal // 4 END c FROM cat"


@query(f"WITH {X.CAT_SQL}, n AS (SELECT *, coalesce(i, c, coalesce(part_id, '') || '|' || coalesce(usage_side, '')) k FROM ({_NAMELESS})) SELECT k, ordinal FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY ordinal) = 1")
def w3_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with ids that stand twice, rows without an id, and rows without a code either: the first of each key stays."""
    o = F.col("ordinal")
    rows = X.catalogue(spark, sf_dir).withColumns({"id": F.when(o % 3 != 0, F.floor(o / 2).cast("string")), "code": F.when(o % 6 != 0, F.concat(F.lit("C"), F.floor(o / 4).cast("string")))})
    return L.first_wins(rows.withColumn("k", L.row_key("part_id", "usage_side")), ["k"], ["ordinal"]).select("k", "ordinal")


# ---- sessions ---------------------------------------------------------------------------------------------------
@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 40")
def w5_trace_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.last_rows(X.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 40).select("user_id", "event_id")


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END role, left(text, 1800) text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6 in_answer FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8")
def w6_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight turns of each conversation; the last six go into the answer."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = L.last_rows(X.table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 8).withColumn("in_answer", F.row_number().over(w) <= 6)
    return kept.select("conv_id", "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), F.substring("text", 1, 1800).alias("text"), "in_answer")


@query("SELECT user_id, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 at_ms FROM events")
def a11_trace_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return X.table(spark, sf_dir, "events").select("user_id", "event_id", F.floor((at - F.min(at).over(Window.partitionBy("user_id"))) / 1000).alias("at_ms"))


@query("""WITH c AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'gemini' ELSE 'openrouter' END provider FROM events WHERE event_type IN ('click', 'view')),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, provider ORDER BY ts, event_id) n FROM c), a AS (SELECT *, CASE WHEN n <= 2 THEN row_number() OVER (PARTITION BY user_id, n <= 2 ORDER BY ts, event_id) END t FROM p)
SELECT user_id, event_id, provider, n <= 2 AND coalesce(t <= 3, false) admitted FROM a""")
def w7_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two calls of a provider and three in all for each query; refused calls cost nothing."""
    e = X.table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    calls = e.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "click", "gemini").otherwise("openrouter").alias("provider"))
    return L.admitted_calls(calls, "user_id", ["ts", "event_id"], 2, 3).select("user_id", "event_id", "provider", "admitted")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') gemini, count(*) FILTER (WHERE event_type = 'view') openrouter, count(*) FILTER (WHERE event_type IN ('click', 'view')) total FROM events GROUP BY user_id")
def a10_call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("gemini"), F.count_if(F.col("event_type") == "view").alias("openrouter"), F.count_if(F.col("event_type").isin("click", "view")).alias("total"))


@query("SELECT user_id, count(*) events, epoch_us(max(ts)) - epoch_us(min(ts)) duration_us FROM events GROUP BY user_id")
def a11_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("duration_us"))


@query("""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER w answer, lead(turn) OVER w next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, conv_id || ':' || turn eq, CASE WHEN turn % 3 <> 2 THEN sha256(coalesce(text, '')) END eh, conv_id || ':' || CASE WHEN next % 5 = 0 THEN turn - 1 ELSE turn END aq, CASE WHEN next % 4 = 1 THEN sha256(coalesce(answer, '')) WHEN next % 4 = 3 THEN sha256(coalesce(text, '')) END ah FROM t WHERE next IS NOT NULL)
SELECT conv_id, turn, CASE WHEN eq <> aq THEN 'stale_query_id' WHEN eh <> ah THEN 'image_hash' END error FROM p""")
def j10_stale_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a request and the next one its answer; some answers name an older request or another image."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = X.table(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(w), "next": F.lead("turn").over(w)}).where("next IS NOT NULL")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    expected = F.struct(name(F.col("turn")).alias("query_id"), F.when(F.col("turn") % 3 != 2, digest("text")).alias("image_hash"))
    actual = F.struct(name(F.when(F.col("next") % 5 == 0, F.col("turn") - 1).otherwise(F.col("turn"))).alias("query_id"), F.when(F.col("next") % 4 == 1, digest("answer")).when(F.col("next") % 4 == 3, digest("text")).alias("image_hash"))
    return L.stale_responses(t.select("conv_id", "turn", expected.alias("expected"), actual.alias("actual"))).select("conv_id", "turn", "error")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events WHERE event_type IN ('error', 'purchase')), k AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id) ok FROM e),
f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND n > coalesce(ok, 0)) failures FROM k GROUP BY user_id)
SELECT user_id, failures, CASE WHEN failures = 0 THEN 'done' WHEN failures >= 4 THEN 'failed' ELSE 'retry' END state FROM f""")
def l5_retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    return L.retry_totals(e.select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("ok")), "user_id", ["ts", "event_id"])


# ---- evaluation -------------------------------------------------------------------------------------------------
_RANK = f"{D.FUSED}, rk AS (SELECT c.query_id, min(f.rank) rank FROM counts c LEFT JOIN fused f ON f.query_id = c.query_id AND f.record_id = c.truth GROUP BY c.query_id)"


@query(f"WITH {_RANK} SELECT count(*) queries, round(avg(CAST(coalesce(rank <= 1, false) AS INT)), 6) recall_1, round(avg(CAST(coalesce(rank <= 5, false) AS INT)), 6) recall_5, round(avg(CAST(coalesce(rank <= 10, false) AS INT)), 6) recall_10, round(avg(CAST(coalesce(rank <= 30, false) AS INT)), 6) recall_30, round(avg(coalesce(1.0 / rank, 0)), 6) mrr FROM rk")
def e1_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recall_and_mrr(_truth_ranks(spark, sf_dir), [])


def _truth_ranks(spark: SparkSession, sf_dir: str, profile: tuple[str, ...] = X.PROFILE) -> DataFrame:
    p = X.probes(spark, sf_dir)
    counts = p.groupBy("query_id").agg(F.count("*").alias("n_probes"), F.first("truth").alias("truth"), F.first("message").alias("message"))
    fused = V.fused_probes(V.top_hits(X.image_vectors(spark, sf_dir), p, profile), counts.select("query_id", "n_probes"))
    return L.first_relevant(counts, fused, "truth")


@query(f"WITH {_RANK} SELECT message slice, count(*) queries, round(avg(CAST(coalesce(rank <= 30, false) AS INT)), 6) recall_30, avg(CAST(coalesce(rank <= 30, false) AS INT)) >= 0.95 gate FROM rk JOIN counts USING (query_id) GROUP BY message")
def e3_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = L.recall_and_mrr(_truth_ranks(spark, sf_dir), ["message"])
    return per.select(F.col("message").alias("slice"), "queries", "recall_30", (F.col("recall_30") >= 0.95).alias("gate"))


_BY_PROFILE = f"WITH {_RANK} SELECT message slice, count(*) queries, round(avg(CAST(coalesce(rank <= 30, false) AS INT)), 6) recall_30, round(avg(coalesce(1.0 / rank, 0)), 6) mrr FROM rk JOIN counts USING (query_id) GROUP BY message"


@query(f"SELECT 'canon_v2' profile, * FROM ({_BY_PROFILE}) UNION ALL SELECT 'canon_v1', * FROM ({_BY_PROFILE.replace("preprocess_version = 'canon_v2' AND", "preprocess_version = 'canon_v1' AND")})")
def e3_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of two profiles side by side."""
    own = [L.recall_and_mrr(_truth_ranks(spark, sf_dir, (*X.PROFILE[:2], p, X.PROFILE[3])), ["message"]).select(F.lit(p).alias("profile"), F.col("message").alias("slice"), "queries", "recall_30", "mrr") for p in ("canon_v2", "canon_v1")]
    return own[0].unionByName(own[1])


@query(f"WITH {X.VEC_SQL} SELECT preprocess_version, count(*) vectors, CAST(sum(len(embedding) * 2) AS BIGINT) half_bytes FROM vec GROUP BY preprocess_version")
def e4_storage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.image_vectors(spark, sf_dir).groupBy("preprocess_version").agg(F.count("*").alias("vectors"), F.sum(F.size("embedding") * 2).alias("half_bytes"))


# ---- quality, foreground, pixels --------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.25 * least(1, sqrt(l_quantity * 100 * 800) / 900) + 0.25 * l_discount * 10 + 0.2 * l_tax * 10 + 0.3 * (l_quantity / 50))), 6) quality FROM lineitem")
def f10_query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.query_quality(q * 100, F.lit(800.0), F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10, q / 50), 6).alias("quality"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 < 0.05 THEN 'fallback_original' WHEN l_discount * 10 < 0.35 THEN 'skip_removal' WHEN l_tax * 10 >= 0.7 THEN 'use_mask' ELSE 'fallback_original' END \"action\" FROM lineitem")
def d9_foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.foreground_action(F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 10).alias("action"))


_PIX = """px AS (SELECT vec_id, pos, pos % 8 x, pos // 8 y, v r, v g, greatest(0, least(255, v + label)) b, CASE WHEN pos = 0 AND vec_id % 4 = 0 THEN 30 ELSE 255 END a
  FROM (SELECT vec_id, label, pos, CAST(greatest(0, least(255, round(128 + 400 * CAST(embedding[pos + 1] AS DOUBLE)))) AS INT) v FROM embeddings, range(0, 64) t(pos))),
bp AS (SELECT *, CAST(x IN (0) AS INT) + CAST(x IN (7) AS INT) + CAST(y = 0 AS INT) + CAST(y = 7 AS INT) k FROM px WHERE (x IN (0, 7) OR y IN (0, 7)) AND a >= 20),
mn AS (SELECT vec_id, sum(k * r) / sum(k) mr, sum(k * g) / sum(k) mg, sum(k * b) / sum(k) mb FROM bp GROUP BY vec_id),
bs AS (SELECT vec_id, any_value(mr) mr, any_value(mg) mg, any_value(mb) mb, sum(k * sqrt((r - mr) ** 2 + (g - mg) ** 2 + (b - mb) ** 2)) / sum(k) spread FROM bp JOIN mn USING (vec_id) GROUP BY vec_id)"""


@query(f"WITH {_PIX} SELECT vec_id, round(mr, 4) r, round(mg, 4) g, round(mb, 4) b, round(spread, 4) spread FROM bs")
def i1_border_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.border_stats(P.fixture_pixels(X.table(spark, sf_dir, "embeddings")), 8, 8)
    return s.select("vec_id", *(F.round(c, 4).alias(c) for c in ("r", "g", "b", "spread")))


_MASK = f"""{_PIX}, fl AS (SELECT vec_id, count(*) FILTER (WHERE a < 245) > 0.64 aware FROM px GROUP BY vec_id),
mk AS (SELECT px.*, aware, spread, CASE WHEN aware THEN a > 36 ELSE round(sqrt((r - mr) ** 2 + (g - mg) ** 2 + (b - mb) ** 2), 9) > round(greatest(28, least(82, 24 + 1.4 * spread)), 9) END fg FROM px JOIN bs USING (vec_id) JOIN fl USING (vec_id)),
mc AS (SELECT vec_id, any_value(aware) aware, any_value(spread) spread, count(*) FILTER (WHERE fg) / 64 coverage, min(x) FILTER (WHERE fg) x0, max(x) FILTER (WHERE fg) x1, min(y) FILTER (WHERE fg) y0, max(y) FILTER (WHERE fg) y1 FROM mk GROUP BY vec_id)"""


@query(f"""WITH {_MASK} SELECT vec_id, aware alpha_aware, round(coverage, 6) coverage, round(CASE WHEN aware THEN greatest(0, least(1, 0.85 + least(0.14, coverage))) ELSE greatest(0, least(1, 1 - spread / 80)) * CASE WHEN coverage > 0.03 AND coverage < 0.92 THEN 1 ELSE 0.35 END END, 5) confidence FROM mc""")
def i2_foreground_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.masks(P.fixture_pixels(X.table(spark, sf_dir, "embeddings")), 8, 8)
    return P.mask_summary(m, 8, 8).select("vec_id", "alpha_aware", F.round("coverage", 6).alias("coverage"), F.round("confidence", 5).alias("confidence"))


@query(f"WITH {_MASK} SELECT vec_id, CASE WHEN f THEN 0 ELSE x0 END min_x, CASE WHEN f THEN 0 ELSE y0 END min_y, CASE WHEN f THEN 7 ELSE x1 END max_x, CASE WHEN f THEN 7 ELSE y1 END max_y FROM (SELECT *, x0 IS NULL OR coverage < 0.02 OR coverage > 0.96 f FROM mc)")
def i3_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.masks(P.fixture_pixels(X.table(spark, sf_dir, "embeddings")), 8, 8)
    return P.mask_summary(m, 8, 8).select("vec_id", *(F.col(c).cast("long").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


@query(f"""WITH {_MASK}, b AS (SELECT vec_id, CASE WHEN f THEN 0 ELSE x0 END ax, CASE WHEN f THEN 0 ELSE y0 END ay, CASE WHEN f THEN 7 ELSE x1 END bx, CASE WHEN f THEN 7 ELSE y1 END b2 FROM (SELECT *, x0 IS NULL OR coverage < 0.02 OR coverage > 0.96 f FROM mc)),
p AS (SELECT *, CAST(floor(greatest(bx - ax + 1, b2 - ay + 1) * 0.14 + 0.5) AS BIGINT) pad FROM b), c AS (SELECT vec_id, greatest(0, ax - pad) x0, greatest(0, ay - pad) y0, least(7, bx + pad) x1, least(7, b2 + pad) y1 FROM p), s AS (SELECT *, greatest(x1 - x0 + 1, y1 - y0 + 1) side FROM c),
q AS (SELECT *, CAST(greatest(0, least(greatest(0, 8 - side), floor((x0 + x1) / 2.0 - side / 2.0 + 0.5))) AS BIGINT) crop_x, CAST(greatest(0, least(greatest(0, 8 - side), floor((y0 + y1) / 2.0 - side / 2.0 + 0.5))) AS BIGINT) crop_y FROM s)
SELECT vec_id, crop_x, crop_y, least(side, 8 - crop_x, 8 - crop_y) crop_side FROM q""")
def i3_square_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.masks(P.fixture_pixels(X.table(spark, sf_dir, "embeddings")), 8, 8)
    return P.square_crop(P.mask_summary(m, 8, 8), 8, 8).select("vec_id", *(F.col(c).cast("long").alias(c) for c in ("crop_x", "crop_y", "crop_side")))


@query(f"WITH {_PIX} SELECT vec_id, pos, CAST(round_even(greatest(0, least(255, (0.2126 * r + 0.7152 * g + 0.0722 * b - 128) * 1.12 + 128)), 0) AS INT) gray FROM px")
def i4_gray_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fixture_pixels(X.table(spark, sf_dir, "embeddings")).select("vec_id", "pos", P.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))
