"""Catalogue views over the star-schema tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = ("m1", "r1", "canon_v2", "cls_l2")
MESSAGES = (
    ("m01", "PRT000012"),
    ("m02", "tìm mã có 4 lỗ"),
    ("m03", "red widget 4 holes round"),
    ("m04", "linh kiện màu đen bên trái"),
    ("m05", "ĐEN tròn"),
    ("m06", "double gear golden"),
    ("m07", "blue bolt 4 loại"),
    ("m08", "oval left and right"),
    ("m09", "có bao nhiêu mã oval"),
    ("m10", "so sánh PRT000001 và PRT000002"),
    ("m11", "hello"),
    ("m12", ""),
    ("m13", "gear\u00a03 holes"),
    ("m14", '"round", (square)!'),
    ("m15", "zzz qqq"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    code = F.concat(F.lit("PRT"), F.lpad(key.cast("string"), 6, "0"))
    features = F.concat("p_name", F.lit(" "), (F.col("p_size") % 8).cast("string"), F.lit(" holes "), pick(F.col("p_size") % 4, "oval", "round", "square", ""))
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"),
        key.cast("long").alias("ordinal"),
        code.alias("code"),
        F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("part_id"),
        F.when(key % 11 != 0, features).alias("identifying_features"),
        F.when(key % 3 != 0, F.concat(F.lit("see "), "p_type")).alias("confusing_note"),
        pick(key % 4, "left", "right", "both", "unknown").alias("usage_side"),
        pick(key % 3, "single_face", "dual_face", "detail_set").alias("view_mode"),
        (key % 2 == 0).alias("is_symmetric"),
        F.concat(F.lit("thumb/"), code, F.lit(".webp")).alias("thumb_path"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("front/"), code, F.lit(".webp"))).alias("front_path"),
        F.lit(None).cast("string").alias("fallback_path"),
    )


def raw_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir).where("ordinal % 7 <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("ordinal") % 4).cast("int"))))
    kind = pick(F.col("k"), "thumb", "FRONT", "back", "poster")
    path = F.when(F.col("ordinal") % 13 == 0, "").otherwise(F.concat(F.lit("/"), F.lower(kind), F.lit("/"), "code", F.lit(".webp")))
    return rows.select(F.col("id").alias("record_id"), "ordinal", kind.alias("asset_type"), path.alias("image_path"), (F.col("k") + 1).alias("sort_order"))


def _mixed(*parts: tuple[float, str]) -> Column:
    """A weighted sum of double arrays of equal length."""
    out = F.transform(parts[0][1], _times(parts[0][0]))
    for w, name in parts[1:]:
        out = F.zip_with(out, F.col(name), _plus(w))
    return out


def _times(w: float):
    return lambda x: x * F.lit(w)


def _plus(w: float):
    return lambda a, b: a + F.lit(w) * b


def vectors_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e, table(spark, sf_dir, "embeddings").count()


def _shifted(e: DataFrame, n: int, by: int) -> DataFrame:
    """vec_id and the vector `by` places further, around the end."""
    return e.select(F.pmod(F.col("vec_id") - by, F.lit(n)).alias("vec_id"), F.col("e").alias(f"e{by}"))


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = vectors_of(spark, sf_dir)
    joined = e.join(_shifted(e, n, 1), "vec_id").join(_shifted(e, n, 7), "vec_id")
    views = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("embedding")) for k, v in enumerate((_mixed((1.0, "e")), _mixed((0.8, "e"), (0.6, "e1")), _mixed((0.9, "e"), (-0.45, "e7"))))))
    rows = joined.select("vec_id", F.explode(views).alias("v")).select("vec_id", "v.k", "v.embedding").withColumn("id", F.col("vec_id") * 3 + F.col("k"))
    kind = pick(F.col("k"), "front", "back", "detail")
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        "id",
        F.col("vec_id").cast("string").alias("record_id"),
        kind.alias("asset_type"),
        F.concat(kind, F.lit("/"), F.col("vec_id").cast("string"), F.lit(".webp")).alias("object_key"),
        F.when(F.col("id") % 2 == 0, "canon_rgb_v2").otherwise("canon_gray_v2").alias("view_variant"),
        F.lit("m1").alias("embedding_model"),
        F.lit("r1").alias("embedding_model_version"),
        F.when(F.col("id") % 17 == 0, "canon_v1").otherwise("canon_v2").alias("preprocess_version"),
        F.lit("cls_l2").alias("embedding_profile"),
        "embedding",
        F.lit("fixture").alias("foreground_status"),
        ((F.col("id") % 100) / 100.0).alias("quality_score"),
        (F.col("id") % 19 != 0).alias("is_active"),
        created.alias("created_at"),
        (created + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("updated_at"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, truth, message, probe_id (1, 2), view_variant, embedding."""
    e, n = vectors_of(spark, sf_dir)
    joined = e.where("vec_id % 10 = 0").join(_shifted(e, n, 3), "vec_id").join(_shifted(e, n, 5), "vec_id")
    easy = F.col("vec_id") % 20 == 0
    first = F.when(easy, _mixed((1.0, "e"))).otherwise(_mixed((0.8, "e"), (0.6, "e3")))
    second = F.when(easy, _mixed((0.95, "e"), (0.3, "e5"))).otherwise(_mixed((0.6, "e"), (0.8, "e5")))
    both = F.array(F.struct(F.lit(1).alias("probe_id"), F.lit("canon_rgb_v2").alias("view_variant"), first.alias("embedding")), F.struct(F.lit(2).alias("probe_id"), F.lit("canon_gray_v2").alias("view_variant"), second.alias("embedding")))
    message = pick(F.floor(F.col("vec_id") / 10) % 4, "", "round 4 holes", "red widget", "left oval")
    return joined.select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), F.col("vec_id").cast("string").alias("truth"), message.alias("message"), F.explode(both).alias("p")).select("query_id", "truth", "message", "p.*")


def _written(spark: SparkSession, rows: list[tuple[str, str]] | tuple[tuple[str, str], ...]) -> DataFrame:
    """query_id and message of inline rows: a local relation, so no executor starts Python for them."""
    ids, texts = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table([pa.array(ids), pa.array(texts)], ["query_id", "message"]))


def messages(spark: SparkSession) -> DataFrame:
    return _written(spark, MESSAGES)


#: With one of the eight, part 12 alone has the holes and the code; its colour conflicts: few strong rows, none strict.
STRONG = [(f"s{h}", f"PRT000012 {h} holes black") for h in range(8)]
COUNTS = [("k0", "count red"), ("k1", "có bao nhiêu mã oval bên trái"), ("k2", "đếm round"), ("k3", "count"), ("k4", "count PRT0000"), ("k5", "how many red holes: count left"), ("k6", "zzz count"), ("k7", "red")]


def routed_messages(spark: SparkSession) -> DataFrame:
    return messages(spark).unionByName(_written(spark, STRONG))


def count_messages(spark: SparkSession) -> DataFrame:
    return messages(spark).unionByName(_written(spark, COUNTS))


def text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inline messages, and all conversation turns."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("message"))
    return messages(spark).unionByName(turns)


# ---- the same views for DuckDB ----------------------------------------------------------------------------------
CAT_SQL = """cat AS (SELECT CAST(p_partkey AS VARCHAR) id, CAST(p_partkey AS BIGINT) ordinal, 'PRT' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') code, p_brand || '-' || p_size part_id,
  CASE WHEN p_partkey % 11 <> 0 THEN p_name || ' ' || (p_size % 8) || ' holes ' || ['oval', 'round', 'square', ''][p_size % 4 + 1] END identifying_features,
  CASE WHEN p_partkey % 3 <> 0 THEN 'see ' || p_type END confusing_note, ['left', 'right', 'both', 'unknown'][p_partkey % 4 + 1] usage_side,
  ['single_face', 'dual_face', 'detail_set'][p_partkey % 3 + 1] view_mode, p_partkey % 2 = 0 is_symmetric, 'thumb/PRT' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.webp' thumb_path,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'front/PRT' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.webp' END front_path, CAST(NULL AS VARCHAR) fallback_path FROM part)"""
ASSETS_SQL = """assets AS (SELECT id record_id, ordinal, ['thumb', 'FRONT', 'back', 'poster'][k + 1] asset_type,
  CASE WHEN ordinal % 13 = 0 THEN '' ELSE '/' || lower(['thumb', 'FRONT', 'back', 'poster'][k + 1]) || '/' || code || '.webp' END image_path, CAST(k + 1 AS INT) sort_order
  FROM (SELECT *, unnest(range(0, ordinal % 4 + 1)) k FROM cat WHERE ordinal % 7 <> 0))"""
_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e, (SELECT count(*) FROM embeddings) n FROM embeddings)"


def _mix_sql(*parts: tuple[float, str]) -> str:
    return "list_transform(range(1, len(a.e) + 1), lambda i: " + " + ".join(f"CAST({w} AS DOUBLE) * {name}.e[i]" for w, name in parts) + ")"


VEC_SQL = f"""{_E}, vec AS (SELECT vec_id * 3 + k id, CAST(vec_id AS VARCHAR) record_id, ['front', 'back', 'detail'][k + 1] asset_type, ['front', 'back', 'detail'][k + 1] || '/' || vec_id || '.webp' object_key,
  CASE WHEN (vec_id * 3 + k) % 2 = 0 THEN 'canon_rgb_v2' ELSE 'canon_gray_v2' END view_variant, 'm1' embedding_model, 'r1' embedding_model_version,
  CASE WHEN (vec_id * 3 + k) % 17 = 0 THEN 'canon_v1' ELSE 'canon_v2' END preprocess_version, 'cls_l2' embedding_profile, embedding, 'fixture' foreground_status,
  ((vec_id * 3 + k) % 100) / 100.0 quality_score, (vec_id * 3 + k) % 19 <> 0 is_active, TIMESTAMP '2024-01-01' created_at, TIMESTAMP '2024-01-01' + to_seconds(vec_id * 3 + k) updated_at
  FROM (SELECT a.vec_id, k, CASE k WHEN 0 THEN {_mix_sql((1.0, 'a'))} WHEN 1 THEN {_mix_sql((0.8, 'a'), (0.6, 'b'))} ELSE {_mix_sql((0.9, 'a'), (-0.45, 'c'))} END embedding
    FROM e a JOIN e b ON b.vec_id = (a.vec_id + 1) % a.n JOIN e c ON c.vec_id = (a.vec_id + 7) % a.n, range(0, 3) r(k)))"""
PROBES_SQL = f"""probes AS (SELECT 'q' || a.vec_id query_id, CAST(a.vec_id AS VARCHAR) truth, ['', 'round 4 holes', 'red widget', 'left oval'][(a.vec_id // 10) % 4 + 1] message, CAST(p AS INT) probe_id,
  CASE p WHEN 1 THEN 'canon_rgb_v2' ELSE 'canon_gray_v2' END view_variant,
  CASE WHEN a.vec_id % 20 = 0 AND p = 1 THEN {_mix_sql((1.0, 'a'))} WHEN a.vec_id % 20 = 0 THEN {_mix_sql((0.95, 'a'), (0.3, 'c'))} WHEN p = 1 THEN {_mix_sql((0.8, 'a'), (0.6, 'b'))} ELSE {_mix_sql((0.6, 'a'), (0.8, 'c'))} END embedding
  FROM e a JOIN e b ON b.vec_id = (a.vec_id + 3) % a.n JOIN e c ON c.vec_id = (a.vec_id + 5) % a.n, range(1, 3) r(p) WHERE a.vec_id % 10 = 0)"""


def _values(rows: list[tuple[str, str]]) -> str:
    return "msgs AS (SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(q, m.replace("'", "''")) for q, m in rows) + ") t(query_id, message))"


MSGS_SQL, ROUTED_SQL, COUNTS_SQL = _values(MESSAGES), _values([*MESSAGES, *STRONG]), _values([*MESSAGES, *COUNTS])
TEXTS_SQL = MSGS_SQL + ", texts AS (SELECT * FROM msgs UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"
