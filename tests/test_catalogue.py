"""Every catalogue query against DuckDB, and hand-written edge cases."""

import pytest
from pyspark.sql import functions as F

import gearfinch.plans.legacy_queries  # noqa: F401
import gearfinch.plans.lifecycle_queries  # noqa: F401
import gearfinch.plans.rerank_queries  # noqa: F401
import gearfinch.plans.routing_queries  # noqa: F401
from gearfinch.functions import text as T
from gearfinch.operators import lifecycle as L
from gearfinch.operators import routing as Q
from gearfinch.operators import scoring as S
from gearfinch.operators import vectors as V
from gearfinch.plans.catalogue_queries import ORACLE, QUERIES
from gearfinch.sources import fixtures as X

from .conftest import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, small, name):
    same(QUERIES[name](spark, small), ORACLE[name], small)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_normalisers_differ_on_the_barred_d(spark):
    text = F.lit("Đen đỏ, (Ngàm)")
    assert one(spark, T.norm_v5(text)) == "đen đo ngam"
    assert one(spark, T.norm_v4(text)) == "en do ngam"
    assert one(spark, T.norm_v1(text)) == "den do ngam"


def test_borders_are_ascii(spark):
    assert one(spark, T.first_of(F.lit("đen"), {"x": "en"})) == "x"
    assert one(spark, T.first_of(F.lit("den"), {"x": "en"})) is None


@pytest.mark.parametrize(("text", "n"), [("4 lỗ", 4), ("gear\u00a03 holes", 3), ("x4 holes", None), ("4 loai", None), ("", None)])
def test_hole_counts(spark, text, n):
    assert one(spark, T.hole_count(T.norm_v5(F.lit(text)))) == n


def test_loose_holes_need_no_border(spark):
    assert one(spark, T.loose_hole_count(F.lit("blue bolt 4 loại"))) == 4


def test_matrix_path_equals_expressions(spark, small):
    v, p = X.image_vectors(spark, small).where("id < 300"), X.probes(spark, small).where("query_id IN ('q0', 'q10')")
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "probe_id", "id", "similarity", "rank").collect())
    assert key(V.top_hits(v, p, X.PROFILE, 7)) == key(V.top_hits_by_expressions(v, p, X.PROFILE, 7))


def test_blocks_of_probes_give_the_same_hits(spark, small, monkeypatch):
    v, p = X.image_vectors(spark, small).where("id < 300"), X.probes(spark, small)
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "probe_id", "id", "record_id", "asset_type", "similarity", "rank").collect())
    expected = key(V.top_hits(v, p, X.PROFILE, 7))
    monkeypatch.setattr(V, "BROADCAST_BYTES", 16 << 10)
    monkeypatch.setattr(V, "BLOCK", 16)
    assert key(V.top_hits(v, p, X.PROFILE, 7)) == expected and len(expected) == 7 * p.count()


@pytest.mark.parametrize(
    ("text", "kind", "confidence", "reason"),
    [("", "unsupported", 1.0, "empty"), (" \u00a0", "unsupported", 1.0, "empty"), ("xx: (12345)", "catalogue", 0.95, "code_like"), ("1 2\u00a03 4 5", "catalogue", 0.95, "code_like"), ("4 lỗ", "catalogue", 0.79, "catalogue_terms"), ("zzz qqq", "unknown", 0.55, "no_catalogue_signal")],
)
def test_intents(spark, text, kind, confidence, reason):
    found = one(spark, T.intent(F.lit(text), F.lit(False)))
    assert (found["kind"], found["confidence"], found["reason"]) == (kind, pytest.approx(confidence), reason)
    assert one(spark, T.intent(F.lit(text), F.lit(True)))["reason"] == "image_or_embedding"


def test_colours_keep_their_order_and_aliases(spark):
    assert one(spark, T.colors_v4(F.lit("ghi"))) == []
    assert one(spark, T.colors_v4(F.lit("xanh la do grey kem"))) == ["gray", "red", "green", "beige"]


def test_structural_scores_of_all_kinds_are_met(spark, small):
    rows = QUERIES["f4_f5_structural_fusion"](spark, small).select("structural_score").distinct().collect()
    assert {r[0] for r in rows} == {None, 0.0, 1.0}


def test_a_conflict_costs_eight_hundredths(spark):
    none = F.lit(None).cast("double")
    score = S.fused_score(F.lit(0.9), none, none, F.lit(False), F.lit(0.0), F.lit(1))
    assert one(spark, score) == pytest.approx(0.9 * 0.78 / 0.9 - 0.08)


def test_retries_count_since_the_last_success(spark):
    rows = [(1, 1, False), (1, 2, False), (1, 3, False), (1, 4, True), (1, 5, False), (2, 1, True), *((3, i, False) for i in range(4))]
    found = L.retry_totals(spark.createDataFrame(rows, "job int, seq int, ok boolean"), "job", ["seq"]).collect()
    assert {r["job"]: (r["failures"], r["state"]) for r in found} == {1: (1, "retry"), 2: (0, "done"), 3: (4, "failed")}


def test_answers_of_models(spark):
    good = '{"ambiguous": false, "summary": "", "rankings": [{"candidate_id": "1", "score": 0.5}]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, f"So: {good} -- done"), (4, good[:30]), (5, good.replace("0.5", "1.5")), (6, None), (7, "[]"), (8, good.replace("false", '"x"'))]
    found = {r["i"]: r["status"] for r in Q.parsed_rankings(spark.createDataFrame(rows, "i int, answer string")).collect()}
    assert found == {1: "ok", 2: "ok", 3: "ok", 4: "invalid_json", 5: "schema", 6: "invalid_json", 7: "invalid_json", 8: "schema"}


def test_stale_answers(spark):
    pair = "struct<query_id:string,image_hash:string>"
    rows = [(1, ("q", "h"), ("q", "h")), (2, ("q", "h"), ("p", "h")), (3, ("q", "h"), ("q", "g")), (4, ("q", None), ("q", "g")), (5, (None, ""), ("", "g"))]
    found = {r["i"]: r["error"] for r in L.stale_responses(spark.createDataFrame(rows, f"i int, expected {pair}, actual {pair}")).collect()}
    assert found == {1: None, 2: "stale_query_id", 3: "image_hash", 4: None, 5: None}


@pytest.mark.parametrize(("n", "chunks"), [(1, 1), (20, 1), (21, 2), (43, 3), (107, 6)])
def test_chunks_stop_at_the_first_failure(spark, n, chunks):
    rows = spark.range(n).selectExpr("'u' AS upload", "id div 20 AS chunk", "id <> 25 AS ok")
    r = L.chunk_totals(rows, "upload").first()
    sent = min(n, 40) if n > 25 else n
    assert (r["chunks"], r["accepted"], r["written"], r["integrity"]) == (chunks, sent, sent - (n > 25), n <= 25)


def test_vector_contract(spark):
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, None), (6, [float("inf"), 0.0])], "i int, v array<double>")
    got = {r["i"]: r["e"] for r in bad.select("i", V.contract_error(F.col("v"), 2, F.lit("k")).alias("e")).collect()}
    assert got == {1: None, 2: "dimension", 3: "not_finite", 4: "not_finite", 5: "not_an_array", 6: "not_finite"}


def test_zero_vector_stays_zero(spark):
    assert one(spark, V.l2_normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_missing_signals_leave_the_mean(spark):
    none = F.lit(None).cast("double")
    score = S.fused_score(F.lit(0.8), none, none, F.lit(False), none, F.lit(0))
    assert abs(one(spark, score) - 0.8) < 1e-12
    assert one(spark, S.fused_score(F.lit(0.8), none, none, F.lit(False), none, F.lit(9))) == pytest.approx(0.56)
