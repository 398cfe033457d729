"""Whole flows on crafted rows, model answers, profile pruning, and every character of the basic plane."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gearfinch.functions import text as T
from gearfinch.operators import answers as A
from gearfinch.operators import image_flow as I
from gearfinch.operators import lifecycle as L
from gearfinch.operators import second_flow as W
from gearfinch.operators import vectors as V
from gearfinch.plans import answer_queries
from gearfinch.sources import fixtures as X

ROWS = "id string, ordinal long, code string, part_id string, identifying_features string, confusing_note string, usage_side string, view_mode string"


def test_every_character_is_decomposed_whole(spark):
    """Of all characters of the basic plane, what is left is what compatibility decomposition leaves."""
    codes = [c for c in range(1, 0xFFFF) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c long, t string").select("c", T.norm_v4(F.col("t")).alias("v4"), T.norm_v1(F.col("t")).alias("v1")).collect()

    def plain(c, first):
        t = "".join(x for x in unicodedata.normalize("NFKD", f"a{chr(c)}b") if not 0x300 <= ord(x) <= 0x36F)
        t = t.replace("đ", "d").lower() if first else t.lower().replace("đ", "d")
        return re.sub("[^a-z0-9]+", " ", t).strip()

    assert not [hex(r["c"]) for r in found if r["v4"] != plain(r["c"], True) or r["v1"] != plain(r["c"], False)]


@pytest.fixture(scope="module")
def world(spark):
    """Four parts and their vectors: 1 and 2 nearly alike, 3 apart, 4 with other holes beside 3."""
    rows = spark.createDataFrame([("1", 1, "A1", "p1", "plate", None, "left", "x"), ("2", 2, "A2", "p2", "plate", None, "right", "x"), ("3", 3, "A3", "p3", "ring 4 holes", None, "left", "x"), ("4", 4, "A4", "p4", "ring 6 holes", None, "left", "x")], ROWS)
    places = {"1": [1.0, 0.0, 0.0, 0.0], "2": [0.999, 0.03, 0.0, 0.0], "3": [0.0, 0.0, 1.0, 0.0], "4": [0.0, 0.0, 0.8, 0.6]}
    vectors = [(int(r), r, "front", v, "m", "r", "c", "l", True) for r, v in places.items()]
    layout = "id long, record_id string, asset_type string, embedding array<double>, embedding_model string, embedding_model_version string, preprocess_version string, embedding_profile string, is_active boolean"
    return rows, spark.createDataFrame(vectors, layout)


def test_image_flow_cases(spark, world):
    """Exact code, nothing near, clear, near tie, hole conflict, orientation conflict, abstaining judge, unsure model."""
    rows, vectors = world
    tie, ring, far = [1.0, 0.01, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, -1.0, 0.0, 0.0]
    apart = [0.0, 0.0, 0.78, 0.62]
    asked = {"exact": (tie, " a2 "), "none": (far, ""), "clear": (ring, "ring"), "tie": (tie, ""), "holes": (ring, "ring 4 holes"), "side": (tie, ""), "abstain": (tie, ""), "unsure": (tie, ""), "silent": (tie, "")}
    probes = spark.createDataFrame([(q, 1, v, m) for q, (v, m) in asked.items()], "query_id string, probe_id int, embedding array<double>, message string")
    rankings, judged = [], []
    for q in ("tie", "side", "abstain", "unsure"):
        close = q in ("abstain",)
        rankings += [(q, "2", 0.9, 1, q == "unsure"), (q, "99", 0.99, 2, False), (q, "1", 0.88 if close else 0.5, 3, False), (q, "2", 0.1, 4, False)]
    rankings += [("holes", "3", 0.9, 1, False), ("holes", "4", 0.1, 2, False)]
    for q, decision in (("abstain", "abstain"), ("unsure", "accept"), ("holes", "accept"), ("tie", "accept")):
        judged += [(q, decision, "77", 1.0, 0), (q, decision, "3" if q == "holes" else "1", 0.7, 1)]
    table = lambda given, extra: spark.createDataFrame(given, f"query_id string, {extra}")
    orientation = table([("side", True)], "orientation_conflict boolean")
    found = I.routed(probes, vectors, rows, ("m", "r", "c", "l"), table(rankings, "candidate_id string, score double, seq int, ambiguous boolean"), table(judged, "decision string, candidate_id string, score double, seq int"), orientation)
    told = {}
    for r in found.orderBy("query_id", "place").collect():
        told.setdefault(r["query_id"], (r["mode"], r["decision"], []))[2].append(r["id"])
    assert told["exact"] == ("EXACT", None, ["2"]) and told["none"] == ("VECTOR_NO_MATCH", None, [None])
    assert told["clear"][0] in ("VECTOR_CLEAR", "VECTOR_RERANKED")
    assert told["tie"] == ("VECTOR_RERANKED", None, ["2", "1"])
    assert told["abstain"] == ("VECTOR_RERANKED_JUDGED", "abstain", ["1"]) and told["unsure"] == ("VECTOR_RERANKED_JUDGED", "accept", ["1"])
    assert told["side"] == ("VECTOR_RERANKED_JUDGED", "ambiguous", [None]) and told["silent"][0] == "VECTOR_RERANKED"
    assert told["holes"] == ("VECTOR_RERANKED_JUDGED", "accept", ["3"])
    assert apart and len(told) == len(asked)


def test_second_flow(spark):
    """Few rows found bring the scan; rows without a point are shown only among few; verified rows come first."""
    table = [(str(i), i, f"C{i}", f"p{i}", "red gear 4 holes" if i < 3 else None, None, "left", "x") for i in range(40)]
    rows = spark.createDataFrame(table, ROWS)
    queries = spark.createDataFrame([("a", "red gear 4 holes", None), ("b", "zzz", None), ("c", "zzz", ["gear"])], "query_id string, message string, seen array<string>")
    best = W.ranked(queries, rows)
    per = {r["query_id"]: (r["n"], r["retrieved"]) for r in best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("retrieved").alias("retrieved")).collect()}
    assert per == {q: (3, 40) for q in "abc"}  # 9, none and 3 found: all scan; only three rows have points
    few = {r["query_id"] for r in W.ranked(queries, rows.where("ordinal < 20")).collect()}
    assert few == {"a", "b", "c"}  # of 30 rows or fewer all are shown
    first = best.where("query_id = 'a'").orderBy("place").first()
    assert first["score"] == 16 * 3 + 35 + 25 + 4 and first["matched"][-2:] == ["khớp cụm mô tả", "khớp số lỗ: 4"]
    verified = spark.createDataFrame([("a", "2", 1, 0.3, "rim"), ("a", "2", 2, 0.9, "late"), ("a", "1", 3, 0.8, None)], "query_id string, id string, seq int, match_score double, reason string")
    shown = W.shown(best, verified).where("query_id = 'a'").orderBy("place").collect()
    assert [(r["id"], r["score"]) for r in shown] == [("1", 0.8), ("2", 0.3), ("0", 1.0)] and shown[1]["match_reason"] == "rim" and shown[0]["match_reason"].startswith("metadata có: ")
    assert {r["query_id"]: r["mode"] for r in W.routed(queries, rows).collect()} == {"a": "FOUND", "b": "FOUND", "c": "FOUND"}
    bare = W.routed(queries.where("query_id = 'b'"), rows.where("ordinal > 3")).collect()
    assert [(r["mode"], r["id"], r["match_reason"]) for r in bare] == [("NONE", None, None)]


GOOD = {"decision": "accept", "summary": "", "warnings": [], "top5": [{"candidate_id": "1", "score": 1, "reason": ""}]}


def test_answers(spark):
    row = GOOD["top5"][0]
    cases = [
        (json.dumps(GOOD), "ok", []),
        ("Sure: ```json\n" + json.dumps(GOOD) + "\n``` done", "ok", []),
        (None, "invalid_json", None),
        ("[1]", "type", ["$:type"]),
        (json.dumps(GOOD | {"decision": "no"}), "enum", ["$.decision:enum"]),
        (json.dumps(GOOD | {"decision": 1}), "type", ["$.decision:type"]),
        (json.dumps({k: v for k, v in GOOD.items() if k != "summary"} | {"x": 1, "a": 2}), "unknown_property", ["$.a:unknown_property", "$.x:unknown_property", "$.summary:required"]),
        (json.dumps(GOOD | {"top5": [row] * 6}), "too_many", ["$.top5:too_many"]),
        (json.dumps(GOOD | {"top5": [row | {"score": 1.01}, row | {"score": -1}, {"score": "1", "candidate_id": "2"}]}), "range", ["$.top5[].score:range", "$.top5[].score:type", "$.top5[].reason:required"]),
        (json.dumps(GOOD | {"warnings": [1]}), "type", ["$.warnings[]:type"]),
        (json.dumps(GOOD | {"top5": None}), "type", ["$.top5:type"]),
    ]
    rows = A.checked(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "k int, answer string"), A.JUDGEMENT).orderBy("k").collect()
    assert [(r["status"], r["issues"]) for r in rows] == [c[1:] for c in cases]
    counts = [('{"a": 3.0}', "ok"), ('{"a": 2.5}', "type"), ('{"a": -2}', "range"), ('{"a": true}', "type")]
    rows = A.checked(spark.createDataFrame(counts, "answer string, s string"), A.Fields((("a", A.COUNT),))).collect()
    assert [r["status"] for r in rows] == [r["s"] for r in rows]


def test_a_flip_reads_the_files_of_one_profile(spark, small, capsys):
    vectors = answer_queries.by_profile(spark, small)
    control = spark.createDataFrame([("canon_v1", "active"), ("canon_v2", "building")], "preprocess_version string, state string")
    seen = L.searchable(vectors, control, ["preprocess_version"])
    seen.explain()
    assert "dynamicpruning" in capsys.readouterr().out
    assert {r[0] for r in seen.select("preprocess_version").distinct().collect()} == {"canon_v1"}
    assert seen.count() == X.image_vectors(spark, small).where("preprocess_version = 'canon_v1' AND is_active").count() and V.TOP_K
