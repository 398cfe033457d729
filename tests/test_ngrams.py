"""Substring search by the n-gram index against a plain scan."""

import pytest
from pyspark.sql import functions as F

import gearfinch.plans.rerank_queries  # noqa: F401  (registers its queries)
from gearfinch.operators import lifecycle as L
from gearfinch.operators import ngrams as G
from gearfinch.operators import rerank as K
from gearfinch.operators import routing as Q
from gearfinch.plans.catalogue_queries import ORACLE, QUERIES
from gearfinch.sources import fixtures as X

from .conftest import same

NEEDLES = ["red", "RED".lower(), "e", "", "ho", "prt0000", "4 holes", "holes round", "zzz", "lỗ", "🙂x", "t-1", "left", "single_face", "prt000012 extra", "_"]


@pytest.fixture(scope="module")
def rows(spark, small):
    return X.catalogue(spark, small).cache()


@pytest.mark.parametrize("slice_rows", [65_536, 7])
def test_same_rows_as_a_scan(spark, rows, monkeypatch, slice_rows):
    """Needles of any length, needles that nothing has, and grams in many slices."""
    monkeypatch.setattr(G, "SLICE", slice_rows)
    index = G.built(rows, G.fields_of(L.SEARCHED))
    asked = spark.createDataFrame([(i, n, s, v) for i, n in enumerate(NEEDLES) for s, v in (("all", "all"), ("left", "all"), ("right", "single_face"))], "k int, needle string, side string, view string")
    found = {}
    for r in G.searched(index, asked).collect():
        found.setdefault((r["needle"], r["side"], r["view"]), []).append((r["n"], r["id"]))
    table = rows.collect()
    for needle in set(NEEDLES):
        for side, view in (("all", "all"), ("left", "all"), ("right", "single_face")):
            own = [r for r in table if any(needle in (r[c] or "").lower() for c in L.SEARCHED) and side in ("all", r["usage_side"]) and view in ("all", r["view_mode"])]
            expected = [r["id"] for r in sorted(own, key=lambda r: r["ordinal"])]
            got = [i for _, i in sorted(set(found.get((needle, side, view), [])))]
            assert got == expected, needle


def test_plans_have_no_nested_loop(spark, rows, capsys):
    queries = X.messages(spark)
    for df in (Q.text_candidates(queries, rows), L.text_retrieval(queries, rows), K.multi_retrieval(queries, rows), Q.retrieved_v1(queries, rows)):
        df.explain()
        plan = capsys.readouterr().out
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_rows_and_needles(spark):
    rows = spark.createDataFrame([("a", 1, None, None, None), ("b", 2, "left", "x", ""), ("c", 3, "all", "all", "aaaa")], "id string, ordinal long, usage_side string, view_mode string, t string")
    index = G.built(rows, [F.col("t")])
    needles = spark.createDataFrame([("aaa",), ("aa",), (None,), ("aaaaa",), ("",)], "needle string")
    assert sorted((r["needle"], r["id"]) for r in index.find(needles).collect()) == [("aa", "c"), ("aaa", "c")]
    asked = needles.select("needle", F.lit("all").alias("side"), F.lit("all").alias("view"))
    assert sorted(r["id"] for r in G.searched(index, asked).where("needle = ''").collect()) == ["a", "b", "c"]
    empty = G.built(rows.limit(0), [F.col("t")])
    assert G.searched(empty, asked).count() == 0


def catalogue(spark, *rows):
    names = "id string, ordinal long, code string, part_id string, identifying_features string, confusing_note string, usage_side string, view_mode string"
    return spark.createDataFrame([(str(i), i, *r) for i, r in enumerate(rows, 1)], names)


def test_strong_texts_show_strong_rows_only(spark):
    """Three rows have the holes; the side and shape conflict in two of them, and nowhere is a strict match."""
    rows = catalogue(spark, ("A1", "p", "black plate 4 holes round", None, "left", "x"), ("A2", "p", "plate 4 holes", None, "right", "x"), ("A3", "p", "plate 4 holes oval", None, "left", "x"))
    queries = spark.createDataFrame([("q", "white left round 4 holes", "all", "all"), ("s", "white left round 4 holes", "right", "")], "query_id string, message string, usage_side string, view_mode string")
    modes, found = Q.routed_texts(queries, rows)
    assert {r["query_id"]: r["mode"] for r in modes.collect()}["q"] == "TEXT_STRONG"
    shown = [(r["id"], r["metadata_score"]) for r in found.where("query_id = 'q'").orderBy("place").collect()]
    assert shown and all(score >= 0.45 for _, score in shown) and shown[0][0] == "1" and len(shown) < 3


def test_exact_rows_keep_to_the_request(spark):
    rows = catalogue(spark, ("A1", "p1", "x", None, "left", "single_face"), ("A2", "p1", "x", None, "right", "dual_face"))
    queries = spark.createDataFrame([("a", "P1", "all", None), ("b", "p1", "left", "all"), ("c", "p1", "left", "dual_face")], "query_id string, message string, usage_side string, view_mode string")
    assert sorted((r["query_id"], r["id"]) for r in L.exact_lookup(queries, rows).collect()) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_a_count_question_is_one_scan(spark):
    """The first three terms of three letters or more, joined by blanks, on the side asked for; all flows count alike."""
    rows = catalogue(spark, *(("C%d" % i, "p", "count red gear" if i % 2 else "red gear", None, "left" if i % 3 else "right", "x") for i in range(40)))
    queries = spark.createDataFrame([("a", "count red gear"), ("b", "count left"), ("c", "red gear"), ("d", "count")], "query_id string, message string")
    expected = {"a": 20, "b": 0, "d": 20}
    assert {r["query_id"]: r["n"] for r in K.broad_count(queries, rows).collect()} == expected
    flow = {r["query_id"]: (r["mode"], r["n_rows"]) for r in Q.routed_texts_v1(queries, rows).collect()}
    assert {q: n for q, (mode, n) in flow.items() if mode == "COUNT"} == expected and flow["c"][1] == 30


def test_counts_have_no_cap(spark, tmp_path):
    """More red parts than the 1,500 rows of a scan."""
    names = [("red gear" if i < 1000 or i % 2 else "blue gear") for i in range(2820)] + ["grey"] * 180
    rows = [(i, n, "Brand#1", "STEEL", 3, 1.0) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["a6_broad_count"](spark, str(tmp_path))
    same(found, ORACLE["a6_broad_count"], str(tmp_path))
    rows = catalogue(spark, *(("C%d" % i, "p", "count red gear", None, "left", "x") for i in range(1600)))
    queries = spark.createDataFrame([("a", "count red gear"), ("b", "count blue"), ("c", "red")], "query_id string, message string")
    assert {r["query_id"]: r["n"] for r in K.broad_count(queries, rows).collect()} == {"a": 1600, "b": 0}


def test_display_contract(spark):
    shown = spark.createDataFrame([("a", "1", "x"), ("b", "", "x"), ("c", "1", ""), ("d", None, "x"), ("", "1", "x"), (None, "1", "x"), ("e", "1", " ")] + [("f", str(i), "x") for i in range(6)], "query_id string, id string, code string")
    assert {r["query_id"] for r in K.shape_violations(shown).collect()} == {"b", "c", "d", "", None, "f"}


def test_requests(spark):
    bodies = ['{"query_embedding": [1, null]}', '{"query_embedding": [1, 1e999]}', '{"query_embedding": ["2.5", 0]}', '{"query_embedding": [1, "x"]}', '{"query_embedding": 5, "message": "m"}', "no json", '{"message": " "}']
    bodies += ['{"embedding_profile": "p", "query_embeddings": [{"embedding": [1, 2]}, {"probe_id": "b", "embedding": [3, 4], "embedding_profile": "own"}, {"embedding": [5, 6]}, {"embedding": [7]}]}']
    rows = Q.checked_queries(spark.createDataFrame(list(enumerate(bodies)), "k int, body string"), 2).orderBy("k").collect()
    assert [r["reject_reason"] for r in rows] == [None, "embedding", None, "embedding", None, "empty", "empty", None]
    assert rows[0]["query_embedding"] == [1.0, 0.0] and rows[2]["query_embedding"] == [2.5, 0.0]
    assert [(p["probe_id"], p["embedding"], p["embedding_profile"]) for p in rows[7]["probes"]] == [("probe_1", [1.0, 2.0], "p"), ("b", [3.0, 4.0], "own"), ("probe_3", [5.0, 6.0], "p")]
