"""The vector index against the exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearfinch.operators import ann as A
from gearfinch.operators import vectors as V
from gearfinch.plans import ann_queries
from gearfinch.plans.catalogue_queries import ORACLE
from gearfinch.sources import fixtures as X

from .conftest import same

LAYOUT = "id long, record_id string, asset_type string, embedding array<double>"


@pytest.fixture(scope="module")
def clustered(spark):
    """40 clusters of 25 vectors, and a third of all rows equal."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16))
    rows = [(i, str(i), "front", (centres[i % 40] + 0.2 * r.normal(size=16)).tolist()) for i in range(1000)]
    rows += [(1000 + i, str(i), "back", rows[0][3]) for i in range(500)]
    probes = [(f"q{i}", 1, (centres[i] + 0.2 * r.normal(size=16)).tolist()) for i in range(40)]
    return spark.createDataFrame(rows, LAYOUT), spark.createDataFrame(probes, "query_id string, probe_id int, embedding array<double>"), rows, probes


def cosines(rows, probes):
    m, q = (np.array([x[3] if len(x) == 4 else x[2] for x in y]) for y in (rows, probes))
    return (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T


def test_clusters_are_found_in_few_cells(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "SLICE_ROWS", 100)
    vectors, probes, rows, asked = clustered
    index = A.build_index(vectors, f"{tmp_path}/index")
    assert index.lists().count() == 1500 and index.lists().select("slice").distinct().count() > 1
    again = A.load_index(spark, f"{tmp_path}/index")
    assert (again.n_probe, again.n_vectors, again.dim) == (index.n_probe, 1500, 16)
    sim = cosines(rows, asked)
    found = {}
    for r in A.search(index, probes, 10).collect():
        found.setdefault(r["query_id"], []).append(r["similarity"])
    kept = [sum(x >= np.sort(sim[i])[-10] - 1e-6 for x in found[q]) / 10 for i, (q, *_) in enumerate(asked)]
    assert np.mean(kept) >= 0.95 and max(map(len, found.values())) == 10
    least = index.n_probe / index.cells().count()
    assert least < 0.5  # clusters: most cells are left alone


def test_floor_search_is_exact(spark, clustered, tmp_path):
    vectors, probes, rows, asked = clustered
    index = A.build_index(vectors, f"{tmp_path}/index", n_cells=30)
    sim = np.round(cosines(rows, asked), 6)
    for floor in (0.9, 0.55):
        found = {(r["query_id"], r["id"]) for r in A.within(index, probes, floor).collect()}
        assert found == {(asked[i][0], rows[j][0]) for i, j in zip(*np.nonzero(sim >= floor), strict=True)}
    assert A.visited(index, probes, None, 0.9).count() < 0.5 * 40 * index.cells().count()


def test_odd_vectors(spark, tmp_path):
    rows = [(1, "a", "front", [1.0, 0.0]), (2, "b", "front", [0.0, 0.0]), (3, "c", "front", None), (4, "d", "front", [float("nan"), 1.0]), (5, "e", "front", [1.0]), (6, None, None, [0.6, 0.8])]
    index = A.build_index(spark.createDataFrame(rows, LAYOUT), f"{tmp_path}/index")
    probes = spark.createDataFrame([("q", 1, [1.0, 0.0]), ("z", 1, [0.0, 0.0]), ("w", 1, [1.0])], "query_id string, probe_id int, embedding array<double>")
    assert [(r["query_id"], r["id"], r["similarity"]) for r in A.search(index, probes).orderBy("rank").collect()] == [("q", 1, 1.0), ("q", 6, 0.6)]
    empty = A.build_index(spark.createDataFrame([], LAYOUT), f"{tmp_path}/empty")
    assert A.search(empty, probes).count() == 0 and A.within(empty, probes).count() == 0


def test_only_files_of_visited_cells_are_read(spark, clustered, tmp_path, capsys):
    vectors, probes, _, _ = clustered
    index = A.build_index(vectors, f"{tmp_path}/index")
    A.search(index, probes.limit(1)).explain()
    plan = capsys.readouterr().out
    assert "dynamicpruning" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_recall_on_driver_rows(spark, small):
    per = ann_queries.n6_approximate_search(spark, small).agg(F.avg("recall"), F.max("scored_share")).first()
    assert per[0] >= 0.95 and per[1] < 0.1
    same(ann_queries.n6_index_floor_search(spark, small), ORACLE["n6_index_floor_search"], small)
    assert V.MIN_SIMILARITY == 0.55 and X.PROFILE[2] == "canon_v2"


@pytest.mark.parametrize("ef", [20, 600])
def test_lists_are_never_moved(spark, clustered, tmp_path, monkeypatch, capsys, ef):
    """Neither pairs of probes and cells nor vectors are shuffled: lists are gone through where they stand, by blocks of
    probes, and what is found is what the codes of all lists tell."""
    vectors, probes, rows, asked = clustered
    index = A.build_index(vectors, f"{tmp_path}/index", n_cells=12)
    monkeypatch.setattr(A, "PROBES_A_BLOCK", 16)
    monkeypatch.setattr(A, "ROWS_OUT", 11)
    monkeypatch.setattr(V, "BLOCK", 3)
    monkeypatch.setattr(V, "STRIP", 50)
    capsys.readouterr()
    A.within(index, probes, 0.9).explain()
    plan = capsys.readouterr().out
    # the names of the visited cells alone
    assert set(re.findall(r"hashpartitioning\((\w+)#", plan)) <= {"cell"}
    hits = A.search(index, probes, 10, 12, ef)
    hits.explain()
    plan += capsys.readouterr().out
    assert "CoGroups" not in plan and "embedding" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    own, q = (np.array([x[at] for x in y]) for y, at in ((rows, 3), (asked, 2)))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit(q) @ A.codes(unit(own), index.scale).astype(float).T
    sim = np.round(cosines(rows, asked), 6)
    found = {}
    for r in hits.orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r["similarity"])
    for i, (name, *_) in enumerate(asked):
        best = np.argsort(-near[i], kind="stable")[:ef]
        assert found[name] == pytest.approx(np.sort(sim[i, best])[::-1][:10].tolist(), abs=2e-6), name
