"""Memory and work of single steps at sizes where they used to fail."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from gearfinch.functions import text as T
from gearfinch.llm import line_dedup, quality_rules
from gearfinch.operators import ann as A
from gearfinch.operators import lifecycle as L
from gearfinch.operators import ngrams as G
from gearfinch.operators import rerank as K
from gearfinch.operators import scoring as S
from gearfinch.operators import vectors as V
from gearfinch.plans.catalogue_queries import ORACLE, QUERIES
from gearfinch.sources import fixtures as X

from .conftest import same


def test_nearest_needs_no_matrix_of_all_probes():
    """6,000 probes against batches of 4,000 rows, some of them equal: the same hits as by brute force, in little memory."""
    n, each, dim, k = 6000, 4000, 8, 5
    draw = np.random.default_rng(5)
    q, m = draw.normal(size=(n, dim)), draw.normal(size=(2 * each, dim))
    m[100:160], m[7] = m[99], 0.0
    names = ["id", "record_id", "asset_type", "embedding"]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + each)), pa.array([str(i % 50) for i in range(a, a + each)]), pa.array(["front"] * each), pa.array(list(m[a : a + each]))], names) for a in (each, 0)]
    tracemalloc.start()
    found = pa.Table.from_batches(list(V.nearest(V.Probes([f"q{i}" for i in range(n)], [1] * n, q), iter(batches), k)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    own = {}
    for r in found.to_pylist():
        own.setdefault(r["query_id"], []).append((-r["similarity"], r["id"], r["record_id"]))
    unit = m[m.any(1)] / np.linalg.norm(m[m.any(1)], axis=1, keepdims=True)
    ids = np.flatnonzero(m.any(1))
    for i in range(0, n, 97):
        sim = np.round(unit @ q[i] / np.linalg.norm(q[i]), 6)
        best = ids[np.lexsort((ids, -sim))[:k]]
        assert [x[1:] for x in sorted(own[f"q{i}"])] == [(j, str(j % 50)) for j in best]


def test_visits_leave_in_small_batches(spark, tmp_path, monkeypatch):
    """Probes leave with their vectors, once for each visited cell: never all of a batch at once."""
    n = 400
    draw = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, str(i), "front", draw.normal(size=4).tolist()) for i in range(n)], "id long, record_id string, asset_type string, embedding array<double>")
    index = A.build_index(vectors, f"{tmp_path}/index", n_cells=8)
    probes = vectors.select(F.col("record_id").alias("query_id"), F.lit(1).alias("probe_id"), "embedding")
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "cell", "visit").collect())
    whole, hits = key(A.visited(index, probes, None)), sorted(tuple(r) for r in A.search(index, probes, 5).collect())
    monkeypatch.setattr(A, "ROWS_OUT", 20)
    monkeypatch.setattr(V, "BLOCK", 1)
    monkeypatch.setattr(V, "STRIP", 7)
    assert key(A.visited(index, probes, None)) == whole and len(whole) == n * index.cells().count()
    assert sorted(tuple(r) for r in A.search(index, probes, 5).collect()) == hits


def test_bulk_import_of_parts_that_share_a_code(spark, tmp_path):
    """Keys of seven digits lose their last one in a code of six: each part keeps its own row, as in SQL."""
    keys = [100000, 100001, 999999, 1000000, 1000003, 1000004, 1000010, 1000011]
    spark.createDataFrame([(k, "red gear", "Brand#1", "STEEL", 3, 1.0) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["a9_bulk_import"](spark, str(tmp_path))
    assert found.count() == len(keys)
    same(found, ORACLE["a9_bulk_import"], str(tmp_path))


def test_files_of_one_batch_replace_each_other(spark):
    files = spark.createDataFrame([("a.jpg", 1, 1), ("A.png", 1, 2), ("a-back.jpg", 2, 3)], "name string, batch int, seq int")
    rows = lambda df: [(r["code"], r["front"], r["back"]) for r in K.imported_files(df).collect()]
    assert rows(files.drop("batch")) == [("A", "A.png", "a-back.jpg")]
    assert set(rows(files)) == {("A", "A.png", None), ("A", None, "a-back.jpg")}


@pytest.mark.parametrize("listed", [256, 3, 0])
def test_stated_needles_need_no_index(spark, small, monkeypatch, listed):
    """Listed needles and needles by gram find what the stored index finds, and nothing is written for the listed ones."""
    monkeypatch.setattr(G, "LISTED", listed)
    monkeypatch.setattr(G, "DEALT", 3)
    rows = X.catalogue(spark, small).where("ordinal < 60")
    needles = ["red", "e", "", "prt0000", "holes round", "zzz", "t-1", "both\nleft", None]
    asked = spark.createDataFrame([(i, n, s, v) for i, n in enumerate(needles) for s, v in (("all", "all"), ("left", "all"), ("right", "single_face"))], "k int, needle string, side string, view string")
    key = lambda df: sorted(tuple(r) for r in df.select("k", "side", "view", "id", "n").collect())
    texts = G.fields_of(L.SEARCHED)
    for each in (None, 5):
        with monkeypatch.context() as m:
            if listed > len(needles):
                m.setattr(G, "stored", None)
            m.setattr(G, "scratch", None)
            got = key(G.searched(G.scanned(rows, texts), asked, each))
        assert got and got == key(G.searched(G.built(rows, texts), asked, each))


def test_characters_written_out_are_found_by_ranges(spark):
    """All characters of several base characters, between plain and accented ones; the pattern is a few ranges."""
    assert len(T._SEVERAL_CLASS) < 8 * len(T._SEVERAL) and set(re.findall(T._SEVERAL_CLASS, "".join(map(chr, range(0x20, 0xD800))))) == {c for c in T._SEVERAL if c < "\ud800"}
    texts = [f"é{c}x{c}" for c in T._SEVERAL] + ["", "été", "".join(T._SEVERAL), "ﬁﬁ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["e"] for r in df.select("i", T.expanded(F.col("t")).alias("e")).collect()}
    assert found == {i: t and "".join(T._SEVERAL.get(c, c) for c in t) for i, t in enumerate(texts)}


def test_facts_of_rows_give_the_same_evidence(spark, small):
    """Shapes, sides and colours told once for a row, not again for each pair; rows of one file are dealt to all tasks."""
    rows, asked = X.catalogue(spark, small).where("ordinal < 40"), S.with_constraints(X.messages(spark))
    plain = S.evidence(S.with_row_text(rows).crossJoin(asked))
    told = S.evidence(S.paired(S.with_row_facts(S.with_row_text(rows)), asked))
    key = lambda df: sorted(str(tuple(r)) for r in df.select("query_id", "id", "evidence", "conflicts", "ok").collect())
    assert key(told) == key(plain)
    scored = S.scored_metadata(X.messages(spark), rows)
    plan = scored._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan and "RepartitionByExpression" in plan


def most_python_steps(df):
    """Python steps in one task, at most, of df's plan."""
    most = 0

    def below(node):
        nonlocal most
        name, own = node.nodeName(), [below(node.children().apply(i)) for i in range(node.children().size())]
        # parts of a union are tasks of their own
        found = (max(own) if name == "Union" else sum(own)) + bool(re.search("Python|InArrow", name))
        most = max(most, found)
        return 0 if "Exchange" in name else found

    plan = df._jdf.queryExecution().executedPlan()
    below(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return most


def test_one_python_worker_for_each_task(spark, monkeypatch):
    """Each further step in a task holds a worker of its own beside the first (pipeline: quality_rules and line_dedup)."""
    draw = np.random.default_rng(8)
    line = lambda: " ".join(f"w{i}" for i in draw.integers(0, 3000, 12))
    shared = [line() for _ in range(5)]
    rows = [(i, None if i == 7 else "\n".join([line(), shared[i % 5] + f" x{i % 3}", line()]), "en") for i in range(60)] + [(None, shared[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    plans = []
    for module in (line_dedup, quality_rules):
        monkeypatch.setattr(module, "stored", lambda df, name, keep=module.stored: plans.append((name, most_python_steps(df))) or keep(df, name))
    kept = quality_rules.kept_documents(docs, labels)
    found = line_dedup.deduplicated(docs)
    plans += [("kept", most_python_steps(kept)), ("deduplicated", most_python_steps(found))]
    assert {"quality-cutoffs", "line-pairs", "line-words", "line-verified"} <= {name for name, _ in plans}
    assert all(n <= 1 for _, n in plans), plans
    assert kept.count() == 59 + 1
    own = {r["row"]["doc_id"]: r for r in found.collect()}
    assert len(own) == 61 and sum(r["n_removed"] for r in own.values()) > 40
    assert own[7]["row"]["text"] is None and own[7]["n_lines"] == 0 and own[None]["row"]["text"] == shared[0]
