"""The pipeline against brute force, stage by stage."""

import itertools
import os
import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gearfinch.llm import decontaminate, line_dedup, near_dedup, quality_rules

from ..conftest import duck


def least_of_components(texts):
    """The least id of each component of texts whose words are within the edit distance."""
    top = {d: d for d in texts}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    words = {d: (t or "").split() for d, t in texts.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = words[a], words[b]
        most = near_dedup.most_edits(max(len(x), len(y)), 0.8)
        if (texts[a] or "") == (texts[b] or "") or (x and y and abs(len(x) - len(y)) <= most and near_dedup.banded_distance(x, y, most) <= most):
            top[max(root(a), root(b))] = min(root(a), root(b))
    return {root(d) for d in texts}


def odd_tables(folder, empty=False):
    """Nulls, empty and very long texts, repeated rows, ids that stand for two texts, and names that clash."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(r.sample(words, n))
    clean, shared = [prose(60) for _ in range(12)], prose(40)
    texts = [None, "", " \n ", clean[0], clean[0], clean[1] + "\n" + shared, clean[2] + "\n" + shared, "\n".join(prose(2000) for _ in range(40)), *clean[3:]]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, *range(8, 16), None]
    rows = list(zip(ids, texts, strict=False))
    rows += [rows[9], (10, prose(50))]  # a repeated row, and another text of an id
    columns = {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows]), "lang": pa.array(["en", None] * 99)[: len(rows)], "source": pa.array([None, "b", "a"] * 99)[: len(rows)], "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64())}
    for c in ("key", "row", "node", "gone", "n_lines", "z", "stratum", "cut", "size", "line", "digest", "id"):
        columns[c] = pa.array([f"{c}{i}" for i in range(len(rows))])
    tables = {"documents": pa.table(columns), "labels": pa.table({"doc_id": pa.array([3, None], pa.int64()), "quality": pa.array([1, None], pa.int32()), "toxic": pa.array([0, None], pa.int32())}), "benchmark": pa.table({"item_id": pa.array([1, None, 3], pa.int64()), "text": pa.array([clean[4], None, ""])})}
    for name, t in tables.items():
        pq.write_table(t.slice(0, 0) if empty else t, f"{folder}/{name}.parquet")
    return rows, clean, shared


def test_odd_rows_through_all_stages(spark, tmp_path):
    rows, clean, shared = odd_tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        found = [(r["doc_id"], r["text"]) for r in docs.collect()] if name != "mixing" else None
        if name == "quality_rules":
            expected = [(d, t) for d, t in rows if len((t or "").split()) >= 10]
        elif name == "line_dedup":
            # the second of two equal texts and a line that stood before go; documents without ids don't change
            expected = [(d, "" if d == 4 else clean[2] if d == 6 else t) for d, t in expected]
        elif name == "near_dedup":
            # the repeated row and one of the two rows of a text go
            expected = list(dict.fromkeys(expected))
        elif name == "decontaminate":
            expected = [(d, t) for d, t in expected if t != clean[4]]
        else:
            assert docs.count() == len(expected) and docs.where("taken > 2 * size").isEmpty()
            break
        assert docs.columns == names
        assert sorted(found, key=str) == sorted(expected, key=str), name
        assert all(r["key"].startswith("key") and r["row"].startswith("row") for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    odd_tables(tmp_path, empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mixing"]
    import tempfile

    for name, stage in corpus_pipeline.STAGES:
        folder = tempfile.mkdtemp()
        docs.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            os.symlink(f"{small}/{t}.parquet", f"{folder}/{t}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, small)
        if name == "mixing":
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(before)
            break
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            kept = {r["doc_id"] for r in duck(quality_rules.OP8_SQL, folder)[1] if r["kept"]}
            assert set(after) == kept and all(after[k] == before[k] for k in kept)
        elif name == "line_dedup":
            gone = {r["doc_id"]: r["n_removed"] for r in duck(line_dedup.OP9_SQL, folder)[1]}
            assert set(after) == set(before)
            assert all((after[k] == before[k]) == (gone[k] == 0) for k in after)
        elif name == "near_dedup":
            assert set(after) < set(before) and all(after[k] == before[k] for k in after)
            assert set(after) == least_of_components(before)
        elif name == "decontaminate":
            bad = {r["doc_id"] for r in duck(decontaminate.OP1_SQL, folder)[1] if r["contaminated"]}
            assert set(after) == set(before) - bad
        docs = out


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "size", "source", "source_size", "target", "taken"]
    assert out.where(F.col("taken") > 2 * F.col("size")).isEmpty() and out.count() > 50
