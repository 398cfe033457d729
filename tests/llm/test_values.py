"""Values, not counts, on repeated rows, null ids and further columns; texts beyond a chunk; keys of texts."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gearfinch.llm import decontaminate, mixing, near_dedup, registry, texts

from .test_operators import edge  # noqa: F401  (a fixture)


@pytest.fixture(scope="module")
def odd(edge, tmp_path_factory):  # noqa: F811
    """The edge tables with repeated rows, rows without an id, and columns whose names clash."""
    folder = tmp_path_factory.mktemp("odd")
    for t in ("documents", "benchmark", "labels", "pages"):
        table = pq.read_table(f"{edge}/{t}.parquet")
        loose = table.slice(4, 2).set_column(0, table.column_names[0], pa.nulls(2, pa.int64()))
        table = pa.concat_tables([table, table.slice(3, 4), loose])
        for c in ("id", "key", "size", "line", "node", "row", "c", "s", "taken", "digest"):
            table = table.append_column(c, pa.array(["x"] * len(table)))
        pq.write_table(table, f"{folder}/{t}.parquet")
    return str(folder)


def test_mixing_values(spark, odd):
    rows = pq.read_table(f"{odd}/documents.parquet").to_pylist()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    whole = Counter()
    for r in rows:
        whole[r["source"]] += size(r["text"])
    found = [r.asDict() for r in registry.QUERIES["op4_mixing"](spark, odd).collect()]
    expected = Counter((r["doc_id"], size(r["text"]), whole[r["source"]]) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in found) == expected
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    weights = dict(zip(sorted(whole, key=lambda s: (s is None, s or "")), itertools.cycle(mixing.WEIGHTS)))
    goal, rest, left = {}, set(whole), 1.5 * sum(whole.values())
    while full := [s for s in rest if left * weights[s] / sum(weights[x] for x in rest) > 2 * whole[s]]:
        for s in full:
            goal[s] = 2.0 * whole[s]
        left, rest = left - sum(goal[s] for s in full), rest - set(full)
    goal |= {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
    assert {round(r["target"], 6) for r in found} == {round(x, 6) for x in goal.values()}
    assert sorted(map(str, found)) == sorted(str(r.asDict()) for r in registry.QUERIES["op4_mixing"](spark, odd).collect())


def test_near_dedup_values(spark, odd):
    rows = pq.read_table(f"{odd}/documents.parquet").to_pylist()
    words = [(r["text"] or "").split() for r in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = words[a], words[b]
        most = near_dedup.most_edits(max(len(x), len(y)), 0.8)
        if (rows[a]["text"] or "") == (rows[b]["text"] or "") or (x and y and abs(len(x) - len(y)) <= most and near_dedup.banded_distance(x, y, most) <= most):
            top[max(root(a), root(b))] = min(root(a), root(b))
    group = defaultdict(list)
    for i, r in enumerate(rows):
        group[root(i)].append(r["doc_id"])
    expected = Counter((r["doc_id"], min((d for d in group[root(i)] if d is not None), default=None), len(group[root(i)])) for i, r in enumerate(rows))
    found = registry.QUERIES["op5_near_dedup"](spark, odd).select("doc_id", "class_id", "class_size").collect()
    assert Counter(tuple(r) for r in found) == expected


def test_warc_values(spark, odd):
    rows = pq.read_table(f"{odd}/pages.parquet").to_pylist()
    payload = lambda r: (r["html"] or "").encode()
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    largest = {}
    for r in rows:
        if r["page_id"] is not None:
            largest[payload(r)] = max(largest.get(payload(r), r["page_id"]), r["page_id"])
    found = [r.asDict() for r in registry.QUERIES["op6_warc"](spark, odd).collect()]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found) == Counter((r["page_id"], len(payload(r)), digest(payload(r))) for r in rows)
    by_digest = {digest(b): i for b, i in largest.items()}
    responses = Counter(r["payload_digest"] for r in found if r["record_type"] == "response")
    assert set(responses) == {digest(payload(r)) for r in rows}  # a repeated row of the largest id is a response too
    for r in found:
        if r["record_type"] == "revisit":
            assert r["refers_to"] == by_digest[r["payload_digest"]]
        else:
            assert r["refers_to"] is None and r["page_id"] == by_digest.get(r["payload_digest"])


def test_a_text_beyond_a_chunk(spark, tmp_path):
    """One text of 5 MB beside small ones, through the operators that read texts in chunks."""
    r = random.Random(11)
    word = [f"w{i}" for i in range(5000)]
    passage = " ".join(r.choice(word) for _ in range(60))
    long = " ".join(r.choice(word) for _ in range(900_000)) + " " + passage
    docs = [(1, passage + " first"), (2, long), (3, "short"), (4, passage)]
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs], "lang": ["en"] * 4, "source": ["s"] * 4, "n_chars": pa.array([len(t) for _, t in docs], pa.int64())}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([9], pa.int64()), "text": [" ".join(passage.split()[5:30])]}), f"{tmp_path}/benchmark.parquet")
    run = lambda name: {x["doc_id"]: x for x in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    found = run("op3_substring_dedup")
    assert (found[2]["n_words"], found[2]["n_removed"], found[4]["n_removed"], found[1]["n_removed"]) == (900_060, 60, 60, 0)
    found = run("op2_suffix_dedup")
    assert found[2]["n_bytes"] == len(long) and found[2]["n_removed"] >= len(passage) and found[4]["n_removed"] == len(passage)
    found = run("op1_decontaminate")
    assert found[2]["n_hit"] >= 25 and not found[2]["contaminated"] and found[4]["contaminated"]
    assert run("op11_importance_resampling")[2]["n_features"] == 2 * 900_060 - 1


def test_texts_whose_digests_collide_get_others(spark, monkeypatch):
    """The first seed tells only lengths apart: the next is taken."""
    docs = spark.createDataFrame([("ab",), ("cd",), ("ab",), ("",)], "text string")
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(F.length(c[0])) if len(c) == 1 else real(*c))
    found = docs.select("text", texts.text_key(docs, F.col("text")).alias("key")).collect()
    assert len({r["key"] for r in found}) == 3 == len({(r["text"], r["key"]) for r in found})
    assert decontaminate.contamination is not None
