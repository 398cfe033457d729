"""What near_dedup stores and joins."""

import re

from gearfinch.llm import near_dedup

from .test_operators import edited, prose


def test_only_grouped_texts_are_kept_and_no_member_is_joined_by_its_hub(spark, monkeypatch):
    """Texts and histograms are stored of nodes that share a key, once; members learn their hub's class by their group."""
    seen, plain = {}, near_dedup.stored

    def stored(df, name):
        seen.setdefault(name, []).append((df._jdf.queryExecution().optimizedPlan().toString(), out := plain(df, name)))
        return out

    monkeypatch.setattr(near_dedup, "stored", stored)
    base = prose(200)
    texts = [edited(base, 30 + i) for i in range(8)] + [prose(100) for _ in range(20)] + [base] * 5 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert {found[i] for i in (*range(8), *range(28, 33))} == {0} and all(found[i] == i for i in range(8, 28)) and found[33] == found[34] == 33
    kept = {r["text"] for r in seen["near-nodes"][0][1].select("text").collect()}
    assert len(seen["near-nodes"]) == 1 and kept == {*texts[:8], base} and seen["near-nodes"][0][1].count() == 9
    assert not re.search(r"Join \w+, \(hub#", seen["near-failed"][0][0])
