"""Pools where scores lie half way between two values of six digits."""

import numpy as np

from gearfinch.operators import retrieval as R
from gearfinch.operators import vectors as V
from gearfinch.plans import catalogue_queries as C
from gearfinch.plans import duck as D
from gearfinch.sources import fixtures as X

from .conftest import same


def test_halves_are_rounded_as_in_sql(spark, small, tmp_path, monkeypatch):
    draw = np.random.default_rng(4)
    messages = ("", "round 4 holes", "red widget", "left oval")
    probes = [(f"q{i}", messages[i % 4], p, [0.0]) for i in range(120) for p in (1, 2)]
    hits = []
    for i in range(120):
        for p in (1, 2):
            scores = sorted(draw.integers(22_000, 40_000, 5) * 25 / 1e6, reverse=True)
            hits += [(f"q{i}", p, 3 * r, str(r), "front", float(s), n) for n, (s, r) in enumerate(zip(scores, draw.permutation(8)[:5].tolist(), strict=True), 1)]
    hits = spark.createDataFrame(hits, "query_id string, probe_id int, id long, record_id string, asset_type string, similarity double, rank int")
    probes = spark.createDataFrame(probes, "query_id string, message string, probe_id int, embedding array<double>")
    hits.write.parquet(f"{tmp_path}/hits")
    probes.write.parquet(f"{tmp_path}/probes")
    monkeypatch.setattr(V, "top_hits", lambda *_: hits)
    monkeypatch.setattr(C, "_hybrid", lambda spark, sf_dir: R.hybrid(probes, probes, X.catalogue(spark, sf_dir), X.PROFILE))
    given = f"hits AS (SELECT * FROM '{tmp_path}/hits/*.parquet'), probes AS (SELECT *, '' truth FROM '{tmp_path}/probes/*.parquet')"
    for name in ("k2_candidate_pool", "hybrid_search"):
        sql = C.ORACLE[name].replace(D.HITS, given)
        assert sql != C.ORACLE[name]
        same(C.QUERIES[name](spark, small), sql, small)
