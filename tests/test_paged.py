"""The paged source against the table."""

import pytest
from pyspark.sql import functions as F

from gearfinch.sources import fixtures as X
from gearfinch.sources import paged as P


@pytest.fixture(scope="module")
def source(spark, small, tmp_path_factory):
    rows = X.catalogue(spark, small)
    return rows, P.stored_rows(rows, f"file://{tmp_path_factory.mktemp('pages')}/rows")


@pytest.mark.parametrize("partitions", [1, 3, 500])
def test_rows_equal_the_table(spark, source, partitions, monkeypatch):
    rows, path = source
    key = lambda df: sorted(tuple(r) for r in df.select("id", "ordinal", "code", "usage_side").collect())
    found = P.paged(spark, path, partitions)
    assert key(found) == key(rows)
    assert key(P.search(found, "HOLES", "left")) == key(rows.where("usage_side = 'left' AND contains(lower(identifying_features), 'holes')"))
    assert [r["ordinal"] for r in P.search(found, cap=5).collect()] == [0, 1, 2, 3, 4]


def test_filters_are_pushed(spark, source, capsys):
    rows, path = source
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = P.search(P.paged(spark, path, 2), "gear", "left", "single_face")
        found.explain()
        plan = capsys.readouterr().out  # the source has taken the filters over: Spark applies none of them again
        assert "= left" not in plan and "= single_face" not in plan and "Contains(" not in plan
        expected = rows.where("usage_side = 'left' AND view_mode = 'single_face' AND contains(lower(identifying_features), 'gear')")
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in expected.collect())
        P.search(P.paged(spark, path, 2), "gear").where("ordinal % 2 = 0").explain()
        assert "% 2" in capsys.readouterr().out  # what it can't take is Spark's
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    P.search(P.paged(spark, path, 2), "gear", "left").explain()
    plan = capsys.readouterr().out
    assert "= left" in plan and "Contains(" in plan


def test_pages_end_short():
    class Pages(P.CatalogueReader):
        asked = []

        def page(self, after, last):
            import pyarrow as pa

            Pages.asked.append(after)
            at = [x for x in range(250) if after < x <= last][: P.PAGE]
            return pa.table({"ordinal": pa.array(at, pa.int64())})

    batches = list(Pages("", 1).read(P.Range(0, 249)))
    assert sum(b.num_rows for b in batches) == 250 and Pages.asked == [-1, 99, 199]
    assert F is not None


@pytest.mark.parametrize("ordered", [True, False])
def test_each_group_is_read_once(spark, tmp_path, monkeypatch, ordered):
    """Pages come from one sweep, and rows that share an ordinal across the end of a page are all found."""
    rows = X.catalogue(spark, "/root/testdata/sf0.01").withColumn("ordinal", F.when(F.col("ordinal").between(95, 260), 95).otherwise(F.col("ordinal")))
    path = f"file://{tmp_path}/rows"
    if ordered:
        monkeypatch.setattr(P, "GROUP", 300)
        P.stored_rows(rows, path)
    else:
        rows.withColumn("search_text", F.lower("code")).select(*P._NAMES).repartition(7, "id").write.parquet(path)
    reader = P.CatalogueReader(path, 3)
    groups, read = reader._groups(), []

    class Group:
        def __init__(self, group):
            self.group = group

        def to_table(self, **how):
            read.append(self)
            return self.group.to_table(**how)

    wrapped = [(a, b, Group(g)) for a, b, g in groups]
    monkeypatch.setattr(P.CatalogueReader, "_groups", lambda self: wrapped)
    assert len(groups) >= 7
    batches = list(reader.read(P.Range(0, 1999)))
    assert len(read) == len(set(map(id, read))) == len(groups)
    assert [x for b in batches for x in b.column("ordinal").to_pylist()] == sorted(r["ordinal"] for r in rows.select("ordinal").collect())
    found = sorted(r["id"] for r in P.paged(spark, path, 3).select("id").collect())
    assert found == sorted(r["id"] for r in rows.select("id").collect())
