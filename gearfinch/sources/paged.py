"""The catalogue as a paged source: a Python data source over stored rows, read page by page, with pushed filters.

Partitions are ranges of the ordinal; each is read in pages of PAGE rows, the next one from the last ordinal on, until a
page comes short.  Rows that share the last ordinal of a page are in it, so that the next one misses none.  Pages of a
partition are cut from one sweep over the row groups, in the order of their first ordinals, so each group is read once for a
partition; rows wait in memory until no later group can hold an earlier one.  `stored_rows` writes them in order, in groups
of GROUP rows; of rows in any other order a partition may hold all.  Equality on usage_side and view_mode and `contains` on search_text (all searched fields, lower case)
go into each page's request where spark.sql.python.filterPushdown.enabled is on; else Spark filters what comes.
Options: path (a Parquet folder of rows that driver and executors see), partitions (8 by default).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringContains

PAGE, PARTITIONS, GROUP = 100, 8, 65_536
SEARCHED = ("code", "part_id", "identifying_features", "usage_side", "view_mode")
SCHEMA = "id string, ordinal long, code string, part_id string, identifying_features string, confusing_note string, usage_side string, view_mode string, search_text string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_LAYOUT = pa.schema([(c, pa.int64() if c == "ordinal" else pa.string()) for c in _NAMES])


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CatalogueReader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts, self.equal, self.needles = path, parts, {}, []
        self._next, self._sweep, self._ready = None, None, None

    def _rows(self) -> ds.Dataset:
        system, path = pyarrow.fs.FileSystem.from_uri(self.path)
        return ds.dataset(path, format="parquet", filesystem=system)

    def _groups(self) -> list[tuple[int, int, ds.Fragment]]:
        """First and last ordinal of each row group, and the group, in order; groups without ordinals are left out."""
        found = []
        for fragment in self._rows().get_fragments():
            for group in fragment.split_by_row_group():
                told = (group.row_groups[0].statistics or {}).get("ordinal")
                low, high = (told["min"], told["max"]) if told else (x.as_py() for x in pc.min_max(group.to_table(columns=["ordinal"]).column(0)).values())
                if low is not None:
                    found.append((low, high, group))
        return sorted(found, key=lambda g: g[:2])

    def partitions(self) -> list[InputPartition]:
        groups = self._groups() if self.parts > 1 else []
        if not groups:
            return [Range(-(1 << 63), (1 << 63) - 1)]
        low, high = groups[0][0], max(g[1] for g in groups) + 1
        step = max(1, -(-(high - low) // self.parts))
        return [Range(a, min(a + step, high) - 1) for a in range(low, high, step)]

    def _in_order(self, after: int, last: int) -> Iterator[pa.Table]:
        """All rows behind an ordinal that meet the pushed filters, by ordinal; equal ordinals come in one table."""
        wanted = (ds.field("ordinal") > after) & (ds.field("ordinal") <= last)
        for c, v in self.equal.items():
            wanted &= ds.field(c) == v
        for needle in self.needles:
            wanted &= pc.match_substring(ds.field("search_text"), needle)
        groups = [g for g in self._groups() if g[1] > after and g[0] <= last]
        kept = None
        for i, (_, _, group) in enumerate(groups, 1):
            own = group.to_table(columns=_NAMES, filter=wanted).cast(_LAYOUT)
            kept = own if kept is None else pa.concat_tables([kept, own])
            if i < len(groups):
                done = pc.less(kept.column("ordinal"), groups[i][0])
                if 2 * (pc.sum(done).as_py() or 0) < kept.num_rows:
                    continue  # what waits is copied only behind as many rows that leave
                yield kept.filter(done).sort_by("ordinal")
                kept = kept.filter(pc.invert(done))
        if kept is not None:
            yield kept.sort_by("ordinal")

    def page(self, after: int, last: int) -> pa.Table:
        """The next rows behind an ordinal that meet the pushed filters: PAGE at most, and those that share the last one's."""
        if self._next != (after, last):
            self._sweep, self._ready = self._in_order(after, last), _LAYOUT.empty_table()
        while self._ready.num_rows < PAGE and (more := next(self._sweep, None)) is not None:
            self._ready = pa.concat_tables([self._ready, more]).combine_chunks()
        n, ordinals = min(PAGE, self._ready.num_rows), self._ready.column("ordinal")
        while 0 < n < len(ordinals) and ordinals[n] == ordinals[n - 1]:
            n += 1
        found, self._ready = self._ready.slice(0, n), self._ready.slice(n)
        self._next = (ordinals[n - 1].as_py(), last) if n else None
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        after = max(partition.first - 1, -(1 << 63))
        while True:
            found = self.page(after, partition.last)
            yield from found.combine_chunks().to_batches()
            if found.num_rows < PAGE:
                return
            after = found.column("ordinal")[-1].as_py()


class FilteredReader(CatalogueReader):
    """With the filters in its requests; Spark takes no such reader while pushdown is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("usage_side",), ("view_mode",)) and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            elif isinstance(f, StringContains) and f.attribute == ("search_text",):
                self.needles.append(f.value)
            else:
                yield f  # Spark's to apply


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogueReader:
        kind = FilteredReader if self.options.get("pushdown") == "true" else CatalogueReader
        return kind(self.options["path"], int(self.options.get("partitions", PARTITIONS)))


def stored_rows(rows: DataFrame, path: str) -> str:
    """Write catalogue rows for the source, in order; returns the path."""
    text = F.lower(F.concat_ws("\u0001", *(F.coalesce(c, F.lit("")) for c in SEARCHED)))
    rows.withColumn("search_text", text).select(*_NAMES).orderBy("ordinal").write.option("maxRecordsPerFile", GROUP).parquet(path)
    return path


def paged(spark: SparkSession, path: str, partitions: int = PARTITIONS) -> DataFrame:
    spark.dataSource.register(CatalogueSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("catalogue_pages").option("path", path).option("partitions", partitions).option("pushdown", pushdown).load()


def search(rows: DataFrame, text: str = "", side: str = "all", view: str = "all", cap: int | None = None) -> DataFrame:
    """Rows of the source with the text in a searched field, on a side and in a view; the first `cap` by ordinal."""
    rows = rows.where(F.contains("search_text", F.lit(text.lower()))) if text else rows
    rows = rows if side == "all" else rows.where(F.col("usage_side") == side)
    rows = rows if view == "all" else rows.where(F.col("view_mode") == view)
    return rows if cap is None else rows.orderBy("ordinal").limit(cap)
