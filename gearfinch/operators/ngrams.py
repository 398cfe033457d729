"""Substring search by an inverted index: `contains` as an equi-join from each needle's rarest gram.

`postings` holds, for every run of one to three characters of a row's texts, the rows that have it, in slices of SLICE
rows, sorted by gram so that a search reads few row groups; `grams` holds how many rows each gram stands in; `rows` holds
the texts.  A needle of one or two characters is a gram itself; of a longer one the rarest of its grams of three is
looked up, and what that proposes is verified on the texts.  A needle with a gram that no row has is found nowhere.  An
empty needle is in every row; it is answered from the rows without the index.  A gram that most rows have is dealt by
slice, so no task gets all its rows.  Null texts are empty; a null needle is no needle and finds nothing.

An index pays where it is kept for many searches.  A query that brings its own needles, a stated set, builds none:
`scanned` goes through the rows, dealt anew to all tasks, and holds each against the needles, up to LISTED of them as a
constant of the plan.  More are looked up by their rarest gram: the rows are read once to count the grams that the needles
ask for, and once more to find and verify.  Needles are sent to every task, and nothing is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import scratch, stored
from .scoring import checked_broadcast

LONGEST, SLICE = 3, 65_536
#: Parts into which the hits of one needle are dealt before the first of them are picked.
DEALT = 32
#: Needles that are held against every row; more are looked up by their grams.
LISTED = 256


def grams(text: Column, n: int) -> Column:
    """All runs of n characters of a text, in order."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def wanted_grams(needles: DataFrame) -> DataFrame:
    """needle, gram: a short needle itself, or all grams of a longer one.  Null and empty needles have none."""
    own = F.when(F.length("needle") < LONGEST, F.array("needle")).otherwise(grams(F.col("needle"), LONGEST))
    return needles.where("needle <> ''").select("needle", F.explode(F.array_distinct(own)).alias("gram"))


def grams_of_all(texts: str, sizes: list[int]) -> Column:
    """The different grams of these sizes in an array of texts."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.concat(*(grams(t, n) for n in sizes)))))


def rarest(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """needle and rare (n, gram) of the needles all of whose grams stand somewhere."""
    each = wanted.join(counts, "gram", "left")
    return each.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare")).where("rare.n > 0")


@dataclass
class NgramIndex:
    """rows: id, ordinal, usage_side, view_mode, texts; postings: gram, slice, id; counts: gram, n."""

    rows: DataFrame
    postings: DataFrame
    counts: DataFrame

    def find(self, needles: DataFrame) -> DataFrame:
        """needle with the columns of rows, for each row that has it in one of its texts.  needles: distinct needles."""
        rare = rarest(wanted_grams(needles), self.counts)
        looked_up = rare.select("needle", "rare.gram", F.explode(F.sequence(F.lit(0), F.floor((F.col("rare.n") - 1) / SLICE).cast("int"))).alias("slice"))
        proposed = self.postings.join(looked_up, ["gram", "slice"]).select("needle", "id")
        return proposed.join(self.rows, "id").where(F.exists("texts", lambda t: F.contains(t, F.col("needle"))))


@dataclass
class NgramScan:
    """rows: id, ordinal, usage_side, view_mode, texts.  Searched as an NgramIndex is, without one."""

    rows: DataFrame

    def find(self, needles: DataFrame) -> DataFrame:
        """As NgramIndex.find."""
        known = [r["needle"] for r in needles.where("needle <> ''").select("needle").distinct().limit(LISTED + 1).collect()]
        proposed = self._each(sorted(known)) if len(known) <= LISTED else self._by_gram(needles)
        return proposed.where(F.exists("texts", lambda t: F.contains(t, F.col("needle"))))

    def _each(self, known: list[str]) -> DataFrame:
        listed = F.array(*map(F.lit, known)).cast("array<string>")
        whole = self.rows.withColumn("whole", F.array_join("texts", "\n")).repartition("id")
        return whole.withColumn("needle", F.explode(F.filter(listed, lambda x: F.contains(F.col("whole"), x)))).drop("whole")

    def _by_gram(self, needles: DataFrame) -> DataFrame:
        wanted, rows = wanted_grams(needles), self.rows.repartition("id")
        sizes = [r["n"] for r in wanted.select(F.length("gram").alias("n")).distinct().orderBy("n").collect()]  # LONGEST at most
        every = F.explode(grams_of_all("texts", sizes)).alias("gram")
        met = rows.select(every).join(checked_broadcast(wanted.select("gram").distinct()), "gram")
        rare = stored(rarest(wanted, met.groupBy("gram").agg(F.count("*").alias("n"))).select("needle", "rare.gram"), "rare-grams")
        return rows.select("*", every).join(checked_broadcast(rare), "gram").drop("gram")


def _searchable(rows: DataFrame, texts: list[Column]) -> DataFrame:
    return rows.select("id", "ordinal", "usage_side", "view_mode", F.array(*(F.coalesce(t, F.lit("")) for t in texts)).alias("texts"))


def scanned(rows: DataFrame, texts: list[Column]) -> NgramScan:
    """The search of rows (id, ordinal, usage_side, view_mode) over `texts` for a stated set of needles."""
    return NgramScan(_searchable(rows, texts))


def built(rows: DataFrame, texts: list[Column], path: str | None = None) -> NgramIndex:
    """The index of rows (id, ordinal, usage_side, view_mode) over `texts`, under `path` or in a new shared folder."""
    spark = rows.sparkSession
    path = path or scratch(spark, "ngrams")
    own = _searchable(rows, texts)
    own.write.parquet(f"{path}/rows")
    own = spark.read.parquet(f"{path}/rows")
    each = own.select(F.explode(grams_of_all("texts", list(range(1, LONGEST + 1)))).alias("gram"), "id")
    each.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/grams")
    counts = spark.read.parquet(f"{path}/grams")
    sliced = each.join(counts, "gram").withColumn("slice", F.pmod(F.xxhash64("id"), F.floor((F.col("n") - 1) / SLICE) + 1).cast("int"))
    sliced.select("gram", "slice", "id").sortWithinPartitions("gram", "slice").write.parquet(f"{path}/postings")
    return NgramIndex(own, spark.read.parquet(f"{path}/postings"), counts)


def fields_of(names: tuple[str, ...]) -> list[Column]:
    return [F.lower(F.col(c)) for c in names]


def _hits(index: NgramIndex | NgramScan, wanted: DataFrame) -> DataFrame:
    """needle, side, view, id and ordinal of all rows that have the needle.  wanted: distinct needle, side and view."""
    found = index.find(wanted.select("needle").distinct()).join(checked_broadcast(wanted.where("needle <> ''")), "needle")
    found = found.where("(side = 'all' OR usage_side = side) AND (view = 'all' OR view_mode = view)")
    # rows under the filters that they meet: an empty needle is an equi-join too
    key = lambda *c: F.concat_ws("\u0001", *c)
    both = [F.when(side.isNotNull() & view.isNotNull(), key(F.lit(""), side, view)) for side in (F.lit("all"), F.col("usage_side")) for view in (F.lit("all"), F.col("view_mode"))]
    open_rows = index.rows.select("id", "ordinal", F.explode(F.array_distinct(F.array_compact(F.array(*both)))).alias("key"))
    # the needle is part of the key, so that filters that are constants still leave an equi-join
    everywhere = open_rows.join(checked_broadcast(wanted.where("needle = ''").withColumn("key", key("needle", "side", "view"))), "key")
    columns = ["needle", "side", "view", "id", "ordinal"]
    return found.select(*columns).unionByName(everywhere.select(*columns))


def counted(index: NgramIndex | NgramScan, asked: DataFrame) -> DataFrame:
    """asked (needle, side, view) with n, how many rows have the needle: all of them, counted where they are found."""
    key = ["needle", "side", "view"]
    return asked.join(_hits(index, asked.select(*key).distinct()).groupBy(*key).agg(F.count("*").alias("n")), key, "left").na.fill(0, ["n"])


def searched(index: NgramIndex | NgramScan, asked: DataFrame, each: int | None = None) -> DataFrame:
    """asked (needle, and side and view, 'all' for any; other columns stay) with id and ordinal of the rows that have the
    needle, and n, their number by ordinal; with `each`, the first so many of each."""
    hits = _hits(index, asked.select("needle", "side", "view").distinct())
    if each is not None:
        # the first of a part, before the parts of a needle meet in one task
        part = Window.partitionBy("needle", "side", "view", "part").orderBy("ordinal", "id")
        dealt = hits.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(DEALT)))
        hits = dealt.withColumn("n", F.row_number().over(part)).where(F.col("n") <= each).drop("n", "part")
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("needle", "side", "view").orderBy("ordinal", "id")))
    hits = hits if each is None else hits.where(F.col("n") <= each)
    return asked.join(hits, ["needle", "side", "view"])
