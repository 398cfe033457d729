"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share 1.5 times all words; a target stops
at twice its source's words and the excess is shared again (water filling, by running sums over the sources, one row
for each source).  Documents are cut into blocks of BLOCK words.  A source whose target is r times its words gives all
its blocks floor(r) times and an exact quota of round((r - floor(r)) * blocks) more.  Blocks are dealt to 2**depth
output shards by hash; a tree splits each quota among the shards, every node drawing its left share from the exact
hypergeometric law (counts of a uniform draw without replacement), so no source is ever gathered in one task.  Each
shard then takes its quota from its own blocks in a permuted order, and plays its blocks in another.

All draws are hashes of fixed keys and the seed: reruns agree.  Null text has no words; null source is a source, null
ids are kept; repeated rows are separate documents.  An empty table gives no rows.  A text of
any length is cut to blocks by its number of words; its bytes are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .texts import stored, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK = 64
#: Blocks of the largest source in a shard, about; and the depth of the tree at least and at most.
SHARD_BLOCKS, DEPTHS = 4096, (2, 14)
SEED = 20_240_607


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size and a key of each row: two digests, and a number among equal rows."""
    text = F.col(text_col).cast("string")
    row = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h"))
    all_ = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ("doc_id", "source", "size", "h")))
    row = row.select("doc_id", "source", "size", F.xxhash64(all_).alias("k1"), F.xxhash64(F.lit(1), all_).alias("k2"))
    return row.withColumn("k3", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("size")))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_blocks, target.  sizes: rows of source, size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / BLOCK)).alias("n_blocks"))
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumns({"cap": MOST * F.col("source_size"), "all": SHARE * F.sum("source_size").over(every)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("full", F.col("level") * F.col("weight") > F.col("cap"))
    per = per.withColumn("level", F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))).over(every))
    return per.select("source", "source_size", "n_blocks", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series eight steps up, to about 1e-12."""
    x = n + 8.0
    down = n + 1.0
    for i in range(2, 8):
        down = down * (n + float(i))
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - F.log(down)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(left: Column, right: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items, taken without replacement, come from the left: the quantile u of the exact law,
    summed over ten standard deviations to both sides."""

    def bounds(s: Column) -> Column:
        a, b, q = s["a"], s["b"], s["q"]
        n = a + b
        mean = F.when(n > 0, q * a / n).otherwise(0.0)
        spread = let(mean, lambda m: 10 * F.sqrt(F.when(n > 1, m * b / n * (n - q) / (n - 1)).otherwise(0.0)) + 2)
        return let(F.struct(mean.alias("mean"), spread.alias("spread")), lambda m: F.struct(s["u"].alias("u"), a.alias("a"), b.alias("b"), q.alias("q"), F.greatest(F.lit(0.0), q - b, F.floor(m["mean"] - m["spread"]).cast("double")).alias("low"), F.least(q, a, F.ceil(m["mean"] + m["spread"]).cast("double")).alias("high")))

    def walk(s: Column) -> Column:
        a, b, q, k0 = s["a"], s["b"], s["q"], s["low"]
        logs = F.transform(F.array(a, b, q, a + b - q, a + b, k0, a - k0, q - k0, b - q + k0), log_factorial)
        first = let(logs, lambda x: F.exp(x[0] + x[1] + x[2] + x[3] - x[4] - x[5] - x[6] - x[7] - x[8]))

        def step(t: Column, k: Column) -> Column:
            x, total = k.cast("double"), t["total"] + t["p"]
            return F.struct((t["p"] * (a - x) * (q - x) / ((x + 1) * (b - q + x + 1))).alias("p"), total.alias("total"), F.when(total < s["u"], x + 1).otherwise(t["at"]).alias("at"))

        start = F.struct(first.alias("p"), F.lit(0.0).alias("total"), k0.alias("at"))
        return F.least(F.aggregate(F.sequence(k0.cast("long"), s["high"].cast("long")), start, step)["at"], s["high"])

    given = F.struct(left.cast("double").alias("a"), right.cast("double").alias("b"), drawn.cast("double").alias("q"), u.alias("u"))
    return let(let(given, bounds), lambda s: F.when(s["high"] <= s["low"], s["low"]).otherwise(walk(s))).cast("long")


def _left_share(depth: int, level: int):
    """The left share of node i of a level, from the sums of the leaves below its two children."""
    width = 1 << (depth - level - 1)
    name, leaves, quotas = F.coalesce(F.col("source"), F.lit("\u0000")), F.col("leaves"), F.col("quotas")

    def below(child: Column) -> Column:
        return F.aggregate(F.slice(leaves, child * width + 1, F.lit(width)), F.lit(0).cast("long"), lambda a, x: a + x)

    return lambda i: hypergeometric(below(2 * i), below(2 * i + 1), quotas[i], uniform(F.lit("node"), name, F.lit(level), i))


def _both_shares(left: Column, i: Column) -> Column:
    return F.array(left, F.col("quotas")[i] - left)


def split_quotas(counts: DataFrame, depth: int) -> DataFrame:
    """source, quotas: the shard quotas of each source.  counts: source, quota, leaves (blocks in each shard).

    One small stored table for each level: nested in one plan, the levels would multiply each other's expressions."""
    tree = counts.select("source", "leaves", F.array("quota").alias("quotas"))
    for level in range(depth):
        nodes = F.sequence(F.lit(0), F.lit((1 << level) - 1))
        tree = stored(tree.withColumn("left", F.transform(nodes, _left_share(depth, level))), "mix-level")
        tree = tree.select("source", "leaves", F.flatten(F.transform("left", _both_shares)).alias("quotas"))
    return tree.select("source", "quotas")


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized rows; the targets with `times` (whole passes) and `quota` (blocks more); and the blocks drawn by
    quota: shard, place (in the shard's order), row key, block, words."""
    rows = stored(sized(docs, id_col, text_col, source_col), "mix-sizes")
    goal = targets(rows)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = stored(goal.withColumn("times", F.floor(ratio)).withColumn("quota", F.round((ratio - F.floor(ratio)) * F.col("n_blocks")).cast("long")), "mix-targets")
    largest = goal.agg(F.max("n_blocks")).first()[0] or 0
    depth = min(max(DEPTHS[0], (max(0, largest - 1) // SHARD_BLOCKS).bit_length()), DEPTHS[1])
    blocks = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / BLOCK).cast("int"))))
    blocks = blocks.select("source", "k1", "k2", "k3", "block", F.least(F.lit(BLOCK), F.col("size") - BLOCK * F.col("block")).alias("words"), F.pmod(F.xxhash64(F.lit(SEED), "k1", "k2", "k3", "block"), F.lit(1 << depth)).cast("int").alias("shard"))
    here = goal.where("n_blocks > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit((1 << depth) - 1))))
    found = blocks.groupBy("source", "shard").agg(F.count("*").alias("n"))
    same = lambda a, b, *on: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in on))
    leaves = here.alias("a").join(found.alias("b"), same("a", "b", "source", "shard"), "left").select("a.source", "a.quota", "a.shard", F.coalesce("n", F.lit(0)).alias("n"))
    leaves = leaves.groupBy("source", "quota").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "n"))), lambda x: x["n"]).alias("leaves"))
    quotas = stored(split_quotas(leaves, depth).select("source", F.posexplode("quotas").alias("shard", "quota")), "mix-quotas")
    drawn = blocks.alias("a").join(quotas.alias("b"), same("a", "b", "source", "shard")).where("quota > 0").select("a.*", "quota")
    order = F.xxhash64(F.lit("draw"), F.lit(SEED), "k1", "k2", "k3", "block")
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("source", "shard").orderBy(order, "k1", "k2", "k3", "block"))).where("at <= quota")
    return rows, goal, drawn.drop("at", "quota")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every block taken, with its shard and its place in the shard's shuffled order."""
    rows, goal, drawn = planned(docs, id_col, text_col, source_col)
    whole = rows.alias("a").join(goal.alias("b"), F.expr("a.source <=> b.source")).where("times > 0 AND size > 0").select("a.*", "times")
    whole = whole.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / BLOCK).cast("int"))))
    n = (goal.agg(F.max("n_blocks")).first()[0] or 0)
    depth = min(max(DEPTHS[0], (max(0, n - 1) // SHARD_BLOCKS).bit_length()), DEPTHS[1])
    whole = whole.select("source", "k1", "k2", "k3", "block", F.least(F.lit(BLOCK), F.col("size") - BLOCK * F.col("block")).alias("words"), F.pmod(F.xxhash64(F.lit(SEED), "k1", "k2", "k3", "block"), F.lit(1 << depth)).cast("int").alias("shard"), "pass")
    taken = whole.unionByName(drawn.withColumn("pass", F.lit(0)))
    ids = rows.select("k1", "k2", "k3", "doc_id")
    play = F.xxhash64(F.lit("play"), F.lit(SEED), "k1", "k2", "k3", "block", "pass")
    return taken.join(ids, ["k1", "k2", "k3"]).select("shard", F.row_number().over(Window.partitionBy("shard").orderBy(play, "k1", "k2", "k3", "block", "pass")).alias("place"), "doc_id", "source", "block", "words", "pass")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target and taken for each row of docs."""
    rows, goal, drawn = planned(docs, id_col, text_col, source_col)
    more = drawn.groupBy("k1", "k2", "k3").agg(F.sum("words").alias("more"))
    joined = rows.join(more, ["k1", "k2", "k3"], "left").alias("a").join(goal.alias("b"), F.expr("a.source <=> b.source"))
    return joined.select("doc_id", "size", "a.source", "source_size", "target", (F.col("times") * F.col("size") + F.coalesce("more", F.lit(0))).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
