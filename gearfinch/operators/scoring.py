"""Scores of catalogue rows for text queries, structural evidence and score fusion.

A pair is a query with its constraint struct `c` next to a catalogue row with its text `row_text`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .vectors import clamp, rounded

CAT_TEXT = ("code", "part_id", "identifying_features", "confusing_note", "usage_side", "view_mode")
SIDES_OF_ROWS = {"left": "trai|left|lhf", "right": "phai|right|rhf", "both": "ca hai|hai ben|both"}
FIRST_FEATURES = ("identifying_features", "confusing_note", "code", "part_id")


#: Bytes of rows, written as JSON, up to which a side of a join is sent to every task.
BROADCAST_BYTES = 8 << 20


def checked_broadcast(side: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The side of a join, to be broadcast if it is small; else Spark picks a join by its own sizes."""
    size = side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(side) if size <= most else side


def with_row_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_text", T.row_text(True, T.norm_v5, *CAT_TEXT)).withColumn("row_holes", T.hole_count(F.col("row_text")))


def with_constraints(queries: DataFrame, message: str = "message") -> DataFrame:
    return queries.withColumn("c", T.constraints_v5(F.col(message)))


#: What is told of a row once, before it meets queries: the names whose patterns stand in its text.
FACTS = {"row_shapes": T.SHAPES, "row_sides": SIDES_OF_ROWS, "row_colors": T.COLORS}


def with_row_facts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.array_compact(F.array(*(F.when(F.col("row_text").rlike(T.bounded(p)), F.lit(name)) for name, p in patterns.items()))) for c, patterns in FACTS.items()})


def paired(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row beside every query of a stated set.  Rows are dealt anew first: pairs cost far more than the rows' bytes
    tell, and few files would be few tasks."""
    return rows.repartition("id").crossJoin(checked_broadcast(queries))


def _stands(name: Column, patterns: dict[str, str], text: Column, facts: Column | None = None) -> Column:
    """Whether the pattern that `name` stands for is in text; null if there is no name."""
    if facts is not None:
        return F.when(name.isNotNull(), F.array_contains(facts, name))
    return F.coalesce(*(F.when(name == k, text.rlike(T.bounded(p))) for k, p in patterns.items()))


def evidence(pairs: DataFrame) -> DataFrame:
    """Adds evidence and conflicts (arrays of tags), and the matched terms.  Facts of rows are used where there."""
    c, text = F.col("c"), F.col("row_text")
    told = [F.col(f) if f in pairs.columns else None for f in FACTS]
    holes = F.when(c["hole_count"].isNotNull() & F.col("row_holes").isNotNull(), F.col("row_holes") == c["hole_count"])
    facts = [
        (holes, F.concat(F.lit("hole_count:"), F.col("row_holes").cast("string"))),
        (_stands(c["shape"], T.SHAPES, text, told[0]), F.concat(F.lit("shape:"), c["shape"])),
        (_stands(c["side"], SIDES_OF_ROWS, text, told[1]), F.concat(F.lit("side:"), c["side"])),
        (_stands(c["color"], T.COLORS, text, told[2]), F.concat(F.lit("color:"), c["color"])),
    ]
    matched = F.filter(c["terms"], lambda t: F.contains(text, t))
    return pairs.withColumns(
        {
            "term_matches": matched,
            "evidence": F.concat(F.array_compact(F.array(*(F.when(ok, tag) for ok, tag in facts))), F.transform(matched, lambda t: F.concat(F.lit("term:"), t))),
            "conflicts": F.array_compact(F.array(*(F.when(~ok, tag) for ok, tag in facts))),
            "ok": F.struct(*(ok.alias(n) for (ok, _), n in zip(facts, ("hole", "shape", "side", "color"), strict=True))),
        }
    )


def metadata_available() -> Column:
    c = F.col("c")
    return c["hole_count"].isNotNull() | c["shape"].isNotNull() | c["side"].isNotNull() | c["color"].isNotNull() | (F.size(c["terms"]) > 0)


def metadata_score() -> Column:
    """In [0, 1], null if the query has no metadata evidence.  Needs `evidence` first."""
    score = F.lit(0.0)
    for name, plus, minus in (("hole", 0.55, 0.75), ("shape", 0.50, 0.60), ("side", 0.30, 0.40), ("color", 0.25, 0.25)):
        score = score + F.when(F.col(f"ok.{name}"), plus).when(~F.col(f"ok.{name}"), -minus).otherwise(0.0)
    n = F.size(F.col("c")["terms"])
    score = score + F.when(n > 0, 0.35 * (F.size("term_matches") / n)).otherwise(0.0)
    return F.when(metadata_available(), rounded(clamp(score)))


def scored_metadata(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every query of a stated set against all rows.  queries: query_id, message; rows: the catalogue."""
    pairs = paired(with_row_facts(with_row_text(rows)), with_constraints(queries))
    return evidence(pairs).drop(*FACTS).withColumn("metadata_score", metadata_score()).withColumn("metadata_available", metadata_available())


def ranked(scored: DataFrame, score: str, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(score, F.lit(0.0))), "ordinal")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def is_strict() -> Column:
    """No conflict, and hole and shape seen if asked for; only for queries with a strong constraint."""
    c = F.col("c")
    strong = c["hole_count"].isNotNull() | c["shape"].isNotNull() | c["side"].isNotNull() | c["color"].isNotNull()
    return strong & (F.size("conflicts") == 0) & (c["hole_count"].isNull() | F.coalesce(F.col("ok.hole"), F.lit(False))) & (c["shape"].isNull() | F.coalesce(F.col("ok.shape"), F.lit(False)))


def strong_text_result(scored: DataFrame, most: int = 20, enough: int = 5, floor: float = 0.45) -> DataFrame:
    """Strict rows if any, else rows of the floor or more if any, else all, at most `most` by score; with the number of
    rows of that kind, source and sufficient."""
    flagged = scored.withColumn("strict", is_strict()).withColumn("strong", F.coalesce(F.col("metadata_score") >= floor, F.lit(False)))
    per = flagged.groupBy("query_id").agg(F.count_if("strict").alias("n_strict"), F.count_if("strong").alias("n_strong"))
    joined = flagged.join(per, "query_id")
    kept = joined.where(F.when(F.col("n_strict") > 0, F.col("strict")).when(F.col("n_strong") > 0, F.col("strong")).otherwise(True))
    kept = kept.withColumn("source", F.when(F.col("n_strict") > 0, "strict_constraints").otherwise("metadata_rank"))
    kept = kept.withColumn("sufficient", F.when(F.col("n_strict") > 0, F.col("n_strict") <= enough).otherwise(F.col("n_strong").between(1, enough)))
    return ranked(kept, "metadata_score", most)


def structural(pairs: DataFrame, message: str = "message") -> DataFrame:
    """structural_score: 1, 0 or null where hole counts can't be compared."""
    asked = T.loose_hole_count(F.col(message))
    there = T.loose_hole_count(F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in FIRST_FEATURES)))
    both = pairs.withColumns({"requested_holes": asked, "candidate_holes": there})
    known = F.col("requested_holes").isNotNull() & F.col("candidate_holes").isNotNull()
    return both.withColumn("structural_score", F.when(known, (F.col("requested_holes") == F.col("candidate_holes")).cast("double")))


def structural_totals(scored: DataFrame) -> DataFrame:
    """Per query: number of candidates, how many of them differ in hole counts, and whether any does."""
    per = scored.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("structural_score") == 0).alias("conflicts"))
    return per.withColumn("hole_conflict", F.col("conflicts") > 0)


def fused_score(vector: Column, consensus: Column, metadata: Column, metadata_on: Column, structure: Column, n_conflicts: Column) -> Column:
    """The weighted mean of the signals that are there, less a penalty for conflicts."""
    signals = [(vector, 0.78, F.lit(True)), (consensus, 0.08, F.lit(True)), (metadata, 0.10, metadata_on), (structure, 0.12, F.lit(True))]
    total, weight = F.lit(0.0), F.lit(0.0)
    for score, w, on in signals:
        there = on & score.isNotNull() & ~F.isnan(score)
        total, weight = total + F.when(there, clamp(score) * w).otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    return clamp(total / F.when(weight == 0, 1.0).otherwise(weight) - F.least(F.lit(0.24), 0.08 * n_conflicts))


#: Weights of the fixed profile, without and with a masked vector: vector, masked, metadata, structural.
FIXED, FIXED_MASKED = (0.75, 0.0, 0.15, 0.10), (0.65, 0.10, 0.15, 0.10)


def fixed_score(vector: Column, masked: Column, metadata: Column, structure: Column, has_masked: Column) -> Column:
    """The fixed profile: a plain weighted sum in which an absent signal counts as 0."""
    total = lambda weights: sum((clamp(s) * w for s, w in zip((vector, masked, metadata, structure), weights, strict=True)), F.lit(0.0))
    return clamp(F.when(F.coalesce(has_masked, F.lit(False)), total(FIXED_MASKED)).otherwise(total(FIXED)))
