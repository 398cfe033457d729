"""Answers of models against their schemas: parsed as VARIANT, each violation with its own name and place.

A schema is made of OBJECT, LIST and the leaves TEXT, FLAG, COUNT, SHARE and CHOICE below.  Objects have no other
properties than those named, and all of those.  A whole number with a decimal point (3.0) is a whole number, as in JSON
Schema.  Paths of list elements do not say which element.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    kind: str  # text, flag, whole or number
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Items:
    of: Leaf | Fields
    most: int | None = None


@dataclass(frozen=True)
class Fields:
    of: tuple[tuple[str, Leaf | Items], ...]


TEXT, FLAG, SHARE = Leaf("text"), Leaf("flag"), Leaf("number", 0, 1)
COUNT = Leaf("whole", -1, 100)


def choice(*names: str) -> Leaf:
    return Leaf("text", choices=names)


# ---- fixed values: what the models are asked for ------------------------------------------------------------------
TEXTS = Items(TEXT)
RANKING = Fields(
    (
        ("ambiguous", FLAG),
        ("summary", TEXT),
        ("warnings", TEXTS),
        ("rankings", Items(Fields((("candidate_id", TEXT), ("score", SHARE), ("matched", TEXTS), ("conflicts", TEXTS), ("unknown", TEXTS), ("reason", TEXT))), 10)),
    )
)
JUDGEMENT = Fields(
    (
        ("decision", choice("accept", "ambiguous", "abstain")),
        ("summary", TEXT),
        ("warnings", TEXTS),
        ("top5", Items(Fields((("candidate_id", TEXT), ("score", SHARE), ("reason", TEXT))), 5)),
    )
)
SIGNATURE = Fields(
    (
        ("object_family", TEXT),
        ("dominant_colors", Items(TEXT, 5)),
        ("hole_count", COUNT),
        ("hole_layout", Items(TEXT, 10)),
        ("slot_count", COUNT),
        ("notch_count", COUNT),
        ("has_flange", choice("yes", "no", "unknown")),
        ("has_rim", choice("yes", "no", "unknown")),
        ("has_hook_or_clip", choice("yes", "no", "unknown")),
        ("material_appearance", Items(TEXT, 6)),
        ("silhouette", Items(TEXT, 10)),
        ("mounting_features", Items(TEXT, 12)),
        ("distinctive_features", Items(TEXT, 14)),
        ("symmetry", choice("symmetric", "asymmetric", "unknown")),
        ("orientation_cues", Items(TEXT, 10)),
        ("confidence", SHARE),
        ("uncertainties", Items(TEXT, 10)),
    )
)
# -----------------------------------------------------------------------------------------------------------------

_NONE = "array<string>"


def _one(broken: Column, path: str, issue: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(True)), F.array(F.lit(f"{path}:{issue}"))).otherwise(F.array().cast(_NONE))


def _issues(v: Column, schema: Leaf | Items | Fields, path: str) -> Column:
    """What is wrong with a value that is there: an array of path:issue."""
    kind = F.schema_of_variant(v)
    if isinstance(schema, Fields):
        own = F.try_variant_get(v, "$", "map<string,variant>")
        names = [name for name, _ in schema.of]
        unknown = F.transform(F.array_sort(F.filter(F.map_keys(own), lambda k: ~k.isin(*names))), lambda k: F.concat(F.lit(f"{path}."), k, F.lit(":unknown_property")))
        parts = [unknown]
        for name, of in schema.of:
            value = own[name]
            parts.append(F.when(value.isNull(), F.array(F.lit(f"{path}.{name}:required"))).otherwise(_issues(value, of, f"{path}.{name}")))
        return F.when(~kind.startswith("OBJECT"), F.array(F.lit(f"{path}:type"))).otherwise(F.concat(*parts))
    if isinstance(schema, Items):
        own = F.try_variant_get(v, "$", "array<variant>")
        each = F.flatten(F.transform(own, lambda x: _issues(x, schema.of, f"{path}[]")))
        long = _one(F.size(own) > schema.most, path, "too_many") if schema.most is not None else F.array().cast(_NONE)
        return F.when(~kind.startswith("ARRAY"), F.array(F.lit(f"{path}:type"))).otherwise(F.concat(long, F.array_distinct(each)))
    if schema.kind == "text":
        text = F.try_variant_get(v, "$", "string")
        wrong = _one(~text.isin(*schema.choices), path, "enum") if schema.choices else F.array().cast(_NONE)
        return F.when(kind != "STRING", F.array(F.lit(f"{path}:type"))).otherwise(wrong)
    if schema.kind == "flag":
        return _one(kind != "BOOLEAN", path, "type")
    number = F.try_variant_get(v, "$", "double")
    numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if schema.kind == "whole":
        numeric = numeric & (number == F.floor(number))
    inside = number.between(schema.least, schema.most) if schema.least is not None else F.lit(True)
    return F.when(~numeric, F.array(F.lit(f"{path}:type"))).otherwise(_one(~inside, path, "range"))


def json_text(answer: Column) -> Column:
    """The JSON of an answer: without a code fence; if that is no JSON, from the first brace to the last."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"(?i)\s*```$", ""))
    cut = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(cut)


def checked(answers: DataFrame, schema: Fields, column: str = "answer") -> DataFrame:
    """answers with value (VARIANT, null if it is no JSON), issues and status: ok, invalid_json, or the kind of the first
    issue (type, unknown_property, required, enum, range, too_many)."""
    read = answers.withColumn("value", F.try_parse_json(json_text(F.col(column))))
    read = read.withColumn("issues", F.when(F.col("value").isNotNull(), _issues(F.col("value"), schema, "$")))
    status = F.when(F.col("value").isNull(), "invalid_json").when(F.size("issues") == 0, "ok").otherwise(F.substring_index(F.col("issues")[0], ":", -1))
    return read.withColumn("status", status)
