"""Registered queries of the earlier scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import legacy_scoring as L
from ..operators.scoring import ranked
from ..sources import fixtures as X
from . import duck as D
from .catalogue_queries import joined, query

_ROW = "concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in L.ROW) + ")"
_SPLIT4 = "list_filter(regexp_split_to_array(translate(coalesce(message, ''), {}, {}), '[\\s\\v,;:()/]+'), lambda x: x <> '')".format(D.q(T.WIDE_BLANKS), D.q(" " * len(T.WIDE_BLANKS)))
_SPLIT1 = _SPLIT4.replace(",;:()/", ",;:()")
_TOKENS = f"list_filter(regexp_extract_all(coalesce(message, ''), '{T.EXACT_TOKEN}'), lambda x, i: list_position(regexp_extract_all(coalesce(message, ''), '{T.EXACT_TOKEN}'), x) = i)"


def _first(array: str) -> str:
    return f"list_filter({array}, lambda x, i: list_position({array}, x) = i)"


def _longest(array: str, most: int) -> str:
    return f"list_transform(list_sort(list_transform({array}, lambda x, i: {{'n': -length(x), 'i': i, 'x': x}}))[1:{most}], lambda s: s.x)"


# written out here: these names and aliases are the contract, in this order
_COLOR_WORDS = {
    "gray": ("xam", "gray", "grey"), "black": ("den", "black"), "white": ("trang", "white"), "red": ("do", "red"), "blue": ("xanh duong", "blue"), "green": ("xanh la", "green"),
    "yellow": ("vang", "yellow"), "brown": ("nau", "brown"), "beige": ("beige", "kem", "cream"),
}
_COLORS = ", ".join("CASE WHEN " + " OR ".join(f"contains(n, {D.q(w)})" for w in words) + f" THEN '{c}' END" for c, words in _COLOR_WORDS.items())
C4 = f"""k0 AS (SELECT *, {D.norm_v4('message')} n, list_filter(list_transform({_SPLIT4}, lambda x: {D.norm_v4('x')}), lambda x: length(x) >= 3 AND x NOT IN {D.in_list(T.STOP_WORDS_V4)}) t0 FROM texts),
k AS (SELECT query_id, message, n, ({_first('t0')})[1:12] terms, list_filter([{_COLORS}], lambda x: x IS NOT NULL) colors,
  coalesce(CAST(nullif(regexp_extract(coalesce(message, ''), {D.q('(?i)' + T.LOOSE_HOLE)}, 1), '') AS BIGINT), -1) hole_count, {_longest(_TOKENS, 6)} tokens,
  coalesce({D.names('n', {'left': 'left|ben trai|trai', 'right': 'right|ben phai|phai', 'both': 'both|ca hai|hai ben'})}, 'all') side, len(t0) >= 2 many FROM k0),
k4 AS (SELECT *, CAST(len(colors) > 0 AS INT) + CAST(hole_count >= 0 AS INT) + CAST(many AS INT) + CAST(side <> 'all' AS INT) strong_count FROM k)"""


@query(f"WITH {X.TEXTS_SQL}, {C4} SELECT query_id, n normalized, array_to_string(terms, '|') terms, array_to_string(colors, '|') colors, hole_count, array_to_string(tokens, '|') tokens, side, strong_count FROM k4")
def t5_constraints_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.text_messages(spark, sf_dir).select("query_id", T.constraints_v4(F.col("message")).alias("k"))
    return found.select("query_id", "k.normalized", joined(F.col("k.terms")).alias("terms"), joined(F.col("k.colors")).alias("colors"), "k.hole_count", joined(F.col("k.tokens")).alias("tokens"), "k.side", "k.strong_count")


V1 = f"""i0 AS (SELECT *, {D.norm_v1('message')} n, ({_longest(_TOKENS, 1)}) token, (list_filter({_SPLIT1}, lambda x: length(x) >= 3))[1:8] ws FROM texts),
i1 AS (SELECT *, coalesce({D.names('n', {'count': 'bao nhieu|dem|count', 'compare': 'so sanh|compare|khac nhau'})}, 'find') act, coalesce({D.names('n', {'left': 'ben trai|left', 'right': 'ben phai|right', 'both': 'ca hai|both'})}, 'all') side, {_first('list_concat(token, ws)')} terms FROM i0)"""


@query(f"WITH {X.TEXTS_SQL}, {V1} SELECT query_id, act \"action\", side, length(message) > 120 OR act = 'compare' OR regexp_matches(n, '\\b(?:tai sao|giai thich|phan tich|de xuat|thong ke)\\b') complex, token[1] token, array_to_string(terms, '|') terms FROM i1")
def t6_intent_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.text_messages(spark, sf_dir).select("query_id", T.intent_v1(F.col("message")).alias("v"))
    return found.select("query_id", "v.action", "v.side", "v.complex", "v.token", joined(F.col("v.terms")).alias("terms"))


@query(f"WITH {X.TEXTS_SQL}, {C4} SELECT query_id, array_to_string({_first('list_concat(tokens, CASE WHEN trim(left(message, 140)) <> {0} THEN [trim(left(message, 140))] ELSE [] END, terms[1:5])'.format(D.q('')))}[1:8], '|') queries FROM k4")
def t8_query_list_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts of a V4 query: its tokens, its beginning, five terms; distinct, eight at most."""
    found = X.text_messages(spark, sf_dir).select("query_id", "message", T.constraints_v4(F.col("message")).alias("k"))
    start = F.trim(F.substring("message", 1, 140))
    every = F.concat(F.col("k.tokens"), F.when(start != "", F.array(start)).otherwise(F.array().cast("array<string>")), F.slice("k.terms", 1, 5))
    return found.select("query_id", joined(F.slice(F.array_distinct(every), 1, 8)).alias("queries"))


def _pairs(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return make(X.messages(spark), X.catalogue(spark, sf_dir))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(text4, {D.q(w)})" for w in words) + ")"


_OWN = " OR ".join(f"(x = '{c}' AND {_has(w)})" for c, w in _COLOR_WORDS.items())
_OTHER = " OR ".join(f"(x <> '{c}' AND {_has(w)})" for c, w in _COLOR_WORDS.items())
F7 = f"""{X.CAT_SQL}, {X.MSGS_SQL}, texts AS (SELECT * FROM msgs), {C4}, p0 AS (SELECT k4.* EXCLUDE n, cat.*, {D.norm_v4(_ROW)} text4, {D.norm_v4('code')} code4, {D.norm_v4('part_id')} part4, {D.norm_v4('usage_side')} side4 FROM k4, cat),
p1 AS (SELECT *, list_transform(regexp_extract_all(text4, '(\\d+) ?(?:lo|holes|hole)', 1), lambda x: CAST(x AS BIGINT)) counts,
  list_filter(list_transform(tokens, lambda x: CASE WHEN code4 = {D.norm_v4('x')} THEN {{'p': 120, 'tag': 'exact code'}} WHEN part4 = {D.norm_v4('x')} THEN {{'p': 110, 'tag': 'exact part_id'}} WHEN contains(text4, {D.norm_v4('x')}) THEN {{'p': 35, 'tag': 'token:' || x}} END), lambda s: s IS NOT NULL) tk,
  list_filter(terms, lambda x: contains(text4, x)) tm, list_transform(colors, lambda x: {{'c': x, 'v': CASE WHEN {_OWN} THEN 1 WHEN {_OTHER} THEN -1 ELSE 0 END}}) cv,
  CASE WHEN side = 'all' THEN NULL WHEN side4 IN (side, 'both') THEN 1 WHEN side4 NOT IN ('', 'unknown') THEN -1 ELSE 0 END sv FROM p0),
p2 AS (SELECT *, CASE WHEN hole_count < 0 THEN NULL WHEN list_contains(counts, hole_count) THEN 1 WHEN len(counts) > 0 THEN -1 ELSE 0 END hv FROM p1),
s4 AS (SELECT *, coalesce(list_sum(list_transform(tk, lambda s: s.p)), 0) + 12 * len(tm) + CASE hv WHEN 1 THEN 32 WHEN -1 THEN -28 ELSE 0 END + 10 * coalesce(list_sum(list_transform(cv, lambda s: s.v)), 0) + CASE sv WHEN 1 THEN 18 WHEN -1 THEN -25 ELSE 0 END
  + CASE WHEN trim(coalesce(identifying_features, '')) <> '' THEN 3 ELSE 0 END + CASE WHEN trim(coalesce(confusing_note, '')) <> '' THEN 2 ELSE 0 END score,
  list_concat(list_transform(tk, lambda s: s.tag), list_transform(tm, lambda x: 'metadata:' || x), CASE WHEN hv = 1 THEN [hole_count || ' holes'] ELSE [] END, list_transform(list_filter(cv, lambda s: s.v = 1), lambda s: 'color:' || s.c), CASE WHEN sv = 1 THEN ['side:' || side] ELSE [] END) m,
  list_concat(CASE WHEN hv = -1 THEN ['hole count metadata=' || array_to_string(counts, '/') || ' vs query=' || hole_count] ELSE [] END, list_transform(list_filter(cv, lambda s: s.v = -1), lambda s: 'color conflict:' || s.c), CASE WHEN sv = -1 THEN ['side:' || side4] ELSE [] END) cf FROM p2),
v4 AS (SELECT *, {_first('m')}[1:10] matched FROM s4)"""


@query(f"WITH {F7} SELECT query_id, id, CAST(score AS BIGINT) score, array_to_string(matched, '|') matched, array_to_string(cf[1:8], '|') conflicts FROM v4")
def f7_metadata_score_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scored_v4(_pairs(spark, sf_dir, L.pairs_v4)).select("query_id", "id", F.col("score").cast("long").alias("score"), joined(F.col("matched")).alias("matched"), joined(F.col("conflicts")).alias("conflicts"))


@query(f"""WITH {F7}, f AS (SELECT *, hole_count >= 0 AND list_contains(matched, hole_count || ' holes') bh, len(colors) > 0 AND strong_count >= 2 AND len(list_filter(colors, lambda x: NOT list_contains(matched, 'color:' || x))) = 0 bc FROM v4)
SELECT query_id, id, CAST(score AS BIGINT) score FROM f WHERE CASE WHEN bool_or(bh) OVER (PARTITION BY query_id) THEN bh ELSE bc END""".replace("WHERE CASE", "QUALIFY CASE"))
def p9_strong_filter_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.strong_matches_v4(L.scored_v4(_pairs(spark, sf_dir, L.pairs_v4))).select("query_id", "id", F.col("score").cast("long").alias("score"))


@query(f"""WITH {F7}, g AS (SELECT query_id, count(*) FILTER (WHERE score > 0) n, list_sort(list(score) FILTER (WHERE score > 0), 'DESC') b FROM v4 GROUP BY query_id)
SELECT query_id, n, CAST(coalesce(b[1], 0) - coalesce(b[2], 0) AS BIGINT) gap, CASE WHEN n BETWEEN 1 AND 5 THEN 'easy_filter' ELSE 'needs_analysis' END "mode" FROM g""")
def d3_pre_gate_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.pre_gate_v4(L.scored_v4(_pairs(spark, sf_dir, L.pairs_v4)))
    return found.select("query_id", "n", F.col("gap").cast("long").alias("gap"), "mode")


_V1P = f"""{X.CAT_SQL}, {X.MSGS_SQL}, texts AS (SELECT * FROM msgs), {V1}, p AS (SELECT i1.query_id, message, n raw, side, list_filter(list_transform(terms, lambda x: {D.norm_v1('x')}), lambda x: length(x) >= 2) terms, {D.norm_v1('token[1]')} ex, cat.*, {D.norm_v1(_ROW)} t, {D.norm_v1('code')} c1, {D.norm_v1('part_id')} p1 FROM i1, cat)"""


@query(f"""WITH {_V1P}, s AS (SELECT *, CASE WHEN ex = '' THEN 0 WHEN c1 = ex THEN 120 WHEN p1 = ex THEN 110 WHEN contains(c1, ex) OR contains(p1, ex) THEN 70 ELSE 0 END
  + coalesce(list_sum(list_transform(terms, lambda x: CASE WHEN x IN (c1, p1) THEN 45 WHEN contains(t, x) THEN 12 ELSE 0 END)), 0) + CASE WHEN raw <> '' AND contains(t, raw) THEN 30 ELSE 0 END
  + CASE WHEN side = 'all' THEN 0 WHEN usage_side IN (side, 'both') THEN 18 WHEN usage_side <> 'unknown' THEN -35 ELSE 0 END score FROM p)
SELECT query_id, id, CAST(score AS BIGINT) score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) <= 12""")
def f8_k4_rank_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(L.scored_v1(_pairs(spark, sf_dir, L.pairs_v1)), "score", 12).select("query_id", "id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


_HINTS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(n, {D.q(k)})" for k in keys) + f" THEN {D.q(label)} END" for label, keys in T.HINTS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {X.CAT_SQL}, {X.MSGS_SQL}, b0 AS (SELECT *, {D.norm_v1('message')} n FROM msgs), b1 AS (SELECT *, list_concat({_HINTS}, list_filter({_SPLIT1}, lambda x: length(x) >= 3)) w FROM b0),
b2 AS (SELECT query_id, n raw, list_filter(list_transform({_first('w')}, lambda x: {D.norm_v1('x')}), lambda x: length(x) >= 2) terms, regexp_extract_all(coalesce(message, ''), {D.q('(?i)' + T.LOOSE_HOLE)}, 1) asked FROM b1),
p AS (SELECT b2.*, cat.*, {D.norm_v1(_ROW)} t, {D.norm_v1('code')} c1, {D.norm_v1('part_id')} p1 FROM b2, cat)
SELECT query_id, id, CAST(coalesce(list_sum(list_transform(terms, lambda x: CASE WHEN x IN (c1, p1) THEN 80 WHEN contains(t, x) THEN 16 ELSE 0 END)), 0) + CASE WHEN raw <> '' AND contains(t, raw) THEN 35 ELSE 0 END
  + CASE WHEN contains(t, 'lo') OR contains(t, 'hole') THEN 25 * len(list_filter(asked, lambda x: contains(' ' || t || ' ', ' ' || x || ' '))) ELSE 0 END
  + CASE WHEN trim(coalesce(identifying_features, '')) <> '' THEN 4 ELSE 0 END + CASE WHEN trim(coalesce(confusing_note, '')) <> '' THEN 3 ELSE 0 END AS BIGINT) score FROM p""")
def f9_score_v1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scored_v1b(_pairs(spark, sf_dir, L.pairs_v1b)).select("query_id", "id", F.col("score").cast("long").alias("score"))
