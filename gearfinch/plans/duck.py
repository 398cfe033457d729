"""DuckDB expressions for the oracle queries (see `fixtures` for the views)."""

from __future__ import annotations

from ..functions import text as T
from ..sources import fixtures as X


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm_v5(x: str) -> str:
    gone = T.PUNCTUATION + T.WIDE_BLANKS
    return f"trim(regexp_replace(translate(lower(strip_accents(coalesce({x}, ''))), {q(gone)}, {q(' ' * len(gone))}), '[\\s\\v]+', ' ', 'g'))"


def norm_v4(x: str) -> str:
    return f"trim(regexp_replace(lower(translate(strip_accents(coalesce({x}, '')), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g'))"


def norm_v1(x: str) -> str:
    return f"trim(regexp_replace(translate(lower(strip_accents(coalesce({x}, ''))), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"


def names(n: str, patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({n}, {q(chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')}) THEN {q(k)}" for k, p in patterns.items()) + " END"


def number(x: str, pattern: str) -> str:
    return f"CAST(nullif(regexp_extract({x}, {q(pattern)}, 1), '') AS BIGINT)"


def in_list(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def constraints(source: str, name: str = "c") -> str:
    """CTEs that parse the messages of `source` (query_id, message, ...) into n, hole, shape, side, color, terms."""
    return f"""{name}0 AS (SELECT *, {norm_v5('message')} n FROM {source}),
{name} AS (SELECT *, {number('n', T.HOLE)} hole, {names('n', T.SHAPES)} shape, {names('n', T.SIDES)} side, {names('n', T.COLORS)} color,
  list_filter(string_split(n, ' '), lambda x, i: list_position(string_split(n, ' '), x) = i AND length(x) >= 2 AND x NOT IN {in_list([*T.STOP_WORDS, 'lo', 'hole', 'holes'])} AND NOT regexp_matches(x, '^\\d+$')) terms FROM {name}0)"""


_CAT_TEXT = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in ("code", "part_id", "identifying_features", "confusing_note", "usage_side", "view_mode")) + ")"
ROWS = f"rows0 AS (SELECT *, {norm_v5(_CAT_TEXT)} row_text FROM cat), rws AS (SELECT *, {number('row_text', T.HOLE)} row_holes FROM rows0)"


def stands(column: str, patterns: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN regexp_matches(row_text, {q(chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')})" for k, p in patterns.items()) + " END"


_ROW_SIDES = {"left": "trai|left|lhf", "right": "phai|right|rhf", "both": "ca hai|hai ben|both"}


def evidence(pairs: str, name: str = "ev") -> str:
    """CTEs that add ok_hole, ok_shape, ok_side, ok_color, matched, evidence, conflicts and metadata_score to pairs."""
    tags = (("ok_hole", "'hole_count:' || row_holes"), ("ok_shape", "'shape:' || shape"), ("ok_side", "'side:' || side"), ("ok_color", "'color:' || color"))
    points = (("ok_hole", 0.55, 0.75), ("ok_shape", 0.5, 0.6), ("ok_side", 0.3, 0.4), ("ok_color", 0.25, 0.25))
    return f"""{name}0 AS (SELECT *, row_holes = hole ok_hole, {stands('shape', T.SHAPES)} ok_shape, {stands('side', _ROW_SIDES)} ok_side, {stands('color', T.COLORS)} ok_color,
  list_filter(terms, lambda t: contains(row_text, t)) matched FROM {pairs}),
{name} AS (SELECT *, list_concat(list_filter([{', '.join(f'CASE WHEN {k} THEN {t} END' for k, t in tags)}], lambda x: x IS NOT NULL), list_transform(matched, lambda t: 'term:' || t)) evidence,
  list_filter([{', '.join(f'CASE WHEN NOT {k} THEN {t} END' for k, t in tags)}], lambda x: x IS NOT NULL) conflicts,
  hole IS NOT NULL OR shape IS NOT NULL OR side IS NOT NULL OR color IS NOT NULL OR len(terms) > 0 metadata_available,
  CASE WHEN hole IS NOT NULL OR shape IS NOT NULL OR side IS NOT NULL OR color IS NOT NULL OR len(terms) > 0 THEN
  round(greatest(0.0, least(1.0, CAST(0 AS DOUBLE) {' '.join(f'+ CASE WHEN {k} THEN CAST({a} AS DOUBLE) WHEN NOT {k} THEN CAST(-{b} AS DOUBLE) ELSE 0 END' for k, a, b in points)}
    + CASE WHEN len(terms) > 0 THEN CAST(0.35 AS DOUBLE) * (len(matched) / len(terms)) ELSE 0 END)), 6) END metadata_score FROM {name}0)"""


def structural(pairs: str, name: str = "st") -> str:
    row = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in ("identifying_features", "confusing_note", "code", "part_id")) + ")"
    return f"""{name}0 AS (SELECT *, {number("lower(coalesce(message, ''))", T.LOOSE_HOLE)} requested_holes, {number(f'lower({row})', T.LOOSE_HOLE)} candidate_holes FROM {pairs}),
{name} AS (SELECT *, CAST(requested_holes = candidate_holes AS DOUBLE) structural_score FROM {name}0)"""


HITS = f"""{X.VEC_SQL}, {X.PROBES_SQL}, hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, probe_id ORDER BY similarity DESC, id) rank
  FROM (SELECT query_id, probe_id, v.id, record_id, asset_type, round(list_cosine_similarity(p.embedding, v.embedding), 6) similarity FROM probes p, vec v WHERE preprocess_version = 'canon_v2' AND is_active)
  QUALIFY row_number() OVER (PARTITION BY query_id, probe_id ORDER BY similarity DESC, id) <= 60)"""
COUNTS = "counts AS (SELECT query_id, count(*) n_probes, any_value(message) message, any_value(truth) truth FROM probes GROUP BY query_id)"
FUSED = f"""{HITS}, {COUNTS}, per AS (SELECT query_id, record_id, sum(1.0 / (20 + rank)) rrf_sum, count(DISTINCT probe_id) probe_count, max(greatest(0, least(1, similarity))) raw_vector_similarity,
  arg_max({{'id': id, 'asset_type': asset_type}}, (greatest(0, least(1, similarity)), -probe_id, -rank)) hit FROM hits GROUP BY query_id, record_id),
fu0 AS (SELECT per.query_id, record_id, hit.id best_id, hit.asset_type asset_type, probe_count, raw_vector_similarity, probe_count / n_probes probe_consensus, greatest(0, least(1, rrf_sum / (n_probes / 21.0))) rrf FROM per JOIN counts USING (query_id)),
fu AS (SELECT * EXCLUDE rrf, round(rrf, 6) probe_rrf, round(greatest(0, least(1, 0.82 * raw_vector_similarity + 0.12 * rrf + 0.06 * probe_consensus)), 6) similarity FROM fu0),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, CAST(record_id AS BIGINT)) rank FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, CAST(record_id AS BIGINT)) <= 60)"""
HYBRID = f"""{X.CAT_SQL}, {ROWS}, {FUSED}, hyd AS (SELECT f.* EXCLUDE (probe_consensus), message, n_probes, coalesce(r.id, record_id) id, CASE WHEN n_probes > 1 THEN probe_consensus ELSE 0 END probe_consensus,
  coalesce(ordinal, CAST(record_id AS BIGINT)) ordinal, code, part_id, identifying_features, confusing_note, usage_side, view_mode, coalesce(row_text, '') row_text, row_holes
  FROM fused f JOIN counts USING (query_id) LEFT JOIN rws r ON r.id = f.record_id WHERE similarity >= 0.55),
{constraints('hyd')}, {evidence('c')}, {structural('ev')},
w AS (SELECT *, CAST(0.78 AS DOUBLE) * similarity + CAST(0.08 AS DOUBLE) * probe_consensus + CASE WHEN metadata_available THEN CAST(0.1 AS DOUBLE) * metadata_score ELSE 0 END + coalesce(CAST(0.12 AS DOUBLE) * structural_score, 0) total,
  CAST(0.78 AS DOUBLE) + CAST(0.08 AS DOUBLE) + CASE WHEN metadata_available THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN structural_score IS NOT NULL THEN CAST(0.12 AS DOUBLE) ELSE 0 END weight FROM st),
scored AS (SELECT *, round(greatest(0, least(1, total / weight - CASE WHEN structural_score = 0 THEN CAST(0.08 AS DOUBLE) ELSE 0 END)), 6) final_score FROM w)"""
