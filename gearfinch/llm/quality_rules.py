"""Quality rules with risk-controlled thresholds.

Three ratios of a document (symbols per word character, repeated lines, repeated five-word windows) may reject it when
they exceed a cutoff.  Cutoffs aren't set by hand: in every stratum (language) they are tightened along one path that is
fixed beforehand (PATH: first symbols alone, then lines and repeats together), as long as the share of labelled good
documents that all three rules together reject is at most ALPHA by the exact (Clopper-Pearson) upper bound at level
DELTA / strata.  The first step that fails ends the path.  Testing in a fixed sequence needs no correction for its
steps, and the strata share DELTA by the union bound: with probability 1 - DELTA no stratum loses more than ALPHA of its
good documents.  A stratum with too few labels (219 of four strata, with no false rejection) certifies no step: the
rules are then off there.

Null and empty texts have no words and fail the base rule.  A null language is a stratum of its own.  Labels are one
per document id (any good label counts); documents without an id have none.  With no labels only the base rule rejects.
Repeated rows are judged each by its own text and all alike; a text of any length is counted whole.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import first_of_runs
from .texts import Words, as_bytes, mix, ranges, rolling, spans_of, stored, table

ALPHA, DELTA = 0.02, 0.05
WINDOW = 5
RULES = {"symbols": "n_symbols / word_chars", "lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words"}
GRID = tuple(round(0.02 * i, 2) for i in range(1, 26))
#: Cutoffs of symbols, and of lines and repeats (null: off), from the loosest pair to the tightest.
PATH = tuple((c, None) for c in reversed(GRID)) + tuple((GRID[0], c) for c in reversed(GRID))
NO_STRATUM = "\u0000"

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, words: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[words.text_starts[1:]] - total[words.text_starts[:-1]]


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = Words(texts)
    hashes, n = words.hashes(), np.diff(words.bounds)
    lead = (words.buf & 0xC0) != 0x80
    blank = np.isin(words.buf, [32, 9, 10, 11, 12, 13])
    # words in windows that stand twice or more in the same text
    at = ranges(words.bounds[:-1], n - WINDOW + 1)
    text = np.repeat(np.arange(len(n)), np.maximum(0, n - WINDOW + 1))
    window = rolling(hashes, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
    key = window ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    begin = first_of_runs(key[order])
    sizes = np.diff(np.append(begin, len(order)))
    again = np.sort(at[order[np.repeat(sizes > 1, sizes)]])
    covered = np.zeros(len(hashes) + 1, np.int64)
    a, b = spans_of(again, WINDOW)
    covered[ranges(a, b - a)] = 1
    total = np.concatenate([[0], np.cumsum(covered)])
    dup, lines = [], []
    for x in texts:
        own = [line for line in x.split(b"\n") if line.strip()]
        lines.append(len(own))
        dup.append(len(own) - len(set(own)))
    return dict(
        zip(
            _COUNTS,
            (n, _per_text(lead & ~blank, words), _per_text(_SYMBOL[words.buf], words), np.array(lines, np.int64), np.array(dup, np.int64), total[words.bounds[1:]] - total[words.bounds[:-1]]),
            strict=True,
        )
    )


@F.arrow_udf(_TYPE)
def _counts(column: pa.Array) -> pa.Array:
    out: dict[str, list] = {c: [] for c in _COUNTS}
    for first in range(0, len(column), 256):
        for c, v in text_counts(as_bytes(column.slice(first, 256))).items():
            out[c].append(v)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in out.values()], _COUNTS)


#: Spark would run it once more, in a second worker, for a filter on its result if it took it for deterministic.
_counts = _counts.asNondeterministic()


def base_failed(c: str = "c") -> Column:
    return (F.col(f"{c}.n_words") < 10) | (100 * F.col(f"{c}.n_repeat_words") > 20 * F.col(f"{c}.n_words"))


def scores(c: str = "c") -> Column:
    """The three ratios, 0 where nothing is counted."""
    def ratio(rule: str) -> Column:
        a, b = (F.col(f"{c}.{x}") for x in RULES[rule].split(" / "))
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).alias(rule)

    return F.struct(*(ratio(r) for r in RULES))


def upper_bound_holds(n: int, k: int, rate: float, level: float) -> bool:
    """Whether the exact upper bound at `level` for the rate behind k of n is at most `rate`: P(Bin(n, rate) <= k) <= level."""
    if n <= 0 or k >= n:
        return False
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(k + 1)]
    top = max(log)
    return top + math.log(sum(math.exp(x - top) for x in log)) <= math.log(level)


def thresholds(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and a cutoff for each rule (null: off): the last step of PATH that is certified.  scored: doc_id, stratum, s (scores), bad (base rule fails).

    Documents that the base rule fails don't count: the guarantee is for what the thresholds reject beyond it."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    held = scored.where(~F.col("bad")).join(good, "doc_id", "left_semi")
    first, *others = (F.col(f"s.{r}") for r in RULES)

    def rejected(step: tuple) -> Column:
        return reduce(lambda a, b: a | b, [first > step[0], *(x > step[1] for x in others if step[1] is not None)])

    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*(F.count_if(rejected(step)) for step in PATH)).alias("rejected"))
    # one row for each stratum; all strata share the correction
    counts = counts.crossJoin(counts.agg(F.count("*").alias("strata")))

    def choose(batches):
        for batch in batches:
            out = {"stratum": batch.column("stratum").to_pylist()} | {r: [] for r in RULES}
            for row in batch.to_pylist():
                steps = takewhile(lambda at: upper_bound_holds(row["n"], at[1], alpha, delta / row["strata"]), zip(PATH, row["rejected"], strict=True))
                last = max((step for step, _ in enumerate(steps)), default=None)
                first, others = (None, None) if last is None else PATH[last]
                for r, c in zip(RULES, (first, others, others), strict=True):
                    out[r].append(c)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("stratum", pa.string()), *((r, pa.float64()) for r in RULES)]))

    return counts.mapInArrow(choose, "stratum string, " + ", ".join(f"{r} double" for r in RULES))


def with_scores(docs: DataFrame, id_col: str, text_col: str, stratum_col: str | None) -> DataFrame:
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(NO_STRATUM)) if stratum_col else F.lit(NO_STRATUM)
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), _counts(F.col(text_col).cast("string")).alias("c"))
    return counted.select("doc_id", "stratum", "c", scores().alias("s"), base_failed().alias("bad"))


def rejects() -> Column:
    """The thresholds' verdict on scores s beside columns of cutoffs; a rule that is off rejects nothing."""
    verdict = F.lit(False)
    for r in RULES:
        verdict = verdict | F.coalesce(F.col(f"s.{r}") > F.col(r), F.lit(False))
    return verdict


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, stratum, the counts, the ratios, base_failed, the cutoffs and kept, for each row of docs."""
    scored = stored(with_scores(docs, id_col, text_col, stratum_col), "quality-scores")
    cut = stored(thresholds(scored, labels), "quality-cutoffs")
    return scored.join(cut, "stratum", "left").select("doc_id", "stratum", "c.*", "s", F.col("bad").alias("base_failed"), *RULES, (~F.col("bad") & ~rejects()).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    cut = stored(thresholds(with_scores(docs, id_col, text_col, stratum_col), labels), "quality-cutoffs")
    cut = cut.select(F.struct("*").alias("cut"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(stratum_col).cast("string"), F.lit(NO_STRATUM)).alias("stratum"), _counts(F.col(text_col).cast("string")).alias("c"))
    rows = rows.select("row", "stratum", scores().alias("s"), base_failed().alias("bad")).where("NOT bad")
    joined = rows.join(cut, F.col("stratum") == F.col("cut.stratum"), "left")
    verdict = F.lit(False)
    for r in RULES:
        verdict = verdict | F.coalesce(F.col(f"s.{r}") > F.col(f"cut.{r}"), F.lit(False))
    return joined.where(~verdict).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The binomial tail is summed in logarithms, as above; cutoffs are the grid's.
OP8_SQL = """
WITH w AS (SELECT doc_id, coalesce(lang, chr(0)) stratum, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + 5)) p FROM win JOIN twice USING (doc_id, s)) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) n, count(*) - count(DISTINCT l) d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) n_lines, CAST(coalesce(ln.d, 0) AS BIGINT) n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed,
  [CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END] r FROM c),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT s.* FROM s SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
path AS (SELECT i, CASE WHEN i <= 25 THEN round(0.02 * (26 - i), 2) ELSE 0.02 END c, CASE WHEN i > 25 THEN round(0.02 * (51 - i), 2) END t FROM range(1, 51) q(i)),
k AS (SELECT stratum, i step, count(*) n, count(*) FILTER (WHERE r[1] > c OR coalesce(r[2] > t OR r[3] > t, false)) k, (SELECT count(DISTINCT stratum) FROM held) strata FROM held, path GROUP BY ALL),
tail AS (SELECT stratum, step, any_value(n) n, any_value(k.k) k, any_value(strata) strata,
  sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln(0.02) + (n - i) * ln(0.98))) p FROM (SELECT *, unnest(range(0, k + 1)) i FROM k) k GROUP BY stratum, step),
cutoff AS (SELECT stratum, coalesce(min(step) FILTER (WHERE NOT (k < n AND p <= 0.05 / strata)), 51) - 1 last FROM tail GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cutoff JOIN path ON i = last WHERE cutoff.stratum = s.stratum AND (s.r[1] > c OR coalesce(s.r[2] > t OR s.r[3] > t, false))) kept
FROM s
"""
