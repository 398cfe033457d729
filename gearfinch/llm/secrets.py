"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are the matches of three fixed patterns in a text; they are always told.  The method looks for further
credentials (provider tokens, private keys, bearer tokens, passwords in addresses, and mixed tokens that look random),
hashes each value, and counts over the whole corpus how many distinct repositories and owners hold that hash.  A value
of at most MOST_OWNERS owners and MOST_REPOSITORIES repositories is `live`: its spans are added, unless a base span
meets them.  A value that more owners or repositories hold is `copied`: an example from a manual, a test vector, a
boilerplate.  A private key or token counts only as a digest; no value is stored.

Plan: one scan of the texts leaves narrow rows, stored: for each match its kind, its length and that of the text before
it (by `split` and `regexp_extract_all`), and a digest.  Running sums over the matches of a row give positions in code
points.  Digests are made distinct by repository and by owner before they are counted, with partial aggregates, so a
value in a third of all rows is one row of each task.  The live digests meet the candidates in a sort-merge join that
adaptive execution can split.

Null text is empty.  Rows are told apart by their place in the stored scan, so repeated rows and ids and null ids each
give their own row; a null owner or repository is one owner or repository of its own.  Texts are matched whole, whatever
their length.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .texts import stored, table

# The base kinds, in the order in which spans of one start are listed: pattern, group that is measured,
# characters at least.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds: pattern, and the group that holds the value.
MORE = (
    ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[rs]k_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36})", 0),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END [A-Z ]*PRIVATE KEY-----", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    ("bearer", r"[Bb]earer ([A-Za-z0-9+/_.=~-]{16,})", 1),
    ("address", r"://[A-Za-z0-9_.-]+:([^\x20\x09-\x0D:/@]{6,})@", 1),
    ("random", r"[A-Za-z0-9+/_=-]{20,}", 0),
)
#: A random token has digits, capitals and small letters, and so many different characters.
RANDOM_DISTINCT = 12
MOST_OWNERS, MOST_REPOSITORIES = 1, 3

_MATCH = "array<struct<kind:string,rank:int,nth:int,before:int,size:int,measured:int,digest:binary>>"


def matches(text: Column, kind: str, rank: int, pattern: str, group: int, keep_digest: bool) -> Column:
    """Leftmost matches that don't overlap: kind, rank, nth, before (code points since the match before), size, measured
    (code points of the group) and, if wanted, the group's digest.  Most texts have none and end at the first test."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), whole, lambda b, m: F.struct(F.length(b).alias("before"), m.alias("m")))
    if group:
        pairs = F.zip_with(pairs, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, v: F.struct(x["before"].alias("before"), x["m"].alias("m"), v.alias("v")))
    value = "v" if group else "m"
    digest = (lambda x: F.unhex(F.sha2(x[value], 256))) if keep_digest else (lambda x: F.lit(None).cast("binary"))

    def match(x: Column, nth: Column) -> Column:
        parts = {"kind": F.lit(kind), "rank": F.lit(rank), "nth": nth, "before": x["before"], "size": F.length(x["m"]), "measured": F.length(x[value]), "digest": digest(x)}
        return F.struct(*(c.alias(name) for name, c in parts.items()))

    found = F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), match)
    if kind == "random":  # too plain a token still counts for the positions of those behind it
        plain = F.transform(whole, looks_random)
        found = F.zip_with(found, plain, lambda x, r: x.withField("measured", F.when(r, x["measured"]).otherwise(0)))
    return F.when(text.rlike(pattern), found.cast(_MATCH)).otherwise(F.array().cast(_MATCH))


def looks_random(value: Column) -> Column:
    several = F.size(F.array_distinct(F.split(value, ""))) >= RANDOM_DISTINCT
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]") & several


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """One stored row for each row of docs: its place, id, owner and repository, and its matches of all kinds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        if not group:  # a run is matched whole or not at all, so a short one need not be matched to be dropped
            pattern = pattern.removesuffix("+") + f"{{{least - len(pattern.partition('[')[0])},}}"
        kinds.append(matches(text, kind, rank, pattern, group, False))
    kinds += [matches(text, kind, len(BASE) + rank, pattern, group, True) for rank, (kind, pattern, group) in enumerate(MORE)]
    owner, repository = F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository")
    return stored(docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("doc_id"), owner, repository, F.concat(*kinds).alias("found")), "secret-scan")


def placed(rows: DataFrame) -> DataFrame:
    """place, owner, repository, kind, rank, start, stop, digest: base spans that are long enough, and candidates that
    no base span meets."""
    each = rows.where(F.size("found") > 0).select("place", "owner", "repository", F.inline("found"))
    stop = F.sum(F.col("before") + F.col("size")).over(Window.partitionBy("place", "rank").orderBy("nth"))
    least = F.create_map(*(F.lit(x) for kind, *_, size in BASE for x in (kind, size)))
    each = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where(F.col("measured") >= F.coalesce(least[F.col("kind")], F.lit(1)))
    base = F.col("digest").isNull()
    until = F.max(F.when(base, F.col("stop"))).over(Window.partitionBy("place").orderBy("start", "rank"))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("place").orderBy(F.desc("start"), F.desc("rank")))
    each = each.withColumns({"until": until, "after": after})
    free = F.coalesce(F.col("until") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("stop"), F.lit(True))
    return each.where(base | free).select("place", "owner", "repository", "kind", "rank", "start", "stop", "digest")


def ownership(candidates: DataFrame) -> DataFrame:
    """digest, n_owners, n_repositories, live.  candidates: digest, owner, repository.

    Distinct pairs are made first, then counted: a digest that many rows hold is counted from partial sums."""
    pairs = candidates.select("digest", "owner", "repository").distinct()
    repositories = pairs.select("digest", "repository").distinct().groupBy("digest").agg(F.count("*").alias("n_repositories"))
    owners = pairs.select("digest", "owner").distinct().groupBy("digest").agg(F.count("*").alias("n_owners"))
    live = (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repositories") <= MOST_REPOSITORIES)
    return owners.join(repositories, "digest").withColumn("live", live)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned rows; the base spans; and the further candidates with n_owners, n_repositories and live."""
    rows = scanned(docs, id_col, text_col, owner_col, repository_col)
    spans = stored(placed(rows), "secret-spans")
    base, more = spans.where("digest IS NULL"), spans.where("digest IS NOT NULL")
    return rows, base, more.join(stored(ownership(more), "secret-owners"), "digest")


def _listed(found: Column) -> Column:
    """kind:start:stop by start, then kind."""
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (base and live) of each row."""
    rows, base, more = findings(docs, id_col, text_col, owner_col, repository_col)
    span = F.struct("start", "rank", "stop", "kind")
    every = base.withColumn("own", F.lit(True)).select("place", "own", "kind", span.alias("span"))
    every = every.unionByName(more.where("live").select("place", F.lit(False).alias("own"), "kind", span.alias("span")))
    counts = [F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind, *_ in BASE]
    by_row = every.groupBy("place").agg(*counts, F.collect_list(F.when(F.col("own"), F.col("span"))).alias("base"), F.collect_list("span").alias("all"))
    joined = rows.select("place", "doc_id").join(by_row, "place", "left")
    numbers = (F.coalesce(F.col(f"n_{kind}"), F.lit(0)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE)
    listed = lambda c: F.coalesce(_listed(F.col(c)), F.lit(""))
    return joined.select("doc_id", *numbers, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Each kind's matches with running sums; the patterns are those above."""
    kinds = [(k, r, p, g, least) for r, (k, p, g, least) in enumerate(BASE)] + [(k, r + len(BASE), p, g, 1) for r, (k, p, g) in enumerate(MORE)]
    one = "SELECT rn, '{k}' kind, {r} rank, {least} least, unnest(regexp_extract_all(t, '{p}', 0)) m, unnest(regexp_extract_all(t, '{p}', {g})) v, unnest(string_split_regex(t, '{p}')[:-2]) b, unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) nth FROM d"
    every = " UNION ALL ".join(one.format(k=k, r=r, p=p.replace("'", "''"), g=g, least=least) for k, r, p, g, least in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () rn, doc_id, source, coalesce(text, '') t FROM documents),
m AS ({every}),
p AS (SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY rn, rank ORDER BY nth) stop FROM m),
s AS (SELECT rn, kind, rank, v, stop - length(m) start, stop FROM p WHERE length(v) >= least AND (kind <> 'random'
  OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND len(list_distinct(string_split(v, ''))) >= {RANDOM_DISTINCT})),
base AS (SELECT * FROM s WHERE rank < {len(BASE)}),
more AS (SELECT s.*, doc_id, source FROM s JOIN d USING (rn) WHERE rank >= {len(BASE)} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rn = s.rn AND b.start < s.stop AND s.start < b.stop)),
live AS (SELECT v FROM more GROUP BY v HAVING count(DISTINCT coalesce('s' || source, 'n')) <= {MOST_OWNERS} AND count(DISTINCT coalesce('s' || doc_id, 'n')) <= {MOST_REPOSITORIES}),
every AS (SELECT rn, kind, rank, start, stop FROM base UNION ALL SELECT rn, kind, rank, start, stop FROM more SEMI JOIN live USING (v)),
told AS (SELECT rn, count(*) FILTER (WHERE kind = 'assign') n_assign, count(*) FILTER (WHERE kind = 'access') n_access, count(*) FILTER (WHERE kind = 'hex') n_hex,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}) base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) spans FROM every GROUP BY rn)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) n_assign, CAST(coalesce(n_access, 0) AS BIGINT) n_access, CAST(coalesce(n_hex, 0) AS BIGINT) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN told USING (rn)
"""


OP13_SQL = _sql()
