"""Each operator against its SQL or brute force, on driver rows and on a fixture of edge cases."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gearfinch.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules, registry, suffix_dedup, substring_dedup, token_counts, url_filters, warc
from gearfinch.llm.induced_sort import suffix_array
from gearfinch.llm.texts import Words

from ..conftest import same

rng = random.Random(7)
WORD = ["".join(rng.choice("abcdeéfgß") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORD) for _ in range(n))


def edited(text, every):
    words = text.split()
    for i in range(every // 2, len(words), every):
        words[i] = "zz" + words[i]
    return " ".join(words)


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    """Nulls, empty, blank and very long texts, ties, copies, near copies, shared passages."""
    base, passage = [prose(120) for _ in range(6)], prose(70)
    texts = [None, "", " \n\t\n ", "one", "a b c d", base[0], base[0], edited(base[0], 40), base[1] + "\n" + passage, passage + "\n" + base[2], base[3] + " " + passage + " " + passage]
    texts += ["x " * 3000, "=" * 5000 + " end", base[4] + "\n" + base[4], "\n".join([prose(12)] * 3), base[5], "Line of the common kind here\nother", "Line of the common kind here\nmore " + prose(30), "\x00 nul \x00" + base[5]]
    n = len(texts)
    folder = tmp_path_factory.mktemp("edge")
    write = lambda name, t: pq.write_table(t, f"{folder}/{name}.parquet")
    write("documents", pa.table({"doc_id": pa.array([3 * i - 7 for i in range(n)], pa.int64()), "text": pa.array(texts), "lang": pa.array(([None, "en", "fr"] * n)[:n]), "source": pa.array(([None, "b", "a", "c"] * n)[:n]), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}))
    bench = [" ".join(base[1].split()[20:50]), "one", None, "", "a b c", " ".join(passage.split()[:13]).upper()]
    write("benchmark", pa.table({"item_id": pa.array(range(len(bench)), pa.int64()), "text": pa.array(bench)}))
    write("labels", pa.table({"doc_id": pa.array([3 * i - 7 for i in range(5, n)], pa.int64()), "quality": pa.array([1] * (n - 5), pa.int32()), "toxic": pa.array([0] * (n - 5), pa.int32())}))
    urls = ["http://A.com/en/1", "https://x.example.com/en/77?q", "net/de/", None, "", "ftp://example.net/de/8", "http://example.net/de/9#x", "s://org/es/", "s://notorg/es/", "http://x.y/casino/", "http://u@h:80/a\nb", "x://com/en/"]
    write("pages", pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls), "html": pa.array(["<p>é", "<p>é", None, "", "x" * 90000, "", "<p>é", "a", "b", "a", "c\r\n\r\nd", "WARC/1.1"])}))
    return str(folder)


SQL = sorted(registry.ORACLE)


@pytest.mark.parametrize("name", SQL)
def test_edge_cases_against_duckdb(spark, edge, name):
    same(registry.QUERIES[name](spark, edge), registry.ORACLE[name], edge)


@pytest.mark.parametrize("name", SQL)
def test_driver_rows_against_duckdb(spark, small, name):
    same(registry.QUERIES[name](spark, small), registry.ORACLE[name], small)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, edge, tmp_path, name):
    for t in ("documents", "benchmark", "labels", "pages"):
        pq.write_table(pq.read_table(f"{edge}/{t}.parquet").slice(0, 0), f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_repeated_rows_null_ids_and_further_columns(spark, edge, tmp_path, name):
    rows = {}
    for t in ("documents", "benchmark", "labels", "pages"):
        table = pq.read_table(f"{edge}/{t}.parquet")
        key = table.column_names[0]
        loose = table.slice(4, 2)
        loose = loose.set_column(0, key, pa.nulls(len(loose), pa.int64()))
        table = pa.concat_tables([table, table.slice(3, 4), loose])
        for c in ("id", "key", "size", "line", "node", "row", "c", "s"):
            table = table.append_column(c, pa.array(["x"] * len(table)))
        pq.write_table(table, f"{tmp_path}/{t}.parquet")
        rows[t] = len(table)
    expected = rows["pages" if name.startswith(("op6", "op7")) else "documents"]
    found = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(found) == expected
    if name.startswith(("op1_", "op2", "op3", "op7", "op8", "op9", "op10")):
        # rows with an id have the values that they have alone: a repeated row is no other document, and rows without an
        # id are no one's source
        own = lambda r: tuple(v for c, v in r.asDict().items() if c not in ("n_items", "items_sha256"))  # noqa: E731  (items are repeated too)
        alone = {own(r) for r in registry.QUERIES[name](spark, edge).collect()}
        assert {own(r) for r in found if r[0] is not None} == alone
        assert name[:4] not in ("op2_", "op3_", "op9_") or all(r["n_removed"] == 0 for r in found if r[0] is None)


def test_texts_of_one_id_never_remove_each_other(spark):
    """Rows of one id with different texts: each is judged by its own text, and only against smaller ids."""
    a, b = prose(60), prose(60)
    rows = [(1, a), (2, a + " x"), (2, b), (2, "y " + b), (3, "z " + b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicated(docs).collect()}
    assert words == {(1, 60, 0), (2, 61, 60), (2, 60, 0), (2, 61, 0), (3, 61, 60)}
    size = lambda t: len(t.encode())
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicated(docs).collect())
    assert found == sorted([(1, size(a), 0), (2, size(a) + 2, size(a)), (2, size(b), 0), (2, size(b) + 2, 0), (3, size(b) + 2, size(b) + 1)])


def test_a_recurring_gram_with_other_fillers(spark):
    """Table rows: a gram of 24 bytes between fillers of three, of which two differ in the later text."""
    gram = "abcdefghijklmnopqrstuvwx"
    texts = [gram.join(f) for f in (["a1;", "b2;", "c3;", "d4;", "e5;", "f6;", "g7;", "h8;"], ["a1;", "b2;", "X3;", "Y4;", "e5;", "f6;", "g7;", "h8;"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {i + k for i in range(len(texts[1]) - 49) if texts[1][i : i + 50] in texts[0] for k in range(50)}
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.deduplicated(docs).collect()}
    assert found == {0: 0, 1: len(gone)} and 0 < len(gone) < len(texts[1])


def test_suffix_array_by_brute_force():
    for _ in range(60):
        x = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 50))]
        import numpy as np

        assert suffix_array(np.array(x), 5).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_array_on_disk(monkeypatch):
    import numpy as np

    from gearfinch.llm import induced_sort

    monkeypatch.setattr(induced_sort, "SHORT", 4)
    monkeypatch.setattr(induced_sort, "REPEATED", 1)
    x = np.frombuffer((prose(400) * 2).encode(), np.uint8)
    text = x.tolist()
    assert suffix_array(x, 256, limit=256).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "red x x x x x blue"), (3, "blue red"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Red blue")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    found = {r["doc_id"]: r["items"] for r in decontaminate.matches(index, items, slop=3).collect()}
    assert found == {1: ["1"], 2: [], 3: ["1"], 4: []}


def test_many_item_blocks(spark, edge, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_BLOCK", 1)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    same(registry.QUERIES["op1_decontaminate"](spark, edge), decontaminate.OP1_SQL, edge)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_by_brute_force():
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 150))]
        b = [x for x in a if rng.random() > 0.05] + [rng.randrange(4) for _ in range(rng.randrange(4))]
        for most in (0, 2, 9, 30):
            assert near_dedup.banded_distance(a, b, most) == min(distance(a, b), most + 1)


def test_near_duplicates_by_brute_force(spark, edge):
    """Classes equal the components of all pairs with a five-word shingle similarity of 0.8, or closer by alignment."""
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    group = {d: d for d in texts}

    def top(d):
        return d if group[d] == d else top(group[d])

    for (a, x), (b, y) in itertools.combinations(texts.items(), 2):
        u, v = x.split(), y.split()
        if x == y or (u and v and max(len(u), len(v)) < 400 and distance(u, v) <= 0.2 * max(len(u), len(v))):
            group[max(top(a), top(b))] = min(top(a), top(b))
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert found == {d: top(d) for d in texts}


def test_near_duplicate_groups_meet_in_blocks(spark, monkeypatch):
    """Many copies with edits, and texts that share a passage only, with blocks of two."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    base, passage = prose(200), prose(60)
    texts = [edited(base, 30 + i) for i in range(12)] + [passage + " " + prose(30) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert {found[i] for i in range(12)} == {0} and all(found[i] == i for i in range(12, 24))


def test_short_near_duplicates_are_never_missed(spark):
    """Texts of 5 to 14 words with all the edits that are allowed, spread so that no five words stay together."""
    rows, r = [], random.Random(3)
    for n in range(5, 15):
        for kind in ("changed", "dropped", "added"):
            words = [f"w{r.randrange(10**9)}" for _ in range(n)]
            other = list(words)
            for at in sorted(([n // 2], [n // 3, 2 * n // 3])[n >= 10], reverse=True):
                other[at : at + (kind != "added")] = [] if kind == "dropped" else ["zz"]
            if near_dedup.most_edits(max(n, len(other)), 0.8) >= distance(words, other) and len(other) <= near_dedup.SHORT:
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    assert len(rows) > 40
    found = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}


def test_recall_of_candidates_by_edit_similarity():
    """Pairs of any length with as many random words changed as are allowed: at least 0.9 have a common key; likewise
    where words are dropped, so that lengths differ."""
    from gearfinch.llm.texts import Words

    r = random.Random(5)
    for n in (15, 20, 25, 40, 63, 64, 80, 81, 82, 100, 200, 400):
        for similarity in (0.8, 0.85, 0.9):
            for drop in (False, True):
                texts = []
                for _ in range(100):
                    words = [str(r.randrange(10**9)) for _ in range(n)]
                    texts.append(" ".join(words).encode())
                    for i in r.sample(range(n), near_dedup.most_edits(n, similarity)):
                        words[i] = "" if drop else str(r.randrange(10**9))
                    texts.append(" ".join(words).encode())
                words = Words(texts)
                keys = near_dedup.candidate_keys(words.hashes(), words.bounds)
                found = sum(bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(keys[::2], keys[1::2], strict=True))
                assert found >= 90, (n, similarity, drop, found)


def test_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mixed(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, mixing.mixed(docs.repartition(3)).collect())) == sorted(map(tuple, rows))
    # targets by the contract's own words
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    for s in names:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.02 * target[s] + 3 * mixing.BLOCK


def test_shards_play_what_is_taken(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect() if r["taken"]}
    played = {r["doc_id"]: r["w"] for r in mixing.shards(docs).groupBy("doc_id").agg(F.sum("words").alias("w")).collect()}
    assert played == taken


def test_hypergeometric_law(spark):
    from math import comb

    a, b, q, n = 30, 20, 12, 4000
    got = spark.range(n).select(mixing.hypergeometric(F.lit(a), F.lit(b), F.lit(q), (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count().collect()
    for r in got:
        assert abs(r["count"] / n - comb(a, r["x"]) * comb(b, q - r["x"]) / comb(a + b, q)) < 1e-3


def test_archives(spark, edge, tmp_path):
    """Rolled files come back whole, twice alike; files outside the manifest don't count."""
    pages = spark.read.parquet(f"{edge}/pages.parquet")
    folders = [f"file://{tmp_path}/{x}" for x in "ab"]
    manifests = [warc.write_archives(pages, f, roll_bytes=300) for f in folders]
    listed = [sorted(map(tuple, m.collect())) for m in manifests]
    assert listed[0] == listed[1] and len(listed[0]) > 3
    (tmp_path / "a" / "stray.warc.gz").write_bytes(b"junk")
    back = {r["page_id"]: r for r in warc.read_archives(manifests[0], folders[0]).collect()}
    rows = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert set(back) == set(rows)
    for k, html in rows.items():
        assert back[k]["payload_bytes"] == len(html)
        if back[k]["record_type"] == "response":
            assert back[k]["payload"] == html


def test_exact_binomial_bound():
    from math import comb

    for n, k in ((50, 0), (400, 1), (900, 4)):
        tail = sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))
        assert quality_rules.upper_bound_holds(n, k, 0.02, tail * 1.0001) and not quality_rules.upper_bound_holds(n, k, 0.02, tail * 0.9999)


def test_thresholds_certify_with_enough_labels(spark):
    rows = [(i, prose(30) + (" ###" * 40 if i % 2 else ""), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(4000)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, labels).collect()}
    assert all(kept[i] == (i % 2 == 0) for i in kept)


def test_certified_cutoffs_against_duckdb(spark, tmp_path):
    """Strata with different numbers of labels: one goes the whole path, one stops at lines, one at symbols, one has too
    few labels."""
    r, rows, labels = random.Random(11), [], []
    words = [f"w{i}" for i in range(5000)]
    for lang, n, noise in (("whole", 400, None), ("lines", 400, "lines"), ("symbols", 400, "symbols"), (None, 60, None)):
        for i in range(n):
            good = i % 3 > 0
            text = "\n".join(" ".join(r.sample(words, 8)) for _ in range(10))
            if not good:
                text += " " + "#*" * r.randint(1, 80) if i % 2 else "\n" + "\n".join(["ab cd"] * r.randint(1, 3))
            elif noise == "lines" and i % 5 == 0:
                text += "\n" + "\n".join(["ab cd"] * 3)
            elif noise == "symbols" and i % 5 == 0:
                text += " " + "#" * 60
            labels.append((len(rows), int(good), 0))
            rows.append((len(rows), text, lang, "s", len(text)))
    write = lambda name, names, x: pq.write_table(pa.table(dict(zip(names, map(list, zip(*x, strict=True)), strict=True))), f"{tmp_path}/{name}.parquet")
    write("documents", ["doc_id", "text", "lang", "source", "n_chars"], rows)
    write("labels", ["doc_id", "quality", "toxic"], labels)
    same(registry.QUERIES["op8_quality_rules"](spark, str(tmp_path)), registry.ORACLE["op8_quality_rules"], str(tmp_path))
    docs, known = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    cut = {x["stratum"]: (x["symbols"], x["lines"]) for x in quality_rules.judged(docs, known).select("stratum", "symbols", "lines").distinct().collect()}
    assert cut["whole"] == (0.02, 0.02) and cut["lines"][0] == 0.02 and cut["lines"][1] > 0.02 and cut["symbols"][0] > 0.02 and cut["symbols"][1] is None
    assert cut[quality_rules.NO_STRATUM] == (None, None)


def test_token_cache(spark, edge, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{edge}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = P.path(name)
        if name.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda t: len(sp.encode(t))  # noqa: B023, E731
        else:
            tok = Tokenizer.from_file(path)
            count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)  # noqa: B023, E731
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, f"file://{tmp_path}/cache", path).collect()}
        assert got == {d: count(t) for d, t in texts.items()}
    cached = spark.read.parquet(f"file://{tmp_path}/cache").count()
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("<|endoftext|>new é's text")))
    token_counts.token_counts(more, f"file://{tmp_path}/cache", P.path("word_bpe_49k.json")).collect()
    assert spark.read.parquet(f"file://{tmp_path}/cache").count() == cached + 1


def test_rules_are_filed_under_the_rarest_token(spark):
    rules = spark.createDataFrame([("r", "block", "x", ["com", "rare"], 1), ("any", "block", ".", [], 1)], url_filters.RULE_SCHEMA)
    tokens = spark.createDataFrame([("com",)] * 9 + [("rare",)], "token string")
    assert {r["rule"]: r["token"] for r in url_filters.rule_index(rules, tokens).collect()} == {"r": "rare", "any": ""}


def line_rows():
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        line = rng.sample(words[:40], 12) + rng.sample(words, 4)
        rows.append((i, " ".join(line) + "\n" + " ".join(line[:-1] + ["other"])))
    rows += [(40 + i, " ".join(rng.sample(words, 100) if i % 2 else words[i : i + 90])) for i in range(12)]
    # a large group of near copies, and lines of the same rare words that are near to few or none of them
    for i in range(150):
        line = [f"q{k}" for k in range(24)]
        for k in rng.sample(range(24), rng.choice([1, 1, 2, 3, 5, 7])):
            line[k] = rng.choice(words)
        rows.append((60 + i, " ".join(line)))
    return rows


def removed_by_brute_force(rows):
    """Ids and numbers of lines that are similar to an earlier one."""
    lines = [(d, k, set(x.split())) for d, t in rows for k, x in enumerate(t.split("\n"))]
    return {(d, k) for n, (d, k, s) in enumerate(lines) if any(s and 5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:n])}


@pytest.mark.parametrize("limits", [{}, {"PROPOSED": 1}, {"FREQUENT": 2}])
def test_lines_with_many_partners(spark, monkeypatch, limits):
    """Lines whose first partners fail are compared with all others; frequent words are dealt by length too."""
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows = line_rows()
    docs = spark.createDataFrame(rows, "key long, text string")
    assert {(r["key"], r["line"]) for r in line_dedup.removed_lines(docs).collect()} == removed_by_brute_force(rows)


def test_very_long_lines_of_many_rare_words(spark):
    """The first word that two similar lines share stands behind 20,000 others in each."""
    shared = " ".join(f"s{k}" for k in range(180_000))
    docs = spark.createDataFrame([(d, f"{shared} " + " ".join(f"{d}u{k}" for k in range(20_000))) for d in (1, 2)], "key long, text string")
    assert [tuple(r) for r in line_dedup.removed_lines(docs).collect()] == [(2, 0)]


def test_only_lines_of_wanted_words_are_cut(spark):
    """The exact last step makes word sets of lines that hold an open word alone, as they are among all lines."""
    texts = [t.encode() for _, t in line_rows()] + [b"", b"\n\n q3 " + b"x" * 200, b"x" * 200 + b" y"]
    levels = np.zeros(1 << line_dedup.SLOT_BITS, np.uint8)
    for w in (b"q3", b"x" * 200, b"w1"):
        word = Words([w]).piece_hashes()
        every, some = line_dedup.Lines(texts, levels), line_dedup.Lines(texts, levels, lambda hashes, word=word: np.isin(hashes, word))
        holds = [(k, i) for k, t in enumerate(texts) for i, line in enumerate(t.split(b"\n")) if w in line.split()]
        assert list(zip(some.text.tolist(), some.number.tolist(), strict=True)) == holds
        known = dict(zip(zip(every.text.tolist(), every.number.tolist(), strict=True), zip(every.low, every.high, every.bits, every.n, strict=True), strict=True))
        assert [known[at] for at in holds] == list(zip(some.low, some.high, some.bits, some.n, strict=True))


def test_lines_of_all_texts_of_an_id(spark):
    """Rows of one id with different texts are different documents; repeated rows are one."""
    lines = [" ".join(f"{c}{i}" for i in range(10)) for c in "abc"]
    near = [x.replace("9", "x") for x in lines]
    rows = [(1, lines[0]), (2, near[0] + "\n" + lines[1]), (2, lines[2]), (2, lines[2]), (3, near[2]), (None, lines[0]), (4, None)]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("row.*", "n_lines", "n_removed").collect()
    expected = [(1, lines[0], 1, 0), (2, lines[1], 2, 1), (2, lines[2], 1, 0), (2, lines[2], 1, 0), (3, "", 1, 1), (None, lines[0], 1, 0), (4, None, 0, 0)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e", 1, 2, 3, 4, 5), (2, "a b c d e\nf", 6, 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, row int, gone int, n_lines int, z int")
    found = line_dedup.deduplicated(docs).select("row.*").orderBy("doc_id").collect()
    assert found[0].asDict() == docs.collect()[0].asDict() and found[1].asDict() == docs.collect()[1].asDict() | {"text": "f"}


@pytest.mark.parametrize("s", ["\n", " ", "|"])
def test_fragments_with_a_recurring_anchor(spark, s):
    """Equal ends and lengths, another middle: only what stands in the earlier text goes."""
    texts = [s.join("x" * n for n in sizes) for sizes in ((58, 25, 25, 60), (60, 24, 24, 60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    starts = [i for i in range(len(texts[1]) - 49) if texts[1][i : i + 50] in texts[0]]
    gone = {i + k for i in starts for k in range(50)}
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.deduplicated(docs).collect()}
    assert found == {0: 0, 1: len(gone)} and len(gone) < len(texts[1])


def test_repeats_have_true_sources(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in suffix_dedup.deduplicated(docs).collect():
        for m in r["repeats"]:
            assert m["source"] < r["doc_id"]
            assert texts[r["doc_id"]][m["start"] :][: m["n_bytes"]] == texts[m["source"]][m["source_start"] :][: m["n_bytes"]]
    for r in substring_dedup.deduplicated(docs).collect():
        for m in r["repeats"]:
            own, source = texts[r["doc_id"]].split(), texts[m["source"]].split()
            assert own[m["start"] :][: m["n_words"]] == source[m["source_start"] :][: m["n_words"]]


def test_digest_of_nothing():
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
