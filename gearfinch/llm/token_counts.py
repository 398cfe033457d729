"""Token counts with a digest cache.

A text is known by the SHA-256 digest of its bytes, a tokenizer by that of its file.  Counts of known pairs are joined
from the cache, a table of files; only distinct texts that miss are encoded, and appended to it.  The tokenizer's own
library does the encoding.  For a tokenizer that treats white-space separated pieces one by one, a task encodes every
distinct piece once and adds up.

Null counts as empty, and empty has no tokens.  Repeated rows share one encoding.  An empty table appends nothing.  A text of
any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import scratch, table

#: Pieces of a task that are remembered at once.
REMEMBERED = 400_000
LIMIT = 2048
_PIECE = re.compile("[^ \t-\r]+")
_CACHE = "digest string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def by_pieces(path: str) -> bool:
    """Whether the tokenizer's steps look at each white-space separated piece alone: white space is dropped between
    pieces, and no special token spans or swallows any."""
    import json

    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = lambda x, many: [k["type"] for k in (x or {}).get(many, [x] if x else [])]
    split = next((s for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split"), None)
    return bool(
        set(kinds(spec["normalizer"], "normalizers")) <= {"NFC", "Replace", "Lowercase"}
        and split
        and split["behavior"] == "Removed"
        and split["invert"]
        and not re.search(r"\\s(?!\\p)|\.", split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", ""))
        and spec["post_processor"] is None
        and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


def counter(path: str):
    """A function from texts to token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    encode = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    if not by_pieces(path):
        return encode
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        if len(known) > REMEMBERED:
            known.clear()
        pieces = [_PIECE.findall(x) for x in texts]
        new = list({p for own in pieces for p in own if p not in known})
        known.update(zip(new, encode(new), strict=True))
        get = known.__getitem__
        return [sum(map(get, own)) for own in pieces]

    return count


def token_counts(docs: DataFrame, cache: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; the cache (a folder, made if missing) grows by the
    distinct texts it lacked."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2("text", 256).alias("digest")
    rows = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    # one row stands for each missing digest; its text alone is read again
    here = spark.createDataFrame([], _CACHE)
    here.write.mode("append").parquet(cache)
    stored = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses = rows.select("digest").distinct().join(stored, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * part.num_rows), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["digest", "tokenizer", "n_tokens"])

    # identical texts meet in one group that keeps one text, thinned before the shuffle
    distinct = texts.select(digest, "text").groupBy("digest").agg(F.first("text").alias("text"))
    distinct.join(misses, "digest", "left_semi").mapInArrow(encode, _CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"), public_tokenizers.path("word_bpe_49k.json"))
