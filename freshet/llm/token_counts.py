"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, then worker caches."""

from __future__ import annotations

import json
import os
import sys
import types
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import by_value, documents

# Fixed value: how the tokenizers library's byte-level pre-tokenizer splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Longer pre-tokens are encoded each time, so that a cache's bytes are bounded too.
LONGEST = 64


def _worker():
    """What a worker process keeps between tasks: loaded tokenizers and its cache."""
    return sys.modules.setdefault("_token_count_worker", types.ModuleType("_token_count_worker")).__dict__


def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    kept = _worker()
    if kept.get("definition") != definition:
        loaded = Tokenizer.from_str(definition)
        loaded.no_truncation()
        loaded.no_padding()
        kept |= {"definition": definition, "tokenizer": loaded, "lengths": {}}
    return kept["tokenizer"], kept["lengths"]


def _encode(tokenizer, words: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def splitter(definition: str):
    """(special strings' pattern or None, pre-token pattern) of a byte-level BPE definition.

    ValueError for any definition whose pre-tokens this split would not give.
    """
    d = json.loads(definition)
    pre = d["pre_tokenizer"] or {}
    plain = d["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    added = d["added_tokens"]
    if not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError("only byte-level BPE without normalizer and prefix space is split here")
    names = sorted((a["content"] for a in added), key=len, reverse=True)
    special = "|".join(regex.escape(n) for n in names)
    return special or None, PATTERN


def frequent(docs: DataFrame, definition: str, sample_rows: int = 4096, size: int = 32_768, text: str = "text") -> dict[str, int]:
    """Token lengths of up to `size` pre-tokens that are frequent in about sample_rows rows.

    Only what is found often goes into the table, and the counts do not depend on it: a
    missing pre-token is encoded where it is met. Each task of the scan counts its own share of
    the sample, the counts are added up by pre-token, and `size` of them reach the driver.
    """
    special, pattern = splitter(definition)
    n = docs.count()
    if not n:
        return {}
    sample = docs.select(F.col(text)).sample(min(1.0, sample_rows / n), seed=13)

    def count(batches):
        word, found = regex.compile(pattern), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(w for w in word.findall(t or "") if len(w) <= LONGEST)
            if len(found) > 16 * size:
                found = Counter(dict(found.most_common(4 * size)))
        top = found.most_common(size)
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["w", "c"])

    total = sample.mapInArrow(count, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")).filter("c > 1")
    words = [r["w"] for r in total.orderBy(F.desc("c"), "w").limit(size).collect()]
    return dict(zip(words, _encode(_tokenizer(definition)[0], words)))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    cache_size: int = 200_000,
    table: dict[str, int] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    n_tokens is the length of the tokenizer's own result for the whole text, without added
    special tokens; special strings inside a text count as the one token that the library
    makes of them. over_limit: more than `limit` tokens.

    Method. Byte-level BPE never joins across pre-tokens, so a text's count is the sum over
    its pre-tokens. The lengths of frequent ones (frequent()'s table, a bounded size) are
    broadcast; a miss is encoded once by the worker that meets it and kept in its cache,
    which is emptied at cache_size entries. No pre-token is ever shuffled.

    Edge cases: a null text is empty and has no tokens; a null doc_id is passed on; rows that
    repeat are counted each; a very long text is split in one stream of matches; other columns
    are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    special, pattern = splitter(definition)
    table = frequent(docs, definition, text=text) if table is None else table
    sent = spark.sparkContext.broadcast((definition, table))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text))

    def count(batches):
        definition, known = sent.value
        tokenizer, cache = _tokenizer(definition)
        word = regex.compile(pattern)
        cut = regex.compile(special) if special else None

        def lengths(words):
            """Fill the cache with the words that neither tier has."""
            new = [w for w in words if w not in known and w not in cache and len(w) <= LONGEST]
            if len(cache) + len(new) > cache_size:
                cache.clear()
                new = [w for w in words if w not in known and len(w) <= LONGEST]
            cache.update(zip(new, _encode(tokenizer, new)))

        def tokens(t):
            parts = cut.split(t) if cut and cut.search(t) else [t]
            total = len(parts) - 1
            for part in parts:
                words = word.findall(part)
                lengths(set(words))
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = cache.get(w)
                        if n is None:
                            n = _encode(tokenizer, [w])[0]
                    total += n
            return total

        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [tokens(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            over = [x > limit for x in n]
            yield pa.record_batch(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(over, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_token_counts": op4}
# No SQL engine here has the tokenizer; tests hold every count against the library's own encode().
SQL: dict[str, str] = {}

by_value(__name__)
