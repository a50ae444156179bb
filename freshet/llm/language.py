"""Language ID by bit-sliced Bloom filters: one probe tells all languages that have an n-gram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import textarrays as ta
from freshet.llm.shared import by_value, documents

GRAMS = (3, 4)
PROBES = 3
# A language keeps its n-grams of at least this share of its n-grams: 1 / LEAST of them at most.
LEAST = 2e-5


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, row) of the n-byte grams of words with a blank before and after, n up to 8.

    White space and ASCII punctuation, digits and controls are one blank; grams with a blank
    inside are left out, those that begin or end with one are not.
    """
    blank = data < 65
    blank |= (data > 90) & (data < 97) | (data > 122) & (data < 128)
    padded = np.full(len(data) + len(offsets), 32, np.uint8)
    # A blank stands before each text and after the last.
    shift = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    padded[np.arange(len(data)) + shift] = np.where(blank, 32, data)
    m = len(padded) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(m, np.uint64)
    empty = padded == 32
    inner = np.zeros(m, bool)
    for i in range(n):
        value |= padded[i : i + m].astype(np.uint64) << np.uint64(8 * i)
        if 0 < i < n - 1:
            inner |= empty[i : i + m]
    keep = np.flatnonzero(~inner & ~(empty[:m] & empty[n - 1 :]))
    start = offsets[:-1] + np.arange(len(offsets) - 1)
    return value[keep] | np.uint64(n) << np.uint64(56), np.searchsorted(start, keep, "right") - 1


def _slots(values: np.ndarray, bits: int):
    mixed = ta.mix(values)
    for i in range(PROBES):
        yield ((mixed >> np.uint64(20 * i)) & np.uint64((1 << bits) - 1)).astype(np.intp)


@dataclass
class Filters:
    """Bloom filters of all languages, sliced by slot: bit l of word[slot] is language l's."""

    languages: list[str]
    words: np.ndarray  # slots x ceil(languages / 64)
    false_rate: np.ndarray

    def lookup(self, values: np.ndarray, word: int) -> np.ndarray:
        """Mask of the languages (of one word of 64) whose filter holds each n-gram."""
        bits = int(np.log2(len(self.words)))
        masks = np.full(len(values), np.uint64(0xFFFFFFFFFFFFFFFF))
        for slot in _slots(values, bits):
            masks &= self.words[slot, word]
        return masks


def learn(
    docs: DataFrame, sample_rows: int = 20_000, bits: int = 20, text: str = "text", lang: str = "lang"
) -> Filters:
    """Filters from texts with a language; no other column is read.

    About sample_rows rows, drawn alike from all labelled ones, are read (the documented bound
    of the learning sample). Each language keeps the n-grams that make up LEAST or more of
    its own, 50,000 at most at the default.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    n = labelled.count()
    sample = labelled.sample(min(1.0, sample_rows / n), seed=17) if n else labelled

    def count(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
            for lo, hi, data, offsets in ta.chunks(pc.utf8_lower(batch.column(0))):
                for size in GRAMS:
                    value, row = grams(data, offsets, size)
                    code = codes[lo:hi][row]
                    for c in np.unique(code):
                        v, k = np.unique(value[code == c], return_counts=True)
                        yield pa.record_batch(
                            [pa.array([names[int(c)].as_py()] * len(v), pa.string()), pa.array(v.view(np.int64)), pa.array(k)],
                            names=["lang", "gram", "c"],
                        )

    counts = sample.mapInArrow(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    total = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    kept = counts.join(F.broadcast(total), "lang").filter(F.col("c") >= LEAST * F.col("total")).select("lang", "gram").toArrow()
    languages = sorted(set(kept.column(0).to_pylist()))
    words = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    codes = np.searchsorted(np.array(languages, object), kept.column(0).to_numpy()) if languages else np.zeros(0, int)
    values = kept.column(1).to_numpy().view(np.uint64)
    for i in range(len(languages)):
        for slot in _slots(values[codes == i], bits):
            words[slot, i // 64] |= np.uint64(1 << (i % 64))
    fill = np.array([np.mean(words[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
    return Filters(languages, words, fill**PROBES)


def identify(
    docs: DataFrame, filters: Filters, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Each of a text's n-grams is probed once for all languages. A language's popcount x over n
    n-grams is corrected for its filter's rate f of false positives, (x - n f) / (1 - f); the
    highest wins, the first by name of equals. score is its share of all corrected counts, or
    1 / languages where no n-gram is known.

    Edge cases: a null text or one without a letter is `und` with score 0, and so is every text
    if nothing was learned; a null doc_id is passed on; repeated rows are told each; other
    columns are not read; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    out = F.lit(False) if held_out is None else held_out
    source = docs.select(
        F.col(doc_id).alias("doc_id"), out.alias("held_out"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("ok"), F.col(text)
    )

    def tell(batches):
        f = sent.value
        k = len(f.languages)
        for batch in batches:
            for lo, hi, data, offsets in ta.chunks(pc.utf8_lower(batch.column(3).fill_null(""))):
                hits, n = np.zeros((k, hi - lo)), np.zeros(hi - lo)
                for size in GRAMS:
                    value, row = grams(data, offsets, size)
                    n += np.bincount(row, minlength=hi - lo)
                    for word in range(f.words.shape[1] if k else 0):
                        masks = f.lookup(value, word)
                        for i in range(64 * word, min(k, 64 * word + 64)):
                            hit = (masks >> np.uint64(i % 64)) & np.uint64(1) == 1
                            hits[i] += np.bincount(row[hit], minlength=hi - lo)
                ok = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool) & (k > 0)
                names, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if k:
                    rate = f.false_rate[:, None]
                    right = np.maximum(0, (hits - n * rate) / np.maximum(1 - rate, 1e-9))
                    best, total = right.argmax(0), right.sum(0)
                    names[ok] = np.array(f.languages, object)[best[ok]]
                    score = np.where(ok, np.where(total > 0, right.max(0) / np.maximum(total, 1e-9), 1 / k), 0.0)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tell, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, learn(docs.filter(~held_out)), held_out)


QUERIES = {"op7_language_id": op7}
# A learned model is no SQL; tests hold its accuracy on held-out rows and its filters against exact sets.
SQL: dict[str, str] = {}

by_value(__name__)
