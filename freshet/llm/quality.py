"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import textarrays as ta
from freshet.llm.shared import by_value, documents

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
# Bytes of texts that are judged together: the rules hold some 60 bytes for each.
RUN_BYTES = 1 << 18


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Texts:
    """Some texts with what the rules share."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.words = ta.Words(data, offsets, hashes=False)
        self.n_words = self.words.counts()

    def only(self, keep: np.ndarray) -> "Texts":
        if keep.all():
            return self
        size = np.diff(self.offsets)
        data = self.data[np.repeat(keep, size)]
        return Texts(data, np.append(0, np.cumsum(size[keep])))


def n_symbols(t: Texts) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    return _sums(table[t.data], t.offsets)


def word_chars(t: Texts) -> np.ndarray:
    return _sums(t.words.inside & (t.data & 0xC0 != 0x80), t.offsets)


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the text."""
    cut = np.flatnonzero(t.data == 10)
    start = np.concatenate([t.offsets[:-1], cut + 1])
    row = np.concatenate([np.arange(len(t.offsets) - 1), np.searchsorted(t.offsets, cut, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.append(start[1:] - 1, len(t.data))
    last = np.append(row[1:] != row[:-1], True)
    end[last] = t.offsets[row[last] + 1]
    total = np.append(0, np.cumsum(t.words.inside))
    some = total[end] > total[start]
    row, value = row[some], ta.span_hashes(t.data, start[some], end[some])
    n = np.bincount(row, minlength=len(t.offsets) - 1)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    again = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    return n, np.bincount(row[1:][again], minlength=len(t.offsets) - 1)


def n_repeat_words(t: Texts) -> np.ndarray:
    """Words inside windows of WINDOW words that the text has twice or more."""
    w = t.words
    rows = w.row_of()
    value = ta.runs_of(ta.span_hashes(t.data, w.start, w.end), WINDOW)
    if not len(value):
        return np.zeros(len(t.offsets) - 1, np.int64)
    at = np.flatnonzero(rows[: len(value)] == rows[WINDOW - 1 :])
    order = at[np.lexsort((value[at], rows[at]))]
    same = (rows[order][1:] == rows[order][:-1]) & (value[order][1:] == value[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(rows) + 1, np.int64)
    np.add.at(step, order[twice], 1)
    np.add.at(step, order[twice] + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    return _sums(covered, w.rows)


def _letters(t: Texts) -> np.ndarray:
    return (t.data >= 128) | ((t.data | 32) >= 97) & ((t.data | 32) <= 122)


# The rules: each gives true for texts to reject.
def many_symbols(t: Texts) -> np.ndarray:
    """Over one symbol of markup in four words."""
    return 4 * n_symbols(t) > t.n_words


def shouting(t: Texts) -> np.ndarray:
    """Over half of the letters A-Z a-z are capitals."""
    upper = _sums((t.data >= 65) & (t.data <= 90), t.offsets)
    lower = _sums((t.data >= 97) & (t.data <= 122), t.offsets)
    return upper > lower


def without_letters(t: Texts) -> np.ndarray:
    """Over 4 in 10 words have no letter."""
    total = np.append(0, np.cumsum(_letters(t)))
    bare = total[t.words.end] == total[t.words.start]
    return 10 * _sums(bare, t.words.rows) > 4 * t.n_words


def odd_words(t: Texts) -> np.ndarray:
    """Words are under 1.5 or over 40 characters long on average."""
    chars = word_chars(t)
    return (2 * chars < 3 * t.n_words) | (chars > 40 * t.n_words)


def repeated_lines(t: Texts) -> np.ndarray:
    """At least four lines, over half of them repeats of an earlier one."""
    n, again = lines(t)
    return (n >= 4) & (2 * again > n)


def stutter(t: Texts) -> np.ndarray:
    """Over 3 in 10 words equal the word before them."""
    w = t.words
    value, rows = ta.span_hashes(t.data, w.start, w.end), w.row_of()
    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (rows[1:] == rows[:-1])
    return 10 * _sums(same, w.rows) > 3 * t.n_words


RULES = {f.__name__: f for f in (many_symbols, shouting, without_letters, odd_words, repeated_lines, stutter)}


def plan(docs: DataFrame, sample_rows: int = 4096, text: str = "text") -> list[str]:
    """Names of the rules, those first that reject most per second on about sample_rows rows.

    The order changes what the cascade costs, never its verdict.
    """
    n = docs.count()
    if not n:
        return list(RULES)
    sample = docs.select(F.col(text)).sample(min(1.0, sample_rows / n), seed=11)

    def measure(batches):
        spent, hits = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
        for batch in batches:
            for _, _, data, offsets in ta.chunks(batch.column(0), RUN_BYTES):
                texts = Texts(data, offsets)
                for name, rule in RULES.items():
                    start = time.thread_time()
                    hits[name] += int(rule(texts).sum())
                    spent[name] += time.thread_time() - start
        ta.release()
        columns = [list(RULES), list(spent.values()), list(hits.values())]
        yield pa.record_batch([pa.array(c) for c in columns], names=["rule", "spent", "hits"])

    rows = sample.mapInArrow(measure, "rule string, spent double, hits long")
    found = {r["rule"]: r["hits"] / (r["spent"] + 1e-9) for r in rows.groupBy("rule").sum("spent", "hits").toDF("rule", "spent", "hits").collect()}
    return sorted(RULES, key=lambda name: (-found.get(name, 0), name))


def judge(docs: DataFrame, order: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, base_failed and kept.

    Counts: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word that equal an earlier line) and n_repeat_words (words in windows of eight found
    twice or more). base_failed: under 20 words, or over 30 in 100 words repeat. The rules
    judge the rest in the given order (by default plan()'s); a rule sees only what all
    before it left, and the cascade stops when none is left. kept: nothing rejected it.

    Edge cases: a null or empty text has no words and fails the base; a null doc_id is passed
    on; repeated rows are judged each; other columns are not read; an empty table gives none.
    """
    order = plan(docs, text=text) if order is None else order
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in ta.chunks(batch.column(1), RUN_BYTES):
                t = Texts(data, offsets)
                repeats, failed, kept = _cascade(t, order)
                counts = [t.n_words, word_chars(t), n_symbols(t), lines(t)[1], repeats]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return source.mapInArrow(run, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean")


def filter_documents(docs: DataFrame, order: list[str] | None = None, text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they are, without a shuffle."""
    order = plan(docs, text=text) if order is None else order
    return docs.mapInArrow(_filterer(order, text), docs.schema)


def _filterer(order: list[str], text: str):
    """Hands on what each run of texts leaves, so that a task never holds its kept texts a second time."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in ta.chunks(batch.column(batch.schema.get_field_index(text)), RUN_BYTES):
                yield batch.slice(lo, hi - lo).filter(pa.array(_cascade(Texts(data, offsets), order)[2]))
            ta.release()

    return run


def _cascade(t: Texts, order: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_repeat_words, base_failed, kept); a rule runs only on texts that all before it left."""
    repeats = n_repeat_words(t)
    failed = (t.n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * t.n_words)
    kept = ~failed
    left = t.only(kept)
    for name in order:
        if not kept.any():
            break
        stays = ~RULES[name](left)
        kept[np.flatnonzero(kept)] = stays
        left = left.only(stays)
    return repeats, failed, kept


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


QUERIES = {"op5_quality_rules": op5}
SQL = {
    "op5_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS r
  FROM documents
),
g AS (
  SELECT r, p, list_slice(w, p, p + 7) AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS p FROM d WHERE len(w) >= 8)
),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, generate_series(0, 7) AS s(k) GROUP BY r),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]')) AS up, len(regexp_extract_all(text, '[a-z]')) AS low,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS bare, len(l) AS n_lines,
         len(list_filter(list_zip(w, list_slice(w, 2, len(w))), lambda z: z[1] = z[2])) AS same
  FROM d LEFT JOIN rep USING (r)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR up > low OR 10 * bare > 4 * n_words
            OR 10 * same > 3 * n_words OR 2 * word_chars < 3 * n_words OR word_chars > 40 * n_words
            OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM b
"""
}

by_value(__name__)
