"""Ranked lexical search: impact-sorted lists read in step, with bounds for each document (NRA)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import textarrays as ta
from freshet.llm.shared import Stage, by_value, documents

# Fixed value: what a term is made of, digits, letters and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Bytes of text indexed at a time, postings of documents searched at a time.
CHUNK, POSTINGS = 4 << 20, 4_000_000
# Entries of each list that the first round reads; each later round doubles the depth.
DEPTH = 64

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row of each term, terms, dictionary-encoded) of texts with A-Z lowered."""
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _TERM[data]
    edge = offsets[offsets < len(data)]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    first[edge] |= inside[edge]
    last = inside[:-1] & ~inside[1:]
    ends = edge[edge > 0]
    last[ends - 1] |= inside[ends - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    flat = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[inside[:-1]])]
    )
    return np.searchsorted(offsets, start, "right") - 1, flat.dictionary_encode()


def _parts(data: np.ndarray, offsets: np.ndarray):
    """A run of texts as it is; one long text in parts that end between terms."""
    if len(data) <= 2 * CHUNK:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data):
            stop = np.flatnonzero(~_TERM[data[end : end + CHUNK]])
            if len(stop):
                end += int(stop[0])
                break
            end += CHUNK
        end = min(end, len(data))
        yield data[at:end], np.array([0, end - at])
        at = end


def index(docs: DataFrame, terms, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a term: doc_id, n (terms with repeats), q, tf (of the broadcast `terms` it holds)."""

    def count(batches):
        wanted = pa.array(terms.value, pa.large_binary())
        size = len(terms.value)
        for batch in batches:
            for lo, hi, data, offsets in ta.chunks(batch.column(1), CHUNK):
                n, rows, keys, counts = np.zeros(hi - lo, np.int64), [], [], []
                for part, at in _parts(data, offsets):
                    row, coded = _terms(part, at)
                    n += np.bincount(row, minlength=hi - lo)
                    number = pc.fill_null(pc.index_in(coded.dictionary, wanted), -1).to_numpy().astype(np.int64)
                    number = number[coded.indices.to_numpy()]
                    key, c = np.unique((row * size + number)[number >= 0], return_counts=True)
                    keys.append(key)
                    counts.append(c)
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                tf = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
                some = np.flatnonzero(n)
                start = np.zeros(len(some) + 1, np.int32)
                start[1:] = np.searchsorted(key, (some + 1) * size)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(some)),
                        pa.array(n[some]),
                        pa.ListArray.from_arrays(pa.array(start), pa.array((key % max(size, 1)).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(start), pa.array(tf)),
                    ],
                    names=["doc_id", "n", "q", "tf"],
                )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    return source.mapInArrow(count, "doc_id long, n long, q array<int>, tf array<long>")


class Lists:
    """Impact-sorted lists of some documents: those of term q lie from start[q] to start[q + 1]."""

    def __init__(self, doc: np.ndarray, q: np.ndarray, impact: np.ndarray, terms: int, docs: int):
        order = np.lexsort((-impact, q))
        self.doc, self.impact, self.docs = doc[order], impact[order], docs
        self.start = np.searchsorted(q[order], np.arange(terms + 1))


def nra(lists: Lists, terms: np.ndarray, top: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that belong to the `top` highest scores above 0, ties with the last of them included.

    held has the scores of other documents found so far. Each round reads each list of the item
    on by as many entries as were read before. A document's lower bound is the sum of the
    impacts read; its upper bound adds, for each list it was not seen in, the next impact there.
    Reading ends when no document whose upper bound reaches the `top`-th lower bound has an
    open interval: then membership, ties and scores are all exact.
    """
    at, end = lists.start[terms], lists.start[terms + 1]
    some = np.flatnonzero(end > at)
    at, end = at[some].copy(), end[some]
    lower = np.zeros(lists.docs, np.int64)
    seen = np.zeros((len(some), lists.docs), bool)
    depth = DEPTH
    while True:
        frontier = np.array([lists.impact[a] if a < e else 0 for a, e in zip(at, end)], np.int64)
        open_ = frontier.sum() - (frontier[:, None] * seen).sum(0) if len(some) else lower
        upper = lower + open_
        best = np.concatenate([lower, held])
        bound = max(1, int(np.partition(best, len(best) - top)[len(best) - top])) if len(best) >= top else 1
        reach = upper >= bound
        if not (reach & (open_ > 0)).any():
            found = np.flatnonzero(reach)
            return found, lower[found]
        for i in range(len(some)):
            stop = min(at[i] + depth, end[i])
            doc = lists.doc[at[i] : stop]
            # A document is once in a list.
            lower[doc] += lists.impact[at[i] : stop]
            seen[i, doc] = True
            at[i] = stop
        depth *= 2


def _searcher(items, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    """Task that holds the best of its documents for each item: item, doc_id, score."""

    def blocks(batches):
        for batch in batches:
            at, offsets = 0, batch.column(2).offsets.to_numpy()
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + POSTINGS, "right")) - 1)
                yield batch.slice(at, end - at)
                at = end

    def search(batches):
        queries = items.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in queries]
        for batch in blocks(batches):
            ids, none = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy()
            offsets = batch.column(2).offsets.to_numpy()
            doc = np.repeat(np.arange(len(n)), np.diff(offsets))
            q, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            impact = weights[q] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            lists = Lists(doc, q, impact, len(weights), len(n))
            for i, terms in enumerate(queries):
                score, held, null = best[i]
                found, more = nra(lists, terms, top, score)
                if len(found):
                    score = np.concatenate([score, more])
                    held, null = np.concatenate([held, ids[found]]), np.concatenate([null, none[found]])
                    keep = np.lexsort((held, null, -score))[:top]
                    best[i] = score[keep], held[keep], null[keep]
        for i, (score, held, null) in enumerate(best):
            if len(score):
                yield pa.record_batch(
                    [pa.array(np.full(len(score), i, np.int32)), pa.array(held, mask=null), pa.array(score)],
                    names=["item", "doc_id", "score"],
                )

    return search


def rank(
    docs: DataFrame, items: DataFrame, top: int = 50, block_bytes: int = 8 << 20,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The `top` documents of each item by score: item_id, rank, doc_id, score.

    Terms are the runs of TERM with A-Z lowered. With N documents that hold a term, L terms in
    all, n in a document, df documents that hold a term t and tf occurrences in one, the
    weight of t is floor(1000 * ln((2N + 2) / (2df + 1))), m is 50 + (50 n N) div L, and a
    document scores sum of weight * ((10^9 tf) div (1000 tf + 20 m)) over the item's terms.

    Method. One pass writes each document's counts of the items' terms (an index by document);
    N, L and df come from it. Each task then sorts the impacts of its documents, some at a time,
    into one list a term and reads them by nra(). The best so far go on to the next documents of
    the task as a bound, so most lists are left early; the tasks' best, `top` an item, meet in
    one ranking. No posting is shuffled. Items are taken in blocks of about block_bytes of text
    (what is broadcast), one pass over the documents each.

    Edge cases: a null or empty text has no terms, so an item with one has no rows and such a
    document is not counted; rows of one item_id are one item with the terms of all; each of
    repeated rows of docs is a document of its own; a null doc_id comes last among ties; long
    texts are indexed in parts; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "search")
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("body")).filter("body is not null")
    total = wanted.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    lowered = F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = None
    for block in range(blocks):
        parts = wanted.filter(F.col("block") == block).select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("t"))
        queries = parts.groupBy("item_id").agg(F.collect_set("t").alias("t")).collect()
        if not queries:
            continue
        vocabulary = sorted({t for r in queries for t in r["t"]})
        number = {t: i for i, t in enumerate(vocabulary)}
        terms = spark.sparkContext.broadcast([t.encode() for t in vocabulary])
        by_doc = stage.keep(index(docs, terms, doc_id, text), "index")
        n_docs, n_terms = by_doc.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = by_doc.select(F.explode("q").alias("q")).groupBy("q").count().toArrow()
        weights = np.zeros(len(vocabulary), np.int64)
        for q, c in zip(df.column(0).to_pylist(), df.column(1).to_pylist()):
            weights[q] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1)))
        # A term of weight 0 adds nothing to any score.
        each = [np.array(sorted(number[t] for t in r["t"] if weights[number[t]] > 0), np.int64) for r in queries]
        sent = spark.sparkContext.broadcast(each)
        best = by_doc.mapInArrow(_searcher(sent, weights, n_docs, n_terms, top), "item int, doc_id long, score long")
        order = "row_number() over (partition by item order by score desc, doc_id asc nulls last)"
        best = best.withColumn("rank", F.expr(order)).filter(f"rank <= {top}")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(queries)], f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.union(best)
    if out is None:
        empty = wanted.limit(0).selectExpr("item_id", "cast(null as int) as rank", "cast(null as long) as doc_id", "cast(null as long) as score")
        return empty
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_ranked_search": op13}
SQL = {
    "op13_ranked_search": r"""
        with terms as (
            select doc_id, row_number() over () as d,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
            from documents),
        docs as (select d, doc_id, ts, len(ts)::bigint as n from terms where len(ts) > 0),
        size as (select count(*)::bigint as total, sum(n)::bigint as words from docs),
        items as (
            select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
            from benchmark),
        tf as (
            select d, t, count(*)::bigint as tf from (select d, unnest(ts) as t from docs)
            where t in (select t from items) group by d, t),
        w as (
            select t, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::bigint as w from tf, size group by t),
        scores as (
            select item_id, tf.d, any_value(doc_id) as doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * total) // words)))))::bigint as score
            from items join tf using (t) join w using (t) join docs on docs.d = tf.d, size
            group by item_id, tf.d),
        ranked as (
            select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
            from scores where score > 0)
        select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50""",
}

by_value(__name__)
