"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import textarrays as ta
from freshet.llm.shared import Stage, by_value, documents, merge_buckets

UNIVERSE_BITS = 20
# From so many comparisons left a document, they are done at once.
LEFT_PER_ROW = 20
# Longs of 30 two-bit coordinates that a sketch keeps.
SKETCH = 4
# Longs of parity bits: bit i tells whether an odd number of shingles fall on i.
PARITY = 8


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of `words` words (A-Z lowered, split at
    ASCII white space); a shorter text is one shingle. Two documents are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable.

    Method. One permutation spreads the shingles over a fixed universe (sigma, a hash); a
    second one (pi) is shifted circularly by k to give coordinate k of the signature. Bands
    of `rows` coordinates are bucket keys: at a similarity of 0.8 a pair shares at least one
    of 24 bands of 5 with probability 0.99993. Equal sets collapse first. In a bucket, one
    leader at a time is compared with the members of other components, and links merge
    components, so a large group of copies costs one pair per member, not all pairs. What is
    left (members outside a bucket's largest component) is compared with all members of
    other components. Three bounds spare pairs the exact comparison: sizes too unlike; more
    differing parity bits than shingles may differ (each such bit needs one of its own, so
    no link is lost); 120 two-bit coordinates that agree six deviations too rarely (one true
    pair in a billion). All others are compared exactly, on full sets.

    Edge cases: a null or empty text, or one without words, has an empty set, is linked with
    nothing and stays. A row without doc_id stays, with a null component. Rows that repeat a
    doc_id are one document: all of them get its answer. Other columns are not read, so
    their names cannot clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near")
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))

    sets = stage.keep(
        source.mapInArrow(_signer(words, bands, rows), "id long, n long, f1 long, f2 long, keys array<long>, sketch array<long>, parity array<long>"), "sets"
    )
    # Equal sets: the smallest id stands for all.
    first = stage.keep(
        sets.filter("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "first"
    )
    member = stage.keep(
        sets.join(first, ["f1", "f2", "n"], "left").selectExpr(
            "id",
            "n",
            "case when id is not null then coalesce(rep, id) end as rep",
            *[f"case when id = rep then {c} end as {c}" for c in ("keys", "sketch", "parity")],
        ),
        "member",
    )
    stage.drop(sets, first)
    entry = member.filter("keys is not null").select(F.explode("keys").alias("key"), F.col("rep").alias("id")).distinct()
    agree = _least_agreement(bands * rows, percent)
    shared = stage.keep(entry.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "keys")
    ids = stage.keep(entry.join(shared, "key", "left_semi").select("id").distinct(), "ids")
    # Sketches and texts of the documents that meet another one.
    met = member.filter("keys is not null").select(F.col("rep").alias("id"), "n", "keys", "sketch", "parity").dropDuplicates(["id"])
    met = stage.keep(met.join(ids, "id", "left_semi"), "met")
    texts = stage.keep(source.join(ids, "id", "left_semi").groupBy("id").agg(F.min("t").alias("t")), "texts")
    size = member.count()
    stage.drop(shared, ids)

    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    near += f" and {100 + percent} * {_differing()} <= {100 - percent} * (n_a + n_b) and {_agreement()} >= {agree}"
    labels = merge_buckets(
        stage, met, ["n", "sketch", "parity"], near, lambda pairs: _verified(pairs, texts, words, percent), LEFT_PER_ROW * size
    )
    stage.drop(met, texts)
    out = member.select("id", "n", "rep")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    return out.selectExpr(
        "id as doc_id",
        "n as n_shingles",
        "coalesce(component, rep) as component_id",
        "coalesce(id = coalesce(component, rep), true) as kept",
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without all but one of each group of near-duplicates.

    Rows go by a number that they get once docs is written: of a group the row with the least
    doc_id stays (null last, of equal ones the first), so a doc_id that two texts have, or none,
    does no harm. Rows without a word stay.
    """
    stage = Stage(docs.sparkSession, "single")
    # The written table fixes the numbers: signatures and texts must read the same.
    rows = stage.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, words, percent, doc_id="_row", text=text)
    groups = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", F.col(doc_id).alias("_id")), "_row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(docs.columns)


def _signer(words: int, bands: int, rows: int):
    """Set size, two 64-bit fingerprints of the set, a key for each band, sketch and parity bits."""

    def sign(batches):
        size, hashes = 1 << UNIVERSE_BITS, bands * rows
        pi = np.random.default_rng(7).permutation(size).astype(np.int32)
        pi = np.concatenate([pi, pi[:hashes]])
        mask = np.uint64(size - 1)
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            for lo, hi, data, offsets in ta.chunks(texts):
                start, value = ta.shingle_sets(ta.Words(data, offsets, lower=True), words)
                n = np.diff(start)
                some = np.flatnonzero(n)
                keys = np.zeros((len(n), bands), np.int64)
                bits = np.zeros((len(n), SKETCH), np.int64)
                prints = np.zeros((2, len(n)), np.uint64)
                odd = np.zeros((len(n), PARITY), np.int64)
                if len(some):
                    at = start[:-1][some]
                    for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                        prints[i, some] = np.add.reduceat(ta.mix(value ^ np.uint64(salt)), at)
                    spread = ta.mix(value ^ np.uint64(0x082EFA98EC4E6C89))
                    bit, word = np.uint64(1) << (spread & np.uint64(63)), (spread >> np.uint64(6)) % np.uint64(PARITY)
                    for w in range(PARITY):
                        odd[some, w] = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), at).view(np.int64)
                    sigma = (ta.mix(value + np.uint64(0xA4093822299F31D0)) & mask).astype(np.intp)
                    for band in range(bands):
                        key = np.full(len(some), band + 1, np.uint64)
                        for k in range(band * rows, band * rows + rows):
                            low = np.minimum.reduceat(pi[k:].take(sigma), at)
                            key = ta.mix(key * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64))
                            if k < 30 * SKETCH:
                                bits[some, k // 30] |= (low & 3).astype(np.int64) << (2 * (k % 30))
                        keys[some, band] = key.view(np.int64)
                used = np.zeros(len(n) + 1, np.int32)
                used[1:] = np.cumsum(np.where(n > 0, bands, 0))
                yield pa.record_batch(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n.astype(np.int64)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(used), pa.array(keys[some].ravel())),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, SKETCH * len(n) + 1, SKETCH, dtype=np.int32)), pa.array(bits.ravel())
                        ),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, PARITY * len(n) + 1, PARITY, dtype=np.int32)), pa.array(odd.ravel())
                        ),
                    ],
                    names=["id", "n", "f1", "f2", "keys", "sketch", "parity"],
                )
        ta.release()

    return sign


def _agreement() -> str:
    """SQL: in how many of the 30 * SKETCH kept coordinates two sketches agree."""
    each = []
    for i in range(SKETCH):
        x = f"(sketch_a[{i}] ^ sketch_b[{i}])"
        each.append(f"30 - bit_count(({x} | shiftright({x}, 1)) & 6148914691236517205L)")
    return "(" + " + ".join(each) + ")"


def _differing() -> str:
    """SQL: how many parity bits differ, at most the number of shingles that one set alone has."""
    return "(" + " + ".join(f"bit_count(parity_a[{i}] ^ parity_b[{i}])" for i in range(PARITY)) + ")"


def _least_agreement(hashes: int, percent: int) -> int:
    """Six deviations below what a pair at the threshold agrees in; at two bits, a quarter agrees by chance."""
    n = 30 * SKETCH
    if hashes < n:
        return 0
    p = percent / 100 + (1 - percent / 100) / 4
    return int(n * p - 6 * (n * p * (1 - p)) ** 0.5)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""

    def verify(batches):
        for batch in batches:
            n = batch.num_rows
            ids = [batch.column(i).to_numpy() for i in (0, 1)]
            all_ids, at, back = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
            both = pa.chunked_array([batch.column(2), batch.column(3)]).take(pa.array(at)).combine_chunks()
            sets = []
            for _, _, data, offsets in ta.chunks(both):
                start, value = ta.shingle_sets(ta.Words(data, offsets, lower=True), words)
                sets += [value[i:j] for i, j in zip(start[:-1], start[1:])]
            good = np.zeros(n, bool)
            for i in range(n):
                a, b = sets[back[i]], sets[back[n + i]]
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good[i] = 100 * shared >= percent * (len(a) + len(b) - shared)
            keep = pa.array(good)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
        ta.release()

    with_a = pairs.join(texts.selectExpr("id as a", "t as ta"), "a")
    with_both = with_a.join(texts.selectExpr("id as b", "t as tb"), "b").select("a", "b", "ta", "tb")
    return with_both.mapInArrow(verify, "a long, b long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2)


QUERIES = {"op9_near_dedup": op9}
# Shingle sets of all documents, every pair that shares one, and the closure of the links
# would take SQL hours on whole tables: the brute-force test stands for it.
SQL: dict[str, str] = {}

by_value(__name__)
