"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import textarrays as ta
from freshet.llm.shared import WORD, Stage, by_value, documents, merge_buckets, runtime_filter

CHARS = 10
BANDS, ROWS = 10, 3
# Comparisons left for each line that meets another, below which turns are not worth their while.
LEFT_PER_ROW = 20
# Longs of parity bits: a bit tells whether an odd number of a line's shingles fall on it.
PARITY = 16
# Bytes of lines that are looked at together.
RUN_BYTES = 1 << 17
# Lines that a task remembers to sign repeated ones once, rows of buckets that are sorted together.
SEEN, DEALT = 1 << 16, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240602).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix32(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A polynomial of each `size` codes that follow each other, put together from those of powers of two."""
    bits, kind = codes.dtype.itemsize * 8, codes.dtype.type
    out, have, step, power = None, 0, 1, codes
    while True:
        shift = kind(pow(_BASE, step, 1 << bits))
        if size & step:
            if out is None:
                out = power
            else:
                m = len(codes) - have - step + 1
                out = out[:m] * shift + power[have : have + m]
            have += step
        if have == size:
            return out
        power = power[:-step] * shift + power[step:]
        step *= 2


def _hashes(data: np.ndarray, offsets: np.ndarray, chars: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place by line, number by line, hashes by place) of all runs of `chars` characters.

    A shorter line is one run; places between the runs of two lines hold no run.
    """
    # A character starts at each byte that does not go on with another one.
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    table = _TABLE.astype(kind)
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        begin, codes = offsets, table[data]
    else:
        begin, codes = np.searchsorted(at, offsets), table[data[at]]
        size = np.diff(np.append(at, len(data)))
        wide = np.flatnonzero(size > 1)
        # Characters of several bytes are hashed by themselves, side by side.
        lead[at[wide]] = False
        stop = np.cumsum(size[wide])
        codes[wide] = ta.span_hashes(data[~lead], stop - size[wide], stop).astype(kind)
    size = np.diff(begin)
    n = np.maximum(size - chars + 1, np.minimum(size, 1))
    # Each character has a place, and one more ends the last line.
    values = _windows(np.concatenate([codes, np.zeros(chars, kind)]), chars)
    values = _mix32(values) if kind is np.uint32 else ta.mix(values)
    short = np.flatnonzero((size > 0) & (size < chars))
    if len(short):
        values[begin[short]] = ta.span_hashes(data, offsets[short], offsets[short + 1]).astype(kind)
    return begin[:-1], n, values


def _shingles(data: np.ndarray, offsets: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(number by line, hashes in order) of all runs of `chars` characters; a shorter line is one run."""
    begin, n, values = _hashes(data, offsets, chars, np.uint64)
    some = n > 0
    edge = np.zeros(len(values) + 1, np.int8)
    edge[begin[some]] += 1
    edge[(begin + n)[some]] -= 1
    return n, values[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]


def _sets(n: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(line numbers, line number and hash in one, bits of the hash) of the distinct shingles of each line.

    As many low bits of a hash give way as the line number takes, so two shingles of a run of
    lines fall together about as seldom as 64-bit hashes of its whole text do.
    """
    room = 64 - int(len(n)).bit_length()
    line = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    both = np.sort((line << np.uint64(room)) | (hashes >> np.uint64(64 - room)))
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    return (both >> np.uint64(room)).astype(np.int64), both, room


def _lists(values: np.ndarray, without: np.ndarray | None = None) -> pa.Array:
    """A list of each row of values, null where `without` says so."""
    rows, width = values.shape
    offsets = pa.array(np.arange(0, width * rows + 1, width, dtype=np.int32))
    mask = None if without is None else pa.array(without)
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64).ravel()), mask=mask)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _signer(chars: int, once: bool):
    """A key for each band, by line; with `once` a repeat of a line that the task remembers has no line and keys."""

    def sign(batches):
        draw = np.random.default_rng(11)
        odd = (draw.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
        seen = np.zeros((2, SEEN), np.int64)
        for batch in batches:
            lines = _column(batch, "line")
            blank = lines.is_null().to_numpy(zero_copy_only=False)
            if once:
                filled = np.flatnonzero(~blank)
                h = np.array([np.asarray(_column(batch, c).take(pa.array(filled))) for c in ("h1", "h2")], np.int64).reshape(2, -1)
                slot = h[0] & (SEEN - 1)
                again = (seen[:, slot] == h).all(axis=0)
                order = np.lexsort((h[1], h[0]))
                again[order[1:]] |= (h[:, order[1:]] == h[:, order[:-1]]).all(axis=0)
                seen[:, slot] = h
                blank[filled[again]] = True
                lines = pc.if_else(pa.array(blank), pa.scalar(None, lines.type), lines)
            batch = batch.set_column(batch.schema.get_field_index("line"), "line", lines)
            for lo, hi, data, offsets in ta.chunks(lines, RUN_BYTES):
                begin, n, values = _hashes(data, offsets, chars, np.uint32)
                some = np.flatnonzero(n)
                keys = np.zeros((len(n), BANDS), np.uint64)
                if len(some):
                    # The shingles of a line, and then the places to the next line.
                    cuts = np.stack([begin[some], (begin + n)[some]], axis=1).ravel()
                    turned = np.empty_like(values)
                    for band in range(BANDS):
                        key = np.full(len(some), band + 1, np.uint64)
                        for k in range(band * ROWS, band * ROWS + ROWS):
                            np.multiply(values, odd[k], out=turned)
                            low = np.minimum.reduceat(turned, cuts)[::2]
                            key = ta.mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
                        keys[some, band] = key
                own = batch.slice(lo, hi - lo)
                yield pa.record_batch([*own.columns, _lists(keys, blank[lo:hi])], names=[*own.schema.names, "keys"])
        ta.release()

    return sign


def signatures(lines: DataFrame, chars: int = CHARS, once: bool = False) -> DataFrame:
    """Adds keys (one of each band) to rows with a column `line`; null where that is.

    With `once` rows have hashes h1 and h2, and of equal lines one in a task stays, or some
    that are far from each other: `line` and `keys` of the others are null.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(_signer(chars, once), f"{columns}, keys array<long>")


def _shared(batches):
    """h1 of rows (key, h1) whose key another h1 has as well, each once at least.

    Rows are sorted DEALT at a time, and one of each key goes along: what is held grows with
    the keys of a task, never with the rows of one.
    """

    def settle(key, h, told):
        order = np.argsort(key)
        key, h, told = key[order], h[order], told[order]
        first = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(key)))
        many = size > 1
        low, high = np.minimum.reduceat(h, start), np.maximum.reduceat(h, start)
        met = low < high
        tell = np.repeat(many & met, size) & ~told
        return (key[start], h[start], np.logical_or.reduceat(told, start) | met), h[tell]

    state, parts, rows = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool)), [], 0
    for batch in batches:
        key, h = (np.asarray(c) for c in batch.columns)
        parts.append((key, h, np.zeros(len(key), bool)))
        rows += len(key)
        if rows >= DEALT:
            state, found = settle(*(np.concatenate(x) for x in zip(state, *parts)))
            parts, rows = [], 0
            yield pa.record_batch([pa.array(found)], names=["h1"])
    if rows:
        state, found = settle(*(np.concatenate(x) for x in zip(state, *parts)))
        yield pa.record_batch([pa.array(found)], names=["h1"])
    ta.release()


def _sketcher(chars: int):
    """Number of distinct shingles and parity bits, by line."""

    def sketch(batches):
        bits = 64 * PARITY
        for batch in batches:
            for lo, hi, data, offsets in ta.chunks(_column(batch, "line"), RUN_BYTES):
                n, hashes = _shingles(data, offsets, chars)
                line, both, room = _sets(n, hashes)
                place = (both >> np.uint64(room - 32)).astype(np.int64) % bits
                odd = np.bincount(line * bits + place, minlength=len(n) * bits).astype(np.uint8) & 1
                parity = np.packbits(odd.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).reshape(-1, PARITY)
                count = np.bincount(line, minlength=len(n)).astype(np.int32)
                own = batch.slice(lo, hi - lo)
                yield pa.record_batch([*own.columns, pa.array(count), _lists(parity)], names=[*own.schema.names, "n", "parity"])
        ta.release()

    return sketch


def sketches(lines: DataFrame, chars: int = CHARS) -> DataFrame:
    """Adds n (distinct shingles) and parity to rows with a column `line`."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(_sketcher(chars), f"{columns}, n int, parity array<long>")


def _linker(chars: int, percent: int):
    """Of rows (a, b, la, lb) the pairs whose sets of shingles are alike."""

    def link(batches):
        for batch in batches:
            a, b, la, lb = batch.columns
            bytes_ = np.asarray(pc.binary_length(la)).astype(np.int64) + np.asarray(pc.binary_length(lb))
            ends = np.cumsum(bytes_)
            at = 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
                room = 64 - int(stop - at).bit_length()
                sizes, keys = [], []
                for ids, side in ((a, la), (b, lb)):
                    # A line of several pairs is looked at once, and its set goes to each of them.
                    _, first, of = np.unique(np.asarray(ids)[at:stop], return_index=True, return_inverse=True)
                    run = side.take(pa.array(first + at))
                    ((_, _, data, offsets),) = ta.chunks(run, int(ends[stop - 1] - before) + 1)
                    line, both, own = _sets(*_shingles(data, offsets, chars))
                    count = np.bincount(line, minlength=len(first))
                    size, start = count[of], (np.cumsum(count) - count)[of]
                    place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                    # Both sides have room for the same numbers of pairs.
                    low = (both & np.uint64((1 << own) - 1)) >> np.uint64(own - room)
                    pair = np.repeat(np.arange(stop - at, dtype=np.uint64), size)
                    sizes.append(size)
                    keys.append((pair << np.uint64(room)) | low[place])
                merged = np.sort(np.concatenate(keys), kind="stable")
                twice = merged[1:][merged[1:] == merged[:-1]] >> np.uint64(room)
                shared = np.bincount(twice.astype(np.int64), minlength=stop - at)
                alike = pa.array(100 * shared >= percent * (sizes[0] + sizes[1] - shared))
                yield pa.record_batch([c.slice(at, stop - at).filter(alike) for c in (a, b)], names=["a", "b"])
                at = stop
        ta.release()

    return link


def _possible(percent: int) -> str:
    """SQL that every link meets: each parity bit that differs needs a shingle that one line alone has."""
    bits = [f"bit_count(parity_a[{i}] ^ parity_b[{i}])" for i in range(PARITY)]
    sizes = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    # Some of the bits alone rule most pairs out.
    return " and ".join([sizes, *[f"{100 + percent} * ({' + '.join(bits[:k])}) <= {100 - percent} * (n_a + n_b)" for k in (PARITY // 2, PARITY)]])


def duplicate_lines(docs: DataFrame, chars: int = CHARS, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line of each row of docs: row, doc_id, line_no, keep_doc, keep_line, kept.

    Lines are what line feeds separate; they are compared trimmed and in small letters. Two
    lines are linked when 100 * intersection >= percent * union of their sets of `chars`
    characters; of each component the line with the least (doc_id, row, line_no) is kept, null
    ids last, and keep_doc and keep_line name it. A line without a word has nulls there and stays.

    Method. Lines are split, hashed and signed where they are read; a task signs a line that it
    remembers once. Equal lines collapse by two 64-bit hashes. Lines meet in buckets of BANDS
    bands of ROWS MinHash coordinates of all shingles (a pair
    that is 0.8 alike is missed once in 1,300 times), are compared by merge_buckets(), exactly
    (unless their numbers of shingles or the parity bits of these rule a link out, which loses
    none), and joined by distributed union-find. Shingles are made in Arrow batches: in native
    functions each costs a microsecond (see the README). No group is gathered in one task.

    Edge cases: a null or empty text has one line without a word; each row of docs is a
    document by itself, whether its doc_id is repeated or null (`row` tells them apart; of
    equal rows any may come first); a line shorter than `chars` is one shingle, so it only links equal ones;
    other columns are not read; an empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "lines", lean=True)

    # Rows get numbers here alone (before their lines are told apart), which are fixed once this is written.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    lines = rows.select("row", "doc_id", F.posexplode(parts).alias("line_no", "line"))
    lines = lines.withColumn("line", F.when(F.col("line").rlike(WORD), F.lower(F.trim("line"))))
    lines = lines.withColumns({f"h{i}": F.when(F.col("line").isNotNull(), F.xxhash64(F.lit(i), "line")) for i in (1, 2)})
    signed = stage.keep(signatures(lines, chars, once=True), "signed")
    slim = signed.select("row", "doc_id", "line_no", "h1", "h2")
    filled = slim.filter("h1 is not null")
    # Lines that share a bucket with another, told apart by their first hash.
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), BANDS * signed.count() // DEALT + 1)
    shared = signed.select(F.explode("keys").alias("key"), "h1").repartition(n, "key").mapInArrow(_shared, "h1 long")
    some = stage.keep(shared.groupBy("h1").agg(F.count("*").alias("buckets")), "some")
    # A line that meets another gets a number; most that meet none are told by a filter and not shuffled.
    texts = signed.filter("keys is not null").select("h1", "h2", "line", "keys").join(some.filter("buckets > 0"), "h1", "left_semi")
    texts = texts.groupBy("h1", "h2").agg(F.first(F.struct("line", "keys")).alias("x")).select("h1", "h2", "x.*")
    met = sketches(texts.withColumn("id", F.monotonically_increasing_id()), chars)
    met = stage.keep(met, "met", runtime_filter(some.count()))
    bounds = met.select("id", "keys", "n", "parity")
    stage.drop(some)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(met.selectExpr("id as a", "line as la"), "a").join(met.selectExpr("id as b", "line as lb"), "b")
        return both.select("a", "b", "la", "lb").mapInArrow(_linker(chars, percent), "a long, b long")

    labels = merge_buckets(stage, bounds, ["n", "parity"], _possible(percent), verify, LEFT_PER_ROW * met.count(), hubs=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")
    first = filled.groupBy("h1", "h2").agg(F.min(order).alias("k"), F.count("*").alias("c"))
    # A line that is alone keeps itself.
    keeper = first.filter("c > 1").drop("c")
    if labels is not None:
        first = stage.keep(first, "first")
        named = stage.keep(labels.withColumnRenamed("node", "id").join(met.select("id", "h1", "h2"), "id").drop("id"), "named")
        own = stage.keep(first.join(named, ["h1", "h2"]), "own")
        least = own.groupBy("component").agg(F.min("k").alias("least"))
        linked = own.join(least, "component").select("h1", "h2", "least")
        keeper = first.join(linked, ["h1", "h2"], "left").filter("c > 1 or least is not null")
        keeper = stage.keep(keeper.select("h1", "h2", F.coalesce("least", "k").alias("k")), "keeper")
        stage.drop(first, named, own)
    stage.drop(met)
    told = filled.join(keeper, ["h1", "h2"], "left").select(
        "row", "doc_id", "line_no",
        F.expr("if(k is null, doc_id, k.doc_id)").alias("keep_doc"), F.expr("if(k is null, line_no, k.line_no)").alias("keep_line"),
        F.expr("k is null or row = k.row and line_no = k.line_no").alias("kept"),
    )
    blank = slim.filter("h1 is null").selectExpr("row", "doc_id", "line_no", "cast(null as long)", "cast(null as int)", "true")
    return told.union(blank)


def by_document(lines: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (with a word), n_dropped, dropped.

    dropped lists the lines that go, each with the line that stays: line_no:doc_id:line_no,
    by line number, joined by commas (the doc_id left out where it is null).
    """
    name = F.concat_ws(":", "line_no", F.coalesce(F.col("keep_doc").cast("string"), F.lit("")), "keep_line")
    named = F.when(~F.col("kept"), F.struct("line_no", name.alias("name")))
    grouped = lines.groupBy("row", "doc_id").agg(F.count("keep_line").alias("n_lines"), F.array_sort(F.collect_list(named)).alias("gone"))
    return grouped.select(
        "doc_id", "n_lines", F.size("gone").cast("long").alias("n_dropped"), F.array_join(F.col("gone.name"), ",").alias("dropped")
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(duplicate_lines(documents(spark, sf_dir)))


QUERIES = {"op8_line_dedup": op8}
# Sets of all lines, each pair that shares one and the closure of links: tests use brute force.
SQL: dict[str, str] = {}

by_value(__name__)
