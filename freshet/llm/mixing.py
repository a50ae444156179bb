"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.shared import WORD, Stage, by_value, documents

WEIGHTS = (5, 2, 1)


def target_tokens(sizes: dict, weights: dict, total: float, most: float = 2.0) -> dict:
    """total shared by weight; no target is over `most` times its size, the excess is reshared."""
    targets, free, left = {}, sorted(sizes, key=lambda s: (s is None, s or "")), total
    while free:
        share = sum(weights[s] for s in free)
        full = [s for s in free if left * weights[s] / share > most * sizes[s]]
        if not full:
            targets |= {s: left * weights[s] / share for s in free}
            break
        for s in full:
            targets[s] = most * sizes[s]
        left -= sum(targets[s] for s in full)
        free = [s for s in free if s not in targets]
    return targets


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Integer quotas: each seat goes to the highest votes / (2 * seats so far + 1), never over `most`.

    A divisor is bisected until the quotients above it are no more than the seats; a party has
    those for sure, less one for rounding, and a heap gives the few seats left one by one. Ties
    go to the earlier party.
    """

    def above(divisor: float) -> list[int]:
        return [min(m, int((v / divisor + 1) / 2)) if v > 0 else 0 for v, m in zip(votes, most)]

    low, high = 0.0, 2.0 * max(votes, default=0.0) + 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if low < middle < high:
            low, high = (low, middle) if sum(above(middle)) <= seats else (middle, high)
    quota = [max(0, q - 1) for q in above(high)]
    heap = [(-v / (2 * q + 1), i) for i, (v, q, m) in enumerate(zip(votes, quota, most)) if q < m and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(quota)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        quota[i] += 1
        if quota[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * quota[i] + 1), i))
    return quota


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block: int = 64,
    shard_tokens: int = 250_000,
    shard_rows: int = 50_000,
    max_cells: int = 1_000_000,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    row: str | None = None,
) -> DataFrame:
    """Which words of each document the mix takes.

    One row per document: doc_id, size (words), source, source_size, target (its source's
    tokens), taken (words, repeats counted) and spans, an array of (pass, first, end): the
    word ranges that each pass over the document takes, end exclusive. `row` names a column of
    docs that the result has too.

    Sources in code point order, null last, have the weights in turn; `share` of all tokens is
    shared by weight, none over `most` times its source's tokens.

    Method. Documents go to shards of about shard_tokens tokens or shard_rows rows of their
    source, whichever makes more shards, by a seeded hash of doc_id and text, and stand there in
    the order of another. Documents without words stand in no shard. Their words, end to end, are cut into
    blocks of `block` tokens. The blocks of the whole mix are apportioned to the sources by
    Sainte-Laguë, and each source's blocks to its shards in the same way, a shard having
    `most` times its blocks at most. A shard with quota q of n blocks takes all of them
    q // n times and once more those q % n whose numbers hash lowest (equal
    64-bit hashes would be taken together). Reruns agree.

    Only sizes move: one row per (source, shard) cell comes to the driver, and shards are
    taken larger once there would be more than max_cells cells. ValueError if there are more
    sources than that. A hot source has as many shards as its tokens and rows need.

    Edge cases: a null text has no words; such documents and empty ones take none; a null
    source is a source; a null doc_id is hashed as null, with its text; rows that repeat a doc_id are mixed
    each by itself (of rows equal in doc_id, source and text, reruns may swap the ranges);
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mix")
    own = [row] if row else []
    slim = stage.keep(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(text)).alias("h"),
            *own,
        ),
        "sizes",
    )
    by_source = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n"))
    rows = by_source.limit(max_cells + 1).collect()
    if len(rows) > max_cells:
        raise ValueError(f"more than {max_cells} sources")
    sizes, filled = {r["source"]: r["size"] for r in rows}, {r["source"]: r["n"] for r in rows}
    # Python orders strings by code point.
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(sizes.values())
    targets = target_tokens(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * total, most)
    # Half of the cells are for tokens, half for rows.
    half = max(1, (max_cells - len(names)) // 2)
    grain, grain_rows = max(shard_tokens, -(-total // half)), max(shard_rows, -(-sum(filled.values()) // half))
    table = spark.createDataFrame(
        [(s, sizes[s], float(targets[s]), max(1, -(-sizes[s] // grain), -(-filled[s] // grain_rows))) for s in names],
        "source string, source_size long, target double, shards long",
    )
    placed = _join(slim, table, ["source"])
    # A document without words has no shard: it takes nothing and need not meet others.
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.col("shards"))
    placed = placed.withColumn("shard", F.when(F.col("size") > 0, shard))
    empty, placed = placed.filter("size = 0"), placed.filter("size > 0")
    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("tokens")).collect()
    quotas = _quotas(cells, names, targets, block, most)
    quota = spark.createDataFrame(quotas, "source string, shard long, blocks long, passes long, extra long")
    quota = stage.keep(quota, "quota")

    # By rows: with a range, equal rows would all stand at the end of the last of them.
    order = Window.partitionBy("source", "shard").orderBy("mark", "doc_id", "size", "h")
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("mark", F.xxhash64(F.lit(seed + 1), "doc_id", "h")).withColumn("stop", F.sum("size").over(order))
    run = run.unionByName(empty.withColumn("stop", F.lit(0).cast("long")), allowMissingColumns=True)
    run = stage.keep(run.select("doc_id", "size", "source", "source_size", "target", "shard", "stop", *own), "run")
    # The blocks that get one more pass are those up to the `extra`-th lowest hash of a shard.
    numbered = quota.filter("extra > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    numbered = numbered.withColumn("lot", F.xxhash64(F.lit(seed + 2), "source", "shard", "block"))
    rank = Window.partitionBy("source", "shard").orderBy("lot")
    cut = numbered.withColumn("rank", F.row_number().over(rank)).filter("rank = extra")
    plan = _join(quota.select("source", "shard", "passes"), cut.select("source", "shard", F.col("lot").alias("cut")), ["source", "shard"], "left")
    plan = stage.keep(plan, "plan")

    start, stop = F.col("stop") - F.col("size"), F.col("stop")
    out = _join(run, plan, ["source", "shard"], "left").withColumn("passes", F.coalesce("passes", F.lit(0)).cast("long"))
    first, last = F.floor(start / block), F.floor((stop - 1) / block)
    none = F.array().cast("array<long>")
    touched = F.when(
        F.col("cut").isNotNull() & (F.col("size") > 0),
        F.filter(F.sequence(first, last), lambda b: F.xxhash64(F.lit(seed + 2), "source", "shard", b) <= F.col("cut")),
    ).otherwise(none)
    extra = F.transform(
        touched,
        lambda b: F.struct(
            F.col("passes").alias("pass"),
            (F.greatest(b * block, start) - start).alias("first"),
            (F.least((b + 1) * block, stop) - start).alias("end"),
        ),
    )
    whole = F.when(
        (F.col("passes") > 0) & (F.col("size") > 0),
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("passes") - 1),
            lambda p: F.struct(p.alias("pass"), F.lit(0).cast("long").alias("first"), F.col("size").alias("end")),
        ),
    )
    kind = "array<struct<pass:bigint,first:bigint,end:bigint>>"
    spans = F.when(F.col("size") > 0, F.concat(F.coalesce(whole, F.array().cast(kind)), F.coalesce(extra, F.array().cast(kind))))
    out = out.withColumn("spans", F.coalesce(spans, F.array().cast(kind)))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    stage.drop(slim, quota)
    return out.select(*own, "doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "spans")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the left's keys stay."""
    other = right.select([F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


def _quotas(cells, names, targets, block, most) -> list[tuple]:
    """(source, shard, blocks, passes, extra) for each cell that has tokens."""
    shards: dict = {s: [] for s in names}
    for c in sorted(cells, key=lambda c: c["shard"]):
        shards[c["source"]].append((c["shard"], c["tokens"], -(-c["tokens"] // block)))
    blocks = [sum(n for _, _, n in shards[s]) for s in names]
    votes = [targets[s] for s in names]
    # A seat is a block of an average cut: the last block of a shard is short.
    tokens = [sum(t for _, t, _ in shards[s]) for s in names]
    wanted = [v * b / t if t else 0.0 for v, b, t in zip(votes, blocks, tokens)]
    seats = sainte_lague(wanted, round(sum(wanted)), [most * b for b in blocks])
    out = []
    for s, q in zip(names, seats):
        own = shards[s]
        for (shard, _, n), k in zip(own, sainte_lague([n for _, _, n in own], q, [most * n for _, _, n in own])):
            out.append((s, shard, n, k // n, k % n))
    return out


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: a row for each pass, its text cut to the words taken.

    A pass over a whole document keeps its text as it is; a pass that takes some ranges holds
    them in order, a line break between two. Documents of which nothing is taken go. A column
    n_chars, if there is one, is set to the new text's length. Rows go by a number that they
    get once docs is written, so rows that repeat a doc_id or have none are cut each by itself.
    """
    # The written table fixes the numbers: the plan and the texts must read the same.
    docs = Stage(docs.sparkSession, "mixed").keep(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
    plan = mix(docs, doc_id=doc_id, text=text, row="_row", **options).filter("taken > 0")
    parts = plan.select("_row", "size", F.explode("spans").alias("s"))
    parts = parts.groupBy("_row", "size", F.col("s.pass").alias("_pass")).agg(
        F.sort_array(F.collect_list(F.struct("s.first", "s.end"))).alias("_cuts")
    )
    whole = (F.size("_cuts") == 1) & (F.col("_cuts")[0]["end"] - F.col("_cuts")[0]["first"] == F.col("size"))
    parts = parts.select("_row", F.when(~whole, F.col("_cuts")).alias("_cuts"))
    joined = docs.join(parts, "_row")

    @F.pandas_udf("string")
    def cut(texts, cuts):
        word = re.compile(WORD)
        out = []
        for t, ranges in zip(texts, cuts):
            if ranges is None or t is None:
                out.append(t)
                continue
            at = [m.span() for m in word.finditer(t)]
            out.append("\n".join(t[at[r["first"]][0] : at[r["end"] - 1][1]] for r in ranges))
        return __import__("pandas").Series(out)

    joined = joined.withColumn(text, F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(cut(F.col(text), F.col("_cuts"))))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select([c for c in docs.columns if c != "_row"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mixing": op2}
SQL: dict[str, str] = {}

by_value(__name__)
