"""Gap filling along an ordered series.

Every window here is one series (keys) with one row per day, so its length is
bounded by the calendar. "Next valid value" is taken with a descending sort and
a running frame: a frame that reaches forward without bound recomputes its
aggregate for each row.
"""

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.sources.staging import Staging


def _neighbours(keys: Sequence[str], order: str, value: str, position: str) -> tuple[Column, Column]:
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("at"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order))
    after = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return before, after


def interpolate_linear(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str | None = None, ends: str = "null"
) -> DataFrame:
    """Fill interior gaps linearly by row position.

    ends: "null" keeps leading and trailing gaps, "flat" repeats the nearest
    valid value into them, "edge" sets only the first and last row to the
    first and last valid value and interpolates from there.
    """
    out = out or value
    src = value
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    work = df.withColumn("_pos", position)
    if ends == "edge":
        work = fill_edges(work, keys, order, value, out="_edge")
        src = "_edge"
    before, after = _neighbours(keys, order, src, "_pos")
    work = work.withColumns({"_before": before, "_after": after})
    weight = F.try_divide(F.col("_pos") - F.col("_before.at"), F.col("_after.at") - F.col("_before.at"))
    inside = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * weight
    filled = F.coalesce(F.col(src), inside)
    if ends == "flat":
        filled = F.coalesce(filled, F.col("_before.v"), F.col("_after.v"))
    return work.withColumn(out, filled).drop("_pos", "_before", "_after", "_edge")


def fill_edges(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str | None = None
) -> DataFrame:
    """First row := first valid value, last row := last valid value."""
    whole = Window.partitionBy(*keys)
    marked = df.withColumns(
        {
            "_lo": F.min(order).over(whole),
            "_hi": F.max(order).over(whole),
            "_first": F.min(F.when(F.col(value).isNotNull(), F.struct(order, value))).over(whole)[value],
            "_last": F.max(F.when(F.col(value).isNotNull(), F.struct(order, value))).over(whole)[value],
        }
    )
    filled = F.coalesce(
        F.col(value),
        F.when(F.col(order) == F.col("_lo"), F.col("_first")),
        F.when(F.col(order) == F.col("_hi"), F.col("_last")),
    )
    return marked.withColumn(out or value, filled).drop("_lo", "_hi", "_first", "_last")


def fill_mean(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Null becomes the mean of its group; the mean is pre-aggregated, not windowed."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return join_null_safe(df, means, keys).withColumn(out or value, F.coalesce(value, "_mean")).drop("_mean")


def join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """df with the columns of other, whose keys are unique; a null key equals a null key."""
    renamed = other.withColumnsRenamed({k: f"_join_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_join_{k}")) for k in keys]
    return df.join(renamed, on, how).drop(*[f"_join_{k}" for k in keys])


def fill_next(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str | None = None) -> DataFrame:
    """Null becomes the next valid value of the series."""
    later = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn(out or value, later)


def fill_median(df: DataFrame, values: Sequence[str], bins: int = 4096, by: Sequence[str] = ()) -> DataFrame:
    """Null becomes the exact median of its variable over the whole grid, or over its cube.

    by names the columns that tell cubes apart, such as init_date. The medians come from
    exact_medians or group_medians, so no task ever holds a variable, or one of a cube, whole.
    """
    if by:
        medians = group_medians(df, by, values, bins).withColumnsRenamed({v: f"_median_{v}" for v in values})
        filled = join_null_safe(df, medians, by)
        return filled.withColumns({v: F.coalesce(F.col(v), F.col(f"_median_{v}")) for v in values}).drop(
            *[f"_median_{v}" for v in values]
        )
    medians = exact_medians(df, values, bins)
    return df.withColumns({v: F.coalesce(F.col(v), F.lit(medians[v]).cast("double")) for v in values})


def exact_medians(df: DataFrame, values: Sequence[str], bins: int = 4096) -> dict[str, float | None]:
    """Exact medians of unbounded columns by histogram refinement.

    A pass over the table counts, for every wanted rank at once, the values of the rank's
    remaining bracket in equal bins. Counts combine before the shuffle and the driver sees
    at most `bins` + 1 of them per rank. The bracket then narrows to the bin that holds the
    rank, until one value is left: the ends of a bracket fall into different bins, so each
    pass narrows it. Infinities are counted apart, NaN is no value.
    """
    data = df.select(*[F.when(~F.isnan(v), F.col(v).cast("double")).alias(v) for v in values])
    inf = F.lit(float("inf"))
    head = data.agg(
        *[F.count(v).alias(f"n_{v}") for v in values],
        *[F.count_if(F.col(v) == -inf).alias(f"below_{v}") for v in values],
        *[F.count_if(F.col(v) == inf).alias(f"above_{v}") for v in values],
        *[F.min(F.when(F.abs(v) < inf, F.col(v))).alias(f"lo_{v}") for v in values],
        *[F.max(F.when(F.abs(v) < inf, F.col(v))).alias(f"hi_{v}") for v in values],
    ).first()
    found: dict[tuple[str, int], float] = {}
    open_ranks = {}
    for v in values:
        n, below, above = head[f"n_{v}"], head[f"below_{v}"], head[f"above_{v}"]
        for rank in {(n - 1) // 2, n // 2} if n else ():
            if rank < below:
                found[(v, rank)] = -math.inf
            elif rank >= n - above:
                found[(v, rank)] = math.inf
            else:
                open_ranks[(v, rank)] = (head[f"lo_{v}"], head[f"hi_{v}"], rank - below)
    while open_ranks:
        found |= {k: lo for k, (lo, hi, _) in open_ranks.items() if lo == hi}
        open_ranks = {k: b for k, b in open_ranks.items() if b[0] != b[1]}
        for key, rows in _bracket_rows(data, open_ranks, bins).items():
            row, left = _pick(rows, open_ranks[key][2])
            open_ranks[key] = (row["lo"], row["hi"], left)
    out: dict[str, float | None] = {}
    for v in values:
        middle = [x for (name, _), x in found.items() if name == v]
        out[v] = sum(middle) / len(middle) if middle else None
    return out


def _pick(rows: list, rank: int) -> tuple:
    """The row whose counts cover the rank, and the rank inside it."""
    for row in rows:
        if rank < row["n"]:
            return row, rank
        rank -= row["n"]
    raise AssertionError("rank beyond the bracket")


def _bracket_rows(data: DataFrame, brackets: dict, bins: int) -> dict[tuple[str, int], list]:
    """Counts of each bracket's values by bin, in order."""
    if not brackets:
        return {}
    keys = list(brackets)
    entries = []
    for i, key in enumerate(keys):
        lo, hi, _ = brackets[key]
        v = F.col(key[0])
        # Halving first keeps the width of a bracket finite.
        step = (hi / 2 - lo / 2) / bins
        slot = F.floor((v / 2 - lo / 2) / step).cast("double") if step else v
        entries.append(
            F.when(v.between(lo, hi), F.struct(F.lit(i).alias("i"), slot.alias("slot"), v.alias("v")))
        )
    rows = (
        data.select(F.explode(F.array(*entries)).alias("e"))
        .filter("e is not null")
        .groupBy("e.i", "e.slot")
        .agg(F.count("*").alias("n"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))
        .collect()
    )
    out = {key: [] for key in keys}
    for row in sorted(rows, key=lambda r: (r["i"], r["lo"])):
        out[keys[row["i"]]].append(row)
    return out


def group_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], bins: int = 4096) -> DataFrame:
    """The exact median of each value column in each group: keys and the value columns.

    Infinities are values, NaN is none; a group without values has a null median.
    """
    ranks = [(v, rank) for v in values for rank in (lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2))]
    found = group_ranks(df, keys, ranks, bins)
    # Halving first keeps two large values finite.
    return found.select(*keys, *[(F.col(f"rank_{2 * i}") / 2 + F.col(f"rank_{2 * i + 1}") / 2).alias(v) for i, v in enumerate(values)])


def group_ranks(
    df: DataFrame, keys: Sequence[str], ranks: Sequence[tuple[str, Callable[[Column], Column]]], bins: int = 4096
) -> DataFrame:
    """Values of given ranks in each group: keys, rank_0, rank_1, ...

    ranks pairs a column with a function from the group's number n of values to the wanted
    rank (0 is the least). Each wanted rank of each group has a bracket that holds it. A pass
    over the table joins the brackets to the rows and counts the values of all brackets in
    equal bins; a bracket narrows to the least and largest value of the bin that holds its
    rank, until these are one value. The ends of a bracket fall into different bins, so each
    pass narrows all of them, whatever the number of groups. Counts combine before the shuffle;
    a window sees the bins of one bracket only, and nothing goes to the driver.
    """
    staging = Staging(df.sparkSession, "ranks")
    columns = list(dict.fromkeys(v for v, _ in ranks))
    data = df.select(*keys, *[F.when(~F.isnan(v), F.col(v).cast("double")).alias(v) for v in columns])
    inf = F.lit(float("inf"))
    head = data.groupBy(*keys).agg(
        *[F.count(v).alias(f"_n_{v}") for v in columns],
        *[F.count_if(F.col(v) == -inf).alias(f"_below_{v}") for v in columns],
        *[F.count_if(F.col(v) == inf).alias(f"_above_{v}") for v in columns],
        *[F.min(F.when(F.abs(v) < inf, F.col(v))).alias(f"_lo_{v}") for v in columns],
        *[F.max(F.when(F.abs(v) < inf, F.col(v))).alias(f"_hi_{v}") for v in columns],
    )

    def bracket(i: int, v: str, rank) -> Column:
        n, below, above = (F.col(f"_{c}_{v}") for c in ("n", "below", "above"))
        at = rank(n).cast("long")
        low, high = at < below, at >= n - above
        lo = F.when(low, -inf).when(high, inf).otherwise(F.col(f"_lo_{v}"))
        hi = F.when(low, -inf).when(high, inf).otherwise(F.col(f"_hi_{v}"))
        return F.when(
            at.between(0, n - 1), F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"), (at - below).alias("left"))
        )

    each = F.array(*[bracket(i, v, rank) for i, (v, rank) in enumerate(ranks)])
    brackets = staging.keep(head.select(*keys, F.filter(each, lambda b: b.isNotNull()).alias("b")))
    value = F.array(*[F.col(v) for v, _ in ranks])
    while not brackets.filter(F.exists("b", lambda b: b["lo"] < b["hi"])).isEmpty():
        open_ = F.filter("b", lambda b: b["lo"] < b["hi"])
        rows = join_null_safe(data, brackets.select(*keys, open_.alias("_b")), keys, "inner").withColumn("_v", value)
        inside = F.filter("_b", lambda b: F.get("_v", b["i"]).between(b["lo"], b["hi"]))

        def entry(b):
            v, step = F.get("_v", b["i"]), (b["hi"] / 2 - b["lo"] / 2) / bins
            slot = F.when(step > 0, F.floor((v / 2 - b["lo"] / 2) / step).cast("double")).otherwise(v)
            return F.struct(b["i"].alias("i"), b["left"].alias("left"), slot.alias("slot"), v.alias("v"))

        counted = (
            rows.select(*keys, F.explode(F.transform(inside, entry)).alias("e"))
            .groupBy(*keys, "e.i", "e.left", "e.slot")
            .agg(F.count("*").alias("n"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))
            .withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "i").orderBy("lo")))
        )
        picked = counted.filter("upto > left and upto - n <= left").select(
            *keys, F.struct("i", "lo", "hi", (F.col("left") - F.col("upto") + F.col("n")).alias("left")).alias("b")
        )
        closed = brackets.select(*keys, F.explode(F.filter("b", lambda b: b["lo"] == b["hi"])).alias("b"))
        # One list of a group's few brackets; groups without any are added again at the end.
        brackets = staging.replace(brackets, closed.union(picked).groupBy(*keys).agg(F.collect_list("b").alias("b")))

    def value_of(i: int) -> Column:
        return F.get(F.filter("b", lambda b: b["i"] == i), F.lit(0))["lo"].alias(f"rank_{i}")

    wide = [value_of(i) for i in range(len(ranks))]
    return join_null_safe(df.select(*keys).distinct(), brackets.select(*keys, *wide), keys)
