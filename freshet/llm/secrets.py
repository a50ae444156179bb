"""Secret scan: known patterns, and a randomness battery with false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import Stage, documents

# Fixed patterns of the base scan: (kind, pattern, group whose length counts, least length).
# A run of 16 hex digits is found as such: shorter runs would be dropped anyway.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = [k for k, *_ in BASE] + ["random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
# Index of a symbol, for serial correlation.
ORDER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_="

# The null hypothesis is an ordinary token: two of its symbols are equal with this chance (and
# never less than twice the alphabet's), its class (digit, capital, small letter, other)
# changes between neighbours with this one, and neighbours correlate so.
EQUAL, CHANGE, SERIAL = 0.065, 0.35, 0.25
# A token is random only if none of the tests rejects that at this level.
REJECT = 0.001
STRATA = (16, 24, 32, 48, 64)
# p-values are binned by hundredths of -log10, up to this many.
BINS = 3000


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, at most a fifth too large beyond 3."""
    x = F.abs(z)
    tail = F.exp(-0.717 * x - 0.416 * x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of the leftmost matches that do not overlap, in code points."""
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    first = F.struct(none.alias("out"), F.lit(0).alias("at"))

    def step(acc, piece):
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["all"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), piece["value"].alias("value")))
        return F.struct(F.concat(acc["out"], one).alias("out"), end.alias("at"))

    pieces = F.arrays_zip(F.slice(gaps, 1, F.size(all_)).alias("gap"), all_.alias("all"), value.alias("value"))
    return F.when(F.size(all_) > 0, F.aggregate(pieces, first, step, lambda a: a["out"])).otherwise(none)


def _base(body: Column, order: int) -> Column:
    """Spans (start, order, end, kind) of one base kind."""
    kind, pattern, group, least = BASE[order]
    spans = F.filter(_found(body, pattern, group), lambda t: F.length(t["value"]) >= least)
    return F.transform(spans, lambda t: _span(t, order, kind))


def _span(t: Column, order: int, kind: str) -> Column:
    return F.struct(t["start"].alias("start"), F.lit(order).alias("order"), t["end"].alias("end"), F.lit(kind).alias("kind"))


def _tests(found: Column) -> Column:
    """(start, end, bin, stratum, ok) of each candidate: how unlike ordinary text, whether like random."""

    def symbols(t):
        v = F.regexp_replace(t["value"], "=+$", "")
        return F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            F.length(v).cast("double").alias("n"),
            # The inferred encoding's alphabet.
            F.when(v.rlike("^[0-9]+$"), 10.0).when(v.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0).when(v.rlike("^[A-Z2-7]+$"), 32.0)
            .when(v.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36.0).otherwise(64.0).alias("m"),
            F.split(v, "").alias("s"),
            F.translate(
                v, ORDER[:-1], "0" * 10 + "A" * 26 + "a" * 26 + "++--"
            ).alias("classes"),
        )

    def numbers(t):
        s, n = t["s"], t["n"]
        squares = F.aggregate(
            F.array_distinct(s), F.lit(0.0), lambda a, c: a + F.pow(n - F.size(F.array_remove(s, c)), F.lit(2.0))
        )
        return F.struct(
            *[t[c].alias(c) for c in ("start", "end", "n", "m")],
            (t["m"] / n * squares - n).alias("chi"),
            # Runs of one class, less one.
            (F.regexp_count(t["classes"], F.lit("0+|A+|a+|[+-]+")) - 1).cast("double").alias("changes"),
            F.transform(s, lambda c: F.instr(F.lit(ORDER), c).cast("double")).alias("v"),
        )

    def moments(t):
        v, n = t["v"], t["n"]
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        return F.struct(
            *[t[c].alias(c) for c in ("start", "end", "n", "m", "chi", "changes", "v")],
            mean.alias("mean"),
        )

    def serial(t):
        v, n, mean = t["v"], t["n"], t["mean"]
        var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: (a - mean) * (b - mean))
        return F.struct(
            *[t[c].alias(c) for c in ("start", "end", "n", "m", "chi", "changes")],
            F.when(var > 0, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / var).otherwise(1.0).alias("r"),
        )

    def verdict(t):
        n, m = t["n"], t["m"]
        equal = F.greatest(F.lit(EQUAL), 2 / m)
        excess = (n - 1) * (m * equal - 1)
        uniform = _upper_tail(-(t["chi"] - (m - 1 + excess)) / F.sqrt(2 * (m - 1) + 4 * excess))
        runs = _upper_tail((t["changes"] - 0.5 - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE)))
        corr = _upper_tail((SERIAL - t["r"]) * F.sqrt(n))
        # Fisher's sum of three is chi-squared with six degrees.
        half = -(F.log(F.greatest(uniform, F.lit(1e-30))) + F.log(F.greatest(runs, F.lit(1e-30))) + F.log(F.greatest(corr, F.lit(1e-30))))
        p = F.exp(-half) * (1 + half + half * half / 2)
        # Tests of randomness itself: the chi-squared by its cube root, changes and correlation two-sided.
        chi = _upper_tail((F.cbrt(t["chi"] / (m - 1)) - (1 - 2 / (9 * (m - 1)))) / F.sqrt(2 / (9 * (m - 1))))
        even = 2 * _upper_tail(F.abs(t["r"] + 1 / n) * F.sqrt(n))
        stratum = F.lit(0)
        for i, least in enumerate(STRATA):
            stratum = F.when(n >= least, i).otherwise(stratum)
        bin_ = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-40))) * 100)).cast("int")
        return F.struct(
            t["start"].alias("start"), t["end"].alias("end"), bin_.alias("bin"), stratum.alias("stratum"),
            ((chi >= REJECT) & (even >= REJECT)).alias("ok"),
        )

    for f in (symbols, numbers, moments, serial, verdict):
        found = F.transform(found, f)
    return found


def scan(docs: DataFrame, rate: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, spans (array of start, order, end, kind).

    Base kinds are the patterns above, leftmost and not overlapping within a kind. Kind
    `random` adds tokens of 16 or more symbols of an encoding (decimal, hex, base32, letters
    of one case with digits, base64 or its URL form) that hold a digit or a capital after a
    small letter, and that no base span covers.

    Method. For each such token: the chi-squared statistic of uniformity over the alphabet of
    its inferred encoding, the number of runs of a symbol class, and the correlation of
    neighbours. Each gives the chance that an ordinary token looks as random; Fisher's method
    combines them. A token is told random if the tests do not reject randomness and it
    passes Benjamini and Hochberg's bound for a false-discovery rate of `rate`, held within
    each class of length over all documents, so many short tokens do not spend what few long
    ones need. The bound needs only counts of binned p-values (few thousand rows).

    Edge cases: a null or empty text has no spans; a null doc_id is passed on; repeated rows
    are scanned each (and count each); positions are code points, ends exclusive; other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "secrets")
    body = F.coalesce(F.col(text), F.lit(""))
    base = [_base(body, order).alias(kind) for order, (kind, *_) in enumerate(BASE)]
    tokens = F.filter(_found(body, CANDIDATE), lambda t: t["value"].rlike("[0-9]|[a-z][^A-Z]*[A-Z]"))
    tested = docs.select(F.col(doc_id).alias("doc_id"), *base, _tests(tokens).alias("tokens"))
    least_bin = int(-100 * math.log10(rate))
    strata = F.transform("tokens", lambda t: t["stratum"])
    per_stratum = F.array(*[F.size("tokens") - F.size(F.array_remove(strata, i)) for i in range(len(STRATA))])
    # No p-value over the rate can pass; of those only the number matters.
    low = F.filter("tokens", lambda t: t["bin"] >= least_bin)
    tested = stage.keep(
        tested.select("doc_id", *[k for k, *_ in BASE], per_stratum.alias("n"), low.alias("tokens")), "tested"
    )
    number = tested.agg(*[F.sum(F.col("n")[i]) for i in range(len(STRATA))]).first()
    bins = tested.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    bounds = _bounds({(r[0], r[1]): r["count"] for r in bins}, [x or 0 for x in number], rate)
    covers = F.concat(*[F.col(k) for k, *_ in BASE])
    bound = F.array(*[F.lit(b) for b in bounds])
    random = F.filter("tokens", lambda t: t["ok"] & (t["bin"] >= F.element_at(bound, t["stratum"] + 1)))
    random = F.filter(random, lambda t: ~F.exists(covers, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    random = F.transform(random, lambda t: _span(t, len(BASE), "random"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return tested.select("doc_id", *counts, F.array_sort(covers).alias("base"), F.array_sort(F.concat(covers, random)).alias("spans"))


def _bounds(bins: dict[tuple[int, int], int], number: list[int], rate: float) -> list[int]:
    """Least bin of each stratum that Benjamini and Hochberg's step-up rule lets pass."""
    out = []
    for i, n in enumerate(number):
        best, above = BINS + 1, 0
        for b in sorted((b for s, b in bins if s == i), reverse=True):
            above += bins[i, b]
            if 10 ** (-b / 100) <= rate * above / n:
                best = b
        out.append(best)
    return out


def _joined(spans: str) -> Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


QUERIES = {"op1_secret_scan": op1}
# Positions of all matches and the rate's step-up bound are no plain SQL; tests scan by brute force.
SQL: dict[str, str] = {}
