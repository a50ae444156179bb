"""Distribution functions built from SQL expressions, so p-values stay in the JVM.

Each step is a named column that later ones refer to (lateral aliases of one select).
Nested as one expression the repeated terms would multiply into a tree too large to plan.
"""

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES_TERMS = 160
EXACT_SPEARMAN_MAX_N = 9

# Edgeworth coefficients of algorithm AS 89 (Best & Roberts 1975).
AS89 = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4)


def with_normal_cdf(df: DataFrame, x: str, out: str) -> DataFrame:
    """Adds the standard normal CDF of x, by its all-positive power series cut at |x| = 8."""
    series = f"""aggregate(sequence(1, {SERIES_TERMS}), named_struct('t', _z, 's', _z),
        (a, k) -> named_struct('t', a.t * _z * _z / (2 * k + 1), 's', a.s + a.t * _z * _z / (2 * k + 1)), a -> a.s)"""
    return (
        df.withColumn("_z", F.expr(f"least(abs({x}), 8D)"))
        .withColumn("_upper", F.expr(f"least(0.5D + exp(-_z * _z / 2) / sqrt(2 * pi()) * {series}, 1D)"))
        .withColumn(out, F.expr(f"if({x} >= 0, _upper, 1 - _upper)"))
        .drop("_z", "_upper")
    )


@lru_cache(maxsize=None)
def spearman_tail_counts(n: int) -> dict[int, int]:
    """Permutations of n by sum of squared rank differences, built by placing one rank at a time."""
    states: dict[int, dict[int, int]] = {0: {0: 1}}
    for position in range(n):
        following: dict[int, dict[int, int]] = {}
        for used, sums in states.items():
            for rank in range(n):
                if used >> rank & 1:
                    continue
                target = following.setdefault(used | 1 << rank, {})
                step = (position - rank) ** 2
                for s, count in sums.items():
                    target[s + step] = target.get(s + step, 0) + count
        states = following
    return states[(1 << n) - 1]


@lru_cache(maxsize=None)
def _exact_table() -> str:
    """SQL map from n * 1000 + sum of squared rank differences to the two-sided exact p, 2 <= n <= 9."""
    entries = []
    for n in range(2, EXACT_SPEARMAN_MAX_N + 1):
        counts = spearman_tail_counts(n)
        middle = (n**3 - n) / 6
        for s in sorted(counts):
            tail = sum(c for k, c in counts.items() if (k >= s if s > middle else k <= s))
            entries.append(f"{n * 1000 + s}, {min(1.0, 2 * tail / math.factorial(n))!r}D")
    return "map(" + ", ".join(entries) + ")"


def with_spearman_p(df: DataFrame, rho: str = "rho", n: str = "n", tied: str = "tied", out: str = "pval") -> DataFrame:
    """Adds the two-sided p of Spearman's rho.

    With ties: Student's t with n - 2 degrees of freedom as a finite trigonometric sum,
    where the angle of t is asin |rho|. Without ties: exact permutation counts up to
    n = 9, the Edgeworth series beyond.
    """
    c = AS89
    terms = "aggregate(if(_terms >= 2, sequence(1, greatest(_terms - 1, 1)), array()), named_struct('t', _first, 's', _first), "
    terms += "(a, k) -> named_struct('t', a.t * _cos2 * if(_odd, 2 * k / (2 * k + 1), (2 * k - 1) / (2 * k)), "
    terms += "'s', a.s + a.t * _cos2 * if(_odd, 2 * k / (2 * k + 1), (2 * k - 1) / (2 * k))), a -> a.s)"
    steps = [
        ("_abs", f"least(abs({rho}), 1D)"),
        ("_cos2", "1 - _abs * _abs"),
        ("_odd", f"{n} % 2 = 1"),
        ("_terms", f"cast(if(_odd, ({n} - 3) / 2, ({n} - 2) / 2) as int)"),
        ("_first", "if(_odd, sqrt(_cos2), 1D)"),
        ("_sum", f"if(_terms >= 1, {terms}, 0D)"),
        ("_p_t", "greatest(0D, 1 - if(_odd, 2 / pi() * (asin(_abs) + _abs * _sum), _abs * _sum))"),
        # Edgeworth series on the sum of squared rank differences
        ("_s", f"round((pow({n}, 3) - {n}) * (1 - {rho}) / 6)"),
        ("_is_upper", f"_s > (pow({n}, 3) - {n}) / 6"),
        ("_b", f"1D / {n}"),
        ("_x", f"(6 * (if(_is_upper, _s, _s + 2) - 1) * _b / ({n} * {n} - 1D) - 1) * sqrt({n} - 1D)"),
        ("_y", "_x * _x"),
        ("_u1", f"{c[8]}D - {c[9]}D * _b + _y * _b * ({c[10]}D - {c[11]!r}D * _y)"),
        ("_u2", f"{c[6]}D + {c[7]}D * _b - _y * _u1"),
        (
            "_u",
            f"_x * _b * ({c[0]}D + _b * ({c[1]}D + {c[2]}D * _b) "
            f"+ _y * (-{c[3]}D + _b * ({c[4]}D + {c[5]}D * _b) - _y * _b * _u2))",
        ),
    ]
    work = df.selectExpr("*", *[f"{expr} as {name}" for name, expr in steps])
    work = with_normal_cdf(work, "_x", "_phi")
    edgeworth = "if(_is_upper, 1 - _phi + _u * exp(-_y / 2), _phi - _u * exp(-_y / 2))"
    exact = f"element_at({_exact_table()}, cast({n} * 1000 + _s as int))"
    work = work.withColumn(
        out,
        F.expr(
            f"""case when {rho} is null or {n} < 3 then null when {tied} then _p_t
            when {n} <= {EXACT_SPEARMAN_MAX_N} then {exact}
            else least(2 * greatest({edgeworth}, 0D), 1D) end"""
        ),
    )
    return work.drop(*[name for name, _ in steps], "_phi")
