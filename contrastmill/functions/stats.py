"""Test statistics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrastmill.functions.binding import bind

# The series and the continued fraction for erfc meet here; both are exact to double
# precision at this point with the number of terms below.
_SPLIT = 2.0
_SERIES_TERMS = 60
_FRACTION_TERMS = 80

# Two table probabilities this close count as equal in the two-sided exact test.
_TIE = 1e-7

# From this number on five terms of Stirling's series are exact to double precision.
_STIRLING_FROM = 16
_HALF_LN_TAU = math.log(2 * math.pi) / 2
# Chances smaller than the largest of a tail by this many powers of e add nothing to it.
_NOTHING = 45.0


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-squared of ``[[a, b], [c, d]]`` with the continuity correction, bounded by the
    deviation itself. Null when a margin is zero."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    deviation = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.when(margins > 0, n * deviation * deviation / margins)


def rule_chi2(count_group: Column, count_reference: Column, total_group: Column, total_reference: Column) -> Column:
    """Chi-squared of hits and misses, group against reference."""
    return chi2_yates(
        count_group, count_reference, total_group - count_group, total_reference - count_reference
    )


def erfc(z: Column) -> Column:
    """Complementary error function of a non-negative column."""
    square = z * z
    # erf(z) = 2z/sqrt(pi) exp(-z^2) (1 + 2z^2/3 (1 + 2z^2/5 (1 + ...)))
    series = F.aggregate(
        F.sequence(F.lit(_SERIES_TERMS), F.lit(1), F.lit(-1)),
        F.lit(1.0),
        lambda acc, k: F.lit(1.0) + acc * square * 2 / (k * 2 + 1),
    )
    near = 1 - z * series * F.exp(-square) * (2 / math.sqrt(math.pi))
    # erfc(z) = exp(-z^2)/sqrt(pi) / (z + (1/2)/(z + (2/2)/(z + (3/2)/(z + ...))))
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_TERMS), F.lit(1), F.lit(-1)),
        z,
        lambda acc, k: z + k / 2 / acc,
    )
    far = F.exp(-square) / (fraction * math.sqrt(math.pi))
    return F.when(z < _SPLIT, near).when(z.isNotNull(), far)


def chi2_pvalue(chi2: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return erfc(F.sqrt(chi2 / 2))


def phi_coefficient(chi2: Column, total_group: Column, total_reference: Column) -> Column:
    return F.sqrt(chi2 / (total_reference + total_group))


def _stirling_table() -> Column:
    exact = [math.lgamma(k + 1) - ((k + 0.5) * math.log(k) - k + _HALF_LN_TAU if k else 0) for k in range(_STIRLING_FROM)]
    return F.array(*map(F.lit, exact))


def _sum_of(terms: list[Column], value: Callable[[Column], Column]) -> Column:
    """Sum of one expression over several arguments; the expression stands in the plan once."""
    return F.aggregate(F.array(*terms), F.lit(0.0), lambda total, term: total + value(term))


def _stirling_error(n: Column, table: Column) -> Column:
    """``ln n!`` less Stirling's formula for it, for whole numbers from 0."""
    x = 1 / (n * n)
    series = (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * (1 / 1680 - x / 1188)))) / n
    return F.when(n < _STIRLING_FROM, F.get(table, n.cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """``x ln(x / mean) + mean - x`` without cancellation when the two are close."""

    def near(v: Column) -> Column:
        odd = F.aggregate(F.sequence(F.lit(17), F.lit(3), F.lit(-2)), F.lit(0.0), lambda total, k: 1 / k + v * v * total)
        close = (x - mean) * v + 2 * x * v * v * v * odd
        return F.when(F.abs(v) < 0.1, close).otherwise(x * F.log(x / mean) + mean - x)

    return bind((x - mean) / (x + mean), near)


def _log_binomial(x: Column, n: Column, p: Column, q: Column, table: Column) -> Column:
    """Logarithm of the chance of ``x`` hits in ``n`` trials, by its saddle point: what is large in
    the log-gammas cancels before it is computed."""
    signed = [F.struct(v.alias("v"), F.lit(float(sign)).alias("sign")) for v, sign in ((n, 1), (x, -1), (n - x, -1))]
    errors = _sum_of(signed, lambda e: e["sign"] * _stirling_error(e["v"], table))
    means = [F.struct(v.alias("v"), (n * share).alias("mean")) for v, share in ((x, p), (n - x, q))]
    away = _sum_of(means, lambda e: _deviance(e["v"], e["mean"]))
    inside = errors - away - _HALF_LN_TAU - (F.log(x) + F.log1p(-x / n)) / 2
    return F.when(x == 0, n * F.log1p(-p)).when(x == n, n * F.log1p(-q)).otherwise(inside)


def _log_table(x: Column, t: Column) -> Column:
    """Logarithm of the chance of a table with ``x`` in its first cell, given the margins."""
    rows = [F.struct(x.alias("x"), t["row"].alias("n")), F.struct((t["column"] - x).alias("x"), (t["n"] - t["row"]).alias("n"))]
    return _sum_of(rows, lambda e: _log_binomial(e["x"], e["n"], t["p"], t["q"], t["table"])) - t["base"]


def _bisect(inner: Column, outer: Column, t: Column, level: Column) -> Column:
    """The table nearest to ``inner`` no likelier than ``level``; ``outer`` is one, ``inner`` is not.

    Chances only fall from the mode outwards, so halving the way finds it.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.abs(outer - inner) + 1)).cast("int"))

    def halve(ends: Column, _: Column) -> Column:
        middle = F.floor((ends["near"] + ends["far"]) / 2).cast("double")
        low = _log_table(middle, t) <= level
        moved = F.struct(F.when(low, ends["near"]).otherwise(middle).alias("near"), F.when(low, middle).otherwise(ends["far"]).alias("far"))
        return F.when(F.abs(ends["near"] - ends["far"]) > 1, moved).otherwise(ends)

    return F.aggregate(steps, F.struct(inner.alias("near"), outer.alias("far")), halve, lambda ends: ends["far"])


def _tail(t: Column, outer: Column, step: Column) -> Column:
    """Sum of the chances of one tail, from its innermost table as far as they count."""
    row, column, n = t["row"], t["column"], t["n"]

    def summed(e: Column) -> Column:
        first, top = e["first"], e["top"]
        last = F.when(e["outer"] > top - _NOTHING, outer).otherwise(_bisect(first, outer, t, top - _NOTHING))

        def add(state: Column, _: Column) -> Column:
            x, term = state["x"], state["term"]
            up = (row - x) * (column - x) / ((x + 1) * (n - row - column + x + 1))
            down = x * (n - row - column + x) / ((row - x + 1) * (column - x + 1))
            ratio = F.when(step > 0, up).otherwise(down)
            return F.struct((x + step).alias("x"), (term * ratio).alias("term"), (state["total"] + term).alias("total"))

        start = F.struct(first.alias("x"), F.exp(top).alias("term"), F.lit(0.0).alias("total"))
        places = bind(last, lambda end: F.sequence(F.lit(0).cast("long"), F.abs(end - first).cast("long")))
        return F.aggregate(places, start, add, lambda state: state["total"])

    def found(chance: Column) -> Column:
        first = _bisect(t["mode"], outer, t, t["limit"])
        with_top = bind(first, lambda x: F.struct(x.alias("first"), _log_table(x, t).alias("top"), chance.alias("outer")))
        return F.when(chance <= t["limit"], bind(with_top, summed)).otherwise(0.0)

    return bind(_log_table(outer, t), found)


def interaction_cells(n_ab: Column, n_a: Column, n_b: Column, n: Column, table: str = "shifted"):
    """The four cells of the interaction test of a pair.

    ``shifted`` is ``[[n_ab, n - n_a], [n - n_b, n - n_ab]]``; ``contingency`` is the usual
    presence/absence table.
    """
    if table == "shifted":
        return n_ab, n - n_a, n - n_b, n - n_ab
    if table == "contingency":
        return n_ab, n_a - n_ab, n_b - n_ab, n - n_a - n_b + n_ab
    raise ValueError(f"unknown interaction table {table!r}: use 'shifted' or 'contingency'")


def _exact(a: Column, b: Column, c: Column, d: Column, single: Column, answer: Callable[[Column], Column]) -> Column:
    """``answer`` from the margins of a table and the logarithm ``limit`` of its chance, raised by
    the tolerance of ties; ``single`` where the margins allow one table only."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    low = F.greatest(F.lit(0.0), a - d)
    high = F.least(a + b, a + c)
    n = a + b + c + d
    cells = F.struct(
        a.alias("a"), (a + b).alias("row"), (a + c).alias("column"), n.alias("n"), low.alias("low"), high.alias("high"),
        ((a + c) / n).alias("p"), ((b + d) / n).alias("q"), _stirling_table().alias("table"),
    )

    def with_base(t: Column) -> Column:
        mode = F.floor((t["row"] + 1) * (t["column"] + 1) / (t["n"] + 2)).cast("double")
        fields = [t[f].alias(f) for f in ("a", "row", "column", "n", "low", "high", "p", "q", "table")]
        base = _log_binomial(t["column"], t["n"], t["p"], t["q"], t["table"])
        return F.struct(*fields, F.least(F.greatest(mode, t["low"]), t["high"]).alias("mode"), base.alias("base"))

    def with_limit(t: Column) -> Column:
        return t.withField("limit", _log_table(t["a"], t) + _TIE)

    known = (F.least(a, b, c, d) >= 0) & a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    # with an empty margin there is one table only
    return F.when(known & (low == high), single).when(known, bind(bind(bind(cells, with_base), with_limit), answer))


def _two_sided(t: Column) -> Column:
    ends = [F.struct(t[e].alias("outer"), F.lit(step).alias("step")) for e, step in (("low", -1.0), ("high", 1.0))]
    tails = F.least(_sum_of(ends, lambda e: _tail(t, e["outer"], e["step"])), F.lit(1.0))
    return F.when(_log_table(t["mode"], t) <= t["limit"], 1.0).otherwise(tails)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact test of ``[[a, b], [c, d]]``: the chance of all tables with these margins that
    are no likelier than this one. Null cells, and negative ones, give null.

    The chances rise to one mode and fall again, so the tables wanted form two tails. Each is summed
    from its inner end outwards, so the cost follows the spread of the distribution and not the size
    of the margins.
    """
    return _exact(a, b, c, d, F.lit(1.0), _two_sided)


def fisher_at_most(a: Column, b: Column, c: Column, d: Column, alpha: Column) -> Column:
    """Is ``fisher_exact`` at most ``alpha``; summed up only where two bounds leave it open.

    The table itself is one of those counted, and none of them is likelier.
    """

    def decide(t: Column) -> Column:
        tables = F.log(t["high"] - t["low"] + 1)
        return (
            F.when(t["limit"] - 2 * _TIE > F.log(alpha), False).when(t["limit"] + tables <= F.log(alpha), True)
            .otherwise(_two_sided(t) <= alpha)
        )

    return _exact(a, b, c, d, alpha >= 1.0, decide)
