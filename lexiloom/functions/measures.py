"""Statistical measures as Column expressions.

Counts may be of any numeric type; all are cast to double first, so products of
large counts cannot overflow.  Every guard stands before the expression that it
protects, as division by zero is an error in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def infinity(sign: int = 1) -> Column:
    return F.lit(float("inf") * sign)


def expected(r, c, n) -> Column:
    """R*C/N; null where N is not positive."""
    return F.when(_d(n) > 0, _d(r) * _d(c) / _d(n))


def mutual_information(o, r, c, n) -> Column:
    return F.when(_d(o) <= 0, infinity(-1)).otherwise(F.log2(_d(o) / expected(r, c, n)))


def t_score(o, r, c, n) -> Column:
    return F.when(_d(o) <= 0, F.lit(0.0)).otherwise((_d(o) - expected(r, c, n)) / F.sqrt(_d(o)))


def dice(joint, fx, fy) -> Column:
    total = _d(fx) + _d(fy)
    return F.when(total <= 0, F.lit(0.0)).otherwise(2 * _d(joint) / total)


def log_dice(joint, fx, fy) -> Column:
    d = dice(joint, fx, fy)
    return F.when(d <= 0, infinity(-1)).otherwise(14 + F.log2(d))


def _cells(a, b, c, d) -> list[tuple[Column, Column]]:
    a, b, c, d = map(_d, (a, b, c, d))
    n = a + b + c + d
    return [(o, F.when(n > 0, r * k / n)) for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d))]


def log_likelihood(a, b, c, d) -> Column:
    """2 * sum of O ln(O/E); empty cells add nothing, an empty table gives 0."""
    terms = [F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0) for o, e in _cells(a, b, c, d)]
    return 2 * (terms[0] + terms[1] + terms[2] + terms[3])


def chi_square(a, b, c, d) -> Column:
    terms = [F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0) for o, e in _cells(a, b, c, d)]
    return terms[0] + terms[1] + terms[2] + terms[3]


def delta_p(joint, fx, fy, n) -> tuple[Column, Column]:
    """(P(y|x) - P(y|not x), P(x|y) - P(x|not y)); zeros where a count is not positive."""
    joint, fx, fy, n = map(_d, (joint, fx, fy, n))
    some = (fx > 0) & (fy > 0) & (n > 0)

    def one(x: Column, y: Column) -> Column:
        rest = F.when(n - x > 0, (y - joint) / (n - x)).otherwise(0.0)
        return F.when(some, joint / F.when(x > 0, x) - rest).otherwise(0.0)

    return one(fx, fy), one(fy, fx)


def per_million(f, n) -> Column:
    return F.when(_d(n) > 0, _d(f) / _d(n) * 1e6).otherwise(0.0)


def log_ratio(f1, f2, n1, n2) -> Column:
    p, q = per_million(f1, n1), per_million(f2, n2)
    return F.when((p == 0) & (q == 0), 0.0).when(p == 0, infinity(-1)).when(q == 0, infinity()).otherwise(F.log2(p / q))


def percent_difference(f1, f2, n1, n2) -> Column:
    p, q = per_million(f1, n1), per_million(f2, n2)
    return F.when(q > 0, (p - q) / q * 100).when(p > 0, infinity()).otherwise(0.0)


def simple_maths(f1, f2, n1, n2, smooth: float = 1.0) -> Column:
    return (per_million(f1, n1) + smooth) / (per_million(f2, n2) + smooth)


def odds_ratio(f1, f2, n1, n2) -> Column:
    below = _d(f2) * (_d(n1) - _d(f1))
    return F.when(below > 0, _d(f1) * (_d(n2) - _d(f2)) / below).when(_d(f1) > 0, infinity()).otherwise(0.0)


def keyness_columns(f1: Column, f2: Column, n1: Column, n2: Column) -> dict[str, Column]:
    """The six keyness measures by name."""
    cells = (f1, _d(n1) - _d(f1), f2, _d(n2) - _d(f2))
    return {
        "log_likelihood": log_likelihood(*cells),
        "chi_square": chi_square(*cells),
        "log_ratio": log_ratio(f1, f2, n1, n2),
        "pct_diff": percent_difference(f1, f2, n1, n2),
        "simple_maths": simple_maths(f1, f2, n1, n2),
        "odds_ratio": odds_ratio(f1, f2, n1, n2),
    }


def juilland_d(mean: Column, sd: Column, parts: Column) -> Column:
    """Evenness of a frequency over parts, from its population mean and deviation."""
    n = _d(parts)
    return F.when(n < 2, 1.0).when(mean == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (sd / F.when(mean != 0, mean)) / F.sqrt(F.greatest(n - 1, F.lit(1.0)))))


def deviation_of_proportions(total_difference: Column) -> Column:
    """Half the summed absolute difference of observed and expected shares."""
    return 0.5 * total_difference


def type_token_ratio(types: Column, tokens: Column) -> Column:
    return F.when(_d(tokens) > 0, _d(types) / _d(tokens)).otherwise(0.0)


def sentiment_score(p: Column, n: Column) -> Column:
    return (_d(p) - _d(n)) / (_d(p) + _d(n) + 1)


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.05, "positive").when(score < -0.05, "negative").otherwise("neutral")


def length_ratio_confidence(a: Column, b: Column) -> Column:
    """1 less half the distance of the length ratio from one, 0 at least; 0.5 where a side is empty."""
    return F.when((_d(a) <= 0) | (_d(b) <= 0), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 0.5 * F.abs(1 - _d(a) / F.when(_d(b) > 0, _d(b)))))


def colour_distance(r1, g1, b1, r2, g2, b2) -> Column:
    """Euclidean RGB distance, 0 to 1."""
    return F.sqrt(F.pow(_d(r1) - _d(r2), 2) + F.pow(_d(g1) - _d(g2), 2) + F.pow(_d(b1) - _d(b2), 2)) / (3**0.5 * 255)
