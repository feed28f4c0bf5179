"""Distribution functions as column expressions, for tables of tests.

Regularised incomplete beta and gamma functions by continued fractions (Lentz's form)
and, for the lower gamma, its series, each an ``aggregate`` over a sequence whose
length follows from the arguments: terms after convergence change nothing. All run in
the JVM, a row at a time. Relative accuracy is about 1e-10 or better; a row of
parameter a takes some sqrt(a) steps. Degrees of freedom past MANY are held there, which
moves p-values by less than one in MANY.

Null and not finite arguments, and degrees of freedom that are not positive, give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MANY = 1e9
TINY = 1e-300
#: Coefficients of ln Gamma's Stirling series: B(2k) / (2k (2k - 1)) (fixed values).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
SHIFT = 9


def _col(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def log_gamma(x) -> Column:
    """ln Gamma of a positive number: Stirling's series at x + SHIFT, less the factors between."""
    x = _col(x)
    y = x + SHIFT
    series = sum((F.lit(c) / F.pow(y, F.lit(float(2 * k + 1))) for k, c in enumerate(STIRLING)), F.lit(0.0))
    factors = x
    for k in range(1, SHIFT):
        factors = factors * (x + k)
    small = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - F.ln(factors)
    large = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(x < 1e6, small).otherwise(large)


def log_gamma_ratio(x, d) -> Column:
    """ln Gamma(x + d) - ln Gamma(x) of positive x and d, without subtracting large numbers where x is large."""
    x, d = _col(x), _col(d)
    series = lambda y: 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    large = (x + d - 0.5) * F.log1p(d / x) + d * F.ln(x) - d + series(x + d) - series(x)
    return F.when(x > 200, large).otherwise(log_gamma(x + d) - log_gamma(x))


def _floored(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _steps(size: Column, least: int) -> Column:
    return F.sequence(F.lit(1), (F.lit(least) + F.ceil(4 * F.sqrt(size))).cast("int"))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, for x below (a + 1) / (a + b + 2)."""
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    d = 1 / _floored(1 - (a + b) * x / (a + 1))

    def step(s, i):
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / _floored(1 + even * s["d"]), _floored(1 + even / s["c"])
        h1 = s["h"] * d1 * c1
        d2, c2 = 1 / _floored(1 + odd * d1), _floored(1 + odd / c1)
        return state(c2, d2, h1 * d2 * c2)

    return F.aggregate(_steps(F.greatest(a, b), 60), state(F.lit(1.0), d, d), step)["h"]


def _finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def _let(body: Callable[..., Column], **columns: Column) -> Column:
    """body of these columns, each computed once a row."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])), lambda s: body(**{n: s[n] for n in columns}))[0]


def _beta(a: Column, b: Column, x: Column, y: Column) -> Column:
    """I_x(a, b) of positive a and b, with y = 1 - x given apart, so that neither end loses digits."""

    def inside(a: Column, b: Column, x: Column, y: Column, other: Column) -> Column:
        more, less = F.greatest(a, b), F.least(a, b)
        log_beta = log_gamma(less) - log_gamma_ratio(more, less)
        front = F.exp(a * F.when(x < 0.5, F.ln(x)).otherwise(F.log1p(-y)) + b * F.when(y < 0.5, F.ln(y)).otherwise(F.log1p(-x)) - log_beta)
        part = front * _beta_fraction(a, b, x) / a
        return F.when(other, 1 - part).otherwise(part)

    def end(a: Column, b: Column, x: Column, y: Column) -> Column:
        other = x >= (a + 1) / (a + b + 2)  # the fraction converges fast on this side alone
        pick = lambda p, q: F.when(other, p).otherwise(q)
        return F.when(x <= 0, 0.0).when(y <= 0, 1.0).otherwise(_let(inside, a=pick(b, a), b=pick(a, b), x=pick(y, x), y=pick(x, y), other=other))

    return _let(end, a=a, b=b, x=x, y=y)


def beta_cdf(a, b, x) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = _col(a), _col(b), _col(x)
    return F.when(_finite(a, b, x) & (a > 0) & (b > 0), _beta(a, b, x, 1 - x))


def gamma_sf(s, x) -> Column:
    """The regularised upper incomplete gamma function Q(s, x)."""
    s, x = _col(s), _col(x)
    return F.when(_finite(s, x) & (s > 0), F.when(x <= 0, 1.0).otherwise(_let(_gamma_sf, s=s, x=x)))


def _gamma_sf(s: Column, x: Column) -> Column:
    front = F.exp(s * F.ln(x) - x - log_gamma(s))
    series = F.aggregate(_steps(s, 80), F.struct((1 / s).alias("t"), (1 / s).alias("sum")), lambda acc, i: F.struct((acc["t"] * x / (s + i)).alias("t"), (acc["sum"] + acc["t"] * x / (s + i)).alias("sum")))["sum"]
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    first = 1 / _floored(x + 1 - s)

    def step(acc, i):
        m = i.cast("double")
        an, bn = -m * (m - s), x + 2 * m + 1 - s
        d, c = 1 / _floored(an * acc["d"] + bn), _floored(bn + an / acc["c"])
        return state(c, d, acc["h"] * d * c)

    fraction = F.aggregate(_steps(s, 200), state(F.lit(1 / TINY), first, first), step)["h"]
    return F.when(x < s + 1, 1 - front * series).otherwise(front * fraction)


def _held(df: Column) -> Column:
    return F.when((df > MANY) & ~F.isnan(df), F.lit(MANY)).otherwise(df)


def t_two_sided(t, df) -> Column:
    """P(|T| >= |t|) of Student's t."""
    t, df = _col(t), _held(_col(df))
    return F.when(_finite(t, df) & (df > 0), _beta(df / 2, F.lit(0.5), df / (df + t * t), t * t / (df + t * t)))


def f_sf(f, df_num, df_den) -> Column:
    """P(F >= f)."""
    f, a, b = _col(f), _held(_col(df_num)), _held(_col(df_den))
    return F.when(_finite(f, a, b) & (a > 0) & (b > 0), F.when(f <= 0, 1.0).otherwise(_beta(b / 2, a / 2, b / (b + a * f), a * f / (b + a * f))))


def chi2_sf(x, df) -> Column:
    """P(X >= x) of chi-square."""
    x, df = _col(x), _col(df)
    return gamma_sf(df / 2, x / 2)


def normal_two_sided(z) -> Column:
    """P(|Z| >= |z|) of the standard normal."""
    z = _col(z)
    return gamma_sf(F.lit(0.5), z * z / 2)


def mann_whitney_two_sided(u, n1, n2, tie_sum) -> Column:
    """Normal approximation with tie and continuity corrections; tie_sum is the sum of t^3 - t over ties. 1 where all values tie."""
    u, n1, n2, ties = (_col(x) for x in (u, n1, n2, tie_sum))
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), (F.abs(u - n1 * n2 / 2) - 0.5) / F.when(sd > 0, sd))
    return F.when(_finite(u, n1, n2, ties), F.coalesce(normal_two_sided(z), F.lit(1.0)))


def fisher_two_sided(a, b, c, d) -> Column:
    """Two-sided exact p of each row's table [[a, b], [c, d]]: all tables as likely as it or less, with a tolerance of 1e-7 relative."""
    a, b, c, d = (_col(x) for x in (a, b, c, d))
    rows, columns, n = a + b, a + c, a + b + c + d
    choose = lambda m, k: log_gamma(m + 1) - log_gamma(k + 1) - log_gamma(m - k + 1)
    at = lambda k: F.exp(choose(rows, k) + choose(n - rows, columns - k) - choose(n, columns))
    own = at(a)
    low, high = F.greatest(F.lit(0.0), columns + rows - n), F.least(rows, columns)
    total = F.aggregate(F.sequence(low.cast("long"), high.cast("long")), F.lit(0.0), lambda acc, k: acc + F.when(at(k.cast("double")) <= own * (1 + 1e-7), at(k.cast("double"))).otherwise(0.0))
    return F.when(_finite(a, b, c, d) & (n > 0), F.least(F.lit(1.0), total))
