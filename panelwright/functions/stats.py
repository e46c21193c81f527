"""Normal quantile and Student t probability as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Rational approximations of the normal quantile (Wichura 1988, AS 241, PPND16),
# lowest power first.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


def _rational(pair, x: Column) -> Column:
    return _poly(pair[0], x) / _poly(pair[1], x)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1."""
    q = p - 0.5
    near = q * _rational(CENTRE, F.lit(0.180625) - q * q)
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    far = F.when(r <= 5.0, _rational(MIDDLE, r - 1.6)).otherwise(_rational(TAIL, r - 5.0))
    return F.when(F.abs(q) <= 0.425, near).otherwise(F.signum(q) * far)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for whole degrees of freedom, by the finite trigonometric series."""
    df = df.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos, sin = F.cos(theta), F.sin(theta)
    even = df % 2 == 0
    last = F.when(even, (df - 2) / 2).otherwise((df - 3) / 2).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        up = F.when(even, (2 * k - 1) / (2.0 * k)).otherwise((2 * k) / (2.0 * k + 1))
        term = acc["term"] * up * cos * cos
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, zero, step, lambda a: a["total"])
    inside = (
        F.when(even, sin * series)
        .when(df == 1, 2 * theta / F.pi())
        .otherwise((theta + sin * cos * series) * 2 / F.pi())
    )
    return F.greatest(1 - inside, F.lit(0.0))
