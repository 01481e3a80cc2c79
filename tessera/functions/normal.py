"""The normal distribution and its inverse as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximations published by Hart (1968, no. 5666) for the distribution, and by Wichura (1988, AS 241) for
# its inverse, highest power first.
_UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_MIDDLE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _polynomial(x: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + t
    return out


def _bound(x: Column, of) -> Column:
    """of(x), with x computed once however often it is used."""
    return F.element_at(F.transform(F.array(x), of), 1)


def cdf(x: Column) -> Column:
    """The chance that a standard normal value is below x; within 1e-14. Null for null."""
    return _bound(x, _cdf)


def inverse(p: Column) -> Column:
    """The value that a standard normal one is below with chance p; within 1e-14 of its size. Null unless 0 < p < 1."""
    return _bound(p, _inverse)


def _cdf(x: Column) -> Column:
    z = F.least(F.abs(x), F.lit(37.0))
    near = F.exp(-z * z / 2) * _polynomial(z, _UPPER) / _polynomial(z, _LOWER)
    fraction = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = z + k / fraction
    far = F.exp(-z * z / 2) / fraction / math.sqrt(2 * math.pi)
    tail = F.when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.when(x > 0, 1.0 - tail).otherwise(tail))


def _inverse(p: Column) -> Column:
    q = p - 0.5
    r = 0.180625 - q * q
    centre = q * _polynomial(r, _CENTRE[0]) / _polynomial(r, _CENTRE[1])
    s = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    part = lambda t, terms: _polynomial(t, terms[0]) / _polynomial(t, terms[1])
    outer = F.when(s <= 5, part(s - 1.6, _MIDDLE)).otherwise(part(s - 5.0, _TAIL))
    value = F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer)
    return F.when((p > 0) & (p < 1), value)
