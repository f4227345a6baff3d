"""Column helpers for distributions: normal scores, log gamma, and counts drawn from hashes of their row."""

import math

from pyspark.sql import Column, functions as F

# fixed values: the published rational approximation of the inverse normal distribution function
CENTRAL_UP = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
CENTRAL_DOWN = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
TAIL_UP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
TAIL_DOWN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
TAIL = 0.02425


def _polynomial(x: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + t
    return out


def normal_score(p: Column) -> Column:
    """Inverse of the standard normal distribution function, to 9 digits, for 0 < p < 1."""
    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return (F.when(p < TAIL, _polynomial(low, TAIL_UP) / _polynomial(low, TAIL_DOWN))
            .when(p > 1 - TAIL, -_polynomial(high, TAIL_UP) / _polynomial(high, TAIL_DOWN))
            .otherwise(q * _polynomial(r, CENTRAL_UP) / _polynomial(r, CENTRAL_DOWN)))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0: moved up by eight, then the asymptotic series."""
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def hash_uniform(k: int | Column, ids: list[str], seed: int = 1) -> Column:
    """A number strictly between 0 and 1 from the row's ids: the first 12 digits of an MD5, which any engine can repeat."""
    number = F.lit(str(seed * 10 + k)) if isinstance(k, int) else (k + seed * 1000).cast("string")
    digest = F.md5(F.concat_ws("|", number, *[F.col(c).cast("string") for c in ids]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


TRIES = 12            # of a rejection; each fails less often than one time in eight
SMALL_RATE = 10.0     # below, counts come from the inverse distribution function


def _with(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of values, each worked out once however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), F.lit(0))


def _first_accepted(attempt) -> Column:
    """The first of ``TRIES`` attempts that is not NULL; later ones are not worked out."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"),
                       lambda found, i: F.when(found.isNotNull(), found).otherwise(attempt(i)))


def gamma_draw(shape: Column, ids: list[str], seed: int = 1) -> Column:
    """A gamma draw of scale 1: a cubed normal, accepted or tried again with the row's next hashes; the shape itself should
    none be accepted (less than one row in 10^15). Shapes below 1 are drawn one higher and brought back by a power."""
    d = F.when(shape < 1, shape + 1).otherwise(shape) - 1.0 / 3

    def drawn(f):
        def attempt(i):
            z = F.sqrt(-2 * F.log(hash_uniform(i * 3 + 1, ids, seed))) * F.cos(2 * F.pi() * hash_uniform(i * 3 + 2, ids, seed))
            return _with({"z": z, "u": hash_uniform(i * 3 + 3, ids, seed)}, lambda t: _with(
                {"z": t["z"], "u": t["u"], "v": F.pow(1 + t["z"] / F.sqrt(9 * f["d"]), F.lit(3.0))}, taken))

        def taken(t):
            v = F.when(t["v"] > 0, t["v"]).otherwise(1.0)
            return F.when((t["v"] > 0) & (F.log(t["u"]) < 0.5 * t["z"] * t["z"] + f["d"] - f["d"] * t["v"] + f["d"] * F.log(v)), f["d"] * t["v"])

        return F.coalesce(_first_accepted(attempt), f["d"] + 1.0 / 3)

    raised = _with({"d": d}, drawn)
    return F.when(shape < 1, raised * F.pow(hash_uniform(F.lit(90), ids, seed), 1 / shape)).otherwise(raised)


def poisson_draw(rate: Column, ids: list[str], seed: int = 1) -> Column:
    """A Poisson draw from hashes of the row: rates below 10 by the inverse distribution function, larger ones by transformed
    rejection; the rounded rate should all tries be rejected (less than one row in 10^9). No rate, or one below 0, gives NULL."""
    def inverse(f):
        def step(s, k):
            p = s["p"] * f["rate"] / k
            return F.struct((s["n"] + F.when(f["u"] > s["cum"], 1.0).otherwise(0.0)).alias("n"), p.alias("p"), (s["cum"] + p).alias("cum"))

        start = F.struct(F.lit(0.0).alias("n"), F.exp(-f["rate"]).alias("p"), F.exp(-f["rate"]).alias("cum"))
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: k.cast("double")), start, step)["n"]

    def rejection(f):
        def attempt(i):
            u = hash_uniform(i * 2 + 100, ids, seed) - 0.5
            return _with({"u": u, "v": hash_uniform(i * 2 + 101, ids, seed)}, lambda t: _with(
                {"us": 0.5 - F.abs(t["u"]), "v": t["v"], "x": F.floor((2 * f["a"] / (0.5 - F.abs(t["u"])) + f["b"]) * t["u"] + f["rate"] + 0.43).cast("double")}, taken))

        def taken(t):
            k = F.greatest(t["x"], F.lit(0.0))
            quick = (t["us"] >= 0.07) & (t["v"] <= 0.9277 - 3.6224 / (f["b"] - 2))
            sound = (t["x"] >= 0) & ((t["us"] >= 0.013) | (t["v"] <= t["us"]))
            bound = (F.log(t["v"]) + F.log(1.1239 + 1.1328 / (f["b"] - 3.4)) - F.log(f["a"] / (t["us"] * t["us"]) + f["b"])
                     <= -f["rate"] + k * F.log(f["rate"]) - log_gamma(k + 1))
            return F.when(quick | (sound & bound), t["x"])

        return F.coalesce(_first_accepted(attempt), F.round(f["rate"]))

    small = _with({"rate": rate, "u": hash_uniform(F.lit(91), ids, seed)}, inverse)
    b = 0.931 + 2.53 * F.sqrt(F.greatest(rate, F.lit(SMALL_RATE)))
    large = _with({"rate": rate, "b": b, "a": -0.059 + 0.02483 * b}, rejection)
    return F.when((rate >= 0) & (rate < SMALL_RATE), small).when((rate >= SMALL_RATE) & (rate < float("inf")), large)
