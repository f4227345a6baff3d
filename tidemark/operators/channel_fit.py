"""Fits in which every channel has its own response shape, with stated priors and a chosen likelihood.

Spark scales the weekly table, takes the lags, puts each channel through a dictionary of shapes and lays out one row per
(panel, week). A panel's weeks, whose number the calendar bounds, then meet in one task: sums of products of all
channel-shape columns are taken once per reweighting, and the search changes one channel's shape at a time on small
systems cut out of them. Panels are dealt over the cluster.

Model of a panel: eta = level + trend + season + controls + sum of beta * effect(channel), beta >= 0.
``normal`` and ``student_t``: KPI / max = eta + noise. ``negative_binomial`` and ``poisson``: count with mean exp(eta).
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, over
from tidemark.functions.response import alpha_from_half_life, hill_effect, logistic_effect
from tidemark.operators.features import fourier
from tidemark.operators.fit import block_repeats, kernel, nonnegative, scale, scalers, weighted_systems
from tidemark.operators.response import lags

COUNTS = ("negative_binomial", "poisson")
STUDENT_T_NU = 4.0
TINY = 1e-9
FIT = ("choice array<int>, coef array<double>, sigma double, dispersion double, loglik double, gradient array<double>, "
       "n_obs int, rounds int")


@dataclass(frozen=True)
class Shape:
    """Carry-over (peaked at ``theta`` weeks, or geometric) and saturation (logistic with ``lam``, or Hill)."""

    half_life: float
    half_sat: float | None = None
    slope: float = 1.0
    lam: float | None = None
    theta: float | None = None


def shape_grid(half_lives=(0.5, 1.0, 2.5, 5.0), half_sats=(0.15, 0.3, 0.6, 1.2), slopes=(1.0,), lams=(), thetas=(None,)) -> list[Shape]:
    hills = [dict(half_sat=k, slope=s) for k in half_sats for s in slopes]
    return [Shape(h, theta=t, **sat) for h in half_lives for t in thetas for sat in [*hills, *[dict(lam=x) for x in lams]]]


# --- weekly rows with every shape's effect -------------------------------------------------------

def _kernels(shapes: list[Shape], l_max: int) -> tuple[list[list[float]], list[int]]:
    found, at = [], []
    for s in shapes:
        w = kernel(s, l_max)
        if w not in found:
            found.append(w)
        at.append(found.index(w))
    return found, at


def shape_effects(spend: DataFrame, keys: list[str], shapes: list[Shape], l_max: int = fx.L_MAX) -> DataFrame:
    """(keys, week, series, effects, directs): scaled spend through each shape, in the order of ``shapes``.

    Shapes with one carry-over share its stock. ``directs`` are the shares of the stock that are the week's own spend.
    """
    weights, at = _kernels(shapes, l_max)
    x = spend.withColumn("_lags", F.array(*lags(keys, l_max, "scaled")))
    literal = F.array(*[F.array(*[F.lit(float(w)) for w in k]) for k in weights])
    x = x.withColumn("_stocks", F.transform(literal, lambda k: F.aggregate(
        F.zip_with("_lags", k, lambda v, w: v * w), F.lit(0.0), lambda total, v: total + v)))
    own = F.transform(literal, lambda k, i: F.when(F.get("_stocks", i) > 0, F.col("_lags")[0] * k[0] / F.get("_stocks", i)).otherwise(0.0))
    x = x.withColumn("_own", own)
    facts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s.half_sat).cast("double").alias("half_sat"), F.lit(float(s.slope)).alias("slope"),
                               F.lit(s.lam).cast("double").alias("lam")) for s, k in zip(shapes, at)])

    def effect(f):
        stock = F.get("_stocks", f["k"])
        return F.when(f["lam"].isNotNull(), logistic_effect(stock, f["lam"])).otherwise(hill_effect(stock, f["half_sat"], f["slope"]))

    return x.select(*keys, WEEK, "series", F.transform(facts, effect).alias("effects"),
                    F.transform(facts, lambda f: F.get("_own", f["k"])).alias("directs"))


def weekly_design(master: DataFrame, keys: list[str], kpi: str, channels: list[str], controls: list[str], shapes: list[Shape],
                  modes: int = 1, sizes: DataFrame | None = None, n_train: str | None = None) -> tuple[DataFrame, list[str]]:
    """One row per (panel, week): y, actual, y_max, idx, n_weeks, the free terms, and ``effects`` and ``directs`` of all
    channels and shapes as one array each. Returns the table and the names of the free terms.

    ``sizes`` scales by other weeks than the master's own; ``n_train`` names a column of ``master`` with the number of
    weeks that time is scaled by. A channel that a panel lacks has no effect there.
    """
    sizes = scalers(master, keys) if sizes is None else sizes
    sized = scale(master, sizes, keys)
    w = Window.partitionBy(*keys)
    base = sized.groupBy(*keys, WEEK).agg(
        F.max(F.when(F.col("series") == kpi, F.col("scaled"))).alias("y"),
        F.max(F.when(F.col("series") == kpi, F.col("value"))).alias("actual"),
        *([F.max(n_train).alias("_train")] if n_train else []),
        *[F.coalesce(F.max(F.when(F.col("series") == c, F.col("scaled"))), F.lit(0.0)).alias(f"z_{c}") for c in controls])
    idx = (F.row_number().over(w.orderBy(WEEK)) - 1).cast("double")
    base = base.withColumn("idx", idx).withColumn("n_weeks", F.count(F.lit(1)).over(w))
    span = (F.col("_train") if n_train else F.col("n_weeks")) - 1
    waves = fourier(F.col("idx"), 52.0, modes)
    base = base.withColumns({"one": F.lit(1.0), "t": F.coalesce(over(F.col("idx"), span), F.lit(0.0)), **waves}).drop("_train")
    spend = sized.where((F.col("role") == "spend") & F.col("series").isin(*channels))
    none = F.array_repeat(F.lit(0.0), len(shapes))

    def laid_out(name):
        return F.flatten(F.array(*[F.coalesce(F.max(F.when(F.col("series") == c, F.transform(name, lambda v: F.coalesce(v, F.lit(0.0))))), none)
                                   for c in channels])).alias(name)

    effects = shape_effects(spend, keys, shapes).groupBy(*keys, WEEK).agg(laid_out("effects"), laid_out("directs"))
    y_max = sizes.where(F.col("series") == kpi).select(*keys, F.col("size").alias("y_max"))
    free = ["one", "t", *waves, *[f"z_{c}" for c in controls]]
    return base.join(effects, [*keys, WEEK]).join(y_max, keys), free


def with_choice(design: DataFrame, fitted: DataFrame, keys: list[str], channels: list[str], n_shapes: int) -> DataFrame:
    """The design with one column per channel: ``x_`` the effect of its chosen shape, ``d_`` the direct share."""
    cells = {f"{p}_{c}": F.get(source, F.lit(i * n_shapes) + F.get("choice", F.lit(i)))
             for i, c in enumerate(channels) for p, source in (("x", "effects"), ("d", "directs"))}
    return design.join(fitted.select(*keys, "choice"), keys).withColumns(cells).drop("effects", "directs", "choice")


# --- priors as numbers of the system -------------------------------------------------------------

def prior_terms(panel: DataFrame, priors: DataFrame, keys: list[str], free: list[str], channels: list[str], shapes: list[Shape]) -> DataFrame:
    """(keys, likelihood, mean, sd, noise_sd, penalty) from the tables of ``measure.baseline_priors`` and ``measure.channel_priors``.

    ``mean`` and ``sd`` belong to the free terms and then the channels, whose effects are half-normal. ``penalty`` holds,
    channel by channel, minus the log prior density of each shape; NULL where the channel's carry-over or saturation kind
    is another. ``panel`` needs the baseline priors, ``likelihood`` and ``kpi_max``. Under a log link the level's prior is
    the log of the outcome expected without channels.
    """
    def penalty(s: Shape) -> Column:
        alpha = 0.5 ** (1 / s.half_life) if s.half_life > 0 else TINY
        center = F.least(F.greatest(alpha_from_half_life(F.col("half_life")), F.lit(1e-6)), F.lit(1 - 1e-6))
        out = (-(center * F.col("adstock_concentration") - 1) * math.log(alpha)
               - ((1 - center) * F.col("adstock_concentration") - 1) * math.log(1 - alpha))
        if s.theta is not None:
            out = out + F.pow((F.lit(float(s.theta)) - F.col("delayed_peak_weeks")) / F.col("delayed_peak_sigma"), F.lit(2.0)) / 2
        if s.lam is not None:
            out = out + F.pow(F.lit(float(s.lam)) / F.col("logistic_lam_sigma"), F.lit(2.0)) / 2
        else:
            out = out + (F.pow((math.log(s.half_sat) - F.log("halfsat_log_center")) / F.col("halfsat_log_sigma"), F.lit(2.0)) / 2 + math.log(s.half_sat)
                         - (F.col("hill_slope_a") - 1) * math.log(s.slope) + F.col("hill_slope_b") * s.slope)
        fits = ((F.col("adstock") == ("geometric" if s.theta is None else "delayed"))
                & (F.col("saturation") == ("hill" if s.lam is None else "logistic")))
        return F.when(fits, out)

    rows = priors.select(*keys, "series", "beta_sigma", F.array(*[penalty(s) for s in shapes]).alias("penalty"))
    anything = F.array_repeat(F.lit(0.0), len(shapes))      # a channel without a stated prior may take any shape
    per = rows.groupBy(*keys).agg(
        F.array(*[F.max(F.when(F.col("series") == c, F.col("beta_sigma"))) for c in channels]).alias("_b"),
        F.flatten(F.array(*[F.coalesce(F.max(F.when(F.col("series") == c, F.col("penalty"))), anything) for c in channels])).alias("penalty"))
    count = F.col("likelihood").isin(*COUNTS)
    level = F.when(count, F.log(F.greatest(F.col("intercept_mu") * F.col("kpi_max"), F.lit(1.0)))).otherwise(F.col("intercept_mu"))

    def sd(name: str) -> Column:
        if name == "one":
            return F.when(count, F.lit(1.0)).otherwise(F.col("intercept_sigma"))
        return F.col("trend_sigma" if name == "t" else "control_sigma" if name.startswith("z_") else "season_sigma")

    zeros = [F.lit(0.0)] * (len(free) - 1 + len(channels))
    return panel.join(per, keys).select(*keys, "likelihood", F.array(level, *zeros).alias("mean"),
                                        F.concat(F.array(*[sd(f) for f in free]), "_b").alias("sd"),
                                        F.col("noise_sigma").alias("noise_sd"), "penalty")


# --- small solves --------------------------------------------------------------------------------

@dataclass
class Prior:
    """Prior of one panel; without stated priors nothing but a trace of ridge is added."""

    mean: np.ndarray
    precision: np.ndarray
    penalty: np.ndarray          # channels by shapes, inf where not allowed
    noise_sd: float

    @classmethod
    def of(cls, row, n_free: int, n_channels: int, n_shapes: int) -> Prior:
        p = n_free + n_channels
        if row is None:
            return cls(np.zeros(p), np.zeros(p), np.zeros((n_channels, n_shapes)), math.nan)
        number = lambda v: np.array([math.nan if x is None else x for x in v], float)
        sd, mean, penalty = number(row.sd), number(row.mean), number(row.penalty).reshape(n_channels, n_shapes)
        precision = np.where(np.isfinite(sd) & (sd > 0), 1 / np.square(np.where(sd > 0, sd, 1.0)), 0.0)
        penalty = np.where(np.isnan(penalty), np.inf, penalty)
        penalty[~np.isfinite(penalty).any(axis=1)] = 0.0     # no shape of the dictionary is of the stated kind: all may be taken
        return cls(np.nan_to_num(mean), precision, penalty, float(row.noise_sd) if row.noise_sd is not None else math.nan)

    def system(self, xx: np.ndarray, xz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = xx + np.diag(self.precision)
        return a + 1e-9 * np.eye(len(xz)) * max(np.trace(a) / len(xz), 1e-12), xz + self.precision * self.mean

    def loss(self, b: np.ndarray) -> float:
        return 0.5 * float(self.precision @ np.square(b - self.mean))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x).tolist()]).reshape(np.shape(x))


class Likelihood:
    """What a week says about eta, as weights and a working response; ``scale`` is sigma or the dispersion."""

    def __init__(self, kind: str, y: np.ndarray, prior: Prior, nu: float = STUDENT_T_NU):
        self.kind, self.y, self.nu, self.count = kind, y, nu, kind in COUNTS
        self.noise_sd = prior.noise_sd
        spread = float(np.std(y)) or 1.0
        self.scale = math.inf if kind == "poisson" else 10.0 if self.count else spread
        self._y_gamma = _lgamma(y + 1) if self.count else None

    def start(self) -> np.ndarray:
        return np.log(self.y + 0.5) if self.count else self.y

    def working(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.count:
            mu = np.exp(np.clip(eta, -30, 30))
            return mu / (1 + mu / self.scale), eta + (self.y - mu) / mu
        r = self.y - eta
        if self.kind == "student_t":
            return (self.nu + 1) / (self.nu * self.scale ** 2 + r * r), self.y
        return np.full(len(r), 1 / self.scale ** 2), self.y

    def score(self, eta: np.ndarray) -> np.ndarray:
        """Derivative of the log likelihood by each week's eta."""
        w, z = self.working(eta)
        return w * (z - eta)

    def loglik(self, eta: np.ndarray, scale: float | None = None) -> float:
        s, y = self.scale if scale is None else scale, self.y
        if self.count:
            mu = np.exp(np.clip(eta, -30, 30))
            if math.isinf(s):
                return float((y * np.log(mu) - mu - self._y_gamma).sum())
            return float((_lgamma(y + s) - math.lgamma(s) - self._y_gamma + s * np.log(s / (s + mu)) + y * np.log(mu / (s + mu))).sum())
        r2 = np.square((y - eta) / s)
        if self.kind == "student_t":
            c = math.lgamma((self.nu + 1) / 2) - math.lgamma(self.nu / 2) - 0.5 * math.log(self.nu * math.pi) - math.log(s)
            return float(len(y) * c - (self.nu + 1) / 2 * np.log1p(r2 / self.nu).sum())
        return float(-0.5 * r2.sum() - len(y) * (math.log(s) + 0.5 * math.log(2 * math.pi)))

    def rescale(self, eta: np.ndarray, p: int) -> None:
        """Sigma by its update at the present eta (half-normal prior where one is stated), dispersion by its best value of a
        logarithmic grid under its gamma prior."""
        if self.kind == "poisson":
            return
        if self.count:
            grid = np.geomspace(0.05, 5000, 60)
            self.scale = float(max(grid, key=lambda s: self.loglik(eta, s) + math.log(s) - 0.1 * s))
            return
        r2 = np.square(self.y - eta)
        if self.kind == "student_t":
            r2 = r2 * (self.nu + 1) / (self.nu + r2 / self.scale ** 2)
            s2 = r2.mean()
        else:
            s2 = r2.sum() / max(len(r2) - p, 1)
        if np.isfinite(self.noise_sd) and self.noise_sd > 0:    # d/ds of n log s + ss / (2 s^2) + s^2 / (2 tau^2) is 0 there
            n, t2 = len(r2), self.noise_sd ** 2
            s2 = (-n * t2 + math.sqrt((n * t2) ** 2 + 4 * t2 * n * s2)) / 2
        self.scale = max(math.sqrt(s2), TINY)


def climb(x: np.ndarray, like: Likelihood, prior: Prior, b: np.ndarray | None, n_free: int, weights: np.ndarray | None = None,
          rounds: int = 60, rescale: bool = True) -> tuple[np.ndarray, int]:
    """Reweighted least squares up the log posterior; ``weights`` repeats weeks. Steps that go down are halved."""
    m = np.ones(len(x)) if weights is None else weights

    def objective(eta, beta):
        if weights is None:
            return like.loglik(eta) - prior.loss(beta)
        w, z = like.working(eta)                     # weights are whole repeats: the quadratic around eta stands in
        return -0.5 * float((m * w * np.square(z - eta)).sum()) - prior.loss(beta)

    if b is None:
        w, z = np.full(len(x), like.working(like.start())[0].mean()), like.start()
        b = nonnegative(*prior.system((x.T * (w * m)) @ x, x.T @ (w * m * z)), n_free)
        if rescale:
            like.rescale(x @ b, x.shape[1])
    for k in range(1, rounds + 1):
        eta = x @ b
        w, z = like.working(eta)
        step = nonnegative(*prior.system((x.T * (w * m)) @ x, x.T @ (w * m * z)), n_free)
        if like.count and weights is None:
            before = objective(eta, b)
            for _ in range(20):
                if objective(x @ step, step) >= before - 1e-12 * abs(before):
                    break
                step = (step + b) / 2
        moved = np.abs(step - b).max(initial=0.0)
        b, was = step, like.scale
        if rescale:
            like.rescale(x @ b, x.shape[1])
        change = 0.0 if like.scale == was else abs(like.scale / was - 1)
        if moved <= 1e-9 * (1 + np.abs(b).max(initial=0.0)) and change < 1e-9:
            break
    return b, k


# --- search --------------------------------------------------------------------------------------

def _best_shapes(g: np.ndarray, gz: np.ndarray, prior: Prior, start: list[int], n_free: int, sweeps: int = 12) -> tuple[float, list[int]]:
    """Block-coordinate search: each channel in turn takes the shape that makes the penalised quadratic least.

    ``g``, ``gz``: sums of products of the free terms and all channel-shape columns, and with the working response.
    """
    channels, shapes = prior.penalty.shape
    choice, free = list(start), list(range(n_free))

    def loss(picked):
        at = free + [n_free + c * shapes + k for c, k in enumerate(picked)]
        a, r = prior.system(g[np.ix_(at, at)], gz[at])
        b = nonnegative(a, r, n_free)
        return 0.5 * float(b @ a @ b) - float(r @ b) + sum(prior.penalty[c, k] for c, k in enumerate(picked))

    best = loss(choice)
    for _ in range(sweeps):
        before = list(choice)
        for c in range(channels):
            for k in range(shapes):
                if k != choice[c] and np.isfinite(prior.penalty[c, k]):
                    tried = loss([*choice[:c], k, *choice[c + 1:]])
                    if tried < best - 1e-9 * (1 + abs(best)):
                        best, choice = tried, [*choice[:c], k, *choice[c + 1:]]
        if choice == before:
            break
    return best, choice


def search(free: np.ndarray, effects: np.ndarray, like: Likelihood, prior: Prior, turns: int = 6) -> tuple[list[int], np.ndarray, int]:
    """(choice, coefficients, rounds): shapes and fit in turn until the shapes stay.

    Two starts, the prior's own shapes and the best one that all channels may share; the working response and weights are
    those of the fit so far.
    """
    n, n_free = free.shape
    channels, shapes = prior.penalty.shape
    z_all = np.hstack([free, effects.reshape(n, channels * shapes)])
    columns = lambda picked: np.hstack([free, np.stack([effects[:, c, k] for c, k in enumerate(picked)], axis=1)]) if channels else free
    choice = [int(k) for k in prior.penalty.argmin(axis=1)]
    shared = [k for k in range(shapes) if np.isfinite(prior.penalty[:, k]).all()]
    b, rounds = climb(columns(choice), like, prior, None, n_free)
    for turn in range(turns):
        w, z = like.working(columns(choice) @ b)
        g, gz = (z_all.T * w) @ z_all, z_all.T @ (w * z)
        starts = [choice]
        if turn == 0 and shared and channels:
            commons = [[k] * channels for k in shared]
            starts.append(min(commons, key=lambda c: _best_shapes(g, gz, prior, c, n_free, 0)[0]))
        found = min(_best_shapes(g, gz, prior, s, n_free) for s in starts)[1]
        same = found == choice
        choice = found
        b, k = climb(columns(choice), like, prior, b, n_free)
        rounds += k
        if same:
            break
    return choice, b, rounds


def _observed(pdf: pd.DataFrame, burn_in: int, kind: str) -> pd.DataFrame:
    rows = pdf[(pdf["idx"] >= burn_in) & pdf["y"].notna() & pdf["actual"].notna()].sort_values("idx")
    return rows[rows["is_train"]] if "is_train" in rows.columns else rows


def _outcome(rows: pd.DataFrame, kind: str) -> np.ndarray:
    return np.maximum(np.rint(rows["actual"].to_numpy(float)), 0.0) if kind in COUNTS else rows["y"].to_numpy(float)


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def fit_channels(design: DataFrame, keys: list[str], free: list[str], channels: list[str], shapes: list[Shape], terms: DataFrame | None = None,
                 burn_in: int = 0, likelihood: str = "normal") -> DataFrame:
    """Each panel's shapes and coefficients: (keys, choice, coef, sigma, dispersion, loglik, gradient, n_obs, rounds).

    ``design`` is from :func:`weekly_design`; weeks where a column ``is_train`` is false are not fitted on. ``terms`` is
    from :func:`prior_terms` and names the likelihood per panel; without it all have ``likelihood`` and no priors.
    ``choice`` is each channel's place in ``shapes``; ``gradient`` is that of the log posterior by each coefficient, 0
    for all but channels held at 0, where it is 0 or below. Panels without an observed week give no row.
    """
    out = f"{_types(design, keys)}, {FIT}"
    names = [k for k in keys]
    wanted = [*keys, "idx", "y", "actual", *free, "effects"] + (["is_train"] if "is_train" in design.columns else [])

    def run(key, pdf, spec=None):
        row = next(spec.itertuples(index=False), None) if spec is not None else None
        kind = row.likelihood if row is not None else likelihood
        rows = _observed(pdf, burn_in, kind) if len(pdf) else pdf
        if not len(rows) or (spec is not None and row is None):
            return pd.DataFrame(columns=[*names, *(f.split()[0] for f in FIT.split(", "))])
        prior = Prior.of(row, len(free), len(channels), len(shapes))
        x0 = rows[free].to_numpy(float)
        effects = np.stack(rows["effects"].to_numpy()).reshape(len(rows), len(channels), len(shapes))
        like = Likelihood(kind, _outcome(rows, kind), prior)
        choice, b, rounds = search(x0, effects, like, prior)
        x = np.hstack([x0, np.stack([effects[:, c, k] for c, k in enumerate(choice)], axis=1)]) if channels else x0
        eta = x @ b
        gradient = x.T @ like.score(eta) - prior.precision * (b - prior.mean)
        return pd.DataFrame([(*key, choice, b.tolist(), None if like.count else like.scale, like.scale if like.count else None,
                              like.loglik(eta), gradient.tolist(), len(rows), rounds)], columns=[*names, *(f.split()[0] for f in FIT.split(", "))])

    rows = design.select(*wanted).groupBy(*keys)
    if terms is None:
        return rows.applyInPandas(lambda key, pdf: run(key, pdf), out)
    return rows.cogroup(terms.groupBy(*keys)).applyInPandas(lambda key, pdf, spec: run(key, pdf, spec), out)


def fit_draws(chosen: DataFrame, fitted: DataFrame, keys: list[str], free: list[str], channels: list[str], replicates: int, terms: DataFrame | None = None,
              burn_in: int = 0, likelihood: str = "normal", block: int = 4, seed: int = 1) -> DataFrame:
    """Block-bootstrap draws of the coefficients at the chosen shapes: (keys, draw, coef).

    ``chosen`` is from :func:`with_choice`. Blocks of weeks get Poisson(1) weights from a generator seeded by the panel's
    key and ``seed``, so a task that runs again, or another layout, gives the same draws. A draw climbs from the fit; its
    scale stays the fit's.
    """
    columns = [*free, *[f"x_{c}" for c in channels]]
    n_free = len(free)
    specs = fitted.select(*keys, "coef", "sigma", "dispersion")
    stated = terms is not None
    if stated:
        specs = specs.join(terms, keys)

    def run(key, pdf, spec):
        row = next(spec.itertuples(index=False), None)
        kind = row.likelihood if stated and row is not None else likelihood
        rows = _observed(pdf, burn_in, kind) if len(pdf) else pdf
        if row is None or not len(rows):
            return pd.DataFrame(columns=[*keys, "draw", "coef"])
        prior = Prior.of(row if stated else None, n_free, len(channels), len(row.penalty) // max(len(channels), 1) if stated else 1)
        like = Likelihood(kind, _outcome(rows, kind), prior)
        like.scale = float(row.dispersion if like.count else row.sigma)
        x, b = rows[columns].to_numpy(float), np.asarray(row.coef, float)
        blocks, repeats = block_repeats(rows["idx"], key, replicates, block, seed)
        if kind == "normal":
            coefs = [nonnegative(*prior.system(a, r), n_free) for a, r in weighted_systems(x / like.scale, like.y / like.scale, blocks, repeats)]
        else:
            coefs = [climb(x, like, prior, b, n_free, weights=m[blocks], rounds=25, rescale=False)[0] for m in repeats]
        return pd.DataFrame({**{k: [v] * replicates for k, v in zip(keys, key)}, "draw": range(replicates), "coef": [c.tolist() for c in coefs]})

    wanted = [*keys, "idx", "y", "actual", *columns] + (["is_train"] if "is_train" in chosen.columns else [])
    return chosen.select(*wanted).groupBy(*keys).cogroup(specs.groupBy(*keys)).applyInPandas(run, f"{_types(chosen, keys)}, draw int, coef array<double>")


def expected_weeks(chosen: DataFrame, coefs: DataFrame, keys: list[str], free: list[str], channels: list[str], on: list[str] = ()) -> DataFrame:
    """(keys, on, week, idx, y, actual, y_max, mu, media): the linear predictor of each week, and its part from channels."""
    mu, media = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate([*free, *[f"x_{c}" for c in channels]]):
        term = F.get("coef", F.lit(i)) * F.col(c)
        mu = mu + term
        media = media + term if i >= len(free) else media
    return chosen.join(coefs.select(*keys, *on, "coef"), keys).select(*keys, *on, WEEK, "idx", "y", "actual", "y_max", mu.alias("mu"), media.alias("media"))


def in_outcome(mu: Column, likelihood: Column, y_max: Column) -> Column:
    """The outcome that a linear predictor stands for."""
    return F.when(likelihood.isin(*COUNTS), F.exp(mu)).otherwise(mu * y_max)


def prior_outcomes(design: DataFrame, terms: DataFrame, keys: list[str], free: list[str], channels: list[str], draws: int = 100,
                   burn_in: int = 0, seed: int = 1) -> DataFrame:
    """Outcomes that the priors alone imply: (keys, draw, week, value) in KPI units.

    Coefficients, shapes, noise and dispersion come from their priors, by a generator seeded with the panel's key.
    """
    def run(key, pdf, spec):
        row = next(spec.itertuples(index=False), None)
        rows = pdf[pdf["idx"] >= burn_in].sort_values("idx") if len(pdf) else pdf
        if row is None or not len(rows):
            return pd.DataFrame(columns=[*keys, "draw", WEEK, "value"])
        n_shapes = len(row.penalty) // max(len(channels), 1)
        prior = Prior.of(row, len(free), len(channels), n_shapes)
        rng = np.random.default_rng([seed, zlib.crc32("|".join(map(str, key)).encode())])
        sd = np.where(prior.precision > 0, 1 / np.sqrt(np.where(prior.precision > 0, prior.precision, 1.0)), 0.0)
        b = prior.mean + sd * rng.standard_normal((draws, len(sd)))
        b[:, len(free):] = np.abs(b[:, len(free):])
        eta = b[:, :len(free)] @ rows[free].to_numpy(float).T
        effects = np.stack(rows["effects"].to_numpy()).reshape(len(rows), len(channels), n_shapes)
        for c in range(len(channels)):
            weight = np.exp(prior.penalty[c].min() - prior.penalty[c])
            picked = rng.choice(n_shapes, draws, p=weight / weight.sum())
            eta = eta + b[:, len(free) + c, None] * effects[:, c, picked].T
        if row.likelihood in COUNTS:
            mu = np.exp(np.clip(eta, -30, 30))
            rate = mu if row.likelihood == "poisson" else mu * (g := rng.gamma(2.0, 10.0, (draws, 1))) ** -1 * rng.gamma(g, 1.0, mu.shape)
            value = rng.poisson(np.minimum(rate, 1e15)).astype(float)
        else:
            sigma = np.abs(rng.standard_normal((draws, 1))) * (prior.noise_sd if np.isfinite(prior.noise_sd) else 0.0)
            noise = rng.standard_t(STUDENT_T_NU, eta.shape) if row.likelihood == "student_t" else rng.standard_normal(eta.shape)
            value = (eta + sigma * noise) * rows["y_max"].to_numpy(float)
        n = len(rows)
        return pd.DataFrame({**{k: [v] * (draws * n) for k, v in zip(keys, key)}, "draw": np.repeat(np.arange(draws), n),
                             WEEK: np.tile(rows[WEEK].to_numpy(), draws), "value": value.ravel()})

    wanted = [*keys, WEEK, "idx", "y_max", *free, "effects"]
    return (design.select(*wanted).groupBy(*keys).cogroup(terms.groupBy(*keys))
            .applyInPandas(run, f"{_types(design, keys)}, draw int, {WEEK} date, value double"))
