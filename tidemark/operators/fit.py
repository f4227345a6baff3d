"""Fitting response models for many panels: grid of shapes, product sums, small constrained solves.

Model form per panel: KPI/max = level + trend + season + controls + sum of beta * saturation
(carry-over(spend/max)), beta >= 0. Spark applies the shapes, multiplies columns and sums; a task
receives one p-by-p system per (panel, candidate) and nothing that grows with the weeks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, over, stored
from tidemark.functions.response import hill_effect
from tidemark.operators.features import fourier
from tidemark.operators.measure import unpack_gram
from tidemark.operators.response import lags


def scalers(master: DataFrame, keys: list[str]) -> DataFrame:
    """How each series was scaled, kept so that later weeks can be scaled the same way."""
    v = F.col("value")
    s = master.groupBy(*keys, "series", "role").agg(
        F.max(v).alias("_max"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"))
    control = F.col("role") == "control"
    return s.select(*keys, "series", F.when(control, F.col("_mean")).otherwise(0.0).alias("shift"),
                    F.when(control, F.col("_sd")).otherwise(F.col("_max")).alias("size"))


def scale(master: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    scaled = (F.col("value") - F.col("shift")) / F.nullif(F.col("size"), F.lit(0.0))
    return master.join(sizes, [*keys, "series"]).withColumn("scaled", scaled).drop("shift", "size")


@dataclass(frozen=True)
class Candidate:
    """One shape for all channels of a panel; channels differ by their beta."""

    half_life: float
    half_sat: float
    slope: float = 1.0
    theta: float | None = None


def candidate_grid(half_lives=(0.5, 1.0, 2.5, 5.0), half_sats=(0.15, 0.3, 0.6), slopes=(1.0,),
                   thetas=(None,)) -> list[Candidate]:
    """Shapes around the prior centres."""
    return [Candidate(h, k, s, t) for h in half_lives for k in half_sats for s in slopes for t in thetas]


def with_candidates(df: DataFrame, candidates: list[Candidate]) -> DataFrame:
    """Repeat each row per candidate; the list is a literal, so nothing is joined."""
    rows = [F.struct(F.lit(i).alias("cand"), F.lit(c.half_life).alias("half_life"),
                     F.lit(c.half_sat).alias("half_sat"), F.lit(c.slope).alias("slope"),
                     F.lit(c.theta).cast("double").alias("theta")) for i, c in enumerate(candidates)]
    return df.select(*df.columns, F.inline(F.array(*rows)))


def kernel(c: Candidate, l_max: int = fx.L_MAX) -> list[float]:
    """Normalised weight of each lag of a candidate; without a half-life only the week itself counts."""
    alpha = 0.5 ** (1 / c.half_life) if c.half_life > 0 else 0.0
    raw = [alpha ** (i if c.theta is None else (i - c.theta) ** 2) for i in range(l_max)]
    return [w / (sum(raw) or 1.0) for w in raw]


def shaped(spend: DataFrame, keys: list[str], candidates: list[Candidate], l_max: int = fx.L_MAX) -> DataFrame:
    """(keys, week, series, cand, effect, direct): scaled spend through each candidate's shape.

    ``direct`` is the share of the stock that is the week's own spend. Lags are taken once, before the rows are
    repeated per candidate; the weights are literals, so nothing is computed per row but one sum of products.
    """
    x = spend.withColumn("_lags", F.array(*lags(keys, l_max, "scaled")))
    rows = [F.struct(F.lit(i).alias("cand"), F.array(*[F.lit(float(w)) for w in kernel(c, l_max)]).alias("_w"),
                     F.lit(float(c.half_sat)).alias("half_sat"), F.lit(float(c.slope)).alias("slope"))
            for i, c in enumerate(candidates)]
    wide = x.select(*keys, WEEK, "series", "_lags", F.inline(F.array(*rows)))
    stock = F.aggregate(F.zip_with("_lags", "_w", lambda v, w: v * w), F.lit(0.0), lambda total, v: total + v)
    wide = wide.withColumn("_stock", stock)
    own = F.when(F.col("_stock") > 0, F.col("_lags")[0] * F.col("_w")[0] / F.col("_stock")).otherwise(0.0)
    return wide.select(*keys, WEEK, "series", "cand", hill_effect(F.col("_stock"), F.col("half_sat"), F.col("slope")).alias("effect"),
                       own.alias("direct"))


def design_table(master: DataFrame, keys: list[str], kpi: str, channels: list[str], controls: list[str],
                 candidates: list[Candidate], modes: int = 1, sizes: DataFrame | None = None) -> tuple[DataFrame, list[str], int]:
    """One row per (panel, candidate, week): y, base terms, one column per channel effect (x_) and its direct share (d_).

    ``sizes`` scales by other weeks than the master's own. Returns the table, the design columns, and how many
    leading ones are unconstrained.
    """
    sized = scale(master, scalers(master, keys) if sizes is None else sizes, keys)
    w = Window.partitionBy(*keys)
    base = sized.groupBy(*keys, WEEK).agg(
        F.max(F.when(F.col("series") == kpi, F.col("scaled"))).alias("y"),
        F.max(F.when(F.col("series") == kpi, F.col("value"))).alias("actual"),
        *[F.coalesce(F.max(F.when(F.col("series") == c, F.col("scaled"))), F.lit(0.0)).alias(f"z_{c}") for c in controls])
    t = (F.row_number().over(w.orderBy(WEEK)) - 1).cast("double")
    base = base.withColumn("idx", t).withColumn("n_weeks", F.count(F.lit(1)).over(w))
    waves = fourier(F.col("idx"), 52.0, modes)
    base = base.withColumns({"one": F.lit(1.0), "t": over(F.col("idx"), F.col("n_weeks") - 1), **waves})
    spend = sized.where((F.col("role") == "spend") & F.col("series").isin(*channels))
    effects = shaped(spend, keys, candidates).groupBy(*keys, WEEK, "cand").agg(
        *[F.max(F.when(F.col("series") == c, F.col(v))).alias(f"{n}_{c}") for n, v in (("x", "effect"), ("d", "direct")) for c in channels])
    free = ["one", "t", *waves, *[f"z_{c}" for c in controls]]
    return base.join(effects, [*keys, WEEK]), free + [f"x_{c}" for c in channels], len(free)


def products(columns: list[str]) -> Column:
    """Products of every pair of the columns and ``y``, row by row of the upper triangle, then 1, in one array.

    Lambdas over one array stay the same short code for any number of columns.
    """
    x = F.array(*[F.col(c).cast("double") for c in columns], F.col("y").cast("double"))
    size = F.lit(len(columns) + 1)
    upper = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 1, size), lambda b: a * b)))
    return F.concat(upper, F.array(F.lit(1.0)))


def unfold(sums: DataFrame, group: list[str], p: int) -> DataFrame:
    """(group, xx, xy, yy, n) from summed products in long form (group, pos, s)."""
    at = {ij: k for k, ij in enumerate(combinations_with_replacement(range(p + 1), 2))}
    pick = lambda cells: F.transform(F.array(*[F.lit(at[ij]) for ij in cells]), lambda k: F.col("_s")[k])
    folded = sums.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("_s"))
    return folded.select(*group, pick(combinations_with_replacement(range(p), 2)).alias("xx"), pick([(i, p) for i in range(p)]).alias("xy"),
                         F.col("_s")[at[p, p]].alias("yy"), F.col("_s")[len(at)].alias("n"))


def gram(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, xx, xy, yy, n): sums over the rows, one row per product so that partial sums shrink them in the scan's tasks."""
    long = df.select(*group, F.posexplode(products(columns)).alias("pos", "v"))
    return unfold(long.groupBy(*group, "pos").agg(F.sum("v").alias("s")), group, len(columns))


def nonnegative(a: np.ndarray, r: np.ndarray, n_free: int) -> np.ndarray:
    """The b that makes b'ab/2 - r'b least with the coefficients after ``n_free`` at 0 or above.

    Block exchange of the bounded set, one coefficient at a time once it stops shrinking; ``a`` is positive definite.
    """
    p, fixed = len(r), np.zeros(len(r), bool)
    best, tries = p + 1, 3
    tol = 1e-10 * (1 + np.abs(r).max(initial=0.0))
    for _ in range(100 + 20 * p):
        b = np.zeros(p)
        on = ~fixed
        b[on] = np.linalg.solve(a[np.ix_(on, on)], r[on])
        g = a @ b - r
        wrong = (on & (b < 0)) | (fixed & (g < -tol))
        wrong[:n_free] = False
        n = int(wrong.sum())
        if not n:
            return b
        if n < best:
            best, tries = n, 3
        elif tries:
            tries -= 1
        else:
            wrong[:np.flatnonzero(wrong)[-1]] = False
        fixed ^= wrong
    b[n_free:] = np.maximum(b[n_free:], 0.0)      # only rounding can bring the exchange here
    return b


def nonneg_solve(xx: np.ndarray, xy: np.ndarray, n_free: int, ridge: float) -> np.ndarray:
    """Ridge least squares with the trailing coefficients kept >= 0."""
    return nonnegative(xx + ridge * np.eye(len(xy)) * max(np.trace(xx) / len(xy), 1e-12), xy, n_free)


def block_repeats(idx: pd.Series, key: tuple, replicates: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(each week's block, how often each draw repeats each block): Poisson(1) counts of a generator seeded by the panel's
    key, so a task that runs again, or another layout, draws the same."""
    _, blocks = np.unique((idx.to_numpy() // block).astype(int), return_inverse=True)
    rng = np.random.default_rng([seed, zlib.crc32("|".join(map(str, key)).encode())])
    return blocks, rng.poisson(1.0, (replicates, blocks.max() + 1)).astype(float)


def weighted_systems(x: np.ndarray, y: np.ndarray, blocks: np.ndarray, repeats: np.ndarray):
    """(X'X, X'y) of every draw: sums of products are taken by block and weighted for all draws at once."""
    n, p = repeats.shape[1], x.shape[1]
    xx, xy = np.zeros((n, p, p)), np.zeros((n, p))
    np.add.at(xx, blocks, x[:, :, None] * x[:, None, :])
    np.add.at(xy, blocks, x * y[:, None])
    return zip((repeats @ xx.reshape(n, -1)).reshape(-1, p, p), repeats @ xy)


def _solve_rows(grams: DataFrame, ids: list[str], design: list[str], n_free: int, ridge: float,
                holdout: bool) -> DataFrame:
    """Solve one system per row, streaming; score it on held-out sums when they are there."""
    p = len(design)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema if f.name in ids)

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                if rec.xx is None:
                    continue
                xx, xy = unpack_gram(rec.xx, p), np.array([0.0 if v is None else v for v in rec.xy])
                if getattr(rec, "pull_xx", None) is not None:
                    xx = xx + np.diag(np.asarray(rec.pull_xx, float))
                    xy = xy + np.asarray(rec.pull_xy, float)
                b = nonneg_solve(xx, xy, n_free, ridge)
                err = None
                if holdout and rec.xx_h is not None:
                    hx, hy = unpack_gram(rec.xx_h, p), np.array([0.0 if v is None else v for v in rec.xy_h])
                    err = float((rec.yy_h - 2 * b @ hy + b @ hx @ b) / max(rec.n_h, 1.0))
                rows.append(tuple(getattr(rec, k) for k in ids) + (b.tolist(), err))
            yield pd.DataFrame(rows, columns=[*ids, "coef", "holdout_mse"])

    return grams.mapInPandas(run, f"{types}, coef array<double>, holdout_mse double")


def grid_fit(design: DataFrame, keys: list[str], columns: list[str], n_free: int, burn_in: int = 0,
             holdout_weeks: int = 13, ridge: float = 1e-6) -> DataFrame:
    """Best candidate per panel by error on the last weeks: (keys, cand, coef, holdout_mse)."""
    rows = (design.where(F.col("y").isNotNull() & (F.col("idx") >= burn_in))
            .withColumn("late", F.col("idx") >= F.col("n_weeks") - holdout_weeks))
    parts = gram(rows, [*keys, "cand", "late"], columns)
    grams = parts.groupBy(*keys, "cand").agg(
        *[F.max(F.when(F.col("late") == late, F.col(c))).alias(c + suffix)
          for late, suffix in ((False, ""), (True, "_h")) for c in ("xx", "xy", "yy", "n")])
    solved = _solve_rows(grams, [*keys, "cand"], columns, n_free, ridge, holdout=True)
    best = F.min_by(F.struct("cand", "coef", "holdout_mse"), F.struct("holdout_mse", "cand"))
    return solved.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def refit(design: DataFrame, best: DataFrame, keys: list[str], columns: list[str], n_free: int,
          burn_in: int = 0, ridge: float = 1e-6, pulls: DataFrame | None = None) -> DataFrame:
    """Fit the chosen candidate on all weeks. ``pulls``: (keys, pull_xx, pull_xy) from experiments."""
    chosen = design.join(best.select(*keys, "cand"), [*keys, "cand"], "left_semi")
    grams = gram(chosen.where(F.col("y").isNotNull() & (F.col("idx") >= burn_in)), [*keys, "cand"], columns)
    if pulls is not None:
        grams = grams.join(pulls, keys, "left")
    return _solve_rows(grams, [*keys, "cand"], columns, n_free, ridge, holdout=False).drop("holdout_mse")


def bootstrap_draws(design: DataFrame, best: DataFrame, keys: list[str], columns: list[str], n_free: int,
                    replicates: int, block: int = 4, burn_in: int = 0, seed: int = 1) -> DataFrame:
    """Draws of the coefficients from block-bootstrap weights: (keys, cand, draw, coef).

    A panel's weeks, bounded by the calendar, meet in one task; panels are dealt over the cluster and nothing is
    repeated per draw but p-by-p systems inside it.
    """
    chosen = (design.join(best.select(*keys, "cand"), [*keys, "cand"], "left_semi")
              .where(F.col("y").isNotNull() & (F.col("idx") >= burn_in)))
    group = [*keys, "cand"]

    def run(key, pdf):
        pdf = pdf.sort_values("idx")
        blocks, repeats = block_repeats(pdf["idx"], key[:-1], replicates, block, seed)
        systems = weighted_systems(pdf[columns].to_numpy(float), pdf["y"].to_numpy(float), blocks, repeats)
        coefs = [nonneg_solve(a, r, n_free, 1e-6).tolist() for a, r in systems]
        return pd.DataFrame({**{k: [v] * replicates for k, v in zip(group, key)}, "draw": range(replicates), "coef": coefs})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in group)
    return chosen.select(*group, "idx", "y", *columns).groupBy(*group).applyInPandas(run, f"{types}, draw int, coef array<double>")


def calibration_pulls(design: DataFrame, best: DataFrame, spend_totals: DataFrame, experiments: DataFrame,
                      keys: list[str], columns: list[str], burn_in: int = 0) -> DataFrame:
    """Terms that pull implied returns toward experiments: (keys, pull_xx, pull_xy).

    ``spend_totals``: (keys, series, total_spend, y_max); ``experiments``: (keys, series, roas, sd).
    The return is linear in beta: k = y_max * sum(effect) / total spend, so an experiment adds
    k^2/sd^2 to the diagonal and k*roas/sd^2 to the right-hand side.
    """
    chosen = (design.join(best.select(*keys, "cand"), [*keys, "cand"], "left_semi")
              .where(F.col("idx") >= burn_in))
    effects = [c for c in columns if c.startswith("x_")]
    sums = chosen.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in effects])
    long = sums.unpivot(keys, effects, "series", "effect").withColumn("series", F.substring("series", 3, 500))
    k = over(F.col("y_max") * F.col("effect"), F.col("total_spend"))
    pulls = (long.join(spend_totals, [*keys, "series"]).join(experiments, [*keys, "series"])
             .withColumn("xx", k * k / (F.col("sd") * F.col("sd"))).withColumn("xy", k * F.col("roas") / (F.col("sd") * F.col("sd"))))

    def column_value(name: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.concat(F.lit("x_"), "series") == name, F.col(value))), F.lit(0.0))

    return pulls.groupBy(*keys).agg(
        F.array(*[column_value(c, "xx") for c in columns]).alias("pull_xx"),
        F.array(*[column_value(c, "xy") for c in columns]).alias("pull_xy"))


def predict(design: DataFrame, fitted: DataFrame, keys: list[str], columns: list[str], on: list[str] = (),
            count_link: bool = False) -> DataFrame:
    """Expected KPI per week (and draw) in scaled units, with its media part."""
    j = design.join(fitted, [*keys, "cand"])
    mu, media = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(columns):
        term = F.col("coef")[i] * F.col(c)
        mu = mu + term
        if c.startswith("x_"):
            media = media + term
    return j.select(*keys, *on, WEEK, "idx", "y", "actual", F.exp(mu).alias("mu") if count_link else mu.alias("mu"),
                    media.alias("media"))


def on_unseen_weeks(master: DataFrame, folds: DataFrame, keys: list[str], kpi: str, channels: list[str], controls: list[str],
                    candidates: list[Candidate], burn_in: int = 0, holdout_weeks: int = 13) -> DataFrame:
    """(keys, fold, week, actual, fitted) of each fold's test weeks.

    Scaling, choice of shape and fit see the fold's training weeks alone. ``folds``: (keys, fold, train_end, test_end).
    """
    at = [*keys, "fold"]
    weeks = master.select(*keys, WEEK).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(WEEK)) - 1)
    dealt = (master.join(weeks, [*keys, WEEK]).join(folds.select(*at, "train_end", "test_end"), keys)
             .where(F.col("_i") < F.col("test_end")))
    sizes = scalers(dealt.where(F.col("_i") < F.col("train_end")), at)
    design, columns, n_free = design_table(dealt.select(*at, WEEK, "series", "role", "value"), at, kpi, channels, controls, candidates,
                                           sizes=sizes)
    rows = stored(design.join(folds.select(*at, "train_end"), at), "folds")
    train = rows.where(F.col("idx") < F.col("train_end")).withColumn("n_weeks", F.col("train_end"))
    best = stored(grid_fit(train, at, columns, n_free, burn_in, holdout_weeks), "fold-best")
    fitted = refit(train, best, at, columns, n_free, burn_in)
    tests = predict(rows.where((F.col("idx") >= F.col("train_end")) & F.col("y").isNotNull()), fitted, at, columns)
    size = sizes.where(F.col("series") == kpi).select(*at, "size")
    return tests.join(size, at).select(*at, WEEK, "actual", (F.col("mu") * F.col("size")).alias("fitted"))


def placebo_shares(master: DataFrame, keys: list[str], kpi: str, channels: list[str], controls: list[str],
                   candidates: list[Candidate], burn_in: int = 0, name: str = "placebo") -> DataFrame:
    """(keys, series, share of the outcome) after a refit; ``master`` holds the random channel ``name`` as well."""
    names = [*channels, name]
    d, columns, n_free = design_table(master, keys, kpi, names, controls, candidates)
    d = stored(d, "placebo")
    best = stored(grid_fit(d, keys, columns, n_free, burn_in), "placebo-best")
    sums = d.join(best.select(*keys, "cand"), [*keys, "cand"], "left_semi").groupBy(*keys).agg(
        F.sum("y").alias("_y"), *[F.sum(f"x_{c}").alias(f"x_{c}") for c in names])
    share = F.array(*[F.struct(F.lit(c).alias("series"), over(F.col("coef")[columns.index(f"x_{c}")] * F.col(f"x_{c}"), F.col("_y")).alias("share"))
                      for c in names])
    return sums.join(best.select(*keys, "coef"), keys).select(*keys, F.inline(share))
