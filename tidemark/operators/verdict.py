"""From diagnostics to a graded verdict and the outputs it allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fx

CHECKS = "array<struct<code string, passed boolean, severity string, value double>>"


def _check(code: str, passed: Column, severity: str, value: Column | None = None, when: Column | None = None) -> Column:
    cell = F.struct(F.lit(code).alias("code"), passed.alias("passed"), F.lit(severity).alias("severity"),
                    (value if value is not None else F.lit(None)).cast("double").alias("value"))
    return cell if when is None else F.when(when, cell)


SAMPLER = ("max_r_hat", "n_divergences", "min_ess_bulk")
FITTED = ("decomposition_ok", "r2", "coverage_94")


def _missing(d: DataFrame, names: tuple[str, ...]) -> Column:
    """How many of these were not measured. Rows whose ``sampled`` is false have independent draws, no chains: R-hat and
    divergences do not exist for them and are not missing."""
    chains = F.coalesce(F.col("sampled"), F.lit(True)) if "sampled" in d.columns else F.lit(True)
    out = F.lit(0)
    for n in names:
        gone = F.col(n).isNull()
        out = out + (gone & chains if n in SAMPLER[:2] else gone).cast("int")
    return out


def validity_checks(diagnostics: DataFrame, keys: list[str], channels: DataFrame | None = None,
                    shares: DataFrame | None = None) -> DataFrame:
    """One row per named check that applies: (keys, code, passed, severity, value).

    ``diagnostics``: one row per run with max_r_hat, n_divergences, n_samples, min_ess_bulk,
    min_ess_tail, min_e_bfmi, decomposition_ok, r2, coverage_94/80/50, mape, autocorrelation,
    holdout_mape, placebo_share; what was not measured is NULL and its check is left out. What a verdict needs at least
    and is missing is counted in ``all_measured``, a warning. ``sampled`` may say false for draws without chains.
    ``channels``: (keys, series, verdict); ``shares``: (keys, series, share).
    """
    d = diagnostics
    if channels is not None:
        n = channels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_channels"),
                                        F.count_if(F.col("verdict") == "not_identified").alias("n_unusable"))
        d = d.join(n, keys, "left")
    else:
        d = d.withColumns({"n_channels": F.lit(None).cast("bigint"), "n_unusable": F.lit(None).cast("bigint")})
    if shares is not None:
        typical = shares.groupBy(*keys).agg(F.abs(F.percentile("share", F.lit(0.5))).alias("typical_share"))
        d = d.join(typical, keys, "left")
    else:
        d = d.withColumn("typical_share", F.lit(None).cast("double"))
    d = d.withColumn("_missing", _missing(d, SAMPLER + FITTED))
    c = F.col
    div = c("n_divergences") / F.greatest(c("n_samples"), F.lit(1))
    off = [F.coalesce(F.abs(c(f"coverage_{b}") - b / 100) > fx.COVERAGE_TOLERANCE, F.lit(False)) for b in (94, 80, 50)]
    placebo = F.abs(c("placebo_share"))
    clean = (placebo <= fx.PLACEBO_LIMIT) & F.coalesce(placebo < c("typical_share"), F.lit(True))
    rows = [
        _check("converged", c("max_r_hat") <= fx.RHAT_BLOCKING, "blocking", c("max_r_hat"), c("max_r_hat").isNotNull()),
        _check("convergence_tight", F.lit(False), "warning", c("max_r_hat"),
               (c("max_r_hat") > fx.RHAT_WARN) & (c("max_r_hat") <= fx.RHAT_BLOCKING)),
        _check("few_divergences", div <= fx.DIVERGENCE_SHARE, "blocking", div, div.isNotNull()),
        _check("some_divergences", F.lit(False), "warning", c("n_divergences"),
               (c("n_divergences") > 0) & (div <= fx.DIVERGENCE_SHARE)),
        _check("enough_effective_samples", c("min_ess_bulk") >= fx.ESS_MIN, "warning", c("min_ess_bulk"), c("min_ess_bulk").isNotNull()),
        _check("enough_tail_samples", c("min_ess_tail") >= fx.ESS_MIN, "warning", c("min_ess_tail"), c("min_ess_tail").isNotNull()),
        _check("energy_ok", c("min_e_bfmi") >= fx.EBFMI_MIN, "warning", c("min_e_bfmi"), c("min_e_bfmi").isNotNull()),
        _check("all_measured", F.lit(False), "warning", c("_missing"), c("_missing") > 0),
        _check("decomposition_adds_up", c("decomposition_ok"), "blocking", None, c("decomposition_ok").isNotNull()),
        _check("explains_the_data", c("r2") >= fx.R2_BLOCKING, "blocking", c("r2"), c("r2").isNotNull()),
        _check("explains_the_data_weakly", F.lit(False), "warning", c("r2"), (c("r2") >= fx.R2_BLOCKING) & (c("r2") < fx.R2_WARN)),
        _check("uncertainty_is_calibrated", ~(off[0] | off[1] | off[2]), "warning", c("coverage_94"), c("coverage_94").isNotNull()),
        _check("prediction_error_ok", c("mape") <= fx.MAPE_LIMIT, "warning", c("mape"), c("mape").isNotNull()),
        _check("no_leftover_structure", F.abs("autocorrelation") <= fx.AUTOCORR_LIMIT, "warning", c("autocorrelation"),
               c("autocorrelation").isNotNull()),
        _check("generalises", c("holdout_mape") <= fx.HOLDOUT_LIMIT, "warning", c("holdout_mape"), c("holdout_mape").isNotNull()),
        _check("placebo_clean", clean, "blocking", c("placebo_share"), c("placebo_share").isNotNull()),
        _check("any_channel_identifiable", c("n_unusable") < c("n_channels"), "blocking", None, c("n_channels").isNotNull()),
        _check("all_channels_identifiable", F.lit(False), "warning", None,
               (c("n_unusable") > 0) & (c("n_unusable") < c("n_channels"))),
    ]
    # one union branch per check would rescan the diagnostics; an array of rows does not
    return d.select(*keys, F.explode(F.array(*rows)).alias("_c")).where("_c IS NOT NULL").select(*keys, "_c.*")


def verdict_level(checks: DataFrame, keys: list[str], channels: DataFrame | None = None) -> DataFrame:
    """The ladder: blocking, then the fit, then the evidence on unseen data and channels."""
    failed = ~F.col("passed")
    warn = failed & (F.col("severity") == "warning")

    def some(test: Column) -> Column:
        return F.max(F.coalesce(test, F.lit(False)))

    s = checks.groupBy(*keys).agg(
        some(failed & (F.col("severity") == "blocking")).alias("blocked"),
        some(warn & F.col("code").isin(*fx.FIT_WARNINGS)).alias("fit_problem"),
        some(warn & (F.col("code") != "all_channels_identifiable")).alias("model_warning"),
        some((F.col("code") == "generalises") & F.col("passed")).alias("generalises"))
    if channels is None:
        s = s.withColumn("has_usable", F.lit(False))
    else:
        usable = channels.groupBy(*keys).agg(F.max(F.col("verdict") != "not_identified").alias("has_usable"))
        s = s.join(usable, keys, "left").withColumn("has_usable", F.coalesce("has_usable", F.lit(False)))
    top = F.col("has_usable") & F.col("generalises") & ~F.col("model_warning")
    level = (F.when(F.col("blocked"), "not_usable").when(F.col("fit_problem"), "technically_completed")
             .when(top, "usable_for_decisions").otherwise("statistically_valid"))
    return s.select(*keys, level.alias("level"))


def allowed_outputs(levels: DataFrame, keys: list[str]) -> DataFrame:
    out = None
    for level, names in fx.ALLOWED_OUTPUTS.items():
        cell = F.array(*[F.lit(n) for n in names])
        out = F.when(F.col("level") == level, cell) if out is None else out.when(F.col("level") == level, cell)
    return levels.select(*keys, "level", F.explode(out).alias("output"))


GRADES = ("good", "unmeasured", "caution", "weak")


def trust_layers(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """Trust in the sampler and in the fit, graded apart, and the worse of the two.

    ``unmeasured`` is no ``good``: nothing speaks against the layer, but part of what would is NULL. What was measured
    and is bad still makes it ``caution`` or ``weak``.
    """
    c = F.col

    def some(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    sampler_note = some(c("max_r_hat") > fx.RHAT_WARN) | some(c("n_divergences") > 0) | some(c("min_ess_bulk") < fx.ESS_MIN)
    fit_note = (some(F.abs(c("coverage_94") - 0.94) > fx.COVERAGE_TOLERANCE) | some(c("r2") < fx.R2_WARN) | some(c("mape") > fx.TRUST_MAPE))
    weak = {"sampler": some(c("max_r_hat") > fx.RHAT_BLOCKING), "fit": some(~c("decomposition_ok")) | some(c("r2") < fx.R2_BLOCKING)}
    layers = {}
    for name, note, needed in (("sampler", sampler_note, SAMPLER), ("fit", fit_note, FITTED)):
        layers[name] = F.when(weak[name], 3).when(note, 2).when(_missing(diagnostics, needed) > 0, 1).otherwise(0)
    names = F.array(*[F.lit(g) for g in GRADES])
    d = diagnostics.withColumn("_s", layers["sampler"]).withColumn("_f", layers["fit"])
    return d.select(*keys, F.element_at(names, c("_s") + 1).alias("sampler"), F.element_at(names, c("_f") + 1).alias("fit"),
                    F.element_at(names, F.greatest("_s", "_f") + 1).alias("overall"))
