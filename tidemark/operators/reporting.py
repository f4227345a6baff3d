"""Report tables: money figures, channel sets, actions, charts over weeks and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK
from tidemark.operators.planning import read_curve

MONEY = fx.MONEY_UNIT


def money_kpis(channels: DataFrame, totals: DataFrame, keys: list[str], margin: float | None = None) -> DataFrame:
    """Spend counts money channels only; marketing counts every channel.

    ``channels``: (keys, series, unit, total_spend, contribution_p3/p50/p97); ``totals``:
    (keys, kpi_total, baseline_p50).
    """
    s = channels.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("unit") == MONEY, F.col("total_spend"))), F.lit(0.0)).alias("total_spend"),
        *[F.sum(f"contribution_{p}").alias(f"marketing_{p}") for p in ("p3", "p50", "p97")]).join(totals, keys)
    spend = F.col("total_spend")
    s = s.withColumn("blended_return", F.when(spend > 0, F.col("marketing_p50") / spend))
    roi = F.when(spend > 0, (F.col("marketing_p50") * F.lit(margin).cast("double") - spend) / spend * 100)
    return (s.withColumn("roi_pct", roi).withColumn(
        "baseline_share_pct", F.when(F.col("kpi_total") > 0, F.col("baseline_p50") / F.col("kpi_total") * 100)))


def channel_sets(channels: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Each channel's set (money, volume, idle) and whether its own number may be shown."""
    hidden = verdicts.where(F.col("verdict") == "not_identified").select(*keys, "series").distinct().withColumn("_h", F.lit(True))
    kind = (F.when(F.col("unit") == MONEY, "money").when(F.col("total_spend") > 0, "volume").otherwise("idle"))
    return (channels.join(hidden, [*keys, "series"], "left")
            .withColumn("channel_set", kind).withColumn("reportable", F.col("_h").isNull()).drop("_h"))


def unreportable_total(sets: DataFrame, keys: list[str]) -> DataFrame:
    return (sets.where(~F.col("reportable")).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_unreportable"), F.sum("contribution_p50").alias("unreportable_p50")))


def confidence(p3: Column, p50: Column, p97: Column) -> Column:
    half = (p97 - p3) / (2 * F.abs(p50))
    return (F.when(F.abs(p50) < 1e-9, "low").when(half < fx.CONFIDENCE_LIMITS[0], "high")
            .when(half < fx.CONFIDENCE_LIMITS[1], "mid").otherwise("low"))


def nearest_point(front: DataFrame, targets: DataFrame, keys: list[str], target: str, prefix: str) -> DataFrame:
    """Frontier point nearest to a target budget per key; the smaller budget wins a tie."""
    j = targets.join(front.select(*keys, F.col("total_budget").alias("_x"), "p3", "p50", "p97"), keys)
    best = F.min_by(F.struct("_x", "p3", "p50", "p97"), F.struct(F.abs(F.col("_x") - F.col(target)), F.col("_x")))
    return j.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b._x").alias(f"{prefix}budget"), *[F.col(f"_b.{p}").alias(f"{prefix}{p}") for p in ("p3", "p50", "p97")])


def frontier_step(front: DataFrame, current: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """What the frontier promises at ``factor`` times today's budget; nothing if it ends before.

    ``current``: (keys, budget).
    """
    base = nearest_point(front, current, keys, "budget", "base_")
    more = nearest_point(front, current.withColumn("_t", F.col("budget") * factor), keys, "_t", "more_")
    j = base.join(more, keys).where(F.col("more_budget") > F.col("base_budget") * 1.01)
    return (j.withColumn("extra_spend", F.col("more_budget") - F.col("base_budget"))
            .withColumn("extra_kpi", F.col("more_p50") - F.col("base_p50")))


def actions(channels: DataFrame, allocation: DataFrame, predicted: DataFrame, curves: DataFrame, front: DataFrame,
            keys: list[str], kpi_type: str = "revenue", margin: float | None = None, most: int | None = None) -> DataFrame:
    """Actions per panel in order: shift or hold, scale, cut; all of them, or the first ``most``.

    ``allocation``: (keys, series, spend, current); ``predicted``: (keys, budget, p3, p50, p97) of
    that allocation; ``channels``: (keys, series, unit, total_spend, return_p97).
    """
    break_even = 1 / margin if margin else (1.0 if kpi_type == "revenue" else None)
    now = read_curve(allocation, curves, [*keys, "series"], "current").withColumn("delta", F.col("spend") - F.col("current"))
    moves = now.groupBy(*keys).agg(
        F.sum("p50").alias("current_kpi"), F.max_by(F.struct("series", "delta"), F.struct("delta", "series")).alias("up"),
        F.min_by(F.struct("series", "delta"), F.struct("delta", "series")).alias("down"))
    m = moves.join(predicted, keys).withColumn("gain", F.col("p50") - F.col("current_kpi"))
    shift = ((F.col("gain") > F.greatest(F.lit(1.0), F.col("current_kpi") * fx.SHIFT_GAIN))
             & (F.col("up.delta") > 0) & (F.col("down.delta") < 0))
    first = m.select(
        *keys, F.lit(1).alias("priority"), F.when(shift, "shift").otherwise("hold").alias("kind"),
        F.when(shift, F.concat(F.col("down.series"), F.lit(">"), F.col("up.series"))).alias("subject"),
        F.when(shift, F.least(F.col("up.delta"), -F.col("down.delta"))).alias("amount"),
        F.col("gain").alias("kpi_gain"), confidence(F.col("p3"), F.col("p50"), F.col("p97")).alias("confidence"))
    s = frontier_step(front, predicted.select(*keys, "budget"), keys, 1.3)
    per = F.col("extra_kpi") / F.greatest(F.lit(1.0), F.col("extra_spend"))
    worth = (F.when(F.col("extra_spend") > 0, F.col("extra_kpi") * margin / F.col("extra_spend")) > 1) if margin else (
        per > break_even if break_even is not None else F.lit(False))
    second = s.select(*keys, F.lit(2).alias("priority"), F.lit("scale").alias("kind"),
                      F.when(worth, "pays").otherwise("flat").alias("subject"), F.col("extra_spend").alias("amount"),
                      F.col("extra_kpi").alias("kpi_gain"),
                      confidence(F.col("more_p3"), F.col("more_p50"), F.col("more_p97")).alias("confidence"))
    out = first.unionByName(second)
    if break_even is not None:
        growing = now.where(F.col("delta") > 0).select(*keys, "series")
        losers = (channels.where((F.col("unit") == MONEY) & (F.col("return_p97") <= break_even) & (F.col("total_spend") > 0))
                  .join(growing, [*keys, "series"], "left_anti"))
        third = losers.groupBy(*keys).agg(
            F.lit(3).alias("priority"), F.lit("cut").alias("kind"), F.array_join(F.array_sort(F.collect_set("series")), ",").alias("subject"),
            F.lit(None).cast("double").alias("amount"), F.lit(None).cast("double").alias("kpi_gain"), F.lit("high").alias("confidence"))
        out = out.unionByName(third)
    w = Window.partitionBy(*keys).orderBy("priority")
    return out if most is None else out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def mix_share(weekly: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Weekly share (percent) of positive channel contributions."""
    v = F.greatest(F.col(value), F.lit(0.0))
    total = F.sum(v).over(Window.partitionBy(*keys, WEEK))
    return weekly.withColumn("share_pct", v / F.when(total == 0, 1.0).otherwise(total) * 100)


def buildup(weekly: DataFrame, keys: list[str], components: list[str], value: str = "value") -> DataFrame:
    """One row per week, one floored column per component."""
    return weekly.groupBy(*keys, WEEK).agg(
        *[F.max(F.when(F.col("component") == c, F.greatest(F.col(value), F.lit(0.0)))).alias(c) for c in components])


def rolling_return(weekly: DataFrame, keys: list[str], contribution: str, spend: str) -> DataFrame:
    """Contribution over spend in a trailing window of min(4, weeks/8); NULL until it is full."""
    w = Window.partitionBy(*keys, "series")
    size = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.col("_n") / 8)))
    d = weekly.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(WEEK)))
    # the window length depends on the data, so the four possible lengths are all at hand
    cases = None
    for k in (1, 2, 3, 4):
        o = w.orderBy(WEEK).rowsBetween(1 - k, 0)
        c, s = F.sum(contribution).over(o), F.sum(spend).over(o)
        r = F.when((s > 1e-6) & (F.col("_i") >= k), c / s)
        cases = F.when(size == k, r) if cases is None else cases.when(size == k, r)
    return d.withColumn("rolling_return", cases).drop("_n", "_i")


def waterfall(channels: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline, channels by size, total; each bar with the level it starts from.

    ``channels``: (keys, series, p50); ``baseline``: (keys, p50).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("p50"), "series")
    b = baseline.select(*keys, F.col("p50").alias("_b"))
    c = (channels.join(b, keys).withColumn("position", F.row_number().over(w))
         .withColumn("_to", F.col("_b") + F.sum("p50").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    bars = c.select(*keys, "position", F.col("series").alias("bar"), F.least(F.col("_to"), F.col("_to") - F.col("p50")).alias("start"),
                    F.abs("p50").alias("height"))
    first = baseline.select(*keys, F.lit(0).alias("position"), F.lit("baseline").alias("bar"), F.lit(0.0).alias("start"), F.col("p50").alias("height"))
    last = c.groupBy(*keys).agg((F.max("position") + 1).alias("position"), F.max_by("_to", "position").alias("height")).select(
        *keys, "position", F.lit("total").alias("bar"), F.lit(0.0).alias("start"), "height")
    return first.unionByName(bars).unionByName(last)


def budget_vs_effect(channels: DataFrame, keys: list[str]) -> DataFrame:
    paid = channels.where(F.col("unit") == MONEY)
    w = Window.partitionBy(*keys)
    effect = F.greatest(F.col("contribution_p50"), F.lit(0.0))
    spend_total, effect_total = F.sum("total_spend").over(w), F.sum(effect).over(w)
    d = paid.withColumn("_s", spend_total).withColumn("_e", effect_total).where((F.col("_s") > 0) & (F.col("_e") > 0))
    return d.select(*keys, "series", (F.col("total_spend") / F.col("_s") * 100).alias("budget_pct"), (effect / F.col("_e") * 100).alias("effect_pct"))


def spend_vs_return(channels: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    up = F.greatest(F.col("contribution_p97") - F.col("contribution_p50"), F.lit(0.0)) * factor
    down = F.greatest(F.col("contribution_p50") - F.col("contribution_p3"), F.lit(0.0)) * factor
    return channels.select(*keys, "series", F.col("total_spend").alias("cost"),
                           (F.greatest(F.col("contribution_p50"), F.lit(0.0)) * factor).alias("value"),
                           down.alias("arm_down"), up.alias("arm_up"))


def headline(money: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Headline figures as rows, only where the verdict allows the media total."""
    allowed = levels.where(F.col("level").isin(*[k for k, v in fx.ALLOWED_OUTPUTS.items() if "total_media_contribution" in v]))
    m = money.join(allowed.select(*keys), keys, "left_semi")
    rows = F.array(*[F.struct(F.lit(name).alias("figure"), F.col(c).alias("value")) for name, c in (
        ("marketing_driven", "marketing_p50"), ("return_per_unit", "blended_return"), ("net_return_pct", "roi_pct"))])
    return m.select(*keys, F.inline(rows)).where(F.col("value").isNotNull())


def strongest(channels: DataFrame, verdicts: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Largest share among usable channels (all of them if none is marked usable)."""
    allowed = levels.where(F.col("level").isin(*[k for k, v in fx.ALLOWED_OUTPUTS.items() if "channel_contributions" in v]))
    usable = verdicts.where(F.col("verdict") != "not_identified").select(*keys, "series").distinct().withColumn("_u", F.lit(1))
    c = channels.join(allowed.select(*keys), keys, "left_semi").join(usable, [*keys, "series"], "left")
    c = c.withColumn("_any", F.max("_u").over(Window.partitionBy(*keys))).where(F.col("_any").isNull() | F.col("_u").isNotNull())
    best = F.max_by(F.struct("series", "share_p3", "share_p50", "share_p97"), F.struct("share_p50", "series"))
    b = c.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
    wide = F.col("share_p97") - F.col("share_p3") > F.greatest(F.lit(0.1), F.col("share_p50"))
    return b.select(*keys, "series", F.col("share_p50").alias("share"), F.when(wide, "wide").otherwise("narrow").alias("band"))


def year_ago(weekly: DataFrame, keys: list[str], day: str = WEEK, value: str = "value",
             shift: int = fx.YEAR_AGO_DAYS, tolerance: int = fx.YEAR_AGO_TOLERANCE) -> DataFrame:
    """Known value nearest to a year earlier, within ten days; the earlier day wins a tie.

    Days are cut into buckets as wide as the tolerance band, a row looks into two of them, and
    the as-of join becomes a hash join.
    """
    width = 2 * tolerance + 1
    lo = F.unix_date(day) - shift - tolerance
    left = weekly.withColumn("_bucket", F.explode(F.array(F.floor(lo / width), F.floor(lo / width) + 1)))
    right = weekly.where(F.col(value).isNotNull()).select(
        *keys, F.col(day).alias("year_ago_day"), F.col(value).alias("year_ago_value"), F.floor(F.unix_date(day) / width).alias("_bucket"))
    gap = F.abs(F.date_diff(day, "year_ago_day") - shift)
    hits = left.join(right, [*keys, "_bucket"]).where(gap <= tolerance)
    best = hits.groupBy(*keys, day).agg(
        F.min_by(F.struct("year_ago_day", "year_ago_value"), F.struct(gap, F.col("year_ago_day"))).alias("_b")).select(*keys, day, "_b.*")
    return weekly.join(best, [*keys, day], "left")
