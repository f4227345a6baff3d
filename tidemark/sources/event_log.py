"""The event log: validating and clipping batches of client events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.functions.text import truncated


def clean_events(log: DataFrame, clip: bool = False) -> DataFrame:
    """Row-wise part: levels checked, empty fields filled, the time of the action kept; ``clip`` cuts long texts. Also streams."""
    ok = F.col("level").isin(*fx.LOG_LEVELS) & F.col("event").isNotNull()
    detail = F.coalesce("detail", F.lit("{}"))
    clipped = F.to_json(F.struct(F.lit(True).alias("afgekapt"), F.length(detail).alias("tekens"),
                                 F.substring(detail, 1, fx.LOG_DETAIL).alias("fragment")))
    if not clip:
        return log.where(ok).withColumns({"session_id": F.coalesce("session_id", F.lit("onbekend")), "detail": detail})
    return log.where(ok).withColumns({
        "session_id": F.substring(F.coalesce("session_id", F.lit("onbekend")), 1, fx.LOG_SESSION),
        "event": F.substring("event", 1, fx.LOG_EVENT),
        "message": truncated(F.col("message"), fx.LOG_MESSAGE),
        "detail": F.when(F.length(detail) > fx.LOG_DETAIL, clipped).otherwise(detail)})


def take_batches(log: DataFrame, batch: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` events of each batch; the limit applies inside each task first."""
    w = Window.partitionBy(*batch).orderBy(*order)
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def left_out(log: DataFrame, batch: list[str], most: int) -> DataFrame:
    """(batch, n): how many events of each batch :func:`take_batches` leaves out."""
    return log.groupBy(*batch).agg((F.count(F.lit(1)) - most).alias("n")).where(F.col("n") > 0)


def accept_batches(log: DataFrame, batch: list[str], order: list[str], most: int | None = None, clip: bool = False) -> DataFrame:
    """All events of all batches, cleaned; ``most`` takes only so many of each batch, ``clip`` cuts long texts."""
    return clean_events(log if most is None else take_batches(log, batch, order, most), clip)
