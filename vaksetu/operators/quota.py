"""Reading a quota meter: which billing explains it, and what it means for the schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT


def minutes_of(clock: Column) -> Column:
    """'HH:MM' in minutes."""
    p = F.split(clock, ":")
    return F.get(p, 0).cast("int") * 60 + F.get(p, 1).cast("int")


def implied_runtimes(probes: DataFrame) -> DataFrame:
    """Adds the session minutes that either billing would imply (columns delta, gpus, sessions)."""
    bad = (F.col("delta") < 0) | (F.col("gpus") < 1) | (F.col("sessions") < 1)
    delta = F.when(bad, F.raise_error(F.lit("a probe needs a meter reading, a session and a GPU")).cast("double")).otherwise(F.col("delta").cast("double"))
    out = probes.withColumn("if_wall_clock", delta).withColumn("if_per_gpu", F.col("if_wall_clock") / F.col("gpus"))
    return out.withColumn("each_wall_clock", F.col("if_wall_clock") / F.col("sessions")).withColumn("each_per_gpu", F.col("if_per_gpu") / F.col("sessions"))


def verdicts(probes: DataFrame, hours_needed: float | None = None, tolerance: float | None = None) -> DataFrame:
    """Adds (wall, per_gpu, billing, quota_hours, weeks) to probes (delta, gpus, and session_minutes or sessions and minutes).

    A reading near the middle of both predictions, or far outside them, is ambiguous and budgeted as metered by GPU.
    """
    q = DEFAULT.quota
    need, tol = (q.gpu_hours_needed if hours_needed is None else hours_needed), (q.tolerance if tolerance is None else tolerance)
    given = F.col("session_minutes").isNotNull()
    listed = F.aggregate("session_minutes", F.lit(0.0), lambda a, x: a + x)
    bad = F.when(given, (F.size("session_minutes") == 0) | F.exists("session_minutes", lambda x: x <= 0)).otherwise(~F.coalesce((F.col("sessions") >= 1) & (F.col("minutes") > 0), F.lit(False)))
    wall = F.when(bad, F.raise_error(F.lit("a probe needs sessions that ran")).cast("double")).when(given, listed).otherwise(F.col("sessions") * F.col("minutes"))
    out = probes.withColumn("wall", wall).withColumn("per_gpu", F.col("wall") * F.col("gpus"))
    delta, middle = F.col("delta"), (F.col("wall") + F.col("per_gpu")) / 2
    unclear = (F.abs(delta - middle) <= middle * tol * 0.5) | (delta < F.col("wall") * (1 - tol)) | (delta > F.col("per_gpu") * (1 + tol))
    out = out.withColumn("billing", F.when(unclear, "ambiguous").when(delta < middle, "wall_clock").otherwise("per_gpu"))
    out = out.withColumn("quota_hours", F.when(F.col("billing") == "wall_clock", F.lit(need) / F.col("gpus")).otherwise(F.lit(need)))
    return out.withColumn("weeks", F.col("quota_hours") / q.hours_per_week)
