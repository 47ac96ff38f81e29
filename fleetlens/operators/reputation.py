"""Worker reputation from a log of verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import PRIOR_ALPHA, PRIOR_BETA, TRUSTED_AT
from fleetlens.operators.ordered import Cooldown, is_hot, running, scan


@dataclass(frozen=True)
class ReputationConfig:
    alpha0: float = PRIOR_ALPHA
    beta0: float = PRIOR_BETA
    blacklist_below: float = 0.30
    cooldown_ms: int = 300_000
    trusted_at: float = TRUSTED_AT
    max_penalty: float = 4.0


def evidence(verdicts: DataFrame, cfg: ReputationConfig) -> DataFrame:
    """Adds gain and penalty of each verdict; a failed spot check counts double
    before the cap."""
    sev = F.col("severity") * F.when(F.col("spot"), F.lit(2.0)).otherwise(F.lit(1.0))
    pen = F.least(F.greatest(sev, F.lit(0.0)), F.lit(cfg.max_penalty))
    return (verdicts.withColumn("gain", F.when(F.col("accepted"), F.lit(1.0)).otherwise(F.lit(0.0)))
            .withColumn("penalty", F.when(F.col("accepted"), F.lit(0.0)).otherwise(pen)))


def reputation_scores(verdicts: DataFrame, cfg: ReputationConfig = ReputationConfig(),
                      hot: bool | None = None) -> DataFrame:
    """alpha, beta, score and counts after each verdict. Evidence only adds up,
    so this is a running sum per worker in (t_ms, verdict_id) order."""
    e = running(evidence(verdicts, cfg), ["worker_id"], ["t_ms", "verdict_id"], {
        "alpha_sum": ("sum", F.col("gain")), "beta_sum": ("sum", F.col("penalty")),
        "accepted_count": ("sum", F.col("accepted").cast("long")), "seen": ("count", F.lit(1)),
        "spot_failures": ("sum", (F.col("spot") & ~F.col("accepted")).cast("long"))}, hot=hot)
    e = (e.withColumn("alpha", F.lit(cfg.alpha0) + F.col("alpha_sum"))
         .withColumn("beta", F.lit(cfg.beta0) + F.col("beta_sum"))
         .withColumn("rejected_count", F.col("seen") - F.col("accepted_count")))
    return (e.withColumn("score", F.col("alpha") / (F.col("alpha") + F.col("beta")))
            .drop("alpha_sum", "beta_sum", "seen", "gain", "penalty"))


def reputation_history(verdicts: DataFrame, cfg: ReputationConfig = ReputationConfig(), hot: bool | None = None) -> DataFrame:
    """Scores plus bans and probation after each verdict.

    A rejection that leaves the score under the limit starts a ban unless one
    runs. A served ban becomes probation, which an accept at a trusted score
    ends. Probation is read when the worker's next verdict arrives."""
    keys, order = ["worker_id"], ["t_ms", "verdict_id"]
    hot = is_hot(verdicts, keys) if hot is None else hot
    s = reputation_scores(verdicts, cfg, hot)
    s = s.withColumn("strike", ~F.col("accepted") & (F.col("score") < cfg.blacklist_below))
    b = scan(s, keys, order, ["t_ms", "strike"], Cooldown("t_ms", "strike", cfg.cooldown_ms), hot)
    # Bans do not overlap, so the last one to have ended is the latest or the one before it.
    end = F.when(F.col("ban_started"), F.col("banned_until"))
    r = running(b, keys, order, {"__prev": ("last", end)}, inclusive=False, hot=hot)
    ban = F.when(F.col("ban_started"), F.struct(F.col("banned_until").alias("end"), F.col("__prev").alias("prev")))
    clears = F.when(F.col("accepted") & (F.col("score") >= cfg.trusted_at), F.col("t_ms"))
    r = running(r, keys, order, {"__ban": ("last", ban), "__clear": ("max", clears)}, inclusive=False, hot=hot)
    now = F.col("t_ms")
    served = F.when(F.col("__ban.end") <= now, F.col("__ban.end")).when(F.col("__ban.prev") <= now, F.col("__ban.prev"))
    cleared = F.coalesce(F.greatest("__clear", clears) >= served, F.lit(False))
    return (r.withColumn("on_probation", served.isNotNull() & ~cleared)
            .withColumn("banned_until", F.col("banned_until").cast("long"))
            .drop("__prev", "__ban", "__clear", "strike"))


def current_reputation(verdicts: DataFrame, cfg: ReputationConfig = ReputationConfig()) -> DataFrame:
    """Final standing per worker without bans: one aggregation, no ordering."""
    e = evidence(verdicts, cfg).groupBy("worker_id").agg(
        (F.lit(cfg.alpha0) + F.sum("gain")).alias("alpha"), (F.lit(cfg.beta0) + F.sum("penalty")).alias("beta"),
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    return e.withColumn("score", F.col("alpha") / (F.col("alpha") + F.col("beta")))
