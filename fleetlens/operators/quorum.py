"""Replica quorum. Submissions carry ``seq``, their dense arrival number per
task. The verdict is taken anew at every arrival, over the answers of the round
so far, and the first accepting one settles the task; what arrives after it is
late and gets neither credit nor charge. An undecided round of ``cap`` answers
is cleared and the next starts empty, so rounds are consecutive blocks of
``cap`` arrivals and can be judged side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.exprs import MAX_REPLICAS, U32, ulp_distance
from fleetlens.operators.compare import statistical_pair

KNOWN_POOL = 256


def with_rounds(subs: DataFrame, cap: int = MAX_REPLICAS) -> DataFrame:
    return subs.withColumn("round", F.floor((F.col("seq") - 1) / F.lit(cap)))


def _clusters(subs: DataFrame, required, cap: int, value: str, agree) -> DataFrame:
    """Per (task, round): ``rows`` in arrival order, and ``clusters`` as they stood
    when the round was decided, or at its last row.

    An answer joins the first cluster in which it agrees with every member, later
    against earlier. ``required`` is a number, or the column with the agreement
    that the arriving worker's own record asks for. A round has at most ``cap``
    rows, so it is folded as one small array inside the JVM."""
    need = required if isinstance(required, Column) else F.lit(required)
    r = with_rounds(subs, cap).groupBy("task_id", "round").agg(F.array_sort(F.collect_list(
        F.struct("seq", "worker_id", F.col(value).alias("v"), need.cast("long").alias("need")))).alias("rows"))
    elem = r.schema["rows"].dataType.simpleString()

    def place(clusters, x):
        fits = F.transform(clusters, lambda c: F.forall(c, lambda m: agree(x["v"], m["v"])))
        at = F.array_position(fits, True)
        joined = F.transform(clusters, lambda c, i: F.when(i + 1 == at, F.concat(c, F.array(x))).otherwise(c))
        return F.when(at > 0, joined).otherwise(F.concat(clusters, F.array(F.array(x))))

    def arrive(state, x):
        placed = place(state["clusters"], x)
        enough = F.array_max(F.transform(placed, lambda c: F.size(c))) >= x["need"]
        return F.when(state["done"], state).otherwise(F.struct(placed.alias("clusters"), enough.alias("done")))

    start = F.struct(F.array().cast(f"array<{elem}>").alias("clusters"), F.lit(False).alias("done"))
    g = r.withColumn("state", F.aggregate("rows", start, arrive))
    g = g.select("task_id", "round", F.size("rows").alias("received"), F.col("state.clusters").alias("clusters"),
                 F.col("state.done").alias("done"))
    sizes = F.transform("clusters", lambda c: F.size(c))
    g = g.withColumn("best_size", F.array_max(sizes)).withColumn("n", F.aggregate(sizes, F.lit(0), lambda t, c: t + c))
    g = g.withColumn("best", F.element_at("clusters", F.array_position(sizes, F.col("best_size")).cast("int")))
    action = (F.when(F.col("done"), "Accept").when(F.col("n") < cap, "NeedMoreReplicas")
              .when(F.col("best_size") * 2 > F.col("n"), "Accept").otherwise("Inconclusive"))
    return g.withColumn("action", action)


def decide_exact(subs: DataFrame, required=2, cap: int = MAX_REPLICAS, policy: str = "fixed2x") -> DataFrame:
    """Verdict per (task, round) when equal checksums are the only agreement.

    ``n`` counts the answers up to the deciding one, ``received`` all of the round;
    ``required`` may be a column, see :func:`_clusters`. Policy "none" takes the
    first answer."""
    if policy == "none":
        subs, required = subs.where("seq = 1"), 1
    g = _clusters(subs, required, cap, "answer", lambda a, b: a.eqNullSafe(b))
    won = F.col("action") == "Accept"
    dissent = won & (F.col("n") > F.col("best_size"))
    return g.select(
        "task_id", "round", F.col("n").cast("long").alias("n"), F.col("received").cast("long").alias("received"),
        F.size("clusters").cast("long").alias("clusters"), "action",
        F.when(won, F.col("best")[0]["v"]).alias("answer"),
        F.when(won, F.col("best_size")).otherwise(F.lit(0)).cast("long").alias("agreeing"),
        F.when(won, F.col("n") - F.col("best_size")).otherwise(F.lit(0)).cast("long").alias("dissenting"),
        # a checksum has no distance: any exact dissent is the largest one
        F.when(dissent, F.lit(U32)).otherwise(F.lit(0)).cast("long").alias("dissent_max_ulp"),
        F.when(dissent, F.lit(1.0)).otherwise(F.lit(0.0)).alias("dissent_max_rel"))


def _agree(a: Column, b: Column, is_array: bool, abs_eps: float, rel_eps: float) -> Column:
    def close(x, y):
        x, y = x.cast("double"), y.cast("double")
        nx, ny = F.isnan(x), F.isnan(y)
        diff = F.abs(x - y)
        apart = F.isnan(diff) | (diff <= F.lit(abs_eps) + F.lit(rel_eps) * F.abs(y))
        return F.when(nx | ny, nx & ny).otherwise(apart)
    if not is_array:
        return close(a, b)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, close), lambda ok: F.coalesce(ok, F.lit(False)))


def _distance(a: Column, b: Column, is_array: bool) -> tuple[Column, Column]:
    """(largest ulp, largest relative difference) of a against b."""
    def rel(x, y):
        x, y = x.cast("double"), y.cast("double")
        return F.when(F.abs(y) > 0, F.abs(x - y) / F.abs(y)).otherwise(F.lit(0.0))

    def ulp(x, y):
        return ulp_distance(x.cast("float"), y.cast("float"))
    if not is_array:
        return ulp(a, b), rel(a, b)
    return F.array_max(F.zip_with(a, b, ulp)), F.array_max(F.zip_with(a, b, rel))


def decide_tolerant(subs: DataFrame, required, cap: int, abs_eps: float, rel_eps: float,
                    value: str = "value") -> DataFrame:
    """Verdict per (task, round) for float answers, scalars or vectors; see :func:`decide_exact`."""
    is_array = isinstance(subs.schema[value].dataType, T.ArrayType)
    g = _clusters(subs, required, cap, value, lambda a, b: _agree(a, b, is_array, abs_eps, rel_eps))
    losers = F.flatten(F.filter("clusters", lambda c: c != F.col("best")))
    won = F.col("action") == "Accept"
    winner = F.col("best")[0]["v"]
    ulps = F.transform(losers, lambda x: _distance(x["v"], winner, is_array)[0])
    rels = F.transform(losers, lambda x: _distance(x["v"], winner, is_array)[1])
    return g.select(
        "task_id", "round", F.col("n").cast("long").alias("n"), F.col("received").cast("long").alias("received"),
        F.size("clusters").cast("long").alias("clusters"), "action",
        F.when(won, F.col("best")[0]["seq"]).otherwise(F.lit(-1)).cast("long").alias("winner_seq"),
        F.when(won, F.col("best_size")).otherwise(F.lit(0)).cast("long").alias("agreeing"),
        F.when(won, F.col("n") - F.col("best_size")).otherwise(F.lit(0)).cast("long").alias("dissenting"),
        F.when(won, F.coalesce(F.array_max(ulps), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("dissent_max_ulp"),
        F.when(won, F.coalesce(F.array_max(rels), F.lit(0.0))).otherwise(F.lit(0.0)).alias("dissent_max_rel"),
        F.when(won, F.transform("best", lambda x: x["worker_id"])).alias("agreeing_workers"))


def decide_statistical(subs: DataFrame, required, cap: int = MAX_REPLICAS, value: str = "payload") -> DataFrame:
    """Verdict per (task, round) for Monte Carlo payloads, arrays of (r, g, b, samples); see :func:`decide_exact`.

    Two answers agree if the statistical comparison says Match; a comparison that is not possible is no agreement. How far
    dissent lies from the winner is the largest distance of the means in standard errors; it has no distance in floats."""
    g = _clusters(subs, required, cap, value, lambda a, b: statistical_pair(a, b)["match"])
    losers = F.flatten(F.filter("clusters", lambda c: c != F.col("best")))
    won = F.col("action") == "Accept"
    winner = F.col("best")[0]["v"]
    apart = F.array_max(F.transform(losers, lambda x: statistical_pair(x["v"], winner)["z_aggregate"]))
    return g.select(
        "task_id", "round", F.col("n").cast("long").alias("n"), F.col("received").cast("long").alias("received"),
        F.size("clusters").cast("long").alias("clusters"), "action",
        F.when(won, F.col("best")[0]["seq"]).otherwise(F.lit(-1)).cast("long").alias("winner_seq"),
        F.when(won, F.col("best_size")).otherwise(F.lit(0)).cast("long").alias("agreeing"),
        F.when(won, F.col("n") - F.col("best_size")).otherwise(F.lit(0)).cast("long").alias("dissenting"),
        F.lit(0).cast("long").alias("dissent_max_ulp"),
        F.when(won, F.coalesce(apart, F.lit(0.0))).otherwise(F.lit(0.0)).alias("dissent_max_rel"),
        F.when(won, F.transform("best", lambda x: x["worker_id"])).alias("agreeing_workers"))


def settle(decided: DataFrame) -> DataFrame:
    """One verdict per task: the first accepted round, else the latest round."""
    rest = [c for c in decided.columns if c not in ("task_id", "received")]
    row = F.struct(*rest)
    g = decided.groupBy("task_id").agg(
        F.min_by(row, F.when(F.col("action") == "Accept", F.col("round"))).alias("won"),
        F.max_by(row, "round").alias("last"), F.sum("received").alias("submissions"))
    v = F.coalesce("won", "last")
    return g.select("task_id", "submissions", *[v[c].alias(c) for c in rest])


def quorum_credits(subs: DataFrame, verdicts: DataFrame, cap: int = MAX_REPLICAS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Who an exact verdict credits and charges, in the form reputation_history
    reads: one row per submission up to the one that decided; later ones are late.
    ``keep`` names further columns of ``subs``."""
    # A verdict's submissions are a stretch of its task's, so tasks are all that is joined on.
    v = verdicts.where("action = 'Accept'").select(
        "task_id", (F.col("round") * cap).alias("from"), (F.col("round") * cap + F.col("n")).alias("to"), F.col("answer").alias("won"))
    j = subs.join(v, "task_id").where((F.col("seq") > F.col("from")) & (F.col("seq") <= F.col("to")))
    ok = F.col("answer").eqNullSafe(F.col("won"))
    # Exact dissent: largest ulp, relative difference 1, hence the top severity.
    return j.select("task_id", "worker_id", "seq", ok.alias("accepted"),
                    F.when(ok, F.lit(0.0)).otherwise(F.lit(4.0)).alias("severity"), *keep)


def known_pool(verdicts: DataFrame, cap: int = KNOWN_POOL) -> DataFrame:
    """Known-answer ranges: distinct by (start, count) at first arrival, empty
    ranges and single-worker verdicts left out, the newest ``cap`` kept. A range
    that was evicted and arrives again keeps its first place here; the live pool
    would append it anew. Top-k per task, then one merge."""
    ok = verdicts.where((F.col("unit_count") > 0) & (F.col("agreeing") >= 2))
    first = ok.groupBy("start_unit", "unit_count").agg(
        F.min("arrival").alias("arrival"), F.min_by("checksum", "arrival").alias("checksum"))
    return first.orderBy(F.col("arrival").desc()).limit(cap)


def number_pool(pool: DataFrame) -> DataFrame:
    """Slots from 0 in arrival order; the pool is bounded by known_pool."""
    from pyspark.sql.window import Window
    return pool.withColumn("slot", (F.row_number().over(Window.orderBy("arrival")) - 1).cast("long"))


def held_partials(partials: DataFrame, leases: DataFrame) -> DataFrame:
    """Partials sent by the holder of the task's lease; others may not move the
    sequence. ``leases`` (task_id, worker_id) may be static beside a stream."""
    return partials.join(leases.select("task_id", "worker_id"), ["task_id", "worker_id"], "left_semi")


def latest_partial(partials: DataFrame, finished: DataFrame) -> DataFrame:
    """The newest partial per unfinished task: greatest sequence, first arrival
    on a tie, payload replaced whole. Combines on the map side."""
    rest = [c for c in partials.columns if c not in ("task_id", "sequence", "arrival")]
    live = partials.join(finished.select("task_id").dropDuplicates(), "task_id", "left_anti")
    best = live.groupBy("task_id").agg(
        F.max_by(F.struct("sequence", "arrival", *rest), F.struct("sequence", -F.col("arrival"))).alias("p"))
    return best.select("task_id", "p.*")
