"""Quorum whose required agreement follows from the workers' own records.

How many answers must agree is asked when an answer arrives, of the record that its worker has by then; the verdict that
the answer then brings about changes the records of all who took part, and so what later answers need. Arrivals have one
order over all tasks, but a task's verdict depends on others only through these records. So every requirement is guessed,
all tasks are judged side by side, records are read as of every arrival, and what came out differently is judged again,
until nothing changes.

This ends in the one state that judging the arrivals one after the other would give: if all requirements before an
arrival are right, then so are all verdicts before it, hence the records that it meets, and its own requirement is right
from the next round on. A state in which nothing changes is therefore right from the first arrival to the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.exprs import MAX_REPLICAS, TRUSTED_AT, beta_score, required_agreement
from fleetlens.operators.ordered import is_hot, running
from fleetlens.operators.quorum import decide_exact, quorum_credits, settle
from fleetlens.operators.reputation import ReputationConfig, reputation_history
from fleetlens.session import Buckets, join_where_they_lie

ORDER = ["t_ms", "sub_id"]
EVIDENCE = ["worker_id", "task_id", "t_ms", "sub_id", "slot", "accepted", "severity"]
#: What tells evidence apart: the rest follows from it.
PLACE = ["worker_id", "sub_id", "slot", "accepted"]
#: Workers or tasks of a round that are sent to every task.
BROADCAST_KEYS = 500_000


def _time(c: str) -> Column:
    """The time, or the least there is for none, as rows are ordered."""
    return F.coalesce(F.col(c), F.lit(-2**63).cast("long"))


def _evidence(subs: DataFrame, cap: int) -> DataFrame:
    """Who is credited and charged for the tasks of ``subs``, at the arrival that decided: the last that counts."""
    credits = quorum_credits(subs, settle(decide_exact(subs, F.col("need"), cap)), cap, tuple(ORDER))
    last = F.max(F.struct("seq", *ORDER)).over(Window.partitionBy("task_id"))
    return credits.withColumn("slot", F.col("seq")).withColumn("last", last).select(
        *[F.col("last")[c].alias(c) if c in ORDER else F.col(c) for c in EVIDENCE])


def _standing(arrivals: DataFrame, evidence: DataFrame, cfg: ReputationConfig, cap: int, hot: bool) -> DataFrame:
    """``arrivals`` with ``need`` from the evidence of earlier ones. Of one arrival's evidence credits count before
    charges, then the order of the round. A ban that ran out puts its worker on probation."""
    place = (F.col("sub_id") * 2 + (~F.col("accepted")).cast("int")) * cap + (F.col("slot") - 1) % cap
    log = evidence.select("worker_id", "t_ms", "sub_id", place.alias("verdict_id"), "accepted", "severity", F.lit(False).alias("spot"))
    history = reputation_history(log, cfg, hot)
    known = F.struct("score", (F.col("on_probation") | (F.col("banned_until") > F.col("t_ms"))).alias("checked"))
    # An arrival reads the record before its own verdict changes it.
    both = (history.select("worker_id", *ORDER, F.lit(1).alias("kind"), "verdict_id", known.alias("known"), F.lit(None).cast("long").alias("task_id"))
            .unionByName(arrivals.select("worker_id", *ORDER, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("verdict_id"),
                                         F.lit(None).cast("struct<score:double,checked:boolean>").alias("known"), "task_id")))
    read = running(both, ["worker_id"], [*ORDER, "kind", "verdict_id"], {"seen": ("last", F.col("known"))}, hot=hot)
    score = F.coalesce("seen.score", beta_score(F.lit(cfg.alpha0), F.lit(cfg.beta0)))
    trusted = F.when(score >= cfg.trusted_at, F.lit(TRUSTED_AT)).otherwise(F.lit(0.0))
    need = required_agreement(F.lit("adaptive"), trusted, F.coalesce("seen.checked", F.lit(False)), F.lit(False))
    return read.where("kind = 0").select("worker_id", "task_id", "sub_id", need.alias("need"))


def _needs(rows: DataFrame, moved: DataFrame, by: str, first, **until: int) -> DataFrame:
    """``rows`` with what ``moved`` said last of the arrival, else ``first``: ``need``, and for each name in ``until`` the
    same without the passes after that one. Both lie by ``by``."""
    said = {"need": F.col("pass")} | {name: F.when(F.col("pass") <= n, F.col("pass")) for name, n in until.items()}
    last = moved.groupBy(by, "sub_id").agg(*[F.max_by("need", when).alias(f"__{name}") for name, when in said.items()])
    found = rows.join(last, [by, "sub_id"], "left")
    return found.select(*rows.columns, *[F.coalesce(f"__{name}", first).alias(name) for name in said])


def _few(keys: DataFrame) -> DataFrame:
    """Distinct keys, sent to every task if they are few: the side they are looked up in is then neither sorted nor moved.

    Bucketed joins have no shuffle whose size Spark could see, and it takes a filtered table to be as large as the whole."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def adaptive_requirements(subs: DataFrame, cfg: ReputationConfig = ReputationConfig(), cap: int = MAX_REPLICAS) -> DataFrame:
    """``subs`` (task_id, worker_id, seq, answer, t_ms, sub_id) with ``need``, the agreement its worker's record asked for.

    ``sub_id`` is unique and below 2^56, (t_ms, sub_id) is the order of arrival over all tasks and ``seq`` the same order within a task;
    an arrival without a task or worker keeps the first requirement. After the first round only tasks whose requirements changed are judged again, and only records of workers whose
    evidence changed are read again, so a round's work falls with what is still open. Arrivals are filed once by task and
    once by worker, and stay there; a round files what changed: requirements, and evidence that came or went. A round
    settles at least one more arrival for good; in practice requirements change seldom and few rounds are needed.
    """
    join_where_they_lie(subs.sparkSession)
    first = required_agreement(F.lit("adaptive"), F.lit(cfg.alpha0 / (cfg.alpha0 + cfg.beta0)), F.lit(False), F.lit(False))
    tasks = Buckets(subs.select("task_id", "worker_id", "seq", "answer", *ORDER), "task_id", "tasks")
    judged = tasks.read()
    workers = Buckets(judged.where("sub_id IS NOT NULL").select("worker_id", "task_id", *ORDER), "worker_id", "workers")
    arrivals = workers.read()
    hot = is_hot(arrivals, ["worker_id"])
    record = Buckets(_evidence(judged.withColumn("need", first), cap).select(*EVIDENCE, F.lit(1).alias("sign"), F.lit(0).alias("pass")),
                     "worker_id", "record")
    none = judged.select("worker_id", "task_id", "sub_id", first.alias("need"), F.lit(0).alias("pass")).limit(0)
    asked, needs = Buckets(none, "worker_id", "asked"), Buckets(none.drop("worker_id"), "task_id", "needs")
    done = 0
    while True:
        # What a worker is asked before its first evidence that changed stays as it is; no time comes before any other.
        touched = _few(record.read().where(F.col("pass") == done).groupBy("worker_id").agg(F.min(_time("t_ms")).alias("since")))
        evidence = (record.read().join(touched, "worker_id", "left_semi").groupBy(*PLACE)
                    .agg(F.sum("sign").alias("sign"), *[F.max(c).alias(c) for c in EVIDENCE if c not in PLACE])
                    .where("sign > 0").select(*EVIDENCE))
        later = arrivals.join(touched, "worker_id").where(_time("t_ms") >= F.col("since")).drop("since")
        read = _standing(later, evidence, cfg, cap, hot)
        before = _needs(read.withColumnRenamed("need", "now"), asked.read(), "worker_id", first)
        moved = before.where("now <> need").select("worker_id", "task_id", "sub_id", F.col("now").alias("need"), F.lit(done + 1).alias("pass"))
        asked.add(moved)
        moved = asked.read().where(F.col("pass") == done + 1)
        if not moved.limit(1).count():
            break
        needs.add(moved.drop("worker_id"))
        opened = _few(needs.read().where(F.col("pass") == done + 1).select("task_id").distinct())
        # The tasks judged again are looked up once; both verdicts are then taken of their arrivals alone.
        again = Buckets(_needs(judged.join(opened, "task_id", "left_semi"), needs.read().join(opened, "task_id", "left_semi"),
                               "task_id", first, was=done), "task_id", "again")
        gone = _evidence(again.read().withColumn("need", F.col("was")).drop("was"), cap).withColumn("sign", F.lit(-1))
        come = _evidence(again.read().drop("was"), cap).withColumn("sign", F.lit(1))
        done += 1
        record.add(gone.unionAll(come).groupBy(*PLACE)
                   .agg(F.sum("sign").cast("int").alias("sign"), *[F.max(c).alias(c) for c in EVIDENCE if c not in PLACE])
                   .where("sign <> 0").select(*EVIDENCE, "sign", F.lit(done).alias("pass")))
        again.close()
    result = _needs(judged, needs.read(), "task_id", first)
    for table in (tasks, workers, record, asked, needs):
        table.close()
    return result


def decide_adaptive(subs: DataFrame, cfg: ReputationConfig = ReputationConfig(), cap: int = MAX_REPLICAS) -> DataFrame:
    """One exact verdict per task, as :func:`quorum.settle` gives it, under requirements that follow the workers' records."""
    return settle(decide_exact(adaptive_requirements(subs, cfg, cap), F.col("need"), cap))
