"""Quorum under requirements that follow the workers' records, against judging the arrivals one by one."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from fleetlens.operators import feedback
from fleetlens.operators.reputation import ReputationConfig

CFG = ReputationConfig(cooldown_ms=40)
CAP = 4


class Worker:
    def __init__(self):
        self.alpha, self.beta, self.until, self.probation = CFG.alpha0, CFG.beta0, 0, False

    def score(self):
        return self.alpha / (self.alpha + self.beta)

    def need(self):
        if self.probation or self.until:
            return CAP
        return 1 if self.score() >= CFG.trusted_at else 2

    def judge(self, good, t):
        if self.until and self.until <= t:
            self.until, self.probation = 0, True
        self.alpha, self.beta = self.alpha + good, self.beta + 4 * (not good)
        if good:
            self.probation &= self.score() < CFG.trusted_at
        elif not self.until and self.score() < CFG.blacklist_below:
            self.until = t + CFG.cooldown_ms


def one_by_one(rows):
    workers, rounds, done, needs, verdicts = defaultdict(Worker), defaultdict(list), set(), {}, {}
    for task, worker, seq, answer, t, sub in sorted(rows, key=lambda r: r[4:]):
        needs[sub] = workers[worker].need()
        if task in done:
            continue
        held = rounds[task]
        held.append((worker, answer))
        count = [sum(a == b for _, b in held) for _, a in held]
        verdicts[task] = "NeedMoreReplicas"
        if max(count) >= needs[sub] or len(held) == CAP and 2 * max(count) > CAP:
            done.add(task)
            won = held[count.index(max(count))][1]
            verdicts[task] = ("Accept", won)
            for good in (True, False):
                for w, a in held:
                    if (a == won) == good:
                        workers[w].judge(good, t)
        elif len(held) == CAP:
            rounds[task] = []
            verdicts[task] = "Inconclusive"
    return needs, verdicts


def arrivals(seed, tasks, workers, wrong):
    rng = random.Random(seed)
    rows, seq = [], defaultdict(int)
    for sub in range(tasks * 4):
        task, worker = rng.randrange(tasks), 0 if rng.random() < .3 else rng.randrange(workers)
        seq[task] += 1
        bad = rng.random() < wrong.get(worker, 0)
        rows.append((task, worker, seq[task], f"bad{rng.randrange(2)}" if bad else "good", sub // 3, sub))
    return rows


def test_requirements_follow_the_records(spark):
    rows = arrivals(7, 90, 12, {2: .9, 3: .6, 4: .3, 5: .9})
    df = spark.createDataFrame(rows, "task_id long, worker_id long, seq long, answer string, t_ms long, sub_id long").repartition(3)
    subs = feedback.adaptive_requirements(df, CFG, CAP)
    needs, verdicts = one_by_one(rows)
    assert {r.sub_id: r.need for r in subs.collect()} == needs
    assert {1, 2, 4} == set(needs.values())
    got = feedback.settle(feedback.decide_exact(subs, F.col("need"), CAP))
    assert {r.task_id: (r.action, r.answer) if r.action == "Accept" else r.action for r in got.collect()} == verdicts


def test_judging_by_task_needs_no_shuffle(spark):
    rows = arrivals(8, 20, 5, {2: .9})
    df = spark.createDataFrame(rows, "task_id long, worker_id long, seq long, answer string, t_ms long, sub_id long")
    before = {t.name for t in spark.catalog.listTables()}
    got = feedback.decide_adaptive(df, CFG, CAP)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == len({r[0] for r in rows}) and {t.name for t in spark.catalog.listTables()} == before


def test_no_submissions(spark):
    none = spark.createDataFrame([], "task_id long, worker_id long, seq long, answer string, t_ms long, sub_id long")
    assert feedback.decide_adaptive(none).count() == 0


def test_rounds_read_only_what_may_have_changed(spark, monkeypatch):
    rows = arrivals(7, 40, 6, {2: .9, 3: .6})
    df = spark.createDataFrame(rows, "task_id long, worker_id long, seq long, answer string, t_ms long, sub_id long")
    read, judged = [], []
    standing, evidence = feedback._standing, feedback._evidence

    def watched_standing(some, *rest):
        read.append(some.count())
        return standing(some, *rest)

    def watched_evidence(subs, cap):
        judged.append(subs._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return evidence(subs, cap)
    monkeypatch.setattr(feedback, "_standing", watched_standing)
    monkeypatch.setattr(feedback, "_evidence", watched_evidence)
    monkeypatch.setattr(feedback, "BROADCAST_KEYS", 0)
    subs = feedback.adaptive_requirements(df, CFG, CAP)
    assert {r.sub_id: r.need for r in subs.collect()} == one_by_one(rows)[0]
    assert len(read) > 2 and read[-1] < len(rows)
    assert judged == [1] * len(judged), "changed tasks are looked up once, not for every table and verdict"


def test_evidence_without_a_time_comes_first(spark):
    rows = [(k, 1 + k % 3, 1 + i, "good" if (k + i) % 4 else "bad", None if k < 6 else k * 10, k * 8 + i) for k in range(40) for i in range(2)]
    df = spark.createDataFrame(rows, "task_id long, worker_id long, seq long, answer string, t_ms long, sub_id long")
    got = feedback.adaptive_requirements(df, CFG, CAP).collect()
    needs, _ = one_by_one([(*r[:4], -1 if r[4] is None else r[4], r[5]) for r in rows])
    assert {r.sub_id: r.need for r in got} == needs
