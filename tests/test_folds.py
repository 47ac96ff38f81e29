"""The folds as composable maps: one pass, any cut, many keys at once, and one key of a million rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import ordered as O
from fleetlens.operators.live import transition_table


def ewma(rows):
    x = 1.0
    for p, q in rows:
        if p > 0 and q > 0:
            x = (1 - 0.3) * x + 0.3 * min(max(q / p, 0.1), 1000.0)
        yield x, x


def states(rows):
    table, s = transition_table(), 0
    for (e,) in rows:
        nxt = table[s][e] if e >= 0 else -1
        s = nxt if nxt >= 0 else s
        yield (s, nxt >= 0), s


def bans(length):
    def fold(rows):
        until = 0.0
        for t, strike in rows:
            started = bool(strike) and until <= t
            until = float(t + length) if started else until
            yield (started, until), until
    return fold


def carve(rows):
    cur = 0
    for size, total, group in rows:
        take = min(size, total - cur, group - cur % group if group else size)
        start, take = cur, max(take, 0)
        cur += take
        yield (start, take), cur


def cases():
    yield "ewma", O.Ewma("p", "q", 0.3, 0.1, 1000.0), ["p", "q"], ewma, lambda r, i: (float(r.randrange(-1, 9)), float(r.randrange(1, 50)))
    yield "states", O.StateMachine("e", transition_table()), ["e"], states, lambda r, i: (r.randrange(-1, 10),)
    for length in (0, 1, 4, 60):
        yield f"bans {length}", O.Cooldown("t", "s", length), ["t", "s"], bans(length), lambda r, i: (i // 3, r.random() < 0.4)
    for total, group in ((10**9, 0), (10**9, 37), (100, 7), (90, 0), (0, 5), (10**9, 1)):
        yield (f"carve {total} {group}", O.Carve("n", "total", "group"), ["n", "total", "group"], carve,
               lambda r, i, total=total, group=group: (r.choice([0, 1, 3, 8, 50]), total, group))


def columns(names, rows):
    return {n: np.array([r[i] for r in rows]) for i, n in enumerate(names)}


def outputs(fold, outs):
    made = list(zip(*[np.asarray(outs[n]).tolist() for n in fold.outputs]))
    return [m[0] for m in made] if len(fold.outputs) == 1 else made


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_any_cut_gives_the_sequential_fold(case):
    _, fold, names, plain, row = case
    rng = random.Random(5)
    for n in (1, 2, 9, 120):
        rows = [row(rng, i) for i in range(n)]
        want = list(plain(rows))
        for cut in range(n + 1):
            got, state = [], fold.start()
            for part in (rows[:cut], rows[cut:]):
                if part:
                    outs, state = fold.step(state, columns(names, part))
                    got += outputs(fold, outs)
            assert got == [w for w, _ in want]
            assert state == [float(want[-1][1])]
            # The same end through summaries, with the second part taken up in two batches.
            state, half = fold.start(), cut + (n - cut) // 2
            for parts in ((rows[:cut],), (rows[cut:half], rows[half:])):
                acc = fold.blank()
                for part in parts:
                    acc = fold.absorb(acc, columns(names, part)) if part else acc
                state = fold.chain(state, [float(v) for v in fold.pack(acc)]) if any(parts) else state
            assert state == pytest.approx([float(want[-1][1])], rel=1e-12)


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_many_keys_in_one_call(case):
    _, fold, names, plain, row = case
    rng = random.Random(7)
    groups = [[row(rng, i) for i in range(rng.choice([1, 2, 5, 40]))] for _ in range(60)]
    rows = [r for g in groups for r in g]
    heads = np.concatenate([[k > 0] + [False] * (len(g) - 1) for k, g in enumerate(groups)])
    outs, state = fold.step(fold.start(), columns(names, rows), heads)
    assert outputs(fold, outs) == [w for g in groups for w, _ in plain(g)]
    assert state == [float(list(plain(groups[-1]))[-1][1])]


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_a_million_rows_of_one_key(case):
    _, fold, names, plain, row = case
    rng = random.Random(3)
    rows = [row(rng, i) for i in range(1_000_000)]
    cols = columns(names, rows)
    began = time.monotonic()
    outs, state = fold.step(fold.start(), cols)
    end = fold.chain(fold.start(), [float(v) for v in fold.pack(fold.absorb(fold.blank(), cols))])
    assert time.monotonic() - began < 10
    want = list(plain(rows))
    assert outputs(fold, outs) == [w for w, _ in want]
    assert state == [float(want[-1][1])] and end == pytest.approx(state, rel=1e-9)


@pytest.mark.parametrize("hot", [False, True])
def test_null_keys_are_one_key(spark, hot):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, 1).cast("long").alias("k"), "id", F.lit(3).alias("n"),
                                 F.lit(10**6).alias("total"), F.lit(10).alias("group"))
    got = O.scan(df, ["k"], ["id"], ["n", "total", "group"], O.Carve("n", "total", "group"), hot).collect()
    for odd in (0, 1):
        mine = sorted((r.id, r.start_unit, r.granted) for r in got if r.id % 2 == odd)
        assert [m[1:] for m in mine] == [w for w, _ in carve([(3, 10**6, 10)] * 200)]
