"""Order-dependent work per key that survives hot keys.

A plain window puts a whole key into one task. That is the right plan while
every key is small, so each operator here first looks at how much the
input reads and, if that is a lot, at a bound on the largest group (``is_hot``). Past ``spark.fleetlens.hotRows`` the rows are range
partitioned by (key, order), which cuts a hot key into as many ordered pieces
as it needs; each piece is handled on its own and receives a carry from the
pieces before it. Range partitioning leaves at most one key continuing into a
partition, so the carry table never has more than two rows per partition and is
safe to broadcast.

The pieces come from sampled bounds, so the partitioned rows are written once
(checkpoint) before both passes read them; a recomputed stage can then not cut
the rows elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetlens.session import cut_lineage, hot_rows, shuffle_partitions

CHUNK = "__chunk"
CARRY = "__carry_"
BYTES_PER_ROW = 8
BUCKETS = 65_536


def estimated_bytes(df: DataFrame) -> int:
    """What the optimised plan reads: the size estimates of its leaves."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def multiplies(df: DataFrame) -> bool:
    """Whether the plan may give more rows than its leaves have."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(f"{node} " in plan for node in ("Generate", "Expand", "Join"))


def is_hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether some group is too large for one task: more than ``spark.fleetlens.hotRows`` rows.

    Inputs that read little and are not multiplied by a join or an explode are not counted. Otherwise rows are
    counted per hash bucket of the key, which bounds the largest group from
    above: one scan of the key columns, combined on the map side to a fixed
    number of buckets whatever the number of keys. A wrong guess costs time,
    never rows."""
    spark = df.sparkSession
    limit = hot_rows(spark)
    if limit <= 0:
        return True
    if not multiplies(df) and estimated_bytes(df) <= BYTES_PER_ROW * limit:
        return False
    if not keys:
        return df.count() > limit
    parts = shuffle_partitions(spark)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(max(BUCKETS, 8 * parts)))
    top = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (top or 0) > limit


def in_order(order: list[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def split_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows range partitioned by (keys, order) with the piece number as data."""
    parts = max(2, shuffle_partitions(df.sparkSession))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *in_order(order))
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id().cast("long")))


def _local(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(value).over(window), F.lit(0))
    if kind == "count":
        return F.count(F.lit(1)).over(window)
    if kind == "total":
        return F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"min": F.min, "max": F.max}[kind](value).over(window)


def _total(kind: str, value: Column, order: list[str]) -> Column:
    if kind in ("sum", "total"):
        return F.coalesce(F.sum(value), F.lit(0))
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "last":
        plain = F.struct(*[F.col(c.lstrip("-")) for c in order])
        pick = F.min_by if order[0].startswith("-") else F.max_by
        return pick(value, F.when(value.isNotNull(), plain))
    return {"min": F.min, "max": F.max}[kind](value)


def _carry(kind: str, total: Column, before, whole) -> Column:
    """What the other pieces of the key add to this one."""
    if kind == "total":
        return F.sum(total).over(whole) - total
    return _local("sum" if kind == "count" else kind, total, before)


def _join(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count", "total"):
        return local + F.coalesce(carry, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carry)
    return {"min": F.least, "max": F.greatest}[kind](local, carry)


def running(df: DataFrame, keys: list[str], order: list[str],
            outs: dict[str, tuple[str, Column]], inclusive: bool = True, hot: bool | None = None) -> DataFrame:
    """Running values per key. ``outs`` maps a new column to (kind, value) with
    kind one of sum, count, last (non-null), min, max, or total (the sum over
    the whole key, on each of its rows). ``order`` must be total
    within a key and point one way ("-" prefix: descending); ``inclusive=False``
    leaves the current row out, so "last" then reads the previous row. Pass
    ``hot`` when a chain of calls over the same groups was measured once."""
    end = 0 if inclusive else -1
    if not (is_hot(df, keys) if hot is None else hot):
        # One window for all outputs: one shuffle and one sort.
        w = Window.partitionBy(*keys).orderBy(*in_order(order)).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[_local(k, v, w).alias(n) for n, (k, v) in outs.items()])

    pieces = split_ranges(df, keys, order)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*in_order(order)).rowsBetween(Window.unboundedPreceding, end)
    local = pieces.select("*", *[_local(k, v, w).alias(n) for n, (k, v) in outs.items()])

    totals = pieces.groupBy(*keys, CHUNK).agg(*[_total(k, v, order).alias(n) for n, (k, v) in outs.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = totals.select(
        *[F.col(k).alias(CARRY + k) for k in keys], F.col(CHUNK).alias(CARRY + "chunk"),
        F.count(F.lit(1)).over(whole).alias("__pieces"),
        *[_carry(k, F.col(n), before, whole).alias(CARRY + n) for n, (k, _) in outs.items()],
    ).where("__pieces > 1").drop("__pieces")
    cond = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(CARRY + k)), keys,
                  F.col(CHUNK) == F.col(CARRY + "chunk"))
    joined = local.join(F.broadcast(carry), cond, "left")
    return joined.select(*df.columns, *[_join(k, F.col(n), F.col(CARRY + n)).alias(n)
                                        for n, (k, _) in outs.items()])


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, hot: bool | None = None) -> DataFrame:
    """1-based position within the key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, hot=hot)


def nearest_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict, hot: bool | None = None) -> DataFrame:
    """Values at given 0-based ranks of the sorted group, without sorting a
    group in one place: distinct values are counted (map-side combine), their
    counts accumulated, and the first value whose cumulative count passes the
    rank is taken. ``ranks`` maps a name to a function from group size to rank."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    # A group of few rows has few distinct values; only a large one is counted again.
    hot = (is_hot(df, keys) if hot is None else hot) and is_hot(counts, keys)
    cum = running(counts, keys, [value], {"__cum": ("sum", F.col("__n")), "__size": ("total", F.col("__n"))}, hot=hot)
    return cum.groupBy(*keys).agg(
        F.max("__size").alias("n"),
        *[F.min(F.when(F.col("__cum") > fn(F.col("__size")), F.col(value))).alias(name)
          for name, fn in ranks.items()])


def rank_of(q: float):
    """min(n - 1, int(q * n)) as a column function."""
    return lambda n: F.least(n - 1, F.floor(F.lit(float(q)) * n).cast("long"))


def lower_mid(n: Column) -> Column:
    return F.floor((n - 1) / 2).cast("long")


def upper_mid(n: Column) -> Column:
    return F.floor(n / 2).cast("long")


def whole_div(a: Column, b: Column) -> Column:
    """Integer division, exact beyond the range of doubles."""
    return F.call_function("div", a, b)


EXPAND_BLOCK = 32_768


def expand(df: DataFrame, low: Column, high: Column, name: str, block: int = EXPAND_BLOCK,
           spread: int | None = None) -> DataFrame:
    """One row per integer of [low, high]. Long ranges are first cut into
    blocks; the blocks are spread over the cluster before they are expanded, so
    no row ever holds more than ``block`` values and no task a whole range."""
    keep = [c for c in df.columns if c not in (name, "__lo", "__hi")]
    cut = (df.withColumn("__lo", low.cast("long")).withColumn("__hi", high.cast("long")).where("__hi >= __lo")
           .withColumn("__b", F.explode(F.sequence(
               F.lit(0).cast("long"), whole_div(F.col("__hi") - F.col("__lo"), F.lit(block))))))
    first = F.col("__lo") + F.col("__b") * block
    blocks = cut.repartition(spread or shuffle_partitions(df.sparkSession))
    return blocks.select(*keep, F.explode(F.sequence(
        first, F.least(first + (block - 1), F.col("__hi")))).alias(name))


# ---- ordered folds that a window cannot express ----------------------------

class Scan:
    """A left fold per key whose pieces compose.

    ``step`` folds rows of one or more keys and returns one output array per
    column; ``heads`` marks the rows at which a new key starts over. ``absorb``
    collects the rows of one key, ``pack`` sums them up as a map that ``chain``
    can later apply to any starting state. Numbers only; states and summaries
    are float lists.
    """

    outputs: dict[str, str] = {}

    def start(self) -> list[float]:
        raise NotImplementedError

    def step(self, state: list[float], cols: dict[str, np.ndarray], heads: np.ndarray | None = None):
        raise NotImplementedError

    def blank(self):
        raise NotImplementedError

    def absorb(self, acc, cols: dict[str, np.ndarray]):
        raise NotImplementedError

    def pack(self, acc) -> list[float]:
        raise NotImplementedError

    def chain(self, state: list[float], packed: list[float]) -> list[float]:
        raise NotImplementedError


def _changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether a row's key differs from the row's before it; null keys are equal."""
    change = np.zeros(len(pdf), dtype=bool)
    change[:1] = True
    for k in keys:
        col, null = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        change[1:] |= (col[1:] != col[:-1]) & ~(null[1:] & null[:-1])
    return change


def _key(pdf: pd.DataFrame, keys: list[str], row: int) -> tuple:
    return tuple(None if pd.isna(v) else _plain(v) for v in (pdf[k].iloc[row] for k in keys))


def _runs(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    starts = np.flatnonzero(_changes(pdf, keys))
    for s, e in zip(starts, np.append(starts[1:], len(pdf))):
        yield _key(pdf, keys, s), int(s), int(e)


def _plain(v):
    return v.item() if isinstance(v, np.generic) else v


def scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], fold: Scan,
         hot: bool | None = None) -> DataFrame:
    """Append ``fold.outputs`` to every row, folding each key in ``order``."""
    out_schema = T.StructType(df.schema.fields + [
        f for f in T._parse_datatype_string(
            ", ".join(f"{n} {t}" for n, t in fold.outputs.items())).fields])

    def apply_rows(batches, carries: dict):
        key, state = None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            heads = _changes(pdf, keys)
            if state is None:
                # Only the first key of a piece may have begun before it.
                chunk = _plain(pdf[CHUNK].iloc[0]) if CHUNK in pdf else -1
                state = list(carries.get((*_key(pdf, keys, 0), chunk)) or fold.start())
                heads[0] = False
            else:
                heads[0] = _key(pdf, keys, 0) != key
            key = _key(pdf, keys, -1)
            outs, state = fold.step(state, {c: pdf[c].to_numpy() for c in inputs}, heads)
            yield pdf.drop(columns=[CHUNK], errors="ignore").assign(**{n: outs[n] for n in fold.outputs})

    if not (is_hot(df, keys) if hot is None else hot):
        placed = df.repartition(*keys).sortWithinPartitions(*keys, *in_order(order))
        return placed.mapInPandas(lambda it: apply_rows(it, {}), out_schema)

    pieces = split_ranges(df, keys, order).sortWithinPartitions(*keys, *in_order(order))

    # Only the last key of a piece can continue into the next one, but it may
    # have begun earlier, so first and last key of every piece are summarised.
    def summarise(batches):
        first, key, acc, chunk = None, None, None, None
        for pdf in batches:
            for k, s, e in _runs(pdf, keys):
                if k != key:
                    if key is not None and key == first:
                        yield _row(key, chunk, fold.pack(acc))
                    first = k if first is None else first
                    key, acc = k, fold.blank()
                    chunk = _plain(pdf[CHUNK].to_numpy()[s])
                acc = fold.absorb(acc, {c: pdf[c].to_numpy()[s:e] for c in inputs})
        if key is not None:
            yield _row(key, chunk, fold.pack(acc))

    def _row(k, chunk, packed):
        return pd.DataFrame({**{c: pd.Series([v], dtype=object) for c, v in zip(keys, k)}, CHUNK: [chunk],
                             "packed": [[float(x) for x in packed]]})

    sum_schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField(CHUNK, T.LongType()), T.StructField("packed", T.ArrayType(T.DoubleType()))])
    # At most two rows per partition, whatever the data size.
    rows = pieces.mapInPandas(summarise, sum_schema).collect()
    by_key: dict[tuple, list] = {}
    for r in rows:
        by_key.setdefault(tuple(r[k] for k in keys), []).append((r[CHUNK], r["packed"]))
    carries = {}
    for k, parts in by_key.items():
        state = fold.start()
        for i, (chunk, packed) in enumerate(sorted(parts)):
            if i:
                carries[(*k, chunk)] = state
            state = fold.chain(state, packed)
    return pieces.mapInPandas(lambda it: apply_rows(it, carries), out_schema)


def _heads(heads: np.ndarray | None, n: int) -> np.ndarray:
    return np.zeros(n, dtype=bool) if heads is None else heads


def _reached(entries: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Elements on the chains i, jump[i], jump[jump[i]], ... from ``entries``; len(jump) ends a chain.

    Jumps are doubled: after k rounds the first 2^k elements of every chain are marked."""
    m = len(jump)
    jump, seen = np.append(jump, m), np.zeros(m + 1, dtype=bool)
    seen[entries] = True
    while (jump < m).any():
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:m]


def _ends(jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last element, number of jumps) of the chain from every element, by doubling."""
    m = len(jump)
    hops = (jump < m).astype(np.int64)
    last = np.where(jump < m, jump, np.arange(m))
    while True:
        further = last[last]
        if (further == last).all():
            return last, hops
        hops, last = hops + hops[last], further


class Ewma(Scan):
    """Correction factor: a convex step toward the clamped actual/predicted
    ratio. Start and samples lie inside the clamp, so the factor does too and a
    piece is the affine map x -> a*x + b. Within a piece the steps stay in order,
    as another order of adding would round differently."""

    outputs = {"correction_after": "double"}

    def __init__(self, predicted: str, actual: str, alpha: float, low: float, high: float):
        self.p, self.q = predicted, actual
        self.alpha, self.low, self.high = min(max(alpha, 0.0), 1.0), low, high

    def _samples(self, cols):
        p, q = cols[self.p].astype(float), cols[self.q].astype(float)
        ok = np.isfinite(p) & np.isfinite(q) & (p > 0) & (q > 0)
        ratio = np.clip(np.divide(q, p, out=np.ones_like(p), where=ok), self.low, self.high)
        return ok, ratio

    def start(self):
        return [1.0]

    def step(self, state, cols, heads=None):
        ok, ratio = self._samples(cols)
        heads = _heads(heads, len(ok))
        # Rows that neither sample nor start a key repeat the factor before them.
        at = np.flatnonzero(ok | heads)
        x, keep, first = state[0], 1.0 - self.alpha, self.start()[0]
        after = [x]
        for head, sampled, step in zip(heads[at].tolist(), ok[at].tolist(), (self.alpha * ratio[at]).tolist()):
            x = first if head else x
            x = keep * x + step if sampled else x
            after.append(x)
        return {"correction_after": np.array(after)[np.cumsum(ok | heads)]}, [x]

    def blank(self):
        return [1.0, 0.0]

    def absorb(self, acc, cols):
        ok, ratio = self._samples(cols)
        keep, r = 1.0 - self.alpha, ratio[ok]
        weight = keep ** np.arange(len(r), -1, -1, dtype=float)
        return [acc[0] * weight[0], acc[1] * weight[0] + self.alpha * float(weight[1:] @ r)]

    def pack(self, acc):
        return acc

    def chain(self, state, packed):
        return [packed[0] * state[0] + packed[1]]


class StateMachine(Scan):
    """Table-driven automaton: column ``code`` holds event numbers, ``table[s][e]``
    the next state or -1 (refused, state kept). A piece is a map of all states.

    Rows are laid out in about sqrt(n) blocks that advance side by side, first
    from every state, then, with the maps of the blocks chained, from the true one."""

    outputs = {"state_code": "long", "legal": "boolean"}

    def __init__(self, code: str, table: list[list[int]], start_state: int = 0):
        self.code, self.first = code, start_state
        # A last column for events below 0, which are refused.
        self.table = np.array([[*row, -1] for row in table], dtype=np.int64)
        self.next = np.where(self.table >= 0, self.table, np.arange(len(table))[:, None])

    def start(self):
        return [float(self.first)]

    def _blocks(self, cols, heads):
        events = np.maximum(cols[self.code].astype(np.int64), -1)
        n = len(events)
        width = max(1, int(np.ceil(np.sqrt(n))))
        pad = -n % width
        lay = lambda a, fill: np.append(a, np.full(pad, fill, a.dtype)).reshape(-1, width).T
        return n, lay(events, -1), lay(_heads(heads, n), False)

    def _maps(self, events, heads):
        at = np.tile(np.arange(len(self.next)), (events.shape[1], 1))
        for e, h in zip(events, heads):
            at = self.next[np.where(h[:, None], self.first, at), e[:, None]]
        return at

    def step(self, state, cols, heads=None):
        n, events, heads = self._blocks(cols, heads)
        s, begins = int(state[0]), np.empty(events.shape[1], dtype=np.int64)
        for b, ends in enumerate(self._maps(events, heads)):
            begins[b], s = s, int(ends[s])
        states, legal = np.empty(events.shape, dtype=np.int64), np.empty(events.shape, dtype=bool)
        at = begins
        for j, (e, h) in enumerate(zip(events, heads)):
            at = np.where(h, self.first, at)
            legal[j] = self.table[at, e] >= 0
            states[j] = at = self.next[at, e]
        return {"state_code": states.T.ravel()[:n], "legal": legal.T.ravel()[:n]}, [float(s)]

    def blank(self):
        return np.arange(len(self.next))

    def absorb(self, acc, cols):
        _, events, heads = self._blocks(cols, None)
        for ends in self._maps(events, heads):
            acc = ends[acc]
        return acc

    def pack(self, acc):
        return [float(x) for x in acc]

    def chain(self, state, packed):
        return [packed[int(state[0])]]


class Cooldown(Scan):
    """Greedy bans: a strike at time t starts a ban until t + length unless one
    is running. The state is the end of the current ban. The strike that starts
    the next ban is found by binary search, and the chain of bans by doubling
    such jumps. Over a piece the end state is a step function of the start
    state: starts up to a strike's time follow that strike's chain to its end."""

    outputs = {"ban_started": "boolean", "banned_until": "double"}

    def __init__(self, time: str, strike: str, length: float):
        self.t, self.s, self.length = time, strike, float(length)

    def start(self):
        return [0.0]

    def _jumps(self, key, time):
        """The strike of the same key that starts the next ban, or the number of strikes."""
        def pair(t):  # compared by key, then by time
            z = np.empty(len(key), dtype=complex)
            z.real, z.imag = key, t
            return z
        m = len(time)
        after = np.maximum(np.searchsorted(pair(time), pair(time + self.length)), np.arange(1, m + 1))
        return np.where((after < m) & (key[np.minimum(after, m - 1)] == key), after, m)

    def step(self, state, cols, heads=None):
        t, struck = cols[self.t].astype(float), cols[self.s].astype(bool)
        heads, rows = _heads(heads, len(t)), np.arange(len(t))
        key = np.cumsum(heads)
        at = np.flatnonzero(struck)
        free = t[at] >= np.where(key[at] == 0, state[0], self.start()[0])
        # A key's bans begin with its first strike after the state it starts from.
        entries = np.flatnonzero(free)[np.unique(key[at][free], return_index=True)[1]]
        started = np.zeros(len(t), dtype=bool)
        if len(entries):
            started[at[_reached(entries, self._jumps(key[at], t[at]))]] = True
        source = np.maximum.accumulate(np.where(started | heads, rows, -1))
        value = np.where(started, t + self.length, self.start()[0])
        until = np.where(source >= 0, value[source], state[0])
        return {"ban_started": started, "banned_until": until}, [float(until[-1])]

    def blank(self):
        return []

    def absorb(self, acc, cols):
        return [*acc, cols[self.t].astype(float)[cols[self.s].astype(bool)]]

    def pack(self, acc):
        """Classes of starting values: highest start in the class, its end."""
        t = np.concatenate(acc) if acc else np.empty(0)
        if not len(t):
            return []
        last, _ = _ends(self._jumps(np.zeros(len(t)), t))
        tops, first = np.unique(t, return_index=True)
        ends = t[last[first]] + self.length
        final = np.append(ends[1:] != ends[:-1], True)
        return np.stack([tops[final], ends[final]], 1).ravel().tolist()

    def chain(self, state, packed):
        i = int(np.searchsorted(packed[::2], state[0]))
        return [packed[2 * i + 1]] if 2 * i < len(packed) else state


class Carve(Scan):
    """Cursor over a unit range cut at group boundaries: each request takes
    min(size, room to the boundary, units left). Group and total belong to the
    key. The request that next reaches a boundary is found by binary search over
    running sums, and the chain of them by doubling such jumps. A piece is a
    step function of where in its group the cursor stood: every start that is
    first clipped at the same request continues identically."""

    outputs = {"start_unit": "long", "granted": "long"}

    def __init__(self, size: str, total: str, group: str):
        self.size, self.total, self.group = size, total, group

    def start(self):
        return [0.0]

    def _asked(self, cols):
        size, total, group = (cols[c].astype(np.int64) for c in (self.size, self.total, self.group))
        most = np.maximum(np.where(group > 0, np.minimum(group, total), total), 0)
        return np.clip(size, 0, most), total, group

    def step(self, state, cols, heads=None):
        n, total, group = self._asked(cols)
        heads, rows = _heads(heads, len(n)), np.arange(len(n))
        key = np.cumsum(heads)
        begin = np.maximum.accumulate(np.where(heads, rows, 0))
        origin = np.where(key == 0, int(state[0]), int(self.start()[0]))
        width = np.maximum(group, 1)
        offset = np.where(group > 0, origin % width, 0)
        done = np.cumsum(n)
        before = (done - n)[begin]
        cut = np.flatnonzero(group > 0)

        def reach(goal, rows):
            """The first request of the same key at which the running sum reaches the goal."""
            j = np.searchsorted(done, goal)
            return np.where((j < len(n)) & (key[np.minimum(j, len(n) - 1)] == key[rows]), j, len(n))
        jump = np.full(len(n), len(n))
        jump[cut] = reach(done[cut] + group[cut], cut)
        firsts = cut[begin[cut] == cut]
        clipped = _reached(reach(before[firsts] + group[firsts] - offset[firsts], firsts), jump)
        passed = np.cumsum(clipped)
        passed -= (passed - clipped)[begin]
        last = np.maximum.accumulate(np.where(clipped | heads, rows, 0))
        inside = origin - offset + passed * group + done - done[last]
        end = np.where(passed > 0, inside, origin + done - before)
        limit = np.maximum(total, origin)
        end = np.minimum(end, limit)
        start = np.where(begin == rows, origin, np.append(0, end[:-1]))
        return {"start_unit": start, "granted": end - start}, [float(end[-1])]

    def blank(self):
        return {"n": [], "group": 0, "total": 0}

    def absorb(self, acc, cols):
        n, total, group = self._asked(cols)
        return {"n": [*acc["n"], n], "group": int(group[-1]), "total": int(total[-1])} if len(n) else acc

    def pack(self, acc):
        """Group, total, units asked, and classes of starting offsets: the lowest
        offset in the class, groups passed, offset after the piece."""
        n = np.concatenate(acc["n"]) if acc["n"] else np.empty(0, dtype=np.int64)
        head, group, done = [acc["group"], acc["total"], int(n.sum())], acc["group"], np.cumsum(n)
        first = np.flatnonzero((n > 0) & (done - n < group))  # requests that can be the first to be clipped
        if not len(first):
            return head
        last, hops = _ends(np.searchsorted(done, done + group))
        low, passed, offset = np.maximum(group - done[first], 0), hops[first] + 1, done[-1] - done[last[first]]
        final = np.append((passed[1:] != passed[:-1]) | (offset[1:] != offset[:-1]), True)
        return head + np.stack([low[final], passed[final], offset[final]], 1).ravel().tolist()

    def chain(self, state, packed):
        group, total, moved = (int(v) for v in packed[:3])
        cur = int(state[0])
        if group:
            base, off = cur - cur % group, cur % group
            lows = np.asarray(packed[3::3])
            i = int(np.searchsorted(-lows, -off))  # lows fall: the first at most the offset
            if i < len(lows):
                return [float(min(base + int(packed[4 + 3 * i]) * group + int(packed[5 + 3 * i]), total))]
        return [float(min(cur + moved, total))]
