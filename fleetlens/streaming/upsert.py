"""A keyed table kept by a stream: one base, a few deltas, and a manifest that says which of them count.

Every trigger lands its rows as a delta and then a manifest row; with enough deltas the base is rewritten with them and
they are let go. Folders are taken in turn from fixed rings, so their number does not grow with the triggers, and a folder
comes up again only when no manifest that a reader can still hold names it. A trigger that failed before its manifest row
changed nothing that is read; one that is replayed after it does nothing.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from fleetlens.sources.state import compact

MANIFEST = "batch_id long, base int, deltas array<long>"
MANIFESTS, BASES = 4, 3
BATCH = "_batch_id"


class UpsertTable:
    """The latest row per ``keys`` of a stream in update mode, under ``path``.

    Rows are read as of one trigger. What a reader holds stays in place for at least ``merge_every`` more triggers.
    Concurrent writers are not supported: a stream has one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge_every: int = 8):
        self.spark, self.path, self.keys, self.merge_every = spark, path.rstrip("/"), keys, merge_every

    def _delta(self, batch_id: int) -> str:
        return f"{self.path}/delta/{batch_id % (2 * self.merge_every)}"

    def _base(self, number: int) -> str:
        return f"{self.path}/base/{number}"

    def manifest(self) -> Row | None:
        """The newest committed state. A manifest folder that is being rewritten is one of the older ones."""
        for attempt in range(3):
            try:
                found = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*").collect()
            except PySparkException as e:
                if "PATH_NOT_FOUND" in str(e):
                    return None
                if attempt == 2:
                    raise
            else:
                return max(found, key=lambda r: r.batch_id, default=None)
        return None

    def _rows(self, state: Row | None, schema) -> DataFrame:
        folders = [] if state is None else [self._base(state.base)] * (state.base >= 0) + [self._delta(b) for b in state.deltas]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def land(self, batch: DataFrame, batch_id: int) -> None:
        """Take a trigger's rows; use it as ``writeStream.foreachBatch(table.land)``."""
        state = self.manifest()
        if state is not None and state.batch_id >= batch_id:
            return
        rows = batch.selectExpr("*", f"CAST({batch_id} AS BIGINT) AS {BATCH}")
        rows.write.mode("overwrite").parquet(self._delta(batch_id))
        base, deltas = (-1, []) if state is None else (state.base, list(state.deltas))
        deltas.append(batch_id)
        if len(deltas) >= self.merge_every:
            whole = self._rows(Row(base=base, deltas=deltas), rows.schema)
            base, deltas = (base + 1) % BASES, []
            compact(whole, self.keys, BATCH, [*self._rest(rows.columns), BATCH]).select(rows.columns).write.mode("overwrite").parquet(self._base(base))
        commit = self.spark.createDataFrame([(batch_id, base, deltas)], MANIFEST).coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.path}/manifest/{batch_id % MANIFESTS}")

    def _rest(self, columns: list[str]) -> list[str]:
        return [c for c in columns if c not in (*self.keys, BATCH)]

    def read(self, schema=None) -> DataFrame:
        """The latest row per key as of the newest trigger. ``schema`` is needed only while nothing has landed."""
        state = self.manifest()
        if state is None:
            return self.spark.createDataFrame([], schema)
        if schema is None:
            schema = self.spark.read.parquet(self._delta(state.batch_id)).drop(BATCH).schema
        full = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, {BATCH} long"
        return compact(self._rows(state, full), self.keys, BATCH, self._rest(schema.names)).select(schema.names)
