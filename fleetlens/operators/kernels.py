"""Named map kernels over a column, with their comparison class."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import pcg_hash
from fleetlens.operators.compare import compare_exact, compare_statistical, compare_tolerant
from fleetlens.operators.quorum import decide_exact, decide_statistical, decide_tolerant


@dataclass(frozen=True)
class Kernel:
    apply: Callable[[Column], Column]
    determinism: str
    abs_eps: float = 0.0
    rel_eps: float = 0.0


def pixel_payload(vector: Column) -> Column:
    """A payload of the statistical class: groups of four elements are r, g, b and, from |fourth| + 1, the sample count."""
    def pixel(i):
        v = [F.element_at(vector, i * 4 + k).cast("double") for k in (1, 2, 3, 4)]
        return F.struct(v[0].alias("r"), v[1].alias("g"), v[2].alias("b"), (F.abs(v[3]) + 1.0).alias("samples"))
    whole = F.floor(F.size(vector) / 4).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), whole), lambda i: i < whole), pixel)


REGISTRY: dict[str, Kernel] = {
    "smoke_hash": Kernel(pcg_hash, "exact"),
    "smoke_double": Kernel(lambda v: v.cast("double") * 2.0, "tolerant", 1e-6, 1e-5),
    "smoke_pixels": Kernel(pixel_payload, "statistical"),
}


def register(name: str, kernel: Kernel) -> None:
    if kernel.determinism not in ("exact", "tolerant", "statistical"):
        raise ValueError(f"no comparator for class {kernel.determinism!r}")
    REGISTRY[name] = kernel


def kernel_map(df: DataFrame, name: str, column: str = "value", out: str = "value") -> DataFrame:
    if name not in REGISTRY:
        raise KeyError(f"kernel {name!r} is not registered")
    return df.withColumn(out, REGISTRY[name].apply(F.col(column)))


def compare_kernel(name: str, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    k = REGISTRY[name]
    if k.determinism == "exact":
        return compare_exact(a, b, keys)
    if k.determinism == "statistical":
        return compare_statistical(*[
            s.select(*keys, F.posexplode("value").alias("pixel", "v")).select(*keys, F.col("pixel").cast("long").alias("pixel"), "v.*")
            for s in (a, b)], keys)
    return compare_tolerant(a, b, keys, k.abs_eps, k.rel_eps)


def decide_kernel(name: str, subs: DataFrame, required, cap: int, value: str = "value") -> DataFrame:
    """Verdict per (task, round) by the comparison of the kernel's class; exact kernels answer with checksums."""
    k = REGISTRY[name]
    if k.determinism == "exact":
        return decide_exact(subs.withColumn("answer", F.col(value)), required, cap)
    if k.determinism == "statistical":
        return decide_statistical(subs, required, cap, value)
    return decide_tolerant(subs, required, cap, k.abs_eps, k.rel_eps, value)
