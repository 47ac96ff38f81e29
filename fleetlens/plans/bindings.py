"""The test tables seen as the toolkit's logical inputs.

Each function takes (spark, folder). The matching SQL fragments are in
``fragments.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.ordered import number_rows, running, whole_div

DAY_MS = 86_400_000
LEASE_MS = 30 * DAY_MS
NOW_MS = 946_684_800_000  # 2000-01-01

EVENT_KINDS = {"view": "grant", "purchase": "accept", "error": "expire",
               "click": "cancel", "signup": "worker_join"}
STATE_OF = {"F": "Accepted", "O": "Leased", "P": "Queued"}


TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table under its declared schema: no footer is read to infer one."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def millis(c: str):
    """Epoch milliseconds of a zone-less timestamp."""
    return whole_div(F.unix_micros(F.col(c).cast("timestamp")), F.lit(1000).cast("long"))


def one_of(c: str, mapping: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(F.col(c) == k, F.lit(v)).otherwise(out)
    return out


def as_event_log(ev: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        "event_id", millis("ts").alias("t_ms"),
        one_of("event_type", EVENT_KINDS).alias("event"),
        ((F.col("user_id") * 7 + F.col("event_id")) % 4000).alias("task_id"),
        F.col("user_id").alias("worker_id"), (k + 1).alias("unit_count"),
        F.col("value").alias("duration_ms"), (F.lit(2.0) * (k + 1)).alias("predicted_ms"),
        F.lit(1.0).alias("correction"), F.when(F.col("event_id") % 17 == 0, 1).otherwise(0).alias("speculative"),
        F.date_format("ts", "yyyy-MM-dd").alias("run"), (F.col("user_id") % 2).alias("condition"),
        k.alias("k"), F.col("ts").cast("timestamp").alias("ts"))


def event_log(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """The log, or only the given kinds: that filter reaches the file scan."""
    ev = table(spark, sf, "events")
    if kinds:
        ev = ev.where(F.col("event_type").isin(*[k for k, v in EVENT_KINDS.items() if v in kinds]))
    return as_event_log(ev)


def all_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a carved range of its customer's job, before the gaps."""
    units = F.floor("o_totalprice").cast("long") % 900 + 100
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("task_id"), units.alias("unit_count"),
        one_of("o_orderstatus", STATE_OF).alias("state"), (F.col("o_custkey") % 97).alias("holder"),
        millis("o_orderdate").alias("t_ms"))
    r = running(o, ["job_id"], ["t_ms", "task_id"],
                {"start_unit": ("sum", F.col("unit_count")), "prev": ("last", F.col("task_id"))}, inclusive=False)
    return r.withColumn("start_unit", F.col("start_unit").cast("long")) \
        .withColumn("replica_of", F.when(F.col("task_id") % 11 == 0, F.col("prev"))) \
        .withColumn("lease_expires_at_ms", F.col("t_ms") + LEASE_MS).drop("prev")


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The task table: every range of every job."""
    return all_ranges(spark, sf)


def tasks_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges with gaps, for what looks for them: some tasks are missing from the table."""
    return all_ranges(spark, sf).where(F.col("task_id") % 13 != 0)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    units = F.floor("o_totalprice").cast("long") % 900 + 100
    j = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.sum(units).alias("total_units"))
    return j.withColumn("next_unit", F.when(F.col("job_id") % 3 == 0, F.col("total_units") - 100)
                        .otherwise(F.col("total_units")))


SUB_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", *SUB_ORDER)
    n = number_rows(li, ["l_orderkey"], SUB_ORDER, "seq")
    return n.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("worker_id"),
        F.concat("l_linestatus", "l_returnflag").alias("answer"), "seq", F.col("l_quantity").alias("value"))


def timed_submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions with their arrival time and a number that breaks ties over all tasks; an order has fewer than 64 lines."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", *SUB_ORDER)
    n = number_rows(li, ["l_orderkey"], SUB_ORDER, "seq")
    return n.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("worker_id"),
        F.concat("l_linestatus", "l_returnflag").alias("answer"), "seq", millis("l_shipdate").alias("t_ms"),
        (F.col("l_orderkey") * 64 + F.col("seq")).alias("sub_id"))


def partials(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", *SUB_ORDER)
    n = number_rows(li, ["l_orderkey"], SUB_ORDER, "arrival")
    return n.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("long").alias("sequence"),
                    F.col("l_quantity").cast("long").alias("units_done"), F.col("l_suppkey").alias("worker_id"),
                    "arrival")


def search_spec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("search_id"), (F.col("o_orderkey") * 100).alias("start_lo"),
        F.lit(100).cast("long").alias("unit_count"), F.lit(0).cast("long").alias("base_hi"),
        F.col("o_custkey").alias("seed"), F.lit(0x14).cast("long").alias("target"),
        F.lit(0x1F).cast("long").alias("mask"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings numbered within their label; odd and next even form a pair."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    n = number_rows(e, ["label"], ["vec_id"], "r")
    return n.select(F.col("label").cast("long").alias("label"), F.floor((F.col("r") + 1) / 2).alias("pair"),
                    (F.col("r") % 2).alias("odd"), "vec_id", "embedding")


def vector_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf).select("label", "pair", "odd", F.col("embedding").alias("value"))
    return v.where("odd = 1").drop("odd"), v.where("odd = 0").drop("odd")


def pixel_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    px = pixels(vectors(spark, sf), "label", "pair", "odd")
    return px.where("odd = 1").drop("odd"), px.where("odd = 0").drop("odd")


def pixels(vecs: DataFrame, *keep: str) -> DataFrame:
    """Groups of four elements: r, g, b and |fourth| + 1 as the sample count."""
    at = F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1)

    def quad(i):
        def val(k):
            return F.element_at("embedding", i * 4 + (k + 1)).cast("double")
        return F.struct(i.cast("long").alias("pixel"), val(0).alias("r"), val(1).alias("g"), val(2).alias("b"),
                        (F.abs(val(3)) + 1.0).alias("samples"))
    return vecs.select(*keep, F.inline(F.transform(at, quad)))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Two uploads per 4x4 tile, the later replacing; label 9 lacks its last pixel."""
    e = table(spark, sf, "embeddings")
    px = pixels(e, "vec_id", "label")
    return px.where(~((F.col("label") == 9) & (F.col("pixel") == 15))).select(
        F.floor(F.col("vec_id") / 2).alias("tile"), F.col("vec_id").alias("upload"), "pixel", "r", "g", "b", "samples")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return as_verdicts(event_log(spark, sf))


def as_verdicts(ev: DataFrame, *keep: str) -> DataFrame:
    """Judged results per worker: severities in quarters, so sums are exact."""
    k = F.col("k") % 4
    sev = F.when(k == 0, 0.25).when(k == 1, 0.5).when(k == 2, 1.0).otherwise(4.0)
    return ev.select("worker_id", "t_ms", F.col("event_id").alias("verdict_id"),
                     F.col("event").isin("grant", "accept", "worker_join").alias("accepted"),
                     sev.alias("severity"), (F.col("speculative") == 1).alias("spot"), *keep)


def range_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") * 1000).alias("start_unit"),
                    (F.floor("o_totalprice").cast("long") % 50).alias("unit_count"),
                    F.col("o_orderkey").alias("arrival"), (F.col("o_orderkey") % 3 + 1).alias("agreeing"),
                    F.col("o_orderkey").alias("checksum"))


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Input fetches and peer attempts of each event."""
    ev = event_log(spark, sf)
    src = F.col("k") % 4
    return ev.select(
        "event_id", "worker_id", "condition",
        F.when(src == 0, "none").when(src == 1, "cached").when(src == 2, "peer").otherwise("origin").alias("source"),
        (src != 0).alias("has_input"), (F.col("event") == "expire").alias("requeued"), (src == 1).alias("cached_hit"),
        (F.col("k") % 8).alias("mask"), (F.col("k") % 3).alias("attempts"),
        (F.col("event") == "accept").alias("connected"),
        ((F.col("k") % 8).bitwiseAND(F.lit(4)) != 0).alias("relay"))


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).select("worker_id", F.col("k").alias("asset")).dropDuplicates()


def truth(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return lab.select(F.col("source").alias("arm"), (F.col("toxic") == 1).alias("wrong"),
                      (F.col("quality") == 1).alias("accepted"), "doc_id")


def hourly_workers(spark: SparkSession, sf: str) -> DataFrame:
    """(timestamp_ms of the hour, worker) with counts, one row each."""
    ev = event_log(spark, sf)
    hour = F.floor(F.col("t_ms") / 3_600_000) * 3_600_000
    return ev.groupBy(hour.alias("timestamp_ms"), "worker_id").agg(
        F.count_if(F.col("event") == "accept").alias("tasks_completed"),
        F.max("k").alias("ice_gathered"), F.bit_or("k").alias("flags"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Nested hourly snapshots; a snapshot holds each worker of its hour once."""
    h = hourly_workers(spark, sf)
    m = F.struct(
        "worker_id", "tasks_completed", "ice_gathered",
        *[(F.col("flags").bitwiseAND(F.lit(b)) != 0).alias(n)
          for n, b in (("ice_host", 1), ("ice_srflx", 2), ("ice_relay", 4))])
    ev = event_log(spark, sf)
    hour = F.floor(F.col("t_ms") / 3_600_000) * 3_600_000
    names = ["grant", "accept", "expire", "cancel", "worker_join"]
    counts = ev.groupBy(hour.alias("timestamp_ms")).agg(*[F.count_if(F.col("event") == n).alias(n) for n in names])
    return (h.groupBy("timestamp_ms").agg(F.collect_list(m).alias("fleet"))
            .join(counts, "timestamp_ms")
            .select("timestamp_ms", "fleet", F.array(*[F.lit(n) for n in names]).alias("state_names"),
                    F.array(*names).alias("tasks_by_state")))


def join_times(spark: SparkSession, sf: str) -> DataFrame:
    """Per (day, worker): ms from the first event to the first grant and accept."""
    ev = event_log(spark, sf)
    g = ev.groupBy("run", "worker_id").agg(
        F.min("t_ms").alias("joined_ms"),
        F.coalesce(F.min(F.when(F.col("event") == "grant", F.col("t_ms"))), F.lit(0)).alias("first_grant_ms"),
        F.coalesce(F.min(F.when(F.col("event") == "accept", F.col("t_ms"))), F.lit(0)).alias("first_result_ms"),
        F.sum(F.when(F.col("event") == "accept", F.col("unit_count")).otherwise(0)).alias("units_completed"),
        F.sum(F.when(F.col("event") == "accept", F.col("predicted_ms")).otherwise(0)).alias("observed_ms_total"),
        F.max("unit_count").alias("unit_count"))

    def since(c):
        return F.when(F.col(c) != 0, F.col(c) - F.col("joined_ms")).otherwise(F.lit(-1))
    return g.withColumn("ready_ms", since("first_result_ms")).withColumn("grant_ms", since("first_grant_ms")) \
        .withColumn("condition", F.col("worker_id") % 2)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as received payload declarations."""
    d = table(spark, sf, "documents")
    n = F.octet_length("text").cast("long")
    return d.select(
        "doc_id", n.alias("params_bytes"), (n * 300).alias("output_bytes"), (n * 8).alias("envelope_bytes"),
        F.lit(1).alias("in_flight"), (F.col("source") != "src1").alias("lease_held"),
        (F.col("lang") == "de").alias("worker_is_prior"), (F.col("n_chars") % 1000).alias("upload_interval_ms"),
        F.sha2(F.col("text").cast("binary"), 256).alias("checksum"),
        F.sha2(F.trim("text").cast("binary"), 256).alias("computed_checksum"),
        F.col("n_chars").alias("declared_bytes"), n.alias("actual_bytes"),
        F.ceil(n / 16384).cast("long").alias("chunk_total"), F.ceil(F.col("n_chars") / 16384).cast("long").alias("expected_chunks"),
        (F.ceil(n / 16384) - 1).cast("long").alias("chunk_index"), (n % 20000).alias("chunk_bytes"))
