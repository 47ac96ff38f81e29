"""Content-addressed blobs. The address is SHA-256: Spark has no BLAKE3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 16 * 1024
MAX_ASSET_BYTES = 256 * 1024 * 1024


def content_put(df: DataFrame, bytes_col: str, id_col: str) -> DataFrame:
    """One row per distinct content: address, size, copies and the id of the
    copy kept. Contents stay out of the aggregation: only the address and
    numbers are shuffled, and equal contents combine on the map side."""
    raw = F.col(bytes_col).cast("binary")
    return (df.select(F.sha2(raw, 256).alias("address"), F.octet_length(raw).cast("long").alias("bytes"),
                      F.col(id_col).alias("id"))
            .groupBy("address")
            .agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("stored_id")))


def stored_blobs(df: DataFrame, bytes_col: str) -> DataFrame:
    """(address, content) with every distinct content once. Equal contents
    combine on the map side, so a copied blob is shuffled once per task."""
    return (df.withColumn("address", F.sha2(F.col(bytes_col).cast("binary"), 256))
            .groupBy("address").agg(F.first(bytes_col).alias(bytes_col)))


def split_chunks(df: DataFrame, content: str, key: str = "address", size: int = CHUNK_BYTES) -> DataFrame:
    """(key, index, total, part): pieces of ``size`` bytes (characters when the
    column is a string); an empty blob has no piece."""
    n = F.length(F.col(content)).cast("long")
    total = F.ceil(n / F.lit(size)).cast("long")
    piece = F.transform(
        F.sequence(F.lit(0).cast("long"), total - 1),
        lambda i: F.struct(i.alias("index"), total.alias("total"), F.substring(
            F.col(content), (i * size + 1).cast("int"), F.lit(size)).alias("part")))
    # Pieces and total come out of one generator, so the blob itself is not
    # carried along on every generated row.
    return df.where(n > 0).select(key, F.inline(piece))


def reassemble(chunks: DataFrame, manifest: DataFrame, size: int = CHUNK_BYTES,
               max_bytes: int = MAX_ASSET_BYTES) -> DataFrame:
    """Blobs rebuilt from received pieces and checked against their address.

    ``manifest`` (address, expected) holds the trusted length; ``chunks``
    (address, seq, index, total, part) what peers sent, ``seq`` the arrival
    order. Result: address, status and, when verified, the content. A fetch is
    refused for the first bad piece that arrives before it is complete. A
    manifest entry is at most ``max_bytes`` long, which bounds what one group
    collects; repeated pieces are reduced to the first before that.
    """
    m = manifest.select("address", F.col("expected").cast("long"))
    want_total = F.ceil(F.col("expected") / F.lit(size)).cast("long")
    sized = (m.withColumn("want_total", want_total)
             .withColumn("refused", (F.col("expected") <= 0) | (F.col("expected") > max_bytes)))
    fit = sized.where(~F.col("refused"))
    length = F.length("part").cast("long")
    last = F.col("index") + 1 == F.col("want_total")
    want_len = F.when(last, F.col("expected") - (F.col("want_total") - 1) * size).otherwise(F.lit(size))
    # Reasons in the order the checks run.
    reason = (F.when(F.col("total") != F.col("want_total"), "total disagrees")
              .when((F.col("index") < 0) | (F.col("index") >= F.col("total")), "index out of range")
              .when(length > size, "piece too large")
              .when((length < size) & ~last, "short piece before the end")
              .when(length != want_len, "length disagrees with position"))
    judged = chunks.join(fit.select("address", "expected", "want_total"), "address").withColumn("reason", reason)
    # First good copy and first fault per position, then per blob. The first step
    # combines on the map side, so repeated pieces stay out of the shuffle.
    good = F.col("reason").isNull()
    per = judged.groupBy("address", "index").agg(
        F.min_by(F.struct("seq", "part"), F.when(good, F.col("seq"))).alias("p"),
        F.min(F.when(~good, F.struct("seq", "reason"))).alias("fault"))
    built = per.groupBy("address").agg(
        F.count("p").alias("have"), F.max("p.seq").alias("done_seq"), F.min("fault").alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("index", F.col("p.part").alias("part")))))
        .alias("parts"))
    # Pieces of a binary column are joined as hex text; strings join directly.
    is_binary = chunks.schema["part"].dataType.typeName() == "binary"
    texts = F.transform("parts", lambda p: F.hex(p["part"]) if is_binary else p["part"])
    joined = F.array_join(texts, "")
    content = F.unhex(joined) if is_binary else joined
    j = sized.join(built, "address", "left")
    j = j.withColumn("complete", F.coalesce(F.col("have") == F.col("want_total"), F.lit(False)))
    j = j.withColumn("content", F.when(F.col("complete"), content))
    early = F.col("b").isNotNull() & (~F.col("complete") | (F.col("b.seq") < F.col("done_seq")))
    status = (F.when(F.col("refused"), "bad expected size")
              .when(early, F.col("b.reason"))
              .when(~F.col("complete"), "incomplete")
              .when(F.sha2(F.col("content").cast("binary"), 256) != F.col("address"), "digest mismatch")
              .otherwise("verified"))
    return (j.withColumn("status", status)
            .select("address", "status", F.coalesce("have", F.lit(0)).alias("have"), "want_total",
                    F.when(F.col("status") == "verified", F.col("content")).alias("content")))
