"""The corpus pipeline: one written and reread table after each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import curriculum, decontaminate, jaccard, quality, tokens
from fleetlens.llm.common import fresh_path, saved, small, table
from fleetlens.llm.queries import tokenizer_path
from fleetlens.session import tune

#: Metadata key of ``doc_id``: where the mix's training positions lie.
PLAN = "fleetlens.plan"

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Equal texts share a fate, repeated rows all stay or go; null and empty texts get the odds of the labels. Columns are
    kept whatever their names; an empty table stays empty.
    """
    score = quality.scorer(quality.train(docs, table(spark, sf_dir, "labels")), spark)
    return docs.where(score(F.col("text")) >= quality.THRESHOLD)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the least id, rows without an id last. Documents without words all stay.

    Rows go by the hash of id and text, so repeated rows, null ids and an id on several texts are told apart. Of rows
    that repeat id and text one stays, the same however rows arrive. Columns are kept whatever their names; an empty table
    stays empty.
    """
    key = F.xxhash64("doc_id", "text")
    found = jaccard.join_texts(docs.select(key.alias("_key"), "text"), "_key")
    facts = docs.select(key.alias("_key"), "doc_id").groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    named = saved(found.where("n_shingles > 0").select(F.col("id").alias("_key"), "component_id").distinct().join(facts, "_key"), "alike")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "_key")).alias("first"))
    chosen = saved(first.select("first._key"), "chosen")
    gone = saved(named.join(chosen, "_key", "left_anti").select(F.col("_key").alias("_gone")), "gone")
    kept = docs.join(small(gone).alias("gone"), key == F.col("gone._gone"), "left_anti")
    repeated = saved(named.where("copies > 1").join(chosen, "_key", "left_semi").select(F.col("_key").alias("_repeated")), "repeated")
    if not repeated.limit(1).count():
        return kept
    again = key == F.col("repeated._repeated")
    one = (kept.join(small(repeated).alias("repeated"), again, "left_semi").groupBy(key.alias("_key"))
           .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*"))
    return kept.join(small(repeated).alias("repeated"), again, "left_anti").unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    A row is judged by its text: repeated rows go together, and of an id on several texts only the contaminated ones. Null
    and wordless texts stay, as does a row without an id if its text is clean. Columns are kept whatever their names; an
    empty table stays empty, and without benchmark items nothing goes.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = saved(found.where("contaminated").select(F.col("id").alias("_gone"), "text_key").distinct(), "gone")
    same = F.col("docs.doc_id").eqNullSafe(F.col("gone._gone")) & (F.xxhash64("docs.text") == F.col("gone.text_key"))
    return docs.alias("docs").join(small(gone).alias("gone"), same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; documents are repeated or left out to meet the sources' targets.

    Tables are written and read again in no certain order, so the positions lie in a table of their own, whose path is
    in the metadata of ``doc_id``. Repeated rows are placed one by one; null and empty texts have size 0, null sources are
    a source of their own. Columns are kept whatever their names; an empty table stays empty.
    """
    path = fresh_path(spark, "plan")
    curriculum.assign(docs).select("id", "source", "text_key", "positions").write.parquet(path)
    metadata = docs.schema["doc_id"].metadata | {PLAN: path}
    mixed = curriculum.mix(docs, plan=spark.read.parquet(path), in_order=False)
    return mixed.select(*[F.col("doc_id").alias(c, metadata=metadata) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, read back: a row per document. Documents of no mix are in id order.

    Texts are encoded where they lie, so only packed ids are shuffled, to their positions and into ranges of them. A null
    text is an empty one, repeated rows are a document each, other columns are left out; an empty table gives no rows.
    """
    plan = docs.schema["doc_id"].metadata.get(PLAN)
    if plan is None:
        path = tokens.write_tokens(docs, tokenizer_path())
    else:
        encoded = tokens.encode_texts(docs, tokenizer_path())
        path = tokens.write_encoded(curriculum.placed(encoded, spark.read.parquet(plan)), "_position")
    return tokens.read_tokens(spark, path, with_ids=False).drop("ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_alike),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", to_tokens),
]
#: Model training and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each works on all that the one before kept."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
