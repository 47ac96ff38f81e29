"""Language identification by Bayesian evidence fusion.

The posterior of a page's language is the product of

* the text's likelihood under byte trigram models, one per language, tempered as neighbouring trigrams are not
  independent;
* how often pages of a language declare what this one declares (a confusion table counted over all pages);
* how often pages of a language have this address suffix (likewise);
* the prior of its host, smoothed towards its domain's, and that towards the whole table's.

The counts are grouped sums of the text posteriors of all rows, so they grow with the table and need no labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import subwords
from fleetlens.llm.common import saved
from fleetlens.llm.urls import host_of

#: Most documents that the trigram models are fitted on, those with the least hash of their id. All rows are judged.
TRAIN_ROWS = 8000
#: Trigrams that a text's likelihood may weigh, table rows, and the smoothing of trigram counts.
WEIGHT, BITS, ADD = 30.0, 16, 0.5
#: Pseudo-counts of the level above for a domain and a host, and of each value in the confusion tables.
SMOOTH, CONFUSE = 5.0, 1.0
TAGS = r"(?is)<(script|style)\b.*?</(script|style)\s*>|<[^>]*>"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    owner, h = subwords.char_grams(pc.utf8_lower(texts), (3,))
    return owner, (h >> np.uint64(64 - BITS)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for first, texts in subwords.parts(batch.column(0)):
            owner, slots = grams(texts)
            of = langs[first:first + len(texts)]
            for lang in set(of):
                total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                total[lang] += np.bincount(slots[(of == lang)[owner]], minlength=1 << BITS)
    langs = list(total)
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([total[x].tobytes() for x in langs], pa.binary())], ["lang", "counts"])


def _model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[lang] = total.get(lang, 0) + np.frombuffer(data, np.int64)
    langs = sorted(total)
    logs = [np.log((total[x] + ADD) / (total[x] + ADD).sum()).astype(np.float32).tobytes() for x in langs]
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(logs, pa.binary())], ["lang", "logs"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of every trigram row by language) from at most ``TRAIN_ROWS`` labelled documents.

    Rows with a null id, text or language are not learned from.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = saved(known.groupBy(F.col(id_col).alias("_key")).agg(F.min(lang_col).alias("_lang")).orderBy(F.xxhash64("_key"), "_key")
                .limit(TRAIN_ROWS), "labels")
    rows = (known.join(F.broadcast(ids), F.col(id_col) == F.col("_key")).select(F.col(text_col).alias("text"), "_lang")
            .mapInArrow(_count, "lang string, counts binary").repartition(1).mapInArrow(_model, "lang string, logs binary").collect())
    return [r["lang"] for r in rows], np.stack([np.frombuffer(r["logs"], np.float32) for r in rows]) if rows else np.zeros((0, 1 << BITS), np.float32)


def _normal(logs: Column) -> Column:
    """Log weights to probabilities."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def declared_language(html: Column) -> Column:
    """The primary subtag of the page's declared language, or an empty string."""
    return F.coalesce(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,8})", 1)), F.lit(""))


def _soft_counts(rows: DataFrame, keys: list[str], langs: list[str], name: str) -> DataFrame:
    """Sums of the text posteriors by key, combined before they are shuffled."""
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col("near")[i]).alias(f"_{i}") for i in range(len(langs))])
    return sums.select(*keys, F.array(*[F.col(f"_{i}") for i in range(len(langs))]).alias(name))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text: Column, declared: Column, host: Column, keep: list[Column]) -> DataFrame:
    """(keep..., lang, probability, text_lang): one row per row of ``rows``.

    Null texts, hosts and declarations are empty ones: a text without trigrams says nothing, and hosts and declarations
    that are empty are counted like any other value. ``lang`` is null if no language was learned. Ties go to the
    language first in code point order. Repeated rows count and are judged each.
    """
    langs, logs = model
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    n = len(langs)

    @F.arrow_udf("array<float>")
    def likelihood(texts: pa.Array) -> pa.Array:
        table = shared.value
        out = np.zeros((len(texts), n), np.float32)
        for first, part in subwords.parts(texts):
            owner, slots = grams(part)
            count = np.bincount(owner, minlength=len(part))
            scale = np.minimum(count, WEIGHT) / np.maximum(count, 1)
            for i in range(n):
                out[first:first + len(part), i] = np.bincount(owner, table[i][slots], len(part)) * scale
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n, pa.int32()), pa.array(out.reshape(-1)))
    if not n:
        return rows.select(*keep, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                           F.lit(None).cast("string").alias("text_lang"))
    names = [f"_keep{i}" for i in range(len(keep))]
    facts = rows.select(*[c.alias(k) for c, k in zip(keep, names, strict=True)], text.alias("text"), F.coalesce(declared, F.lit("")).alias("declared"),
                        F.coalesce(host, F.lit("")).alias("host"))
    facts = facts.withColumn("likely", likelihood(F.col("text")).cast("array<double>")).drop("text")
    facts = saved(facts.withColumn("near", _normal(F.col("likely")))
                  .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "facts")

    langs_total = F.array(*[F.sum(F.col("near")[i]) for i in range(n)])
    everything = facts.groupBy().agg(langs_total.alias("total"), F.count("*").alias("rows"))
    tables = {"host": ["host", "domain"], "declared": ["declared"], "suffix": ["suffix"], "domain": ["domain"]}
    counts = {k: saved(_soft_counts(facts, cols, langs, f"{k}_n"), f"counts-{k}") for k, cols in tables.items()}
    mass = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    smooth = lambda xs, above: F.zip_with(xs, above, lambda x, p: (x + SMOOTH * p) / (mass(xs) + SMOOTH))
    domains = counts["domain"].join(F.broadcast(everything)).select(  # one row
        "domain", smooth(F.col("domain_n"), F.transform("total", lambda x: (x + 1) / (F.col("rows") + n))).alias("domain_p"))
    hosts = counts["host"].join(domains, "domain").select("host", smooth(F.col("host_n"), F.col("domain_p")).alias("prior"))

    def confusion(name: str) -> DataFrame:
        return (counts[name].join(F.broadcast(everything))
                .select(name, F.zip_with(f"{name}_n", "total", lambda x, t: F.log((x + CONFUSE) / (t + CONFUSE * (n + 1)))).alias(f"{name}_log")))
    joined = facts.join(hosts, "host").join(confusion("declared"), "declared").join(confusion("suffix"), "suffix")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs_of = add(add(add(F.col("likely"), F.transform("prior", lambda p: F.log(p))), F.col("declared_log")), F.col("suffix_log"))
    judged = joined.withColumn("posterior", _normal(logs_of))
    name = lambda xs: F.element_at(F.lit(langs), F.array_position(xs, F.array_max(xs)).cast("int"))
    return judged.select(*[F.col(k) for k in names], name(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"),
                         name(F.col("near")).alias("text_lang"))


def page_languages(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """(id, lang, probability, text_lang) of every page, from its visible text, markup and address."""
    html = F.col(html_col)
    text = F.regexp_replace(html, TAGS, " ")
    found = identify(pages, model, text, declared_language(html), host_of(F.col(url_col)), [F.col(id_col)])
    return found.withColumnRenamed("_keep0", "id")


def document_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text",
                       source_col: str = "source") -> DataFrame:
    """(id, lang, probability, text_lang) of every document; its source takes the host's part, and nothing is declared."""
    found = identify(docs, model, F.col(text_col), F.lit(""), F.col(source_col), [F.col(id_col)])
    return found.withColumnRenamed("_keep0", "id")
