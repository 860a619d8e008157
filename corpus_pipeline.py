"""A corpus from raw documents to packed sequences: toxic documents go, near-duplicates go, sources are mixed, packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each as Parquet below the shared folder
and reads it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import mixing, toxicity
from scanloom.llm.jaccard import jaccard_components
from scanloom.llm.packing import pack_documents
from scanloom.llm.queries import MIX, domain_labels
from scanloom.llm.shared import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of labels.toxic does not predict to be toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each component of five-word shingle sets of similarity 0.75 or more.

    Documents without words and rows with a null id stay. Of rows that repeat an id one stays.
    """
    found = jaccard_components(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the rate that brings the domains' expected tokens to the weights of MIX.

    The total is set so that no domain of good quality has to be cut: those are repeated where they lack tokens,
    and only low-quality domains are thinned out.
    """
    classifier = mixing.fit_classifier(docs, domain_labels(docs, _labels(spark, sf_dir)))
    if not classifier.domains:  # nothing is labelled, so nothing is known to mix
        return docs
    # Whole rows are written with what they hold of each domain, so that no text is looked at twice.
    rows = written(mixing.weighed(docs, classifier), "weighed")
    now = mixing.totals_of(rows, classifier)
    weight = sum(MIX.get(d, 0.0) for d in now)
    total = max((v * weight / MIX[d] for d, v in now.items() if d.endswith(":1") and MIX.get(d)), default=sum(now.values()))
    rates = mixing.fit_rates(rows, mixing.targets_of(rows, classifier, MIX, total))
    return mixing.repeated(rows, rates)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_copies), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express the tokenizer's ids nor the fits; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
