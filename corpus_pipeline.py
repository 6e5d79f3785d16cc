"""From raw documents to packed training sequences.

Stages, in order: language identification, quality classification, near-
duplicate removal, substring removal, packing. Each stage takes the documents
that the one before it kept and returns documents, the last one pieces of
sequences. ``run`` writes every stage's result to the shared folder and reads
it again, so a lost executor costs one stage at most.

An empty table passes through all stages as an empty table. Columns beyond
those of ``documents`` are carried to the packing stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import language, minhash, packing, quality, sampling, substring
from sheaf.llm.queries import labelled_quality, prepared
from sheaf.session import collect_garbage, written

# A document is rejected if it is less likely than this to be in the language
# found, against texts in no learned language, however many are learned. Short
# clean texts tell little either way and stay. ...
KNOWN_SCORE = 0.1
# ... or if its quality score is below this.
QUALITY_SCORE = 0.7


def begun(spark: SparkSession) -> SparkSession:
    """``prepared``, without what earlier stages left on the driver."""
    collect_garbage(spark)
    return prepared(spark)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known.

    Rejected: null texts, texts without letters, and texts whose probability of
    being in their likeliest language is below ``KNOWN_SCORE``. The classifier
    learns from the documents' own ``lang``, outside the held-out fold.
    """
    begun(spark)
    part = sampling.remainder(F.col("doc_id"), 5)
    training = docs.filter(part != 0).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    found = language.predict(docs, language.fit(training))
    sure = (F.col("lang_pred") != language.UNKNOWN) & (F.col("known") >= KNOWN_SCORE)
    return found.filter(sure).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score is ``QUALITY_SCORE`` or more.

    The classifier learns from ``labels`` outside the held-out fold; without a
    label among the documents nothing can be told, and all are kept.
    """
    begun(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    training = labelled_quality(docs.select("doc_id", "text"), labels)
    model = quality.fit(training, per_label=None)
    if not model.trained:
        return docs
    return quality.score(docs, model).filter(F.col("score") >= QUALITY_SCORE).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest id.

    Groups are told apart by row, so of two texts under one id each is judged by
    itself; repeated rows are one document. Documents without words stay, and so
    do those without an id.
    """
    begun(spark)
    return minhash.one_of_each(docs.filter("doc_id is not null")).unionByName(docs.filter("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out the words of every passage that occurs more than once; no document goes.

    A document of which nothing is left stays with an empty text. ``n_chars``
    counts the new text.
    """
    begun(spark)
    found = substring.remove_repeats(docs)
    new = {"text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return found.select(*(new.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 ids, mixed by source: one row per piece, with its ids."""
    begun(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

# Classifiers, hashing and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the packed sequences."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
