"""From raw documents to packed sequences: five stages, each a job over all that the one before it kept.

All stages read whole texts of any length and keep the columns of ``documents``, extra ones too, whatever their names; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudweft.llm import decontamination, host_rules, langid, near, packing
from cloudweft.llm._common import lean, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language leads, with that language in ``lang``; undetermined texts and even mixtures go.

    Null, empty and letterless texts are undetermined. Each row is judged alone, so ids may be null or repeat.
    """
    lean(spark)
    return langid.identified(docs, langid.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules on hosts that pass theirs.

    Null and empty texts fail; a document without a host needs to pass the base rules only. Each row is judged, so ids may be null or repeat.
    """
    return host_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 and more.

    The smallest id stays; rows that repeat id and text leave one; rows without an id stay.
    """
    lean(spark)
    return near.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null texts hold none; rows that repeat stay or go together."""
    lean(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' token ids. A null or empty text is its end id alone; a long one is cut into pieces."""
    import public_tokenizers

    lean(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.sequences(packing.place(packing.token_pieces(docs, path)))


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packed),
]

#: The language model and the alignments can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
