"""Labelled texts from and to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_body(text: Column) -> Column:
    """A file's text without ideographic spaces and its first three lines, the rest joined without separator."""
    lines = F.split(F.translate(text, "　", ""), "\n")
    return F.concat_ws("", F.slice(lines, 4, F.greatest(F.size(lines) - 3, F.lit(0))))


#: Ends a document in a file of many. Texts that hold it, or the sign that stands for it, are written with that sign and a letter.
END, SIGN = "\x1e", "\x1b"


def write_class_corpus(df: DataFrame, path: str) -> None:
    """(class, body) in a folder per class, many documents a file, each ended by ``END``: a file a document costs more to open, to list and to commit than its text."""
    body = F.replace(F.replace("body", F.lit(SIGN), F.lit(SIGN + "e")), F.lit(END), F.lit(SIGN + "r"))
    df.select("class", body.alias("body")).write.partitionBy("class").option("lineSep", END).text(path)


def read_class_corpus(spark: SparkSession, path: str | Sequence[str], together: bool = False) -> DataFrame:
    """(class, body, path): one document a file, its class the folder it is in; ``together`` for files of ``write_class_corpus``, which are read in splits."""
    how = {"lineSep": END} if together else {"wholetext": True}
    text = F.replace(F.replace("value", F.lit(SIGN + "r"), F.lit(END)), F.lit(SIGN + "e"), F.lit(SIGN)) if together else F.col("value")
    files = spark.read.text(path, **how).select(F.col("_metadata.file_path").alias("path"), text.alias("value"))
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("class"), corpus_body(F.col("value")).alias("body"), "path")


def read_labelled_csv(spark: SparkSession, path: str | Sequence[str], schema: str = "label string, Description1 string, Description2 string") -> DataFrame:
    """Headed CSV of labelled texts; quoted texts may hold line breaks, commas and doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def write_labelled_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
