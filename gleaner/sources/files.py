"""Files in, tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "docx", "md", "txt")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(name, path, length, modificationTime, content) of the files in a folder, not below it. Content is only read where it is used. Spark leaves out files without a byte: they count as not there."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder).withColumn("name", base_name(F.col("path")))


def read_texts(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(source, text): each file as one string, under the name that ``list_files`` gives it (paths of the text reader are percent-encoded)."""
    return list_files(spark, folder, suffixes).select(F.col("name").alias("source"), F.col("content").cast("string").alias("text"))


def write_files(rows: DataFrame, folder: str, name: str = "name", text: str = "text") -> int:
    """Writes each row's text as a file of its name into a folder that all executors share, whole or not at all; returns the number of files. Names may hold any character but a slash."""
    from pyarrow import fs

    def write(batches):
        import pandas as pd

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for file, content in zip(batch["name"], batch["text"], strict=True):
                # Under another name first: a task that dies leaves no half file, and one that runs twice writes the same.
                draft = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write((content or "").encode())
                store.move(draft, f"{base}/{file}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    own = rows.select(F.col(name).alias("name"), F.col(text).alias("text"))
    return own.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def file_hashes(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    return files.select(F.col(name).alias("name"), F.md5(F.col(content).cast("binary")).alias("md5"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, question, keywords) from one JSON object with an array of questions."""
    root = spark.read.schema("questions array<struct<id:string,category:string,question:string,expected_keywords:array<string>>>").json(path, multiLine=True)
    return root.select(F.explode("questions").alias("q")).select("q.id", "q.category", "q.question", F.coalesce("q.expected_keywords", F.array().cast("array<string>")).alias("keywords"))


def quarantine(rows: DataFrame, text_col: str = "text", error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with an error or blank text are set apart; the others go on."""
    from gleaner.functions.text import is_blank

    reason = F.when(F.col(error_col).isNotNull(), F.col(error_col)).when(is_blank(F.col(text_col)), "blank")
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")
