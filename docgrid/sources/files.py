
from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Encodings that the sources use.
CP1252, LATIN1, UTF8 = "windows-1252", "ISO-8859-1", "UTF-8"


def allow(spark: SparkSession, encoding: str) -> str:
    """Spark takes charsets beyond its short list only where the session allows those of the JVM."""
    if encoding.lower() not in ("utf-8", "iso-8859-1", "us-ascii"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return encoding


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """[S1-S5] A query of a database, its filters pushed down; needs the driver's jar. Give partitionColumn and bounds for a parallel scan."""
    reader = spark.read.format("jdbc").option("url", url)
    reader = reader.option("dbtable", f"({query}) q") if "partitionColumn" in options else reader.option("query", query)
    return reader.options(**options).load()


def first_by_prefix(catalogue: DataFrame, column: str, prefix: str, order: str) -> DataFrame:
    """[S3] The first record whose name begins so; one row is what it is for."""
    return catalogue.where(F.col(column).startswith(prefix)).orderBy(order).limit(1)


def csv_table(spark: SparkSession, path: str, encoding: str = UTF8, sep: str = ",", strings: bool = True) -> DataFrame:
    """[S6, S8-S10] With a header; a byte-order mark in front of it goes. ``strings``: every cell as text, blank ones as ''."""
    reader = spark.read.option("header", True).option("encoding", allow(spark, encoding)).option("sep", sep).option("multiLine", True).option("escape", '"')
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.na.fill("") if strings else df


def without_index(df: DataFrame) -> DataFrame:
    """[S11] Without the nameless first column that an index leaves."""
    first = df.columns[0]
    return df.drop(first) if first in ("_c0", "", "Unnamed: 0") else df


def csv_grids(spark: SparkSession, paths: str | Sequence[str], encoding: str = CP1252) -> DataFrame:
    """[S7] (path, grid): each headerless file as one grid, rows in the file's order.

    A file is read whole, in Arrow batches, and parsed as CSV: quoted cells may
    hold line breaks, rows may have any number of cells, blank lines are no
    rows. A captured table is small.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = content.decode(encoding, "replace").lstrip("\ufeff")
                grid = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([grid], pa.list_(pa.list_(pa.string())))], names=["path", "grid"])

    return files.mapInArrow(run, "path string, grid array<array<string>>")


def json_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """[S13] (label, label_ord, phrase, phrase_ord) of a JSON object of lists, both in the file's order; labels without phrases have a null phrase."""
    whole = spark.read.text(path, wholetext=True)
    keys = F.json_object_keys("value")
    lists = F.from_json("value", F.lit("map<string,array<string>>"))
    out = whole.select(F.posexplode(keys).alias("label_ord", "label"), lists.alias("m"))
    return out.select("label", "label_ord", F.posexplode_outer(F.col("m")[F.col("label")]).alias("phrase_ord", "phrase")).select("label", "label_ord", "phrase", "phrase_ord")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """[S15] (path, text), a row for each file."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_ids(spark: SparkSession, pattern: str) -> DataFrame:
    """[S16] (id): the stems of the files that match; contents aren't read."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id")).distinct()


def pages_of_html(df: DataFrame, text: str = "html") -> DataFrame:
    """[S14] One row for each div of class page, with its place."""
    parts = F.split(F.col(text), r'(?i)<div[^>]*class="page"[^>]*>')
    return df.select("*", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("page", "page_html"))


def list_literal(column: str):
    """[S24] "['a', 'b']" as an array."""
    return F.from_json(F.translate(F.col(column), "'", '"'), "array<string>")


def excel(spark: SparkSession, path: str) -> DataFrame:
    """[S12] Through pandas, where an Excel reader is installed."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise NotImplementedError("reading Excel needs openpyxl") from e
    frame = pd.read_excel(path, dtype=str, keep_default_na=False)
    return spark.createDataFrame(frame, StructType([StructField(str(c), StringType()) for c in frame.columns]))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, header: bool = True, sep: str = ",", encoding: str = UTF8, one_file: bool = False) -> None:
    """[K15, K16] ``one_file`` is for reports that a person opens."""
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", header).option("sep", sep).option("encoding", encoding).csv(path)


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """[K17] A folder for each key."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """[K18]"""
    df.write.mode("overwrite").json(path)


def _needs(what: str):
    def stub(*_args, **_options):
        raise NotImplementedError(f"{what} isn't available offline; give its results as a table (file_id, status, message, payload)")

    return stub


#: [S17-S22, K19] Work on PDFs, pictures and the network needs libraries that aren't here.
pdf_tables = _needs("extracting tables from PDFs")
pdf_text = _needs("reading PDFs")
pdf_outline = _needs("reading PDF outlines")
ocr = _needs("character recognition")
page_image = _needs("rendering pages")
download = _needs("downloading documents")
