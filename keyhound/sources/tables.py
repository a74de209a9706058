"""Files, lines and pairs out of ordinary tables, and lines out of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.fixed_values import FILE_NAME_KEY, FILE_NAME_KV_PATH, MIN_FILE_BYTES
from keyhound.functions.strings import base_name


def files_from_table(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """One row per document, in the shape of a file corpus (content stays a string)."""
    return df.select(
        path.alias("path"),
        F.octet_length(text).cast("bigint").alias("length"),
        text.alias("content"),
    )


def text_of(files: DataFrame) -> Column:
    """File content as text; bytes are taken as they are, without a decoding step."""
    if dict(files.dtypes)["content"] == "string":
        return F.col("content")
    return F.col("content").cast("string")


def line_array(text: Column) -> Column:
    """Lines as a line reader sees them, still with a possible final empty element."""
    return F.split(text, "\n")


def without_carriage_return(line: Column) -> Column:
    return F.when(
        F.endswith(line, F.lit("\r")), F.left(line, F.char_length(line) - 1)
    ).otherwise(line)


def large_enough(files: DataFrame) -> DataFrame:
    """Files of fewer than seven bytes are not analysed (their names still are)."""
    return files.filter(F.col("length") >= MIN_FILE_BYTES)


def to_lines(files: DataFrame) -> DataFrame:
    """``path, line, text``: 1-based lines, without line ends or an empty last line."""
    text = text_of(files)
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.char_length(text) - 1)).otherwise(
        text
    )
    return (
        files.filter(text != "")
        .select("path", F.posexplode(line_array(body)).alias("pos", "raw"))
        .select(
            "path",
            (F.col("pos") + 1).cast("int").alias("line"),
            without_carriage_return(F.col("raw")).alias("text"),
        )
    )


def filename_kv(files: DataFrame) -> DataFrame:
    """The pair (file, base name) of every file, whether or not it is parsed."""
    return files.select(
        F.col("path").alias("file_path"),
        F.lit(FILE_NAME_KEY).alias("key"),
        base_name(F.col("path")).alias("value"),
        F.lit(FILE_NAME_KV_PATH).alias("kv_path"),
        F.lit(0).alias("line"),
    )


def kv_from_table(
    df: DataFrame, file_path: Column, columns: Sequence[str], kv_path: str
) -> DataFrame:
    """Every named column as a pair (column name, value as text); nulls become empty text."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"),
                F.coalesce(F.col(name).cast("string"), F.lit("")).alias("value"),
            )
            for name in columns
        ]
    )
    return df.select(file_path.alias("file_path"), F.inline(pairs)).select(
        "file_path", "key", "value", F.lit(kv_path).alias("kv_path"), F.lit(0).alias("line")
    )
