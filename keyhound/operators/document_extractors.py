"""Extractors that need a whole document: comments, registry logins, shell scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.functions.strings import after, item, no_items, trim_space
from keyhound.operators.line_extractors import shell_items
from keyhound.sources.tables import line_array, text_of

# Fixed value: one HTML comment.
HTML_COMMENT = r"(?s)<!--(.*?)-->"


def html_items(text: Column) -> Column:
    """The text of every HTML comment, on line 0.

    The document is cut after the last ``-->``, so that every ``<!--`` left has an end;
    a search for an end that is not there would run to the end of the text each time.
    """
    rest = F.substring_index(text, "-->", -1)
    closed = F.left(text, F.char_length(text) - F.char_length(rest))
    found = F.transform(F.regexp_extract_all(closed, F.lit(HTML_COMMENT), F.lit(1)), trim_space)
    return F.when(
        F.contains(text, F.lit("-->")),
        F.transform(
            F.filter(found, lambda t: t != ""), lambda t: item(F.lit("comment"), t, "html")
        ),
    ).otherwise(no_items())


def dockercfg_items(text: Column) -> Column:
    """The non-empty logins of a registry configuration; other JSON gives nothing.

    Field names are found in any letter case.  A login that is neither text nor null, or
    anything behind the object, makes the whole document give nothing.  The text is read as
    the first of two array elements: what ends the array early, or adds to it, loses the
    second one, whose name is a hash of the text.  Repeated field names all count.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    mark = F.md5(text)
    wrapped = F.concat(F.lit("["), text, F.lit(',{"'), mark, F.lit('":""}]'))
    parts = F.from_json(wrapped, "ARRAY<MAP<STRING, STRING>>", strict)
    alone = (F.size(parts) == 2) & F.map_contains_key(F.get(parts, F.lit(1)), mark)
    named = F.filter(
        F.map_entries(F.get(parts, F.lit(0))),
        lambda e: (F.lower(e["key"]) == "auths") & e["value"].isNotNull(),
    )
    hosts = F.transform(
        named, lambda e: F.from_json(e["value"], "MAP<STRING, MAP<STRING, VARIANT>>", strict)
    )
    fields = F.flatten(
        F.transform(
            F.flatten(F.transform(hosts, F.map_values)),
            lambda host: F.coalesce(F.map_entries(host), F.array().cast(_LOGIN_FIELDS)),
        )
    )
    logins = F.transform(
        F.filter(fields, lambda e: F.lower(e["key"]) == "auth"), lambda e: e["value"]
    )
    plain = F.forall(logins, lambda a: a.isNull() | F.schema_of_variant(a).isin("STRING", "VOID"))
    kept = F.filter(F.transform(logins, lambda a: a.cast("string")), lambda a: a != "")
    return F.when(
        alone & plain, F.transform(kept, lambda a: item(F.lit("Dockercfg"), a, "dockercfg"))
    ).otherwise(no_items())


_LOGIN_FIELDS = "ARRAY<STRUCT<key: STRING, value: VARIANT>>"


DOCUMENT_EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "html": html_items,
    "dockercfg": dockercfg_items,
}


def extract_documents(files: DataFrame, items: Callable[[Column], Column]) -> DataFrame:
    """Pairs of whole documents; their line is 0."""
    return files.select(
        F.col("path").alias("file_path"), F.inline(items(text_of(files)))
    ).select("file_path", "key", "value", "kv_path", F.lit(0).alias("line"))


def logical_line_pieces(text: Column) -> Column:
    """Shell lines with continuations joined, each as ``<line number>\\t<text>``.

    Every non-blank line is written as its text followed by its number on a line
    of its own.  Removing ``\\``, the number and the break between two lines joins
    them, and the number that stays is that of the last physical line.  What is
    still open at the end of the document is dropped.
    """
    numbered = F.transform(
        line_array(text), lambda line, pos: F.struct(trim_space(line).alias("t"), pos.alias("p"))
    )
    layout = F.array_join(
        F.transform(
            F.filter(numbered, lambda x: x["t"] != ""),
            lambda x: F.concat(x["t"], F.lit("\n"), (x["p"] + 1).cast("string"), F.lit("\n")),
        ),
        "",
    )
    joined = F.regexp_replace(layout, r"\\\n\d+\n(?=[^\n])", " ")
    closed = F.regexp_replace(joined, r"(?dm)^[^\n]*+(?<=\\)\n\d+\n\z", "")
    pieces = F.split(F.regexp_replace(closed, r"([^\n]*+)\n(\d+)\n", "$2\t$1\n"), "\n")
    return F.filter(pieces, lambda p: p != "")


def piece_line(piece: Column) -> Column:
    return F.substring_index(piece, "\t", 1).cast("int")


def piece_text(piece: Column) -> Column:
    return after(piece, "\t")


def shell_lines(files: DataFrame) -> DataFrame:
    """``path, line, text`` of logical shell lines."""
    return files.select(
        "path", F.explode(logical_line_pieces(text_of(files))).alias("piece")
    ).select(
        "path", piece_line(F.col("piece")).alias("line"), piece_text(F.col("piece")).alias("text")
    )


def extract_shell(files: DataFrame) -> DataFrame:
    lines = shell_lines(files)
    return lines.select(
        F.col("path").alias("file_path"), "line", F.inline(shell_items(F.col("text")))
    ).select("file_path", "key", "value", "kv_path", "line")
