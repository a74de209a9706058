"""Which extractor a file gets.  The first row of the routing table that fits wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.fixed_values import MIN_FILE_BYTES, TEMPLATE_SUFFIXES, XML_DECLARATION_START
from keyhound.functions.memo import remembered
from keyhound.functions.predicates import any_of
from keyhound.functions.strings import base_name, let, starts_with

# Formats whose rows are lines, whole documents, or trees.
TREE_FORMATS = ["yaml", "json", "xml"]
CONFIG_LIKE = "conf"

# The routing table, in order.  Names are case-sensitive, extensions
# are compared in lower case.  (format, names, name prefixes, extensions,
# extension prefixes, extension suffixes)
ROUTES = [
    ("yaml", [], [], [".yaml", ".yml"], [], []),
    ("json", [], [], [".json"], [], []),
    ("xml", [], [], [".xml"], [], []),
    ("npmrc", [], [".npmrc"], [], [], []),
    ("pypirc", [], [".pypirc"], [], [], []),
    ("pip", ["pip.conf", "pip.ini"], [], [], [], []),
    ("properties", [], [], [".properties"], [], []),
    ("shell", [], [], [".env"], [], ["sh"]),
    ("dockerfile", [], ["Dockerfile"], [], [], []),
    ("dockercfg", ["config.json"], [], [".dockercfg"], [], []),
    ("htpasswd", [], [".htpasswd"], [], [], []),
    ("text", [], [], [".txt"], [], []),
    ("html", [], [], [], [".htm"], []),
    ("python", [], [], [], [".py"], []),
    ("js", [], [], [".js", ".mjs"], [], []),
    ("java", [], [], [".java"], [], []),
    ("go", [], [], [".go"], [], []),
    ("php", [], [], [], [".php"], []),
    ("conf", [], [], [".conf", ".cfg", ".config", ".ini", ".credentials", ".s3cfg"], [], []),
]

# Extensions and names that extractors declare but routing never reaches.
EXTENDED_ROUTES = [
    ("text", [], [], [".log", ".md", ".text"], [], []),
    ("js", [], [], [".jsx", ".ts", ".tsx"], [], []),
    ("java", [], [], [".groovy", ".kt"], [], []),
    ("html", [], [], [".xhtml"], [], []),
    ("shell", ["bashrc", "zshrc"], [], [], [], []),
    ("dockerfile", [], [], [".dockerfile"], [], []),
]


def extension(name: Column) -> Column:
    """From the last dot on, or empty text; a leading dot counts (``.env`` → ``.env``)."""
    return F.when(
        F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))
    ).otherwise(F.lit(""))


def effective_extension(name: Column) -> Column:
    """The extension, looking through ``.dist`` and ``.template``.

    The suffix is cut only where the name carries it in lower case.  When nothing
    but the suffix was there to see, the remaining name acts as the extension.
    """
    def unwrap(file: Column) -> Column:
        name, ext = file["name"], file["ext"]
        inner = F.when(
            F.endswith(name, ext), F.left(name, F.char_length(name) - F.char_length(ext))
        ).otherwise(name)
        inner_ext = F.lower(extension(inner))
        return F.when(
            ext.isin(TEMPLATE_SUFFIXES), F.when(inner_ext == "", inner).otherwise(inner_ext)
        ).otherwise(ext)

    return let(F.struct(name.alias("name"), F.lower(extension(name)).alias("ext")), unwrap)


@remembered
def format_by_name(path: str = "path", extended: bool = False) -> Column:
    """The format the file name in a column calls for, or null.

    ``conf`` may still turn out to be XML.
    """
    routes = ROUTES + (EXTENDED_ROUTES if extended else [])

    def fits(file: Column, names, prefixes, exts, ext_prefixes, ext_suffixes) -> Column:
        name, ext = file["name"], file["ext"]
        tests = [starts_with(name, p) for p in prefixes]
        tests += [starts_with(ext, p) for p in ext_prefixes]
        tests += [F.endswith(ext, F.lit(s)) for s in ext_suffixes]
        if names:
            tests.append(name.isin(names))
        if exts:
            tests.append(ext.isin(exts))
        return any_of(tests)

    def chain(file: Column) -> Column:
        start = F.when(F.lit(False), F.lit(""))
        return reduce(lambda c, r: c.when(fits(file, *r[1:]), F.lit(r[0])), routes, start)

    named = F.struct(
        base_name(F.col(path)).alias("name"),
        effective_extension(base_name(F.col(path))).alias("ext"),
    )
    return let(named, chain)


def sniff_xml(fmt: Column, content: Column) -> Column:
    """Config-like files that open with an XML declaration are XML."""
    head = F.left(content.cast("string"), F.lit(len(XML_DECLARATION_START)))
    return F.when((fmt == CONFIG_LIKE) & (head == XML_DECLARATION_START), F.lit("xml")).otherwise(
        fmt
    )


def with_name_format(files: DataFrame, extended: bool = False) -> DataFrame:
    """Add ``format`` from name and size alone, so unneeded content is never read."""
    fmt = format_by_name("path", extended)
    return files.withColumn("format", F.when(F.col("length") >= MIN_FILE_BYTES, fmt))


def with_format(files: DataFrame, extended: bool = False) -> DataFrame:
    """Add ``format`` (null when no extractor takes the file)."""
    named = with_name_format(files, extended)
    return named.withColumn("format", sniff_xml(F.col("format"), F.col("content")))
