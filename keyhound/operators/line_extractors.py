"""Extractors that look at one line at a time.

Each extractor maps the text of a line to an array of pairs.  ``needles`` are
plain texts of which a line must hold at least one; they let a scan drop whole
documents and lines with a byte search before any pattern runs.

Identifier patterns consume a word at once and start only at its edge
(``(?<!\\w)\\d*+``), which finds the same captures as a free search in linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.functions.predicates import any_of
from keyhound.functions.strings import (
    after,
    before,
    item,
    items_when,
    let,
    no_items,
    starts_with,
    trim_space,
)
from keyhound.functions.uri import password_items, uri_items
from keyhound.fixed_values import UNICODE_SPACES

# What counts as an assignment, call or instruction in each language.
# (White space is ASCII here; quoted texts never hold either quote character.)
_S = r"[\t\n\f\r ]"
_WORD_START = r"(?<!\w)\d*+"
_IDENT = r"([a-zA-Z_]\w*+)"
_QUOTED = r"""['"]([^'"]+)['"]"""
_QUOTED_OR_EMPTY = r"""['"]([^'"]*)['"]"""
GO_ASSIGN = rf"{_WORD_START}{_IDENT}{_S}*+(?::=|=){_S}*+{_QUOTED}"
JAVA_ASSIGN = rf"{_WORD_START}[a-zA-Z_]\w*+{_S}++{_IDENT}{_S}*+={_S}*+{_QUOTED}"
JS_ASSIGN = rf"(?:const|let|var){_S}++{_IDENT}{_S}*+={_S}*+{_QUOTED}"
PHP_DEFINE = rf"(?iu)define{_S}*+\({_S}*+{_QUOTED}{_S}*+,{_S}*+{_QUOTED}{_S}*+\)"
PHP_ASSIGN = rf"(?:(?:\$([a-zA-Z_]\w*+))|(?:{_QUOTED}{_S}*+=>)){_S}*+={_S}*+{_QUOTED}"
PY_ASSIGN = rf"\A{_S}*+{_IDENT}{_S}*+={_S}*+{_QUOTED_OR_EMPTY}"
PY_DICT = rf"{_QUOTED}{_S}*:{_S}*{_QUOTED_OR_EMPTY}"
PY_KEYWORD = rf"{_WORD_START}{_IDENT}{_S}*+={_S}*+{_QUOTED_OR_EMPTY}"
PY_GETENV = (
    rf"(?:os\.getenv|environ\.get)\({_S}*+{_QUOTED}(?:{_S}*,{_S}*{_QUOTED_OR_EMPTY})?{_S}*\)"
)
PY_CALL = rf"(?<![\w.])[0-9.]*+([a-zA-Z_][\w.]*+){_S}*+\("
DOCKER_SET = rf"(?diu)\A%s{_S}+([a-zA-Z_][a-zA-Z0-9_]*+)(?:{_S}+|=)(.+)"
SHELL_PAIR = r"(?d)\A([^=]+)=(.+)\z"
CURL_USER = rf"""(?iu)(?:-u|--user){_S}+['"]?([^'"]+)['"]?"""
NPM_TOKEN = ":_authToken="
PYPI_PASSWORD = "password:"


@dataclass(frozen=True)
class LineExtractor:
    items: Callable[[Column], Column]
    needles: tuple[str, ...]

    def may_match(self, text: Column) -> Column:
        return any_of([F.contains(text, F.lit(n)) for n in self.needles])


def _first(text: Column, pattern: str, kv_path: str, key: int = 1, value: int = 2) -> Column:
    """One pair from the first match; captured keys are never empty."""
    return let(
        F.regexp_extract(text, pattern, key),
        lambda found: items_when(
            found != "", item(found, F.regexp_extract(text, pattern, value), kv_path)
        ),
    )


def _quoted_matches(text: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of every match of a pattern, which runs once: a match is cut at its quotes, which its texts cannot hold."""
    has_quote = F.contains(text, F.lit("'")) | F.contains(text, F.lit('"'))
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.split(m, "['\"]"))
    return F.when(has_quote, let(matches, body)).otherwise(no_items())


def _is_comment(line: Column, *marks: str) -> Column:
    return any_of([starts_with(line, m) for m in marks])


def _split_pair(line: Column, mark: str, kv_path: str, dots_to: str | None = None) -> Column:
    key = trim_space(before(line, mark))
    if dots_to is not None:
        key = F.replace(key, F.lit("."), F.lit(dots_to))
    return item(key, trim_space(after(line, mark)), kv_path)


def _setting(text: Column, comments: str, body: Callable[[Column], Column]) -> Column:
    """``body`` over a trimmed line that is no comment and has a ``=``."""

    def checked(line: Column) -> Column:
        usable = F.contains(line, F.lit("=")) & ~_is_comment(line, *comments)
        return F.when(usable, body(line)).otherwise(no_items())

    return let(trim_space(text), checked)


def config_items(text: Column) -> Column:
    """``key = value`` outside ``#`` and ``;`` comments, empty values dropped."""
    return F.filter(
        _setting(text, "#;", lambda line: F.array(_split_pair(line, "=", "config"))),
        lambda kv: kv["value"] != "",
    )


def pip_setting_items(text: Column) -> Column:
    """``key = value`` as in config files, empty values kept."""
    return _setting(text, "#;", lambda line: F.array(_split_pair(line, "=", "pip")))


def pip_url_items(text: Column) -> Column:
    """The password inside a URL setting."""

    def from_value(value: Column) -> Column:
        found = F.contains(value, F.lit("://")) & F.contains(value, F.lit("@"))
        return F.when(found, password_items(value, "pip", "pip password")).otherwise(no_items())

    return _setting(text, "#;", lambda line: let(trim_space(after(line, "=")), from_value))


def pip_items(text: Column) -> Column:
    return F.concat(pip_setting_items(text), pip_url_items(text))


def properties_items(text: Column) -> Column:
    """``key=value`` or ``key:value``; dots in keys become underscores."""

    def split(line: Column) -> Column:
        usable = ~_is_comment(line, "#", "!")
        return (
            F.when(
                usable & F.contains(line, F.lit("=")),
                F.array(_split_pair(line, "=", "properties", dots_to="_")),
            )
            .when(
                usable & F.contains(line, F.lit(":")),
                F.array(_split_pair(line, ":", "properties", dots_to="_")),
            )
            .otherwise(no_items())
        )

    return let(trim_space(text), split)


def _docker_items(text: Column, instruction: str, kv_path: str) -> Column:
    pattern = DOCKER_SET % instruction

    def split(line: Column) -> Column:
        key = F.regexp_extract(line, pattern, 1)
        value = F.btrim(F.regexp_extract(line, pattern, 2), F.lit("\"'"))
        return items_when(key != "", item(key, value, kv_path))

    return let(trim_space(text), split)


def docker_env_items(text: Column) -> Column:
    return _docker_items(text, "ENV", "env")


def docker_arg_items(text: Column) -> Column:
    return _docker_items(text, "ARG", "arg")


def dockerfile_items(text: Column) -> Column:
    return F.concat(docker_env_items(text), docker_arg_items(text))


def go_items(text: Column) -> Column:
    return _first(text, GO_ASSIGN, "go")


def java_items(text: Column) -> Column:
    return _first(text, JAVA_ASSIGN, "java")


def js_items(text: Column) -> Column:
    return _first(text, JS_ASSIGN, "javascript")


def php_define_items(text: Column) -> Column:
    return _first(text, PHP_DEFINE, "php.define")


def php_assign_items(text: Column) -> Column:
    variable, quoted = F.regexp_extract(text, PHP_ASSIGN, 1), F.regexp_extract(text, PHP_ASSIGN, 2)
    key = F.when(variable != "", variable).otherwise(quoted)
    return items_when(
        key != "", item(key, F.regexp_extract(text, PHP_ASSIGN, 3), "php.assignment")
    )


def php_items(text: Column) -> Column:
    return F.concat(php_define_items(text), php_assign_items(text))


def htpasswd_items(text: Column) -> Column:
    """The second ``:`` field of a line."""
    line = trim_space(text)
    return items_when(
        F.contains(line, F.lit(":")),
        item(F.lit("htpasswd Hash"), trim_space(before(after(line, ":"), ":")), "htpasswd"),
    )


def npmrc_items(text: Column) -> Column:
    return items_when(
        F.contains(text, F.lit(NPM_TOKEN)),
        item(F.lit("npm authToken"), trim_space(F.substring_index(text, NPM_TOKEN, -1)), "npmrc"),
    )


def pypirc_items(text: Column) -> Column:
    return items_when(
        F.contains(text, F.lit(PYPI_PASSWORD)),
        item(
            F.lit("PyPI password"), trim_space(F.substring_index(text, PYPI_PASSWORD, -1)), "pypirc"
        ),
    )


def plaintext_items(text: Column) -> Column:
    """Credentials and parameters of every URI among the words of a line."""
    words = F.filter(
        F.split(text, "[" + UNICODE_SPACES + "]+"), lambda w: F.contains(w, F.lit(":/"))
    )
    return F.flatten(F.transform(words, lambda w: uri_items(w, "plaintext.uri")))


def _python(condition: Column, text: Column, items: Column) -> Column:
    return F.when(condition & ~starts_with(trim_space(text), "#"), items).otherwise(no_items())


def python_assign_items(text: Column) -> Column:
    return _python(
        F.contains(text, F.lit("=")), text, _first(text, PY_ASSIGN, "assignment")
    )


def python_dict_items(text: Column) -> Column:
    pairs = _quoted_matches(
        text, PY_DICT, lambda found: F.transform(found, lambda m: item(F.get(m, 1), F.get(m, 3), "dict"))
    )
    return _python(F.contains(text, F.lit(":")), text, pairs)


def _getenv_names(found: Column) -> Column:
    return F.transform(found, lambda m: item(F.get(m, 1), F.lit(""), "env"))


def _getenv_defaults(found: Column) -> Column:
    given = F.filter(found, lambda m: F.coalesce(F.get(m, 3), F.lit("")) != "")
    return F.transform(given, lambda m: item(F.get(m, 1), F.get(m, 3), "env_default"))


def _getenv(text: Column, *bodies: Callable[[Column], Column]) -> Column:
    pairs = _quoted_matches(text, PY_GETENV, lambda found: F.concat(*[body(found) for body in bodies]))
    return _python(F.contains(text, F.lit("env")), text, pairs)


def python_getenv_items(text: Column) -> Column:
    """Names only; their empty value never reaches a rule."""
    return _getenv(text, _getenv_names)


def python_getenv_default_items(text: Column) -> Column:
    return _getenv(text, _getenv_defaults)


def python_call_items(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(PY_CALL), F.lit(1))
    return _python(
        F.contains(text, F.lit("(")),
        text,
        F.transform(names, lambda n: item(F.lit("function"), F.concat(n, F.lit("()")), "call")),
    )


def python_keyword_items(text: Column) -> Column:
    """Keyword arguments, on lines that are not an assignment themselves."""
    def pair(match: Column) -> Column:
        name = F.rtrim(before(F.get(match, 0), "="), F.lit("\t\n\f\r "))
        return item(F.ltrim(name, F.lit("0123456789")), F.get(match, 1), "keyword")

    pairs = _quoted_matches(text, PY_KEYWORD, lambda found: F.transform(found, pair))
    return _python(F.contains(text, F.lit("=")) & ~text.rlike(PY_ASSIGN), text, pairs)


def python_items(text: Column) -> Column:
    return F.concat(
        python_assign_items(text),
        python_dict_items(text),
        _getenv(text, _getenv_names, _getenv_defaults),
        python_call_items(text),
        python_keyword_items(text),
    )


def shell_pair_items(text: Column) -> Column:
    """``key=value`` of a logical line; the key keeps words such as ``export``."""
    return let(
        trim_space(F.regexp_extract(text, SHELL_PAIR, 2)),
        lambda value: items_when(
            value != "",
            item(trim_space(F.regexp_extract(text, SHELL_PAIR, 1)), value, "shell"),
        ),
    )


def curl_items(text: Column) -> Column:
    """The password of a ``curl -u user:password`` call on a logical line."""
    user = F.when(
        F.contains(F.lower(text), F.lit("curl")), F.regexp_extract(text, CURL_USER, 1)
    ).otherwise(F.lit(""))
    return let(
        user,
        lambda u: items_when(
            F.contains(u, F.lit(":")), item(F.lit("cURL_Password"), after(u, ":"), "curl")
        ),
    )


def shell_items(text: Column) -> Column:
    return F.when(
        ~starts_with(trim_space(text), "#"), F.concat(shell_pair_items(text), curl_items(text))
    ).otherwise(no_items())


LINE_EXTRACTORS: dict[str, LineExtractor] = {
    "npmrc": LineExtractor(npmrc_items, (NPM_TOKEN,)),
    "pypirc": LineExtractor(pypirc_items, (PYPI_PASSWORD,)),
    "pip": LineExtractor(pip_items, ("=",)),
    "properties": LineExtractor(properties_items, ("=", ":")),
    "dockerfile": LineExtractor(dockerfile_items, (" ", "\t")),
    "htpasswd": LineExtractor(htpasswd_items, (":",)),
    "text": LineExtractor(plaintext_items, (":/",)),
    "python": LineExtractor(python_items, ("=", "(", ":")),
    "js": LineExtractor(js_items, ("=",)),
    "java": LineExtractor(java_items, ("=",)),
    "go": LineExtractor(go_items, ("=",)),
    "php": LineExtractor(php_items, ("=", "(")),
    "conf": LineExtractor(config_items, ("=",)),
}


def extract_lines(lines: DataFrame, extractor: LineExtractor | Callable[[Column], Column]):
    """Pairs of a ``path, line, text`` table under one extractor."""
    if isinstance(extractor, LineExtractor):
        lines, items = lines.filter(extractor.may_match(F.col("text"))), extractor.items
    else:
        items = extractor
    return lines.select(
        F.col("path").alias("file_path"), "line", F.inline(items(F.col("text")))
    ).select("file_path", "key", "value", "kv_path", "line")
