"""Parts of a URI as Columns: the password and the query parameters.

``try_parse_url`` is not enough here: it has no query for opaque URIs such as
``jdbc:mysql://host?password=x``.  The checks below decide which texts count as
a URI at all; an unparsable one yields nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyhound.functions.predicates import is_uri_ascii
from keyhound.functions.strings import after, before, item, let, no_items, starts_with

_SCHEME = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*):"
_CONTROL = r"[\x00-\x1f\x7f]"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_USERINFO = r"\A[A-Za-z0-9\-._:~!$&'()*+,;=%@]*+\z"
_HOST = r"""(?s)\A(?:[A-Za-z0-9\-._~!$&'()*+,;=:\[\]<>"]|[^\x00-\x7f]|%25|%[89A-Fa-f][0-9A-Fa-f])*+\z"""
_PORT = r"\A(?:[^:\[]*(?::[0-9]*)?|\[[^\]]*\](?::[0-9]*)?|[^\[]*:[0-9]*)\z"


def _unescaped(text: Column, plus_is_space: bool) -> Column:
    """Percent-decoded text, null when an escape is broken."""
    source = text if plus_is_space else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.when(~text.rlike(_BAD_ESCAPE), F.try_url_decode(source))


def _with_parts(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over the parts of a parsable URI; no items for any other text.

    The parts are worked out in steps, each of which uses the one before.
    """

    def split_scheme(t: Column) -> Column:
        scheme = F.regexp_extract(t, _SCHEME, 1)
        unfragmented = before(t, "#")
        return F.struct(
            t.alias("text"),
            scheme.alias("scheme"),
            F.substr(
                unfragmented, F.when(scheme == "", 1).otherwise(F.char_length(scheme) + 2)
            ).alias("hierarchy"),
        )

    def split_query(u: Column) -> Column:
        return F.struct(
            u["text"].alias("text"),
            u["scheme"].alias("scheme"),
            before(u["hierarchy"], "?").alias("rest"),
            F.when(
                F.contains(u["hierarchy"], F.lit("?")), after(u["hierarchy"], "?")
            ).alias("query"),
        )

    def split_authority(u: Column) -> Column:
        rest, has_scheme = u["rest"], u["scheme"] != ""
        has_authority = starts_with(rest, "//") & (has_scheme | ~starts_with(rest, "///"))
        authority = F.when(has_authority, before(F.substr(rest, F.lit(3)), "/"))
        return F.struct(
            u["text"].alias("text"),
            has_scheme.alias("has_scheme"),
            rest.alias("rest"),
            u["query"].alias("query"),
            (has_scheme & ~starts_with(rest, "/")).alias("opaque"),
            F.coalesce(authority, F.lit("")).alias("authority"),
        )

    def split_user(u: Column) -> Column:
        authority = u["authority"]
        host = F.substring_index(authority, "@", -1)
        return F.struct(
            *[u[n].alias(n) for n in ("text", "has_scheme", "rest", "query", "opaque", "authority")],
            host.alias("host"),
            F.when(
                F.contains(authority, F.lit("@")),
                F.left(authority, F.char_length(authority) - F.char_length(host) - 1),
            ).alias("userinfo"),
        )

    def if_parsable(u: Column) -> Column:
        return F.when(_is_parsable(u), body(u)).otherwise(no_items())

    return let(
        split_scheme(text),
        lambda a: let(
            split_query(a),
            lambda b: let(split_authority(b), lambda c: let(split_user(c), if_parsable)),
        ),
    )


def _is_parsable(u: Column) -> Column:
    userinfo, text = F.coalesce(u["userinfo"], F.lit("")), u["text"]
    no_scheme_ok = starts_with(u["rest"], "/") | ~F.contains(before(u["rest"], "/"), F.lit(":"))
    authority_length = F.char_length(u["authority"])
    path = F.when(u["opaque"], F.lit("")).otherwise(
        F.when(
            authority_length > 0, F.substr(u["rest"], authority_length + 3)
        ).otherwise(u["rest"])
    )
    fragment = F.when(F.contains(text, F.lit("#")), after(text, "#")).otherwise(F.lit(""))
    hierarchical = (
        userinfo.rlike(_USERINFO)
        & ~userinfo.rlike(_BAD_ESCAPE)
        & u["host"].rlike(_HOST)
        & u["host"].rlike(_PORT)
        & (u["has_scheme"] | no_scheme_ok)
    )
    return (
        ~text.rlike(_CONTROL)
        & ~starts_with(text, ":")
        & (u["opaque"] | hierarchical)
        & ~F.concat(path, F.lit("#"), fragment).rlike(_BAD_ESCAPE)
    )


def _password(u: Column, kv_path: Column | str, key: str) -> Column:
    found = ~u["opaque"] & F.contains(F.coalesce(u["userinfo"], F.lit("")), F.lit(":"))
    password = _unescaped(after(u["userinfo"], ":"), plus_is_space=False)
    return F.when(found, F.array(item(F.lit(key), password, kv_path))).otherwise(no_items())


def _query(u: Column, kv_path: Column | str) -> Column:
    pairs = F.filter(
        F.split(F.coalesce(u["query"], F.lit("")), "&"),
        lambda p: (p != "") & ~F.contains(p, F.lit(";")) & ~p.rlike(_BAD_ESCAPE),
    )
    return F.transform(
        pairs,
        lambda p: item(
            _unescaped(before(p, "="), plus_is_space=True),
            F.when(
                F.contains(p, F.lit("=")), _unescaped(after(p, "="), plus_is_space=True)
            ).otherwise(F.lit("")),
            kv_path,
        ),
    )


def password_items(text: Column, kv_path: Column | str, key: str = "URI_Password") -> Column:
    """The userinfo password, percent-decoded; an empty password still counts."""
    return _with_parts(text, lambda u: _password(u, kv_path, key))


def query_items(text: Column, kv_path: Column | str) -> Column:
    """Every decodable query parameter, repeats included; pairs holding ``;`` are dropped."""
    return _with_parts(text, lambda u: _query(u, kv_path))


def uri_items(text: Column, kv_path: Column | str) -> Column:
    """Password and query parameters of a text that looks like a URI."""
    return F.when(
        is_uri_ascii(text),
        _with_parts(
            text, lambda u: F.concat(_password(u, kv_path, "URI_Password"), _query(u, kv_path))
        ),
    ).otherwise(no_items())
