"""Allowlist check of repository URLs.

The parts are taken apart with the grammar of RFC 3986, appendix B.
``parse_url`` is of no use here: it keeps the path encoded and the scheme as
written, and gives NULL for texts that have to be told apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.functions.text import let, trim_all

# Fixed values
MAX_URL_BYTES = 256
ALLOWED_SCHEME = "https"
ALLOWED_HOST = "github.com"
REPOSITORY_PATTERN = r"^https://github\.com/[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+(?:\.git)?/?\z"
URL_ERRORS = {
    "length": "URL too long",
    "characters": "URL contains invalid characters",
    "syntax": "invalid URL format",
    "scheme": "only HTTPS URLs are allowed",
    "host": "only github.com repositories are supported",
    "userinfo": "URL must not contain credentials",
    "query": "URL must not contain query parameters or fragments",
    "path": "URL contains invalid path",
    "shape": "invalid GitHub URL",
}

_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def _named(**columns: Column) -> Column:
    return F.struct(*[column.alias(name) for name, column in columns.items()])


def _with_parts(url: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the parts of the URL, taken apart from the outside in."""

    def fragment(u: Column) -> Column:
        return _named(
            fragment=F.regexp_extract(u, r"(?s)#(.*)\z", 1), bare=F.regexp_replace(u, r"(?s)#.*\z", "")
        )

    def scheme(p: Column) -> Column:
        after = F.regexp_replace(p["bare"], r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
        return _named(
            fragment=p["fragment"], bare=p["bare"],
            scheme=F.lower(F.regexp_extract(p["bare"], r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)),
            query=F.regexp_extract(after, r"(?s)\?(.*)\z", 1),
            rest=F.regexp_replace(after, r"(?s)\?.*\z", ""),
        )

    def authority(p: Column) -> Column:
        has_authority = p["rest"].startswith("//")
        path = (
            F.when(has_authority, F.regexp_replace(p["rest"], r"(?s)^//[^/]*", ""))
            # without a leading slash the rest is opaque: it has no path
            .when(p["rest"].startswith("/") | (p["scheme"] == ""), p["rest"])
            .otherwise("")
        )
        return _named(
            **{name: p[name] for name in ("fragment", "bare", "scheme", "query", "rest")},
            authority=F.when(has_authority, F.regexp_extract(p["rest"], r"(?s)^//([^/]*)", 1)).otherwise(""),
            path=path,
            # form decoding would turn "+" into a space
            decoded=F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))),
        )

    def host(p: Column) -> Column:
        return _named(
            **{name: p[name] for name in ("fragment", "bare", "scheme", "query", "rest", "path")},
            userinfo=F.when(p["authority"].contains("@"), F.regexp_replace(p["authority"], r"(?s)@[^@]*\z", "")),
            host=F.regexp_extract(p["authority"], r"(?s)([^@]*)\z", 1),
            clean=F.concat(F.lit(f"https://{ALLOWED_HOST}"), p["decoded"]),
        )

    return let(fragment(url), lambda a: let(scheme(a), lambda b: let(authority(b), lambda c: let(host(c), body))))


def _malformed(p: Column) -> Column:
    host, userinfo = p["host"], p["userinfo"]
    tests = [
        p["bare"].rlike(r"[\x00-\x1F\x7F]") | p["fragment"].rlike(r"[\x00-\x1F\x7F]"),
        # a colon in front of everything, or in the first segment of a relative path
        p["bare"].startswith(":"),
        (p["scheme"] == "") & p["rest"].rlike(r"^[^/]*:"),
        p["path"].rlike(_BAD_ESCAPE),
        p["fragment"].rlike(_BAD_ESCAPE),
        # host: the port is digits, an open bracket closes, escapes are for non-ASCII bytes only
        F.when(host.startswith("["), ~host.rlike(r"\](?::[0-9]*)?\z")).otherwise(
            host.contains(":") & ~host.rlike(r":[0-9]*\z")
        ),
        host.rlike(r"%(?![89A-Fa-f][0-9A-Fa-f]|25)"),
        host.rlike(r"[ \\^`{|}]"),
        F.coalesce(userinfo.rlike(r"[^A-Za-z0-9\-._:~!$&'()*+,;=%@]") | userinfo.rlike(_BAD_ESCAPE), F.lit(False)),
    ]
    return reduce(lambda a, b: a | b, tests)


def validate_repo_url(url: Column) -> Column:
    """``struct<clean, error>``: the cleaned URL, or the first rule it breaks."""

    def verdict(p: Column) -> Column:
        error = (
            F.when(F.octet_length(url) > MAX_URL_BYTES, URL_ERRORS["length"])
            .when(F.octet_length(url) != F.length(url), URL_ERRORS["characters"])
            .when(url.contains("\x00"), URL_ERRORS["characters"])
            .when(_malformed(p), URL_ERRORS["syntax"])
            .when(p["scheme"] != ALLOWED_SCHEME, URL_ERRORS["scheme"])
            .when(p["host"] != ALLOWED_HOST, URL_ERRORS["host"])
            .when(p["userinfo"].isNotNull(), URL_ERRORS["userinfo"])
            .when((p["query"] != "") | (p["fragment"] != ""), URL_ERRORS["query"])
            .when(p["clean"].contains(".."), URL_ERRORS["path"])
            .when(~p["clean"].rlike(REPOSITORY_PATTERN), URL_ERRORS["shape"])
        )
        return let(error, lambda e: _named(clean=F.when(e.isNull(), p["clean"]), error=e))

    return _with_parts(url, verdict)


def split_valid(requests: DataFrame, url_col: str = "repo_url") -> tuple[DataFrame, DataFrame]:
    """Requests with a clean URL, and rejected ones with the reason."""
    checked = requests.withColumn("checked", validate_repo_url(trim_all(F.col(url_col)))).select(
        *requests.columns, F.col("checked.clean").alias("clean_url"), F.col("checked.error").alias("error")
    )
    return (
        checked.where(F.col("error").isNull()).drop("error"),
        checked.where(F.col("error").isNotNull()).drop("clean_url"),
    )
