"""Addresses, markup escaping and spreadsheet-safe cells."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WEB_SCHEME = r"^(?:https?|ftp|wss?):"
ANY_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
WEB_HOST = (
    r"^[a-z]+:[/\\]*(?:[^/\\?#]*@)?"
    r"(\[[0-9a-f:.]+\]|[^/\\?#:@\s<>^|%\[\]]+)"
    r"(?::[0-9]{0,5})?(?:[/\\?#]|$)"
)
OTHER_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"


def domain(url: Column, fallback: str = "") -> Column:
    """Host of an address without one leading ``www.``.

    ``fallback`` is the answer for text that is no address; an address without a host
    (``mailto:``) gives ``''``. Hosts outside ASCII stay as written, not as punycode.
    """
    trimmed = F.trim(url)
    lowered = F.lower(trimmed)
    host = F.regexp_extract(lowered, WEB_HOST, 1)
    other = F.regexp_extract(trimmed, OTHER_HOST, 1)
    return (
        F.when(lowered.rlike(WEB_SCHEME), F.when(host == "", F.lit(fallback)).otherwise(_without_www(host)))
        .when(lowered.rlike(ANY_SCHEME), _without_www(other))
        .otherwise(F.lit(fallback))
    )


def _without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def display_domain(url: Column) -> Column:
    return domain(url, "web")


def safe_url(url: Column) -> Column:
    """The address if it is an absolute http(s) one, else ``''``."""
    trimmed = F.trim(url)
    return F.when(
        F.lower(trimmed).rlike(r"^https?:") & (F.regexp_extract(F.lower(trimmed), WEB_HOST, 1) != ""), trimmed
    ).otherwise(F.lit(""))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    # The five characters with a meaning in markup; the ampersand goes first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


# First characters a spreadsheet would run as a formula.
FORMULA_START = r"^[=+\-@\t\r]"


def harden_cell(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def reader_url(provider: Column, record_id: Column) -> Column:
    """Link into the provider's own reader, where it has one."""
    return F.when(
        provider == "instapaper", F.concat(F.lit("https://www.instapaper.com/read/"), record_id)
    ).otherwise(F.lit(""))
