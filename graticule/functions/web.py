"""URL and web-result operators as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graticule.functions.text import BLANK, html_to_text, strip

# Top-level domains that make a bare name an address.
TOP_LEVEL = [
    "com", "net", "org", "io", "ai", "app", "dev", "cloud", "info", "biz", "tv", "me", "us", "ca", "eu", "uk", "de", "fr",
    "it", "es", "nl", "se", "no", "fi", "pl", "cz", "ch", "at", "au", "nz", "br", "in", "sg", "hk", "jp", "cn", "kr", "tw",
    "tr", "gr", "pt", "ru", "ua",
]


def normalize_url(candidate: Column) -> Column:
    """An address with its scheme, null if the text isn't one."""
    bare = strip(F.coalesce(candidate, F.lit("")))
    bare = F.regexp_replace(bare, r"""^[()\[\]{}<>"']+|[()\[\]{}<>"']+$""", "")
    bare = F.regexp_replace(bare, r"""[.,);\]}>"'?!]+$""", "")
    low = F.lower(bare)
    host = F.regexp_extract(bare, r"^([^/?#:]*)", 1)
    domain = F.lower(F.regexp_extract(host, r"([^.]*)$", 1))
    secure = F.concat(F.lit("https://"), bare)
    return (
        F.when(bare == "", None)
        .when(low.startswith("http://") | low.startswith("https://"), bare)
        .when(low.startswith("www."), secure)
        .when(F.contains(bare, F.lit(".")) & host.rlike("^[A-Za-z0-9.-]+$") & domain.isin(TOP_LEVEL), secure)
    )


def extract_urls(text: Column, most: int) -> Column:
    """Distinct addresses of a text, those with a scheme first, then words that look like one."""
    if most <= 0:
        return F.array().cast("array<string>")
    source = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(source, F.lit(r"(?i)https?://[^\s)<>\"]+"), F.lit(0))
    # a word can only be an address if it has a scheme, or a dot before something that isn't trimmed off
    words = F.filter(F.split(strip(source), f"{BLANK}+"), lambda w: w.rlike(r"""\.[^.,);\]}>"'?!]|://"""))
    normal = F.filter(F.transform(F.concat(found, words), normalize_url), lambda u: u.isNotNull())
    return F.slice(F.array_distinct(normal), 1, most)


def search_prefix(text: Column) -> Column:
    """The query after `web:`, `ddg:` or `search:`, null without such a prefix."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)^\s*(?:web|ddg|search)\s*:\s*(.+?)\s*$", 1), F.lit(""))


def unwrap_redirect(address: Column, parameter: str = "uddg") -> Column:
    """The target of a redirecting address, else the address."""
    target = F.nullif(F.regexp_extract(address, rf"[?&]{parameter}=([^&#]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(target), address)


def search_results(html: Column, most: int = 5) -> Column:
    """Results of a search page: (title, url, snippet) structs, distinct by address, at most `most` (1 to 10).

    A result reaches from its link to the next one; its snippet is the first element of the snippet class in it.
    """
    most = min(max(most, 1), 10)
    parts = F.split(F.coalesce(html, F.lit("")), r"""(?i)(?=<a[^>]*class="result__a")""")
    link = r"""(?is)^<a[^>]*class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>"""
    snippet = r"""(?is)<(?:a|div)[^>]*class="result__snippet"[^>]*>(.*?)</(?:a|div)>"""

    def result(part: Column) -> Column:
        return F.struct(
            html_to_text(F.regexp_extract(part, link, 2)).alias("title"),
            unwrap_redirect(F.replace(F.regexp_extract(part, link, 1), F.lit("&amp;"), F.lit("&"))).alias("url"),
            html_to_text(F.regexp_extract(part, snippet, 1)).alias("snippet"),
        )

    found = F.filter(F.transform(parts, result), lambda r: (r["title"] != "") & (r["url"] != ""))
    first = F.filter(found, lambda r, i: F.array_position(F.transform(found, lambda x: x["url"]), r["url"]) == i + 1)
    return F.slice(first, 1, most)


def bounded_body(body: bytes, content_type: str, max_bytes: int = 1_000_000, max_chars: int = 20_000) -> dict[str, object]:
    """What a fetch keeps of a response: refused unless it is text, cut at a number of bytes and of characters."""
    kind = content_type.split(";", 1)[0].strip().lower()
    if kind and not (kind.startswith("text/") or kind in ("application/xhtml+xml", "application/xml", "application/json")):
        raise ValueError(f"content type {kind} is not text")
    text = body[:max_bytes].decode("utf-8", "replace")
    return {"text": text[:max_chars], "truncated": len(body) > max_bytes or len(text) > max_chars}


def fetch(url: str, opener: Callable[[str], tuple[bytes, str]], max_bytes: int = 1_000_000, max_chars: int = 20_000) -> dict[str, object]:
    """One page through a caller's opener (url to body and content type), on the driver; jobs never use the network."""
    body, kind = opener(url)
    return {"url": url, **bounded_body(body, kind, max_bytes, max_chars)}
