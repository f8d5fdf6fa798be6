"""Column functions over addresses."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CREDIBILITY, INSTITUTIONAL, SKIP_DOMAINS, SKIP_EXTENSIONS, TRACKING, TRUST
from .text import let, trim

_SHAPE = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


_GROUPS = ("scheme", "host", "port", "path", "query")


def _parts(url: Column) -> Column:
    """Struct of scheme and host in lower case, port, path and query as they are; empty strings if it isn't http or https."""
    groups = {name: k for k, name in enumerate(_GROUPS, 1)}
    cut = lambda text, name: F.regexp_extract(text, _SHAPE, groups[name])
    return let(trim(url), lambda t: F.struct(*((F.lower(cut(t, n)) if n in ("scheme", "host") else cut(t, n)).alias(n) for n in _GROUPS)))


def host(url: Column) -> Column:
    """In lower case; empty if the address isn't http or https."""
    return F.lower(F.regexp_extract(trim(url), _SHAPE, 2))


def _port(p: Column) -> Column:
    usual = (p["port"] == "") | ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
    return F.when(usual, "").otherwise(F.concat(F.lit(":"), p["port"]))


def _path(raw: Column) -> Column:
    """With dot segments resolved; '/' if empty."""
    parts = F.slice(F.split(raw, "/"), 2, 1_000_000)

    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    ended = lambda done: F.when(raw.rlike(r"/\.{1,2}$") & ~done.endswith("/"), F.concat(done, F.lit("/"))).otherwise(done)
    resolved = F.aggregate(parts, F.array().cast("array<string>"), step, lambda p: ended(F.concat(F.lit("/"), F.array_join(p, "/"))))
    return F.when(raw == "", "/").when(raw.contains("/."), resolved).otherwise(raw)


def path(url: Column) -> Column:
    """With dot segments resolved; '/' if empty."""
    return let(F.regexp_extract(trim(url), _SHAPE, 4), _path)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _query(raw: Column) -> Column:
    """'?' and the parameters that don't track, decoded; empty if there are none."""
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    kept = F.transform(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)), lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    return let(F.array_join(kept, "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def normalized(url: Column) -> Column:
    """Without fragment and tracking parameters; null if it isn't http or https."""
    return let(_parts(url), lambda p: F.when(p["host"] != "", F.concat(p["scheme"], F.lit("://"), p["host"], _port(p), _path(p["path"]), _query(p["query"]))))


def dedup_key(url: Column) -> Column:
    """Of a normalised address: host and path in lower case, and the query as it is."""

    def key(p: Column) -> Column:
        return F.concat(p["host"], F.regexp_replace(F.lower(_path(p["path"])), "/+$", ""), F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])))

    return let(_parts(url), lambda p: F.when(p["host"] != "", key(p)).otherwise(F.lower(url)))


def skipped(url: Column) -> Column:
    """Names a domain anywhere, or ends in a file type, that is passed over."""
    named = let(F.lower(url), lambda low: F.exists(F.array(*map(F.lit, SKIP_DOMAINS)), lambda d: low.contains(d)))
    return named | let(F.lower(path(url)), lambda low: F.exists(F.array(*map(F.lit, SKIP_EXTENSIONS)), lambda e: low.endswith(e)))


def focus_bypass(url: Column, focus: Column) -> Column:
    """Addresses that a focus wants in spite of skipped()."""
    h = host(url)
    return ((focus == "reddit") & h.contains("reddit.com")) | ((focus == "youtube") & (h.contains("youtube.com") | h.contains("youtu.be")))


def old_reddit(url: Column) -> Column:
    """The address that is fetched for one of the forum's: its old host, whose pages are plain."""
    return F.regexp_replace(url, r"://(?:www\.)?reddit\.com", "://old.reddit.com")


def _parameter(href: Column, names: str) -> Column:
    """The first parameter of one of these names, decoded; a plus is a space. Null if there is none."""
    raw = F.regexp_extract(F.regexp_replace(href, "#.*$", ""), rf"[?&](?:{names})=([^&]*)", 1)
    return F.when(href.rlike(rf"[?&](?:{names})="), F.coalesce(F.try_url_decode(raw), raw))


def redirect_target(href: Column) -> Column:
    """Where a result link leads: itself if it is an address, or the first q= or url= that /url? carries, or uddg=; null if neither."""
    return (
        F.when(href.rlike("^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/url?") & href.rlike("[?&](q|url)="), _parameter(href, "q|url"))
        .when(href.contains("uddg="), let(_parameter(href, "uddg"), lambda once: F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)))
    )


def credibility(url: Column) -> Column:
    """The label of the first needle that the host has; else the host without www."""

    def label(h: Column) -> Column:
        out = F.when(h.endswith(".gov") | h.endswith(".edu"), INSTITUTIONAL)
        for needle, known in CREDIBILITY:
            out = out.when(h.contains(needle), known)
        return out.otherwise(F.concat(F.lit("[General Web - "), F.regexp_replace(h, r"^(www\.)+", ""), F.lit("]")))

    return let(F.coalesce(F.nullif(host(url), F.lit("")), F.lit("unknown")), label)


def trust(url: Column) -> Column:
    """A float multiplier by the first tier that the host belongs to."""

    def tier(h: Column) -> Column:
        out = F.when(h.endswith(".gov") | h.endswith(".edu"), 1.5)
        for score, needles in TRUST:
            out = out.when(reduce(or_, (h.contains(n) for n in needles)), score)
        return out.otherwise(1.0).cast("float")

    return let(host(url), tier)
