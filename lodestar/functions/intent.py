"""Column functions over search queries: what kind they are and what they ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import let, trim


def _any(text: Column, needles: Sequence[str]) -> Column:
    return let(text, lambda known: F.exists(F.array(*map(F.lit, needles)), lambda n: known.contains(n)))


def words(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: w != "")


def intent(query: Column) -> Column:
    q, n = F.lower(trim(query)), F.size(words(query))
    navigation = (n <= 3) & F.exists(F.array(*map(F.lit, L.NAVIGATION_SITES)), lambda s: q.contains(s) & (q.contains("login") | q.contains("website") | (q == s)))
    comparison = _any(q, L.COMPARISON) | (q.contains(" or ") & (q.contains("which") | q.contains("better")))
    return (
        F.when(navigation, "navigational")
        .when(comparison, "comparison")
        .when(_any(q, L.PERSON), "person")
        .when(_any(q, L.HOWTO), "howto")
        .when(_any(q, L.TEMPORAL) | _any(q, L.ROLES), "temporal")
        .when((n >= 8) | _any(q, L.RESEARCH), "research")
        .otherwise("factual")
    )


def temporal_hint(query: Column) -> Column:
    """Why a query is sensitive to time, or null if it isn't."""
    q = F.lower(trim(query))
    implied = F.when(_any(q, L.IMPLICIT) | (intent(query) == "temporal"), "current")
    return F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, L.RECENCY)), lambda n: q.contains(n)), F.lit(1)), F.try_element_at(F.filter(F.array(*map(F.lit, L.RELATIVE)), lambda n: q.contains(n)), F.lit(1)), implied, F.try_element_at(F.filter(F.array(*map(F.lit, L.YEARS)), lambda n: q.contains(n)), F.lit(1)))


def complexity(query: Column) -> Column:
    n = F.size(words(query))
    return F.when(n <= 3, "simple").when(n <= 8, "medium").otherwise("complex")


def source_count(kind: Column, grade: Column) -> Column:
    return F.when(kind == "factual", F.when(grade == "simple", 15).otherwise(20)).when(kind == "comparison", 30).when(kind == "navigational", 10).when(kind == "research", 40).otherwise(25)


def news_boost(query: Column) -> Column:
    return temporal_hint(query).isNotNull() | _any(F.lower(trim(query)), L.NEWS)


def entities(query: Column) -> Column:
    """Runs of capitalised words that aren't stop words, each once, in order."""
    stop = F.array(*map(F.lit, L.ENTITY_STOPWORDS))
    clean = F.filter(F.transform(F.split(query, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, word: Column) -> Column:
        named = word.rlike(r"^\p{Lu}") & ~F.array_contains(stop, F.lower(word)) & (F.octet_length(word) > 1)
        grown = F.when(state["open"] == "", word).otherwise(F.concat_ws(" ", state["open"], word))
        ended = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(F.when(named, state["done"]).otherwise(ended).alias("done"), F.when(named, grown).otherwise("").alias("open"))

    return F.array_distinct(F.aggregate(clean, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))))


def with_focus(query: Column, focus: Column) -> Column:
    q = trim(query)
    return F.when(focus == "reddit", F.concat(q, F.lit(" site:reddit.com"))).when(focus == "youtube", F.concat(q, F.lit(" site:youtube.com"))).when(focus == "academic", F.concat(q, F.lit(" site:edu OR site:gov OR site:nature.com"))).otherwise(q)


def with_year(query: Column, year: str) -> Column:
    """The year at the end of a query that is sensitive to time and names none."""
    return F.when(temporal_hint(query).isNotNull() & ~_any(F.lower(query), L.YEARS), F.concat(query, F.lit(f" {year}"))).otherwise(query)


def url_cap(focus: Column, asked: Column, usual: int, kind: Column, grade: Column) -> Column:
    """How many addresses a mode fetches for a query."""
    auto = focus.isNull() | focus.isin("auto", "lite", "")
    first = F.least(F.coalesce(asked, F.lit(usual)), F.lit(100))
    tuned = F.when(grade == "simple", F.least(first, F.lit(50))).when(grade == "complex", F.least(F.greatest(first, F.lit(100)), F.lit(150))).otherwise(first)
    tuned = F.when(kind == "navigational", F.least(tuned, F.lit(30))).otherwise(tuned)
    return F.when(focus == "fast", F.least(F.coalesce(asked, F.lit(30)), F.lit(30))).when(auto, tuned).when(focus.startswith("specialized"), F.least(F.coalesce(asked, F.lit(100)), F.lit(150))).otherwise(F.least(F.coalesce(asked, F.lit(usual)), F.lit(900)))


def chunk_count(focus: Column, optimal: Column) -> Column:
    """How many chunks go to the answer."""
    return F.when(focus == "research", 200).when(focus.startswith("specialized"), 50).otherwise(F.greatest(optimal, F.lit(25)))


def variations(query: Column) -> Column:
    q = trim(query)
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array(q, F.concat(q, F.lit(" news")), F.concat(q, F.lit(" forum"))))


def domain_variations(query: Column, domain: Column) -> Column:
    """A query, and with the words that its domain adds."""
    added = F.lit(L.DOMAIN_SUFFIXES["default"])
    for name, words_of in L.DOMAIN_SUFFIXES.items():
        added = F.when(domain == name, words_of).otherwise(added)
    return let(trim(query), lambda q: F.when(q == "", F.array().cast("array<string>")).otherwise(F.array(q, F.concat(q, F.lit(" "), added))))


def with_year_live(query: Column, year: str) -> Column:
    """The same as with_year() where a live search looks for words of its own list only."""
    low = F.lower(query)
    return F.when(_any(low, L.LIVE_RECENCY) & ~_any(low, L.YEARS), F.concat(query, F.lit(f" {year}"))).otherwise(query)


def live_url_cap(focus: Column, asked: Column, usual: int) -> Column:
    return F.least(F.coalesce(asked, F.lit(usual)), F.when(focus.eqNullSafe("lite"), 50).otherwise(900))


def live_chunk_count(focus: Column) -> Column:
    return F.when(focus.eqNullSafe("research"), 50).otherwise(25)
