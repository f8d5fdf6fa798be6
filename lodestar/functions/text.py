"""Column functions over text: tokens, chunks, quality, cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CHUNK_LEAST, CHUNK_MOST, OVERLAP, STOPWORDS

# Beginnings of lines that are no content.
BOILERPLATE = (
    r"(?i)^(share (this|on|via)|read more|subscribe|sign up|follow us|cookie|accept all|privacy policy|terms of (service|use)|advertisement|sponsored|related articles|trending|popular posts|most read|you may also (like|enjoy)|"
    r"© \d{4}|all rights reserved|powered by|loading\.\.\.|please wait|click here|read the full|continue reading|view more|show more|see also|tags?:|categories?:|filed under|posted in|last (updated|modified)|published|modified|edited|"
    r"log ?in|register|sign ?in|free trial|download now|buy now|add to cart|leave a (comment|reply)|your email|required fields|notify me|rss|print this|email this|bookmark|save to|report (this|abuse)|flag|spam|inappropriate|"
    r"next article|previous article|newer posts?|older posts?|page \d+ of \d+|showing \d+|results? for|sort by|filter by|refine|close|dismiss|got it|accept|decline|no thanks|maybe later|not now|we use cookies|"
    r"manage (preferences|consent)|cookie (settings|preferences|consent)|accept (all )?cookies|reject (all )?cookies|gdpr|data protection|we value your privacy|consent|personalize|customize your|opt[ -]?(in|out)|unsubscribe|paywall|premium content|"
    r"members only|subscriber exclusive|sign in to (read|continue)|create (a )?free account|start your free|already a (member|subscriber)|this content is|upgrade to)"
)
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F​‌‍﻿­  ]"


# White space of any kind.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often, or in whatever inner function, it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without the empty one after a last line break."""
    return F.split(F.regexp_replace(text, r"\n$", ""), "\n")


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of two bytes or more that aren't stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOPWORDS))


def without_stopwords(raw: Column) -> Column:
    """tokens() from raw_tokens()."""
    return F.filter(raw, lambda t: ~t.isin(*STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _join(a: Column, b: Column, by: str) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit(by), b))


#: The shortest run of whole sentences of CHUNK_LEAST characters that another one follows, behind the run before it.
_RUN = rf"(?s)\G ?+(.{{{CHUNK_LEAST - 1},}}?[.!?])(?= \p{{Lu}})"


def sentence_chunks(text: Column) -> Column:
    """Cut after a sentence once a chunk has CHUNK_LEAST characters; a shorter rest joins the last chunk."""

    def finish(done: Column, rest: Column) -> Column:
        n = F.size(done)
        joined = F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(done, -1), rest)))
        return F.when(rest == "", done).when((F.length(rest) < CHUNK_LEAST) & (n > 0), joined).otherwise(F.concat(done, F.array(rest)))

    return let(F.regexp_extract_all(text, F.lit(_RUN), F.lit(1)), lambda done: let(trim(F.regexp_replace(text, _RUN, "")), lambda rest: finish(done, rest)))


def paragraphs(text: Column) -> Column:
    """Neighbouring paragraphs together while they have CHUNK_MOST characters at most, or the first ones less than CHUNK_LEAST."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, "\r", ""), "\n\n"), trim), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        size = F.length(state["open"])
        goes_on = (size == 0) | (size + 2 + F.length(part) <= CHUNK_MOST) | (size < CHUNK_LEAST)
        return F.struct(F.when(goes_on, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"), F.when(goes_on, _join(state["open"], part, "\n\n")).otherwise(part).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def chunks(text: Column) -> Column:
    """Paragraphs, the long ones cut at sentences, without overlap."""
    return F.flatten(F.transform(paragraphs(text), lambda p: F.when(F.length(p) > CHUNK_MOST, sentence_chunks(p)).otherwise(F.array(p))))


def overlapped(parts: Column) -> Column:
    """Each chunk but the first begins with the end of the one before it, from a word's beginning."""

    def joined(chunk: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        n = F.floor(F.length(before) * F.lit(OVERLAP)).cast("int")
        end = F.right(before, n)
        words = trim(F.when(F.locate(" ", end) > 0, F.substring(end, F.locate(" ", end), F.length(end))).otherwise(end))
        return F.when((i == 0) | (n <= 10) | (words == ""), chunk).otherwise(F.concat(words, F.lit("… "), chunk))

    return F.transform(parts, joined)


def quality(text: Column) -> Column:
    """A tenth of its bytes, 5 for each line like a sentence; a third less if most lines are short."""
    def scored(own: Column) -> Column:
        sentences = F.size(F.filter(own, lambda x: (F.octet_length(x) >= 30) & x.rlike(r"[A-Z].*[.!?]$")))
        short = F.size(F.filter(own, lambda x: F.octet_length(x) < 15)) / F.size(own)
        score = F.expr("0L") + F.floor(F.octet_length(text) / 10) + sentences * 5
        return F.when((text != "") & (short > 0.6), score - F.floor(score / 3)).otherwise(score)

    return let(F.transform(lines(text), trim), scored)


def fingerprint(paragraph: Column) -> Column:
    return F.substring(trim(F.regexp_replace(F.lower(paragraph), r"(?U)\s+", " ")), 1, 80)


def cleaned(text: Column) -> Column:
    """Without control characters, repeated paragraphs, and lines that are short or boilerplate."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), "\r", "\n"), "\n\n"), trim), lambda p: p != "")
    # sorted by key and place, the first of a key stands behind another key; then back in order
    keyed = F.array_sort(F.transform(parts, lambda p, i: F.struct(fingerprint(p).alias("key"), i.alias("place"), p.alias("part"))))
    first = let(keyed, lambda k: F.array_sort(F.transform(F.filter(k, lambda x, i: (i == 0) | (F.get(k, i - 1)["key"] != x["key"])), lambda x: F.struct(x["place"].alias("place"), x["part"].alias("part")))))
    content = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), trim), lambda x: (F.octet_length(x) >= 3) & ~x.rlike(BOILERPLATE)), " ")
    kept = F.filter(F.transform(first, lambda x: content(x["part"])), lambda p: F.octet_length(p) >= 10)
    return trim(F.regexp_replace(F.array_join(kept, "\n\n"), r"(?U)\s{3,}", " "))
