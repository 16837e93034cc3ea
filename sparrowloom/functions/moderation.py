"""Moderation of texts as columns. Patterns are applied in their order; positions count code points from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import BLANK

#: Fixed values.
PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?1?[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "ssn": r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b",
    "credit_card": r"\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}
DEFAULT = ("email", "phone", "ssn", "credit_card")
PROFANITY = ("damn", "hell", "ass", "shit", "fuck", "bitch", "bastard")


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<text, start, stop>>`` of the matches of a pattern; its length is that of the gaps and matches before."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    before = lambda values, n: F.aggregate(F.slice(values, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    start = lambda i: before(gaps, i + 1) + before(found, i)
    return F.transform(found, lambda m, i: F.struct(m.alias("text"), start(i).alias("start"), (start(i) + F.length(m)).alias("stop")))


def pii(text: Column, types: tuple[str, ...] = DEFAULT, custom: dict[str, str] | None = None) -> Column:
    """``array<struct<sub_type, text, start, stop>>`` of all personal data of these types and of the custom patterns."""
    wanted = {t: PII[t] for t in types} | (custom or {})
    named = lambda name: lambda s: F.struct(F.lit(name).alias("sub_type"), s["text"].alias("text"), s["start"].alias("start"), s["stop"].alias("stop"))
    parts = [F.transform(spans(text, p), named(name)) for name, p in wanted.items()]
    return F.concat(*parts)


def masked(text: Column, types: tuple[str, ...] = DEFAULT, custom: dict[str, str] | None = None, by: str = "[REDACTED]") -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, by), ({t: PII[t] for t in types} | (custom or {})).values(), text)


def word_list(base: tuple[str, ...], custom: list[str], allowed: list[str]) -> list[str]:
    """Base and custom words in lower case, without one occurrence of each allowed one."""
    words = [w.lower() for w in (*base, *custom)]
    for w in allowed:
        if w.lower() in words:
            words.remove(w.lower())
    return words


def profane(text: Column, words: tuple[str, ...] = PROFANITY) -> Column:
    """The words of the list among those of a text, each once, in the order of the list; only a to z of a word count."""
    own = F.transform(F.split(text, f"{BLANK}+", -1), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.array_contains(own, w))


def without_profanity(text: Column, words: tuple[str, ...] = PROFANITY) -> Column:
    found = profane(text, words)
    return reduce(lambda t, w: F.when(F.array_contains(found, w), F.regexp_replace(t, rf"(?i)\b{w}\b", "*" * len(w))).otherwise(t), words, text)


def topics(text: Column, blocked: dict[str, str]) -> Column:
    """``array<struct<topic, start, action>>``: the topics that a text holds in any case, where first, and what is to be done."""
    low = F.lower(text)
    all_ = F.array(*(F.struct(F.lit(t).alias("topic"), (F.locate(t.lower(), low) - 1).alias("start"), F.lit(a).alias("action")) for t, a in blocked.items()))
    return F.filter(all_, lambda t: t["start"] >= 0)


def verdict(text: Column, blocked: dict[str, str], types: tuple[str, ...] = DEFAULT, words: tuple[str, ...] = PROFANITY) -> Column:
    """``struct<passed, violations, blocked, moderated_text>``: no violation at all passes; a topic to block leaves no text."""
    own = topics(text, blocked)
    n = F.size(pii(text, types)) + F.size(profane(text, words)) + F.size(own)
    stop = F.exists(own, lambda t: t["action"] == "block")
    return F.struct((n == 0).alias("passed"), n.alias("violations"), stop.alias("blocked"), F.when(~stop, without_profanity(masked(text, types), words)).alias("moderated_text"))


def keywords(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words in any case."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w.lower())) for w in words))


def trigger(latency: Column, text: Column, position: Column, slow_ms: float, words: list[str], every: int, custom: Column | None = None) -> Column:
    """What makes an alert of a response; of several the custom one, then sampling, keyword, long response. Null without any."""
    return F.coalesce(F.when(custom, "custom") if custom is not None else F.lit(None).cast("string"), F.when(position % every == 0, "sampling"), F.when(keywords(text, words), "keyword"), F.when(latency > slow_ms, "long_response"))
