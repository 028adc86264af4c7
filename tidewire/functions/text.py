"""Scalar text functions as Column builders. The cleaners, splitters and stemmers differ on purpose; none stands in for another."""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# ---- clean and normalise ----


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), "\\s+", " ")), 256)


def normalize_title(title: Column) -> Column:
    """Lower case; what is no ASCII letter, digit or space becomes a space; collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9\\s]", " "), "\\s+", " "))


def normalized_runs(text: Column) -> Column:
    """The runs of ASCII letters and digits, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def flat(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def comparable_text(content: Column, summary: Column, title: Column, least: int = 50) -> Column:
    """The first of content and summary that is long enough when trimmed, else the title, else null."""
    long = lambda c: F.when(F.length(F.trim(c)) >= least, F.trim(c))
    return F.coalesce(long(content), long(summary), F.nullif(F.trim(title), F.lit("")))


_LEAD_BYTE = re.compile("[Â-ô][\u0080-¿Œ-™]")


def _repair(text: str) -> str:
    if _LEAD_BYTE.search(text):
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return text


@F.pandas_udf(StringType())
def clean_entities(s: pd.Series) -> pd.Series:
    """Text decoded by the wrong table repaired, and entities unescaped up to twice; null stays null and tags stay."""
    return s.map(lambda t: None if t is None else html.unescape(html.unescape(_repair(t))))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def clean_article(text: Column) -> Column:
    """Block tags become line breaks, other tags and addresses spaces; entities unescaped; blanks and blank lines collapsed. Null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)<\\s*/?\\s*(p|div|br|li|ul|ol|h[1-6]|tr|blockquote|article|section)\\b[^>]*>", "\n")
    t = unescape(F.regexp_replace(t, "<[^>]*>", " "))
    t = F.regexp_replace(F.regexp_replace(t, "https?://\\S+", " "), "[ \\t\\f\\x0B\\r]+", " ")
    return F.trim(F.regexp_replace(t, " ?\n[ \n]*", "\n"))


def clean_inline(text: Column) -> Column:
    """Entities first, then tags; all white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(text), "<[^>]+>", " "), "\\s+", " "))


def plain_text(text: Column) -> Column:
    """Tags become spaces, entities are unescaped, addresses become spaces."""
    return F.regexp_replace(unescape(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")), "https?://\\S+", " ")


# ---- tokenise, split, stem ----


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(normalize_title(title), " "), ""))


def entity_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*"), F.lit(0))


def sentences(text: Column, least: int = 3) -> Column:
    """Split after . ! or ? where white space and an opener, capital, digit or dollar follow, and at line breaks; pieces longer than ``least``."""
    parts = F.split(text, "(?<=[.!?])(?<=[.!?][\"')\\]]?)\\s+(?=[\"'(\\[]?[A-Z0-9$])|\n+", -1)
    return F.filter(F.transform(parts, F.trim), lambda s: F.length(s) > least)


def stem(word: Column) -> Column:
    """The first suffix of a list that fits goes, if four letters stay; ies becomes y."""
    out = word
    for suffix in ("s", "ly", "es", "ed", "ies", "ing", "ation", "ations"):  # the last tried stands outermost
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) - len(suffix) >= 4), F.concat(F.left(word, F.length(word) - len(suffix)), F.lit("y" if suffix == "ies" else ""))).otherwise(out)
    return out


def plural_stem(word: Column) -> Column:
    """A possessive ending goes, outer . - and ' go, and a plural s after four letters or more."""
    w = F.regexp_replace(F.regexp_replace(word, "'s$", ""), "^[.'-]+|[.'-]+$", "")
    return F.when((F.length(w) > 4) & w.rlike("[^s]s$"), F.left(w, F.length(w) - 1)).otherwise(w)


def light_stem(word: Column) -> Column:
    w = F.regexp_replace(word, "'s$", "")
    out = w
    for suffix in ("s", "ly", "es", "ed", "ing"):
        out = F.when(F.endswith(w, F.lit(suffix)) & (F.length(w) - len(suffix) >= 4), F.left(w, F.length(w) - len(suffix))).otherwise(out)
    return out


def content_stems(text: Column, stop: tuple[str, ...]) -> Column:
    words = F.filter(F.transform(entity_tokens(text), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)
    return F.array_distinct(F.transform(words, stem))


@F.pandas_udf(StringType())
def strip_html(s: pd.Series) -> pd.Series:
    """Text repaired, tags to blanks, entities unescaped, white space collapsed."""
    return s.map(lambda t: None if t is None else re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", " ", _repair(t)))).strip())


def normalized_unescaped(text: Column) -> Column:
    """Entities unescaped, lower case, runs of anything but ASCII letters and digits one space each."""
    return F.trim(F.regexp_replace(F.lower(unescape(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def closed_sentences(text: Column) -> Column:
    """Split after . ! or ? and any closing marks, which stay with their sentence."""
    parts = F.split(F.regexp_replace(text, "([.!?][\"'’”)\\]]*)\\s+", "$1\u0000"), "\u0000", -1)
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(text), "\\s+"), ""))


def end_sentence(text: Column) -> Column:
    return F.when(text.rlike("[.!?][\"')\\]]*$"), text).otherwise(F.concat(text, F.lit(".")))


# ---- similarity ----


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def coverage(a: Column, b: Column) -> Column:
    """Part of ``a`` that ``b`` holds."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


@F.pandas_udf(DoubleType())
def sequence_similarity(candidate: pd.Series, member: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; not symmetric, so always candidate first."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(candidate, member, strict=True)], dtype="float64")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a`` (Hyyro)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(DoubleType())
def sequence_at_least(candidate: pd.Series, member: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio above where it may reach ``least``, else 0: matched blocks are a common subsequence, which is cheap to bound."""
    out = []
    for a, b, t in zip(candidate, member, least, strict=True):
        size = len(a) + len(b)
        may = t <= 0 or 2 * common_subsequence(a, b) >= t * size
        out.append(SequenceMatcher(None, a, b).ratio() if may else 0.0)
    return pd.Series(out, dtype="float64")


# Not because it varies: a filter on its result would else be pushed below it and ask it a second time for each pair.
sequence_at_least = sequence_at_least.asNondeterministic()


def mentions(text: Column, term: Column) -> Column:
    """Whether the term stands in the text as a whole token."""
    return F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])\\Q"), term, F.lit("\\E(?![a-z0-9])")))


def whole_word(text: Column, words: tuple[str, ...]) -> Column:
    """Those of ``words`` (a small list) that the lower-cased text holds as whole words, sorted."""
    hits = [F.when(text.rlike("(^|[^a-z0-9])" + re.sub(r"([.\-+()])", r"\\\1", w) + "([^a-z0-9]|$)"), F.lit(w)) for w in sorted(words)]
    return F.array_compact(F.array(*hits))


# ---- numbers ----

# What counts as a number with meaning, and plain numbers and years.
NUMBER = "(?i)\\$\\s?\\d[\\d,]*(?:\\.\\d+)?\\s?(?:million|billion|trillion|bn|m|k|b)?\\b|\\b\\d+(?:\\.\\d+)?\\s?(?:%|percent|x\\b|million|billion|trillion|bn|gb|tb|mb|ghz|tokens?|parameters?|users|customers|employees|countries|languages)|\\b\\d+(?:\\.\\d+){1,3}\\b|\\b\\d{1,3}(?:,\\d{3})+\\b"
PLAIN_NUMBER = "(?<![\\w.-])\\d+(?:\\.\\d+)?(?![\\w.-])"
YEAR = "^(?:19|20)\\d{2}$"


def numbers_in(text: Column) -> Column:
    """Normalised numbers with a unit, of money, of versions or with commas; bare years are none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda m: F.replace(F.regexp_replace(F.lower(m), "[\\s,$]", ""), F.lit("percent"), F.lit("%")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda m: (m != "") & ~m.rlike(YEAR))))


def title_numbers(title: Column) -> Column:
    plain = F.filter(F.regexp_extract_all(title, F.lit(PLAIN_NUMBER), F.lit(0)), lambda m: ~m.rlike(YEAR))
    return F.array_sort(F.array_union(numbers_in(title), plain))


# Fixed value: numbers of a script, with what gives them a unit.
MEASURE = "(?i)\\$?\\d[\\d,]*(?:\\.\\d+)?\\s?(?:%|percent\\b|(?:million|billion|trillion|thousand)\\b|[mbkx]\\b)?"


def numbers_by_unit(text: Column) -> Column:
    """map of pct, usd, mult and plain to the distinct numbers of that unit, without signs and commas, sorted."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MEASURE), F.lit(0)), lambda m: F.lower(F.trim(m)))
    unit = lambda m: F.when(m.rlike("%|percent"), "pct").when(F.startswith(m, F.lit("$")), "usd").when(F.endswith(m, F.lit("x")), "mult").otherwise("plain")
    value = lambda m: F.regexp_replace(m, "[,\\s$%]|percent", "")
    of = lambda u: F.array_sort(F.array_distinct(F.transform(F.filter(raw, lambda m: unit(m) == u), value)))
    units = ("pct", "usd", "mult", "plain")
    return F.map_filter(F.create_map(*(x for u in units for x in (F.lit(u), of(u)))), lambda k, v: F.size(v) > 0)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.map_values(numbers_by_unit(text))))


def numeric_conflict(a: Column, b: Column) -> Column:
    """Whether two texts give different values of one measured unit; plain numbers never conflict."""
    x, y = numbers_by_unit(a), numbers_by_unit(b)
    differs = lambda u: F.coalesce(~F.arrays_overlap(F.try_element_at(x, F.lit(u)), F.try_element_at(y, F.lit(u))), F.lit(False))
    return differs("pct") | differs("usd") | differs("mult")


def main_figure(text: Column) -> Column:
    """struct(stat, unit) of a sentence's figure: money, then a scaled number, a share, a multiple, a number with commas."""
    kinds = (("usd", "\\$\\s?\\d[\\d,.]*(?:\\s?(?:thousand|million|billion|trillion))?"), ("scale", "\\b\\d[\\d,.]*\\s?(?:thousand|million|billion|trillion)\\b"), ("pct", "\\b\\d+(?:\\.\\d+)?\\s?(?:%|percent\\b)"), ("mult", "\\b\\d+(?:\\.\\d+)?x\\b"), ("count", "\\b\\d{1,3}(?:,\\d{3})+\\b"))
    hit = [F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for _, p in kinds]
    return F.coalesce(*(F.when(h.isNotNull(), F.struct(h.alias("stat"), F.lit(k).alias("unit"))) for (k, _), h in zip(kinds, hit, strict=True)))


# ---- time, address, format ----


def coverage_date(instant: Column) -> Column:
    """The business day, in Indian time, of an instant in UTC."""
    return F.to_date(F.from_utc_timestamp(instant, "Asia/Kolkata"))


def target_date(instant: Column) -> Column:
    """The business day that a pass collects: the one before."""
    return F.date_sub(coverage_date(instant), 1)


def valid_labels(day: Column, time: Column) -> Column:
    """Whether labels look like 03/10/2026 and 9:00 AM."""
    return day.rlike(r"^\d{2}/\d{2}/\d{4}$") & time.rlike("^(1[0-2]|[1-9]):[0-5]\\d (AM|PM)$")


def coverage_window(day: Column) -> Column:
    """struct(start, end) of a business day in UTC."""
    start = F.to_utc_timestamp(day.cast("timestamp"), "Asia/Kolkata")
    return F.struct(start.alias("start"), (start + F.expr("interval 1 day") - F.expr("interval 1 microsecond")).alias("end"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


# Publishers by host.
PUBLISHERS = {"news.ycombinator.com": "Hacker News", "theguardian.com": "The Guardian", "theregister.com": "The Register", "macrumors.com": "MacRumors", "spectrum.ieee.org": "IEEE Spectrum"}


def publisher(url: Column, names: dict[str, str] | None = None) -> Column:
    """The curated name of an address's host, else the host, else Unknown."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")
    curated = F.create_map(*(F.lit(x) for pair in (PUBLISHERS if names is None else names).items() for x in pair))
    return F.coalesce(F.try_element_at(curated, host), F.nullif(host, F.lit("")), F.lit("Unknown"))


def two_places(x: Column) -> Column:
    """Rounded half to even, as reasons print it."""
    return F.format_number(x, 2)


def percent_encode(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
