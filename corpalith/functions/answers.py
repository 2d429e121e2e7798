"""Functions on questions, answers and sources: figures, markers, snippets, dates, routing and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpalith.functions import text as T

#: Numbers, and the markers by which a sentence names its source.
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
PAGE_MARKER = r"(?i)\[page\]"
DATA_MARKER = r"(?i)\[d\d{1,2}\]"
PASSAGE_MARKER = r"\[\d{1,2}\](?!\()"
#: Words that tie a question to what its asker has in view.
DEICTIC = ("this", "these", "my", "mine", "our", "ours", "here", "current", "currently", "above", "below", "on screen", "shown", "showing")
#: How questions begin that one look-up answers, and words that ask for research.
SINGLE = ("how do i", "how can i", "where is", "where do i", "what is the", "who is", "when is", "can i", "does the", "is there")
RESEARCH = (
    "compare", "why", "explain", "analyse", "analyze", "overview of", "everything", "all the ways", "differences", "trade-off", "tradeoff", "implications", "summarise", "summarize", "across", "landscape",
    "what should i consider", "pros and cons",
)
#: Labels of dates of change and of origin, the most trusted first.
UPDATED = (
    "last updated", "last modified", "last reviewed", "last revised", "date last reviewed", "revised on", "revised", "reviewed on", "reviewed", "updated on", "updated", "modified on", "modified", "version date",
    "effective date", "effective", "issued on", "issued", "published on", "published", "date of issue", "approval date", "approved on",
)
CREATED = ("created on", "created", "date created", "authored on", "authored", "first published", "first issued", "original issue", "date of origin", "drafted on", "drafted")


def figures(text: Column) -> Column:
    """Distinct numbers of a text without thousands separators and trailing decimal zeros."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"(\.\d*?)0+$|\.$", "$1")))


def sentences(text: Column) -> Column:
    """Sentences with the white space after them, so that joining them gives the text back."""
    return F.split(F.regexp_replace(text, r"((?<=[.!?:])\s+|\n+)", "$1\u0001"), "\u0001")


def supported(answer: Column, sources: Column, question: Column) -> Column:
    """(kept, removed, survives): an answer without the sentences whose figures its sources do not hold.

    Only sentences marked as from the page or a data point, and not from a passage, are checked.
    The figures of the question count as known. The rest survives if a marker remains in it.
    """
    allowed = F.array_union(figures(F.coalesce(sources, F.lit(""))), figures(F.coalesce(question, F.lit(""))))

    def bad(s: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(s, PAGE_MARKER, " "), DATA_MARKER, " ")
        return (s.rlike(PAGE_MARKER) | s.rlike(DATA_MARKER)) & ~s.rlike(PASSAGE_MARKER) & (F.size(F.array_except(figures(body), allowed)) > 0)

    parts = sentences(F.coalesce(answer, F.lit("")))
    kept = F.trim(F.array_join(F.filter(parts, lambda s: ~bad(s)), ""))
    marked = kept.rlike(PASSAGE_MARKER) | kept.rlike(PAGE_MARKER) | kept.rlike(DATA_MARKER)
    return F.struct(kept.alias("kept"), F.transform(F.filter(parts, bad), lambda x: F.trim(x)).alias("removed"), marked.alias("survives"))


def cited(answer: Column) -> Column:
    """The distinct passage numbers that an answer cites, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\](?!\()"), F.lit(1)), lambda x: x.cast("int")))


def verdict(answer: Column, offered: Column, has_page: Column, data: Column) -> Column:
    """(supported, reason) of an answer against the number of passages ``offered``, the page and the count of data points.

    Reasons in order: declined, invented citation, fabricated page, fabricated data, uncited.
    """
    answer = F.coalesce(answer, F.lit(""))
    invented = F.exists(cited(answer), lambda n: (n < 1) | (n > offered))
    points = F.transform(F.regexp_extract_all(answer, F.lit(r"(?i)\[d(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    false_data = F.exists(points, lambda n: (n < 1) | (n > data))
    page = answer.rlike(PAGE_MARKER)
    reason = (
        F.when(T.declines(answer), "declined").when(invented, "invented_citation").when(page & ~has_page, "fabricated_page").when(false_data, "fabricated_data")
        .when((F.size(cited(answer)) == 0) & ~page & (F.size(points) == 0), "uncited")
    )
    return F.struct(reason.isNull().alias("supported"), reason.alias("reason"))


def snippet(text: Column, term: Column, width: int = 180, before: int = 60) -> Column:
    """``width`` characters around the first place of ``term``, from ``before`` characters ahead of it; else the start."""
    at = F.instr(F.lower(text), F.lower(term))
    return F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(width))


def strip_tags(html: Column) -> Column:
    """Text outside angle brackets, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def span(chunk: Column, most: int = 600) -> Column:
    """What is cited of a chunk: without a leading heading line, at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(chunk, r"^\s*#[^\n]*\n+", "")), 1, most)


def page_context(summary: Column, most: int = 1200) -> Column:
    """(text, truncated): control characters as spaces, folded, cut at a word within the last 200 characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(summary, F.lit("")), r"[\x00-\x1F\x7F]", " "), " +", " "))
    head = F.substring(clean, 1, most)
    gap = F.locate(" ", F.reverse(head))
    cut = F.when((gap > 0) & (gap <= 200), F.substring(head, F.lit(1), F.length(head) - gap)).otherwise(head)
    long = F.length(clean) > most
    return F.struct(F.when(long, cut).otherwise(clean).alias("text"), long.alias("truncated"))


def fetches_live(question: Column, key: Column, covered: Column) -> Column:
    """Whether a live source is read: never without a key; if the question points at what is in view, or the corpus doesn't cover it."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    pointing = padded.rlike(" (" + "|".join(DEICTIC) + ") ")
    return F.when(key.isNull() | (F.trim(key) == ""), False).otherwise(pointing | ~covered)


def single_shot(question: Column) -> Column:
    """Whether one look-up will do: no word of research, and short (seven words) or of a simple form."""
    low = F.trim(F.lower(F.coalesce(question, F.lit(""))))
    research = F.lit(False)
    for mark in RESEARCH:
        research = research | F.contains(low, F.lit(mark))
    simple = F.lit(False)
    for start in SINGLE:
        simple = simple | low.startswith(start)
    return ~research & ((F.size(F.split(low, r"\s+")) <= 7) | simple)


def origin_allowed(origin: Column, allowed: list[str]) -> Column:
    """A missing origin may; an empty list lets no other in."""
    return origin.isNull() | (F.array_contains(F.array(*map(F.lit, allowed)), origin) if allowed else F.lit(False))


def upload_refusal(size: Column, head: Column, most: int = 20 << 20) -> Column:
    """Why an upload is refused: empty, too_large or unsupported_format; else null."""
    known = head.startswith("%PDF-") | head.rlike(r"(?i)<(!doctype|html|head|body)\b") | ~head.rlike(r"[\x00-\x08\x0E-\x1F]")
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most, "too_large").when(~known, "unsupported_format")


#: Months by their first letters, and the forms of a date, each with the places of year, month and day.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = "(january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug|september|sep|october|oct|november|nov|december|dec)"
_FORMS = (
    (rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH}\s+(\d{{4}})\b", 3, 2, 1), (rf"\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", 3, 1, 2),
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3), (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 3, 2, 1),
)


def _date(words: Column) -> Column:
    """The first date of a short lower-case text: 1 march 2026, march 1, 2026, 2026-03-01 or 01/03/2026 with the day first."""
    found = []
    for pattern, year, month, day in _FORMS:
        y, m, d = (F.regexp_extract(words, pattern, i) for i in (year, month, day))
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(m, 1, 3)).cast("string") if _MONTH in pattern else m
        found.append(F.try_to_date(F.concat_ws("-", y, F.lpad(number, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))
    return F.filter(F.array(*found), lambda x: F.year(x).between(1900, 2100))


def labelled_date(text: Column, labels: tuple[str, ...] = UPDATED, reach: int = 40) -> Column:
    """The date within ``reach`` characters after the most trusted label that has one; else null."""
    low = F.lower(text)

    def of(label: Column) -> Column:
        # All places of a label are read, so a first mention without a date hides no later one.
        after = F.regexp_extract_all(low, F.concat(F.lit(r"\b"), label, F.lit(rf"\b(.{{0,{reach}}})")), F.lit(1))
        return F.flatten(F.transform(after, _date))

    present = F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(low, x))
    return F.get(F.flatten(F.transform(present, of)), F.lit(0))
