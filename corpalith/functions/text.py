"""Text and language functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a question's subject, and words about asking.
STOP_WORDS = (
    "a an and are as at be been being but by can could did do does doing for from had has have having he her hers him his how i if in into is it its me might "
    "much my no nor not of on or our ours out should so some such than that the their theirs them then there these they this those to us was we were what when "
    "where which while who whom why will with would you your yours about after again against all also any because before below between both during each few "
    "more most other over same then through under until up very"
).split()
ASKING = "tell explain describe give show list get find need want know understand say question answer information detail details please help".split()
#: Words left out of a question before its passages are compared with it.
RERANK_STOP = (
    "the a an of to and or is are was were be been in on for with by from at as this that these those it its our your their we you they what which how do "
    "does did can may"
).split()
#: Words left out of a question before the store is searched.
SEARCH_STOP = (
    "the a an of to and or in on for with by from at as is are was were be been this that these those it its our your their we you they what which how do does did can may many much get gets got need needs "
    "about into over under when where who whom why not no yes if then than there here"
).split()

WORD = "[a-z0-9]+"
TERM = "[a-z0-9][a-z0-9'-]*"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_terms(text: Column) -> Column:
    """Distinct words of more than two letters that carry what a text is about, sorted."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: F.length(w) > 2)
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS + ASKING))))


def search_terms(text: Column, most: int | None = None) -> Column:
    """Distinct words of more than two letters without those of ``SEARCH_STOP``, in order of the text; of the first ``most`` words, if given."""
    words = F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*SEARCH_STOP))
    return F.array_distinct(F.slice(words, 1, most) if most else words)


def stem(word: Column) -> Column:
    """ies to y, else es or s off, if three letters or more remain."""

    def cut(ending: str, put: str = "") -> tuple[Column, Column]:
        rest = F.substring(word, F.lit(1), F.length(word) - len(ending))
        return word.endswith(ending) & (F.length(rest) >= 3), F.concat(rest, F.lit(put))

    (a, ay), (b, by), (c, cy) = cut("ies", "y"), cut("es"), cut("s")
    return F.when(a, ay).when(b, by).when(c, cy).otherwise(word)


def slug(text: Column) -> Column:
    """ASCII words joined by hyphens."""
    return F.array_join(tokens(text), "-")


def first_sentence(text: Column, most: int) -> Column:
    """The text up to its first full stop, question or exclamation mark, at most ``most`` characters."""
    return F.substring(F.regexp_extract(text, "^[^.!?]*", 0), 1, most)


def summary(text: Column, least: int = 60, most: int = 300) -> Column:
    """The first line of ``least`` characters or more that is no heading, list item or table row, cut at ``most``."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: (F.length(x) >= least) & ~F.substring(x, 1, 1).isin("#", "-", "*", "|"))
    return F.substring(F.get(good, F.lit(0)), 1, most)


#: What a refusal is about, how it is said, and phrases that need no subject.
_CORPUS = r"(?i)\b(passages?|documents?|docs?|knowledge ?base|corpus|sources?|excerpts?|content|context|material|records?|articles?|retrieved \w+|provided (context|text|documents?|passages?)|(pages?|text|information) (provided|supplied|given|here))\b"
_ABSENT = r"(?i)\b((do|does|did)(n't| not) (mention|say|state|specify|address|cover|contain|include|provide|indicate|describe|discuss)|(is|are|was|were) not (mentioned|stated|specified|covered|addressed|described|included|discussed))\b"
_ALONE = r"(?i)\b((could|can) ?not find|couldn't find|cannot find|unable to find|no (information|mention|details?|guidance) (about|on|regarding|for)|nothing (in|about|on) (this|the) (knowledge ?base|corpus|passages?|documents?|page))\b"


def declines(answer: Column) -> Column:
    """Whether a sentence of an answer says that the corpus does not hold the answer."""
    sentences = F.split(F.coalesce(answer, F.lit("")), r"(?<=[.!?])\s+")
    return F.exists(sentences, lambda s: s.rlike(_ALONE) | (s.rlike(_ABSENT) & s.rlike(_CORPUS)))


#: Greetings, and questions about what can be asked.
SOCIAL = r"(?i)^\s*(hi|hey|hello|good (morning|afternoon|evening)|thanks|thank you|cheers|ok|okay|got it|bye|goodbye)\b[\s!.,?]*$"
SCOPE = (
    r"(?i)\b(what (all |else )?can (you|i) (tell|ask|answer|do|help|cover|find)|what else (do|can) you|what (questions|else) can i ask|what (do|can) you know"
    r"|what (are you|is this) (for|about)|what('s| is) (in )?(here|this)|what (kind of )?(topics|subjects|things|questions|documents|content)|what should i ask"
    r"|how can you help|who are you|what are you|help me|^help$)\b"
)


def question_kind(question: Column) -> Column:
    """``social``, ``scope`` (about what can be asked, with one subject of its own at most) or ``content``."""
    text = F.trim(F.coalesce(question, F.lit("")))
    rest = F.regexp_replace(text, SCOPE, " ")
    return F.when(text == "", "content").when(text.rlike(SOCIAL), "social").when(text.rlike(SCOPE) & (F.size(content_terms(rest)) <= 1), "scope").otherwise("content")


#: Personal data and secrets.
SENSITIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "phone": r"[+][0-9]{1,3} ?[(]?[0-9]{3}[)]? ?[0-9]{3}-?[0-9]{4}",
    "card": r"[0-9]{16}",
    "secret": r"(token|password|secret|api_key) ?[=:] ?[\"'][^\"']{8,}[\"']",
}


def sensitive_classes(text: Column) -> Column:
    """The classes of personal data or secrets in a text, in the order of ``SENSITIVE``."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in SENSITIVE.items())), lambda x: x.isNotNull())


def redacted(text: Column) -> Column:
    """The text with each finding replaced by its class in brackets."""
    for name, pattern in SENSITIVE.items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text
