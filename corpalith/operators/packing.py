"""Texts to chunks in column expressions: folds over a document's blocks, without Python and without a shuffle.

Blocks are packed under their heading path up to a target size; the end of a chunk goes with the next one
of its section; small chunks take the next one in. What several parts of a step read is bound to a variable,
as a column would be made anew for each of them. States append once for each chunk, not for each block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.operators.chunking import MOST, OVERLAP, PARENT, RUNT, TARGET

#: White space but for the line's end, and patterns that the folds and their SQL share: elements that are no text; block elements; other tags.
WHITE = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UNSEEN = r"(?is)<(?:script|style|noscript|head)\b.*?</(?:script|style|noscript|head)\s*>|<!--.*?-->"
BLOCKS = r"(?i)</?(?:h[1-6]|p|li|ul|ol|div|table|tr|pre|blockquote|article|section|nav|header|footer|aside|form|br)\b[^>]*>"
TAGS = r"<[^>]*>"
MARKS = "^#*"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, as a variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def marked(page: Column) -> Column:
    """HTML as lines: a block each, headings marked with ``#``; character references stay."""
    text = F.regexp_replace(page, UNSEEN, " ")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    return F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), TAGS, " ")


def blocks(text: Column) -> Column:
    """array<(level, text, size)> of a text's lines: level is over 0 for headings, the text is as it is written into chunks,
    the size is in estimated tokens, four characters each."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")

    def block(line: Column) -> Column:
        marks = F.when(line.startswith("#"), F.length(F.regexp_extract(line, MARKS, 0))).otherwise(0)
        title = F.when(line.startswith("#"), F.btrim(F.substring(line, marks + 1, F.length(line)), F.lit(WHITE))).otherwise("")
        heading = (marks > 0) & (marks <= 6) & (title != "")
        said = F.when(heading, F.concat(F.substring(line, F.lit(1), marks), F.lit(" "), title)).otherwise(line)
        return F.struct(F.when(heading, marks).otherwise(0).alias("level"), said.alias("text"), F.when(heading, title).otherwise(line).alias("title"))

    return F.transform(lines, lambda x: _bound(block(x), lambda b: F.struct(b["level"], b["text"], b["title"], F.greatest(F.lit(1), F.floor(F.length(b["text"]) / 4)).cast("int").alias("size"))))


_GROUP = "struct<section int, path array<string>, first int, last int>"


def groups(held: Column) -> Column:
    """array<(section, path, first, last)>: the blocks of each chunk, numbered from 1; a group of nothing but a heading is none.

    The state is the heading path (cut to the level above, then the heading is put on), the open group and its size.
    """
    none = F.array().cast("array<string>")
    begun = F.struct(
        none.alias("path"), F.lit(0).alias("section"), F.lit(0).alias("at"), F.lit(1).alias("first"), F.lit(0).alias("size"), F.lit(False).alias("body"), F.lit(False).alias("open"),
        F.array().cast(f"array<{_GROUP}>").alias("done"),
    )

    def closed(state: Column) -> Column:
        group = F.struct(state["section"].alias("section"), state["path"].alias("path"), state["first"].alias("first"), state["at"].alias("last"))
        return F.when(state["open"] & state["body"], F.concat(state["done"], F.array(group))).otherwise(state["done"])

    def step(state: Column, block: Column) -> Column:
        heading = block["level"] > 0
        fresh = heading | ~state["open"] | (state["size"] + block["size"] > MOST)
        path = F.when(heading, F.concat(F.slice(state["path"], F.lit(1), F.greatest(F.lit(0), block["level"] - 1)), F.array(block["title"]))).otherwise(state["path"])
        size = F.when(fresh, block["size"]).otherwise(state["size"] + block["size"])
        now = F.struct(
            path.alias("path"), (state["section"] + heading.cast("int")).alias("section"), (state["at"] + 1).alias("at"), F.when(fresh, state["at"] + 1).otherwise(state["first"]).alias("first"),
            size.alias("size"), (~heading).alias("body"), F.lit(True).alias("open"), F.when(fresh, closed(state)).otherwise(state["done"]).alias("done"),
        )
        return _bound(now, _shut)

    def _shut(now: Column) -> Column:
        full = now["body"] & (now["size"] >= TARGET)
        done = F.when(full, closed(now)).otherwise(now["done"])
        return F.struct(*(now[c].alias(c) for c in ("path", "section", "at", "first", "size", "body")), (~full).alias("open"), done.alias("done"))

    return F.aggregate(held, begun, step, closed)


def _joined(held: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.transform(F.slice(held, first, last - first + 1), lambda b: b["text"]), "\n\n")


def parents(held: Column) -> Column:
    """The text of each section, the one before any heading first, ``PARENT`` characters at most."""
    heads = F.filter(F.transform(held, lambda b, i: F.when(b["level"] > 0, i + 1)), lambda i: i.isNotNull())

    def section(starts: Column) -> Column:
        stops = F.concat(starts, F.array(F.size(held) + 1))
        return F.transform(F.sequence(F.lit(1), F.size(starts)), lambda k: F.substring(_joined(held, F.element_at(starts, k), F.element_at(stops, k + 1) - 1), 1, PARENT))

    return _bound(F.concat(F.array(F.lit(1)), heads), section)


def tail(text: Column) -> Column:
    """The last ``OVERLAP`` characters of a text, from a sentence or else a word on; a shorter text whole."""
    end = F.substring(text, F.length(text) - OVERLAP + 1, F.lit(OVERLAP))

    def cut(w: Column) -> Column:
        stop = F.instr(w, ". ")
        return F.when(stop > 0, F.substring(w, stop + 2, F.length(w))).otherwise(F.substring(w, F.instr(w, " ") + 1, F.length(w)))

    return F.when(F.length(text) <= OVERLAP, text).otherwise(_bound(end, cut))


_CHUNK = "struct<path array<string>, text string, overlap string, parent string>"


def merged(chunks: Column) -> Column:
    """Chunks of which those under ``RUNT`` characters have taken the next one in, as long as both stay within six characters a token of the target."""
    begun = F.struct(F.array().cast(f"array<{_CHUNK}>").alias("done"), F.lit(None).cast(_CHUNK).alias("held"))

    def step(state: Column, chunk: Column) -> Column:
        held = state["held"]
        takes = held.isNotNull() & (F.length(held["text"]) < RUNT) & (F.length(held["text"]) + 2 + F.length(chunk["text"]) <= TARGET * 6)
        both = F.struct(held["path"].alias("path"), F.concat(held["text"], F.lit("\n\n"), chunk["text"]).alias("text"), held["overlap"].alias("overlap"), held["parent"].alias("parent"))
        done = F.when(takes | held.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(held)))
        return F.struct(done.alias("done"), F.when(takes, both).otherwise(chunk).alias("held"))

    return F.aggregate(chunks, begun, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def made(held: Column) -> Column:
    """array<(path, text, overlap, parent)>: the chunks of blocks, before small ones take others in."""

    def chunk(packs: Column, texts: Column, sections: Column) -> Callable[[Column, Column], Column]:
        def run(g: Column, i: Column) -> Column:
            follows = (i > 0) & (F.get(packs, i - 1)["section"] == g["section"])
            overlap = F.when(follows, tail(F.get(texts, i - 1))).otherwise("")
            return F.struct(g["path"].alias("path"), F.get(texts, i).alias("text"), overlap.alias("overlap"), F.get(sections, g["section"]).alias("parent"))

        return run

    def texts_of(packs: Column) -> Column:
        texts = F.transform(packs, lambda g: _joined(held, g["first"], g["last"]))
        return _bound(texts, lambda t: _bound(parents(held), lambda s: F.transform(packs, chunk(packs, t, s))))

    return _bound(groups(held), texts_of)


def packed(documents: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, blocks, groups, made, chunks): every step for each document; a null or blank text has no chunks.

    ``made`` are the chunks before small ones take others in, each (path, text, overlap, parent).
    """
    rows = documents.select(F.col(id_col).alias("id"), blocks(text).alias("blocks"))
    rows = rows.select("id", "blocks", _bound(F.col("blocks"), groups).alias("groups"), _bound(F.col("blocks"), made).alias("made"))
    return rows.select("*", merged(F.col("made")).alias("chunks"))


def chunks(documents: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, ordinal, heading_path, text, overlap, parent, n_tokens): as ``chunking.chunks`` of plain texts, in the JVM."""
    rows = packed(documents, id_col, text).select("id", F.posexplode("chunks").alias("ordinal", "c"))
    size = F.greatest(F.lit(1), F.floor(F.length("c.text") / 4)).cast("int")
    return rows.select("id", "ordinal", F.array_join("c.path", " > ").alias("heading_path"), "c.text", "c.overlap", "c.parent", size.alias("n_tokens"))
