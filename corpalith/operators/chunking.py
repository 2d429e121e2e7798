"""Documents to blocks to chunks: an order-dependent fold, done per document in Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Sizes in estimated tokens (four characters each), runts, overlap and parent text in characters.
TARGET, MOST, RUNT, OVERLAP, PARENT = 220, 420, 240, 160, 3600

_UNSEEN = re.compile(r"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_BLOCK = re.compile(r"<(h[1-6]|p|li|table|pre|blockquote|figcaption)\b[^>]*>(.*?)(?=</\1\s*>|<(?:h[1-6]|p|li|table|pre|blockquote|figcaption)\b|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def parse_html(page: str) -> list[tuple[str, int, str]]:
    """(kind, heading level, text) of the block elements in page order; empty blocks are left out."""
    out = []
    for m in _BLOCK.finditer(_UNSEEN.sub(" ", page)):
        name = m[1].lower()
        text = html.unescape(_TAG.sub(" ", m[2]))
        text = text.strip("\n") if name == "pre" else " ".join(text.split())
        if text:
            kind = {"p": "paragraph", "li": "list_item", "pre": "code", "blockquote": "quote", "figcaption": "caption"}.get(name, name)
            out.append(("heading", int(name[1]), text) if name[0] == "h" else (kind, 0, text))
    return out


def parse_text(text: str) -> list[tuple[str, int, str]]:
    """Lines of plain text as paragraphs; ``#`` lines are headings."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        marks = len(line) - len(line.lstrip("#"))
        if 0 < marks <= 6 and line[marks:].strip():
            out.append(("heading", marks, line[marks:].strip()))
        elif line:
            out.append(("paragraph", 0, line))
    return out


def _size(text: str) -> int:
    return max(1, len(text) // 4)


def _tail(text: str) -> str:
    """The end of a chunk, from a sentence or word start."""
    if len(text) <= OVERLAP:
        return text
    cut = text[-OVERLAP:]
    stop = cut.find(". ")
    return cut[stop + 2 :] if stop >= 0 else cut[cut.find(" ") + 1 :]


def chunk(blocks: list[tuple[str, int, str]]) -> list[tuple[str, str, str, str]]:
    """(heading path, text, overlap, parent text) of the chunks of a document.

    Blocks are packed under their heading path up to the target; a block that would pass the most
    starts a new chunk; tables and code stand alone. What is only a heading is no chunk, and the
    end of a chunk goes with the next of its section. Last, a chunk under ``RUNT`` characters takes
    the next one in, of whatever section, as long as both stay within six characters a token of the
    target; the first one's heading path, overlap and parent text stay. The parent text is the
    section's, ``PARENT`` characters at most.
    """
    sections: list[tuple[str, list[tuple[str, str]]]] = []
    path: list[str] = []
    for kind, level, text in blocks:
        if kind == "heading":
            path = [*path[: level - 1], text]
            sections.append((" > ".join(path), [(kind, "#" * level + " " + text)]))
        else:
            if not sections:
                sections.append(("", []))
            sections[-1][1].append((kind, f"- {text}" if kind == "list_item" else text))
    out: list[list[str]] = []
    for where, parts in sections:
        parent = "\n\n".join(text for _, text in parts)[:PARENT]
        held: list[tuple[str, str]] = []
        over = ""
        for place, (kind, text) in enumerate([*parts, ("end", "")]):
            alone = kind in ("table", "code")
            if held and (alone or kind == "end" or sum(_size(t) for _, t in held) + _size(text) > MOST):
                if any(k != "heading" for k, _ in held):
                    out.append([where, "\n\n".join(t for _, t in held), over, parent])
                    over = _tail(out[-1][1])
                held = []
            if place < len(parts):
                held.append((kind, text))
            if held and (alone or sum(_size(t) for _, t in held) >= TARGET) and any(k != "heading" for k, _ in held):
                out.append([where, "\n\n".join(t for _, t in held), over, parent])
                over, held = _tail(out[-1][1]), []
    merged: list[list[str]] = []
    for c in out:
        if merged and len(merged[-1][1]) < RUNT and len(merged[-1][1]) + 2 + len(c[1]) <= TARGET * 6:
            merged[-1][1] += "\n\n" + c[1]
        else:
            merged.append(c)
    return [tuple(c) for c in merged]


#: Characters of the rows that a task holds before it passes them on.
HELD = 4 << 20


def _frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """``rows`` in frames of about ``HELD`` characters, however many a batch of documents has."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= HELD:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def chunks(documents: DataFrame, id_col: str, text_col: str, kind: str = "text") -> DataFrame:
    """(id, ordinal, heading_path, text, overlap, parent, n_tokens) of every document; null and empty ones have none."""
    parse = parse_html if kind == "html" else parse_text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((i, n, *c, _size(c[1])) for i, text in zip(frame["id"], frame["text"], strict=True) for n, c in enumerate(chunk(parse(text or ""))))
            yield from _frames(rows, ["id", "ordinal", "heading_path", "text", "overlap", "parent", "n_tokens"])

    picked = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    return picked.mapInPandas(run, f"id {picked.schema['id'].dataType.simpleString()}, ordinal int, heading_path string, text string, overlap string, parent string, n_tokens int")


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, kind, level, text) of the blocks of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((i, n, *b) for i, page in zip(frame["page_id"], frame["html"], strict=True) for n, b in enumerate(parse_html(page or "")))
            yield from _frames(rows, ["page_id", "ordinal", "kind", "level", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ordinal int, kind string, level int, text string")
