"""Conversations as formatted text with a loss mask, through templates that are black boxes.

A template is any function from messages to text. It is rendered for successive prefixes of a
conversation; where an output begins with the one before it, what was added is the new turn's span.
Where it does not, the template has rewritten history (as templates do that drop earlier reasoning, or
move a system text), and the conversation is marked. Where the text lies inside its span is found by
rendering the prefix once more with a mark in the text's place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpalith.llm.common import like

#: Stands for a turn's text while its place is looked for: a character for private use that templates don't write.
MARK = "\ue000"
#: Turns rendered as prefixes of one window, and turns of the window before that begin the next one.
WINDOW, OVERLAP = 64, 4

#: The control strings of the template ``tagged``, with any backslashes that escape them.
CONTROL = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|OUT\]|ROLE:|/ROLE\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|OUT\]|ROLE:|/ROLE\])")
TURN = re.compile(r"<s>(?:(?P<user>\[INST\]) (?P<said>.*?) \[/INST\]|(?P<assistant>\[OUT\]) (?P<answer>.*?)|\[ROLE:(?P<role>[^\]]*)\] (?P<other>.*?) \[/ROLE\])</s>", re.DOTALL)


class Message(NamedTuple):
    role: str
    text: str


class Template(NamedTuple):
    """``render`` is the black box; ``unescape`` takes back what it does to control strings inside a text, ``parse`` reads turns back."""

    render: Callable[[list[Message]], str]
    unescape: Callable[[str], str]
    parse: Callable[[str], list[Message]]


class Turn(NamedTuple):
    """A turn's span and, inside it, its text's, as offsets in the formatted conversation. ``text`` is -1, -1 where the template hides it."""

    role: str
    start: int
    end: int
    text_start: int
    text_end: int


def escape(text: str) -> str:
    """One backslash more after the first character of every control string, however many there are already."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """The inverse of ``escape`` on all texts."""
    return ESCAPED.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    return role.replace("%", "%25").replace("]", "%5D").replace("<", "%3C").replace("[", "%5B")


def _role_back(role: str) -> str:
    return role.replace("%5B", "[").replace("%3C", "<").replace("%5D", "]").replace("%25", "%")


def _tagged(messages: list[Message]) -> str:
    out = []
    for role, text in messages:
        text = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {text} [/INST]</s>")
        elif role == "assistant":
            out.append(f"<s>[OUT] {text}</s>")
        else:
            out.append(f"<s>[ROLE:{_role(role)}] {text} [/ROLE]</s>")
    return "".join(out)


def _tagged_turns(formatted: str) -> list[Message]:
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        if found["user"]:
            turns.append(Message("user", unescape(found["said"])))
        elif found["assistant"]:
            turns.append(Message("assistant", unescape(found["answer"])))
        else:
            turns.append(Message(_role_back(found["role"]), unescape(found["other"])))
        at = found.end()
    return turns


#: Turns in tags, each with its role; control strings inside texts are escaped, so all that is written can be read back.
TAGGED = Template(_tagged, unescape, _tagged_turns)


class Formatted(NamedTuple):
    text: str
    turns: list[Turn]
    rewritten: int | None


def located(messages: list[Message], template: Template, known: int = 0) -> Formatted:
    """The formatted text of ``messages``, each turn's spans, and the first turn that made the template rewrite what came before (or None).

    The first ``known`` turns are rendered as one prefix, and have no spans. After a rewrite the spans up to
    there no longer hold; the turns that follow have none.
    """
    before = template.render(messages[:known]) if known else ""
    turns: list[Turn] = []
    for n in range(known + 1, len(messages) + 1):
        now = template.render(messages[:n])
        if not now.startswith(before):
            return Formatted(template.render(messages), [], n - 1)
        role = messages[n - 1].role
        marked = template.render([*messages[: n - 1], Message(role, MARK)])
        at = marked.find(MARK, len(before))
        if at < 0 or not marked.startswith(before):
            turns.append(Turn(role, len(before), len(now), -1, -1))
        else:
            turns.append(Turn(role, len(before), len(now), at, len(now) - (len(marked) - at - len(MARK))))
        before = now
    return Formatted(before, turns, None)


def windows(messages: Iterator[Message], template: Template, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[str, list[Turn], int | None]]:
    """(added text, turns with offsets in it, turn at which history was rewritten) of successive windows of a conversation.

    Up to ``window`` turns every prefix is rendered from the first turn on. A longer conversation goes on
    with its last ``overlap`` turns as the beginning, so the work grows with its length and not with its
    square. The overlap's last turn must come out in the new window as it did in the old; a template whose
    turns depend on what lies further back counts as rewriting history.
    """
    held: list[Message] = []
    known, seen, last = 0, 0, ""
    ended = False
    while not ended:
        for message in messages:
            held.append(message)
            if len(held) - known == window:
                break
        else:
            ended = True
        if len(held) == known:
            return
        found = located(held, template, known)
        if found.rewritten is not None:
            yield found.text, [], seen + found.rewritten - known
        else:
            start = found.turns[0].start
            if known and not template.render(held[:known]).endswith(last):
                yield found.text[start:], [], seen
            else:
                yield found.text[start:], [Turn(t.role, t.start - start, t.end - start, *(x - start if x >= 0 else x for x in t[3:])) for t in found.turns], None
            last = found.text[found.turns[-1].start :]
        seen += len(held) - known
        held = held[-overlap:] if overlap else []
        known = len(held)


class _Digest:
    """What a conversation's row says, gathered window by window."""

    def __init__(self, conv: object):
        self.conv, self.n_turns, self.chars, self.loss_chars, self.rewritten = conv, 0, 0, 0, None
        self.turns, self.loss = sha256(), sha256()

    def add(self, text: str, turns: list[Turn], rewritten: int | None, template: Template, roles: frozenset[str]) -> None:
        self.chars += len(text)
        if rewritten is not None and self.rewritten is None:
            self.rewritten = rewritten
        read = template.parse(text)
        for message in read:
            self.n_turns += 1
            self.turns.update(f"{message.role}\n{message.text}\n".encode())
        for message, turn in zip(read, turns, strict=False):
            if message.role in roles and turn.text_start >= 0:
                learned = template.unescape(text[turn.text_start : turn.text_end])
                self.loss_chars += len(learned)
                self.loss.update(learned.encode())


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Message]]:
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield conv, Message(role, text)


def _by_conversation(rows: Iterator[tuple[object, Message]]) -> Iterator[tuple[object, Iterator[Message]]]:
    """Each conversation with its messages as they come; the next one begins where these end."""
    ahead = next(rows, None)

    def messages(conv: object) -> Iterator[Message]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            message = ahead[1]
            ahead = next(rows, None)
            yield message

    while ahead is not None:
        conv = ahead[0]
        mine = messages(conv)
        yield conv, mine
        for _ in mine:  # whatever was not read
            pass


def _in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text) with whole conversations together and turns in order; a null role or text is empty."""
    rows = like(conversations, "conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(conversations: DataFrame, template: Template = TAGGED, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(conv_id, part, text, turns, rewritten_at): the formatted conversations, window by window, with each turn's spans.

    Texts of a conversation's parts in order are its formatted text; ``turns`` has role, start, end, text_start
    and text_end, offsets in the part. ``rewritten_at`` is the turn, from 0, that made the template change
    what it had written before; such a part has no spans. See ``digests`` for nulls and ties.
    """
    rows = _in_order(conversations)
    kind = rows.schema["conv_id"].dataType
    conv_type = to_arrow_type(kind)
    spans = pa.list_(pa.struct([("role", pa.string()), *((c, pa.int64()) for c in Turn._fields[1:])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, messages in _by_conversation(_conversations(batches)):
            for part, (text, turns, rewritten) in enumerate(windows(messages, template, window, overlap)):
                columns = [pa.array([conv], conv_type), pa.array([part], pa.int32()), pa.array([text]), pa.array([[t._asdict() for t in turns]], spans), pa.array([rewritten], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "text", "turns", "rewritten_at"])

    turn = "struct<role string, start bigint, end bigint, text_start bigint, text_end bigint>"
    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, part int, text string, turns array<{turn}>, rewritten_at long")


def digests(conversations: DataFrame, template: Template = TAGGED, learned: tuple[str, ...] = ("assistant",), window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten_at) of every conversation.

    Everything is read back from the formatted text: turns through the template's ``parse``, learned texts
    through the located spans. Turns go by ``turn``, a null one first, equal ones by role and text; repeated
    rows are turns of their own. A null role or text is empty, rows with a null ``conv_id`` are one
    conversation. An empty table gives no rows; other columns play no part.

    A conversation's turns pass through one task in order, as a sha256 over them has no parts; the task
    holds a window of them at a time, whatever their number.
    """
    rows = _in_order(conversations)
    kind = rows.schema["conv_id"].dataType
    roles = frozenset(learned)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_at"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[_Digest] = []

        def flush() -> pa.RecordBatch:
            values = zip(*((d.conv, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars, d.rewritten) for d in done), strict=True)
            columns = [pa.array(v, t) for v, t in zip(values, types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for conv, messages in _by_conversation(_conversations(batches)):
            digest = _Digest(conv)
            for text, turns, rewritten in windows(messages, template, window, overlap):
                digest.add(text, turns, rewritten, template, roles)
            done.append(digest)
            if len(done) == 4096:
                yield flush()
        if done:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at long")

