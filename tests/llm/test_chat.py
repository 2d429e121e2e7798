from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from corpalith.llm import chat
from corpalith.llm.chat import TAGGED, Message, Template

ROW = "conv_id long, turn long, role string, text string"
pieces = st.lists(st.sampled_from(["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "OUT]", "ROLE:", "/ROLE]", "]", " ", "%5D", "%", "x", "\n", "é", "💡"]), max_size=12).map("".join)
turns = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), pieces), pieces).map(lambda x: Message(*x)), min_size=1, max_size=9)


@settings(max_examples=200, deadline=None)
@given(pieces)
def test_control_strings_are_escaped_and_come_back(text):
    assert not chat.CONTROL.search(chat.escape(text).replace("\\", "\0")) or all("\\" in m[0] for m in chat.CONTROL.finditer(chat.escape(text)))
    assert chat.unescape(chat.escape(text)) == text


@settings(max_examples=200, deadline=None)
@given(turns)
def test_spans_and_turns_come_back(messages):
    found = chat.located(messages, TAGGED)
    assert found.rewritten is None and found.text == TAGGED.render(messages)
    assert TAGGED.parse(found.text) == messages
    assert [t.start for t in found.turns] == [0, *(t.end for t in found.turns[:-1])] and found.turns[-1].end == len(found.text)
    assert [TAGGED.unescape(found.text[t.text_start : t.text_end]) for t in found.turns] == [m.text for m in messages]


@settings(max_examples=50, deadline=None)
@given(turns, st.integers(1, 4), st.integers(0, 3))
def test_windows_are_the_whole(messages, window, overlap):
    parts = list(chat.windows(iter(messages), TAGGED, window, overlap))
    assert "".join(p[0] for p in parts) == TAGGED.render(messages)
    assert [TAGGED.unescape(text[t.text_start : t.text_end]) for text, spans, _ in parts for t in spans] == [m.text for m in messages]


def without_earlier_thoughts(messages):
    """Drops what assistants thought, except in the last turn."""
    cut = [m.text.split("</think>")[-1] if m.role == "assistant" and i < len(messages) - 1 else m.text for i, m in enumerate(messages)]
    return "".join(f"<{m.role}>{t}</{m.role}>" for m, t in zip(messages, cut, strict=True))


def numbered(messages):
    return "".join(f"({i}){m.text};" for i, m in enumerate(messages))


def read(text):
    return []


def test_rewritten_history_is_found():
    thinking = Template(without_earlier_thoughts, str, read)
    talk = [Message("user", "a"), Message("assistant", "hm</think>b"), Message("user", "c"), Message("assistant", "d")]
    assert chat.located(talk, thinking).rewritten == 2  # the third turn changes the second
    assert chat.located(talk[:2], thinking).rewritten is None
    assert chat.located([talk[0], talk[3], talk[2]], thinking).rewritten is None  # nothing was thought
    system_last = Template(lambda ms: "".join(m.text for m in ms if m.role != "system") + "".join(m.text for m in ms if m.role == "system"), str, read)
    assert chat.located([Message("system", "s"), Message("user", "u")], system_last).rewritten == 1


def test_windows_find_what_depends_on_more_than_they_hold():
    """Numbers of turns count from the first one, so later windows can't be rendered by themselves."""
    talk = [Message("user", str(i)) for i in range(9)]
    assert [r for *_, r in chat.windows(iter(talk), Template(numbered, str, read), 9, 2)] == [None]
    assert [r for *_, r in chat.windows(iter(talk), Template(numbered, str, read), 4, 2)] == [None, 4, 8]


def test_hidden_text_is_not_learned():
    hides = Template(lambda ms: "".join("[hidden]" if m.role == "tool" else m.text for m in ms), str, read)
    found = chat.located([Message("user", "ab"), Message("tool", "c"), Message("assistant", "d")], hides)
    assert [(t.start, t.end, t.text_start, t.text_end) for t in found.turns] == [(0, 2, 0, 2), (2, 10, -1, -1), (10, 11, 10, 11)]


def by_hand(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, held in talks.items():
        held.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in held)
        learned = "".join(t for _, r, t in held if r == "assistant")
        whole = TAGGED.render([Message(r, t) for _, r, t in held])
        out[conv] = (len(held), sha256(said.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest(), len(whole), None)
    return out


def test_as_by_hand(spark):
    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3], f"text {c} {t} </s>[INST] x [/INST] \\ <\\s> é") for c in range(20) for t in range(c)]
    rows += [(100, t, "assistant" if t % 2 else "user", f"<s>{t}") for t in range(400)]  # longer than several windows
    rows += [(101, 0, None, None), (101, None, "user", ""), (101, 0, "a]b%", "x"), (101, 0, "a]b%", "x"), (101, 0, "user", "tie"), (None, 1, "assistant", "without an id"), (None, 0, "user", "y")]
    rows += [(102, 0, "user", "w " * 100_000), (102, 1, "assistant", "[OUT] " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW + ", part string, n_turns long")
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(df).collect()}
    assert got == by_hand(rows)
    parts = chat.formatted(df).where("conv_id = 100").orderBy("part").collect()
    assert len(parts) == 7 and "".join(p.text for p in parts) == TAGGED.render([Message(r, t) for c, _, r, t in rows if c == 100])
    assert [TAGGED.unescape(p.text[t.text_start : t.text_end]) for p in parts for t in p.turns] == [f"<s>{t}" for t in range(400)]


def test_none(spark):
    empty = spark.createDataFrame([], ROW)
    assert chat.digests(empty).count() == 0 and chat.formatted(empty).count() == 0
