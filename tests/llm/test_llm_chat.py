"""Chat formatting: folding against a plain replay, exact reading back, and the digests of whole conversations."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from llm_data import CLASHING, counted
from parity.llm import chat
from parity.llm.queries import TRICKY

MARKS = st.text(st.sampled_from("#\\/<>turn :\n é😀A"), max_size=40)


@given(st.lists(st.tuples(MARKS, MARKS), max_size=6))
def test_turns_are_read_back_exactly(said):
    text, learned = "", []
    for role, body in said:
        turn, start, end = chat.rendered(role, body)
        learned.append(chat.unescaped((text + turn)[len(text) + start : len(text) + end]))
        text += turn
    assert list(chat.turns(text)) == said
    assert learned == [body for _, body in said]
    assert text.count("</turn>") == len(said) and text.count("###") == len(said)


def digest(conv, said):
    """The row of a conversation of (role, text) turns, but for formatted_chars."""
    learned = "".join(t for r, t in said if r == "assistant")
    all_turns = "".join(f"{r}\n{t}\n" for r, t in said)
    return (conv, len(said), hashlib.sha256(all_turns.encode()).hexdigest(), len(learned),
            hashlib.sha256(learned.encode()).hexdigest(), sum(len(chat.rendered(r, t)[0]) for r, t in said))


def digests(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.selectExpr("*", *(f"'z' AS `{c}`" for c in CLASHING))
    log = chat.log_of_turns(df, "conv_id", "turn", "role", "text")
    segments = chat.formatted(log, "conv_id", ["turn", "h", "row"], "place", "kind", "role", "text")
    return chat.read_back(chat.written(segments))


@pytest.mark.parametrize("segment", [chat.SEGMENT, 40])
def test_digests_are_those_of_the_turns(spark, segment, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rng = random.Random(4)
    rows = []
    for conv in [*range(30), None, 2**53 + 1, -(2**63), -7]:
        for turn in range(rng.randrange(1, 6)):
            said = rng.choice([TRICKY, "", None, "plain words", "é😀" * 9, "a\nb\\", "#" * 7])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "a:b: c"]), said))
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t} " * 9) for t in range(400)]  # one long conversation
    rows.append((501, 0, "assistant", "x" * 300_000))
    rng.shuffle(rows)
    expected = {}
    for conv, _, role, text in sorted(rows, key=lambda r: r[1]):
        expected.setdefault(conv, []).append((role or "", text or ""))
    found = digests(spark, rows).collect()
    assert counted(found) == counted(digest(c, said) for c, said in expected.items())


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same")]
    assert counted(digests(spark, rows).collect()) == counted([digest(1, [r[2:] for r in rows])])
    assert digests(spark, []).count() == 0


def replay(events):
    """Conversations of turns by replaying a sorted log message by message."""
    out = {}
    for conv, message in sorted({e[:2] for e in events}):
        text, role = None, None
        for _, _, _, kind, who, said in sorted(e for e in events if e[:2] == (conv, message)):
            if kind == "start" or kind == "message" or text is None:
                text, role = said, who
            elif kind == "delta":
                text += said
            elif kind in ("edit", "regenerate"):
                text = said
        out.setdefault(conv, []).append((role, text))
    return out


def test_deltas_edits_and_regenerations(spark):
    rng = random.Random(9)
    events = []
    for conv in range(25):
        place = 0
        for message in range(4):
            who = "assistant" if message % 2 else "user"
            events.append((conv, message, place, rng.choice(["start", "message"]), who, rng.choice(["", "begin "])))
            for _ in range(rng.randrange(6)):
                place += 1
                kind = rng.choice(["delta", "delta", "delta", "edit", "regenerate"])
                events.append((conv, message, place, kind, who, "" if kind == "regenerate" else f"{kind}{place} "))
            place += 1
    shuffled = events[:]
    rng.shuffle(shuffled)
    log = spark.createDataFrame(
        [*shuffled, (3, 1, 999, "typing", "user", "left out")],
        "conv bigint, message bigint, place bigint, kind string, role string, text string",
    )
    rows = chat.read_back(chat.formatted(log, "conv", ["message"], "place", "kind", "role", "text"))
    assert counted(rows.collect()) == counted(digest(c, said) for c, said in replay(events).items())
