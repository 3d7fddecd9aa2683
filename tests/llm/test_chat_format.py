import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracewell.llm import catalog, chat_format
from tracewell.llm.chat_format import PART, escape, unescape

CONTROL = ["<|turn|>", "<|text|>", "<|end|>\n", "<|part|>", "<|image:0|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\<SYS>>",
           "<\\|end|>", "[\\\\INST]", "\\", "<", "[", "<|a<|end|>", "<|im_start|>", "é", "\n", "😀"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(CONTROL), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    hidden = escape(text)
    assert unescape(hidden) == text
    for control in ("<|turn|>", "<|text|>", "<|end|>", "<|part|>", "<|image:0|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert control not in hidden


def rows_of(rng, many=2500):
    """Conversations with repeated, null and unordered turns, one of very many rows, and a null id."""
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(CONTROL + ["word "] * 9) for _ in range(rng.randint(0, 12)))
    role = lambda: rng.choice(["user", "assistant", "system", None, "tool <|end|>", ""])
    rows = [(c, t, role(), text()) for c in range(60) for t in rng.sample(range(9), rng.randint(1, 8))]
    rows += [(1, 3, "user", "same"), (1, 3, "user", "same"), (2, None, "assistant", "no turn"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"{t} {text()}") for t in range(many)]
    rows += [(1001, 0, "assistant", "x" * 3_000_000), (1001, 1, "user", "y" * 2_000_000)]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def plain(rows):
    found = {}
    for key, turns in in_order(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        found[key] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                      hashlib.sha256(loss.encode()).hexdigest(),
                      sum(len(f"<|turn|>{escape(r)}<|text|>{escape(t)}<|end|>\n") for r, t in turns))
    return found


def test_conversations_read_back(spark):
    rows = rows_of(random.Random(5))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("x") for c in ("part", "block", "whole", "parts", "formatted")}).drop("parts")
    blocks = chat_format.format_turns(chat_format.plain_turns(frame))
    assert blocks.filter("whole").count() and blocks.filter("conv_id = 1000").count() > 2
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_digests(blocks).collect()}
    assert got == plain(rows)
    empty = frame.limit(0)
    assert chat_format.read_digests(chat_format.format_turns(chat_format.plain_turns(empty))).count() == 0


def test_query_adds_one_conversation(spark):
    given_rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    more = [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    got = {r.conv_id: tuple(r)[1:] for r in catalog.op11_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain(given_rows + more)


def part(kind, **more):
    return tuple({"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None, **more}.values())


def test_parts_become_placeholders_in_order(spark):
    content = [part("text", text="see <|image:0|> "), part("image", ref="a.png", width=280, height=57), part("audio", ref="b.wav", seconds=1.01),
               part("text", text="and"), part("text", text=""), part("document", ref="c.pdf", pages=3), part("video", ref="d"), None,
               part("image", ref="e", width=0, height=5), part("audio", seconds=float("nan")), part(None)]
    turns = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", [part("text", text="yes"), part("image", ref="f"), part("text", text="no")]),
                                   (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{PART}>")
    row, = chat_format.format_turns(turns).collect()
    text = row.formatted
    assert text.startswith("<|turn|>user<|text|>see <\\|image:0|> <|image:0|><|audio:1|>and<|part|><|document:2|><|other:3|><|image:4|><|audio:5|><|other:6|><|end|>\n")
    assert [(a.turn, a.number, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, 0, "image", "a.png", 11 * 3), (0, 1, "audio", "b.wav", 26), (0, 2, "document", "c.pdf", 1920), (0, 3, "other", "d", 1), (0, 4, "image", "e", 1),
        (0, 5, "audio", None, 1), (0, 6, "other", None, 1), (1, 0, "image", "f", 1)]
    assert all(text[a.at:].startswith(f"<|{a.kind}:{a.number}|>") for a in row.attachments)
    assert [text[s.begin:s.end] for s in row.loss] == ["yes", "no"]
    assert list(chat_format.read_turns(text)) == [
        ("user", [("text", "see <|image:0|> "), ("image", 0), ("audio", 1), ("text", "and"), ("text", ""), ("document", 2), ("other", 3), ("image", 4),
                  ("audio", 5), ("other", 6)]),
        ("assistant", [("text", "yes"), ("image", 0), ("text", "no")]), ("user", [("text", "")])]
    with pytest.raises(ValueError):
        list(chat_format.read_turns(text[:-1]))
