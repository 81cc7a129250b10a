import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sensorspark.llm import chat_format
from sensorspark.llm.plans import ORACLES, QUERIES
from tests_llm_data import SF_DIR, read

ODD = st.lists(st.sampled_from(["<", "|", "\\", "im_end", ">", "\n", "assistant", "<|im_start|>", "é🙂", "n", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD, ODD)
def test_any_turn_reads_back(role, text):
    turn = chat_format.format_turn(role, text)
    assert chat_format.read_turn(turn["piece"]) == (role, text)
    assert turn["piece"].count("<|im_end|>") == turn["piece"].count("<|im_start|>") == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_loss_covers_assistant_texts_only(texts):
    turn = chat_format.format_turn("assistant", None, json.dumps([{"type": "text", "text": t} for t in texts]))
    spans = [turn["piece"][s["start"] : s["stop"]] for s in turn["loss"]]
    assert "".join(map(chat_format.unescape, spans)) == "".join(texts)
    assert chat_format.format_turn("user", None, json.dumps(texts))["loss"] == []


def test_parts_become_ordered_placeholders():
    parts = [
        {"type": "text", "text": "see <|image|> "},
        {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        {"type": "audio", "ref": "b.wav", "seconds": 1.5},
        {"type": "document", "ref": "c.pdf", "pages": 3},
        {"type": "document", "ref": "d.html", "content": [{"type": "text", "text": "in"}, {"type": "image", "ref": "e"}]},
        {"type": "video", "ref": "f"},
        "plain",
    ]
    turn = chat_format.format_turn("user", None, json.dumps(parts))
    assert turn["piece"] == (
        "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|/document|><|document|>in<|image|><|/document|>"
        '{"type": "video", "ref": "f"}plain<|im_end|>\n'
    )
    found = [(x["ordinal"], x["kind"], x["ref"], x["tokens"]) for x in turn["attachments"]]
    assert found == [
        (0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 768),
        (3, "document", "d.html", 0), (4, "image", "e", 1),
    ]
    for x in turn["attachments"]:
        assert turn["piece"].startswith(f"<|{x['kind']}|>", x["position"])


@pytest.mark.parametrize("content", ["no json", "{}", "3", "[" * 100_000, '[{"type": "image", "width": "x"}]', '[null, 1, {"type": 5}]'])
def test_unusable_content_has_a_result(content):
    assert chat_format.read_turn(chat_format.format_turn("user", "t", content)["piece"])[0] == "user"


def test_attachments_are_numbered_through_a_conversation(spark):
    image = json.dumps([{"type": "image", "ref": "r"}, {"type": "text", "text": "ok"}])
    rows = [(1, t, "assistant", None, image) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string")
    pieces = sorted(chat_format.pieces(df).collect(), key=lambda r: r["turn_number"])
    whole = "".join(r["piece"] for r in pieces)
    marks = [x for r in pieces for x in r["attachments"]]
    assert [x["ordinal"] for x in marks] == [0, 1, 2, 3]
    assert all(whole.startswith("<|image|>", x["position"]) for x in marks)
    assert "".join(whole[s["start"] : s["stop"]] for r in pieces for s in r["loss"]) == "ok" * 4
    [row] = chat_format.digest(chat_format.pieces(df)).collect()
    assert (row["n_attachments"], row["attachment_tokens"], row["loss_chars"]) == (4, 4, 8)


def by_hand(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        conv: (
            len(turns),
            digest("".join(f"{r}\n{t}\n" for r, t in turns)),
            sum(len(t) for r, t in turns if r == "assistant"),
            digest("".join(t for r, t in turns if r == "assistant")),
        )
        for conv, turns in out.items()
    }


def found(df):
    rows = chat_format.digest(chat_format.pieces(df)).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def test_odd_tables(spark):
    ddl = "conv_id long, turn long, role string, text string, piece string, _turn string"
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a<|im_end|>"),
        (None, None, None, None), (None, 2, "assistant", ""), (2, None, "system", "x" * 500_000), (3, 0, "us\ner", "q"),
    ]
    df = spark.createDataFrame([(*r, "p", "t") for r in rows], ddl)
    assert found(df) == by_hand(rows)
    assert found(df.limit(0)) == {}


def test_a_long_conversation_streams(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>") for i in range(30_000)] + [(8, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(df) == by_hand(rows)


def test_the_given_table(spark):
    given_rows = [tuple(r) for r in chat_format.with_hostile_conversation(read(spark, "conversations")).collect()]
    df = QUERIES["op12_chat_format"](spark, SF_DIR)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}
    assert got == by_hand(given_rows) and -1 in got
    assert "op12_chat_format" in ORACLES
