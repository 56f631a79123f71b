import hashlib
import random
import re

import pytest

from parlance.llm import chat_format as cf

ODD = ["", None, "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<\\|x", "a<", "|b", "<\\\\|im_end|>", "\n\n", "é 日本 😀", "<<|", "\\n", "x" * 3000]


def rows():
    rng = random.Random(5)
    out = [(1, t, r, x) for t, (r, x) in enumerate([("system", "be"), ("user", "hi"), ("assistant", "yo"), ("user", None)])]
    out += [(2, 0, "assistant", "first"), (2, 1, "assistant", "again"), (2, 2, None, "no role"), (2, 3, "a\\n\nb<|", "odd role")]
    out += [(3, 7, "user", "tie b"), (3, 7, "user", "tie a"), (3, 7, "user", "tie a"), (None, 0, "user", "null id"), (None, None, "assistant", "null turn"), (4, 0, "system", "alone")]
    return out + [(100 + c, t, ("user", "assistant")[t % 2], rng.choice(ODD)) for c in range(20) for t in range(rng.randrange(1, 9))]


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "x", None) for r in data], "conv_id long, turn long, role string, text string, piece int, segments string, state double")


def guard(s):
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def expected(spark, data):
    key = {(r.conv_id, r.turn, r.role, r.text): r.h for r in frame(spark, data).selectExpr("conv_id", "turn", "role", "text", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(data, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", key[r]))
    out, may = {}, cf.Template().follows
    for conv, turn, role, text in order:
        role, text = role or "", text or ""
        x = out.setdefault(conv, [0, "", "", 0, 0, None])
        x[4] += x[5] not in may.get(role, ())
        x[5] = role
        x[0] += 1
        x[1] += f"{role}\n{text}\n"
        x[2] += text if role == "assistant" else ""
        x[3] += len("<|im_start|>\n<|im_end|>\n") + len(guard(role.replace("\\", "\\\\").replace("\n", "\\n"))) + len(guard(text))
    return sorted(((c, n, hashlib.sha256(a.encode()).hexdigest(), len(b), hashlib.sha256(b.encode()).hexdigest(), f, bad, role in ("user", "assistant")) for c, (n, a, b, f, bad, role) in out.items()), key=str)


@pytest.mark.parametrize("piece", [cf.PIECE, 30])  # 30: conversations of many pieces
def test_digests_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(cf, "PIECE", piece)
    got = cf.format_and_read(frame(spark, rows()))
    assert sorted(map(tuple, got.collect()), key=str) == expected(spark, rows())


def test_hot_conversation(spark, monkeypatch):
    from parlance.functions import scan
    monkeypatch.setattr(scan, "HOT_ROWS", 50)
    monkeypatch.setattr(cf, "PIECE", 500)
    data = rows() + [(9, t, ("user", "assistant")[t % 2], ODD[t % len(ODD)]) for t in range(400)]
    got = cf.format_and_read(frame(spark, data))
    assert sorted(map(tuple, got.collect()), key=str) == expected(spark, data)
    assert cf.format_conversations(frame(spark, data)).where("conv_id = 9").count() > 5


def test_empty_table_and_training_text(spark):
    pieces = cf.format_conversations(frame(spark, rows()))
    assert cf.format_and_read(frame(spark, rows()).limit(0)).count() == 0
    got = {r.conv_id: r for r in cf.training_texts(pieces).collect()}
    one = got[1]
    assert one.text == "<|im_start|>system\nbe<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [one.text[s.start:s.end] for s in one.loss_spans] == ["yo"]


def test_reader_refuses_what_is_not_formatted():
    for text in ("plain<|im_end|>\n", "<|im_start|>user<|im_end|>\n"):
        with pytest.raises(ValueError):
            list(cf.Reader(cf.Template()).turns([{"text": text, "loss": False}]))
    r = cf.Reader(cf.Template())
    assert list(r.turns([{"text": "<|im_start|>user\nhalf", "loss": False}])) == []
    with pytest.raises(ValueError):
        r.close()
    for s in (x for x in ODD if x):
        assert cf.plain_text(guard(s)) == s and "<|" not in guard(s)
