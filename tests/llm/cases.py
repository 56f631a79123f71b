"""Rows with nulls, empty and long texts, ties and repeats, and plain definitions to hold results against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts():
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "other")
    passage = " ".join(f"p{i}" for i in range(20))
    return [
        (5, base), (3, base), (9, base.replace(" ", " \n")), (7, near), (8, None), (2, ""), (11, " \t\n"), (12, "One two"), (13, "one TWO"),
        (14, f"alpha beta {passage} gamma delta"), (15, f"x {passage} y"), (16, f"{passage} {passage}"), (3, base), (3, f"second text {passage}"),
        (17, "é ñ ü ß 日本語 " * 30), (18, "word " * 5000), (19, "a" * 3000), (20, "idiot you are"), (None, base), (None, None), (None, "lonely null id text"),
        (21, " ".join(f"q{i % 7}" for i in range(40))), (22, "tail " + passage), (23, "<|endoftext|> and <b>tags</b> &amp; 's 're 12345"),
    ]


def frame(spark, rows=None, extra=True):
    """Documents with the usual columns and some whose names clash with inner ones."""
    rows = texts() if rows is None else rows
    full = [(i, t, None if n % 3 == 0 else f"src{n % 2}", None, len(t or ""), "k", 1.0, n) for n, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    if extra:
        return spark.createDataFrame(full, schema + ", kept string, score double, size int")
    return spark.createDataFrame([r[:5] for r in full], schema)


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
