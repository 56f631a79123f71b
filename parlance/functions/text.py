"""Text expressions.  All but the Unicode decomposition run in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: contractions and their replacements, applied in this order
CONTRACTIONS = [
    ("what's", "what is"), ("can't", "can not"), ("i'm", "i am"), ("n't", " not"), ("'s", ""),
    ("'ve", " have"), ("'re", " are"), ("'d", " would"), ("'ll", " will"),
]

# fixed values: stop words of the label classifier
STOP_WORDS = ["the", "a", "an", "of", "to", "for", "in", "on", "that", "this", "and", "at", "between", "is", "are",
              "am", "i", "do", "does", "be", "if", "please", "s", "there", "any", "have"]

# fixed values: words of the chat interface that carry no topic
CHAT_WORDS = ["yes", "new", "search"]

# fixed values: code point ranges of CJK ideographs
CJK = (r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
       r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}")


def _c(e: Column | str) -> Column:
    return F.col(e) if isinstance(e, str) else e


def clean_text(e) -> Column:
    out = F.lower(_c(e))
    for short, long in CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    return F.trim(F.regexp_replace(out, "[^a-zA-Z0-9 ]+", ""))


def split_words(e) -> Column:
    """Whitespace split without empty words."""
    return F.filter(F.split(_c(e), r"\s+"), lambda w: w != "")


def words(e, stop: list[str] = STOP_WORDS, drop: list[str] = CHAT_WORDS) -> Column:
    """Alphabetic words in lower case, without interface words and stop words."""
    w = F.filter(split_words(e), lambda x: ~x.isin(drop) & x.rlike(r"^\p{L}+$"))
    return F.filter(F.transform(w, F.lower), lambda x: ~x.isin(stop))


def trigrams(word_array: Column) -> Column:
    """Character trigrams of ``#word#`` for every word."""
    def grams(w: Column) -> Column:
        marked = F.concat(F.lit("#"), w, F.lit("#"))
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(marked, i, F.lit(3)))

    return F.flatten(F.transform(F.filter(word_array, lambda w: F.length(w) > 0), grams))


def label_trigrams(e, stop: list[str] = STOP_WORDS) -> Column:
    return trigrams(F.filter(F.split(_c(e), " "), lambda w: ~w.isin(stop)))


def pattern_tokens(e, pattern: str = r"[\p{L}\p{N}_]{2,}") -> Column:
    return F.regexp_extract_all(F.lower(_c(e)), F.lit(pattern), F.lit(0))


@F.pandas_udf(T.StringType())
def _decompose(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFD")


def basic_tokens(e) -> Column:
    """Lower-case tokens without control characters and accents; CJK characters and
    punctuation stand alone.  Only text beyond ASCII goes through Python."""
    t = F.regexp_replace(_c(e), r"[\x{0}\x{FFFD}]|[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, rf"([{CJK}])", " $1 "), r"[\s\p{Zs}]+", " "))
    t = F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(_decompose(t), r"\p{Mn}", "")).otherwise(t)
    t = F.regexp_replace(t, r"([\p{P}$+<=>^`|~])", " $1 ")
    return split_words(t)


def pair_lines(e) -> dict[str, Column]:
    """``a ||| b`` to two texts; any other line is text a alone."""
    e = F.trim(_c(e))
    a = F.regexp_extract(e, r"^(.*) \|\|\| (.*)$", 1)
    paired = e.rlike(r"^(.*) \|\|\| (.*)$")
    return {"text_a": F.when(paired, a).otherwise(e),
            "text_b": F.when(paired, F.regexp_extract(e, r"^(.*) \|\|\| (.*)$", 2))}


# --- model inputs -------------------------------------------------------------

def pair_limits(a: Column, b: Column, limit: Column) -> tuple[Column, Column]:
    """Lengths after trimming the longer side until a + b <= limit."""
    half_up, half_down = F.ceil(limit / 2), F.floor(limit / 2)
    over = a + b > limit
    return (F.when(over, F.least(a, F.greatest(half_up, limit - b))).otherwise(a).cast("int"),
            F.when(over, F.least(b, F.greatest(half_down, limit - a))).otherwise(b).cast("int"))


def model_features(a: Column, b: Column | None, n: int) -> dict[str, Column]:
    """``[CLS] a [SEP] b [SEP]`` cut to n tokens, with mask and segments padded to n."""
    if b is None:
        tokens = F.concat(F.array(F.lit("[CLS]")), F.slice(a, 1, n - 2), F.array(F.lit("[SEP]")))
        first = F.size(tokens)
    else:
        na, nb = pair_limits(F.size(a), F.size(b), F.lit(n - 3))
        tokens = F.concat(F.array(F.lit("[CLS]")), F.slice(a, F.lit(1), na), F.array(F.lit("[SEP]")),
                          F.slice(b, F.lit(1), nb), F.array(F.lit("[SEP]")))
        first = na + 2
    size = F.size(tokens)
    pad = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(0), n)), 1, n)
    return {"tokens": tokens, "mask": pad(F.array_repeat(F.lit(1), size)),
            "segments": pad(F.concat(F.array_repeat(F.lit(0), first), F.array_repeat(F.lit(1), size - first)))}


def mask_count(n: Column, most: int, share: float = 0.15) -> Column:
    """min(most, max(1, round half even of n * share))."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int")))


def span_count(length: Column, n_query: Column, n_max: int, stride: int) -> tuple[Column, Column, Column]:
    """(tokens per span, step, number of spans) of a sliding window over a document."""
    room = F.lit(n_max) - n_query - 3
    step = F.least(room, F.lit(stride))
    return room, step, (1 + F.greatest(F.lit(0), F.ceil((length - room) / step))).cast("int")
