"""Per-sender event sequences: sessions, interleaved turns, answered questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.expr import count_actions
from parlance.functions.scan import (
    before, find_skew, lag, last_known, last_known_before, last_n_known_before, lead, ordered,
    position, running, total,
)

SESSION_GAP = 21_600  # seconds


def sessionise(df: DataFrame, key: str, ts: Column | str, tiebreak: list[str], gap: int = SESSION_GAP,
               hot_rows: int | None = None) -> DataFrame:
    """Adds ``gap`` (seconds to the previous event), ``is_start`` and ``session``."""
    df = df.withColumn("_ts", ts if isinstance(ts, Column) else F.col(ts))

    def starts(d: DataFrame) -> DataFrame:
        d = d.withColumn("gap", F.col("_ts") - F.col("_prev"))
        return d.withColumn("is_start", F.when(F.col("gap").isNull() | (F.col("gap") > gap), 1).otherwise(0))

    steps = [{"_prev": lag("_ts")}, starts, {"session": running("is_start")}]
    return ordered(df, [key], ["_ts", *tiebreak], steps, hot_rows).drop("_ts", "_prev")


USER, BOT = 0, 1


def interleave(user: DataFrame, bot: DataFrame) -> DataFrame:
    """Tagged union of user and bot turns on a common sender, tenant and time.
    A bot turn counts from the moment its answer was shown."""
    u = user.withColumn("src", F.lit(USER)).withColumn("positive_aspects", F.split("positive_aspects", ","))
    b = (bot.withColumn("src", F.lit(BOT)).withColumn("ts", F.col("ts") + F.col("next_response_time"))
         .withColumn("replies", F.split("replies", ",")).drop("next_response_time"))
    return u.unionByName(b, allowMissingColumns=True)


ORDER = ["ts", "src"]


def is_answered() -> Column:
    """1 if one of the next two texts is a quick reply, or the user then names the
    colour, subvertical or product type that the question asked for.  No quick
    replies, or unknown aspects at a colour question, mean 0."""
    code = F.col("response_code")
    quick = F.coalesce(F.array_contains("replies", F.col("_text1")), F.lit(False)) | F.coalesce(
        F.array_contains("replies", F.col("_text2")), F.lit(False))
    colour = (code == "color_question") & ~F.array_contains("_aspects_b", "color") & F.array_contains("_aspects_a", "color")
    sub = code.isin("subvertical_selection", "subvertical_selection_second") & F.col("_sub_b").isNull() & F.col("_sub_a").isNotNull()
    kind = (code == "product_type_selection") & F.col("_type_b").isNull() & (
        F.col("_type_a").isNotNull() | F.col("_type_a2").isNotNull())
    return F.when(F.col("replies").isNull(), 0).when(quick | colour | sub | kind, 1).otherwise(0)


def conversation_features(jnd: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Answered flag, running counts and last known state of every turn.

    All features share one window per sender: one shuffle, one sort."""
    is_q = F.when(F.col("response_code").isNotNull(), 1).otherwise(0)

    def answers(df: DataFrame) -> DataFrame:
        return (df.withColumn("is_answered", is_answered())
                .withColumn("time_from_start", F.col("ts") - F.col("_first"))
                .withColumn("num_quick_replies", F.coalesce(F.size("replies"), F.lit(0)))
                .drop("_text1", "_text2", "_aspects_b", "_aspects_a", "_sub_b", "_sub_a", "_type_a", "_type_a2", "_first")
                .withColumnRenamed("_type_b", "lag_type"))

    return ordered(jnd, ["sender_id"], ORDER, [{
        "_text1": lead("text"), "_text2": lead("text", 2),
        "_aspects_b": lag("positive_aspects"), "_aspects_a": lead("positive_aspects"),
        "_sub_b": lag("subvertical"), "_sub_a": lead("subvertical"),
        "_type_b": lag("product_type"), "_type_a": lead("product_type"), "_type_a2": lead("product_type", 2),
        "question_rank": running(is_q), "_first": running("ts", "min"),
        "last_code": last_known_before("response_code"),
        "last_aspects": last_known("positive_aspects"), "last_subvertical": last_known("subvertical"),
        "last_product_type": last_known("product_type"),
    }, answers, {"sum_answer": before("is_answered"), "last_question": total("question_rank", "max")}], hot_rows)


def end_turns(df: DataFrame, key: str, order: list[str], hot_rows: int | None = None) -> DataFrame:
    """``rank`` and ``max_rank`` per sender; last is rank = max_rank, the one before is max_rank - 1."""
    skew = find_skew(df, [key], hot_rows)
    return ordered(df, [key], order, {"rank": position(), "max_rank": total(F.lit(1), "count")}, skew=skew)


def collected(df: DataFrame, keys: list[str], order: list[str], col: str, out: str, chunk: int = 10_000,
              hot_rows: int | None = None) -> DataFrame:
    """All values of a key in order, as arrays of at most ``chunk`` values
    (``chunk`` numbers them), so that no key has to fit one array."""
    df = ordered(df, keys, order, {"_pos": position()}, hot_rows)
    df = df.withColumn("_n", F.col("_pos") - 1).withColumn("chunk", F.floor(F.col("_n") / chunk))
    pairs = F.array_sort(F.collect_list(F.struct("_n", F.col(col).alias("v"))))
    return df.groupBy(*keys, "chunk").agg(F.transform(pairs, lambda x: x["v"]).alias(out))


def ordered_texts(df: DataFrame, key: str, order: list[str], text: str, hot_rows: int | None = None) -> DataFrame:
    """All texts of a key in order as long rows (key, pos, text), pos from 1, so that no
    key has to fit one value or task; null texts are left out."""
    known = df.where(F.col(text).isNotNull())
    return ordered(known, [key], order, {"pos": position()}, hot_rows).select(key, "pos", text)


def action_counts(df: DataFrame, key: str, order: list[str], action: str, counts: dict[str, str], chunk: int = 1000,
                  hot_rows: int | None = None) -> DataFrame:
    """One row per key: how often each action occurs in its whole list of actions in order.
    The list is made in arrays of at most ``chunk`` values, whose counts are added up."""
    lists = collected(df, [key], order, action, "_actions", chunk, hot_rows)
    parts = lists.select(key, *[count_actions("_actions", a).alias(n) for n, a in counts.items()])
    return parts.groupBy(key).agg(*[F.sum(n).alias(n) for n in counts])


def rank_in_type(jnd: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Question number within (sender, previous product type) and its label
    ``<number>_<code>``, null if the code is null."""
    is_q = F.when(F.col("response_code").isNotNull(), 1).otherwise(0)
    df = ordered(jnd, ["sender_id", "lag_type"], ORDER, {"type_rank": running(is_q)}, hot_rows)
    return df.withColumn("rank_code", F.concat(F.col("type_rank").cast("string"), F.lit("_"), F.col("response_code")))


def first_clicks(clicks: DataFrame, user: str, ts: str) -> DataFrame:
    return clicks.where(F.col("action") == "click").groupBy(user).agg(F.min(ts).alias("first_click"))


def last_before_click(turns: DataFrame, first_click: DataFrame, sender: str, ts: str) -> DataFrame:
    """Per sender the last turn at or before the first click, or the last turn of
    senders who never click.  As-of lookup by max over a struct: no window."""
    cols = [c for c in turns.columns if c != sender]
    d = turns.join(first_click, sender, "left")
    ok = F.col("first_click").isNull() | (F.col(ts) <= F.col("first_click"))
    last = d.where(ok).groupBy(sender).agg(
        F.max(F.struct(ts, *[c for c in cols if c != ts])).alias("r"), F.max("first_click").alias("first_click"))
    return last.select(sender, *[F.col(f"r.{c}").alias(c) for c in cols],
                       F.when(F.col("first_click").isNull(), "no_click").otherwise("click").alias("click_flag"))


def typing_noise(df: DataFrame, key: str, order: list[str], text: str, hot_rows: int | None = None) -> DataFrame:
    """Drop a message whose next message contains it; keep senders left with one."""
    skew = find_skew(df, [key], hot_rows)
    df = ordered(df, [key], order, {"_next": lead(text)}, skew=skew)
    kept = df.where(~F.coalesce(F.contains("_next", F.col(text)), F.lit(False))).drop("_next")
    one = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).select(key)
    return kept.join(one, key, "left_semi")


def last_n_features(df: DataFrame, key: str, order: list[str], cols: list[str], n: int = 3,
                    hot_rows: int | None = None) -> DataFrame:
    """The last n known earlier values of each column as ``<col>_0`` (oldest) ..
    ``<col>_<n-1>``, left-filled with ``None``.

    Null values are skipped.  All columns are read in one ordered scan, whose state is
    the last n known values of each."""
    known = last_n_known_before({f"_last_{c}": F.col(c).cast("string") for c in cols}, n)
    df = ordered(df, [key], order, known, hot_rows)
    at = lambda c, j: F.try_element_at(F.col(f"_last_{c}"), F.lit(j - n))  # from the end
    return df.withColumns({f"{c}_{j}": F.coalesce(at(c, j), F.lit("None")) for c in cols for j in range(n)}).drop(*[f"_last_{c}" for c in cols])


def silent_senders(turns: DataFrame, key: str, profile: DataFrame, more_than: int = 30, clicks: str = "clicks",
                   fewer_than: int = 1, answered: str | None = None) -> DataFrame:
    """(key, n): senders with ``more_than`` turns or more, ``fewer_than`` clicks and, if that
    column is named, no ``answered`` turn.  ``profile`` has one row per sender that did
    something; a sender without one is silent."""
    n = turns.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(answered) if answered else F.lit(None), F.lit(0)).alias("_a"))
    n = n.where((F.col("n") >= more_than) & (F.col("_a") == 0)).drop("_a")
    busy = profile.where(F.coalesce(F.col(clicks), F.lit(0)) >= fewer_than).select(key)
    return n.join(busy, key, "left_anti")


def holds_codes(df: DataFrame, key: str, col: str, codes: list[str]) -> DataFrame:
    """Keys whose sequence holds every one of the codes."""
    seen = df.groupBy(key).agg(*[F.max(F.coalesce(F.col(col) == c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(codes)])
    cond = F.lit(True)
    for i in range(len(codes)):
        cond = cond & F.col(f"_{i}")
    return seen.where(cond).select(key)
