"""Conversations as marked text with loss flags, from a declarative template.

A template names the marks, the roles it knows, which roles the loss covers and which role
may follow which: a finite-state machine whose state is the last role seen.  The machine
runs as an ordered scan (``lag`` of the role within the conversation, cut into blocks with
halo rows where one conversation is hot), and every turn becomes text segments, each with
its loss flag.  Segments of consecutive turns form pieces of bounded size, which are the
rows of the output; a long conversation has several.

Control strings begin with ``<|``.  Inside texts and role names every ``<``, any number of
backslashes, ``|`` gets one backslash more, so none can be mistaken, and taking one away
gives the text back.

The reader knows the marks only: it walks through the joined segments of a conversation,
whatever their boundaries, and finds turns and loss text again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scan import before, lag, ordered
from parlance.session import pinned

PIECE = 1 << 20  # characters after which a piece of a conversation ends
_GUARD, _UNGUARD = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """``follows`` maps a role to the states it may come after; None is the start."""
    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str | None, ...]] = field(default_factory=lambda: {
        "system": (None,), "user": (None, "system", "assistant"), "assistant": ("user",)})
    final: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self):
        if not (self.open.startswith("<|") and self.close.startswith("<|") and self.open != self.close and self.after_role == "\n"):
            raise ValueError("marks begin with <| and differ; a line end follows the role")


def guarded(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def guarded_role(role: Column) -> Column:
    """A role name on one line."""
    return guarded(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def plain_text(text: str) -> str:
    return _UNGUARD.sub(r"<\1|", text)


def plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain_text(role))


def _allowed(template: Template, role: Column, state: Column) -> Column:
    """Whether the machine has a transition from the state (null at the start) for the role."""
    ok = F.lit(False)
    for r, states in template.follows.items():
        named = [s for s in states if s is not None]
        after = state.isin(named) if named else F.lit(False)
        ok = F.when(role == r, F.coalesce(after, F.lit(False)) | (state.isNull() if None in states else F.lit(False))).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def format_conversations(rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pieces of formatted conversations: ``conv_id, piece, segments, n_turns, broken``.

    All rows of a conversation are formatted in the order of ``turn``, ties in that of role
    and text, and nulls first; equal rows are turns of their own.  A null text or role is
    empty.  ``broken`` counts the turns of the piece whose role may not come there: they are
    formatted as they stand, and it is for the reader to leave them out.  Roles unknown to
    the template never may.  A null ``conv_id`` is a conversation too.  An empty table gives
    no rows; other columns are not read.  ``segments`` hold text and loss flag and, joined,
    are the formatted text."""
    t = template
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    turns = turns.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("_row")]
    size = F.char_length("text") + F.char_length("role") + len(t.open + t.close + t.after_role + t.after_turn)
    turns = ordered(turns, ["conv_id"], order, {"state": lag("role"), "ahead": before(size.cast("long"))})
    mark = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
    turn = F.array(mark(F.concat(F.lit(t.open), guarded_role(F.col("role")), F.lit(t.after_role))),
                   F.struct(guarded(F.col("text")).alias("text"), F.col("role").isin(*t.loss).alias("loss")),
                   mark(F.lit(t.close + t.after_turn)))
    ahead = F.coalesce("ahead", F.lit(0))
    turns = turns.select("conv_id", F.floor(ahead / PIECE).cast("long").alias("piece"), F.struct(ahead.alias("ahead"), turn.alias("segments")).alias("one"),
                         (~_allowed(t, F.col("role"), F.col("state"))).cast("long").alias("bad"))
    # a piece holds turns that begin within PIECE characters
    pieces = turns.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("one")).alias("all"), F.count(F.lit(1)).alias("n_turns"), F.sum("bad").alias("broken"))
    return pieces.select("conv_id", "piece", F.flatten(F.transform("all", lambda x: x["segments"])).alias("segments"), "n_turns", "broken")


class Reader:
    """Takes the segments of one conversation and gives its turns; holds one turn at most."""

    def __init__(self, template: Template):
        self.t, self.text, self.flags = template, "", []

    def turns(self, segments: list[dict]) -> Iterator[tuple[str, str, list[str]]]:
        """(role, text, loss texts) of the turns that end within these segments."""
        t, part = self.t, [self.text]
        at = len(self.text)
        for s in segments:
            if s["loss"]:
                self.flags.append((at, at + len(s["text"])))
            part.append(s["text"])
            at += len(s["text"])
        text, i = "".join(part), 0
        flags, f = self.flags, 0
        while True:
            end = text.find(t.close, i)
            if end < 0 or len(text) < end + len(t.close + t.after_turn):
                break
            head = text.find(t.after_role, i)
            if not text.startswith(t.open, i) or head < 0 or head > end or not text.startswith(t.after_turn, end + len(t.close)):
                raise ValueError("not a formatted conversation")
            last = end + len(t.close + t.after_turn)
            loss = []
            while f < len(flags) and flags[f][0] < last:
                loss.append(plain_text(text[flags[f][0]: flags[f][1]]))
                f += 1
            yield plain_role(text[i + len(t.open): head]), plain_text(text[head + len(t.after_role): end]), loss
            i = last
        self.text, self.flags = text[i:], [(a - i, b - i) for a, b in flags[f:]]

    def close(self) -> None:
        if self.text:
            raise ValueError("a formatted conversation ends within a turn")


def read_digests(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation, read from its formatted text: ``conv_id, n_turns,
    turns_sha256`` (role, line end, text, line end of each turn), ``loss_chars, loss_sha256``
    (text under the loss flags), ``formatted_chars, n_broken, complete`` (it ends in a final
    state).  A digest of a whole conversation is sequential, so its pieces stream through
    one task, sorted; memory holds one piece and one turn."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_broken", "complete"]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        now, state, done = None, None, []

        def result():
            reader, turns, loss, n, chars, size, broken, role = state
            reader.close()
            return now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, broken, role in template.final

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)

        for b in batches:
            for k in range(b.num_rows):
                conv = (b.column("conv_id")[k].as_py(),)
                if now is None or conv != now:
                    if now is not None:
                        done.append(result())
                    now, state = conv, [Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, None]
                segments = b.column("segments")[k].as_py()
                state[5] += sum(len(s["text"]) for s in segments)
                state[6] += b.column("broken")[k].as_py()
                for role, text, loss in state[0].turns(segments):
                    state[1].update(f"{role}\n{text}\n".encode())
                    for x in loss:
                        state[2].update(x.encode())
                        state[4] += len(x)
                    state[3] += 1
                    state[7] = role
            if done:
                yield batch()
                done = []
        if now is not None:
            done.append(result())
            yield batch()

    id_type = pieces.schema["conv_id"].dataType
    rows = pieces.select("conv_id", "piece", "segments", "broken").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_broken long, complete boolean")


def format_and_read(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Write the pieces as a table in the shared folder and read the digests from it."""
    return read_digests(pinned(format_conversations(rows, template)), template)


def training_texts(pieces: DataFrame) -> DataFrame:
    """``conv_id, piece, text, loss_spans`` (start and end characters within the piece)."""
    ends = F.aggregate("segments", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
                       lambda a, s: F.struct((a["at"] + F.char_length(s["text"])).alias("at"),
                                             F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.char_length(s["text"])).alias("end"))))).otherwise(a["spans"]).alias("spans")))
    return pieces.select("conv_id", "piece", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), ends["spans"].alias("loss_spans"))
