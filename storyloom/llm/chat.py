"""Chat formatting from an event log.

A log has the columns conv_id, seq, part, kind, message, role and text; events
are ordered by (seq, part, message) within a conversation.  Kinds:

* ``message`` opens a message with a role and a text (anew, at its new place, if it was open before);
* ``delta`` adds its text to the message's end;
* ``edit`` replaces the message's text; place and role stay;
* ``regenerate`` empties the message and withdraws all messages opened after it.

Folding is associative: logs are partitioned by conversation, message and stretch
of sequence numbers, each stretch is sorted and folded to what it resets, opens
and adds, and stretches are folded in order.  A conversation that holds a third
of all events is therefore folded by many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, key_join

STRETCH = 4_096  # sequence numbers folded together
PIECE = 256  # characters of a streamed delta
# Control strings of the template.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/TEXT]")  # any other role, written out
CONTROL = r"/?INST\]|ROLE\]|/?TEXT\]|/?s>"
ESCAPE, UNESCAPE = rf"([\[<])(\\*)({CONTROL})", rf"([\[<])\\(\\*)({CONTROL})"
TARGET = "assistant"  # whose texts are under the loss mask
MESSAGE = ["conv_id", "message"]
TURN = re.compile(r"(?s)\[INST\](?P<user>.*)\[/INST\]|<s>(?P<assistant>.*)</s>|\[ROLE\](?P<role>.*?)\[TEXT\](?P<text>.*)\[/TEXT\]")


def as_events(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log that (conv_id, turn, role, text) rows stand for: assistants' texts are streamed in deltas.

    Null texts are empty.  Rows of one turn are messages of their own, by role and text.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("nth", F.row_number().over(same))
    streamed = F.col("role") == TARGET
    first = F.struct(F.lit("message").alias("kind"), F.when(streamed, F.lit("")).otherwise(F.col("text")).alias("text"))
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda t: F.struct(F.lit("delta").alias("kind"), t.alias("text")))
    events = F.when(streamed, F.concat(F.array(first), deltas)).otherwise(F.array(first))
    message = F.concat_ws(".", "turn", "nth")
    found = rows.select("conv_id", F.col("turn").alias("seq"), message.alias("message"), "role", F.posexplode(events).alias("part", "event"))
    return found.select("conv_id", "seq", "part", "event.kind", "message", "role", "event.text")


def _at() -> Column:
    return F.struct("seq", "part", "message").alias("at")


def _last_reset(parts: Column, resets) -> Column:
    """Place of the last part that resets the text, from 0; null without any."""
    return F.array_max(F.transform(parts, lambda p, i: F.when(resets(p), i)))


def _since(parts: Column, place: Column) -> Column:
    """The joined texts from ``place`` on."""
    return F.array_join(F.transform(F.slice(parts, F.coalesce(place, F.lit(0)) + 1, F.greatest(F.size(parts), F.lit(1))), lambda p: p["text"]), "")


def _last(parts: Column, value) -> Column:
    return F.try_element_at(F.filter(F.transform(parts, value), lambda v: v.isNotNull()), F.lit(-1))


def fold(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, at, message, role, text): the messages that a log leaves, ``at`` their place in the conversation.

    Events of messages that were never opened count for nothing; a regenerate of a
    withdrawn message still withdraws what was opened since its place.  Null
    conversations, messages and sequence numbers (which come first) are values
    like others, null texts are empty; extra columns are ignored.
    """
    log = log.select(
        "conv_id", "message", F.floor(F.col("seq") / stretch).alias("stretch"), _at(), "kind", "role",
        F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )
    events = F.sort_array(F.collect_list(F.struct("at", "kind", "role", "text"))).alias("e")
    each = log.groupBy(*MESSAGE, "stretch").agg(events)
    opened = lambda e: F.when(e["kind"] == "message", F.struct(e["at"].alias("at"), e["role"].alias("role")))
    place = _last_reset(F.col("e"), lambda e: e["kind"] != "delta")
    each = each.select(*MESSAGE, "stretch", place.isNotNull().alias("resets"), _last(F.col("e"), opened).alias("opened"), _since(F.col("e"), place).alias("text"))
    whole = each.groupBy(*MESSAGE).agg(F.sort_array(F.collect_list(F.struct("stretch", "resets", "opened", "text"))).alias("p"))
    messages = whole.select(*MESSAGE, _last(F.col("p"), lambda p: p["opened"]).alias("opened"), _since(F.col("p"), _last_reset(F.col("p"), lambda p: p["resets"])).alias("text"))
    messages = messages.filter("opened is not null").select("conv_id", "opened.at", "message", "opened.role", "text")
    control = log.filter("kind IN ('message', 'regenerate')").select(*MESSAGE, "stretch", "at", "kind")
    if control.filter("kind = 'regenerate'").limit(1).count() == 0:
        return messages
    messages = cut(messages)
    gone = withdrawn(cut(control), messages, stretch)
    return key_join(messages, gone, ["conv_id", "at"], "left_anti")


def withdrawn(control: DataFrame, messages: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, at) of the messages that a later regenerate of an earlier message withdraws.

    A message opened at ``at`` goes if the least opening that regenerates after
    ``at`` go back to lies before it.  That suffix minimum is taken within
    stretches and over the stretches' minima, so no task sees a whole conversation.
    """
    own = Window.partitionBy(*MESSAGE).orderBy("at")
    back = F.last(F.when(F.col("kind") == "message", F.col("at")), ignorenulls=True).over(own)
    regenerated = control.withColumn("back", back).filter("kind = 'regenerate' AND back is not null").select("conv_id", "stretch", "at", "back")
    regenerated = cut(regenerated)
    least = regenerated.groupBy("conv_id", "stretch").agg(F.min("back").alias("back"))
    opened = messages.select("conv_id", F.floor(F.col("at.seq") / stretch).alias("stretch"), "at")
    # A row for each stretch that holds messages or regenerates: few in any conversation.
    stretches = opened.select("conv_id", "stretch").unionByName(regenerated.select("conv_id", "stretch")).distinct()
    later = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = key_join(stretches, least, ["conv_id", "stretch"], "left").select("conv_id", "stretch", F.min("back").over(later).alias("after"))
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = opened.withColumn("back", F.lit(None).cast(regenerated.schema["back"].dataType)).withColumn("is_message", F.lit(True))
    rows = rows.unionByName(regenerated.withColumn("is_message", F.lit(False)))
    rows = rows.withColumn("here", F.min("back").over(within)).filter("is_message")
    held = key_join(rows.drop("back"), after, ["conv_id", "stretch"], "left")
    return held.filter(F.least("here", "after") < F.col("at")).select("conv_id", "at").distinct()


def escape(text: Column) -> Column:
    """A backslash more inside everything that looks like a control string."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(UNESCAPE, r"\1\2\3", text)


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, at, piece, loss_start, loss_end): each message as it stands in the formatted conversation.

    The pieces of a conversation, joined in the order of ``at``, are its formatted
    text.  loss_start and loss_end (code points of the piece) bound what is under
    the loss mask and are null where nothing is.  A null role is an empty one.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    rows = messages.select("conv_id", "at", role.alias("role"), text.alias("text"))
    pieces = F.concat(F.lit(OTHER[0]), escape(F.col("role")), F.lit(OTHER[1]), F.col("text"), F.lit(OTHER[2]))
    for name, (start, stop) in MARKS.items():
        pieces = F.when(F.col("role") == name, F.concat(F.lit(start), F.col("text"), F.lit(stop))).otherwise(pieces)
    masked = F.col("role") == TARGET
    begin = len(MARKS[TARGET][0])
    return rows.select(
        "conv_id", "at", pieces.alias("piece"), F.when(masked, F.lit(begin)).alias("loss_start"),
        F.when(masked, F.char_length("text") + begin).alias("loss_end"),
    )


def read_back(piece: str) -> tuple[str, str]:
    """(role, text) of a rendered message."""
    found = TURN.fullmatch(piece)
    for role in MARKS:
        if found[role] is not None:
            return role, unescape(found[role])
    return unescape(found["role"]), unescape(found["text"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation of the sorted pieces; only running digests are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, state, out = None, None, []

    def done() -> None:
        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def packed(kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
        out.clear()
        return made

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, piece, start, stop in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
            if state is None or conv != now:
                if state is not None:
                    done()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_back(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescape(piece[start:stop])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(piece)
        yield packed(kind)
    if state is not None:
        done()
        yield packed(kind)


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from rendered pieces.

    A digest of a whole conversation can only be taken in order: pieces are sorted
    by conversation and place and streamed, and a task holds no more than one batch
    of them, however long a conversation is.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "piece", "loss_start", "loss_end")
    return ordered.mapInArrow(_digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
