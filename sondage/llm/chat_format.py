"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: ``(conv_id, turn, seq, kind, role, text)``.

* ``delta`` appends its text to the message of its turn;
* ``edit`` replaces the message with its text;
* ``regenerate`` empties it, and later deltas start anew;
* ``delete`` removes it until a later event of that turn.

A message's role is that of its last event that names one.

The log is first folded by (conversation, turn), which spreads a long
conversation over the cluster, and only finished messages meet by conversation,
sorted by turn, to be rendered:

    <|turn|>role<|text|>message<|end|>

In roles and messages ``&``, ``<`` and ``[`` are written as character references,
so no text can hold a mark of this or another template, and reading back is
exact. The loss mask is the list of the spans of assistant messages.

Defined results: a null text is empty, a null role is the empty role, and a null
turn comes first and null ids form one conversation; events that agree in
everything stay two events, ties in ``seq`` are ordered by kind, role and text; a
conversation of which nothing is left isn't returned; an empty log gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm.common import text_of

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: In the order in which they are written; read back in reverse.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LOSS_ROLE = "assistant"
#: Code points of a streamed delta in ``as_events``.
DELTA = 256


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: str) -> str:
    for plain, written in reversed(ESCAPES):
        text = text.replace(written, plain)
    return text


def as_events(messages: DataFrame, delta: int = DELTA) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log that streaming them may leave. Of
    three messages one is streamed as it is; one after a draft that is regenerated;
    and of one a draft is edited into the first part of the message, which goes on.
    Edits and regenerations name no role. Rows that share a turn are messages of
    their own, in the order of role and text, so they are numbered within it."""
    text = text_of("text")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # a turn's rows, nearly always one, are numbered
    each = rows.withColumn("part", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / delta).cast("int"))
    way = F.pmod(F.xxhash64("conv_id", "turn", "part"), F.lit(3))
    none = F.lit(None).cast("string")

    def event(seq: Column, kind: Column, role: Column, text: Column) -> Column:
        return F.struct(seq.cast("int").alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text"))

    draft = event(F.lit(-2), F.lit("delta"), F.col("role"), F.reverse(F.substring(F.col("text"), 1, F.lit(delta))))
    again = event(F.lit(-1), F.lit("regenerate"), none, none)

    def chunk(i: Column) -> Column:
        edits = (way == 2) & (i == 0)
        return event(i, F.when(edits, "edit").otherwise("delta"), F.when(~edits, F.col("role")), F.substring(F.col("text"), i * delta + 1, F.lit(delta)))

    before = F.when(way == 1, F.array(draft, again)).when(way == 2, F.array(draft)).otherwise(F.slice(F.array(draft), 1, 0))
    return each.select("conv_id", "turn", "part", F.explode(F.concat(before, F.transform(starts, chunk))).alias("e")).select("conv_id", "turn", "part", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): the final messages. ``part`` tells apart
    the messages of one turn and may be missing."""
    if "part" not in events.columns:
        events = events.withColumn("part", F.lit(0))
    event = F.struct("seq", "kind", "role", text_of("text").alias("text"))
    log = events.groupBy("conv_id", "turn", "part").agg(F.sort_array(F.collect_list(event)).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(0))
    log = log.withColumn("reset", F.array_max(resets))
    last = F.get("log", F.col("reset") - 1)
    after = F.array_join(F.transform(F.slice("log", F.col("reset") + 1, F.size("log")), lambda e: e["text"]), "")
    kind = F.when(F.col("reset") > 0, last["kind"])
    text = F.when(kind == "edit", F.concat(last["text"], after)).otherwise(after)
    alive = kind.isNull() | (kind != "delete") | (F.col("reset") < F.size("log"))
    named = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    role = F.coalesce(F.get(F.reverse(named), F.lit(0)), F.lit(""))
    return log.where(alive).select("conv_id", "turn", "part", role.alias("role"), text.alias("text"))


RENDERED = "conv_id long, formatted string, spans array<struct<role:string,start:long,end:long,loss:boolean>>"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())]))
    for b in batches:
        texts, spans = [], []
        for turns in b["turns"].to_pylist():
            parts, mask, at = [], [], 0
            for t in turns:
                head = f"{TURN}{t['role']}{TEXT}"
                start = at + len(head)
                at = start + len(t["text"])
                mask.append((t["role"], start, at, t["role"] == LOSS_ROLE))
                parts += [head, t["text"], END]
                at += len(END)
            texts.append("".join(parts))
            spans.append(mask)
        yield pa.RecordBatch.from_arrays([b["conv_id"], pa.array(texts, pa.string()), pa.array(spans, span)], ["conv_id", "formatted", "spans"])


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) of final messages; spans cover the written messages."""
    turn = F.struct("turn", "part", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInArrow(_render, RENDERED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b["formatted"].to_pylist(), b["spans"].to_pylist(), strict=True):
            whole, loss, n_turns = hashlib.sha256(), hashlib.sha256(), 0
            for turn in text.split(TURN)[1:]:
                role, _, rest = turn.partition(TEXT)
                body, end, tail = rest.partition(END)
                if not end or tail:
                    raise ValueError("a turn doesn't end with its mark")
                whole.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                n_turns += 1
            chars = 0
            for s in spans:
                if s["loss"]:
                    under = unescape(text[s["start"] : s["end"]])
                    chars += len(under)
                    loss.update(under.encode())
            rows.append((n_turns, whole.hexdigest(), chars, loss.hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b["conv_id"], *cols], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(rendered: DataFrame) -> DataFrame:
    """What the formatted texts and their masks say, unescaped, as counts and digests."""
    return rendered.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
