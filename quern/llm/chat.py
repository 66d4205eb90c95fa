"""Operator 2, chat formatting by event-sourced reconstruction.

An event log has (conv, seq, kind, msg, role, text): `message` begins message number msg, `delta` adds
to it, `edit` replaces its text, `regenerate` begins it anew and drops the later messages that the
conversation had by then. The log is partitioned by conversation and sorted by sequence; windows find
for each message the event that it last began anew at and the last regeneration of an earlier one, and
what is left after both is folded into the final text. Each final message is rendered as a row:

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

In texts a backslash is doubled and `<|` becomes `<\\|`, in roles also a newline becomes `\\n`, so no
control string can come from a text and reading gives back what was written. loss_start and loss_chars
are the assistant's text in the conversation as rendered. A conversation stays a run of rows in order,
never one value, and sorting spills; so a long one is bounded by its longest message.

Edge cases: null roles and texts are empty, null conversations are one conversation. Rows of one turn
are ordered by role and text, and each is a message of its own; so are repeated rows. Events of equal
seq are ordered by kind and text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def turn_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Whole turns as an event log of one `message` each."""
    slim = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    seq = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    return slim.withColumn("seq", seq).select("conv", "seq", F.lit("message").alias("kind"), F.col("seq").alias("msg"), "role", "text")


def turn_log(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Whole turns as the log of a service that streams, corrects and regenerates answers: the fold of the log
    gives the turns. By a hash, a turn is streamed in two or three pieces, is a draft that an edit replaces, or
    is an answer that was followed up and then regenerated, so that answer and follow-up are dropped."""
    turns = turn_events(rows, conv, turn, role, text)
    a, b = F.floor(F.length("text") / 3).cast("int"), F.floor(F.length("text") / 2).cast("int")
    rest = F.lit(2**31 - 1)

    def event(step: int, kind: str, words: Column, msg: Column | None = None, of: Column | None = None) -> Column:
        return F.struct((F.col("seq") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), (F.col("msg") if msg is None else msg).alias("msg"), (F.lit(None).cast("string") if of is None else of).alias("role"), words.alias("text"))

    def piece(begin: Column | int, size: Column) -> Column:
        return F.substring("text", F.lit(1) + begin, size)

    own = F.col("role")
    logs = [
        F.array(event(0, "message", piece(0, b), of=own), event(1, "delta", piece(b, rest))),
        F.array(event(0, "message", F.lit(""), of=own), event(1, "delta", piece(0, a)), event(2, "delta", piece(a, a)), event(3, "delta", piece(a + a, rest))),
        F.array(event(0, "message", F.concat(F.lit("draft of "), F.col("text")), of=own), event(1, "delta", F.lit(" ...")), event(2, "edit", F.col("text"))),
        F.array(event(0, "message", F.lit("an answer"), of=own), event(1, "message", F.lit("a follow-up"), F.col("msg") + 1, F.lit("user")), event(2, "regenerate", piece(0, b)), event(3, "delta", piece(b, rest))),
    ]
    which = F.pmod(F.xxhash64("conv", "seq"), F.lit(len(logs)))
    chosen = F.coalesce(*(F.when(which == k, log) for k, log in enumerate(logs)))
    return turns.select("conv", F.explode(chosen).alias("x")).select("conv", "x.*")


def fold(events: DataFrame) -> DataFrame:
    """The final messages of an event log: conv, msg, role, text. One shuffle, by conversation."""
    begins = F.col("kind").isin("message", "edit", "regenerate")
    message = Window.partitionBy("conv", "msg")
    earlier = Window.partitionBy("conv").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    live = (
        events.repartition("conv")
        .withColumn("begun", F.max(F.when(begins, F.col("seq"))).over(message))
        .withColumn("of", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(message))
        .withColumn("dropped", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
        .filter("seq >= coalesce(begun, seq) and seq > coalesce(dropped, seq - 1)")
    )
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    texts = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    return live.groupBy("conv", "msg").agg(F.coalesce(F.max("of"), F.lit("")).alias("role"), texts.alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|\|)", "$1")


def render(messages: DataFrame) -> DataFrame:
    """conv, place, formatted, loss_start, loss_chars: a row for each final message."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.col("text"))
    order = Window.partitionBy("conv").orderBy("msg")
    lost = F.col("role") == LOSS_ROLE
    shaped = messages.select("conv", F.row_number().over(order).alias("place"), "msg", F.concat(head, body, F.lit(END + "\n")).alias("formatted"), F.when(lost, F.length(head)).alias("loss_at"), F.when(lost, F.length(body)).otherwise(0).cast("long").alias("loss_chars"))
    before = F.coalesce(F.sum(F.length("formatted").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shaped.withColumn("loss_start", before + F.col("loss_at")).select("conv", "place", "formatted", "loss_at", "loss_start", "loss_chars")


def parse(rendered: DataFrame) -> DataFrame:
    """What render wrote, read from `formatted` and the loss mask alone."""
    line = F.instr("formatted", "\n")
    stop = F.locate(END, F.col("formatted"), 1)
    role = F.expr(f"substring(formatted, {len(START) + 1}, instr(formatted, '\n') - {len(START) + 1})")
    role = unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
    text = F.substring("formatted", line + 1, stop - line - 1)
    loss = F.when(F.col("loss_chars") > 0, F.substring("formatted", F.col("loss_at") + 1, F.col("loss_chars").cast("int")))
    return rendered.select("conv", "place", role.alias("role"), unescape(text).alias("text"), unescape(F.coalesce(loss, F.lit(""))).alias("loss"), F.length("formatted").cast("long").alias("chars"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; the rows come by conversation, in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now: list | None = None
    out: list[tuple] = []

    def close() -> None:
        out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    for batch in batches:
        for conv, role, text, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "loss", "chars")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            now[3] += len(loss)
            now[4].update(loss.encode())
            now[5] += chars
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
    if now is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its rendered rows."""
    sorted_rows = parse(rendered).repartition("conv").sortWithinPartitions("conv", "place")
    return sorted_rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
