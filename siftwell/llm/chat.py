"""Chat formatting of event logs.

A log has events of conversations: (conv_id, seq, op, turn, role, text).  `message` begins a turn (or replaces it),
`delta` appends to it, `edit` replaces its text, and `regenerate` discards it and every later turn as they were then.
Folding is by windows in the order of sequence: an event counts if no later regeneration reaches its turn and no later
message or edit replaces it; what counts of a turn is concatenated.  Logs are dealt out by (conversation, turn), sorted,
so a conversation isn't one task's unless its turns are few, and a window over a conversation's regenerations spills.

Rendering is turn by turn: `<|turn|>role\\n`, the text, `<|end|>\\n`; the assistant's text is under the loss mask.  In
texts and roles the escape is reversible: a backslash is doubled, and one is put behind each `<` and `[`, so no control
string of this template or a common other one ([INST], </s>, <|...|>) is left whole; in roles a line end is `\\n`.

Defined cases: null text and null role are empty; equal seq and turn: rows are ordered by role, then text, and in a
log without ops each row is a turn of its own; null conv_id is a conversation; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

OPEN, CLOSE, LOSS_ROLE = "<|turn|>", "<|end|>\n", "assistant"
_MARKED = re.compile(r"[\\<\[]")
_UNMARKED = re.compile(r"\\\\|\\n|([<\[])\\")


def escape(text: str) -> str:
    return _MARKED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNMARKED.sub(lambda m: m[1] or ("\\" if m[0] == "\\\\" else "\n"), text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, op, turn, role, text)."""
    e = events.select("conv_id", "seq", F.coalesce("op", F.lit("message")).alias("op"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    reach = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    live = e.withColumn("after", F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).over(reach)).filter("after is null or seq >= after")
    last = F.max(F.when(F.col("op") != "delta", F.col("seq"))).over(Window.partitionBy("conv_id", "turn"))
    live = live.withColumn("last", last).filter("last is null or seq >= last")
    parts = F.array_sort(F.collect_list(F.struct("seq", "op", "role", "text")))
    done = live.groupBy("conv_id", "turn").agg(parts.alias("p"))
    role = F.expr("coalesce(try_element_at(filter(transform(p, x -> x.role), r -> r != ''), 1), '')")
    return done.select("conv_id", "turn", role.alias("role"), F.expr("array_join(transform(p, x -> x.text), '')").alias("text"))


def messages(rows: DataFrame) -> DataFrame:
    """A plain table of turns as a log whose every row is a message: rows that share a turn follow each other."""
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("nth"))
    return numbered.select("conv_id", F.struct("turn", "nth").alias("seq"), F.lit("message").alias("op"), F.struct("turn", "nth").alias("turn"), "role", "text")


def render(final: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end) of each final message; the loss span is in code points."""
    prepare(final.sparkSession)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            heads = [f"{OPEN}{escape(r).replace(chr(10), chr(92) + 'n')}\n" for r in f.pop("role")]
            bodies = [escape(t) for t in f.pop("text")]
            f["formatted"] = [f"{h}{b}{CLOSE}" for h, b in zip(heads, bodies, strict=True)]
            yield f

    turn = final.schema["turn"].dataType.simpleString()
    conv = final.schema["conv_id"].dataType.simpleString()
    keyed = final.select(F.to_json(F.struct("conv_id", "turn")).alias("k"), "role", "text")
    out = keyed.mapInPandas(each, "k string, formatted string").withColumn("k", F.from_json("k", f"struct<conv_id:{conv},turn:{turn}>"))
    out = out.select("k.conv_id", "k.turn", "formatted")
    start, end = F.instr("formatted", "\n") + F.lit(0), F.length("formatted") - len(CLOSE)
    masked = F.substring_index("formatted", "\n", 1) == OPEN + LOSS_ROLE
    return out.select("conv_id", "turn", "formatted", F.when(masked, start).alias("loss_start"), F.when(masked, end).alias("loss_end"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its rendered turns, streamed in order: one conversation at a time, and of
    that one turn at a time, is in memory."""
    prepare(rendered.sparkSession)
    conv = rendered.schema["conv_id"].dataType.simpleString()

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = object(), None, []

        def done() -> None:
            if state:
                n, turns, chars, loss, total = state
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for f in frames:
            for conv_id, text, lo, hi in zip(f["conv_id"], f["formatted"], f["loss_start"], f["loss_end"], strict=True):
                conv_id = None if pd.isna(conv_id) else conv_id
                if state is None or conv_id != now:
                    done()
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                head, _, body = text.removeprefix(OPEN).partition("\n")
                role, said = unescape(head), unescape(body.removesuffix(CLOSE))
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if not pd.isna(lo):
                    masked = unescape(text[int(lo) : int(hi)])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
        done()
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss_start", "loss_end")
    got = dealt.mapInPandas(digests, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return got.withColumn("conv_id", F.col("conv_id").cast(conv))
