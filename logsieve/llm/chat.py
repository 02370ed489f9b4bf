"""Chat formatting with turn spans found by rendering, not by knowing the template.

A template is any function from a list of turns to text. Each prefix of a conversation is
rendered; where an output starts with the one before, the new part is the turn's span, and two
renderings with probe texts show where in it the turn's own text lies. A template that changes
what it has rendered before is reported by the first turn that did so; such a conversation has
no spans from that turn on.

Null texts are empty, null roles and turn numbers are allowed; turns are ordered by number, role
and text, so ties and repeated rows have a fixed order. Rows with a null conv_id form one
conversation. An empty table gives an empty result.
"""

import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str | None, str]
Template = Callable[[Sequence[Turn]], str]
#: Marks of the default template: what stands before and after a turn's text.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>\n")}
_CONTROL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Two texts that differ in every place and that templates have no reason to treat specially.
PROBES = ("xqx", "zjz")


def escape(text: str) -> str:
    """No mark can occur in the result; ``unescape`` gives the text back."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruction_template(turns: Sequence[Turn]) -> str:
    """Marks every turn; roles without marks of their own are named in theirs."""
    out = []
    for role, text in turns:
        name = "" if role is None else ":" + escape(role).replace("\n", "\\\n")
        before, after = MARKS.get(role, (f"<s>[TURN{name}]\n", " [/TURN]\n"))
        out.append(before + escape(text) + after)
    return "".join(out)


def role_of(before: str) -> str | None:
    """The role that the marks before a turn's text name."""
    for role, (mark, _) in MARKS.items():
        if before == mark:
            return role
    name = before.removeprefix("<s>[TURN").removesuffix("]\n")
    return unescape(name[1:]) if name.startswith(":") else None


def _shared(a: str, b: str) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def locate(template: Template, turns: Sequence[Turn]) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """The rendered text; for each turn its span and, within it, its text's; the first turn that rewrote history."""
    before, spans = template([]), []
    for k, (role, text) in enumerate(turns):
        out = template(turns[: k + 1])
        if not out.startswith(before):
            return template(turns), spans, k
        a, b = (template([*turns[:k], (role, probe)])[len(before) :] for probe in PROBES)
        head, tail = _shared(a, b), _shared(a[::-1], b[::-1])
        spans.append((len(before), len(before) + head, len(out) - tail, len(out)))
        before = out
    return before, spans, None


SCHEMA = (
    "conv_id long, formatted string, spans array<struct<turn:int,start:int,text_start:int,text_end:int,end:int,loss:boolean>>, "
    "rewritten_at int"
)


def format_chats(turns: DataFrame, template: Template = instruction_template, learn_from: Sequence[str] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, spans (of each turn, of its text, whether it is under the loss mask), rewritten_at of turns (conv_id, turn, role, text)."""
    one = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, chat in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
                said = [(t["role"], t["text"]) for t in chat]
                text, spans, rewritten = locate(template, said)
                found = [
                    dict(zip(("turn", "start", "text_start", "text_end", "end", "loss"), (k, *s, said[k][0] in learn_from), strict=True))
                    for k, s in enumerate(spans)
                ]
                out.append({"conv_id": conv, "formatted": text, "spans": found, "rewritten_at": rewritten})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow())

    return chats.mapInArrow(run, SCHEMA)


def _arrow() -> pa.Schema:
    span = pa.struct([*((n, pa.int32()) for n in ("turn", "start", "text_start", "text_end", "end")), ("loss", pa.bool_())])
    return pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span)), ("rewritten_at", pa.int32())])


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and spans say, read back: counts and SHA-256 of the turns and of the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                text, said, loss = row["formatted"], sha256(), []
                for s in row["spans"]:
                    own = unescape(text[s["text_start"] : s["text_end"]])
                    role = role_of(text[s["start"] : s["text_start"]])
                    said.update(f"{role or ''}\n{own}\n".encode("utf-8", "surrogatepass"))
                    if s["loss"]:
                        loss.append(own)
                learned = "".join(loss)
                out.append({
                    "conv_id": row["conv_id"], "n_turns": len(row["spans"]), "turns_sha256": said.hexdigest(), "loss_chars": len(learned),
                    "loss_sha256": sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), "formatted_chars": len(text),
                    "rewritten_at": row["rewritten_at"],
                })
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten_at", pa.int32()),
            ]))

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at int"
    )
