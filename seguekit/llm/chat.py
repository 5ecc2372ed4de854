"""Chat formatting with typed content parts.

A visitor walks the typed parts of every turn and flattens them to one body: text is escaped, an image, audio clip
or document becomes an ordered placeholder, and each attachment is recorded with its reference and the number of
tokens its placeholder stands for. Turns are then put together per conversation, with the spans that carry loss.

Template, one turn after another::

    <turn role="user">BODY</turn>\\n

Control strings inside texts cannot occur in the output: in BODY and in roles ``\\`` becomes ``\\\\``, ``<`` becomes
``\\l`` and ``"`` becomes ``\\q``. The mapping is reversible, so ``read_back`` restores every turn.

Defined results: null text, role, parts or part count as empty; a part of an unknown kind becomes an ``unknown``
placeholder of no tokens, its attachment keeps the kind; sizes that are null, negative or not finite count as 0; turns
are ordered by ``turn`` (nulls first), ties by role and then body, and repeated rows stay repeated; a null ``conv_id`` is a
conversation of its own; an empty table gives an empty result; texts of any length are kept whole; further columns are
ignored, whatever their names. One conversation is one output value, so it must fit in a task: at most 2 GB of text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<position:int,kind:string,ref:string,tokens:bigint>"

#: Fixed values of the template: character, its escape.
ESCAPES = {"\\": "\\\\", "<": "\\l", '"': "\\q"}
_ESCAPE = re.compile(r'[\\<"]')
_UNESCAPE = re.compile(r"\\([\\lq])")
_BACK = {v[1]: k for k, v in ESCAPES.items()}
_TURN = re.compile(r'<turn role="([^"<]*)">(.*?)</turn>\n', re.S)
_PLACEHOLDER = re.compile(r'<(image|audio|document|unknown) id="(\d+)" tokens="(\d+)"/>')


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


@dataclass(frozen=True)
class TokenRates:
    """How many tokens the parts expand to."""

    bytes_per_token: float = 4.0
    image_tile: int = 512
    tokens_per_tile: int = 170
    tokens_per_image: int = 85
    tokens_per_second: float = 25.0
    tokens_per_page: int = 800


class PartVisitor:
    """Flattens the parts of one turn: text to its escaped form, everything else to placeholders numbered from 0."""

    def __init__(self, rates: TokenRates):
        self.rates = rates
        self.handlers = {"image": self.on_image, "audio": self.on_audio, "document": self.on_document}

    def visit(self, parts) -> tuple[str, list[dict], int]:
        body, attachments, tokens = [], [], 0
        for part in parts or ():
            part = part or {}
            kind = part.get("kind") or "text"
            if kind == "text":
                body.append(escape(part.get("text") or ""))
                tokens += self.on_text(part)
                continue
            n = self.handlers.get(kind, self.on_unknown)(part)
            body.append(f'<{kind if kind in self.handlers else "unknown"} id="{len(attachments)}" tokens="{n}"/>')
            attachments.append({"position": len(attachments), "kind": kind, "ref": part.get("ref"), "tokens": n})
            tokens += n
        return "".join(body), attachments, tokens

    def on_text(self, part) -> int:
        return math.ceil(len((part.get("text") or "").encode("utf-8")) / self.rates.bytes_per_token)

    def on_image(self, part) -> int:
        tiles = math.ceil(_amount(part, "width") / self.rates.image_tile) * math.ceil(_amount(part, "height") / self.rates.image_tile)
        return self.rates.tokens_per_image + self.rates.tokens_per_tile * tiles

    def on_audio(self, part) -> int:
        return math.ceil(_amount(part, "seconds") * self.rates.tokens_per_second)

    def on_document(self, part) -> int:
        return _amount(part, "pages") * self.rates.tokens_per_page

    def on_unknown(self, part) -> int:
        return 0


def _amount(part, name: str):
    x = part.get(name) or 0
    return x if math.isfinite(x) and 0 < x < 1e12 else 0


def renumber(body: str, first: int) -> str:
    """``body`` with its placeholders numbered from ``first``; control strings in texts are escaped, so only placeholders match."""
    return _PLACEHOLDER.sub(lambda m: f'<{m[1]} id="{int(m[2]) + first}" tokens="{m[3]}"/>', body) if first else body


def flatten_parts(turns: DataFrame, rates: TokenRates = TokenRates()) -> DataFrame:
    """(conv_id, turn, role, parts) -> one flattened turn per row; a narrow map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = PartVisitor(rates)
        for b in batches:
            seen = [visitor.visit(p) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([s[0] for s in seen], pa.string()), pa.array([s[1] for s in seen], _ATTACHMENTS), pa.array([s[2] for s in seen], pa.int64())],
                names=["conv_id", "turn", "role", "body", "attachments", "tokens"],
            )

    kept = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), "parts")
    return kept.mapInArrow(run, f"conv_id long, turn long, role string, body string, attachments array<{ATTACHMENT}>, tokens long")


_ATTACHMENTS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(turns: DataFrame, rates: TokenRates = TokenRates(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points, end exclusive), attachments, tokens.

    Attachment positions and placeholder ids count through the conversation. The only shuffle brings the turns of a conversation
    together; bodies are flattened before it.
    """
    flat = flatten_parts(turns, rates)
    together = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "attachments", "tokens"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for turns_ in b.column("turns").to_pylist():
                text, at, spans, found, tokens = [], 0, [], [], 0
                for t in turns_:
                    head, body = f'<turn role="{escape(t["role"])}">', renumber(t["body"], len(found)) if t["attachments"] else t["body"]
                    if t["role"] in loss_roles:
                        spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
                    piece = f"{head}{body}</turn>\n"
                    text.append(piece)
                    at += len(piece)
                    found += [a | {"position": len(found) + i} for i, a in enumerate(t["attachments"] or ())]
                    tokens += t["tokens"]
                out.append(("".join(text), spans, found, tokens))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], _SPANS), pa.array([o[2] for o in out], _ATTACHMENTS), pa.array([o[3] for o in out], pa.int64())],
                names=["conv_id", "formatted", "loss_spans", "attachments", "tokens"],
            )

    return together.mapInArrow(run, f"conv_id long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, attachments array<{ATTACHMENT}>, tokens long")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text with placeholders) of each turn of a formatted conversation."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(formatted)]


def placeholders(body: str) -> list[tuple[str, int, int]]:
    """(kind, id, tokens) of the placeholders of an escaped body, in order."""
    return [(k, int(i), int(n)) for k, i, n in _PLACEHOLDER.findall(body)]


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from ``formatted`` and ``loss_spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans, found, tokens in zip(*(b.column(c).to_pylist() for c in ("formatted", "loss_spans", "attachments", "tokens")), strict=True):
                turns = parse(text)
                whole = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode("utf-8")).hexdigest()
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans or ())
                rows.append((len(turns), whole, len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(text), len(found or ()), tokens))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"])

    return formatted.select("conv_id", "formatted", "loss_spans", "attachments", "tokens").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")


def as_text_parts(conversations: DataFrame) -> DataFrame:
    """Plain turns as turns of a single text part."""
    null = lambda kind: F.lit(None).cast(kind)
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text"), F.lit("")).alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))
