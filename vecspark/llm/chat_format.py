"""Chat formatting from heterogeneous layouts, with DataFrame functions only.

The nested field paths of a table are hashed to a fingerprint that selects a declarative mapping
to canonical turns (conversation id, position, role, text). Turns are rendered by a template whose
control strings are escaped reversibly inside texts, with a loss mask over the assistant's texts.

Escaping inserts a backslash inside a control string, after doubling backslashes that were there:
a lone backslash then marks an escape and nothing else, so undoing it is unambiguous.

Defined cases: NULL texts and roles count as empty; NULL positions come first; turns that share a
position are ordered by role, then text; repeated rows are repeated turns; an empty table gives an
empty result; other columns of a layout are ignored only if a registered layout names its paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_END = "</turn>\n"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths, ``a.b`` for structs and ``a[]`` for arrays, without types."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A named set of field paths and how it becomes turns (conv_id, turn, role, text)."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[DataFrame], DataFrame]


def _turns_of(items: Column, role: str, text: str) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        parts = df.select("conv_id", F.posexplode(items).alias("turn", "m"))
        return parts.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(f"m.{role}").alias("role"), F.col(f"m.{text}").alias("text"))

    return run


def _pair(*parts: tuple[str, Column]) -> Callable[[DataFrame], DataFrame]:
    """One turn a part; NULL texts are empty ones, but without a system text there is no such turn."""
    items = F.array(*(F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in parts))
    return _turns_of(F.filter(items, lambda m: (m.role != "system") | m.text.isNotNull()), "role", "text")


def layouts() -> list[Layout]:
    """The registered layouts; built on demand, as columns need a session."""
    instructed = F.when(F.coalesce(F.col("input"), F.lit("")) == "", F.col("instruction")).otherwise(F.concat_ws("\n\n", "instruction", "input"))
    return [
        Layout("turn rows", ("conv_id", "turn", "role", "text"), lambda df: df.select("conv_id", "turn", "role", "text")),
        Layout("messages", ("conv_id", "messages[].role", "messages[].content"), _turns_of(F.col("messages"), "role", "content")),
        Layout("from-value", ("conv_id", "conversations[].from", "conversations[].value"), _turns_of(F.col("conversations"), "from", "value")),
        Layout("prompt-response", ("conv_id", "prompt", "response"), _pair(("user", F.col("prompt")), ("assistant", F.col("response")))),
        Layout("prompt-completion", ("conv_id", "prompt", "completion"), _pair(("user", F.col("prompt")), ("assistant", F.col("completion")))),
        Layout("instruction", ("conv_id", "instruction", "input", "output"), _pair(("user", instructed), ("assistant", F.col("output")))),
        Layout("system-instruction", ("conv_id", "system", "instruction", "output"), _pair(("system", F.col("system")), ("user", F.col("instruction")), ("assistant", F.col("output")))),
    ]


#: Role names of other layouts, in canonical form.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def select_layout(schema: T.StructType) -> Layout:
    """The layout whose fingerprint is the table's; else the one with most paths among those that
    the table covers (extra columns). Raises ValueError if none is."""
    known, paths = layouts(), field_paths(schema)
    exact = {fingerprint(list(x.paths)): x for x in known}
    if (found := exact.get(fingerprint(paths))) is not None:
        return found
    covered = [x for x in known if set(x.paths) <= set(paths)]
    if not covered:
        raise ValueError(f"no layout for the field paths {paths}")
    return max(covered, key=lambda x: len(x.paths))


def to_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table in any registered layout."""
    layout = select_layout(df.schema)
    turns = layout.turns(df)
    role = F.coalesce(F.col("role"), F.lit(""))
    if layout.name == "from-value":
        for name, canonical in ROLE_NAMES.items():
            role = F.when(F.col("role") == name, F.lit(canonical)).otherwise(role)
    return turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def escape(text: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in (("</turn>", "<\\/turn>"), ("##", "#\\#"), ("\\", "\\\\")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _header(role: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(": "), F.lit(":\\ ")), F.lit(": "))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_mask`` (start, length of each assistant
    text in the formatted string, 1-based code points).

    Rows are gathered per conversation because a conversation is one output value.
    """
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    parts = rows.withColumn(
        "parts",
        F.transform("rows", lambda r: F.struct(_header(r.role).alias("head"), escape(r.text).alias("body"), (r.role == "assistant").alias("loss"))),
    )
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(TURN_END))), "")
    kind = "struct<at:int,spans:array<struct<start:int,len:int>>>"
    start = F.struct(F.lit(1).alias("at"), F.array().alias("spans")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc.at + F.length(p.head)).alias("start"), F.length(p.body).alias("len"))
        after = acc.at + F.length(p.head) + F.length(p.body) + len(TURN_END)
        return F.struct(after.alias("at"), F.when(p.loss, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans")).cast(kind)

    return parts.select("conv_id", formatted.alias("formatted"), F.aggregate("parts", start, step, lambda acc: acc.spans).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the loss text of :func:`format_turns`'s output, from that output alone."""
    chunks = F.split("formatted", TURN_END)
    turns = F.transform(
        F.slice(chunks, 1, F.size(chunks) - 1),
        lambda c: F.struct(
            unescape(F.replace(F.substring_index(F.substr(c, F.lit(5)), ": ", 1), F.lit(":\\ "), F.lit(": "))).alias("role"),
            unescape(F.substr(c, F.instr(c, ": ") + 2)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), s.start, s.len))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digest(read: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
