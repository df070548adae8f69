"""Operator 7: chat formatting, by DataFrame functions alone.

Records come as JSON in several layouts. The nested field paths of a record are read from its schema, types
left out, and hashed; the fingerprint selects a declarative mapping that turns the record into canonical turns
(role, text). A record of an unknown layout gets no turns (null) and its fingerprint, so that a mapping can be added.
A record beyond the limits of Spark's JSON parser is an error, not an unknown layout. Records may be structs too: rows of
turns are gathered into structs of the layout `messages` and go through the same fingerprint and mapping, without JSON.

Formatting marks turns with control strings. Control strings inside a role or a text are escaped: each
backslash is doubled and one is put after the first character of each control string, which taking one
backslash off before any character undoes. The loss mask holds the ranges of code points of the assistant's texts.

Null roles and texts count as empty. Turns of equal number are in order of role and text, null numbers first. A
conversation without turns gives the empty string. Rows of a null conversation id make one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates (fixed values), escaped wherever a text holds them.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<|eot_id|>")
#: Strings of any length that a JVM holds.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}
#: Records shorter than this are within the parser's limits of 20 million chars a string and 128 MiB a record (as measured, 17 million chars a string are fine).
LONG = 16_000_000
#: Other names of the three roles (fixed values).
ROLES = {"human": "user", "prompter": "user", "question": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "instructions": "system"}


class Layout(NamedTuple):
    """Where a layout's turns are: a list (its path, role and text fields), or fields with their roles.

    Consecutive fields with the same role become one turn, joined by a blank line; empty ones are left out of it."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()  # (role, field)
    turns: str = ""
    role: str = "role"
    text: str = "content"

    def needs(self) -> list[str]:
        """The field paths without which the mapping says nothing."""
        return sorted(f"{self.turns}[].{f}" for f in (self.role, self.text)) if self.turns else sorted(f for _, f in self.fields)

    def readable(self, kind: StructType) -> bool:
        """Whether a struct of this type has the fields of the mapping."""
        if not self.turns:
            return {f for _, f in self.fields} <= set(kind.names)
        inner = kind[self.turns].dataType.elementType if self.turns in kind.names and isinstance(kind[self.turns].dataType, ArrayType) else None
        return isinstance(inner, StructType) and {self.role, self.text} <= set(inner.names)

    def schema(self) -> str:
        """The type of what the mapping reads of a record."""
        return f"struct<{self.turns}:array<struct<{self.role}:string,{self.text}:string>>>" if self.turns else "struct<" + ",".join(f"{f}:string" for _, f in self.fields) + ">"

    def turns_of(self, record: Column) -> Column:
        if self.turns:
            return F.transform(record[self.turns], lambda t: _turn(t[self.role], t[self.text], self.role != "role"))
        grouped: list[tuple[str, list[str]]] = []
        for role, field in self.fields:
            if grouped and grouped[-1][0] == role:
                grouped[-1][1].append(field)
            else:
                grouped.append((role, [field]))
        blank = lambda f: F.when(F.coalesce(record[f], F.lit("")) != "", record[f])
        return F.array(*[_turn(F.lit(role), F.concat_ws("\n\n", *[blank(f) for f in fields]), False) for role, fields in grouped])


def _turn(role: Column, text: Column, other_names: bool) -> Column:
    if not other_names:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    named = F.lower(F.coalesce(role, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.struct(F.coalesce(known[named], role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


#: The layouts known by default.
LAYOUTS = (
    Layout("messages", turns="messages"),
    Layout("turns", turns="turns", text="text"),
    Layout("from_value", turns="conversations", role="from", text="value"),
    Layout("instruction", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", (("user", "question"), ("assistant", "answer"))),
    Layout("system_prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def paths_of(json: Column, lists: Sequence[str]) -> Column:
    """array<string>: the field paths of a JSON record in order (name, and name[].field of the lists named); null for what is no JSON object.

    Elements of a list may differ; the paths of all of them count. An empty list has no fields, so it counts as having any: name[]."""
    record = F.try_parse_json(json)
    fields = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))

    def inner(name: str) -> Column:
        elements = F.try_variant_get(record, f"$.{name}", "array<map<string,variant>>")
        found = F.transform(F.array_distinct(F.flatten(F.transform(elements, F.map_keys))), lambda f: F.concat(F.lit(f"{name}[]."), f))
        return F.when(F.size(elements) == 0, F.array(F.lit(f"{name}[]"))).otherwise(F.coalesce(found, F.array().cast("array<string>")))

    return F.array_sort(F.concat(fields, *[inner(name) for name in lists]))


def paths_of_struct(record: Column, schema: StructType, lists: Sequence[str]) -> Column:
    """array<string>: the same paths of a record that is a struct; its lists have the fields of their type, an empty one any, a null one none."""
    found = F.array(*[F.lit(c) for c in schema.names]) if schema.names else F.array().cast("array<string>")
    for f in schema.fields:
        if f.name in lists and isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            inner, size = F.array(*[F.lit(f"{f.name}[].{c}") for c in f.dataType.elementType.names]), F.size(record[f.name])
            found = F.concat(found, F.when(size == 0, F.array(F.lit(f"{f.name}[]"))).when(size > 0, inner).otherwise(F.array().cast("array<string>")))
    return F.when(record.isNotNull(), F.array_sort(found))


def fingerprint_of(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _free(name: str, taken: Sequence[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def canonical_turns(records: DataFrame, json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records plus layout, schema_fingerprint (of all paths) and turns array<struct<role,text>>. A record is JSON, or a struct: its paths are those of its type, and it is never JSON.

    A mapping is chosen by the fingerprint of those paths that it needs, so further fields do no harm; of several, lists of turns come before fields, then the one
    that needs more paths, then the first. An unknown layout gives null, a list without turns an empty array. Where records has a column of an added name, the
    added one gets an underscore behind its name."""
    source, record, held, kind = F.col(json_col), F.col("_record"), F.col("_paths"), records.select(json_col).schema[0].dataType
    lists = sorted({x.turns for x in layouts if x.turns})
    if isinstance(kind, StructType):
        paths, layouts = paths_of_struct(source, kind, lists), tuple(x for x in layouts if x.readable(kind))
        parsed = lambda layout: record
    else:
        too_long = F.raise_error(F.concat(F.lit("a record is no JSON or beyond the limits of Spark's parser, chars: "), F.length(source).cast("string"))).cast("array<string>")
        found = paths_of(source, lists)
        paths = F.when(found.isNull() & (F.length(source) >= LONG), too_long).otherwise(found)
        parsed = lambda layout: F.from_json(record, layout.schema(), ANY_LENGTH)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in sorted(layouts, key=lambda x: (not x.turns, -len(x.needs())), reverse=True):
        needs = F.array(*[F.lit(p) for p in layout.needs()])
        mine = fingerprint_of(F.array_sort(F.array_intersect(held, needs))) == fingerprint_of(needs)
        if layout.turns:
            mine = mine | F.array_contains(held, f"{layout.turns}[]")
        name, turns = F.when(mine, F.lit(layout.name)).otherwise(name), F.when(mine, layout.turns_of(parsed(layout))).otherwise(turns)
    row = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("_row"), source.alias("_record"), paths.alias("_paths"))
    new = [_free(c, records.columns) for c in ("layout", "schema_fingerprint", "turns")]
    made = zip((name, F.when(held.isNotNull(), fingerprint_of(held)), turns), new, strict=True)
    return row.select(*[F.col("_row")[c].alias(c) for c in records.columns], *[c.alias(n) for c, n in made])


def escaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), starts, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column, loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[Column, Column]:
    """The formatted string and the loss mask: array<struct<start,length>> in code points, from 0, escaped texts."""
    safe = F.transform(turns, lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")))
    whole = F.concat_ws("", F.transform(safe, lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        at = state["at"] + F.lit(len(TURN) + len(TEXT)) + F.length(t["role"])
        span = F.struct(at.alias("start"), F.length(t["text"]).alias("length"))
        return F.struct((at + F.length(t["text"]) + F.lit(len(END))).alias("at"), F.when(t["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return whole, F.aggregate(safe, start, add, lambda s: s["spans"])


def format_chats(records: DataFrame, json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records plus layout, schema_fingerprint, formatted and loss_mask; both are null where the layout is unknown."""
    return format_turns(canonical_turns(records, json_col, layouts), _free("turns", records.columns))


def format_turns(known: DataFrame, turns_col: str = "turns") -> DataFrame:
    """formatted and loss_mask in place of turns; no turns at all (null) give null."""
    whole, mask = formatted(F.col(turns_col))
    others = [c for c in known.columns if c != turns_col]
    some = F.col(turns_col).isNotNull()
    return known.select(*[F.col(f"`{c}`") for c in others], F.when(some, whole).alias(_free("formatted", others)), F.when(some, mask).alias(_free("loss_mask", others)))


def read_turns(text: Column) -> Column:
    """Turns read back from a formatted string."""
    parts = F.slice(F.split(text, re.escape(TURN), -1), 2, 2_000_000_000)
    fields = F.transform(parts, lambda p: F.split(p, f"{re.escape(TEXT)}|{re.escape(END)}", -1))
    return F.transform(fields, lambda f: F.struct(unescaped(f[0]).alias("role"), unescaped(f[1]).alias("text")))


def read_loss(text: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask of a formatted string."""
    return F.concat_ws("", F.transform(mask, lambda s: unescaped(F.substr(text, s["start"] + F.lit(1), s["length"]))))


def turns_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, layout, schema_fingerprint and turns: rows of turns gathered by conversation into records of the layout `messages`, of any size that a row can have, whose turns
    are read by the mapping that their fingerprint selects."""
    said = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gathered = rows.select(F.col(id_col).cast("long").alias("conv_id"), said.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return canonical_turns(gathered.select("conv_id", F.struct(messages.alias("messages")).alias("record")), "record", layouts).select("conv_id", "layout", "schema_fingerprint", "turns")


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and record (JSON in the layout `messages`): rows of turns gathered by conversation."""
    named = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return named.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))).alias("record"))
