"""Chat formatting: records of several layouts become canonical turns by the fingerprint of their
nested fields, and turns become one marked text with a loss mask."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.text import let
from draftlake.llm.common import running_totals

TURNS = "array<struct<role:string,text:string>>"
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|n|>"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``single``: (role, path) per turn, or a path after ``$`` in place
    of a fixed role; ``listed``: a path to an array and the names of its role and text fields."""

    name: str
    schema: str
    single: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    roles: dict = field(default_factory=lambda: ROLE_NAMES)


#: Layouts by their nested fields; every scalar is ``*`` and fields stand in the order of their names.
MAPPINGS = (
    Mapping("turn", "OBJECT<role: *, text: *>", single=(("$.role", "$.text"),)),
    Mapping("message", "OBJECT<content: *, role: *>", single=(("$.role", "$.content"),)),
    Mapping("prompt", "OBJECT<prompt: *, response: *>", single=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("completion", "OBJECT<completion: *, prompt: *>", single=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("instruction", "OBJECT<instruction: *, output: *>", single=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input", "OBJECT<input: *, instruction: *, output: *>",
            single=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("system_prompt", "OBJECT<prompt: *, response: *, system: *>",
            single=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content: *, role: *>>>", listed=("$.messages", "role", "content")),
    Mapping("from_value", "OBJECT<conversations: ARRAY<OBJECT<from: *, value: *>>>", listed=("$.conversations", "from", "value")),
)

_SCALARS = r"(?<=: |ARRAY<)(?:[A-Z_]+(?:\(\d+,\s*\d+\))?)(?=[,>])"


def field_paths(record: Column) -> Column:
    """Nested fields of a variant as text: names in order, every scalar type as ``*``."""
    return F.regexp_replace(F.schema_of_variant(record), _SCALARS, "*")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Struct (mapping, turns) of a variant record. The hash of its field paths selects the mapping;
    null texts and roles become empty. An unknown layout gives null in both, so the caller sees it."""

    def renamed(role: Column, m: Mapping) -> Column:
        out = F.coalesce(role, F.lit(""))
        for old, new in m.roles.items():
            out = F.when(role == old, F.lit(new)).otherwise(out)
        return out

    def turns(m: Mapping) -> Column:
        read = lambda p, t="string": F.try_variant_get(record, p, t)
        if m.listed:
            path, role, text = m.listed
            return F.transform(
                read(path, f"array<struct<`{role}`:string,`{text}`:string>>"),
                lambda x: F.struct(renamed(x[role], m).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")),
            )
        return F.array(*[
            F.struct(
                (renamed(read(r), m) if r.startswith("$") else F.lit(r)).alias("role"),
                F.coalesce(read(p), F.lit("")).alias("text"),
            )
            for r, p in m.single
        ])

    def chosen(key: Column) -> Column:
        out = F.lit(None).cast(f"struct<mapping:string,turns:{TURNS}>")
        for m in mappings:
            hit = F.struct(F.lit(m.name).alias("mapping"), turns(m).cast(TURNS).alias("turns"))
            out = F.when(key == F.xxhash64(F.lit(m.schema)), hit).otherwise(out)
        return out

    return let(fingerprint(record), chosen)


def escaped(text: Column) -> Column:
    """Without any ``<|``: backslashes are doubled, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def formatted(turns: Column) -> Column:
    """Struct (text, loss_spans) of canonical turns. Each turn is start mark, role, line feed, text,
    end mark, line feed; control strings in roles and texts are escaped, and a line feed in a role
    is a mark of its own. Loss spans (start, length; code points) cover the texts of assistants."""

    def built(parts: Column) -> Column:
        size = F.transform(parts, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).cast("bigint"))

        def masked(before: Column) -> Column:
            spans = F.transform(parts, lambda p, i: F.struct(
                (F.get(before, i) + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("bigint").alias("length"),
                p["loss"].alias("loss"),
            ))
            text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
            only = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
            return F.struct(text.alias("text"), only.alias("loss_spans"))

        return let(running_totals(size), masked)

    parts = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n")).alias("head"),
        escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"),
    ))
    return let(parts, built)


def parsed(text: Column) -> Column:
    """Turns read back from a formatted text."""
    pieces = F.filter(F.split(text, "<\\|im_start\\|>"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 2 - len(END))
        return F.struct(unescaped(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def format_rows(rows: DataFrame, group: str, order: str, record: Column) -> DataFrame:
    """One row per conversation of rows that each hold one record: (group, turns, text, loss_spans,
    unknown).

    The turns of a conversation meet in one row, as its text and digest are sequential; it holds
    that conversation only. Ties of ``order`` stand in the order of role and text; null groups form
    one conversation. Records of an unknown layout add no turn and are counted in ``unknown``. An
    empty table gives an empty table; extra columns take no part."""
    mapped = rows.select(group, order, canonical_turns(record).alias("c"))
    part = F.struct(F.col(order).alias("o"), F.coalesce("c.turns", F.array().cast(TURNS)).alias("t"))
    whole = mapped.groupBy(group).agg(
        F.array_sort(F.collect_list(part)).alias("ps"), F.sum(F.col("c").isNull().cast("bigint")).alias("unknown")
    )
    turns = whole.select(group, F.flatten(F.transform("ps", lambda p: p["t"])).alias("turns"), "unknown")
    return turns.withColumn("f", formatted(F.col("turns"))).select(group, "turns", "f.text", "f.loss_spans", "unknown")
