"""Chat formatting: layouts are recognised by their field paths, turns become one marked text.

The nested field paths of a table, or of each JSON record, are hashed; the fingerprint selects a
declarative mapping to canonical turns (conv_id, turn, role, text). Everything is DataFrame
expressions: no Python runs on the executors.

The template marks turns as ``<|im_start|>role\\n text<|im_end|>\\n``. In texts and roles a control string cannot
occur: ``<``, any number of backslashes and ``|`` get one backslash more, which reading takes off.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"

#: Per layout: its field paths, and the turns as an array of (role, text), or null for a row a turn.
LAYOUTS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "rows": (("conv_id", "role", "text", "turn"), None),
    "messages": (("conv_id", "messages[].content", "messages[].role"),
                 "transform(messages, x -> struct(x.role as role, x.content as text))"),
    "shared": (("conv_id", "conversations[].from", "conversations[].value"),
               "transform(conversations, x -> struct(case x.`from` when 'human' then 'user' when 'gpt' then 'assistant' "
               "else x.`from` end as role, x.value as text))"),
    "prompt": (("completion", "conv_id", "prompt"),
               "array(struct('user' as role, prompt as text), struct('assistant' as role, completion as text))"),
    "instruction": (("conv_id", "input", "instruction", "output"),
                    "array(struct('user' as role, case when coalesce(input, '') = '' then instruction "
                    "else concat(instruction, '\\n\\n', input) end as text), struct('assistant' as role, output as text))"),
}


def field_paths(kind: DataType, at: str = "") -> Iterator[str]:
    """The leaf paths of a schema; ``[]`` stands for an array's elements."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, ArrayType):
        yield from field_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


OPTIONAL = {"input"}     # may be left out of a record, and of the print
_KNOWN = {p for paths, _ in LAYOUTS.values() for p in paths} - OPTIONAL
_BY_PRINT = {fingerprint(set(paths) - OPTIONAL): name for name, (paths, _) in LAYOUTS.items()}


def to_turns(records: DataFrame) -> DataFrame:
    """A table in any known layout → (conv_id, turn, role, text).

    Fields that no layout knows are ignored; an unknown layout raises. Null lists give no turns.
    """
    found = _BY_PRINT.get(fingerprint(p for p in field_paths(records.schema) if p in _KNOWN))
    if found is None:
        raise ValueError(f"no layout has the fields {sorted(field_paths(records.schema))}")
    paths, turns = LAYOUTS[found]
    records = records.withColumns({p: F.lit(None).cast("string") for p in OPTIONAL.intersection(paths).difference(records.columns)})
    if turns is None:
        return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return records.select(F.col("conv_id").cast("long"), F.posexplode(F.expr(turns)).alias("turn", "x")).select(
        "conv_id", F.col("turn").cast("long"), "x.role", "x.text")


_JSON = {"messages": "messages array<struct<role string, content string>>",
         "shared": "conversations array<struct<`from` string, value string>>",
         "prompt": "prompt string, completion string",
         "instruction": "instruction string, input string, output string"}


def _has_key(name: str) -> Callable[[Column], Column]:
    return lambda record: F.array_contains(F.json_object_keys(record), name)


def _print(column: str) -> Column:
    """The hash of those field paths of a JSON record that layouts know; a list has the paths of all its elements."""
    keys, found = F.json_object_keys(column), []
    for path in sorted(_KNOWN - set(LAYOUTS["rows"][0])):
        key, _, inner = path.partition("[].")
        has = F.array_contains(keys, key)
        if inner:
            items = F.from_json(F.get_json_object(column, f"$.{key}"), "array<string>")
            has = has & F.exists(items, _has_key(inner))
        found.append(F.when(F.coalesce(has, F.lit(False)), F.lit(path)))
    return F.sha2(F.array_join(F.array(*found), "\n"), 256)


def _matched(column: str) -> tuple[dict[str, Column], Column]:
    """Per layout whether a JSON record fits it, and why it fits none (null if it fits one)."""
    shape = F.expr(f"schema_of_variant(try_parse_json({column}))")
    nested = shape.rlike(r"\b(content|role|from|value|prompt|completion|instruction|input|output): (ARRAY|OBJECT)<")
    own = _print(column)
    fits = {name: own == fingerprint(set(LAYOUTS[name][0]) - OPTIONAL - {"conv_id"}) for name in _JSON}
    known = own.isin([fingerprint(set(LAYOUTS[name][0]) - OPTIONAL - {"conv_id"}) for name in _JSON])
    reason = (F.when(shape.isNull(), "no JSON").when(~known, "no layout has its fields")
              .when(nested, "a text or role is no plain value"))
    return {name: reason.isNull() & fit for name, fit in fits.items()}, reason


def json_to_turns(records: DataFrame, column: str = "json") -> DataFrame:
    """``records`` (conv_id, JSON text in mixed layouts) → turns; each record's paths are hashed.

    Fields that no layout knows are ignored. Records that are no JSON, or whose layout is unknown, have no turns:
    ``unmatched`` returns them.
    """
    fits, _ = _matched(column)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, fields in _JSON.items():
        # the mapping of the layout, over the record's fields
        records = records.withColumns({f"_{name}": F.from_json(column, fields)})
        lists = re.sub(r"\b(messages|conversations|prompt|completion|instruction|input|output)\b", rf"_{name}.\1", LAYOUTS[name][1])
        turns = F.when(fits[name], F.expr(lists)).otherwise(turns)
    return records.select(F.col("conv_id").cast("long"), F.posexplode(turns).alias("turn", "x")).select(
        "conv_id", F.col("turn").cast("long"), "x.role", "x.text")


def unmatched(records: DataFrame, column: str = "json") -> DataFrame:
    """The records that ``json_to_turns`` gives no turns for want of a layout, with ``reason`` added."""
    return records.withColumn("reason", _matched(column)[1]).where("reason is not null")


def escaped(text: Column) -> Column:
    """The text without control strings, reversibly."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) → conv_id, formatted, segments; a row per conversation.

    Turns go by ``turn`` (null first), then role and text; a null role or text is empty. Repeated rows are
    turns of their own. ``segments`` lists each turn's text in order: start and length in code
    points of ``formatted``, and ``loss``, true for assistant texts only. A null conv_id is a
    conversation. No rows give no rows; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _role(role), F.lit("\n"))
    pieces = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    pieces = pieces.withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    order = "over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)"
    placed = pieces.selectExpr("conv_id", f"row_number() {order} as at", "head", "body", "role",
                               f"sum(size) {order} - size + length(head) as start")
    turn = F.struct("at", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), F.struct(
        "start", F.length("body").cast("long").alias("length"), (F.col("role") == "assistant").alias("loss")).alias("segment"))
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return chats.select("conv_id", F.array_join("turns.piece", "").alias("formatted"), F.col("turns.segment").alias("segments"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Formatted chats read back: conv_id, turns (role, text), loss_texts, formatted_chars."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    body = F.transform(parts, lambda p: F.substr(p, F.lit(len(START) + 1)))
    turns = F.transform(body, lambda p: F.struct(
        _unrole(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))
    under = F.filter(F.zip_with(body, "segments", lambda p, s: F.when(s["loss"], unescaped(F.right(p, s["length"].cast("int"))))),
                     lambda x: x.isNotNull())
    return chats.select("conv_id", turns.alias("turns"), under.alias("loss_texts"),
                        F.length("formatted").cast("long").alias("formatted_chars"))


def given_chats(spark: SparkSession, records: list[tuple[int, str]]) -> DataFrame:
    """Turns of records given as JSON text."""
    rows = [spark.range(1).select(F.lit(k).cast("long").alias("conv_id"), F.lit(t).alias("json")) for k, t in records]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return json_to_turns(out)
