"""Chat formatting by schema fingerprints.

The nested field paths of a record are hashed; the hash selects a declarative mapping that turns prompt,
instruction and message layouts into canonical turns, array<struct<role, text>>. One template then marks
the turns, escapes control strings inside texts reversibly and reports the loss mask as character ranges.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_starts

#: Levels of nesting of unknown fields that are ignored.
DEEPEST = 4
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """skeleton: the nested field paths; ddl: the type of a record; turns: SQL for the canonical turns of record `r`."""

    name: str
    skeleton: str
    ddl: str
    turns: str


def _pair(prompt: str, answer: str) -> str:
    return f"array(struct('user' as role, {prompt} as text), struct('assistant' as role, {answer} as text))"


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content: _, role: _>>>", "messages array<struct<content:string,role:string>>", "transform(r.messages, m -> struct(m.role as role, m.content as text))"),
    Layout("from_value", "OBJECT<conversations: ARRAY<OBJECT<from: _, value: _>>>", "conversations array<struct<`from`:string,value:string>>", "transform(r.conversations, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))"),
    Layout("prompt_response", "OBJECT<prompt: _, response: _>", "prompt string, response string", _pair("r.prompt", "r.response")),
    Layout("prompt_completion", "OBJECT<completion: _, prompt: _>", "prompt string, completion string", _pair("r.prompt", "r.completion")),
    Layout("instruction", "OBJECT<instruction: _, output: _>", "instruction string, output string", _pair("r.instruction", "r.output")),
    Layout("instruction_input", "OBJECT<input: _, instruction: _, output: _>", "instruction string, input string, output string", _pair("concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))", "r.output")),
    Layout("turn_rows", "OBJECT<rows: ARRAY<OBJECT<role: _, text: _, turn: _>>>", "`rows` array<struct<turn:bigint,role:string,text:string>>", "transform(array_sort(r.rows), m -> struct(m.role as role, m.text as text))"),
)


#: Names of the known fields. Others are left out of a skeleton, so a record may hold more than its layout asks for.
FIELDS = sorted({name for x in LAYOUTS for name in re.findall(r"(\w+): ", x.skeleton)})


def fingerprint(skeleton: Column) -> Column:
    return F.xxhash64(skeleton)


def json_skeleton(record: Column) -> Column:
    """Nested paths of the known fields of a JSON text; null if it is not JSON, or over the 128 MB of a variant."""
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), r"\b(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP|DECIMAL\(\d+,\s*\d+\))", "_")
    unknown = rf"(?:`(?:[^`]|``)*+`|\b(?!(?:{'|'.join(FIELDS)}):)[^\s:,<>`]++): (?:_|OBJECT<[^<>]*+>|ARRAY<(?:_|OBJECT<[^<>]*+>|ARRAY<_>)?>)(?:, |(?=>))"
    for _ in range(DEEPEST):  # a field that holds others goes after them
        shape = F.regexp_replace(F.regexp_replace(shape, unknown, ""), ", >", ">")
    return shape


def turns_of_json(df: DataFrame, record: str) -> DataFrame:
    """df with (layout, turns). The hash of a record's field paths selects its layout, and the record is parsed as
    that layout only. Unknown fields are ignored. A record of no known layout, or none, has null in both and stays."""
    read = df.withColumn("_mark", fingerprint(json_skeleton(F.col(record))))
    layout, turns = F.when(F.lit(False), ""), F.when(F.lit(False), F.array().cast(TURNS))
    for x in LAYOUTS:
        hit = F.col("_mark") == fingerprint(F.lit(x.skeleton))
        layout = layout.when(hit, x.name)
        turns = turns.when(hit, F.expr(f"transform(array(from_json(`{record}`, '{x.ddl}')), r -> {x.turns})[0]").cast(TURNS))
    return read.withColumns({"layout": layout, "turns": turns}).drop("_mark")


def escape(text: Column) -> Column:
    """Puts a backslash into every `<|`, and one more into every `<\\|` ..., so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    back = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*+)\\n", "$1\n")
    return F.replace(back, F.lit("\\\\"), F.lit("\\"))


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def format_chat(df: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """df(turns) with formatted and loss, the ranges (start, length in code points) of formatted that are trained on.

    No turns, or null, give an empty text and no range.
    """
    turns = F.coalesce("turns", F.array().cast(TURNS))
    empty = F.lit("")
    out = df.withColumn("turns", turns).withColumns(
        {
            "_heads": F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape_role(F.coalesce(t["role"], empty)), F.lit("\n"))),
            "_bodies": F.transform("turns", lambda t: escape(F.coalesce(t["text"], empty))),
        }
    )
    out = out.withColumn("formatted", F.array_join(F.zip_with("_heads", "_bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))), ""))
    out = out.withColumn("_sizes", F.zip_with("_heads", "_bodies", lambda h, b: (F.length(h) + F.length(b) + len(CLOSE)).cast("long")))
    out = out.withColumn("_starts", running_starts(F.col("_sizes")))
    ranges = F.transform(
        F.arrays_zip("_starts", "_heads", "_bodies", "turns"),
        lambda z: F.struct((z["_starts"] + F.length(z["_heads"])).alias("start"), F.length(z["_bodies"]).cast("long").alias("length"), z["turns"]["role"].alias("role")),
    )
    loss = F.transform(F.filter(ranges, lambda z: F.coalesce(z["role"], empty) == trained_role), lambda z: F.struct(z["start"].alias("start"), z["length"].alias("length")))
    return out.withColumn("loss", loss).drop("_heads", "_bodies", "_sizes", "_starts")


def read_back(df: DataFrame) -> DataFrame:
    """df(formatted, loss) with read_turns and loss_text, taken from the formatted text alone."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    role = lambda p: F.substring_index(p, "\n", 1)
    turn = lambda p: F.struct(
        unescape_role(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(CLOSE))).alias("text")
    )
    said = F.array_join(F.transform("loss", lambda z: unescape(F.substr("formatted", (z["start"] + 1).cast("int"), z["length"].cast("int")))), "")
    df = df.withColumn("_pieces", pieces)
    return df.withColumn("read_turns", F.transform(F.slice("_pieces", 2, F.greatest(F.size("_pieces") - 1, F.lit(0))), turn)).withColumn("loss_text", said).drop("_pieces")


def conversations_to_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) for each conv_id of rows(conv_id, turn, role, text): a JSON text in the plainest layout that
    holds the conversation. One user turn with its answer is a prompt and a response, or, where the prompt has an
    empty line, an instruction with its input; turns of user and assistant are from-value pairs; other roles make messages,
    and roles that a from-value pair would read as others make rows.

    A record holds its conversation, as the result asks for one text per conversation. Rows with the same
    turn go by role and text; a null turn goes first; null roles and texts are empty; a null conv_id is one
    conversation. No rows give none.
    """
    empty = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    out = rows.select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_t"))
    roles, first, second = F.transform("_t", lambda t: t["role"]), F.get("_t", F.lit(0))["text"], F.get("_t", F.lit(1))["text"]
    alone = (F.size("_t") == 2) & (F.get(roles, F.lit(0)) == "user") & (F.get(roles, F.lit(1)) == "assistant")
    head, tail = F.substring_index(first, "\n\n", 1), F.substr(first, F.length(F.substring_index(first, "\n\n", 1)) + 3)
    parted = alone & first.contains("\n\n") & (head != "") & (tail != "")
    said = {"user": "human", "assistant": "gpt"}
    renamed = lambda role: F.when(role == "user", said["user"]).when(role == "assistant", said["assistant"]).otherwise(role)
    plain = F.forall(roles, lambda r: r.isin(*said))
    other = F.forall(roles, lambda r: ~r.isin(*said.values()))
    record = (
        F.when(parted, F.to_json(F.struct(head.alias("instruction"), tail.alias("input"), second.alias("output"))))
        .when(alone, F.to_json(F.struct(first.alias("prompt"), second.alias("response"))))
        .when(plain, F.to_json(F.struct(F.transform("_t", lambda t: F.struct(renamed(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .when(other, F.to_json(F.struct(F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
        .otherwise(F.to_json(F.struct(F.transform("_t", lambda t, i: F.struct(i.alias("turn"), t["role"].alias("role"), t["text"].alias("text"))).alias("rows"))))
    )
    return out.select("conv_id", record.alias("record"))
