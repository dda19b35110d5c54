"""Chat formatting by schema fingerprints (DataFrame functions only).

A record is JSON. Its fingerprint is a hash of its nested field paths, without types and values; it selects one of the
declared layouts, whose mapping turns the record into canonical (role, text) turns. Records of unknown layout give no
turns and a null layout; `unmapped` counts them, and their conversation stays. Turns are rendered as

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>\\n          and, where the loss counts (assistant turns),
    <|im_start|>ROLE<|im_sep|><|loss|>TEXT<|/loss|><|im_end|>\\n

Control strings inside roles and texts -- these markers and those of other common templates -- get a backslash after
their first character (one more if they have some already), which `unescape` takes away again: any text round-trips.

Null roles and texts count as empty. Turns with the same number come in order of role, then text; repeated rows stay.
A conversation is rendered in pieces of 64 turn numbers that are joined last; its whole text must fit one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, SEP, END, LOSS, LOSS_END = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|loss|>", "<|/loss|>"
#: What may follow an opening character in a control string.
_TAIL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2")


# ------------------------------------------------------------------------------------------- layouts


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


#: Jackson stops at strings of 20,000,000 characters unless it is told otherwise.
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}
#: Longer records are blanked before their shape is taken.
LONG = 10_000_000


def _field(record: Column, name: str, kind: str = "string") -> Column:
    return F.from_json(record, f"`{name}` {kind}", _ANY_LENGTH)[name]


def _list(name: str, role: str, text: str):
    def turns(record: Column) -> Column:
        items = _field(record, name, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(items, lambda x: _turn(canonical_role(x[role]), x[text]))

    return turns


def canonical_role(role: Column) -> Column:
    return F.when(role == "human", "user").when(role.isin("gpt", "model", "bot"), "assistant").otherwise(role)


def _pair(user: str, assistant: str, extra: str | None = None, system: str | None = None):
    def turns(record: Column) -> Column:
        ask = F.coalesce(_field(record, user), F.lit(""))
        more = F.coalesce(_field(record, extra), F.lit("")) if extra else F.lit("")
        ask = F.when(more == "", ask).otherwise(F.concat(ask, F.lit("\n\n"), more))
        both = [_turn("user", ask), _turn("assistant", _field(record, assistant))]
        return F.array(*([_turn("system", _field(record, system))] if system else []), *both)

    return turns


def _row(record: Column) -> Column:
    return F.array(_turn(_field(record, "role"), _field(record, "content")))


#: layout -> (the shape of its field paths, mapping). Fields stand in alphabetical order.
LAYOUTS = {
    "message": ("OBJECT<content, role>", _row),
    "messages": ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", _list("messages", "role", "content")),
    "from_value": ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", _list("conversations", "from", "value")),
    "prompt_response": ("OBJECT<prompt, response>", _pair("prompt", "response")),
    "prompt_completion": ("OBJECT<completion, prompt>", _pair("prompt", "completion")),
    "system_prompt_response": ("OBJECT<prompt, response, system>", _pair("prompt", "response", system="system")),
    "question_answer": ("OBJECT<answer, question>", _pair("question", "answer")),
    "instruction_output": ("OBJECT<instruction, output>", _pair("instruction", "output")),
    "instruction_input_output": ("OBJECT<input, instruction, output>", _pair("instruction", "output", "input")),
    "instruction_context_response": ("OBJECT<context, instruction, response>", _pair("instruction", "response", "context")),
}


def _blanked(record: Column) -> Column:
    """The record with empty strings for its string values: its field paths in a size that does not depend on them."""
    return F.regexp_replace(F.regexp_replace(record, r"(?s)\\.", ""), r'"([^"]*+)"(\s*+:)|"[^"]*+"', '"$1"$2')


def shape(record: Column) -> Column:
    """The record's nested field paths without leaf types, or null if it is no JSON."""
    record = F.when(F.length(record) > LONG, _blanked(record)).otherwise(record)
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), r": [A-Z]+(\([0-9, ]*\))?(?=[,>])", "")


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds fingerprint, layout and turns (null if the layout is unknown) to every row."""
    fingerprint, record = F.col("fingerprint"), F.col(f"`{record_col}`")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, mapping) in LAYOUTS.items():
        hit = fingerprint == F.xxhash64(F.lit(paths))
        layout, turns = F.when(hit, name).otherwise(layout), F.when(hit, mapping(record)).otherwise(turns)
    return records.withColumn("fingerprint", F.xxhash64(shape(record))).withColumn("layout", layout).withColumn("turns", turns)


# ------------------------------------------------------------------------------- rendering and reading


def render(role: Column, text: Column) -> Column:
    body = F.when(role == "assistant", F.concat(F.lit(LOSS), escape(text), F.lit(LOSS_END))).otherwise(escape(text))
    return F.concat(F.lit(BEGIN), escape(role), F.lit(SEP), body, F.lit(END + "\n"))


def _quoted(marker: str) -> str:
    return marker.replace("|", "\\|")


def read_turns(formatted: Column) -> Column:
    """array<role, text, loss> out of a rendered conversation."""

    def one(t: Column) -> Column:
        cut = F.instr(t, SEP)
        body = F.substr(t, cut + len(SEP))
        loss = F.startswith(body, F.lit(LOSS))
        inner = F.when(loss, F.substr(body, F.lit(len(LOSS) + 1), F.length(body) - len(LOSS) - len(LOSS_END))).otherwise(body)
        return F.struct(unescape(F.substr(t, F.lit(len(BEGIN) + 1), cut - len(BEGIN) - 1)).alias("role"), unescape(inner).alias("text"), loss.alias("loss"))

    return F.transform(F.filter(F.split(formatted, _quoted(END) + "\n"), lambda t: t != ""), one)


def format_chats(records: DataFrame, id_col: str, order_col: str, record_col: str = "record") -> DataFrame:
    """conv_id, formatted: the turns of all of a conversation's records, in the order of `order_col`; unmapped: its records of unknown layout."""
    turns = canonical_turns(records.select(F.col(id_col).alias("conv_id"), F.col(order_col).alias("n"), F.col(record_col).alias("record")))
    turns = turns.select("conv_id", "n", F.col("layout").isNull().cast("long").alias("unmapped"), F.posexplode_outer("turns").alias("pos", "t"))
    turns = turns.select("conv_id", (F.col("n").cast("long") / 64).cast("long").alias("piece"), "unmapped", F.struct("n", "pos", "t.role", "t.text", render(F.col("t.role"), F.col("t.text")).alias("out")).alias("t"))
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["out"]), "")
    parts = turns.groupBy("conv_id", "piece").agg(piece.alias("out"), F.sum("unmapped").alias("unmapped"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "out"))), lambda t: t["out"]), "")
    return parts.groupBy("conv_id").agg(whole.alias("formatted"), F.sum("unmapped").alias("unmapped"))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives, as counts and digests."""
    turns = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("t"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("t", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def of_table(conversations: DataFrame) -> DataFrame:
    """Records of the conversations table (one message a row), and conversation -1 in the layout of message lists."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    record = F.to_json(F.struct(text("role").alias("role"), text("text").alias("content")))
    odd = "</s>[INST] ok [/INST]"
    fixed = F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(odd).alias("content")) for r in ("user", "assistant")]).alias("messages")))
    one = conversations.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), fixed.alias("record"))
    return conversations.select("conv_id", "turn", record.alias("record")).unionByName(one)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 0 AS pos FROM conversations
    UNION ALL SELECT -1, 0, r, '</s>[INST] ok [/INST]', p FROM (VALUES ('user', 0), ('assistant', 1)) v(r, p)),
e AS (SELECT *, '<|im_start|>' || regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') || '<|im_sep|>'
    || CASE WHEN role = 'assistant' THEN '<|loss|>' ELSE '' END || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')
    || CASE WHEN role = 'assistant' THEN '<|/loss|>' ELSE '' END || '<|im_end|>' || chr(10) AS o FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, pos, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, pos, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(o)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
