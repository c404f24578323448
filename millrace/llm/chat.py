"""Chat records of any known layout to canonical turns and training text (operator 7).

DataFrame functions only.

`layout_of` reduces a JSON record to the nested paths of its fields (names and
nesting in sorted order, no values, no scalar types) and hashes that: the
schema fingerprint.  A table of declarative mappings, one row of expressions
for each fingerprint, turns records into `turns array<struct<role, text>>`.
Records of a fingerprint that no mapping knows keep null turns and their
fingerprint, so that they can be counted and a mapping can be added.
Texts are emptied before the fields are looked at, and equal neighbours in a
list become one, so that a long text or many turns meet no limit of the parser.

`format_turns` writes the turns in one text (each turn between a start and an
end marker, control strings inside texts broken by a backslash, backslashes
doubled) with the loss mask: for each turn the code points of the template ahead
of its text, those of its text, and whether they are in the loss, so that all
lengths (with one end marker for each turn) add up to the whole text.
`read_turns` and `masked_text` cut the text once at its markers and read both
back.  Everything takes time in proportion to the text, however many turns.

Defined results: null text or role is empty; no turns give an empty text; a
text of any length stays whole; turns of equal number are ordered by role, then
text.  A conversation is one output record, so its turns must meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: markers of the template
START, END = "<|im_start|>", "<|im_end|>\n"
#: fixed values: strings that tokenizers treat as control tokens in public chat templates
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: an occurrence of a control string: its first character, and what must follow
_FIRST = r"(<(?=\||/s>|s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]))"

#: inside of a JSON string; possessive, so that Java's matcher needs no stack
_INSIDE = r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+'
#: a name with its colon, or the quotes of a text
_NAME_OR_TEXT = rf'("{_INSIDE}"\s*+:)|("){_INSIDE}(")'
#: a string, or an object without nested ones and its equal neighbours
_EQUAL = rf'("{_INSIDE}")|(\{{(?:[^{{}}\[\]"]|"{_INSIDE}")*+\}})(?:\s*+,\s*+\2)++'
#: characters without texts from which neighbours are looked at; what is shorter fits a variant (128 MiB)
_MANY = 1 << 24
#: the reader's own limit is 20,000,000 characters
_WHOLE = {"maxStringLen": str((1 << 31) - 1)}

TURNS = "array<struct<role:string,text:string>>"


def _bare(record: Column) -> Column:
    """A JSON text with empty texts; what is no JSON text stays none."""
    bare = F.regexp_replace(record, _NAME_OR_TEXT, "$1$2$3")
    return F.when(F.length(bare) > _MANY, F.regexp_replace(bare, _EQUAL, "$1$2")).otherwise(bare)


def field_paths(record: Column) -> Column:
    """Nested field paths of a JSON text, without values and scalar types; null if it is no object.

    An error if a JSON text is too large for a variant even without its texts."""
    bare = _bare(record)
    kind = F.schema_of_variant(F.try_parse_json(bare))
    broken = F.from_json(bare, "_broken string", {**_WHOLE, "columnNameOfCorruptRecord": "_broken"})["_broken"]
    lost = kind.isNull() & (F.length(bare) > _MANY) & broken.isNull()
    kind = F.when(lost, F.raise_error(F.lit("a record is too large for its fields to be read"))).otherwise(kind)
    bare = F.regexp_replace(kind, r": (?!OBJECT<|ARRAY<)[A-Z][A-Z0-9_]*(\([0-9, ]*\))?", "")
    bare = F.regexp_replace(bare, r"ARRAY<(?!OBJECT|ARRAY)[A-Z][A-Z0-9_]*(\([0-9, ]*\))?>", "ARRAY<>")
    return F.when(F.startswith(kind, F.lit("OBJECT")), bare)


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _turn(role, text) -> Column:
    blank = F.lit("")
    return F.struct(F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))


def _get(name: str) -> Column:
    return F.from_json("record", f"`{name}` string", _WHOLE)[name]


def _messages(name: str, role: str, text: str) -> Column:
    rows = F.from_json("record", f"`{name}` array<struct<`{role}`:string,`{text}`:string>>", _WHOLE)[name]
    return F.transform(rows, lambda m: _turn(m[role], m[text]))


def _renamed(turns: Column) -> Column:
    names = {"human": "user", "gpt": "assistant", "bot": "assistant"}
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(turns, lambda t: _turn(F.coalesce(pairs[t["role"]], t["role"]), t["text"]))


def _pair(ask: str, answer: str) -> Column:
    return F.array(_turn(F.lit("user"), _get(ask)), _turn(F.lit("assistant"), _get(answer)))


def _instruction(with_input: bool) -> Column:
    ask = F.coalesce(_get("instruction"), F.lit(""))
    if with_input:
        more = F.coalesce(_get("input"), F.lit(""))
        ask = F.when(more == "", ask).otherwise(F.concat(ask, F.lit("\n\n"), more))
    return F.array(_turn(F.lit("user"), ask), _turn(F.lit("assistant"), _get("output")))


#: field paths of a layout -> how its turns are read
MAPPINGS = {
    "OBJECT<messages: ARRAY<OBJECT<content, role>>>": lambda: _messages("messages", "role", "content"),
    "OBJECT<conversations: ARRAY<OBJECT<from, value>>>": lambda: _renamed(_messages("conversations", "from", "value")),
    "OBJECT<prompt, response>": lambda: _pair("prompt", "response"),
    "OBJECT<completion, prompt>": lambda: _pair("prompt", "completion"),
    "OBJECT<answer, question>": lambda: _pair("question", "answer"),
    "OBJECT<instruction, output>": lambda: _instruction(False),
    "OBJECT<input, instruction, output>": lambda: _instruction(True),
    "OBJECT<prompt, response, system>": lambda: F.concat(
        F.array(_turn(F.lit("system"), _get("system"))), _pair("prompt", "response")
    ),
}


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with `fingerprint` and `turns`; turns are null where no mapping fits."""
    rows = records.withColumn("record", F.col(f"`{record_col}`")).withColumn("_paths", field_paths(F.col("record")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("_paths")))
    turns = F.lit(None).cast(TURNS)
    for paths, mapping in reversed(MAPPINGS.items()):
        known = F.col("fingerprint") == fingerprint(F.lit(paths))
        turns = F.when(known, mapping()).otherwise(turns)
    return rows.withColumn("turns", turns.cast(TURNS)).drop("_paths")


def as_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one JSON record for each conversation.

    A single exchange becomes a prompt and its response (with a system text if
    there is one), other conversations a list of messages.
    """
    blank = F.lit("")
    turn = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("content"))
    groups = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))
    m, roles = F.col("m"), F.transform("m", lambda t: t["role"])
    single = F.struct(m[0]["content"].alias("prompt"), m[1]["content"].alias("response"))
    system = F.struct(
        m[0]["content"].alias("system"), m[1]["content"].alias("prompt"), m[2]["content"].alias("response")
    )
    messages = F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(single))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(system))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return groups.select("conv_id", record.alias("record"))


def escaped(text: Column) -> Column:
    """Reversible: backslashes doubled, then one after the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _FIRST, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def format_turns(rows: DataFrame, turns_col: str = "turns") -> DataFrame:
    """rows with `formatted` and `loss_mask` array<struct<ahead, length, loss>>, one for each turn, in code points."""
    pieces = F.transform(
        F.coalesce(F.col(turns_col), F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    rows = rows.withColumn("_pieces", pieces)
    body = F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    mask = F.transform(
        "_pieces",
        lambda p: F.struct(F.length(p["head"]).alias("ahead"), F.length(p["body"]).alias("length"), p["loss"].alias("loss")),
    )
    return rows.withColumn("formatted", F.array_join(body, "")).withColumn("loss_mask", mask).drop("_pieces")


def _turn_texts(formatted: Column) -> Column:
    """Formatted turns without their start markers; no text holds a whole marker."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p, i: i > 0)


def read_turns(formatted: Column) -> Column:
    """Turns parsed from a formatted text, unescaped."""
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n"

    def turn(p):
        role = F.regexp_extract(p, head, 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(_turn_texts(formatted), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""

    def text(turn, m):
        return F.when(m["loss"], unescaped(F.substring(turn, m["ahead"] - F.lit(len(START) - 1), m["length"])))

    return F.array_join(F.zip_with(_turn_texts(formatted), mask, text), "")
