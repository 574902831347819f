"""Chat formatting by schema fingerprints, with DataFrame operations only.

A record's fingerprint is the hash of its nested field paths (types left out). It selects a
declarative mapping, which says where the turns of that layout are. The template writes
``### role:`` and a line break, the escaped text, and ``</turn>`` with a line break. In
texts ``\\`` ``<`` and ``#`` are written as two characters each, so no text can look like a
marker, and replacing them backwards restores it.

Cases: null or missing texts and roles count as empty; a record of an unknown layout, or one
that is no JSON, has layout null, no turns and empty output; a text over the
parser's limit that it does not read fails (typed records have no limit); turns of a conversation given
as rows are ordered by turn (null first), then role, then text, and repeated rows are all
kept; a row without a conversation id is a conversation of its own; roles of rows of turns stay
as they are, those of records get their canonical names; empty tables give no rows; other columns do
not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "</turn>\n"
#: The longest string that try_parse_json reads; it gives null for a longer one, as for no JSON.
PARSED_CHARS = 20_000_000
#: Escapes, in the order of writing; read backwards.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c"), ("\n", "\\n")]


@dataclass(frozen=True)
class Layout:
    """Where the turns are: a list of messages, or fields that are one turn each."""

    name: str
    shape: str  # nested field paths in order
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, fields joined by a line break)


def _object(*names: str) -> str:
    return "OBJECT<" + ", ".join(sorted(names)) + ">"


def _messages(name: str, field: str, role: str, text: str, *more: str) -> Layout:
    return Layout(name, _object(f"{field}: ARRAY<{_object(role, text)}>", *more), field, role, text)


def _fields(name: str, *turns: tuple[str, tuple[str, ...]]) -> Layout:
    return Layout(name, _object(*(f for _, fields in turns for f in fields)), fields=turns)


LAYOUTS = [
    _messages("messages", "messages", "role", "content"),
    _messages("messages_id", "messages", "role", "content", "id"),
    _messages("turns", "turns", "role", "text"),
    _messages("conversations", "conversations", "from", "value"),
    _messages("conversations_id", "conversations", "from", "value", "id"),
    _messages("dialog", "dialog", "speaker", "utterance"),
    _fields("prompt_response", ("user", ("prompt",)), ("assistant", ("response",))),
    _fields("prompt_completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _fields("system_prompt_response", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    _fields("instruction", ("user", ("instruction",)), ("assistant", ("output",))),
    _fields("instruction_input", ("user", ("instruction", "input")), ("assistant", ("output",))),
    _fields("question_answer", ("user", ("question",)), ("assistant", ("answer",))),
]
# Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def shape(payload: Column) -> Column:
    """The nested field paths of a JSON text, types left out; null if it is no JSON."""
    described = F.schema_of_variant(F.try_parse_json(payload))
    return F.regexp_replace(described, r": (?!ARRAY|OBJECT)[A-Z]+(\([0-9, ]*\))?", "")


def fingerprint(payload: Column) -> Column:
    return F.sha2(shape(payload), 256)


def _canonical_role(role: Column) -> Column:
    out = role
    for name, known in ROLES.items():
        out = F.when(role == name, F.lit(known)).otherwise(out)
    return out


def _mapped(layout: Layout, get: Callable[[str, str], Column], rename: bool = True) -> Column:
    """The turns of a layout, with ``get(field, type)`` for the fields of a record."""
    named = _canonical_role if rename else lambda role: role
    empty = F.lit("")
    if layout.messages:
        found = get(layout.messages, f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        return F.transform(found, lambda m: F.struct(named(F.coalesce(m[layout.role].cast("string"), empty)).alias("role"), F.coalesce(m[layout.text].cast("string"), empty).alias("text")))
    turns = []
    for role, fields in layout.fields:
        parts = [F.coalesce(get(f, "string").cast("string"), empty) for f in fields]
        text = parts[0]
        for part in parts[1:]:
            text = F.when(part == "", text).otherwise(F.concat(text, F.lit("\n"), part))
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def _turns(layout: Layout, payload: Column) -> Column:
    parsed = F.try_parse_json(payload)
    return _mapped(layout, lambda f, kind: F.variant_get(parsed, f"$.{f}", kind))


def _type_shape(kind: T.DataType) -> str | None:
    """The nested field paths of a type, as a layout has them; null for a scalar."""
    if isinstance(kind, T.StructType):
        inner = [(f.name, _type_shape(f.dataType)) for f in kind.fields]
        return _object(*(n if s is None else f"{n}: {s}" for n, s in inner))
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_type_shape(kind.elementType) or kind.elementType.simpleString().upper()}>"
    return None


def typed_turns(records: DataFrame, record: str = "record", layouts: list[Layout] = LAYOUTS, rename: bool = True) -> DataFrame:
    """Like ``canonical_turns`` for records that are a struct column, whose schema has the fingerprint.

    No JSON text is made, so no text or record is too long for a parser. Without ``rename``
    roles stay as they are.
    """
    known = _type_shape(records.schema[record].dataType)
    layout = next((x for x in layouts if x.shape == known), None)
    out = records.withColumn("fingerprint", F.sha2(F.lit(known), 256)).withColumn("layout", F.lit(layout and layout.name).cast("string"))
    turns = _mapped(layout, lambda f, _: F.col(record)[f], rename) if layout else F.lit(None)
    return out.withColumn("turns", F.coalesce(turns.cast(TURNS), F.array().cast(TURNS)))


def canonical_turns(records: DataFrame, payload: str = "payload", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns to records of JSON texts in any of the layouts."""
    text = F.col(payload)
    # a null of the parser means no JSON only below its limit
    late = F.try_parse_json(text).isNull() & (F.char_length(text) > PARSED_CHARS)
    failure = F.raise_error(F.concat(F.lit("a record is not parsed and may be longer than the JSON parser reads; characters: "), F.char_length(text).cast("string")))
    marks = records.withColumn("fingerprint", F.when(late, failure.cast("string")).otherwise(fingerprint(text)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        is_it = F.col("fingerprint") == F.sha2(F.lit(layout.shape), 256)
        name = F.when(is_it, F.lit(layout.name)).otherwise(name)
        turns = F.when(is_it, _turns(layout, F.col(payload))).otherwise(turns)
    return marks.withColumn("layout", name).withColumn("turns", F.coalesce(turns, F.array().cast(TURNS)))


def escape(text: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, written in escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, written in reversed(escapes):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_turns(records: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds formatted and loss_mask to records with turns.

    The mask has an entry for each turn: ``skip`` code points that are not trained on, then
    ``take`` code points that are, counted from the turn's own opening.
    """
    def written(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("train"))

    pieces = records.withColumn("_pieces", F.transform("turns", written))
    formatted = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    mask = F.transform("_pieces", lambda p: F.struct(F.char_length(p["head"]).alias("skip"), F.when(p["train"], F.char_length(p["body"])).otherwise(0).alias("take")))
    return pieces.withColumn("formatted", formatted).withColumn("loss_mask", mask).drop("_pieces")


def read_back(records: DataFrame) -> DataFrame:
    """Adds read_turns and loss_text, taken from formatted and loss_mask alone."""
    n = F.size("_cut") - 1
    cut = records.withColumn("_cut", F.split("formatted", CLOSE)).withColumn("_cut", F.slice("_cut", F.lit(1), n))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, AFTER_ROLE, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substr(piece, F.char_length(head) + len(AFTER_ROLE) + 1)).alias("text"))

    masked = F.zip_with("_cut", "loss_mask", lambda p, m: unescape(F.substr(p, m["skip"] + 1, m["take"])))
    return cut.withColumn("read_turns", F.transform("_cut", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("_cut")


def conversations_as_structs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns as one record per conversation: ``conv`` and record, a struct in the messages layout.

    A conversation is one output text, so its turns meet in one row; nothing larger is gathered.
    Rows without a conversation are one each, without meeting.
    """
    empty = F.lit("")
    one = F.struct(rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), empty).alias("role"), F.coalesce(rows[text].cast("string"), empty).alias("content"))
    turns = rows.select(rows[conv].alias(conv), one.alias("_turn"))
    grouped = turns.where(F.col(conv).isNotNull()).groupBy(conv).agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    grouped = grouped.unionByName(turns.where(F.col(conv).isNull()).select(conv, F.array("_turn").alias("_turns")))
    messages = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return grouped.select(conv, F.struct(messages.alias("messages")).alias("record"))


def conversations_as_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conversations_as_structs`` with the record as a JSON text: ``conv`` and payload."""
    return conversations_as_structs(rows, conv, turn, role, text).select(conv, F.to_json("record").alias("payload"))
