"""Chat formatting: layouts told apart by fingerprint, one template, a loss mask.

A layout is declared by the nested field paths it requires, with lists marked:
`messages[].role`, `messages[].content`. Of a record's paths those that any layout
requires are sorted and hashed; the SHA-256 is the fingerprint that picks a mapping, an
expression that turns the record into canonical turns (turn, role, text). Other fields
are optional (an id, a number of a turn, an input, a system text, a name) or not read.
Tables have one layout, found in their schema; a column of JSON records may have another
in each row, found in its keys and its variant schema.

The template writes `<|turn|>role<|text|>text<|end|>` and a line end. Within roles
and texts a backslash becomes two, and the first character of every control string
(those of the template and of well-known chat formats) is followed by a backslash.
No control string is left inside a text, and removing one backslash of each pair
and every other backslash restores it.

Every turn is formatted on its own row, so no conversation has to fit one task; the
formatted conversation is its rows' pieces in the order of `position`. Reading back
sorts pieces within partitions and goes through them in a stream.

Edge cases: a null role or text is empty. Turns of a conversation that share a
number follow each other by role, then text; null numbers come first. Null
conv_ids are one conversation, and so are records without an id. A record with an empty
list has no turns. A list's turns are numbered by place unless they bring a number; a
system text beside them is turn -1. JSON records that are no object, have no known
fingerprint (also: paths of two layouts) or exceed what a variant may hold come back
whole, as unknown. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from absentia.llm.texts import map_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"

# Control strings of the template and of public chat formats.
CONTROL_STRINGS = (
    "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<bos>", "<eos>", "<pad>", "<unk>", "<start_of_turn>", "<end_of_turn>",
)
_CONTROL = "|".join(re.escape(c) for c in CONTROL_STRINGS)

# Names of roles in other formats.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A declared record layout: the paths it requires, its type, its id, and its turns
    as an array. Fields of the type that are not required may be absent."""

    name: str
    required: tuple[str, ...]
    ddl: str
    id_field: str
    turns: Callable[[Column], Column]

    @property
    def fields(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


def _turn(number, role, text) -> Column:
    return F.struct(
        F.lit(number).cast("long").alias("turn") if isinstance(number, int)
        else number.cast("long").alias("turn"),
        (F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"),
        text.cast("string").alias("text"),
    )


def _after_system(r: Column, turns: Column) -> Column:
    system = F.array(_turn(-1, "system", r["system"]))
    return F.when(r["system"].isNull(), turns).otherwise(F.concat(system, turns))


def _listed(items: str, role: str, text: str) -> Callable[[Column], Column]:
    def turns(r: Column) -> Column:
        listed = F.coalesce(r[items], F.array())
        return _after_system(r, F.transform(
            listed, lambda x, i: _turn(F.coalesce(x["turn"], i), _canonical_role(x[role]), x[text])
        ))

    return turns


def _canonical_role(role: Column) -> Column:
    name = F.lower(role)
    for other, ours in ROLE_NAMES.items():
        name = F.when(F.lower(role) == other, ours).otherwise(name)
    return name


def _instruction(r: Column) -> Column:
    empty = F.coalesce(r["input"], F.lit("")) == ""
    asked = F.when(empty, r["instruction"]).otherwise(F.concat_ws("\n\n", r["instruction"], r["input"]))
    return _after_system(r, F.array(_turn(0, "user", asked), _turn(1, "assistant", r["output"])))


def _prompt(r: Column) -> Column:
    return _after_system(r, F.array(_turn(0, "user", r["prompt"]), _turn(1, "assistant", r["completion"])))


LAYOUTS = (
    Layout("turn rows", ("role", "text"), "conv_id bigint, turn bigint, role string, text string", "conv_id",
           lambda r: F.array(_turn(r["turn"], r["role"], r["text"]))),
    Layout("messages", ("messages[].role", "messages[].content"),
           "id bigint, system string, messages array<struct<role string, content string, turn bigint>>", "id",
           _listed("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"),
           "id bigint, system string, conversations array<struct<from string, value string, turn bigint>>", "id",
           _listed("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"),
           "id bigint, system string, instruction string, input string, output string", "id", _instruction),
    Layout("prompt", ("prompt", "completion"),
           "id bigint, system string, prompt string, completion string", "id", _prompt),
)


def paths_of(kind: T.DataType, at: str = "") -> Iterator[str]:
    """The nested field paths of a type, lists marked, scalars without their type."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from paths_of(kind.elementType, at + "[]")
    else:
        yield at


def _read_paths(layouts: Iterable[Layout]) -> list[str]:
    return sorted({p for x in layouts for p in x.required})


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def json_fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The fingerprint of a JSON record; null if it is no JSON object."""
    keys = F.json_object_keys(record)
    found = []
    for path in _read_paths(layouts):
        outer, _, inner = path.partition("[].")
        if inner:
            # An empty list may be of any kind of items.
            part = F.try_variant_get(F.try_parse_json(record), f"$.{outer}", "variant")
            there = F.schema_of_variant(part).rlike(rf"^ARRAY<(VOID>$|OBJECT<(.*[ <])?{inner}: )")
        else:
            there = F.array_contains(keys, path)
        found.append(F.when(F.coalesce(there, F.lit(False)), path))
    known = F.concat_ws("\n", *found)
    return F.when(keys.isNotNull() & F.try_parse_json(record).isNotNull(), F.sha2(known, 256))


def _mapping(schema: T.StructType, layouts: tuple[Layout, ...]) -> Layout:
    """The layout with the schema's fingerprint; else, as columns of other layouts may be
    there, the one that requires most among those whose required paths are all there."""
    own = set(paths_of(schema))
    known = {fingerprint(x.required): x for x in layouts}
    if found := known.get(fingerprint(own.intersection(_read_paths(layouts)))):
        return found
    fits = [x for x in layouts if own.issuperset(x.required)]
    if not fits:
        raise ValueError(f"no mapping for {schema.simpleString()}")
    return max(fits, key=lambda x: len(x.required))


def _given(field: T.StructField, own: T.StructType, of: Callable[[str], Column]) -> Column:
    """A declared field from a record of type `own`; null where it is absent."""
    if field.name not in own.names:
        return F.lit(None).cast(field.dataType).alias(field.name)
    value, kind = of(field.name), field.dataType
    if isinstance(kind, T.ArrayType):
        items = own[field.name].dataType.elementType
        value = F.transform(value, lambda x: F.struct(*[
            _given(f, items, lambda name: x[name]) for f in kind.elementType.fields]))
    return value.alias(field.name)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text of a table in any declared layout."""
    layout = _mapping(records.schema, layouts)
    record = F.struct(*[
        _given(f, records.schema, lambda name: F.col(f"`{name}`")) for f in layout.fields.fields])
    named = records.select(record.alias("record"))
    return named.select(
        F.col("record")[layout.id_field].cast("long").alias("conv_id"),
        F.inline(layout.turns(F.col("record"))),
    )


def canonical_turns_of_json(
    records: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """conv_id, turn, role, text of JSON records of mixed layouts, in one pass.

    A record without a known layout gives one row with null turn, role and text, its
    fingerprint in `unknown` and itself in `record`, so that none is lost unseen.
    """
    own = records.select(F.col(column).alias("raw"), json_fingerprint(F.col(column), layouts).alias("print"))
    ids, turns = F.lit(None).cast("long"), F.array(_turn(F.lit(None), F.lit(None), F.lit(None)))
    known = F.lit(False)
    for x in layouts:
        match = F.col("print") == fingerprint(x.required)
        record = F.from_json("raw", x.fields)
        ids = F.when(match, record[x.id_field].cast("long")).otherwise(ids)
        turns = F.when(match, x.turns(record)).otherwise(turns)
        known = known | F.coalesce(match, F.lit(False))
    unknown = F.when(~known, F.coalesce("print", F.lit("not a JSON object")))
    return own.select(
        ids.alias("conv_id"), unknown.alias("unknown"), F.when(~known, F.col("raw")).alias("record"),
        F.inline(turns),
    )


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    # Looking ahead finds every start, also of control strings that overlap.
    return F.regexp_replace(doubled, f"(?=(?:{_CONTROL}))(.)", r"$1\\")


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, role, text order columns and `piece`, the turn as the template
    writes it; loss_start and loss_end, the code points of the piece under the loss
    mask (equal if none)."""
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.col("text"))
    has_loss = F.coalesce(F.col("role") == loss_role, F.lit(False))
    parts = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    start = F.length("head")
    return parts.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role_order"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        start.alias("loss_start"),
        F.when(has_loss, start + F.length("body")).otherwise(start).alias("loss_end"),
    )


_PIECE = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


_DIGESTS = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(),
    "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
}


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all_text, self.loss_text = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int) -> None:
        role, text = _PIECE.fullmatch(piece).groups()
        self.turns += 1
        self.chars += len(piece)
        self.all_text.update(f"{_plain(role)}\n{_plain(text)}\n".encode())
        masked = _plain(piece[start:end])
        self.loss += len(masked)
        self.loss_text.update(masked.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all_text.hexdigest(), self.loss,
                self.loss_text.hexdigest(), self.chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, parsed from the pieces: number of turns, digests
    of all turns and of the text under the loss mask, lengths."""

    def run(batches):
        now, done = None, []
        for batch in batches:
            for conv_id, piece, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(piece, start, end)
            yield packed(done)
            done = []
        yield packed([now.row()] if now is not None else [])

    def packed(rows):
        columns = list(zip(*rows)) or [()] * len(_DIGESTS)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _DIGESTS.values())], names=list(_DIGESTS)
        )

    # Turns of one number and role follow by their text as it was, not as it is escaped.
    body = F.substring(
        "piece", F.col("loss_start") + 1, F.length("piece") - F.col("loss_start") - len(END)
    )
    text = F.regexp_replace(body, r"(?s)\\(.)", "$1")
    ordered = formatted.repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role_order", text
    )
    return map_batches(
        ordered.select("conv_id", "piece", "loss_start", "loss_end"),
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )
