"""Chat formatting of records in many layouts.

A layout is recognised by its schema fingerprint: the hash of its nested field paths. Each known layout
has a declarative mapping from its fields to canonical turns (conv_id, conv_key, turn, role, text). Tables are mapped by
the fingerprint of their schema; columns of JSON records by the fingerprint of each record's own paths, so one
column may mix layouts. Fields that no layout names do not change a fingerprint. Besides its own fields, every layout of
whole conversations takes a ``system`` text, which becomes the first turn, and a ``history`` of earlier turns, as pairs or as
turns, which come next. A text may be a list of text parts.

No text is lost without a trace: a JSON record with a text that its layout has no place for (a second answer of a preference
pair, a part that is an image's address) stays in ``unmatched`` as a whole, unless the field is one of ``METADATA``.
``unmapped_columns`` names the columns of a table that its layout leaves out.

conv_key names a conversation: its id as text, or for a record without id a hash of its turns and a number
among the records with the same turns. conv_id is the id where it is a whole number, else null.

Turns are then rendered by a template that marks where each begins and ends. Control strings inside
a text are escaped, reversibly, so that only the template's own marks are marks. Each turn is one row,
with the span of it that a model is trained on (the assistant's text), so a conversation of any length is spread
over tasks until something has to read it as a whole.

Defined results: a null text or role is empty; turns with equal numbers follow each other by role and text, a null
number first; repeated rows are repeated turns; turns in rows with a null conv_id are a conversation of their own; turn numbers
that are no numbers are null; long texts are whole; an empty table has no turns; a record that gives no turns, of no known layout
for instance, stays in ``unmatched``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of roles in other layouts, and the canonical role.
ROLES = {
    "human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant",
    "chatbot": "assistant",
}

#: Fields of a record that say something about it and are no part of what was said.
METADATA = (
    "id", "conv_id", "conversation_id", "uuid", "type", "name", "model", "source", "dataset", "split", "category", "tags",
    "lang", "language", "license", "url", "created_at", "timestamp", "weight", "score", "n",
)
SYSTEM, HISTORY = "system", "history"


# --- layouts ---

def fingerprint(paths: Sequence[str]) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A layout's paths and where its turns are.

    ``turns`` is the path of an array of turns with the fields ``role`` and ``text``; or, without it, ``parts``
    are pairs of role and the paths that are joined by a blank line to that role's text; or, with
    neither, a row is one turn and ``row`` names its columns.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), row=("turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Layout("turns", ("turns[].role", "turns[].text"), turns="turns", role="role", text="text"),
    Layout("instruction_input", ("instruction", "input", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt_completion", ("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", ("question", "answer"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
)
BY_FINGERPRINT = {layout.fingerprint: layout for layout in LAYOUTS}


def field_paths(kind: T.DataType, stem: str = "") -> list[str]:
    """The paths of all leaves of a type; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{stem}.{f.name}" if stem else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{stem}[]")
    return [stem]


def recognised(paths: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> Layout | None:
    """The first layout whose fingerprint the paths have, among the paths that the layout names."""
    return next((x for x in layouts if fingerprint([p for p in paths if p in x.paths]) == x.fingerprint), None)


def _role(name: Column) -> Column:
    known = F.coalesce(name.cast("string"), F.lit(""))
    canonical = known
    for other, role in ROLES.items():
        canonical = F.when(F.lower(known) == other, F.lit(role)).otherwise(canonical)
    return canonical


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _numbered(turns: Column) -> Column:
    """Turns (role, text) with their place as number."""
    return F.transform(turns, lambda t, i: F.struct(i.cast("bigint").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _parts(layout: Layout, get) -> Column:
    """The turns (role, text) of a layout with parts; ``get`` gives the text of a path."""
    return F.array(*[
        _turn(F.lit(role), F.concat_ws("\n\n", *[F.when(get(p) != "", get(p)) for p in paths])) for role, paths in layout.parts
    ])


def _said(layout: Layout, df: DataFrame) -> Column:
    """The array of a row's turns (turn, role, text) by its layout's mapping."""
    said = F.transform(layout.turns, lambda t: _turn(_role(t[layout.role]), _text(t[layout.text]))) if layout.turns else (
        _parts(layout, lambda path: _text(F.col(path))))
    kinds = dict(df.dtypes)
    before = []
    if kinds.get(SYSTEM) == "string":
        before.append(F.when(_text(F.col(SYSTEM)) != "", F.array(_turn(F.lit("system"), F.col(SYSTEM)))))
    if _pairs(kinds):
        before.append(F.flatten(F.transform(HISTORY, lambda pair: F.transform(pair, lambda t, i: _turn(_speaker(i), _text(t))))))
    elif _past(df):
        role, text = _past(df)
        before.append(F.transform(HISTORY, lambda t: _turn(_role(t[role]), _text(t[text]))))
    none = F.array().cast("array<struct<role:string,text:string>>")
    return _numbered(F.concat(*[F.coalesce(x, none) for x in (*before, said)])) if before else _numbered(said)


def _speaker(place: Column) -> Column:
    return F.when(place % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))


def _pairs(kinds: dict[str, str]) -> bool:
    return kinds.get(HISTORY) == "array<array<string>>"


def _past(df: DataFrame) -> tuple[str, str] | None:
    """The fields of the turns of a table's history, if it has one."""
    kind = df.schema[HISTORY].dataType if HISTORY in df.columns else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return next(((x.role, x.text) for x in LAYOUTS if x.turns and {x.role, x.text} <= set(kind.elementType.names)), None)
    return None


def unmapped_columns(df: DataFrame) -> list[str]:
    """The columns of a table with text that its layout leaves out, but for metadata."""
    layout = recognised(field_paths(df.schema))
    named = {p.split("[]")[0].split(".")[0] for p in layout.paths} if layout else set()
    if layout and not layout.row:
        named |= {SYSTEM} if dict(df.dtypes).get(SYSTEM) == "string" else set()
        named |= {HISTORY} if _pairs(dict(df.dtypes)) or _past(df) else set()
    return [c for c, kind in df.dtypes if "string" in kind and c not in named and c not in METADATA]


def _turns(records: DataFrame) -> DataFrame:
    """The turns of records (id, said); each record without id is a conversation of its own."""
    # Equal records are counted before they are numbered, so that one with many copies leaves each task as one row.
    own = records.where("id IS NULL").groupBy("said").agg(F.count(F.lit(1)).alias("copies")).select(
        "said", F.sha2(F.to_json("said"), 256).alias("digest"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).select(F.lit(None).cast("string").alias("id"), F.concat_ws(":", F.lit("record"), "digest", "copy").alias("conv_key"), "said")
    keyed = records.where("id IS NOT NULL").select("id", F.col("id").alias("conv_key"), "said").unionAll(own)
    return keyed.select("id", "conv_key", F.explode("said").alias("said")).select(
        F.col("id").try_cast("bigint").alias("conv_id"), "conv_key", "said.turn", "said.role", "said.text",
    )


def canonical_turns(df: DataFrame) -> DataFrame:
    """The turns of a table in any known layout; fails if its fingerprint is not known."""
    layout = recognised(field_paths(df.schema))
    if layout is None:
        raise ValueError(f"no layout has the fingerprint of {df.schema.simpleString()}")
    key = F.col("conv_id").cast("string") if "conv_id" in df.columns else F.lit(None).cast("string")
    if layout.row:
        turn, role, text = layout.row
        return df.select(
            key.try_cast("bigint").alias("conv_id"), key.alias("conv_key"), F.col(turn).try_cast("bigint").alias("turn"),
            _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"),
        )
    return _turns(df.select(key.alias("id"), _said(layout, df).alias("said")))


# --- JSON records ---

class Unmapped(Exception):
    """A record has text that its layout has no place for."""


def _node_paths(value, stem: str = "") -> set[str]:
    """The paths of all nodes of a JSON value; [] stands for the elements of an array."""
    if isinstance(value, dict):
        parts = [(f"{stem}.{k}" if stem else k, v) for k, v in value.items()]
    else:
        parts = [(f"{stem}[]", v) for v in value] if isinstance(value, list) else []
    return {p for p, _ in parts}.union(*[_node_paths(v, p) for p, v in parts])


def _has_text(value) -> bool:
    if isinstance(value, dict | list):
        return any(map(_has_text, value.values() if isinstance(value, dict) else value))
    return isinstance(value, str) and value != ""


def _record_text(value) -> str:
    """A text, or the text parts of a list between blank lines."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        parts = [part.get("text") if isinstance(part, dict) else part for part in value]
        if all(isinstance(part, str) for part in parts):
            return "\n\n".join(parts)
    if isinstance(value, list | dict):
        raise Unmapped
    return json.dumps(value)


def _leave_no_text(record: dict, named: Sequence[str]) -> None:
    if any(_has_text(v) for k, v in record.items() if k not in named and k not in METADATA):
        raise Unmapped


def _canonical_role(name: str) -> str:
    return ROLES.get(name.lower(), name)


def _listed_turns(elements, role: str, text: str) -> list[tuple[str, str]]:
    if not isinstance(elements, list) or not all(isinstance(e, dict) for e in elements):
        raise Unmapped
    for e in elements:
        _leave_no_text(e, (role, text))
    return [(_canonical_role(_record_text(e.get(role))), _record_text(e.get(text))) for e in elements]


def _earlier_turns(history) -> list[tuple[str, str]]:
    if not history:
        return []
    if isinstance(history, list) and all(isinstance(pair, list) for pair in history):
        return [(("user", "assistant")[i % 2], _record_text(t)) for pair in history for i, t in enumerate(pair)]
    for layout in LAYOUTS:
        if layout.turns and isinstance(history, list) and any(isinstance(e, dict) and layout.text in e for e in history):
            return _listed_turns(history, layout.role, layout.text)
    raise Unmapped


def record_turns(record: dict, layouts: Sequence[Layout] = LAYOUTS) -> tuple[Layout, list[tuple[str, str]]]:
    """The layout of a record and its turns (role, text) by the layout's mapping; fails if text would be lost."""
    layout = recognised(sorted(_node_paths(record)), layouts)
    if layout is None:
        raise Unmapped
    named = {p.split("[]")[0] for p in layout.paths}
    if layout.row:
        _leave_no_text(record, named)
        return layout, [(_record_text(record.get(layout.row[1])), _record_text(record.get(layout.row[2])))]
    _leave_no_text(record, {*named, SYSTEM, HISTORY})
    system = _record_text(record.get(SYSTEM))
    turns = [("system", system)] if system else []
    turns += _earlier_turns(record.get(HISTORY))
    if layout.turns:
        return layout, turns + _listed_turns(record[layout.turns], layout.role, layout.text)
    texts = {p: _record_text(record.get(p)) for p in layout.paths}
    return layout, turns + [(role, "\n\n".join(texts[p] for p in paths if texts[p])) for role, paths in layout.parts]


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, id, place, one_turn, turns): turns null for a record that gives none, place the number of a turn row."""
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            row = (text, None, None, False, None)
            try:
                record = json.loads(text) if text else None
                if isinstance(record, dict):
                    layout, turns = record_turns(record)
                    name = record.get("conv_id")
                    name = name if name is None or isinstance(name, str) else json.dumps(name)
                    place = str(record.get(layout.row[0])) if layout.row else None
                    said = [{"role": r, "text": t} for r, t in turns]
                    row = (text if not said else None, name, place, bool(layout.row), said or None)
            except (ValueError, RecursionError, Unmapped):
                pass
            rows.append(row)
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), turn]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record", "id", "place", "one_turn", "turns"])


def canonical_turns_of_records(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The turns of a column of JSON records in mixed layouts, and the records that give none."""
    mapped = df.select(F.col(column).cast("string").alias("record")).mapInArrow(
        _mapped, "record string, id string, place string, one_turn boolean, turns array<struct<role:string,text:string>>",
    )
    said = mapped.where("turns IS NOT NULL")
    single = said.where("one_turn").select("id", "place", F.explode("turns").alias("said")).select(
        F.col("id").try_cast("bigint").alias("conv_id"), F.col("id").alias("conv_key"), F.col("place").try_cast("bigint").alias("turn"),
        "said.role", "said.text",
    )
    whole = _turns(said.where("NOT one_turn").select("id", _numbered(F.col("turns")).alias("said")))
    return whole.unionAll(single), mapped.where("turns IS NULL").select("record")


# --- template ---

@dataclass(frozen=True)
class Template:
    """Marks around a turn's role and text, and the strings that may not stand inside either."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = (
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )


CHATML = Template()
#: The first characters of control strings, and how they are written inside a text.
ESCAPES = {"<": "&lt;", "[": "&lsqb;"}


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def escape(text: Column, template: Template = CHATML) -> Column:
    """The text with & written as &amp; and the first character of each control string as an entity."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for first, entity in ESCAPES.items():
        rests = "|".join(_quoted(c[1:]) for c in template.controls if c[0] == first)
        out = F.regexp_replace(out, f"{_quoted(first)}(?={rests})", entity)
    return out


def unescape(text: Column) -> Column:
    out = text
    for first, entity in ESCAPES.items():
        out = F.replace(out, F.lit(entity), F.lit(first))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def render(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per turn: conv_id, conv_key, turn, piece, loss_start, loss_end.

    A conversation's formatted text is its pieces in order. The loss span, in code points of the piece, is
    the escaped text of a turn whose role is trained on; other turns have an empty span.
    """
    role = F.replace(escape(F.col("role"), template), F.lit("\n"), F.lit("&NewLine;"))
    head = F.concat(F.lit(template.before_role), role, F.lit(template.after_role))
    body = escape(F.col("text"), template)
    parts = turns.select("conv_id", "conv_key", "turn", "role", head.alias("head"), body.alias("body"))
    start = F.char_length("head").cast("bigint")
    end = F.when(F.col("role").isin(*template.loss_roles), start + F.char_length("body")).otherwise(start)
    return parts.select(
        "conv_id", "conv_key", "turn", F.concat("head", "body", F.lit(template.after_text)).alias("piece"),
        start.alias("loss_start"), end.cast("bigint").alias("loss_end"),
    )


def read_back(pieces: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, conv_key, turn, role, text and loss_text, read from rendered pieces alone."""
    marks = len(template.before_role)
    after = F.locate(template.after_role, F.col("piece"))
    role = F.substring(F.col("piece"), F.lit(marks + 1), after - marks - 1)
    body_at = after + len(template.after_role)
    body = F.substring(F.col("piece"), body_at, F.char_length("piece") - len(template.after_text) - body_at + 1)
    loss = F.substring(F.col("piece"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return pieces.select(
        "conv_id", "conv_key", "turn", unescape(F.replace(role, F.lit("&NewLine;"), F.lit("\n"))).alias("role"),
        unescape(body).alias("text"), unescape(loss).alias("loss_text"), F.char_length("piece").alias("piece_chars"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, conv_key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The rows of a conversation are sorted into one stream and hashed as they pass, so a conversation of any
    length takes the memory of one turn.
    """
    names = ["conv_id", "conv_key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def finished():
            return (*state[:3], state[3].hexdigest(), state[4], state[5].hexdigest(), state[6])

        for batch in batches:
            done = []
            for conv, key, role, text, loss, chars in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if state is None or state[1] != key:
                    if state is not None:
                        done.append(finished())
                    state = [conv, key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[2] += 1
                state[3].update(f"{role}\n{text}\n".encode())
                state[4] += len(loss)
                state[5].update(loss.encode())
                state[6] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(finished(), kinds, strict=True)], names)

    in_order = turns.repartition("conv_key").sortWithinPartitions("conv_key", "turn", "role", "text")
    return in_order.select("conv_id", "conv_key", "role", "text", "loss_text", "piece_chars").mapInArrow(
        hashed, "conv_id bigint, conv_key string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )
