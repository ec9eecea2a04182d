"""Chat formatting: records of any layout become canonical turns by schema fingerprint, then one reversible text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]


def field_paths(record: object, prefix: str = "") -> set[str]:
    """Nested field paths of a record; the elements of a list share the path ``[]``."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in field_paths(v, f"{prefix}.{k}" if prefix else k)} or {prefix}
    if isinstance(record, list):
        return {p for v in record for p in field_paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    """A hash of the field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def text_of(value: object) -> str:
    """A text; of a list of content parts the texts of its parts, one after the other; null is empty."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "".join(text_of(p.get("text")) if isinstance(p, dict) else text_of(p) for p in value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _at(record: object, path: str) -> object:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


@dataclass(frozen=True)
class Layout:
    """How records with certain field paths become turns.

    ``fields`` gives (role, path) of single turns in order; ``messages`` gives the path of a list and its
    elements' fields of role and text. Fields in ``optional`` may be missing. ``renamed`` gives the
    canonical names of roles that the layout names otherwise. Other fields of a record are left alone, and
    what is nested in a field that holds a text, such as content parts, counts as that field.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()

    def own_paths(self) -> set[str]:
        found = {p for _, p in self.fields}
        if self.messages:
            at, role, text = self.messages
            found |= {f"{at}[]", f"{at}[].{role}", f"{at}[].{text}"}
        return found

    def fingerprints(self) -> set[str]:
        """Those of the sets of its own field paths that this layout takes."""
        wholes = [{p for _, p in self.fields}]
        for p in self.optional:
            wholes += [w - {p} for w in wholes]
        if self.messages:
            at, role, text = self.messages
            lists = [{f"{at}[]"}, {f"{at}[].{role}"}, {f"{at}[].{role}", f"{at}[].{text}"}]  # empty, without texts, usual
            wholes = [w | x for w in wholes for x in lists]
        return {fingerprint(w) for w in wholes}

    def takes(self, paths: set[str]) -> bool:
        """Whether the record's field paths, brought down to this layout's own, have one of its fingerprints."""
        own = self.own_paths()
        inner = {k for k in own if not k.endswith("[]")}
        found = {k for p in paths for k in ([p] if p in own else [k for k in inner if p.startswith((k + "[]", k + "."))])}
        return fingerprint(found) in self.fingerprints()

    def turns(self, record: dict) -> list[Turn] | None:
        """The record's turns, or none where an element of its messages is no object."""
        out = [(role, text_of(value)) for role, path in self.fields if (value := _at(record, path)) is not None]
        if self.messages:
            at, role, text = self.messages
            names = dict(self.renamed)
            for m in _at(record, at) or []:
                if not isinstance(m, dict):
                    return None
                own = text_of(m.get(role))
                out.append((names.get(own, own), text_of(m.get(text))))
        return out


#: Names of roles in the layout of ``from`` and ``value``.
ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

#: The first layout that takes a record counts, so those that need more fields come first.
LAYOUTS = (
    Layout("system-and-messages", fields=(("system", "system"),), messages=("messages", "role", "content")),
    Layout("messages", messages=("messages", "role", "content")),
    Layout("turns", messages=("turns", "role", "text")),
    Layout("system-and-conversations", fields=(("system", "system"),), messages=("conversations", "from", "value"), renamed=ROLES),
    Layout("conversations", messages=("conversations", "from", "value"), renamed=ROLES),
    Layout("prompt-completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt-response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("question-answer", fields=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
)
#: Fingerprints of whole records whose layout a task remembers.
REMEMBERED = 10_000


class Layouts:
    """Finds a record's layout by the fingerprint of its field paths."""

    def __init__(self, layouts: tuple[Layout, ...]):
        self.layouts, self.known = layouts, {}

    def of(self, record: object) -> Layout | None:
        if not isinstance(record, dict):
            return None
        paths = field_paths(record)
        name = fingerprint(paths)
        if name not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[name] = next((x for x in self.layouts if x.takes(paths)), None)
        return self.known[name]


#: The template: what stands before and after a turn's text. Other roles take ``<<ROLE name>>`` and
#: ``<</ROLE>>`` with the name escaped like a text.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = re.compile(r"\\|<(?=/?s>|</?SYS>>|</?ROLE)|\[(?=/?INST\])|>(?=>\n)")
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Put a backslash into each control string, after its first character, and double all others."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """(text, loss spans in code points): the spans cover the escaped texts of the assistant's turns."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        before, after = MARKS.get(role) or (f"<<ROLE {escape(role)}>>\n", "\n<</ROLE>>\n")
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += (before, body, after)
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (before, after) in MARKS.items():
            if formatted.startswith(before, at):
                break
        else:
            if not formatted.startswith("<<ROLE ", at):
                raise ValueError(f"no turn begins at character {at}")
            close = formatted.index(">>\n", at)
            role, before, after = unescape(formatted[at + 7 : close]), formatted[at : close + 3], "\n<</ROLE>>\n"
        at += len(before)
        end = formatted.index(after, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return turns


#: Characters of a conversation's turns that a task holds; a longer one is formatted in several parts.
PART_CHARS = 8 << 20

Rows = list[tuple[str, str]]


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, Rows]]:
    """(id, part, turns) of conversations from rows sorted by conversation and turn; one may go over the end of a batch."""
    current, part, rows, size, some = None, 0, [], 0, False
    for batch in batches:
        for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("id", "role", "text")), strict=True):
            if some and (conv_id != current or size > PART_CHARS):
                yield current, part, rows
                part, rows, size = (part + 1 if conv_id == current else 0), [], 0
            current, some = conv_id, True
            rows.append((role or "", text or ""))
            size += len(role or "") + len(text or "")
    if some:
        yield current, part, rows


def as_record(rows: Rows) -> dict:
    """A conversation in the layout that such ones are usually kept in: a prompt with its answer, or a list of messages."""
    roles = [role for role, _ in rows]
    if roles == ["user", "assistant"]:
        return {"prompt": rows[0][1], "completion": rows[1][1]}
    if roles == ["system", "user", "assistant"]:
        return {"system": rows[0][1], "prompt": rows[1][1], "response": rows[2][1]}
    return {"messages": [{"role": role, "content": text} for role, text in rows]}


_FORMATTED = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("layout", pa.string()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    *plain, spans = zip(*rows, strict=True)
    spans = [None if s is None else [{"start": a, "end": b} for a, b in s] for s in spans]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip([*plain, spans], _FORMATTED, strict=True)], schema=_FORMATTED)


def _formatted(records: Iterator[tuple[int | None, int, dict | None]], layouts: tuple[Layout, ...]) -> Iterator[pa.RecordBatch]:
    known, out, size = Layouts(layouts), [], 0
    for record_id, part, record in records:
        layout = known.of(record)
        turns = layout.turns(record) if layout else None
        text, spans = format_turns(turns) if turns is not None else (None, None)
        out.append((record_id, part, layout.name if turns is not None else None, text, spans))
        size += len(text or "")
        if size > 4 << 20 or len(out) >= 2000:
            yield _emit(out)
            out, size = [], 0
    if out:
        yield _emit(out)


_SCHEMA = "id long, part int, layout string, formatted string, loss_spans array<struct<start: long, end: long>>"


def format_records(records: DataFrame, *, id_col: str = "record_id", json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, formatted, loss_spans) of JSON records of mixed layouts.

    A record's nested field paths are hashed, and the layout found for that fingerprint says where its turns
    are; fields that no layout names don't matter. A record of an unknown layout, or that is no JSON object,
    has nulls. Null and missing texts of messages are empty, a list of content parts is their texts, and an
    empty list of messages has no turn. Repeated rows are each formatted; null ids are kept. An empty table
    gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed() -> Iterator[tuple[int | None, int, dict | None]]:
            for batch in batches:
                for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        yield record_id, 0, json.loads(text) if text is not None else None
                    except (ValueError, RecursionError):
                        yield record_id, 0, None

        yield from _formatted(parsed(), layouts)

    rows = records.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{json_col}`").cast("string").alias("record"))
    return rows.mapInArrow(run, _SCHEMA).drop("part").withColumnRenamed("id", id_col)


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, part, layout, formatted, loss_spans) of conversations given as rows by turn.

    The rows of a conversation are brought together by one shuffle and sorted within their task, which
    streams over them; each becomes a record in its usual layout (:func:`as_record`), which is formatted by
    its fingerprint. A task holds ``PART_CHARS`` characters of turns and one turn more: a longer
    conversation has several rows, numbered by ``part`` from 0, that follow one another and each hold whole
    turns. Their texts, put together, are the conversation's.

    Defined cases: a null text or role is empty. Rows with equal turn numbers, repeated rows among them,
    go by role and text; null turn numbers go first. Rows without a conversation id are one conversation
    with a null id. Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((i, part, as_record(rows)) for i, part, rows in _turn_rows(batches))
        yield from _formatted(records, layouts)

    columns = {"id": (id_col, "long"), "turn": (turn_col, "long"), "role": (role_col, "string"), "text": (text_col, "string")}
    rows = turns.select(*(F.col(f"`{source}`").cast(kind).alias(name) for name, (source, kind) in columns.items()))
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    return rows.mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col)


class _Digest:
    """What is known of a conversation from the parts read so far."""

    def __init__(self) -> None:
        self.turns, self.learned, self.size = 0, 0, 0
        self.whole_hash, self.learned_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        turns = parse(text)
        for role, body in turns:
            self.whole_hash.update(f"{role}\n{body}\n".encode())
        for span in spans:
            own = unescape(text[span["start"] : span["end"]])
            self.learned_hash.update(own.encode())
            self.learned += len(own)
        self.turns, self.size = self.turns + len(turns), self.size + len(text)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.whole_hash.hexdigest(), self.learned, self.learned_hash.hexdigest(), self.size


def digests(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """What reading the formatted texts back gives: turns, digests of turns and of the text under the loss mask.

    The parts of a conversation must follow one another, as :func:`format_conversations` returns them.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        open_: _Digest | None = None
        for batch in batches:
            rows = []
            for record_id, part, text, spans in zip(*(batch[c].to_pylist() for c in ("id", "part", "formatted", "loss_spans")), strict=True):
                if part == 0:
                    if open_ is not None:
                        rows.append(open_.row(current))
                    current, open_ = record_id, _Digest()
                open_.add(text, spans)
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if open_ is not None:
            yield pa.record_batch([pa.array([x], k) for x, k in zip(open_.row(current), kinds, strict=True)], names=names)

    rows = formatted.where("formatted is not null").select(F.col(f"`{id_col}`").alias("id"), "part", "formatted", "loss_spans")
    schema = "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
