r"""Chat formatting by schema fingerprints (operator 12).

A record is a JSON object in any of several layouts: a prompt with its answer, an instruction with an input and an output,
a list of messages, or one turn a row. The nested field paths of a record ("messages[].role"), as far as some layout
names them, are hashed; the hash selects a declarative mapping, which says where roles and texts lie, and the record
becomes canonical turns (key, turn, role, text). The template marks turns as

    <|im_start|>role\ntext<|im_end|>\n

and puts one backslash more between "<" and "|" wherever a text has these with any number of backslashes (none included)
between them. So no text holds a mark, and reading back takes one backslash away.

Records whose paths no layout knows, null ones and texts that are no JSON object have no layout: `canonical` keeps them
as rows without layout, role and text, `layouts` counts them, and the formatter leaves them out. Fields that no layout
names are ignored, whatever their names and types. Null roles and texts are empty. Turns of one key stand in the order of
turn (null or unreadable: first), then role, then text; repeated rows are turns of their own. Records of a null key are
one conversation. An empty table gives no rows. A conversation of any length is read as a sorted stream, a turn at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, chunks

START, END, LOSS = "<|im_start|>", "<|im_end|>", "assistant"


@dataclass(frozen=True)
class Layout:
    """Where a record's turns lie. With `each`, that path's elements ("": the record itself) are turns with a role and a
    text; without, `parts` has a role and the fields that make its text. Fields in `optional` may be absent."""

    name: str
    each: str | None = None
    role: str = ""
    text: str = ""
    order: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.each is None:
            return [f for _, fields in self.parts for f in fields]
        return [f"{self.each}.{f}" if self.each else f for f in (self.role, self.text, self.order) if f]

    def turns(self, record: dict) -> Iterator[tuple[int | None, str, str]]:
        if self.each is None:
            said = ((role, "\n\n".join(t for f in fields if (t := text_at(record, f)))) for role, fields in self.parts if any(values(record, f) for f in fields))
            yield from ((i, role, text) for i, (role, text) in enumerate(said))
            return
        names = dict(self.roles)
        for i, one in enumerate(values(record, self.each) if self.each else [record]):
            role = text_at(one, self.role)
            at = next(iter(values(one, self.order)), None) if self.order else i
            yield whole(at), names.get(role, role), text_at(one, self.text)


#: The names that roles and fields have in common layouts of training data.
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
_ASKED = lambda name, fields, answer: Layout(name, parts=(("system", ("system",)), ("user", fields), ("assistant", (answer,))), optional=("system",))
LAYOUTS = (
    Layout("turns", each="", role="role", text="text", order="turn"),
    Layout("messages", each="messages[]", role="role", text="content"),
    Layout("message parts", each="messages[]", role="role", text="content[].text"),
    Layout("speakers", each="conversations[]", role="from", text="value", roles=SPEAKERS),
    _ASKED("prompt and completion", ("prompt",), "completion"),
    _ASKED("prompt and response", ("prompt",), "response"),
    _ASKED("question and answer", ("question",), "answer"),
    _ASKED("instruction", ("instruction",), "output"),
    _ASKED("instruction and input", ("instruction", "input"), "output"),
    _ASKED("instruction and response", ("instruction",), "response"),
    _ASKED("context", ("context", "instruction"), "response"),
)


def values(item: Any, path: str) -> list:
    """All values at a path below an item; "[]" stands for the elements of a list."""
    found = [item]
    for step in path.split("."):
        name, many = step.removesuffix("[]"), step.endswith("[]")
        found = [x[name] for x in found if isinstance(x, dict) and name in x]
        found = [y for x in found if isinstance(x, list) for y in x] if many else found
    return found


def text_at(item: Any, path: str) -> str:
    """The texts at a path, one behind the other; null is empty, what is no text is shown as JSON, and half a surrogate
    pair, which only JSON can hold, as a question mark."""
    text = "".join(v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False) for v in values(item, path))
    return text if text.isascii() else text.encode(errors="replace").decode()


def whole(at: Any) -> int | None:
    try:
        return int(at)
    except (TypeError, ValueError, OverflowError):
        return None


def field_paths(item: Any, at: str = "") -> set[str]:
    """The paths of all fields that hold neither an object nor a list; an empty one of these has none."""
    if isinstance(item, dict):
        return {p for k, v in item.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    return {p for v in item for p in field_paths(v, at + "[]")} if isinstance(item, list) else {at}


def fingerprint(paths: set[str]) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


def mappings(known: tuple[Layout, ...]) -> tuple[dict[str, Layout], set[str]]:
    """The layout of each fingerprint (one for every choice of its optional fields), and all paths that layouts name."""
    out: dict[str, Layout] = {}
    for layout in known:
        free = layout.optional
        for n in range(len(free) + 1):
            for gone in combinations(free, n):
                if out.setdefault(fingerprint(set(layout.paths()) - {*gone}), layout) is not layout:
                    raise ValueError(f"two layouts have the same fields: {layout.name}")
    return out, {p for layout in known for p in layout.paths()}


def as_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, record): each row's other columns as one JSON object, nulls included."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("record"))


def canonical(records: DataFrame, key: str, known: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, fingerprint, turn, role, text) from (key, record); other columns are left out."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_print, names = mappings(known)
        for batch in chunks(batches, "record"):
            at: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("record").to_pylist()):
                try:
                    record = json.loads(text or "null")
                    sign = fingerprint(field_paths(record) & names) if isinstance(record, dict) else None
                except (ValueError, RecursionError):
                    record = sign = None
                layout = by_print.get(sign)
                turns = [(layout.name, sign, *t) for t in layout.turns(record)] if layout else [(None, sign, None, None, None)]
                rows += turns
                at += [i] * len(turns)
            columns = zip(*rows) if rows else ([], [], [], [], [])
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], [key, "layout", "fingerprint", "turn", "role", "text"])

    return by_bytes(records).select(key, "record").mapInArrow(run, f"{key} {kind}, layout string, fingerprint string, turn long, role string, text string")


def layouts(records: DataFrame, key: str, known: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(layout, fingerprint, turns): what the table's records look like; the row without a layout counts unknown ones."""
    return canonical(records, key, known).groupBy("layout", "fingerprint").agg(F.count("*").alias("turns"))


_CONTROL, _ESCAPED = r"<(\\*)\|", r"<\\(\\*)\|"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"<\\$1|")


def escaped_name(role: Column) -> Column:
    """A role stands on one line, so line feeds and backslashes are written with a backslash."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return re.sub(_ESCAPED, lambda m: f"<{m[1]}|", text) if "<" in text else text


def unescaped_name(role: str) -> str:
    return re.sub(r"\\([n\\])", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def formatted(turns: DataFrame, key: str) -> DataFrame:
    """(key, turn, piece, loss_start, loss_end): a turn's piece of its conversation's output, and the code points of the
    piece that the loss covers: an assistant's text, without marks. Other turns have no loss."""
    head, text = F.concat(F.lit(START), escaped_name(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    rows = turns.where("layout is not null").select(key, "turn", head.alias("_head"), text.alias("_text"), (F.col("role") == LOSS).alias("_loss"))
    start = F.when(F.col("_loss"), F.length("_head"))
    return rows.select(key, "turn", F.concat("_head", "_text", F.lit(END + "\n")).alias("piece"), start.alias("loss_start"), (start + F.length("_text")).alias("loss_end"))


def in_order(pieces: DataFrame, key: str) -> DataFrame:
    """A key's pieces in one task, side by side and in the order of turns; a shuffle that sorts, so nothing is gathered."""
    return pieces.repartition(key).sortWithinPartitions(key, F.col("turn").asc_nulls_first(), "piece")


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


class Reading:
    """What has been read of one conversation's output: digests, counts and nothing of the texts."""

    def __init__(self) -> None:
        self.turns, self.loss = sha256(), sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def take(self, piece: str, start: int | None, end: int | None) -> None:
        at = 0
        for found in _TURN.finditer(piece):
            if found.start() != at:
                break
            self.turns.update(f"{unescaped_name(found[1])}\n{unescaped(found[2])}\n".encode())
            self.n_turns += 1
            at = found.end()
        if at != len(piece):
            raise ValueError(f"no whole turns: {piece[at:at + 80]!r}")
        if start is not None:
            said = unescaped(piece[start:end])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame, key: str) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation's output."""
    kind = pieces.schema[key].dataType.simpleString()
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        reading: Reading | None = None
        for batch in chunks(batches, "piece"):
            keys = batch.column(key)
            done: list[tuple] = []
            for k, piece, start, end in zip(keys.to_pylist(), *(batch.column(c).to_pylist() for c in ("piece", "loss_start", "loss_end"))):
                if reading is None or k != now:
                    if reading:
                        done.append((now, *reading.row()))
                    now, reading = k, Reading()
                reading.take(piece, start, end)
            yield as_batch(done, keys.type)
            last = keys.type
        if reading:
            yield as_batch([(now, *reading.row())], last)

    def as_batch(done: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        types = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 6, types)], names)

    return in_order(pieces, key).mapInArrow(run, f"{key} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(pieces: DataFrame, key: str) -> DataFrame:
    """(key, formatted, loss): each conversation's output as one text with the code points (start, end) under the loss.
    A conversation is one row here, so it has to fit into one; read_back has no such bound."""
    rows = F.sort_array(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "piece", "loss_start", "loss_end")))
    grouped = pieces.groupBy(key).agg(rows.alias("p"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["piece"])).alias("at"),
        F.when(p["loss_start"].isNull(), acc["loss"]).otherwise(F.array_append(acc["loss"], F.struct((acc["at"] + p["loss_start"]).alias("start"), (acc["at"] + p["loss_end"]).alias("end")))).alias("loss"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return grouped.select(key, F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"), F.aggregate("p", none, step)["loss"].alias("loss"))
