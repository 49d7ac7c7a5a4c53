"""Chat formatting: heterogeneous records to one reversible training text.

A record's layout is its *fingerprint*, a hash of its sorted nested field
paths. The fingerprint selects a declarative mapping (``Layout``) that says
where turns, roles and texts stand; the same mappings serve typed tables (the
fingerprint of the schema) and JSON records whose layouts differ from row to
row (the fingerprint of each record).

The template writes ``### Role: text</turn>`` and a line end for every turn.
Inside texts and free role names every backslash, ``#`` and ``<`` (in roles
also ``:``) gets a backslash before it, so neither a marker nor an end mark can
stand in a text unescaped, and unescaping gives every text back.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.llm import arrays

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
# names of the three roles in the layouts
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
END = "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``paths`` are its field paths. Either ``rows`` (one turn a row: key, order,
    role and text columns), or ``turns`` with ``role`` and ``text`` inside each
    element, or ``parts``: (role, paths) in order, the paths' non-empty values
    joined by a blank line. ``lead`` is an optional system text."""
    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    lead: str | None = None


LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Layout("system conversations", ("conversations[].from", "conversations[].value", "system"), turns="conversations", role="from", text="value", lead="system"),
    Layout("instruction", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("input", "instruction", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt and completion", ("completion", "prompt"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", ("answer", "question"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("nested data", ("data.answer", "data.context", "data.question"), parts=(("user", ("data.context", "data.question")), ("assistant", ("data.answer",)))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


BY_PRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Field paths of a type: a.b for structs, a[] for array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def value_paths(value, at: str = "") -> set[str]:
    """Field paths of a JSON value, the union over array elements."""
    if isinstance(value, dict):
        return set().union(*[value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()]) if value else {at}
    if isinstance(value, list):
        return set().union(*[value_paths(v, at + "[]") for v in value]) if value else {at + "[]"}
    return {at}


def _role(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for k, v in ALIASES.items():
        c = F.when(c == k, v).otherwise(c)
    return c


def canonical_turns(df: DataFrame, key: str, layouts=LAYOUTS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, turn, role, text) of a typed table, by the layout whose paths are
    the table's, leaving out the key and ``extra`` columns where the layout has
    no such paths. An unknown fingerprint is an error that names it.

    Turn order is the layout's order; rows that tie in it are ordered by role
    and text, null first. Null texts and roles are empty; a null array or a
    null part gives no turn, an empty part an empty one."""
    prints = {fingerprint(x.paths): x for x in layouts}
    options = [[p for p in schema_paths(df.schema)], [p for p in schema_paths(df.schema) if p.split(".")[0].split("[")[0] not in {key, *extra}],
               [p for p in schema_paths(df.schema) if p.split(".")[0].split("[")[0] not in set(extra)]]
    found = next((prints[fingerprint(p)] for p in options if fingerprint(p) in prints), None)
    if found is None:
        raise ValueError(f"no layout for fingerprint {fingerprint(options[0])}: {sorted(options[0])}")
    if found.rows:
        k, turn, role, text = found.rows
        return df.select(F.col(k).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    at = F.col(key).alias("key")
    if found.turns:
        turns = df.select(at, *([F.col(found.lead).alias("lead")] if found.lead else []), F.posexplode_outer(found.turns).alias("turn", "t"))
        out = turns.where("t IS NOT NULL").select("key", F.col("turn").cast("long").alias("turn"), _role(F.col("t")[found.role]).alias("role"),
                                                  F.coalesce(F.col("t")[found.text], F.lit("")).alias("text"))
        if found.lead:
            out = out.unionByName(df.where(F.col(found.lead).isNotNull()).select(
                at, F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.col(found.lead).alias("text")))
        return out
    parts = []
    for i, (role, paths) in enumerate(found.parts):
        said = F.filter(F.array(*[F.col(p) for p in paths]), lambda x: x.isNotNull() & ((x != "") if len(paths) > 1 else F.lit(True)))
        parts.append(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
                              F.when(F.size(said) > 0, F.array_join(said, "\n\n")).alias("text")))
    return df.select(at, F.explode(F.array(*parts)).alias("p")).where("p.text IS NOT NULL").select("key", "p.turn", "p.role", "p.text")


def _at(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def record_turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of one JSON record by its layout."""
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if layout.turns:
        out = [("system", text(record[layout.lead]))] if layout.lead and record.get(layout.lead) is not None else []
        for t in record[layout.turns]:
            role = text(t.get(layout.role))
            out.append((ALIASES.get(role, role), text(t.get(layout.text))))
        return out
    out = []
    for role, paths in layout.parts:
        said = [text(v) for v in (_at(record, p) for p in paths) if v is not None and (len(paths) == 1 or v != "")]
        if said:
            out.append((role, "\n\n".join(said)))
    return out


def canonical_json(df: DataFrame, key: str, record: str) -> DataFrame:
    """(key, layout, turn, role, text) of JSON records of any mixture of the
    known layouts: each record's own fingerprint selects its mapping. A record
    that is null, no JSON object or of no known layout gives one row with a
    null layout, turn, role and text, so that none is lost unseen."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("layout", T.StringType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in arrays.row_slices(batch, "r_"):
                at, rows = [], []
                for i, r in enumerate(part.column("r_").to_pylist()):
                    try:
                        value = json.loads(r) if r is not None else None
                    except ValueError:
                        value = None
                    layout = BY_PRINT.get(fingerprint(value_paths(value))) if isinstance(value, dict) else None
                    if layout is None or layout.rows:
                        at.append(i)
                        rows.append((None, None, None, None))
                        continue
                    for n, (role, text) in enumerate(record_turns(value, layout)):
                        at.append(i)
                        rows.append((layout.name, n, role, text))
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column("k_").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                                  pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], schema.fieldNames())

    return df.select(F.col(key).alias("k_"), F.col(record).alias("r_")).mapInArrow(run, schema)


def _escaped(c: Column, chars: str) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def formatted(turns: DataFrame) -> DataFrame:
    """turns plus segment (the turn's formatted text) and loss_start, loss_end:
    the span of it that the loss mask covers (the escaped text of an assistant
    turn; elsewhere empty, at the end of the marker)."""
    role = F.col("role")
    known = F.lit(None).cast("string")
    for k, v in ROLES.items():
        known = F.when(role == k, F.lit(f"### {v}: ")).otherwise(known)
    marker = F.coalesce(known, F.concat(F.lit("### ="), _escaped(role, "#<:"), F.lit(": ")))
    said = _escaped(F.col("text"), "#<")
    out = turns.withColumns({"m_": marker, "s_": said})
    start = F.char_length("m_")
    return (out.withColumns({"segment": F.concat("m_", "s_", F.lit(END)), "loss_start": start,
                             "loss_end": start + F.when(role == "assistant", F.char_length("s_")).otherwise(0)}).drop("m_", "s_"))


_MARKER = re.compile(r"### (?:(System|User|Assistant)|=((?:[^\\:]|\\.)*)): ", re.S)
_PLAIN = re.compile(r"\\(.)", re.S)
_STOP = re.compile(r"(?:[^\\<]|\\.)*", re.S)
_BACK = {v: k for k, v in ROLES.items()}


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a formatted conversation;
    start and end are the escaped text's place in it."""
    out, at = [], 0
    while at < len(text):
        m = _MARKER.match(text, at)
        if not m:
            raise ValueError(f"no turn marker at {at}")
        end = _STOP.match(text, m.end()).end()
        if not text.startswith(END, end):
            raise ValueError(f"no end mark at {end}")
        role = _BACK[m[1]] if m[1] else _PLAIN.sub(r"\1", m[2])
        out.append((role, _PLAIN.sub(r"\1", text[m.end():end]), m.end(), end))
        at = end + len(END)
    return out


READ = "key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted text: the turns are
    parsed again, and the loss mask's spans are read from it and unescaped.

    Segments (key, turn, segment, loss_start, loss_end) of a conversation are
    streamed in order; what is held is one turn and two running digests, so a
    conversation may have any number of turns."""
    kind = segments.schema["key"].dataType.simpleString()
    names = [x.split()[0] for x in READ.split(", ")]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    ordered = segments.select("key", "turn", "segment", "loss_start", "loss_end")
    ordered = (ordered.repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), "segment"))

    def run(batches):
        key, state = None, None

        def done():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            rows = []
            for k, segment, a, b in zip(*[batch.column(c).to_pylist() for c in ("key", "segment", "loss_start", "loss_end")]):
                if state is None or k != key:
                    if state is not None:
                        rows.append(done())
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):  # a segment is a whole turn of the conversation's text
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = _PLAIN.sub(r"\1", segment[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            if rows:
                yield _rows(rows)
        if state is not None:
            yield _rows([done()])

    def _rows(rows):
        kinds = (arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return ordered.mapInArrow(run, READ.format(kind=kind))


def conversations_text(turns: DataFrame) -> DataFrame:
    """(key, text, spans): whole formatted conversations with the loss mask's
    spans, for conversations that fit a row."""
    w = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "segment")
    s = formatted(turns).withColumn("at", F.coalesce(F.sum(F.char_length("segment")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("n", F.row_number().over(w))
    parts = s.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "segment", (F.col("at") + F.col("loss_start")).alias("a"), (F.col("at") + F.col("loss_end")).alias("b")))).alias("p"))
    return parts.select("key", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"),
                        F.transform(F.filter("p", lambda x: x["b"] > x["a"]), lambda x: F.struct(x["a"].alias("start"), x["b"].alias("end"))).alias("spans"))
