"""Chat formatting (operator 7): schema fingerprints select declarative mappings into canonical turns.

A layout is known by a hash of its nested field paths. Columns of a table, or the fields of a JSON
record, are reduced to the paths that some layout names; the fingerprint of the rest selects a
mapping, which only says where turns, roles and texts are. Canonical turns (conv_id, turn, role, text)
are formatted one row each, so a conversation of any length is never one value.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts, one backslash more is put
between `<` and `|`, however many were there, which keeps control strings out and can be undone. The
loss mask is a range of code points of the formatted turn: an assistant's escaped text.

Turn rows are canonical already and keep their roles as they are; other layouts' names of roles are mapped.

Fields of other layouts beside those of one are allowed: if just one layout's paths are all there and it isn't part of
another that is there too, it is taken.

Cases: null roles and texts are empty; turns are ordered by turn, then role and text, null turns
first; repeated rows are turns each; a JSON record that can't be mapped (no JSON, no known layout, several layouts, no turns, an item that is no
turn or has no role or text, text that isn't Unicode) has no turns at all and is returned by `unmapped` with the reason, and so is a table's row without
turns by `unmapped_rows`; a conv_id that isn't a whole number of 64 bits is replaced by a
hash of the record; an empty table gives no rows; unknown columns and fields are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small_batches, write

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "conv_id long, turn long, role string, text string"
#: Layouts as paths: `each` names a list of turns, `role` and `text` what holds them in it; `parts` are
#: turns of fixed roles, each joined from fields; `row` is a table with a turn in each row.
LAYOUTS = [
    {"name": "turn rows", "row": ("conv_id", "turn", "role", "text")},
    {"name": "messages", "each": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "each": "conversations", "role": "from", "text": "value"},
    {"name": "dialog", "each": "dialog", "role": "speaker", "text": "utterance"},
    {"name": "prompt and completion", "parts": [("user", ("prompt",)), ("assistant", ("completion",))]},
    {"name": "prompt and response", "parts": [("user", ("prompt",)), ("assistant", ("response",))]},
    {"name": "question and answer", "parts": [("user", ("question",)), ("assistant", ("answer",))]},
    {"name": "system, prompt and response", "parts": [("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))]},
    {"name": "instruction", "parts": [("user", ("instruction",)), ("assistant", ("output",))]},
    {"name": "instruction with input", "parts": [("user", ("instruction", "input")), ("assistant", ("output",))]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_paths(layout: dict) -> frozenset[str]:
    if "row" in layout:
        return frozenset(layout["row"])
    if "each" in layout:
        return frozenset({layout["each"], f"{layout['each']}[].{layout['role']}", f"{layout['each']}[].{layout['text']}"})
    return frozenset(f for _, fields in layout["parts"] for f in fields)


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


KNOWN = frozenset().union(*map(layout_paths, LAYOUTS))
BY_FINGERPRINT = {fingerprint(layout_paths(x)): x for x in LAYOUTS}
#: Fields that only name the conversation and decide no layout.
ID = "conv_id"


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a Spark type; `[]` steps into a list."""
    if isinstance(kind, T.StructType):
        return set().union(*({f"{at}{f.name}"} | schema_paths(f.dataType, f"{at}{f.name}.") for f in kind.fields)) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at.removesuffix('.')}[].")
    return set()


def value_paths(value: object, at: str = "") -> set[str]:
    """The same of a parsed JSON value."""
    if isinstance(value, dict):
        return set().union(*({f"{at}{k}"} | value_paths(v, f"{at}{k}.") for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{at.removesuffix('.')}[].") for v in value)) if value else set()
    return set()


def choose(paths: set[str]) -> dict | None:
    """The layout whose fingerprint the known paths have; `conv_id` alone may come with any. Else the one layout whose
    paths are all there, if no other is but its parts."""
    known = paths & KNOWN
    exact = BY_FINGERPRINT.get(fingerprint(known)) or BY_FINGERPRINT.get(fingerprint(known - {ID}))
    if exact:
        return exact
    there = [x for x in LAYOUTS if layout_paths(x) <= known]
    most = [x for x in there if not any(layout_paths(x) < layout_paths(y) for y in there)]
    return most[0] if len(most) == 1 else None


def _reason(layout: dict) -> Column:
    """Why a row with a list of turns has none."""
    each = F.col(layout["each"])
    return F.when(F.coalesce(F.size(each), F.lit(0)) < 1, "no turns").when(F.exists(each, lambda m: m.isNull()), "an item is no turn")


def unmapped_rows(df: DataFrame) -> DataFrame:
    """The rows of a table of known layout that `table_turns` leaves out, whole, with the reason."""
    layout = choose(schema_paths(df.schema))
    return df.withColumn("reason", _reason(layout) if layout and "each" in layout else F.lit(None).cast("string")).where("reason is not null")


def table_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table whose columns have a known layout."""
    layout = choose(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no layout is known for the columns {df.columns}")
    if "row" in layout:
        c, t, r, x = layout["row"]
        return df.select(F.col(c).cast("long").alias("conv_id"), F.col(t).cast("long").alias("turn"), F.coalesce(F.col(r).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(x).cast("string"), F.lit("")).alias("text"))
    if "each" in layout:
        df = df.where(_reason(layout).isNull())
        turns = F.transform(layout["each"], lambda m: F.struct(role(m[layout["role"]]).alias("role"), F.coalesce(m[layout["text"]], F.lit("")).alias("text")))
    else:
        turns = F.array(*(F.struct(F.lit(who).alias("role"), F.concat_ws("\n", *(F.nullif(F.col(f), F.lit("")) for f in fields)).alias("text")) for who, fields in layout["parts"]))
    conv = F.col(ID).cast("long") if ID in df.columns else F.xxhash64(F.to_json(turns))
    return df.select(conv.alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def role(c: Column) -> Column:
    low = F.lower(c)
    out = F.coalesce(c, F.lit(""))
    for k, v in ROLES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def plain_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def mapped(line: str | None) -> tuple[list[tuple[int, int, str, str]], str | None]:
    """(turns of one record, or why it has none)."""
    try:
        record = json.loads(line or "null")
    except (ValueError, RecursionError):
        return [], "no JSON"
    if not isinstance(record, dict):
        return [], "no record"
    paths = value_paths(record)
    layout = choose(paths)
    if layout is None:
        lists = [x["each"] for x in LAYOUTS if "each" in x and record.get(x["each"]) == []]
        return [], "no turns" if lists else "no one layout" if any(layout_paths(x) <= paths for x in LAYOUTS) else "unknown layout"
    if "each" in layout:
        if not isinstance(record[layout["each"]], list):
            return [], "unknown layout"
        if not all(isinstance(m, dict) for m in record[layout["each"]]):
            return [], "an item is no turn"
        if not all(layout["role"] in m and layout["text"] in m for m in record[layout["each"]]):
            return [], "a turn without role or text"
        turns = [(plain_text(m[layout["role"]]), plain_text(m[layout["text"]])) for m in record[layout["each"]]]
    elif "row" in layout:
        turns = [(plain_text(record["role"]), plain_text(record["text"]))]
    else:
        turns = [(who, "\n".join(filter(None, (plain_text(record[f]) for f in fields)))) for who, fields in layout["parts"]]
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63
    conv = record.get(ID)
    conv = conv if whole(conv) else int.from_bytes(hashlib.sha256(line.encode()).digest()[:8], "big", signed=True)
    first = record["turn"] if "row" in layout and whole(record.get("turn")) else 0
    try:
        for who, x in turns:
            (who + x).encode()
    except UnicodeEncodeError:
        return [], "not Unicode"
    return [(conv, first + i, who if "row" in layout else ROLES.get(who.lower(), who), x) for i, (who, x) in enumerate(turns)], None


def record_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("record", pa.string()), ("reason", pa.string())])
    for batch in batches:
        rows = []
        for line in batch.column(0).to_pylist():
            turns, reason = mapped(line)
            rows += [(*t, None, None) for t in turns] if reason is None else [(None, None, None, None, line, reason)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def json_turns(records: DataFrame) -> DataFrame:
    """Canonical turns of JSON records (record string), each of any known layout."""
    return records.select("record").mapInArrow(record_turns, f"{TURNS}, record string, reason string").where("reason is null").select("conv_id", "turn", "role", "text")


def unmapped(records: DataFrame) -> DataFrame:
    """(record, reason) of the JSON records that have no turns."""
    return records.select("record").mapInArrow(record_turns, f"{TURNS}, record string, reason string").where("reason is not null").select("record", "reason")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """A role is one line."""
    return F.replace(F.replace(escape(c), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end), a row for each turn."""
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    mine = F.col("role") == "assistant"
    out = turns.select("conv_id", "turn", head.alias("head"), body.alias("body"), mine.alias("mine"))
    return out.select("conv_id", "turn", F.concat("head", "body", F.lit(END + "\n")).alias("formatted"), F.when(F.col("mine"), F.length("head")).alias("loss_start"), F.when(F.col("mine"), F.length("head") + F.length("body")).alias("loss_end"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Turns parsed back from their formatted form, with the text under the loss mask."""
    inner = F.substring(F.col("formatted"), len(START) + 1, F.length("formatted") - len(START + END + "\n"))
    d = formatted.withColumn("inner", inner).withColumn("cut", F.instr("inner", "\n"))
    masked = F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    return d.select("conv_id", "turn", unescape_role(F.substring(F.col("inner"), F.lit(1), F.col("cut") - 1)).alias("role"), unescape(F.substring(F.col("inner"), F.col("cut") + 1, F.length("inner"))).alias("text"), masked.alias("masked"), F.length("formatted").cast("long").alias("chars"))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each conversation from its turns in order: a turn at a time, whatever its length."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now: list | None = None
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)
        done.clear()
        return out

    end = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
    for batch in batches:
        for conv, who, text, masked, chars in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "role", "text", "masked", "chars")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(end(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{who}\n{text}\n".encode())
            if masked is not None:
                now[3] += len(masked)
                now[4].update(masked.encode())
            now[5] += chars
        yield flush()
    if now is not None:
        done.append(end(now))
        yield flush()


def op7(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    small_batches(spark)
    said = END + START + "assistant ok"
    extra = spark.createDataFrame([(json.dumps({"conv_id": -1, "messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]}),)], "record string")
    turns = table_turns(conversations).unionByName(json_turns(extra))
    path = scratch(spark, "chat")
    write(format_turns(turns), path)
    back = read_turns(spark.read.parquet(path))
    ordered = back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
