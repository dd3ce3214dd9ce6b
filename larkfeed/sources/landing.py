"""Landed feed snapshots: text files with control totals, read by Spark from any store.

A snapshot is a file of lines of tab-separated cells: what comes before the header, the header, rows, and a last line with the
number of cells that aren't empty. The header is found by its labels, wherever it stands. Files are read one to a row, so each is one
part of a task; what is declared is held against what is counted for every file before any row is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import folder, kept_seen, ship

#: The feed's header, and the columns that its labels stand for.
HEADER = {"지역": "region", "상호": "name", "주소": "address", "상표": "brand", "셀프여부": "self_yn", "고급휘발유": "premium", "휘발유": "gasoline", "경유": "diesel"}
TOTAL = "#cells"
#: A snapshot file of more bytes is an error, before its content is read.
MOST_BYTES = 32 << 20
_SCHEMA = "file string, at long, problem string, " + ", ".join(f"{c} string" for c in HEADER.values())


class LandingError(ValueError):
    """A snapshot that isn't what it says, with the file."""


def _escaped(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def _plain(text: str) -> str:
    if "\\" not in text:
        return text
    out, parts = [], iter(text)
    for c in parts:
        out.append({"t": "\t", "n": "\n", "r": "\r"}.get(d := next(parts, ""), d) if c == "\\" else c)
    return "".join(out)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = len(HEADER)
    yield pa.RecordBatch.from_arrays([pa.array(["snapshot", "\t".join(HEADER)])], ["value"])
    for b in batches:
        rows = [[_escaped(x) for x in row] for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        cells += sum(x != "" for row in rows for x in row)
        yield pa.RecordBatch.from_arrays([pa.array(["\t".join(row) for row in rows], pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array([f"{TOTAL}\t{cells}"])], ["value"])


def write_snapshots(feed: DataFrame, path: str) -> None:
    """A snapshot file for each partition of the feed's text columns, in their order."""
    ship(feed.sparkSession)
    feed.select(*(F.col(c).cast("string") for c in HEADER.values())).mapInArrow(_lines, "value string").write.text(path)


def rows_of(content: bytes) -> tuple[list[list[str]], str | None]:
    """(rows of a snapshot, what is wrong with it). One that is wrong has no rows."""
    try:
        lines = content.decode("utf-8").removesuffix("\n").split("\n")
    except UnicodeDecodeError:
        return [], "not UTF-8"
    heads = [i for i, line in enumerate(lines) if [x.strip() for x in line.split("\t")] == list(HEADER)]
    if len(heads) != 1:
        return [], f"{len(heads)} headers"
    name, _, declared = lines[-1].partition("\t")
    if name != TOTAL or not declared.isdigit():
        return [], "no control total"
    rows = [line.split("\t") for line in lines[heads[0] + 1 : -1]]
    if (wrong := next((i for i, r in enumerate(rows) if len(r) != len(HEADER)), None)) is not None:
        return [], f"{len(rows[wrong])} cells in line {heads[0] + wrong + 2}"
    counted = len(HEADER) + sum(x != "" for r in rows for x in r)
    return (rows, None) if counted == int(declared) else ([], f"{declared} cells declared, {counted} counted")


def _parsed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, length, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            rows, problem = rows_of(content) if content is not None else ([], f"{length} bytes")
            out = [[path, i, None, *map(_plain, r)] for i, r in enumerate(rows)]
            out.append([path, len(rows), problem or "", *[None] * len(HEADER)])  # the file's own row: how many it has, and what is wrong
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def landed(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The feed's rows of all snapshot files in a folder, numbered through the files in order of their names. A file whose header,
    cells or total is wrong is an error before any row is returned, and so is a folder without files."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    small = files.select("path", "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))
    schema = to_arrow_schema(StructType.fromDDL(_SCHEMA))
    parsed = small.mapInArrow(lambda b: _parsed(b, schema), _SCHEMA)
    wrong = F.when(F.col("problem") != "", F.col("file"))
    rows, (seen,) = kept_seen(parsed, "landed", [F.count("problem").alias("files"), F.min(wrong).alias("file"), F.min_by("problem", wrong).alias("problem")])
    if not seen["files"]:
        raise LandingError(f"{path} has no snapshot")
    if seen["file"]:
        raise LandingError(f"{seen['file']}: {seen['problem']}")
    # a row for each file
    before = rows.where("problem is not null").select("file", F.coalesce(F.sum("at").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    d = rows.where("problem is null").join(before, "file")
    return d.select((F.col("before") + F.col("at") + 1).alias("row_num"), *HEADER.values())


def relanded(feed: DataFrame, order: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A feed written in its order as snapshots into the shared folder and read back: three, or as many as keep each at about a quarter
    of the most bytes that a snapshot may have."""
    size = F.lit(len(HEADER))
    for c in HEADER.values():
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        size = size + F.octet_length(text) + F.length(text) - F.length(F.translate(text, "\\\t\n\r", ""))  # escaped ones take two
    every = feed.agg(F.sum(size.cast("long"))).first()[0] or 0
    feed = feed.repartitionByRange(max(3, 1 + 4 * every // most_bytes), order).sortWithinPartitions(order)
    path = folder(feed.sparkSession, "snapshots")
    write_snapshots(feed, path)
    return landed(feed.sparkSession, path, most_bytes)
