"""A Merkle manifest of a dataset (operator 12).

A row's leaf is the digest of its fields. Leaves are dealt by ranges of (group, id), so that a hot group is spread, and sorted
there; the counts of each (range, group) give every leaf its index in its group. Each range builds the subtrees that
are complete in it, aligned by index, and emits only the nodes whose parents it can't finish: at most 30 a level for each end of a range.
These ragged nodes are shuffled by the coordinate of their parent, level by level, up to the root of each group; the roots of
the groups are the leaves of the last tree. Siblings then go down the same way to the ragged nodes, and from there each range
gives its rows their proofs.

Cases: a null field counts as `-`; rows without an id come first in their group, and rows that share an id are in order of their leaves
(equal rows are leaves of their own, in any order: it makes no difference); a null group is a group and comes first; texts of any length are one field
of a leaf; an empty table gives no rows; further columns aren't part of a leaf, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, union

#: Children of a node, as a power of two.
SHIFT = 4
FAN = 1 << SHIFT
#: Leaves of a range at most, about: a range is in one task's memory.
RANGE = 500_000
#: Rows whose proofs are made at once.
AT_ONCE = 500
#: Fields of a row's leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """The digest of fields: `-` for null, else the bytes of the value's text, a colon and the text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts)), 256)


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows, dealt by ranges of the order and sorted, with the number of their range and their place in it; written once."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return materialize(dealt, "ranges").withColumn("part", F.shiftrightunsigned("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))


def offsets(rows: DataFrame) -> DataFrame:
    """(part, g, first, base, total): where each group begins in each range, how many of its rows come in ranges before, and its size."""
    counts = rows.groupBy("part", "g").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("part", "g", "n", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(group).alias("total"))


def subtrees(leaves: list[str], base: int, ends: bool) -> list[tuple[int, list[str]]]:
    """For each level (index of the first node, nodes) what `leaves`, those from index `base` of a group, complete. `ends`: the
    group has no more leaves, so that its last run is complete as it is."""
    levels = [(base, leaves)]
    while levels[-1][1] and not (ends and base == 0 and len(levels[-1][1]) == 1):
        lo, nodes = levels[-1]
        hi = lo + len(nodes)
        up, top = -(-lo // FAN), -(-hi // FAN) if ends else hi // FAN
        levels.append((up, [digest(nodes[k * FAN - lo : min((k + 1) * FAN, hi) - lo]) for k in range(up, top)]))
    return levels


def ragged(levels: list[tuple[int, list[str]]]) -> list[tuple[int, int, str]]:
    """(level, index, digest) of the nodes without a parent among the levels."""
    out = []
    for k, (lo, nodes) in enumerate(levels):
        up, above = levels[k + 1] if k + 1 < len(levels) else (0, [])
        out += [(k, i, h) for i, h in enumerate(nodes, lo) if not up <= i >> SHIFT < up + len(above)]
    return out


def _nodes(rows: pa.Table, about: pa.Table) -> pa.Table:
    leaves, out = rows.sort_by("at")["leaf"].to_pylist(), []
    for r in about.to_pylist():
        for level, index, h in ragged(subtrees(leaves[r["first"] : r["first"] + r["n"]], r["base"], r["base"] + r["n"] == r["total"])):
            out.append({"part": r["part"], "g": r["g"], "n": r["n"], "first": r["first"], "base": r["base"], "total": r["total"], "level": level, "idx": index, "h": h})
    return pa.Table.from_pylist(out, pa.schema([(c, pa.string() if c in ("g", "h") else pa.int64()) for c in ("part", "g", "n", "first", "base", "total", "level", "idx", "h")]))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level, roots) from the ragged nodes (g, level, idx, h): a run has the children of one node."""
    made, runs = None, []
    top = nodes.agg(F.max("level")).first()[0] or 0
    while True:
        level = len(runs)
        now = nodes.where(F.col("level") == level).select("g", "idx", "h")
        now = now if made is None else now.unionByName(made)
        run = now.groupBy("g", F.shiftright("idx", SHIFT).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("kids"))  # 16 at most
        run = materialize(run.withColumn("root", (F.col("up") == 0) & (F.size("kids") == 1)), f"level-{level}")
        runs.append(run)
        rest = run.where("not root")
        if level >= top and rest.isEmpty():
            break
        made = rest.select("g", F.col("up").alias("idx"), F.sha2(F.concat_ws("", "kids.h"), 256).alias("h"))
    return runs, union([r.where("root").select("g", F.col("kids")[0]["h"].alias("root")) for r in runs])


def descend(runs: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, level, idx, proof) of every node of the runs; `above` has (g, proof) of the roots."""
    every, paths = [], None
    for level in reversed(range(len(runs))):
        run = runs[level]
        top = run.where("root").join(above, "g").select("g", F.lit(level).cast("long").alias("level"), F.col("kids")[0]["idx"].alias("idx"), "proof")
        every.append(top)
        if paths is not None:
            kids = run.where("not root").join(paths.select("g", F.col("idx").alias("up"), "proof"), ["g", "up"]).select("g", "proof", "kids", F.posexplode("kids").alias("at", "kid"))
            others = lambda rest: F.concat_ws("", F.transform(rest, lambda k: k["h"]))
            own = F.struct(others(F.slice("kids", F.lit(1), F.col("at"))).alias("left"), others(F.slice("kids", F.col("at") + 2, F.lit(FAN))).alias("right"))
            down = kids.select("g", F.lit(level).cast("long").alias("level"), F.col("kid.idx").alias("idx"), F.concat(F.array(own), "proof").alias("proof"))
            every.append(down)
            top = top.unionByName(down)
        paths = top
    return union(every)


def _proofs(rows: pa.Table, tops: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a range with their proofs, some at a time: a range has its leaves in memory, never its proofs."""
    leaves, known = rows["leaf"].to_pylist(), {}
    for r in tops:
        known.setdefault(r["g"], {})[r["level"], r["idx"]] = r
    for r in sorted((next(iter(t.values())) for t in known.values()), key=lambda r: r["first"]):  # what is known of each group
        own, base, last = known[r["g"]], r["base"], r["base"] + r["n"]
        levels = subtrees(leaves[r["first"] : r["first"] + r["n"]], base, last == r["total"])

        def path(level: int, i: int) -> list[dict]:
            if (level, i) in own:
                return own[level, i]["proof"]
            lo, nodes = levels[level]
            first = (i >> SHIFT) * FAN
            run = nodes[first - lo : min(first + FAN, lo + len(nodes)) - lo]
            return [{"left": "".join(run[: i - first]), "right": "".join(run[i - first + 1 :])}, *path(level + 1, i >> SHIFT)]

        for i in range(base, last, AT_ONCE):
            n = min(AT_ONCE, last - i)
            some = rows.slice(r["first"] + i - base, n)
            made = {"proof": pa.array([path(0, k) for k in range(i, i + n)], schema.field("proof").type), "subroot": pa.array([r["subroot"]] * n, pa.string())}
            yield from pa.table([made[f.name] if f.name in made else some[f.name] for f in schema], schema=schema).combine_chunks().to_batches()


def prove(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches sorted by range, in each first what is known of its ragged nodes, then its rows in their order."""
    held, now = [], None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held)
            is_row = pc.is_valid(t["leaf"])
            yield from _proofs(t.filter(is_row), t.filter(pc.invert(is_row)).select(["g", "n", "first", "base", "total", "level", "idx", "subroot", "proof"]).to_pylist(), schema)

    for batch in batches:
        part = np.asarray(batch.column(batch.schema.get_field_index("part")))
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a and part[a] != now:
                yield from done()
                held, now = [], part[a]
            held += [batch.slice(a, b - a)] if b > a else []
    yield from done()


def manifest(rows: DataFrame, group: str, key: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """rows (group, key, leaf, carried columns) as (key, carried columns, leaf, subroot, root, proof): a proof has, level by level from the leaf to
    the root, the digests to the left and to the right of the node."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    small_batches(spark)
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = materialize(rows.select(g.alias("g"), F.col(key).alias("key"), "leaf", *(F.col(c).alias(f"c_{c}") for c in carried)).withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = ranged(leaves, "g", "key", "leaf", "row").drop("row")
    about = offsets(leaves)
    mine = leaves.select(F.col("part").alias("own"), "at", "leaf")
    nodes = materialize(mine.groupBy("own").cogroup(about.groupBy("part")).applyInArrow(_nodes, "part long, g string, n long, first long, base long, total long, level long, idx long, h string"), "nodes")
    runs, roots = climb(nodes.select("g", "level", "idx", "h"))
    roots = materialize(roots, "roots")
    # the tree of the groups: their ranks are found by ranges as well
    order = ranged(roots.withColumnRenamed("g", "name"), "name").withColumn("g", F.lit(""))
    at = order.join(offsets(order).select("part", F.col("base")), "part").select("name", "g", F.lit(0).cast("long").alias("level"), (F.col("at") + F.col("base")).alias("idx"), F.col("root").alias("h"))
    at = materialize(at, "groups")
    top_runs, whole = climb(at.drop("name"))
    root = next((r["root"] for r in whole.collect()), None)  # one row, or none of an empty table
    paths = descend(top_runs, whole.select("g", F.array().cast(PROOF).alias("proof"))).where("level = 0")
    above = at.join(paths.select("idx", "proof"), "idx").select(F.col("name").alias("g"), "proof")
    down = descend(runs, materialize(above, "paths"))
    tops = materialize(nodes.drop("h").join(down, ["g", "level", "idx"]).join(roots.withColumnRenamed("root", "subroot"), "g"), "tops")
    out = leaves.select("key", *(f"c_{c}" for c in carried), "leaf").schema
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out)}, subroot string, proof {PROOF}"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    both = tops.withColumn("at", F.lit(-1).cast("long")).unionByName(leaves.drop("g"), allowMissingColumns=True)
    got = both.repartition("part").sortWithinPartitions("part", "at").mapInArrow(lambda b: prove(b, arrow), schema)
    return got.select(F.col("key").alias(key), *(F.col(f"c_{c}").alias(c) for c in carried), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def op12(docs: DataFrame) -> DataFrame:
    """Every row's leaf, roots and proof digest, and the root that follows when some texts are tampered with."""
    tampered = F.col("text") if docs.schema["text"].dataType.simpleString() == "string" else F.col("text").cast("string")
    lower = F.translate(tampered, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    own = leaf_of([F.col(c) for c in FIELDS])
    bad = F.when(hit, leaf_of([lower if c == "text" else F.col(c) for c in FIELDS]))
    rows = manifest(docs.select("doc_id", "source", own.alias("leaf"), bad.alias("bad")), "source", "doc_id", ("bad",))
    siblings = F.concat_ws("", F.transform("proof", lambda p: F.concat(p["left"], p["right"])))
    rows = rows.withColumn("folded_root", folded(F.coalesce("bad", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
