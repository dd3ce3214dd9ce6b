"""Exact dedup by counting quotient filters (operator 11).

Each partition counts the fingerprints of its texts in a counting quotient filter for each block of fingerprints (their first
bits). The filters of a block meet in one task, are merged by their sorted remainders without loss, and give the
fingerprints that were counted more than once. Only texts of these go on to byte verification: they are grouped by their
bytes within each batch first, so that a text in a third of all rows is one row a batch, and then over the corpus. Texts that share a
fingerprint only by chance are different groups.

Cases: a null text counts as empty; the row with the smallest doc_id stays, rows without an id come after all others; of rows
that share the smallest doc_id and their text one stays; equal ids with different texts are unrelated; texts of any length are whole; an empty
table gives no rows; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

#: Bits of a fingerprint. Fewer bits give more chance groups for byte verification, never other rows.
BITS = 64
#: Fingerprints of a block at most, on average, and the least number of blocks; fingerprints that a task sorts at once.
BLOCK, LEAST_BLOCKS, AT_ONCE = 1 << 18, 16, 1 << 20
#: A filter's slots are this full at most.
LOAD = 0.75
#: The bitmap that keeps most other texts from being routed has at most 2 ** WORDS rows of 64 bits, 4 MB, and is sent to all workers. It
#: lets a chance share of other texts through, which grows with the repeated fingerprints (a tenth at some two million) and costs
#: shuffling only; the exact fingerprints follow by a join.
WORDS = 18


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


# ---------------------------------------------------------------- the filter


def counted(remainder: int, count: int, bits: int) -> list[int]:
    """The slots of a remainder that occurs `count` times. Remainders ascend in a run, so a slot that doesn't is part of a counter:
    x, x for two; beyond, x, digits, x with digits other than 0 and x, led by 0 if the first one is above x. A zero can't be
    told from the leading 0, so it is 0, 0, 0 for three and 0, digits, 0, 0 beyond."""
    if count <= 2:
        return [remainder] * count
    symbols = [0, remainder] if remainder else [0]
    base, left, digits = (1 << bits) - len(symbols), count - (3 if remainder else 4), []
    while left > 0 or not digits:
        left, d = divmod(left, base)
        digits.append(d + 1 if not remainder or d + 1 < remainder else d + 2)
    digits.reverse()
    if not remainder:
        return [0, *digits, 0, 0] if count > 3 else [0, 0, 0]
    return [remainder, *([0] if digits[0] > remainder else []), *digits, remainder]


def counts_of(run: list[int], bits: int) -> list[tuple[int, int]]:
    """The remainders of a run and their counts: the inverse of `counted`."""
    out, i = [], 0
    while i < len(run):
        x, j = run[i], i + 1
        if j == len(run) or run[j] > x and x:
            n = 1
        elif x:
            if run[j] == x:
                n, j = 2, j + 1
            else:
                end = run.index(x, j)
                value = 0
                for d in run[j:end]:
                    if d:
                        value = value * ((1 << bits) - 2) + (d - 1 if d < x else d - 2)
                n, j = value + 3, end + 1
        elif run[1] == 0:
            n = j = 3 if run[2:3] == [0] else 2
        else:  # no other counter has two zeros in a row
            end = next((k for k in range(2, len(run)) if run[k - 1 : k + 1] == [0, 0]), 0)
            value = 0
            for d in run[1 : end - 1] if end else []:
                value = value * ((1 << bits) - 1) + d - 1
            n, j = (value + 4, end + 1) if end else (1, 1)
        out.append((x, n))
        i = j
    return out


def encode(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of ascending different keys of so many bits: a bit for each quotient that occurs, remainders in
    sorted runs at their quotient or the next free slot, and a bit where each run ends."""
    n = len(keys)
    q = max(1, min(int(np.ceil(np.log2(max(n, 1) / LOAD))), bits - 3))
    r = bits - q
    quotient, remainder = keys >> np.uint64(r), keys & np.uint64((1 << r) - 1)
    size = np.minimum(counts, 2)
    long = np.flatnonzero(counts > 2)
    more = [counted(int(remainder[i]), int(counts[i]), r) for i in long.tolist()]
    size[long] = [len(m) for m in more]
    ends = np.cumsum(size)
    slots = np.repeat(remainder, size)
    for i, m in zip(long.tolist(), more, strict=True):
        slots[ends[i] - size[i] : ends[i]] = np.array(m, np.uint64)
    runs, first = np.unique(quotient, return_index=True)
    at = np.append(first, n)
    before = np.append(0, ends)[at]
    start = np.maximum.accumulate(runs.astype(np.int64) - before[:-1]) + before[:-1]  # linear probing
    stop = start + np.diff(before)
    whole = max(1 << q, int(stop[-1]) if n else 0)
    occupied, run_end = np.zeros(1 << q, bool), np.zeros(whole, bool)
    occupied[runs.astype(np.int64)], run_end[stop - 1] = True, True
    table = np.zeros(whole, np.uint64)
    table[np.arange(len(slots)) + np.repeat(start - before[:-1], np.diff(before))] = slots
    width = (r + 7) // 8
    packed = table.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([q, width]) + len(table).to_bytes(8, "little") + np.packbits(occupied).tobytes() + np.packbits(run_end).tobytes() + packed.tobytes()


def decode(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in ascending order, counts) of a filter."""
    q, width, whole = data[0], data[1], int.from_bytes(data[2:10], "little")
    r, a = bits - q, 10 + ((1 << q) + 7) // 8
    b = a + (whole + 7) // 8
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(data[10:a], np.uint8))[: 1 << q])
    stop = np.flatnonzero(np.unpackbits(np.frombuffer(data[a:b], np.uint8))[:whole]) + 1
    if not len(stop):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    table = np.zeros((whole, 8), np.uint8)
    table[:, :width] = np.frombuffer(data[b:], np.uint8).reshape(whole, width)
    table = table.view(np.uint64).ravel()
    start = np.maximum(occupied, np.append(0, stop[:-1]))
    size = stop - start
    slots = table[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    run = np.repeat(np.arange(len(size)), size)
    odd = np.zeros(len(size), bool)  # runs with a counter somewhere
    odd[run[1:][(slots[1:] <= slots[:-1]) & (run[1:] == run[:-1])]] = True
    plain = ~odd[run]
    keys = [(occupied[run[plain]].astype(np.uint64) << np.uint64(r)) | slots[plain]]
    counts = [np.ones(int(plain.sum()), np.int64)]
    ends = np.cumsum(size)
    some: list[tuple[int, int]] = []
    for k in np.flatnonzero(odd).tolist():
        some += [((int(occupied[k]) << r) | x, n) for x, n in counts_of(slots[ends[k] - size[k] : ends[k]].tolist(), r)]
    keys.append(np.array([x for x, _ in some], np.uint64))
    counts.append(np.array([n for _, n in some], np.int64))
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    return key[order], count[order]


def merge(filters: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of several filters together: their sorted lists are merged and equal keys' counts added."""
    parts = [decode(f, bits) for f in filters]
    key, count = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(key, kind="stable")
    return summed(key[order], count[order])


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, count
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(count, first)


# ---------------------------------------------------------------- Spark


def _count(batches: Iterator[pa.RecordBatch], block_bits: int, bits: int) -> Iterator[pa.RecordBatch]:
    low = bits - block_bits

    def filters(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, count = summed(key := np.sort(np.concatenate(held)), np.ones(len(key), np.int64))
        block = (key >> np.uint64(low)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        own = key & np.uint64((1 << low) - 1)
        for i in range(0, len(cuts) - 1, 1000):
            some = list(zip(cuts[i : i + 1000], cuts[i + 1 : i + 1001], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a]) for a, _ in some], pa.int64()), pa.array([encode(own[a:b], count[a:b], low) for a, b in some], pa.binary())], ["block", "filter"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(64 - bits)).copy())
            n += batch.num_rows
        if n >= AT_ONCE:
            yield from filters(held)
            held, n = [], 0
    if n:
        yield from filters(held)


def _merged(rows: pa.Table, block_bits: int, bits: int) -> pa.Table:
    low = bits - block_bits
    key, count = merge(rows["filter"].to_pylist(), low)
    more = count > 1
    own = (key[more] | np.uint64(rows["block"][0].as_py() << low)) << np.uint64(64 - bits)
    return pa.table({"fp": pa.array(own.view(np.int64)), "n": pa.array(count[more])})


def repeated(prints: DataFrame, n_rows: int, bits: int = BITS) -> DataFrame:
    """(fp, n): the fingerprints, a bigint of which the first `bits` bits count, that occur more than once in `prints`."""
    small_batches(prints.sparkSession)
    block_bits = min(max(LEAST_BLOCKS.bit_length() - 1, int(np.ceil(np.log2(max(1, n_rows) / BLOCK)))), bits - 4)
    filters = prints.select("fp").mapInArrow(lambda b: _count(b, block_bits, bits), "block long, filter binary")
    return filters.groupBy("block").applyInArrow(lambda t: _merged(t, block_bits, bits), "fp long, n long")


def word_of(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 64 - WORDS)


#: The bit of a fingerprint within its word, as SQL: the six bits that follow.
BIT = f"cast(shiftrightunsigned(fp, {58 - WORDS}) & 63 as int)"


def bitmap(fps: DataFrame) -> DataFrame:
    """(word, bits): where fingerprints begin."""
    return fps.groupBy(word_of(F.col("fp")).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {BIT}))").alias("bits"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one row."""
    for batch in batches:
        for rows in slices(batch, "norm"):
            t = pa.table({"fp": rows.column(0), "norm": rows.column(1).cast(pa.large_string()), "doc_id": rows.column(2), "one": pa.array(np.ones(rows.num_rows, np.int64))})
            t = t.group_by(["fp", "norm"]).aggregate([("one", "sum"), ("doc_id", "min")])
            t = t.select(["fp", "norm", "one_sum", "doc_id_min"]).rename_columns(["fp", "norm", "n", "least"])
            yield from t.set_column(1, "norm", t["norm"].cast(pa.string())).combine_chunks().to_batches()


def duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Every row of docs (doc_id, text) as doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    norm = normalised(F.col("text"))
    # the fingerprint is the digest's beginning, so bytes are hashed once; bits beyond `bits` are zero
    sha, fp = F.sha2("norm", 256), F.conv(F.substring("sha", 1, 16), 16, -10).cast("bigint")
    fp = fp.bitwiseAND(-1 << (64 - bits)) if bits < 64 else fp
    prints = docs.select("doc_id", norm.alias("norm")).select("doc_id", sha.alias("sha")).select(F.monotonically_increasing_id().alias("row"), "doc_id", fp.alias("fp"), F.unhex("sha").alias("sha"))
    prints = materialize(prints, "prints")
    more = materialize(repeated(prints, prints.count(), bits).select("fp"), "repeated")
    texts = docs.select("doc_id", norm.alias("norm")).withColumn("sha", sha).select(fp.alias("fp"), "norm", "doc_id")
    texts = texts.join(F.broadcast(bitmap(more)), word_of(F.col("fp")) == F.col("word")).where("shiftrightunsigned(bits, " + BIT + ") & 1 = 1").select("fp", "norm", "doc_id")
    texts = texts.mapInArrow(_grouped, f"fp long, norm string, n long, least {kind}")
    groups = texts.join(more.hint("merge"), "fp").groupBy("fp", "norm").agg(F.sum("n").alias("n"), F.min("least").alias("least"))  # by their bytes
    groups = groups.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "n", "least").groupBy("fp", "sha").agg(F.count("*").alias("texts"), F.first("n").alias("n"), F.first("least").alias("least"))
    clash = F.raise_error(F.lit("two different texts have one SHA-256 digest"))
    groups = groups.select("fp", "sha", F.when(F.col("texts") > 1, clash.cast("long")).otherwise(F.col("n")).alias("n"), "least")
    # rows that repeat with their id: the first of them may stay
    again = prints.groupBy("fp", "sha", "doc_id").agg(F.count("*").alias("times"), F.min("row").alias("first")).where("times > 1").select(F.col("fp").alias("fp_"), F.col("sha").alias("sha_"), F.col("doc_id").alias("doc_id_"), "first")
    out = prints.join(groups, ["fp", "sha"], "left")
    out = out.join(again, (F.col("fp") == F.col("fp_")) & (F.col("sha") == F.col("sha_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left")
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("least"))
    kept = F.col("doc_id").eqNullSafe(keep) & (F.col("first").isNull() | (F.col("first") == F.col("row")))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op11(docs: DataFrame) -> DataFrame:
    return duplicates(docs)
