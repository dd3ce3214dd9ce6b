"""Benchmark decontamination (operator 5): winnowed fingerprints joined and extended.

Of every window of W words the smallest hash of its k-word grams is kept, on both sides, so any shared
W words share a kept gram. Kept grams of the documents that occur in the benchmark are hits; each hit
is extended along its diagonal and marks the words of every whole shared window. An item of fewer
than W words is one window: its whole sequence is looked up directly, one gram length at a time.

A benchmark within BOUND words is sent to every worker as one index. A larger one is not: kept grams carry the
hashes of the windows that they stand for, are joined with those of the benchmark, and a hit is extended by joining
its windows; no text and no list of texts is moved, a frequent line is a skewed join that Spark splits. Both ways give the same rows.

Cases: null or empty text has no words and is clean; an item without words never occurs; equal items
all count, but an item_id that repeats counts once and a null one is the empty string; rows that share a doc_id are judged each; an empty benchmark leaves all clean; an empty
document table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, gram_hashes, materialize, numbered_columns, range_hashes, signed, slices, sliding_min, small_batches, text_buffer, words

W, K = 13, 5
#: Words of a benchmark that is sent to the workers whole (8 bytes a word and 16 a fingerprint).
BOUND = 2_000_000
#: A word before letters are made small.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word, first word of each text and the total)."""
    buf, offsets = text_buffer(column)
    buf = LOWER[buf]
    start, end, first = words(buf, offsets, ALNUM)
    return range_hashes(buf, start, end), first


def kept_grams(h: np.ndarray) -> np.ndarray:
    """Positions of the grams that winnowing keeps of one word sequence of at least W words."""
    g, span = gram_hashes(h, K), W - K + 1
    low = sliding_min(g, span)
    # a gram is kept if it is the smallest of some window that holds it
    padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    most = ~sliding_min(~padded, span)
    return np.flatnonzero(most == g)


class Index:
    """The benchmark: word hashes of all items, kept grams in hash order, and the short items' hashes by length."""

    def __init__(self, ids: list, column: pa.Array):
        self.ids = [str(x) for x in ids]
        self.h, self.first = hashed(column)
        grams, where, item, short = [], [], [], {}
        for i, (a, b) in enumerate(zip(self.first, self.first[1:], strict=False)):
            if b - a >= W:
                at = kept_grams(self.h[a:b])
                grams.append(gram_hashes(self.h[a:b], K)[at])
                where.append(at + a)
                item.append(np.full(len(at), i))
            elif b > a:
                short.setdefault(int(b - a), []).append(i)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        grams, where, item = join(grams, np.uint64), join(where, np.int64), join(item, np.int64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.where, self.item = grams[order], where[order], item[order]
        self.short = {}
        for n, items in short.items():
            keys = np.concatenate([gram_hashes(self.h[self.first[i] : self.first[i + 1]], n) for i in items])
            o = np.argsort(keys, kind="stable")
            self.short[n] = (keys[o], np.array(items)[o])

    @staticmethod
    def pairs(keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in probe, position in keys) of all equal hashes; keys are sorted."""
        a, b = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
        n = b - a
        which = np.repeat(np.arange(len(probe)), n)
        return which, np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def match(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words of the sequence are hit, which items occur)."""
        hit, items = np.zeros(len(h) + 1, np.int64), [np.empty(0, np.int64)]

        def mark(start: np.ndarray, n: int) -> None:
            np.add.at(hit, start, 1)
            np.add.at(hit, start + n, -1)

        if len(h) >= W and len(self.grams):
            at = kept_grams(h)
            which, found = self.pairs(self.grams, gram_hashes(h, K)[at])
            if len(which):
                d, b, item = at[which], self.where[found], self.item[found]
                _, one = np.unique(np.stack([item, b - d]), axis=1, return_inverse=True)
                # each window around the gram, on the same diagonal, within both texts
                s = d[:, None] - np.arange(W - K + 1)[None, :]
                t = b[:, None] - np.arange(W - K + 1)[None, :]
                ok = (s >= 0) & (s + W <= len(h)) & (t >= self.first[item][:, None]) & (t + W <= self.first[item + 1][:, None])
                s, t, item = s[ok], t[ok], np.broadcast_to(item[:, None], ok.shape)[ok]
                same = np.ones(len(s), bool)
                for j in range(W):
                    same &= h[s + j] == self.h[t + j]
                mark(np.unique(s[same]), W)
                items.append(item[same])
        for n, (keys, owner) in self.short.items():
            if len(h) >= n:
                which, found = self.pairs(keys, gram_hashes(h, n))
                mark(np.unique(which), n)
                items.append(owner[found])
        return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(items))


def judge(index: Callable[[], Index], kept: list[str], text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text):
                h, first = hashed(rows.column(rows.schema.get_field_index(text)))
                own: dict[str, list] = {x.split()[0]: [] for x in OUT.split(", ")}
                for a, b in zip(first, first[1:], strict=False):
                    n, hits, items = int(b - a), 0, []
                    if n:
                        hit, found = index().match(h[a:b])
                        hits, items = int(hit.sum()), sorted({index().ids[j] for j in found})
                    for k, v in zip(own, (n, hits, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hits > 0 and 20 * hits >= n), strict=True):
                        own[k].append(v)
                columns = [*(rows.column(rows.schema.get_field_index(k)) for k in kept), *map(pa.array, own.values())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *own])

    return run


FINGERPRINT = "gram long, n int, place int, windows array<long>"


def fingerprints(batches: Iterator[pa.RecordBatch], kept: str, lengths: list[int] | None) -> Iterator[pa.RecordBatch]:
    """(kept column, gram, n, place, windows): for each run of windows with one smallest gram, where the run begins and a
    hash of each window. Sequences of fewer words than W: of `lengths` None the whole text alone, else each run of so many words."""
    for batch in batches:
        for rows in slices(batch):
            h, first = hashed(rows.column(rows.schema.get_field_index("text")))
            out: list[list] = [[], [], [], [], []]  # row, gram, n, place, number of windows
            windows: list[np.ndarray] = []

            def add(i: int, gram: np.ndarray, n: int, place: np.ndarray, own: np.ndarray) -> None:
                for x, v in zip(out, (np.full(len(gram), i), gram, np.full(len(gram), n), place, np.diff(np.append(place, len(own)))), strict=True):  # noqa: B023
                    x.append(v)
                windows.append(own)  # noqa: B023

            for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
                if b - a >= W:
                    low = sliding_min(gram_hashes(h[a:b], K), W - K + 1)
                    begin = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
                    add(i, low[begin], W, begin, gram_hashes(h[a:b], W))
                for n in lengths if lengths is not None else [b - a] if 0 < b - a < W else []:
                    g = gram_hashes(h[a:b], n)
                    add(i, g, n, np.arange(len(g)), g)
            row, gram, n, place, count = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            flat = np.concatenate(windows) if windows else np.empty(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(signed(flat)))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(kept)).take(pa.array(row.astype(np.int64))), pa.array(signed(gram)), pa.array(n, pa.int32()), pa.array(place, pa.int32()), lists], [kept, "gram", "n", "place", "windows"])


def joined(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """(key, n_hit, n_items, items_sha256) by the digest of each text that has a hit, by joins of fingerprints."""
    key = F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("key")
    each = lambda d: d.select(*(c for c in d.columns if c not in ("place", "windows")), "place", F.posexplode("windows").alias("step", "window"))
    own = each(items.mapInArrow(lambda b: fingerprints(b, "item_id", None), f"item_id string, {FINGERPRINT}")).select("item_id", "gram", "n", "window").distinct()
    own = materialize(own, "bench-windows")
    lengths = [r[0] for r in own.where(F.col("n") < W).select("n").distinct().collect()]  # below W
    texts = docs.select(key, F.col(text).alias("text")).where("text is not null")
    met = texts.mapInArrow(lambda b: fingerprints(b, "key", lengths), f"key string, {FINGERPRINT}")
    met = each(met.join(own.select("gram", "n").distinct(), ["gram", "n"], "left_semi")).withColumn("place", F.col("place") + F.col("step")).drop("step")
    # equal texts are one from here on
    hits = materialize(met.join(own.select("gram", "n", "window").distinct(), ["gram", "n", "window"], "left_semi").distinct(), "hit-windows")
    before = Window.partitionBy("key").orderBy("place", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key", "place", "n").distinct().withColumn("end", F.col("place") + F.col("n"))
    spans = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("place", F.coalesce(F.max("end").over(before), F.lit(0)))))
    words_hit = spans.groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    found = hits.select("key", "gram", "n", "window").distinct().join(own, ["gram", "n", "window"]).select("key", "item_id").distinct()
    listed = found.groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    listed = listed.select("key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    return words_hit.join(listed, "key")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), bound: int = BOUND, text: str = "text") -> DataFrame:
    """The kept columns of each document with its verdict."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = tuple(dict.fromkeys(keep))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text")), F.count("*")).first()
    if (size[0] or 0) // 2 + size[1] <= bound:
        rows = items.orderBy("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(Index([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string())))
        schema = T.StructType([docs.schema[k] for k in keep])
        for name, kind in (x.split() for x in OUT.split(", ")):
            schema = schema.add(name, kind)
        return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(judge(lambda: sent.value, list(keep), text), schema)
    plain = docs.select(F.struct(*keep).alias("kept"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("own"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    got = plain.join(joined(docs, items, text), F.col("own") == F.col("key"), "left").withColumn("n_hit", F.coalesce(F.col("n_hit").cast("long"), F.lit(0)))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return got.select("kept.*", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns, whatever their names."""
    plain = numbered_columns(docs)
    got = contamination(plain, benchmark, tuple(plain.columns), text=plain.columns[docs.columns.index("text")])
    return got.where("not contaminated").select(*plain.columns).toDF(*docs.columns)
