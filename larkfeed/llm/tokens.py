"""Token ids as Parquet list columns (operator 1).

Documents are range-partitioned by doc_id, the text's beginning and the place in the table, so that no id is one task, encoded a partition at a time and written in ascending
order. Ids are dictionary-encoded (a page of 16-bit indexes for this vocabulary), metadata columns are
delta-encoded, row groups and pages are bounded and carry page indexes, so that a reader can fetch
the metadata alone or the tokens of a few documents.

Ids are those of `Tokenizer.encode(text, add_special_tokens=False)`: a control string that stands in a text is one
id, as the library has it.

Cases: a null or empty text has the end id alone; rows that share a doc_id follow each other in order of their
first BEGINNING characters, then of their places in the table; null doc_ids come first; an empty table writes no rows; further columns are ignored unless
named in `metadata`.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, slices, small_batches, write

#: Pieces that a worker remembers before it drops those met once: bounds memory, changes no result.
REMEMBERED = 500_000
#: Pieces that are encoded at once.
AT_ONCE, JOINED = 8000, 200
#: Bytes of text that are looked up together: fewer different pieces in all, bounded memory.
AT_A_TIME = 2 << 20
#: Fixed value: the character by which byte-level BPE writes a space.
_SPACE = "\u0120"
#: White space of any kind before a space, for Python and for Arrow.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_SPACE_AFTER_SPACE = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
#: A word, signs with at most one line end, a word, signs: byte-level BPE never joins letters with signs. Apostrophes are
#: left out, as some letters join them; letters are Latin ones alone, and other characters leave the piece whole.
_PARTS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*)([!-&(-/:-@\\[-`{-~]*)")
#: Characters of a text by which rows of one doc_id are dealt.
BEGINNING = 256
#: Row groups, pages and encodings of the written files.
FILE_FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.columnindex.truncate.length": "64",
}


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1], and so on."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


class Encoder:
    """tokenizers' ids of many texts. A space after other text always starts a new piece of byte-level
    BPE, so texts are cut there and each different piece is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        # texts with a control string of the tokenizer go to it whole; in all others no piece can be one
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == _SPACE]] = True
        self.clear()

    def clear(self) -> None:
        self.code: dict = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.length, self.again = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), np.zeros(1 << 16, bool)

    def forget(self) -> None:
        """Keep the pieces that were met again, unless they are most of all."""
        keys, kept = list(self.code), np.flatnonzero(self.again[: len(self.code)])
        start, n, flat = self.start[kept], self.length[kept], self.flat
        self.clear()
        if len(kept) <= REMEMBERED // 2:
            self.add([keys[i] for i in kept.tolist()], flat[runs(start, n)], n)

    def ids_of(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, number of ids of each). Pieces without spaces or outer white space are encoded joined: only
        the first token of each begins with a space, so the ids tell where each one starts."""
        plain = [i for i, p in enumerate(pieces) if type(p) is str and p and " " not in p and not p[0].isspace() and not p[-1].isspace()]
        joined = ["".join([" " + pieces[i] for i in plain[a : a + JOINED]]) for a in range(0, len(plain), JOINED)]
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, np.int32), *ids])
        start = np.flatnonzero(self.spaced[ids])
        where, counts = np.array(plain, np.int64), np.diff(np.append(start, len(ids)))
        if len(plain) < len(pieces):
            other = sorted(set(range(len(pieces))) - set(plain))
            more = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([p[0] if type(p) is tuple else " " + p for p in map(pieces.__getitem__, other)], add_special_tokens=False)]
            where, counts, ids = np.append(where, other), np.append(counts, [len(m) for m in more]), np.concatenate([ids, *more])
        order, ends = np.argsort(where, kind="stable"), np.cumsum(counts)
        n = counts[order]
        return ids[runs(ends[order] - n, n)], n

    def add(self, pieces: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        k, n = len(self.code), len(pieces)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat) // 2, len(ids)), np.int32)])
        if k + n > len(self.start):
            more = (k + n) // 2 + n
            self.start, self.length, self.again = (np.concatenate([x[:k], np.zeros(more, x.dtype)]) for x in (self.start, self.length, self.again))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.length[k : k + n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)
        self.code.update(zip(pieces, range(k, k + n), strict=True))

    def learn(self, pieces: list) -> None:
        """Remember new pieces: those of words and signs from their parts, the others as they are encoded."""
        whole, made, parts, sizes = [], [], [], []
        for p in pieces:
            head, sign, word, last = m.groups() if (m := _PARTS.fullmatch(p if type(p) is str else p[0])) else ("", "", "", "")
            if not sign:
                whole.append(p)
                continue
            own = [head if type(p) is str else (head,), (sign,)]
            if word:
                own.append((word,))
            if last:
                own.append((last,))
            made.append(p)
            parts += own
            sizes.append(len(own))
        seen = self.code
        whole = list(dict.fromkeys([*whole, *(p for p in parts if p not in seen)]))
        for a in range(0, len(whole), AT_ONCE):
            self.add(whole[a : a + AT_ONCE], *self.ids_of(whole[a : a + AT_ONCE]))
        if made:
            at = np.fromiter(map(self.code.__getitem__, parts), np.int64, len(parts))
            ids = self.flat[runs(self.start[at], self.length[at])]
            self.add(made, ids, np.add.reduceat(self.length[at], np.cumsum(sizes) - sizes))

    def codes(self, keys: list) -> np.ndarray:
        """The number under which each of these different pieces is remembered."""
        at = np.fromiter(map(self.code.get, keys, repeat(-1)), np.int64, len(keys))
        self.again[at[at >= 0]] = True
        if len(new := np.flatnonzero(at < 0)):
            new_keys = list(map(keys.__getitem__, new.tolist()))
            self.learn(new_keys)
            at[new] = np.fromiter(map(self.code.__getitem__, new_keys), np.int64, len(new))
        return at

    def numbers(self, keys: list) -> np.ndarray:
        """The same for pieces that may repeat."""
        self.codes(list(dict.fromkeys(keys)))
        return np.fromiter(map(self.code.__getitem__, keys), np.int64, len(keys))

    @staticmethod
    def pieces(text: str) -> list:
        """A string stands for itself after a space, a tuple for a text's beginning."""
        parts = _BEFORE_SPACE.split(text)
        parts[1:] = [p[1:] for p in parts[1:]]
        parts[0] = parts[0][1:] if parts[0][0] == " " else (parts[0],)
        return parts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), as the library gives them; texts with control strings one by one."""
        texts = texts.fill_null("")
        control = np.zeros(len(texts), bool)
        for c in self.controls:
            control |= np.asarray(pc.match_substring(texts, c))
        if not control.any():
            return self.encode_plain(texts)
        plain, n = self.encode_plain(texts.filter(pa.array(~control)))
        self.tokenizer.encode_special_tokens = False
        own = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts.filter(pa.array(control)).to_pylist()]
        self.tokenizer.encode_special_tokens = True
        counts, start = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        counts[~control], counts[control] = n, [len(x) for x in own]
        start[~control], start[control] = np.cumsum(n) - n, len(plain) + np.cumsum(counts[control]) - counts[control]
        return np.concatenate([plain, *own])[runs(start, counts)], counts

    def encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without control strings. Spaces after other text are found by Arrow, and only different
        pieces become Python strings; texts with white space before a space are cut one by one."""
        if len(self.code) > REMEMBERED:
            self.forget()
        odd = pc.match_substring_regex(texts, _SPACE_AFTER_SPACE)
        cut = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        offsets, each = np.asarray(cut.offsets), cut.flatten().dictionary_encode()
        begun = each.take(pa.array(offsets[:-1])).dictionary_decode().to_numpy(zero_copy_only=False).tolist()
        blank = np.array([not p for p in begun], bool)
        at = self.codes(each.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(each.indices)]
        at[offsets[:-1][~blank]] = self.numbers([(p,) for p in begun if p])
        at = np.delete(at, offsets[:-1][blank])
        counts = np.diff(offsets) - blank
        if lists := [self.pieces(t) for t in texts.filter(odd).to_pylist()]:
            more, n, odd = np.array([len(x) for x in lists]), len(at), np.asarray(odd)
            start, plain = np.empty(len(texts), np.int64), counts
            counts = np.empty(len(texts), np.int64)
            counts[~odd], counts[odd] = plain, more
            start[~odd], start[odd] = np.cumsum(plain) - plain, n + np.cumsum(more) - more
            at = np.append(at, self.numbers([p for x in lists for p in x]))[runs(start, counts)]
        lengths = self.length[at]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[runs(self.start[at], lengths)], np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """Kept between the tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, start, part = encoder_of(path), 0, TaskContext.get().partitionId()
    for batch in batches:
        for rows in slices(batch, limit=AT_A_TIME):
            ids, counts = encoder.encode(rows.column(rows.schema.get_field_index("text")))
            n = len(counts)
            out = np.full(len(ids) + n, end_id, np.int32)
            out[np.arange(len(ids)) + np.repeat(np.arange(n), counts)] = ids
            offsets = np.concatenate([[0], np.cumsum(counts + 1)])
            own = {
                "n_tokens": pa.array(counts + 1, pa.int64()), "part": pa.array(np.full(n, part), pa.int32()), "part_start": pa.array(start + offsets[:-1], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out)),
            }
            start += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else rows.column(rows.schema.get_field_index(f.name)) for f in schema], schema=schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, metadata: tuple[str, ...] = ()) -> None:
    """Encode docs (doc_id, text) and write them to `path` in ascending doc_id order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    # ranges of the whole order: no id, and no text, is one task
    kept = docs.select("doc_id", *metadata, "text", F.substring("text", 1, BEGINNING).alias(" begin"), F.monotonically_increasing_id().alias(" place"))
    kept = kept.repartitionByRange("doc_id", " begin", " place").sortWithinPartitions("doc_id", " begin", " place").drop(" begin", " place")
    schema = docs.select("doc_id", *metadata).schema.add("n_tokens", "long").add("part", "integer").add("part_start", "long").add("ids", T.ArrayType(T.IntegerType(), False))
    arrow = to_arrow_schema(schema)
    arrow = pa.schema([f if f.name != "ids" else pa.field("ids", pa.list_(pa.int32())) for f in arrow])
    write(kept.mapInArrow(lambda b: encode_rows(b, tokenizer, end_id, arrow), schema), path, **FILE_FORMAT)


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(b.schema.get_field_index("ids"))
        values, at = np.asarray(ids.values, dtype="<u4"), np.asarray(ids.offsets)
        crc = [zlib.crc32(values[x:y].data) for x, y in zip(at, at[1:], strict=False)]
        keep = [i for i, f in enumerate(b.schema) if f.name != "ids"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(crc, pa.int64())], [*(b.schema.field(i).name for i in keep), "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens wrote, with `start`: the number of ids of all documents before."""
    rows = spark.read.parquet(path)
    # one row for each written partition, 12 bytes: bounded by the writer's partition count, so it is sent to all
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def op1(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    small_batches(spark)
    got = read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return got.mapInArrow(checksums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
