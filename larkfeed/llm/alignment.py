"""Alignment of two tokenizers' ids (operator 13).

Tokens of both sides are walked together by a dangling-suffix transducer: its state is which side leads and the bytes
by which it leads; the next token of the side behind either eats into these bytes or overtakes them, and a group closes
when none are left. Transitions are remembered by (leading side, residual, token). Neither tokenizer joins a space to text before
it, so groups close before every such space: a text is cut there, and each different word is walked once for a worker.

A worker deals with a slice of documents at a time and writes, beside a row for each document, one row with the slice's
links as counts of id pairs. Counts are summed over the corpus by a shuffle on the pair; answers go back to the slices
that asked, again by a shuffle, so nothing of the corpus is sent to the driver or to all workers but the highest count
of each B id (a row for each entry of B's vocabulary at most).

Cases: null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens (zeros and an empty
digest); rows that share a doc_id, or have none, are rows of their own, and repeated rows count each time; a text of any length is whole
(one slice, if it is longer than a slice); an empty table gives no rows; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, small_batches
from .tokens import _BEFORE_SPACE, _SPACE_AFTER_SPACE, Encoder, runs

#: Words and transitions that a worker remembers before it begins anew, and bytes of text of a slice: memory only.
REMEMBERED, TRANSITIONS, SLICE = 300_000, 1 << 19, 8 << 20
#: New words that are encoded at once.
AT_ONCE = 8000
#: Fixed value: how pieces write a space.
_MARK = "▁"


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and number the others from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(_MARK, " ").encode()


class Transducer:
    """Groups of two token lists that spell the same bytes. `bytes_a` and `bytes_b` have the bytes of each id."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes = (bytes_a, bytes_b)
        self.memo: dict[tuple[int, bytes, int], tuple[int, bytes] | None] = {}

    def step(self, lead: int, residual: bytes, token: int) -> tuple[int, bytes] | None:
        """(side that leads, its unmatched bytes) after the next token of the side behind; None if the bytes differ."""
        own = self.bytes[1 - lead][token]
        if residual.startswith(own):
            return lead, residual[len(own) :]
        return (1 - lead, own[len(residual) :]) if own.startswith(residual) else None

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """The numbers of A's and B's tokens before each end that they share; None if their bytes differ."""
        memo, ids, at, out = self.memo, (a, b), [0, 0], []
        if len(memo) > TRANSITIONS:
            memo.clear()
        lead, residual = 0, b""
        while True:
            if not residual:
                if at[0] or at[1]:
                    out.append((at[0], at[1]))
                if at[0] == len(a) or at[1] == len(b):
                    return out if at == [len(a), len(b)] else None
                lead, residual = 0, self.bytes[0][a[at[0]]]
                at[0] += 1
            behind = 1 - lead
            if at[behind] == len(ids[behind]):
                return None
            key = (lead, residual, ids[behind][at[behind]])
            if (now := memo.get(key, 0)) == 0:
                now = memo[key] = self.step(*key)
            if now is None:
                return None
            at[behind] += 1
            lead, residual = now


class Aligner:
    """Both tokenizers, the transducer and the words met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = Encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = byte_of_character(), self.a.tokenizer.get_vocab()
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = bytes(map(letters.__getitem__, token)) if all(map(letters.__contains__, token)) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("the pieces of B cross spaces: texts can't be cut there")
        self.transducer = Transducer(bytes_a, [piece_bytes(p) for p in pieces])
        self.space = [self.b.piece_to_id(_MARK)]
        self.names = [str(i) for i in range(max(len(bytes_a), len(pieces)))]
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.text: list[bytes] = []
        self.sizes: list[tuple[int, int, int]] = []  # tokens of A and of B, groups; -1 for a word whose bytes differ
        self.links: list[int] = []  # of all words, one after another
        self.made = (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))

    def learn(self, words: list[str]) -> None:
        """Walk new words, each of which stands after a space."""
        names, groups_of = self.names, self.transducer.groups
        for lo in range(0, len(words), AT_ONCE):
            some = words[lo : lo + AT_ONCE]
            flat, n = self.a.ids_of(some)
            ends, flat = np.cumsum(n).tolist(), flat.tolist()
            begin = 0
            for word, end, b in zip(some, ends, self.b.encode(some, num_threads=1), strict=True):
                a, begin = flat[begin:end], end
                b = b if word else self.space
                cuts = groups_of(a, b)
                self.code[word] = len(self.sizes)
                if cuts is None or _MARK in word:
                    self.sizes.append((-1, 0, 0))
                    self.text.append(b"")
                    continue
                i = j = 0
                parts = []
                for x, y in cuts:
                    parts.append(f"{','.join([names[k] for k in a[i:x]])}|{','.join([names[k] for k in b[j:y]])}")
                    self.links.append(b[y - 1] << 32 | a[x - 1])
                    i, j = x, y
                self.sizes.append((len(a), len(b), len(cuts)))
                self.text.append(";".join(parts).encode())
        self.made = (np.array(self.sizes, np.int64).reshape(-1, 3), np.array(self.links, np.int64))

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words of all texts as numbers, words of each): every word is what follows a space after other text, and the first."""
        if len(self.code) > REMEMBERED:
            self.clear()
        odd = pc.or_(pc.match_substring_regex(texts, _SPACE_AFTER_SPACE), pc.starts_with(texts, " "))
        cut = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        plain, each = np.diff(np.asarray(cut.offsets)), cut.flatten().dictionary_encode()
        lists = [[p[1:] for p in _BEFORE_SPACE.split(" " + t)] for t in texts.filter(odd).to_pylist()]
        words, others = each.dictionary.to_pylist(), [w for x in lists for w in x]
        self.learn([w for w in dict.fromkeys([*words, *others]) if w not in self.code])
        at = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))[np.asarray(each.indices)]
        if not lists:
            return at, plain
        odd, more = np.asarray(odd), np.array([len(x) for x in lists])
        start, counts = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        counts[~odd], counts[odd] = plain, more
        start[~odd], start[odd] = np.cumsum(plain) - plain, len(at) + np.cumsum(more) - more
        return np.append(at, np.fromiter(map(self.code.__getitem__, others), np.int64, len(others)))[runs(start, counts)], counts

    def aligned(self, texts: pa.Array) -> tuple[list[list], list]:
        """(columns n_a, n_b, n_groups, groups_sha256, words of the documents; the slice's words and links)."""
        texts = texts.fill_null("")
        at, counts = self.codes(texts)
        sizes, links = self.made
        counts = np.where(np.asarray(pc.binary_length(texts)) == 0, 0, counts)
        at = at[np.repeat(counts > 0, np.maximum(counts, 1))] if (counts == 0).any() else at
        ends = np.cumsum(counts)
        wrong = np.append(0, np.cumsum(sizes[at, 0] < 0))
        good = wrong[ends] == wrong[ends - counts]
        at, counts = at[np.repeat(good, counts)], np.where(good, counts, 0)
        ends = np.cumsum(counts)
        total = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(sizes[at], axis=0)])
        n = total[ends] - total[ends - counts]
        text, sums = self.text, []
        for x, y in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            sums.append(hashlib.sha256(b";".join([text[i] for i in at[x:y].tolist()])).hexdigest() if y > x else "")
        seen = np.zeros(len(sizes), bool)
        seen[at] = True
        words = np.flatnonzero(seen)
        new = np.zeros(len(sizes), np.int64)
        new[words] = np.arange(len(words))
        own = np.sort(np.repeat(np.arange(len(counts)), counts) << 32 | new[at]) & 0xFFFFFFFF  # in order within each document
        first = np.cumsum(sizes[:, 2]) - sizes[:, 2]
        k = sizes[words, 2]
        pairs, link = np.unique(links[runs(first[words], k)], return_inverse=True)
        weight = np.bincount(link, np.repeat(np.bincount(own, minlength=len(words)), k), len(pairs)).astype(np.int64)
        offsets = np.append(0, ends)
        docs = [n[:, 0], n[:, 1], n[:, 2], sums, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own, pa.int32()))]
        return docs, [pairs, weight, np.append(0, np.cumsum(k)), link]


_aligners: dict[tuple[str, str], Aligner] = {}


def whole_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut between rows, to about `limit` bytes of text each."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, limit=limit):
            held.append(part)
            size += part.column(part.schema.get_field_index("text")).nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def align_rows(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    aligner, part = _aligners[path_a, path_b], TaskContext.get().partitionId()
    for k, rows in enumerate(whole_slices(batches, SLICE)):
        docs, about = aligner.aligned(rows.column(rows.schema.get_field_index("text")))
        n = rows.num_rows
        own = {"slice": np.full(n, part << 32 | k), "doc_id": rows.column(rows.schema.get_field_index("doc_id")), **dict(zip(("n_a", "n_b", "n_groups", "groups_sha256", "words"), docs, strict=True))}
        yield pa.RecordBatch.from_arrays([(own[f.name] if isinstance(own[f.name], pa.Array) else pa.array(own[f.name], f.type)) if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)
        of = {"slice": part << 32 | k, **dict(zip(("pairs", "weights", "ends", "links"), about, strict=True))}
        yield pa.RecordBatch.from_arrays([pa.array([of.get(f.name)], f.type) for f in schema], schema=schema)


def answered(docs: pa.Table, answers: pa.Table, schema: pa.Schema) -> pa.Table:
    """A slice's documents with the counts of their links."""
    is_doc = pc.is_null(docs["ends"])
    about, docs = docs.filter(pc.invert(is_doc)).to_pylist()[0], docs.filter(is_doc).combine_chunks()
    at = answers["code"].to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)  # every pair of the slice has its answer
    count[at], best[at] = answers["n"].to_numpy(), answers["best"].to_numpy()
    ends, links = np.array(about["ends"], np.int64), np.array(about["links"], np.int64)
    words = docs["words"].combine_chunks() if docs.num_rows else pa.array([], pa.list_(pa.int32()))
    own, cut = np.asarray(words.flatten(), dtype=np.int64), np.append(0, np.cumsum(np.asarray(pc.list_value_length(words))))

    def summed(value: np.ndarray) -> np.ndarray:
        by_word = np.append(0, np.cumsum(value[links]))[ends]
        return np.diff(np.append(0, np.cumsum(np.diff(by_word)[own]))[cut])

    made = {"n_links": docs["n_groups"], "n_best": summed(best), "count_sum": summed(count)}
    return pa.table([pa.array(made[f.name], f.type) if isinstance(made.get(f.name), np.ndarray) else made.get(f.name, docs[f.name] if f.name in docs.column_names else None) for f in schema], schema=schema)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their alignment and the counts of their links; links (a, b, n) of the corpus)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    staged = T.StructType.fromDDL(f"slice long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, words array<int>, pairs array<bigint>, weights array<bigint>, ends array<int>, links array<int>")
    arrow = pa.schema([pa.field(f.name, pa.list_(f.type.value_type) if pa.types.is_list(f.type) else f.type) for f in to_arrow_schema(staged)])
    rows = materialize(docs.select("doc_id", "text").mapInArrow(lambda b: align_rows(b, path_a, path_b, arrow), staged), "aligned")
    asked = rows.where("pairs is not null").select("slice", F.posexplode(F.arrays_zip("pairs", "weights")).alias("code", "z")).select("slice", "code", F.col("z.pairs").alias("pair"), F.col("z.weights").alias("weight"))
    counts = materialize(asked.groupBy("pair").agg(F.sum("weight").alias("n")), "links")
    of_b = F.shiftright("pair", 32).alias("b")
    highest = counts.groupBy(of_b).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most: sent to all
    judged = counts.withColumn("b", of_b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    answers = asked.join(judged, "pair").select("slice", "code", "n", "best")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    result = to_arrow_schema(T.StructType.fromDDL(out))
    held = rows.select(F.col("slice").alias("own"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "words", "ends", "links")
    got = held.groupBy("own").cogroup(answers.groupBy("slice")).applyInArrow(lambda left, right: answered(left, right, result), out)
    return got, counts.select((F.col("pair").bitwiseAND(0xFFFFFFFF)).alias("a"), of_b, "n")


def op13(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return aligned(docs, path_a, path_b)[0]
