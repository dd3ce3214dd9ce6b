"""Language ID (operator 8): interpolated Kneser-Ney character models in sorted hash arrays.

One model of 4-character grams for each language is counted over a bounded sample of the labelled
documents (SAMPLE for each language, different texts, chosen by their hash; a fifth of them is kept apart for
calibration). All languages' log probabilities of a gram stand in one row of a table whose keys are
sorted 64-bit hashes; a gram that no language has falls back to shorter ones by the usual weights. Every
whole document is scored, and the lowest cross-entropy for each character wins.

Rejection: a document whose best cross-entropy lies above its language's calibrated limit is marked
`rejected`; the limit is wide and wider for short texts, so that ordinary documents stay.

Cases: null texts and texts without a letter are `und` with score 0 and rejected; without any labelled
document every text is `und`; ties go to the language that sorts first; repeated rows are judged
each; an empty table gives no rows; further columns pass through `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix, numbered_columns, signed, slices, small_batches, text_buffer

N = 4
#: Labelled documents that a language's model is fitted on, about.
SAMPLE = 600
SPACE = 32
_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(what a code point below 2 ** 16 counts as, whether it is a letter): letters in lower case, all else a space."""
    if not _tables:
        letter = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)
        low = np.fromiter((ord(chr(i).lower()[0]) for i in range(1 << 16)), np.int64, 1 << 16)
        _tables.extend([np.where(letter, np.minimum(low, 0xFFFF), SPACE).astype(np.uint64), letter])
    return _tables[0], _tables[1]


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts, each begun by a space and without doubled spaces; first of each text and the total; has a letter)."""
    to, letter = tables()
    buf, offsets = text_buffer(column)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    wide = points > 0xFFFF
    is_letter = letter[np.minimum(points, 0xFFFF)]
    if wide.any():
        is_letter = is_letter.copy()
        is_letter[wide] = [chr(c).isalpha() for c in points[wide]]
    chars = np.where(wide, np.where(is_letter, 0xFFFF, SPACE), to[np.minimum(points, 0xFFFF)]).astype(np.uint64)
    total = np.concatenate([[0], np.cumsum(is_letter)])
    begin = np.zeros(len(chars), bool)
    begin[at[:-1][at[:-1] < len(chars)]] = True
    before = np.full(len(chars), SPACE, np.uint64)
    before[1:] = chars[:-1]
    before[begin] = SPACE
    keep = (chars != SPACE) | (before != SPACE)
    kept = np.concatenate([[0], np.cumsum(keep)])[at]
    return chars[keep], kept, total[at[1:]] > total[at[:-1]]


def grams(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The N characters that end at each position, 16 bits each; a text is preceded by spaces."""
    out, now = chars.copy(), chars
    for j in range(1, N):
        before = np.full(len(chars), SPACE, np.uint64)
        before[j:] = chars[:-j] if j else chars
        for k in range(j):  # the first j characters of a text
            i = first[:-1] + k
            before[i[i < np.minimum(first[1:], len(chars))]] = SPACE
        out |= before << np.uint64(16 * j)
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch."""
    for batch in batches:
        for rows in slices(batch):
            lang = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), object)
            chars, first, _ = characters(rows.column(rows.schema.get_field_index("text")))
            g, owner = grams(chars, first), np.repeat(np.arange(len(lang)), np.diff(first))
            for x in sorted(set(lang)):
                u, n = np.unique(g[(lang == x)[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(u), pa.string()), pa.array(signed(u)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def discount(n: np.ndarray) -> float:
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return min(0.95, one / (one + 2 * two)) if one else 0.5


class Sorted:
    """Rows of values by key: keys are hashed, sorted, and found from an index of their top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys)
        order = np.argsort(h)
        self.keys, self.values = h[order], values[order]
        self.bits = np.uint64(64 - max(4, int(len(h)).bit_length() + 1))
        self.at = np.searchsorted(self.keys >> self.bits, np.arange((1 << (64 - int(self.bits))) + 1, dtype=np.uint64))
        self.keys = np.concatenate([self.keys, [np.uint64(0xFFFFFFFFFFFFFFFF)]])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        h = mix(keys)
        top = (h >> self.bits).astype(np.int64)
        row, end = self.at[top], self.at[top + 1]
        out = np.where((row < end) & (self.keys[row] == h), row, -1)
        left = np.flatnonzero((out < 0) & (row + 1 < end))
        row, step = row[left], 1
        while len(left):
            row = row + 1
            hit = self.keys[row] == h[left]
            out[left[hit]] = row[hit]
            go = ~hit & (row + 1 < end[left])
            left, row = left[go], row[go]
        return out


class Model:
    """Log probabilities of the last character of a gram for all languages."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.limits = langs, np.full(len(langs), np.inf)
        low = lambda g, n: g & np.uint64((1 << (16 * n)) - 1)
        # by order: n-grams with their counts; below the highest, the number of different characters before them
        orders: dict[int, list] = {n: [] for n in range(1, N + 1)}
        for x in langs:
            g, c = counts[x]
            for n in range(N, 0, -1):
                orders[n].append((g, c, discount(c)))
                g, c = np.unique(low(g, n - 1), return_counts=True) if n > 1 else (g, c)
        alphabet = max(2, len(np.unique(np.concatenate([g for g, _, _ in orders[1]]))) + 1)
        self.floor = np.full((1, len(langs)), np.log(1 / alphabet), np.float32)
        self.probability, self.weight = {}, {}
        for n in range(1, N + 1):
            keys = np.unique(np.concatenate([g for g, _, _ in orders[n]]))
            contexts = np.unique(keys >> np.uint64(16))
            p, w = np.zeros((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
            for i, (g, c, d) in enumerate(orders[n]):
                ctx = np.searchsorted(contexts, g >> np.uint64(16))
                total, kinds = np.bincount(ctx, c, len(contexts)), np.bincount(ctx, minlength=len(contexts))
                seen = total > 0
                w[seen, i] = d * kinds[seen] / total[seen]
                p[np.searchsorted(keys, g), i] = (c - d).clip(0) / total[ctx]
            lower = np.exp(self.shorter(low(keys, n - 1), n - 1))
            p += w[np.searchsorted(contexts, keys >> np.uint64(16))] * lower
            self.probability[n], self.weight[n] = Sorted(keys, np.log(p).astype(np.float32)), Sorted(contexts, np.log(w).astype(np.float32))

    def shorter(self, g: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities by n-grams, rows of languages."""
        if n == 0:
            return np.broadcast_to(self.floor, (len(g), len(self.langs)))
        row = self.probability[n].find(g)
        out = self.probability[n].values[row]
        if len(lost := np.flatnonzero(row < 0)):
            x = g[lost]
            ctx = self.weight[n].find(x >> np.uint64(16))
            out[lost] = np.where((ctx >= 0)[:, None], self.weight[n].values[ctx], 0) + self.shorter(x & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy of each text by language, characters, has a letter)."""
        chars, first, letter = characters(column)
        sums = np.zeros((len(chars) + 1, len(self.langs)))
        np.cumsum(self.shorter(grams(chars, first), N), axis=0, dtype=np.float64, out=sums[1:])
        n = np.diff(first)
        return -(sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)[:, None], n, letter

    def allowed(self, n: np.ndarray) -> np.ndarray:
        return self.limits[None, :] + 6 / np.sqrt(np.maximum(n, 1))[:, None]


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text, aside): `sample` different labelled texts a language at most, whatever ids there are, and which of them are put aside to find
    limits: each fifth, so never the only ones. Texts are drawn by their hash: the smallest ones, looked for below a bound that follows
    from the number of different texts, so that few rows are ranked."""
    usable = docs.where("lang is not null and text is not null").where(~F.coalesce(held_out(), F.lit(False))).select("lang", "text", F.xxhash64("text").alias("draw"))
    draws = materialize(usable.select("lang", "draw").distinct(), "lang-draws")
    sizes = draws.groupBy("lang").agg(F.count("*").alias("size"))  # a row a language
    share = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    near = draws.join(F.broadcast(sizes), "lang").where(share < (4.0 * sample + 200) / F.col("size"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("draw", 1), "draw"))
    chosen = near.select("lang", "draw", place.alias("place")).where(F.col("place") <= sample)  # bounded: `sample` rows a language
    got = usable.join(F.broadcast(chosen), ["lang", "draw"]).dropDuplicates(["lang", "draw"])
    return got.select("lang", "text", (F.col("place") % 5 == 0).alias("aside"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the documents (text, lang, doc_id) that aren't held out."""
    small_batches(docs.sparkSession)
    chosen = materialize(sampled(docs, sample), "lang-sample")
    aside = F.col("aside")
    got = chosen.where(~aside).mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, g, n = np.array(got["lang"].to_pylist(), object), got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy().astype(np.float64)
    langs = sorted(set(lang))
    if not langs:
        return None
    counts = {}
    for x in langs:
        at = np.flatnonzero(lang == x)
        at = at[np.argsort(g[at])]
        counts[x] = (g[at], n[at])
    model = Model(langs, counts)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                h, n, _ = sent.value.entropies(rows.column(rows.schema.get_field_index("text")))
                best = h.argmin(1)
                over = h[np.arange(len(h)), best] - 6 / np.sqrt(np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([pa.array(best, pa.int64()), pa.array(over)], ["best", "over"])

    seen = chosen.where(aside).mapInArrow(own, "best long, over double").groupBy("best").agg(F.avg("over").alias("m"), F.stddev_pop("over").alias("s"), F.max("over").alias("top")).collect()
    for r in seen:
        model.limits[r["best"]] = max(r["top"], r["m"] + 8 * r["s"]) + 0.5
    return model


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns with lang_pred, score and rejected. Nothing but the text is read for them."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([docs.schema[k] for k in keep]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for rows in slices(batch, text):
                size = rows.num_rows
                pred, score, out = np.full(size, "und", object), np.zeros(size), np.ones(size, bool)
                if model is not None:
                    h, n, letter = model.entropies(rows.column(rows.schema.get_field_index(text)))
                    best = h.argmin(1)
                    # the posterior of the best, as if at most 30 characters spoke independently
                    odds = np.exp((h[np.arange(size), best][:, None] - h) * np.minimum(n, 30)[:, None])
                    pred[letter] = np.array(model.langs, object)[best][letter]
                    score[letter] = (1 / odds.sum(1))[letter]
                    out = ~letter | (h[np.arange(size), best] > model.allowed(n)[np.arange(size), best])
                own = [pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(out)]
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(k)) for k in keep), *own], [*keep, "lang_pred", "score", "rejected"])

    return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(run, schema)


def op8(docs: DataFrame) -> DataFrame:
    got = identify(docs, train(docs))
    return got.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def known_language(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their columns, whatever their names."""
    plain = numbered_columns(docs)
    got = identify(plain, train(docs), tuple(plain.columns), plain.columns[docs.columns.index("text")])
    return got.where("not rejected").select(*plain.columns).toDF(*docs.columns)
