"""MinHash near-dedup (operator 10): one-permutation hashing with optimal densification.

A document's set is its distinct five-word shingles. One hash of each shingle gives a bin (the top
bits) and a value; a bin keeps its smallest value, and an empty bin borrows from bins that a hash of
(bin, attempt) names until one is filled. Bands of some bins are buckets. Copies (equal sets) are
joined first by two independent digests of the set, 128 bits, and one of them stands for all.

Pair counts stay bounded: a bucket proposes a star (each member with its smallest), each pair is
confirmed on full sets of 64-bit shingle hashes (two different shingles of a pair share one with a
probability of 1 in 10 ** 10 for sets of 40,000), and components are formed. In buckets that still hold several components, each
document proposes its likeliest partner of another component by signature. At last, what pairs of
different components remain that signatures don't rule out are decided where they meet: buckets are compared in tiles, so a bucket
of any size is many small tasks, a tile gets each document once, and only links come out, one for two components at most.
Every link is confirmed on full sets.

Sets are told apart by both digests and their size, and each different one has a number of its own; never a doc_id, which may repeat,
be null or have several texts.

Cases: null or empty texts and texts without words have an empty set and no links; fewer than five
words are one shingle; repeated rows are copies, each returned by the query, of which `keep_one` keeps
one; several texts of one doc_id are judged each by itself; a null doc_id comes after all others, so it
names no group that has another; an empty table gives no rows; further columns pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, connected_components, gram_hashes, materialize, mix, range_hashes, signed, slices, small_batches, text_buffer, words

#: Words of a shingle; the least similarity of a link for the query and for the stage of a corpus.
K, PERCENT, STAGE_PERCENT = 5, 85, 80
BINS = 256
#: How often a link at the very limit may differ in all its bands.
MISSED = 4e-5
#: Members of a bucket in one tile, and shingles of all their sets, about.
TILE, TILE_SHINGLES = 512, 200_000
#: Partners for which the text of a star's centre is sent once.
PARTNERS = 256
#: Tasks over which the sets of one group are dealt.
DEALT = 16


def band_rows(percent: int) -> int:
    """The most bins in a band with which a link of exactly `percent` is missed as seldom as MISSED."""
    return max(r for r in range(1, BINS + 1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED)


def likely(percent: int) -> int:
    """Pairs whose signatures agree in fewer of the bins are not compared: four standard deviations below
    `percent`, which loses a link at the very limit as seldom (1 in 30,000) as that its bands all differ."""
    p = percent / 100
    return int((p - 4 * (p * (1 - p) / BINS) ** 0.5) * BINS)


def shingles(column: pa.Array, named: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(distinct shingle hashes of each text in ascending order, first of each text and the total, and if `named` a
    second hash of each shingle, which shares nothing with the first but the words)."""
    buf, offsets = text_buffer(column)
    buf = LOWER[buf]
    start, end, first = words(buf, offsets, NOT_SPACE)
    n = np.diff(first)
    whole = np.maximum(n - K + 1, 0)
    owner = np.repeat(np.arange(len(n)), whole)
    at = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(first[:-1], whole)
    short = np.flatnonzero((n > 0) & (n < K))
    owner = np.concatenate([owner, short])

    def hashed(seed: int) -> np.ndarray:
        h = range_hashes(buf, start, end, seed)
        few = [gram_hashes(h[first[i] : first[i + 1]], int(n[i]))[0] ^ mix(n[i : i + 1].astype(np.uint64))[0] for i in short]
        return np.concatenate([gram_hashes(h, K)[at], np.array(few, np.uint64)])

    values = hashed(0)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1)), hashed(1)[order[new]] if named else None


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BINS values for each set that isn't empty; zeros for the others."""
    sets = len(first) - 1
    owner = np.repeat(np.arange(sets), np.diff(first))
    bins = (values >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    cell = owner * BINS + bins
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]  # values ascend within a set, so the first of a bin is its smallest
    out, full = np.zeros(sets * BINS, np.uint64), np.zeros(sets * BINS, bool)
    out[cell[new]], full[cell[new]] = values[new], True
    empty = np.flatnonzero(~full & np.repeat(np.diff(first) > 0, BINS))
    attempt = 1
    while len(empty):
        donor = empty // BINS * BINS + (mix((empty % BINS + BINS * attempt).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        ok = full[donor]
        out[empty[ok]] = out[donor[ok]]
        empty, attempt = empty[~ok], attempt + 1
    return mix(out).reshape(sets, BINS)


def signed_rows(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, n_shingles, k1, k2, bands, signature) of each row: k1 and k2 tell sets apart; a band has `each` bins."""
    count = BINS // each
    for batch in batches:
        for rows in slices(batch):
            values, first, second = shingles(rows.column(rows.schema.get_field_index("text")), named=True)
            n = np.diff(first)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(v ^ np.uint64(s)), dtype=np.uint64)]) for v, s in ((values, 0x51ED2701), (second, 0x2545F491))]
            codes = (signatures(values, first) >> np.uint64(40)).astype(np.uint8)
            bands = gram_rows(codes[:, : count * each].reshape(-1, count, each).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                *(rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "digest")), pa.array(n.astype(np.int64)), *(pa.array(signed(x[first[1:]] - x[first[:-1]])) for x in sums),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * count), pa.array(signed(bands.reshape(-1)))),
                pa.array([r.tobytes() for r in codes], pa.binary()),
            ], ["doc_id", "digest", "n_shingles", "k1", "k2", "bands", "signature"])


def gram_rows(x: np.ndarray) -> np.ndarray:
    """One hash of the last axis, with the place in the axis before it."""
    out = np.broadcast_to(np.arange(x.shape[1], dtype=np.uint64), x.shape[:2]).copy()
    for j in range(x.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return out


def confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets are near. A row without b has the text of a, and those of its partners follow."""
    known = np.empty(0, np.uint64)
    for batch in batches:
        for rows in slices(batch):
            values, first, _ = shingles(rows.column(rows.schema.get_field_index("text")))
            ok = []
            for i, centre in enumerate(rows.column(rows.schema.get_field_index("b")).is_null().to_pylist()):
                own = values[first[i] : first[i + 1]]
                if centre:
                    known = own
                    continue
                if 100 * min(len(own), len(known)) < percent * max(len(own), len(known)):
                    continue
                both = len(np.intersect1d(own, known, assume_unique=True))
                if both and 100 * both >= percent * (len(own) + len(known) - both):
                    ok.append(i)
            yield rows.select(["a", "b"]).take(pa.array(ok, pa.int64()))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of `pairs` that are links. The partners of one a are dealt into parts of about PARTNERS, so a star
    of any size is many small tasks; its centre's text goes to each part once, and not along with every partner."""
    parts = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")), "parts")
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    partners = dealt.join(texts.select(F.col("doc").alias("b"), "text"), "b").select("a", "part", "b", "text")
    centres = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(texts.select(F.col("doc").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    both = centres.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return materialize(both.mapInArrow(lambda x: confirm(x, percent), "a long, b long"), "links")


def tiles(members: DataFrame) -> DataFrame:
    """members (band, doc, component, signature) of buckets with several components, dealt into pairs of tiles:
    (band, i, j, side, ...) rows. A bucket of up to TILE members is one tile against itself."""
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all"), F.countDistinct("component").alias("kinds")).where("kinds > 1")
    sizes = sizes.select("band", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("all") / TILE_SHINGLES)).cast("int").alias("tiles"))
    m = members.join(sizes, "band").withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"))
    own = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return m.withColumn("other", own).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).select("band", "k", "i", "j", "doc", "component", "signature", "n_shingles", "tile")


MEMBER = "band long, k int, i int, j int, doc long, component long, signature binary, n_shingles long, tile int"


def likely_pairs(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, equal bins) of the pairs in a pair of tiles that signatures don't rule out, of different components. A
    pair comes in the first band alone that its documents share."""
    each, enough = band_rows(percent), likely(percent)
    count = BINS // each
    i, j, k = (t[c][0].as_py() for c in ("i", "j", "k"))
    comp, tile, size = (t[c].to_numpy() for c in ("component", "tile", "n_shingles"))
    s = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint8).reshape(-1, BINS)
    left, right = (np.flatnonzero(tile == i), np.flatnonzero(tile == j))
    for x in range(0, len(left), 32):
        rows = left[x : x + 32]
        equal = s[rows][:, None, :] == s[right][None, :, :]
        alike = equal.sum(2)
        one, two = size[rows][:, None], size[right][None, :]
        ok = (alike >= enough) & (comp[rows][:, None] != comp[right][None, :]) & (100 * np.minimum(one, two) >= percent * np.maximum(one, two))
        p, q = np.nonzero(ok)
        first = equal[p, q][:, : count * each].reshape(-1, count, each).all(2).argmax(1) == k
        p, q = p[first], q[first]
        yield rows[p], right[q], alike[p, q]


def propose(percent: int):
    """The likeliest partner of each document in a pair of tiles: no more pairs than documents."""

    def run(t: pa.Table) -> pa.Table:
        most, of = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
        for a, b, alike in likely_pairs(t, percent):
            for x, y in ((a, b), (b, a)):
                by = np.lexsort((y, -alike, x))
                top = by[np.append(True, x[by][1:] != x[by][:-1])] if len(by) else by
                better = top[alike[top] > most[x[top]]]
                most[x[better]], of[x[better]] = alike[better], y[better]
        a = np.flatnonzero(most)
        doc = t["doc"].to_numpy()
        both = np.unique(np.stack([np.minimum(doc[a], doc[of[a]]), np.maximum(doc[a], doc[of[a]])]), axis=1)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return run


def undecided(percent: int):
    """The documents of a pair of tiles that have a likely partner in it."""

    def run(t: pa.Table) -> pa.Table:
        some = np.zeros(t.num_rows, bool)
        for a, b, _ in likely_pairs(t, percent):
            some[a] = some[b] = True
        return t.filter(pa.array(some)).select([c.split()[0] for c in MEMBER.split(", ")])

    return run


def decide(percent: int):
    """Links among all likely pairs of a pair of tiles, confirmed on full sets there: one for each pair of components
    that a link joins, so no more than documents."""

    def run(t: pa.Table) -> pa.Table:
        values, first, _ = shingles(pa.concat_arrays(t["text"].chunks))
        doc, label = t["doc"].to_numpy(), np.unique(t["component"].to_numpy(), return_inverse=True)[1]
        links: list[tuple[int, int]] = []
        for a, b, alike in likely_pairs(t, percent):
            for n in np.argsort(-alike, kind="stable").tolist():
                x, y = a[n], b[n]
                if label[x] == label[y]:
                    continue
                one, two = values[first[x] : first[x + 1]], values[first[y] : first[y + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both and 100 * both >= percent * (len(one) + len(two) - both):
                    links.append((int(doc[x]), int(doc[y])))
                    label[label == label[y]] = label[x]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, digest, n_shingles, first) for each row of docs (doc_id, text), linked by a similarity of `percent`:
    first is (none, doc_id, digest) of the row that comes first in its group, by doc_id (nulls last) and a digest of
    the text. It is null for rows without words."""
    return joined(*signed_docs(docs, percent), percent)


def signed_docs(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, digest) and the digests, bands and signatures of the sets."""
    small_batches(docs.sparkSession)
    each = band_rows(percent)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    rows = materialize(slim.mapInArrow(lambda b: signed_rows(b, each), "doc_id long, digest long, n_shingles long, k1 long, k2 long, bands array<long>, signature binary"), "signatures")
    return slim, rows


def joined(slim: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The rows of `grouped`."""
    key = ["n_shingles", "k1", "k2"]
    # copies: the first row of each different set stands for it, under a number of its own
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "bands", "signature")
    sets = materialize(rows.where("n_shingles > 0").groupBy(*key).agg(F.min(first).alias("row")).select(*key, F.monotonically_increasing_id().alias("doc"), "row.*"), "sets")
    buckets = sets.select("doc", F.posexplode("bands").alias("k", "band"))
    shared = buckets.groupBy("band").agg(F.min("doc").alias("star"), F.count("*").alias("n")).where("n > 1").select("band", "star")
    members = materialize(buckets.join(shared, "band"), "buckets")
    star = members.where("doc <> star").select(F.col("star").alias("a"), F.col("doc").alias("b")).distinct()
    wanted = sets.join(members.select("doc").distinct(), "doc")
    # texts of sets with a candidate, once for all rounds
    found_by = wanted.select("doc", F.col("doc_id").alias("id"), F.col("digest").alias("of"))
    texts = slim.join(found_by, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).select("doc", "text")
    texts = materialize(texts.dropDuplicates(["doc"]), "candidates")
    links = confirmed(star, texts, percent)
    slim_signatures = materialize(wanted.select("doc", "signature", "n_shingles"), "candidate-signatures")
    for best in (True, False):
        found = connected_components(links)
        where = members.select("band", "k", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        where = materialize(where, "components-of-buckets")
        several = where.groupBy("band").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("band")
        if several.isEmpty():  # nothing is left to compare
            break
        units = tiles(where.join(several, "band").join(slim_signatures, "doc")).groupBy("band", "i", "j")
        if best:
            pairs = materialize(units.applyInArrow(propose(percent), "a long, b long").distinct().join(star, ["a", "b"], "left_anti"), "proposals")
            links = links.unionByName(confirmed(pairs, texts, percent))
        else:  # all likely pairs that are left: texts go to pairs of tiles, once for each document, and not to pairs of documents
            open_ = materialize(units.applyInArrow(undecided(percent), MEMBER), "undecided")
            links = links.unionByName(materialize(open_.join(texts, "doc").groupBy("band", "i", "j").applyInArrow(decide(percent), "a long, b long"), "decided"))
    found = connected_components(links).withColumnRenamed("node", "doc")
    own = F.struct("none", "doc_id", "digest").alias("own")
    named = sets.select(*key, "doc", own).join(found, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    named = materialize(named.withColumn("deal", F.pmod("doc", F.lit(DEALT))), "groups")
    # in two steps, as one group may hold very many sets
    firsts = named.groupBy("component", "deal").agg(F.min("own").alias("first"), F.count("*").alias("n")).groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    firsts = firsts.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    classes = named.join(firsts, ["component", "deal"], "left").select(*(F.col(k).alias(f"{k}_") for k in key), F.coalesce("first", "own").alias("first"))
    got = rows.select("doc_id", "digest", *key).join(classes, F.expr(" and ".join(f"{k} = {k}_" for k in key)), "left")
    return got.select("doc_id", "digest", "n_shingles", "first")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text), linked by a similarity of `percent`."""
    return grouped(docs, percent).select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def op10(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """docs with one row of each group of near duplicates, the first by doc_id and a digest of the text, and with all
    rows without words. Of rows repeated with both, that with the smallest other columns stays."""
    stands = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    marks = grouped(docs, percent).where("first is not null").groupBy("doc_id", "digest").agg(F.bool_or(stands).alias("stands"), F.count("*").alias("n"))
    marks = materialize(marks.where("not stands or n > 1"), "marks")
    same = docs["doc_id"].cast("long").eqNullSafe(marks["doc_id"]) & (F.xxhash64(docs["text"]) == marks["digest"])
    # repeated rows are few; they are reduced in each partition first, so very many of one kind are no single task
    repeated = docs.join(marks.where("stands"), same, "left_semi")
    order = F.struct(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))
    repeated = repeated.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return docs.join(marks, same, "left_anti").unionByName(repeated)
