"""Suffix-array dedup (operator 2): repeated byte strings by deep-shallow sorting of suffixes.

Every string of LENGTH bytes is routed by the smallest hash of its K-byte grams, so equal strings meet
wherever they stand. A run of strings with the same smallest hash is a piece: its bytes are the
strings' bytes, overlapping. Hashes only decide what meets: routes that lead to one document alone are dropped, the bytes of
all other pieces are fetched, and everything that is removed was found equal by sorting bytes. Equal pieces are one
class, of which the smallest document's stands for all; a suffix array over the strings of a route's different
pieces then finds what is equal in part.

Deep-shallow sorting: a multikey quicksort, which splits each group by a pivot word into less, equal and
greater and goes on to the next word with the equal ones, down to SHALLOW words; the groups that
still agree are ordered by blind tries, all groups at once: every suffix is compared with its group's
leader, filed under the depth and byte at which it leaves the leader's path, and files with
several suffixes are the groups of the next round.

No task depends on how often a string occurs: equal pieces of a slice of about a megabyte are one row before anything is
shuffled; a route's rows come in order of doc_id, so a class needs one row in memory however many follow; and a route of more than WIDE
rows, or with a piece of more than LONG strings, is dealt string by string, by a hash of the whole string, each different string of a document once.

Cases: null or empty texts have no bytes; texts shorter than LENGTH lose nothing; repeated rows of
a doc_id are judged each (an equal doc_id is not a smaller one), also with different texts; rows
without doc_id are never covered and cover nothing; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, materialize, mix, range_hashes, release, signed, slices, sliding_min, small_batches, stored, text_buffer, union

LENGTH, K = 50, 20
SHALLOW = 3
WIDE = 2000
#: Groups of up to so many suffixes are sorted by their words at once.
SMALL = 24
#: Strings that are sorted at once.
BATCH = 400_000
#: A route with a piece of more strings is dealt string by string as well. Strings of wide routes that are told apart at once, and bytes
#: that are copied at once: memory only.
LONG, AT_ONCE, COPIED = 20_000, 200_000, 16 << 20
#: Bytes of text for each part of the routes and documents that meet one after another, and what a row of a piece takes beside its bytes: disk only.
PART, ROW = 64 << 20, 40
PLACES = pa.list_(pa.struct([("start", pa.int32()), ("strings", pa.int32())]))


def pieces_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in the buffer, strings, route) of the pieces of each text."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    route = sliding_min(Rolling(buf).grams(K), LENGTH - K + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    good = np.arange(n) + LENGTH <= offsets[1:][row]
    new = np.ones(n, bool)
    new[1:] = (route[1:] != route[:-1]) | (row[1:] != row[:-1]) | (good[1:] != good[:-1])
    start = np.flatnonzero(new)
    strings = np.diff(np.append(start, n))
    keep = good[start]
    start, strings = start[keep], strings[keep]
    return row[start], start, strings, route[start]


def emit_pieces(batches: Iterator[pa.RecordBatch], part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """The pieces of all texts whose routes are in a part; of equal ones within a slice, those of larger documents are `done`: covered as a
    whole. They go on under a route of their own. `place` is start, strings and done in one number: every piece is shuffled."""
    for batch in batches:
        for rows in slices(batch):
            ids, marks = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "mark"))
            buf, offsets = text_buffer(rows.column(rows.schema.get_field_index("text")))
            row, at, strings, route = pieces_of(buf, offsets)
            if parts > 1:
                own = route % np.uint64(parts) == part
                row, at, strings, route = row[own], at[own], strings[own], route[own]
            done = np.zeros(len(row), bool)
            by = np.argsort(route, kind="stable")
            same = np.zeros(len(by), bool)
            same[1:] = route[by][1:] == route[by][:-1]
            same[:-1] |= same[1:]
            if len(some := by[same]):
                done[some] = ids[row[some]] > smallest(*classes(buf, at[some], strings[some] + LENGTH - 1, route[some]), ids[row[some]])
            route = np.where(done, mix(at.astype(np.uint64) ^ signed_bits(ids[row])), route)
            start = at - offsets[row]
            place = start.astype(np.int64) << 32 | strings.astype(np.int64) << 1 | done
            yield pa.RecordBatch.from_arrays([pa.array(signed(route)), pa.array(ids[row]), pa.array(marks[row]), pa.array(place)], ["route", "doc_id", "mark", "place"])


def signed_bits(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(np.uint64)


def smallest(order: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each suffix's class."""
    low = np.minimum.reduceat(doc[order], np.flatnonzero(np.diff(kind, prepend=-1)))
    out = np.empty(len(doc), doc.dtype)
    out[order] = low[kind]
    return out


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (route, doc_id): those that are done, and those whose route leads to several documents, with their number
    in the route. Of a route that may run over any number of batches, only the first document's rows are held back until
    another shows up."""
    route = first = None
    several, held, seen = False, [], 0

    def numbered(b: pa.RecordBatch, nth: np.ndarray) -> pa.RecordBatch:
        place = b.column(3).to_numpy()
        start, strings = (place >> 32).astype(np.int32), (place >> 1 & 0x7FFFFFFF).astype(np.int32)
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(start), pa.array(strings), pa.array(place & 1 == 1), pa.array(nth.astype(np.int64))], ["route", "doc_id", "mark", "start", "strings", "done", "nth"])

    for batch in batches:
        done = pa.array(batch.column(3).to_numpy() & 1 == 1)
        if (n := done.true_count):
            yield numbered(batch.filter(done), np.zeros(n))
        batch = batch.filter(pc.invert(done))
        if not batch.num_rows:
            continue
        r, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(r), bool)
        new[1:] = r[1:] != r[:-1]
        new[0] = route is None or r[0] != route
        group = np.cumsum(new)  # 0: goes on from the batch before
        begin = np.flatnonzero(new)
        firsts = np.append(d[0] if first is None else first, d[begin])
        nth = np.arange(len(r)) - np.append(-seen, begin)[group]
        other = np.bincount(group, d != firsts[group], minlength=group[-1] + 1) > 0
        other[0] |= several
        if other[0] and held and group[0] == 0:
            yield from held
            held = []
        if group[-1] > 0:
            held = []
        keep, last = other[group], group == group[-1]
        yield numbered(batch.filter(pa.array(keep)), nth[keep])
        if (wait := ~keep & last).any():
            held.append(numbered(batch.filter(pa.array(wait)), nth[wait]))
        route, first, several, seen = r[-1], firsts[group[-1]], bool(other[group[-1]]), int(nth[-1]) + 1


def one_byte_runs(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the string at each place is the one at the place before: then 51 bytes are equal."""
    change = np.concatenate([[0], np.cumsum(buf[1:] != buf[:-1])])
    return (at > 0) & (change[np.minimum(at + LENGTH - 1, len(buf) - 1)] == change[np.maximum(at - 1, 0)])


def different_strings(buf: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(indexes into `at`, where each of them stands as runs of start and strings): the different strings of each row, which is a document."""
    again = one_byte_runs(buf, at)
    again[0] = False
    again[1:] &= (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1])
    head = np.flatnonzero(~again)
    run = np.diff(np.append(head, len(at)))
    order, kind = suffix_order(buf, at[head], LENGTH, row[head].astype(np.uint64))
    by = order[np.lexsort((at[head][order], kind))]
    kind = np.sort(kind)
    # neighbours of one class that follow each other are one run
    place, size = at[head][by], run[by]
    new = np.ones(len(by), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (place[1:] != place[:-1] + size[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(size, first)
    begins = np.flatnonzero(np.diff(kind[first], prepend=-1))
    ends = pa.array(np.append(begins, len(first)), pa.int32())
    return head[by[first[begins]]], pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(place[first].astype(np.int32)), pa.array(total.astype(np.int32))], ["start", "strings"]))


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of pieces (a list of struct for each document); of wide routes each different string of a document once, under a route of its
    own, with all places where it stands. Strings are told apart where they are; only what goes on is copied."""
    for batch in batches:
        for rows in slices(batch):
            buf, offsets = text_buffer(rows.column(rows.schema.get_field_index("text")))
            lists = rows.column(rows.schema.get_field_index("pieces"))
            each = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            start, strings, route, wide = (each.field(k).to_numpy(zero_copy_only=False) for k in ("start", "strings", "route", "wide"))

            def rows_of(row: np.ndarray, start: np.ndarray, strings: np.ndarray, route: np.ndarray, also: pa.Array | None, deal: bool) -> Iterator[pa.RecordBatch]:
                size = (strings + LENGTH - 1).astype(np.int64)
                part = np.cumsum(size) // COPIED
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(row)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    at, ends = offsets[row[i:j]] + start[i:j], np.concatenate([[0], np.cumsum(size[i:j])])
                    flat = buf[np.repeat(at - ends[:-1], size[i:j]) + np.arange(ends[-1])]
                    own = signed(mix(signed_bits(route[i:j])) ^ range_hashes(flat, ends[:-1], ends[1:])) if deal else route[i:j]
                    data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                    take = pa.array(row[i:j])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), rows.column(rows.schema.get_field_index("doc_id")).take(take), rows.column(rows.schema.get_field_index("mark")).take(take), pa.array(start[i:j].astype(np.int32)), pa.array(strings[i:j].astype(np.int32)), data, pa.nulls(j - i, PLACES) if also is None else also.slice(i, j - i)],
                        ["route", "doc_id", "mark", "start", "strings", "data", "also"],
                    )

            if (~wide).any():
                yield from rows_of(row[~wide], start[~wide], strings[~wide], route[~wide], None, False)
            # wide pieces in parts of so many strings
            which, n = np.flatnonzero(wide), strings[wide].astype(np.int64)
            ends = np.cumsum(n)
            for low in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
                k = np.arange(low, min(low + AT_ONCE, int(ends[-1])))
                of = np.searchsorted(ends, k, side="right")
                piece, place = which[of], start[which[of]] + (k - (ends - n)[of])
                chosen, also = different_strings(buf, offsets[row[piece]] + place, row[piece])
                base = offsets[row[piece[chosen]]]
                inner = also.flatten()
                moved = inner.field("start").to_numpy() - np.repeat(base, np.diff(np.asarray(also.offsets)))
                also = pa.ListArray.from_arrays(also.offsets, pa.StructArray.from_arrays([pa.array(moved.astype(np.int32)), inner.field("strings")], ["start", "strings"])).cast(PLACES)
                yield from rows_of(row[piece[chosen]], place[chosen], np.ones(len(chosen), np.int64), route[piece[chosen]], also, True)


def suffix_order(buf: np.ndarray, at: np.ndarray, length: np.ndarray | int = LENGTH, group: np.ndarray | None = None, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): `at` in order of the `length` bytes that start there, within each group and length if given, and a
    number for each different string."""
    size = np.broadcast_to(np.asarray(length, np.int64), at.shape)
    wide = np.ndarray((len(buf) + 1,), np.dtype(">u8"), np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))

    def word(s: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        """The j-th eight bytes of suffixes s, as numbers in their order; what lies beyond a suffix's end is zero."""
        over = np.clip(8 * (np.asarray(j) + 1) - size[s], 0, 8)
        w = wide[np.minimum(at[s] + 8 * np.asarray(j), len(buf))].astype(np.uint64)
        return np.where(over == 8, np.uint64(0), w >> (8 * (over % 8)).astype(np.uint64))

    n_words = (size + 7) // 8
    order = np.lexsort((size, group)) if group is not None else np.argsort(size, kind="stable")
    begin = np.ones(len(at), bool)
    begin[1:] = size[order][1:] != size[order][:-1]
    if group is not None:
        begin[1:] |= group[order][1:] != group[order][:-1]
    slots = np.arange(len(at))
    rank = slots[begin][np.cumsum(begin) - 1] if len(at) else slots  # of each slot in order: the slot at which its group begins
    depth = np.zeros(len(at), np.int64)  # of each slot: words in which its group agrees
    active = several(rank, slots)
    while len(active):  # multikey quicksort, all groups at once
        g = rank[active]
        new = np.ones(len(active), bool)
        new[1:] = g[1:] != g[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(active)))
        of = np.cumsum(new) - 1
        key = word(order[active], depth[active])
        # the pivot of a large group is the median of three; a small group is split by all its words
        x, y, z = key[first], key[first + many // 2], key[first + many - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[of]
        large = (many > SMALL)[of]
        part = np.where(large, (key >= pivot).astype(np.uint64) + (key > pivot).astype(np.uint64), key)
        by = np.lexsort((part, of))
        order[active], key, part = order[active][by], key[by], part[by]
        equal = ~large | (part == 1)
        cut = new.copy()
        cut[1:] |= part[1:] != part[:-1]
        rank[active] = active[cut][np.cumsum(cut) - 1]
        depth[active[equal]] += 1
        active = several(rank, active)
        active = active[depth[active] < np.minimum(shallow, n_words[order[active]])]
    active = several(rank, slots)
    active = active[depth[active] < n_words[order[active]]]
    while len(active):  # blind tries
        g = rank[active]
        lead = np.ones(len(active), bool)
        lead[1:] = g[1:] != g[:-1]
        leader = order[active[np.flatnonzero(lead)[np.cumsum(lead) - 1]]]
        mine, most = order[active], n_words[order[active]]
        leaves = most.copy()  # the first word in which a suffix leaves its leader's path
        less, branch = np.zeros(len(active), bool), np.zeros(len(active), np.uint64)
        left, j = np.arange(len(active)), shallow
        while len(left):
            x, y = word(mine[left], j), word(leader[left], j)
            off = x != y
            out = left[off]
            leaves[out], less[out], branch[out] = j, x[off] < y[off], x[off]
            j += 1
            left = left[~off & (j < most[left])]
        # files in order: those that leave below the leader, earliest first; the path itself; those above, latest first
        place = np.where(leaves == most, 0, np.where(less, leaves - most, most - leaves))
        by = np.lexsort((branch, place, g))
        order[active] = mine[by]
        place, branch = place[by], branch[by]
        new = np.ones(len(active), bool)
        new[1:] = (place[1:] != place[:-1]) | (branch[1:] != branch[:-1]) | (g[1:] != g[:-1])
        rank[active] = active[new][np.cumsum(new) - 1]
        active = several(rank, active[place != 0])
    first = np.ones(len(at), bool)
    first[1:] = rank[1:] != rank[:-1]
    return order, np.cumsum(first) - 1


def classes(buf: np.ndarray, at: np.ndarray, size: np.ndarray, route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of whole pieces: two have one class if their route and all their bytes are equal."""
    return suffix_order(buf, at, size, route)


def several(rank: np.ndarray, active: np.ndarray) -> np.ndarray:
    """The slots of `active` whose group has more than one."""
    r = rank[active]
    same = np.zeros(len(active), bool)
    same[1:] = r[1:] == r[:-1]
    same[:-1] |= same[1:]
    return active[same]


def bytes_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of `data`, where each row's begin)."""
    data = t["data"].combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    return np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of strings that a smaller document has too, of pieces in order of (route, doc_id)."""
    rest: pa.Table | None = None

    def ranges(t: pa.Table, at: np.ndarray, start: np.ndarray, strings: np.ndarray) -> list[pa.RecordBatch]:
        rows = t.select(["doc_id", "mark", "also"]).take(pa.array(at))
        return rows.append_column("start", pa.array(start.astype(np.int32))).append_column("strings", pa.array(strings.astype(np.int32))).combine_chunks().to_batches()

    def whole(t: pa.Table) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
        """(ranges of pieces equal to one of a smaller document, the rows left, the class of each row)."""
        buf, at = bytes_of(t)
        strings, doc = (t[c].to_numpy().astype(np.int64) for c in ("strings", "doc_id"))
        order, kind = classes(buf, at, strings + LENGTH - 1, t["route"].to_numpy())
        gone = doc > smallest(order, kind, doc)
        out = np.flatnonzero(gone)
        of = np.empty(len(doc), np.int64)
        of[order] = kind
        return ranges(t, out, t["start"].to_numpy()[out], strings[out]), np.flatnonzero(~gone), of

    def sort(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        out, left, of = whole(t)
        yield from out
        # one row of each class stands for those with its document; routes of one class have nothing more to compare
        lead = left[np.unique(of[left], return_index=True)[1]]
        route = t["route"].to_numpy()[lead]
        both = np.unique(route, return_inverse=True, return_counts=True)
        lead = lead[both[2][both[1]] > 1]
        if not len(lead):
            return
        reps = t.take(pa.array(lead)).combine_chunks()
        buf, at = bytes_of(reps)
        strings, doc = (reps[c].to_numpy().astype(np.int64) for c in ("strings", "doc_id"))
        piece = np.repeat(np.arange(len(strings)), strings)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(strings) - strings, strings)
        covered = doc[piece] > smallest(*suffix_order(buf, at[piece] + step, LENGTH, reps["route"].to_numpy()[piece]), doc[piece])
        begin, end = covered.copy(), covered.copy()
        same = piece[1:] == piece[:-1]
        begin[1:] &= ~(covered[:-1] & same)
        end[:-1] &= ~(covered[1:] & same)
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        if not len(a):
            return
        # runs of a class's representative are those of all rows that it stands for
        members = left[np.isin(of[left], of[lead])]
        members = members[np.argsort(of[members], kind="stable")]
        low, high = (np.searchsorted(of[members], of[lead[piece[a]]], side) for side in ("left", "right"))
        which = np.repeat(np.arange(len(a)), high - low)
        at = members[np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]]
        yield from ranges(t, at, t["start"].to_numpy()[at] + step[a][which], (b - a + 1)[which])

    most = BATCH
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        if (done := np.cumsum(rest["strings"].to_numpy().astype(np.int64)))[-1] < most:
            continue
        r = rest["route"].to_numpy()
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        while len(cuts):  # whole routes, about BATCH strings at once; the last route may go on
            upto = cuts[max(0, np.searchsorted(done[cuts - 1], BATCH) - 1)]
            yield from sort(rest.slice(0, upto))
            rest, most = rest.slice(upto), BATCH
            done, cuts = np.cumsum(rest["strings"].to_numpy().astype(np.int64)), cuts[cuts > upto] - upto
            if done[-1] < BATCH:
                break
        if done[-1] >= most:  # one route: what a smaller document has is settled, the rest waits for the route's end
            rest = rest.combine_chunks()
            out, left, _ = whole(rest)
            yield from out
            rest = rest.take(pa.array(left))
            most = max(BATCH, 2 * int(rest["strings"].to_numpy().astype(np.int64).sum()))
    if rest is not None and rest.num_rows:
        yield from sort(rest)


def cover(buf: bytes, start: np.ndarray, strings: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, bytes kept) when strings that start in the ranges are taken out."""
    if not len(start):
        return 0, 0, buf
    order = np.argsort(start, kind="stable")
    a, b = start[order].astype(np.int64), (start + strings)[order].astype(np.int64) + LENGTH - 1
    top = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > top[:-1]
    a, b = a[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        kept.append(buf[at:x])
        at = y
    kept.append(buf[at:])
    return int((b - a).sum()), len(a), b"".join(kept)


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, the kept bytes, their sum and counts of each document, from its ranges."""
    for batch in batches:
        for rows in slices(batch):
            buf, offsets = text_buffer(rows.column(rows.schema.get_field_index("text")))
            lists = rows.column(rows.schema.get_field_index("ranges"))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            each = lists.flatten()
            start, strings = (each.field(k).to_numpy(zero_copy_only=False) for k in ("start", "strings"))
            size, removed, spans, kept = [], [], [], []
            for i in range(rows.num_rows):
                text = buf[offsets[i] : offsets[i + 1]].tobytes()
                x, y = ends[i], ends[i + 1]
                n, s, k = cover(text, start[x:y], strings[x:y])
                size.append(len(text)), removed.append(n), spans.append(s), kept.append(k)
            sums = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sums, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


PIECE = "doc_id long, mark long, start int, strings int"
ALSO = "array<struct<start: int, strings: int>>"


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Ranges (doc_id, mark, start, strings) of strings that start in a smaller document too; docs (doc_id, mark, text).

    Routes meet in parts, one after another, and so do documents and their pieces: each part's shuffle is gone before the next begins."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = 1 + size // PART  # parts that are worth their jobs
    halves, deals = min(2, most), min(3, most)
    made = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        made.append(path)
        return df

    def meet(k: int) -> DataFrame:
        pieces = docs.mapInArrow(lambda batches: emit_pieces(batches, k, halves), "route long, doc_id long, mark long, place long")
        return pieces.repartition("route").sortWithinPartitions("route", "doc_id").mapInArrow(shared, f"route long, {PIECE}, done boolean, nth long")

    met = union([keep(meet(k), "pieces") for k in range(halves)])
    covered = met.where("done").select("doc_id", "mark", "start", "strings")
    wide = keep(met.where(~F.col("done") & ((F.col("nth") == WIDE) | (F.col("strings") > LONG))).select("route", F.lit(True).alias("wide")).distinct(), "wide")

    # so many parts that the bytes of one's pieces are two thirds of the texts'
    bytes_met = met.where("not done").agg(F.sum(F.col("strings") + LENGTH + ROW)).first()[0] or 0
    parts = min(most, 1 + 3 * bytes_met // (2 * max(1, size)), 32)

    # equal rows of one document are one here; the pieces of each part are a column
    def listed(k: int) -> DataFrame:
        own = F.pmod(F.xxhash64("doc_id"), F.lit(deals)) == k
        piece = F.struct("start", "strings", "route", F.coalesce("wide", F.lit(False)).alias("wide"))
        lists = [F.collect_set(F.when(F.pmod("route", F.lit(parts)) == i, piece)).alias(f"pieces{i}") for i in range(parts)]
        pieces = met.where("not done").where(own).join(wide, "route", "left").groupBy("doc_id", "mark").agg(*lists)
        return pieces.join(docs.where(own).dropDuplicates(["doc_id", "mark"]), ["doc_id", "mark"])

    texts = union([keep(listed(k), "open-texts") for k in range(deals)])
    done = made[halves:]

    def equal(k: int) -> DataFrame:
        own = texts.select("doc_id", "mark", "text", F.col(f"pieces{k}").alias("pieces")).where("size(pieces) > 0")
        fetched = own.mapInArrow(fetch, f"route long, {PIECE}, data binary, also {ALSO}")
        return fetched.repartition("route").sortWithinPartitions("route", "doc_id").mapInArrow(compare, f"doc_id long, mark long, also {ALSO}, start int, strings int")

    near = union([keep(equal(k), "equal-strings") for k in range(parts)])
    near = near.select("doc_id", "mark", F.inline(F.coalesce("also", F.array(F.struct("start", "strings")))))
    release(spark, done)
    return covered.unionByName(near)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    ranges = repeated_ranges(docs).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "strings")).alias("ranges"))
    got = docs.join(ranges, ["doc_id", "mark"], "left").select("doc_id", "text", "ranges")
    return got.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
