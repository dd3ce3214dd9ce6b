"""HTML extraction (operator 9): a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags, inline tags don't cut). Each has
features of its ancestors (tags, class and id words) and of its text; the chain weighs features by
label and label by label. It is trained on the labelled pages of `htmlpages` by gradient steps on the
exact likelihood (forward-backward), and pages are decoded by Viterbi. Scripts, styles, heads and
comments are markup and never blocks.

The ancestors' features are kept up as elements open and close, for decoding as one sum of weights, so the work
is in proportion to the page's length however deep it nests.

Cases: null or empty html gives an empty text; broken markup is read as browsers do (unclosed tags
end with their parent, the rest of a page whose last tag never ends is no text); `<br>` is white space; formulas and the
fallback text of objects are text; repeated rows are read each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches
from .htmlpages import page

#: Fixed values of HTML: elements whose content is no text, that have no content, that don't cut text.
OPAQUE = frozenset("script style noscript template svg head title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math mi mn mo mrow mtext msub msup mfrac msqrt object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that opens ends these, if they are open nearer than the elements of the second set.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main aside nav header footer form select".split())

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</[^a-zA-Z][^>]*>", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: For pages with a quote that never ends.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_HEAD_END = re.compile(r"</head\s*>|<body[\s>]", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
STEPS, PAGES, RATE = 120, 700, 0.15


class Open:
    """The open elements, and what they say together of a block within them."""

    def __init__(self, score: dict[str, int] | None):
        self.score, self.tags, self.features = score, [], []
        self.at: dict[str, list[int]] = {}  # where in the stack each tag is
        self.blocks, self.scopes = [], []  # places of elements that aren't inline, and of those that bound an implied end
        self.seen: dict[str, int] = {}
        self.total = 0

    def push(self, tag: str, attributes: str) -> None:
        own = []
        if tag not in INLINE:
            if tag not in ("html", "body"):
                own.append(f"in:{tag}")
            own += [f"name:{w.lower()}" for a, b, c in _NAMES.findall(attributes) for w in _WORD.findall(a or b or c)] if attributes else []
            self.blocks.append(len(self.tags))
        for f in own:
            n = self.seen.get(f, 0)
            self.seen[f] = n + 1
            if not n and self.score is not None:
                self.total += self.score.get(f, 0)
        if tag in SCOPE:
            self.scopes.append(len(self.tags))
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.features.append(own)

    def close(self, upto: int) -> None:
        while len(self.tags) > upto:
            tag = self.tags.pop()
            self.at[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.tags):
                self.blocks.pop()
            if self.scopes and self.scopes[-1] == len(self.tags):
                self.scopes.pop()
            for f in self.features.pop():
                self.seen[f] -= 1
                if not self.seen[f]:
                    del self.seen[f]
                    if self.score is not None:
                        self.total -= self.score.get(f, 0)

    def end(self, tag: str) -> None:
        """An end tag: an inline one doesn't end the block around it."""
        if (places := self.at.get(tag)) and not (tag in INLINE and self.blocks and self.blocks[-1] > places[-1]):
            self.close(places[-1])

    def imply(self, tag: str) -> None:
        """What the beginning of a block ends: an open paragraph, and items beside it up to the next list or table."""
        bound = self.scopes[-1] if self.scopes else -1
        if tag in ENDS:
            places = [p[bisect.bisect(p, bound)] for t in ("p", *ENDS[tag]) if (p := self.at.get(t)) and p[-1] > bound]
            if places:
                self.close(min(places))
        elif (p := self.at.get("p")) and p[-1] > bound:
            self.close(p[-1])

    def state(self) -> tuple:
        """(weights of the features of all ancestors, or the features themselves; tag of the nearest block)."""
        return self.total if self.score is not None else frozenset(self.seen), self.tags[self.blocks[-1]] if self.blocks else ""


def leaf_blocks(html: str, score: dict[str, int] | None = None) -> list[tuple[str, tuple, int]]:
    """(text as written, ancestors as of Open.state, characters of it in links) of each leaf block."""
    out: list[tuple[str, tuple, int]] = []
    stack, parts = Open(score), []
    linked = at = 0
    around: tuple = ()
    tag_of, head_ends = _TAG, True

    def cut() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, around, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, around
        if not parts:
            around = stack.state()
        parts.append(text)
        linked += len(text) if stack.at.get("a") else 0

    size = len(html)
    while at < size:
        m = _OPEN.search(html, at)
        if (upto := m.start() if m else size) > at:
            add(html[at:upto])
        if not m:
            break
        at = upto
        if (m := _COMMENT.match(html, at)) is not None:
            at = m.end()
            continue
        if (m := tag_of.match(html, at)) is None and tag_of is _TAG:
            tag_of = _LOOSE  # a quote runs to the end of the page: from here on quotes are nothing special
            m = tag_of.match(html, at)
        if m is None:
            break  # a tag that never ends
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag not in INLINE:
                cut()
            stack.end(tag)
            continue
        if tag in OPAQUE:
            if tag != "svg":
                cut()
            if tag == "head":
                end = _HEAD_END.search(html, at) if head_ends else None
                head_ends = end is not None
                at = (end.start() if end[0][1] != "/" else end.end()) if end else at
            elif not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                # what browsers read as raw text runs to the end, other elements end with their parent
                at = end.end() if end else size if tag != "svg" else at
            continue
        if tag in ("br", "img"):
            if parts:
                parts.append(" ")
            continue
        if tag not in INLINE:
            cut()
            if tag not in VOID:
                stack.imply(tag)
        if tag not in VOID and not (m[3].endswith("/") and tag not in ("p", "div", "a", "span")):
            stack.push(tag, m[3])
    cut()
    return out


def own_features(blocks: list[tuple[str, tuple, int]]) -> list[list[str]]:
    """Features of each block beside those of its ancestors: its element, length, links, words and last sign, and the same of the blocks
    around it, so that main text is known also where no element or name says so."""
    sizes = [min(8, len(t).bit_length()) for t, _, _ in blocks]
    links = [min(4, 4 * linked // max(1, len(t))) for t, _, linked in blocks]
    free = np.cumsum([0, *(max(0, len(t) - linked) for t, _, linked in blocks)]).tolist()
    longest, n, out = max((len(t) for t, _, _ in blocks), default=1), len(blocks), []
    beside = ["edge", *(f"{s}:{min(1, k)}" for s, k in zip(sizes, links, strict=True)), "edge"]
    for i, (text, (_, tag), _) in enumerate(blocks):
        words = text[:400].split()
        short = sum(len(w) <= 3 for w in words)
        own = [
            "*", f"at:{tag}", f"size:{sizes[i]}", f"links:{links[i]}", f"both:{sizes[i]}:{links[i]}:{tag}", f"short:{4 * short // max(1, len(words))}", f"share:{5 * len(text) // longest}",
            f"before:{beside[i]}", f"after:{beside[i + 2]}", f"near:{min(11, (free[min(n, i + 4)] - free[max(0, i - 3)]).bit_length())}", "ends" if text[-1] in ".?!" else "open",
        ]
        out.append([*own, "rights"] if "©" in text else own)
    return out


def features(blocks: list[tuple[str, tuple, int]]) -> list[set[str]]:
    return [{*around, *own} for (_, (around, _), _), own in zip(blocks, own_features(blocks), strict=True)]


#: Weights are whole numbers of this fraction, so that sums come out the same in any order.
UNIT = 1 << 32


class Chain:
    """Two labels; weights by feature and label, and by neighbouring labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.score = {k: round(float(weights[i, 1] - weights[i, 0]) * UNIT) for k, i in names.items()}
        self.pair = [[round(float(v) * UNIT) for v in row] for row in moves - moves[0, 0]]

    def sums(self, rows: list[set[str]]) -> list[int]:
        return [sum(self.score.get(k, 0) for k in f) for f in rows]

    def decode(self, sums: list[int]) -> list[int]:
        """The best labels of blocks with these sums of weights for label 1, by Viterbi."""
        if not sums:
            return []
        (a, b), (c, d) = self.pair
        zero, one, back = 0, sums[0], []
        for s in sums[1:]:
            x, y = (0, zero + a) if zero + a >= one + c else (1, one + c), (0, zero + b) if zero + b >= one + d else (1, one + d)
            back.append((x[0], y[0]))
            zero, one = x[1], y[1] + s
        now = int(one > zero)
        out = [now]
        for p in reversed(back):
            now = p[now]
            out.append(now)
        return out[::-1]


def training_rows(pages: int = PAGES, first: int = 0) -> list[tuple[list[set[str]], list[int]]]:
    rows = []
    for seed in range(first, first + pages):
        blocks = leaf_blocks(page(seed))
        labels = [int("\x01" in t) for t, _, _ in blocks]
        blocks = [(t.replace("\x01", "").strip() or ".", c, n) for t, c, n in blocks]
        rows.append((features(blocks), labels))
    return rows


_fitted: list[Chain] = []


def fit(rows: list | None = None, steps: int = STEPS, rate: float = RATE) -> Chain:
    """Maximum likelihood with a small squared penalty; all pages advance together, padded to one length."""
    if rows is None:
        if not _fitted:
            _fitted.append(fit(training_rows()))
        return _fitted[0]
    names = {k: i for i, k in enumerate(sorted(set().union(*(f for fs, _ in rows for f in fs))))}
    pages, long = len(rows), max(len(fs) for fs, _ in rows)
    x = np.zeros((pages, long, len(names)), np.float32)
    y, real = np.zeros((pages, long), int), np.zeros((pages, long), bool)
    for p, (fs, labels) in enumerate(rows):
        for t, f in enumerate(fs):
            x[p, t, [names[k] for k in f]] = 1
        y[p, : len(labels)], real[p, : len(labels)] = labels, True
    flat = x[real]
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    both = real[:, 1:] & real[:, :-1]
    gold_moves = np.array([[(both & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    gold = np.eye(2)[y] * real[..., None]
    m, v = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for step in range(1, steps + 1):
        e = np.zeros((pages, long, 2))
        e[real] = flat @ w
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, long):
            new = e[:, t] + np.stack([lse(f[:, t - 1] + moves[:, j]) for j in (0, 1)], 1)
            f[:, t] = np.where(real[:, t, None], new, f[:, t - 1])
        for t in range(long - 2, -1, -1):
            new = np.stack([lse(moves[i] + e[:, t + 1] + b[:, t + 1]) for i in (0, 1)], 1)
            b[:, t] = np.where(real[:, t + 1, None], new, 0)
        z = lse(f[:, -1])
        p1 = np.exp(f + b - z[:, None, None]) * real[..., None]
        p2 = np.exp(f[:, :-1, :, None] + moves + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        grads = [flat.T @ (gold - p1)[real] / pages - 1e-3 * w, (gold_moves - p2.sum((0, 1))) / pages - 1e-3 * moves]
        for k, (g, target) in enumerate(zip(grads, (w, moves), strict=True)):  # Adam
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            target += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Chain(names, w, moves)


def main_text(html: str | None, chain: Chain) -> str:
    blocks, get = leaf_blocks(html or "", chain.score), chain.score.get
    sums = [around + sum(get(k, 0) for k in own) for (_, (around, _), _), own in zip(blocks, own_features(blocks), strict=True)]
    return "\n\n".join(b[0] for b, label in zip(blocks, chain.decode(sums), strict=True) if label)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(chain or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                texts = [main_text(h, sent.value) for h in rows.column(rows.schema.get_field_index("html")).to_pylist()]
                own = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(k)) for k in ("page_id", "url")), *own], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9(pages: DataFrame) -> DataFrame:
    return extract(pages)
