"""Operators 11 to 13 against brute force, on rows made to be awkward."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkfeed.llm import alignment, merkle, quotient
from larkfeed.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: `g`, `key`, `fp` and `part` are names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, key int, fp int, part int"


def awkward(spark):
    """Nulls in every column, empty and blank texts, equal texts under one id and under several, repeated rows, one hot source."""
    rows = []
    for i, t in enumerate(["a b", "a  b", "a\tb", " a b", "", None, "  ", "\n", "a b", "A b", "ä　b", "ä b", "x" * 5000]):
        rows.append((i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s1", None if i % 4 == 0 else i, 1, 2, 3, 4))
    rows += [rows[0], rows[0], (None, "a b", None, None, None, 1, 2, 3, 4), (None, "only", None, "s2", None, 1, 2, 3, 4), (None, "only", None, "s2", None, 1, 2, 3, 4), (1, "other text", "en", "s1", 1, 1, 2, 3, 4), (-5, "Minus", "en", "", 5, 1, 2, 3, 4)]
    rows += [(100 + i, f"Text {i % 150}", "de", "hot", i, 1, 2, 3, 4) for i in range(700)]
    return spark.createDataFrame(rows, SCHEMA)


# ---------------------------------------------------------------- exact dedup


def exact_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[norm(t)].append((d is None, d or 0, i, d))
    least = {x: min(v) for x, v in groups.items()}
    return sorted(((d, least[norm(t)][3], len(groups[norm(t)]), least[norm(t)][2] == i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, (d, t) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("bits", [64, 8])
def test_exact_dedup(spark, bits):
    """With fingerprints of 8 bits most groups are told apart by their bytes alone."""
    docs = awkward(spark).repartition(5)
    want = exact_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, quotient.duplicates(docs, bits).collect()), key=repr) == want
    if bits == 64:
        assert quotient.op11(docs.where("false")).count() == 0


def test_exact_dedup_of_long_texts(spark):
    """Texts of 5 MB that differ in their last byte, or in white space only."""
    long = "long text  " * 480_000
    docs = spark.createDataFrame([(3, long + "a"), (2, long.replace("  ", "\n") + "a"), (1, long + "b")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in quotient.op11(docs).collect()) == [(1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False)]


def test_only_repeated_fingerprints_are_routed(spark):
    prints = spark.createDataFrame([(int(v),) for v in np.repeat(np.arange(1000) * 7919 << 40, np.arange(1000) % 5 + 1)], "fp long").repartition(7)
    got = {r["fp"]: r["n"] for r in quotient.repeated(prints, 3000).collect()}
    assert got == {int(i) * 7919 << 40: i % 5 + 1 for i in range(1000) if i % 5}


@pytest.mark.parametrize("bits", [6, 9, 20, 60])
def test_quotient_filter(bits):
    """A filter gives back what was put in: hot keys, zeros, full runs, and counters of several digits."""
    r = np.random.default_rng(bits)
    for trial in range(60):
        n = int(r.integers(1, min(400, 1 << bits)))
        key = np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64)) if trial % 3 else np.arange(min(n, 1 << bits), dtype=np.uint64)
        count = r.choice([1, 1, 2, 3, 4, 5, 60, 1000, 1 << 33], len(key)).astype(np.int64)
        back = quotient.decode(quotient.encode(key, count, bits), bits)
        assert back[0].tolist() == key.tolist() and back[1].tolist() == count.tolist()
        cut = r.integers(0, 3, len(key))
        merged = quotient.merge([quotient.encode(key[cut != k], count[cut != k], bits) for k in range(3)], bits)
        assert merged[0].tolist() == key.tolist() and merged[1].tolist() == (2 * count).tolist()
    for x in range(8):
        for n in range(1, 300):
            assert quotient.counts_of(quotient.counted(x, n, 3), 3) == [(x, n)]


# ---------------------------------------------------------------- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        out.append((nodes[first:i], nodes[i + 1 : first + 16]))
        i //= 16
    return out


def whole_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*(field(r[c]) for c in merkle.FIELDS))
    groups, out = defaultdict(list), []
    for r in rows:
        bad = {**r, "text": r["text"] and re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])} if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(bad), r["doc_id"]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree_of([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (_, _, own, h, doc_id) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = siblings(trees[s], i) + siblings(top, k)
            for a, b in path:
                h = digest(*a, h, *b)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], digest(*(x for a, b in path for x in a + b)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest(spark):
    docs = awkward(spark).repartition(5)
    got = sorted(map(tuple, merkle.op12(docs).collect()), key=repr)
    assert got == whole_manifest([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}
    assert merkle.op12(docs.where("false")).count() == 0
    assert [len(r["proof"]) for r in merkle.manifest(docs.limit(1).withColumn("leaf", F.lit("x")), "source", "doc_id").collect()] == [0]


def test_manifest_of_many_groups_and_ranges(spark):
    """More than 256 groups, of one leaf to some thousand, in 40 ranges; a text of 5 MB."""
    sizes = [1, 15, 16, 17, 255, 256, 257, 3000, *([1] * 300)]
    rows = [(f"s{g}", i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "source string, doc_id long").selectExpr("doc_id", "case when source = 's4' and doc_id = 7 then repeat('Long', 1250000) else concat('T', doc_id) end as text", "'en' as lang", "source", "doc_id as n_chars").repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, merkle.op12(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == whole_manifest([r.asDict() for r in df.collect()])


def test_subtrees_meet():
    """However leaves are cut into ranges, the nodes that are left without a parent are few and finish the same tree."""
    r = np.random.default_rng(3)
    for n in [1, 2, 16, 17, 256, 300, 4096, 5000]:
        leaves = [digest(str(i)) for i in range(n)]
        cuts = sorted({0, n, *r.integers(0, n, 6).tolist()})
        nodes = {}
        for a, b in zip(cuts, cuts[1:]):
            own = merkle.ragged(merkle.subtrees(leaves[a:b], a, b == n))
            assert len(own) <= 30 * 5 and not nodes.keys() & {(k, i) for k, i, _ in own}
            nodes.update({(k, i): h for k, i, h in own})
        level = 0
        while [k for k in nodes if k[0] > level] or sum(k[0] == level for k in nodes) > 1:
            for up in {i >> 4 for k, i in nodes if k == level}:
                nodes[level + 1, up] = digest(*(nodes.pop((level, i)) for i in range(up * 16, up * 16 + 16) if (level, i) in nodes))
            level += 1
        assert list(nodes.values()) == tree_of(leaves)[-1]


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_merkle_manifest"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


# ---------------------------------------------------------------- alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def alignments(rows):
    """Both tokenizers over whole texts, and offsets that both reach."""
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    letters, docs, count = alignment.byte_of_character(), [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        of_a, of_b = [bytes(letters[c] for c in t.id_to_token(i)) for i in a], [alignment.piece_bytes(sp.id_to_piece(i)) for i in b]
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            docs.append((doc_id, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        count.update((u[-1], v[-1]) for u, v in groups)
        docs.append((doc_id, a, b, groups))
    most = {}
    for (_, v), n in count.items():
        most[v] = max(most.get(v, 0), n)
    out = []
    for doc_id, a, b, groups in docs:
        links = [(u[-1], v[-1]) for u, v in groups]
        text = ";".join(f"{','.join(map(str, u))}|{','.join(map(str, v))}" for u, v in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), count


def test_alignment(spark, monkeypatch):
    """White space, signs, other scripts, control strings and marks in any order; slices of few documents."""
    monkeypatch.setattr(alignment, "SLICE", 3000)
    monkeypatch.setattr(alignment, "REMEMBERED", 300)
    signs = ["a", "B", "é", "ж", "中", "́", "ª", "×", "1", "²", "'s", "n't", "’", ".", ",", "\n", "\n ", "\n\n", " ", "  ", "\t", "\r\n", "\xa0", "　", "\x1c", "\x85", "-", "$$$", "<|endoftext|>", "🙂", "the", "Word", "​", "▁", "<s>", "</s>", "<0x0A>", "\0", "<unk>"]
    r = np.random.default_rng(1)
    texts = [None, "", " ", "  ", "▁", "a ", " a", "▁a b", *("".join(r.choice(signs, r.integers(1, 25))) for _ in range(2000)), "x" * 3000, "the same", "the same"]
    docs = spark.createDataFrame([(None if i % 50 == 3 else i // 2, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, slice int, pairs int")
    want, count = alignments([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, alignment.op13(spark, docs, A, B).collect()), key=repr) == want
    assert {(r["a"], r["b"]): r["n"] for r in alignment.aligned(docs, A, B)[1].collect()} == count
    assert alignment.op13(spark, docs.where("false"), A, B).count() == 0


def test_alignment_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, QUERIES["op13_token_alignment"](spark, SF).collect()), key=repr) == alignments([(r["doc_id"], r["text"]) for r in docs.collect()])[0]


def test_alignment_of_long_texts():
    """5 MB of words, and one word of 1 MB."""
    aligner = alignment.Aligner(A, B)
    text = "some words, again and again. " * 170_000
    docs, _ = aligner.aligned(pa.array([text, "ab" * 500_000]))
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert [docs[0].tolist(), docs[1].tolist()] == [[len(t.encode(" " + x, add_special_tokens=False).ids) for x in (text, "ab" * 500_000)], [len(sp.encode(x)) for x in (text, "ab" * 500_000)]]


def test_transducer():
    """Every cut of one string against every other: groups end where both do, and other bytes are found."""
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b"abab"]
    t = alignment.Transducer(pieces, pieces)
    r = np.random.default_rng(2)
    for _ in range(3000):
        a, b = r.integers(0, 6, r.integers(1, 6)).tolist(), r.integers(0, 6, r.integers(1, 6)).tolist()
        x, y = [np.cumsum([len(pieces[i]) for i in s]).tolist() for s in (a, b)]
        same = b"".join(pieces[i] for i in a) == b"".join(pieces[i] for i in b)
        assert t.groups(a, b) == ([(x.index(e) + 1, y.index(e) + 1) for e in sorted(set(x) & set(y))] if same else None)
    assert t.memo and t.groups([], []) == []
