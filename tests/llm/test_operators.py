"""Every operator against brute force on rows made to be awkward."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkfeed.llm import chat, covertree, decontam, htmltext, langid, minhash, mixing, repeats, tokens, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, ids int"


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdeé"), r.integers(1, 6)))
    base = " ".join(word() for _ in range(400))
    w = base.split()
    texts = [base, base, base.upper(), " ".join(w[:200] + ["CHANGED"] + w[201:]), " ".join(w[100:]), base + "\n" + base, None, "", "  ", "a", "a b c d", "A b  c\td", "x" * 3000, "x" * 60, "  lead  and\n  double", "1 2 3 !!", base[:60], "zz " + base[200:260] + " yy"]
    texts += [" ".join(word() for _ in range(int(n))) for n in r.integers(1, 200, 20)]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA)  # a repeated row


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_tokens(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    start, want = 0, []
    for i, x in sorted(rows_of(docs)):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.op1(spark, docs, path).collect())) == want
    assert tokens.op1(spark, docs.where("false"), path).count() == 0


def test_tokens_of_odd_texts(spark, monkeypatch):
    """White space, signs, other scripts and control strings in any order, also by an encoder that soon forgets."""
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    signs = ["a", "B", "é", "ж", "中", "́", "ª", "×", "1", "²", "'s", "'t", "n't", "’", ".", ",", "\n", "\n ", "\n\n", " ", "  ", "\t", "\r\n", "\xa0", "\u3000", "\x1c", "\x85", "-", "$$$", "<|endoftext|>", "🙂", "the", "Word", "\u200b"]
    r = np.random.default_rng(1)
    texts = ["a\n b c", "one\n  two\n three.\nFour", *("".join(r.choice(signs, r.integers(1, 25))) for _ in range(4000))]
    got = tokens.op1(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {x["doc_id"]: x["ids_crc32"] for x in got} == {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in enumerate(texts)}
    encoder = tokens.Encoder(path)
    for a in range(0, len(texts), 100):
        ids, n = encoder.encode(pa.array(texts[a : a + 100]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts[a : a + 100]]


def test_tokens_of_one_id(spark, tmp_path):
    """Very many rows without an id, some of them equal, are several parts in order of their texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(4000).selectExpr("cast(null as long) doc_id", "concat(repeat('same beginning ', 6), 'text ', if(id < 1500, 0, id)) text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(docs, str(tmp_path / "t"), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    assert [r["ids"] for r in got] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in sorted(r["text"] for r in docs.collect())]
    assert len({r["part"] for r in got}) > 2


def test_token_files(spark, tmp_path):
    """Encodings, row groups and indexes of the written files, and what a selective read touches."""
    import pyarrow.parquet as pq

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(3000).selectExpr("id as doc_id", "'en' as lang", "concat('a <|endoftext|> b ', repeat(concat('word', id % 97, ' '), 200)) as text")
    tokens.write_tokens(docs, str(tmp_path / "t"), path, metadata=("lang",))
    files = sorted(str(p) for p in (tmp_path / "t").glob("*.parquet"))
    t = Tokenizer.from_file(path)
    text = "a <|endoftext|> b " + "word5 " * 200
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 40 << 20
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    assert "RLE_DICTIONARY" in column.encodings
                else:
                    assert any(e.startswith("DELTA") for e in column.encodings), (column.path_in_schema, column.encodings)
    got = tokens.read_tokens(spark, str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan(got.select("doc_id", "start", "n_tokens")).split("ReadSchema")[1]
    few = got.where("doc_id = 5").select("doc_id", "ids")
    assert "EqualTo(doc_id,5)" in plan(few)
    assert few.first()["ids"] == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_repeats(docs, monkeypatch):
    seen, want = {}, []
    every = sorted(rows_of(docs))
    for i, x in every:
        b = x.encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, x in every:
        b = x.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(v for v, g in zip(b, gone) if not g)).hexdigest()))
    assert sorted(map(tuple, repeats.op2(docs).collect())) == sorted(want)
    for name, value in (("WIDE", 1), ("AT_ONCE", 70), ("COPIED", 500), ("BATCH", 300), ("LONG", 3)):  # routes dealt string by string; parts of pieces; routes of several batches
        monkeypatch.setattr(repeats, name, value)
        assert sorted(map(tuple, repeats.op2(docs).collect())) == sorted(want)
    assert repeats.op2(docs.where("false")).count() == 0


def test_repeats_in_parts(docs, monkeypatch):
    """No single shuffle has the pieces or texts of all documents where there are many, and parts change no row."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").repartition(4).localCheckpoint()
    store, jvm = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.jvm

    def shuffled() -> dict[int, int]:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    def run() -> tuple[list, int]:
        before = max(shuffled(), default=-1)
        repeats.repeated_ranges(docs.selectExpr("doc_id", "xxhash64(text) mark", "text"))
        most = max(v for k, v in shuffled().items() if k > before)
        return sorted(map(tuple, repeats.op2(docs).collect())), most

    want, whole = run()
    monkeypatch.setattr(repeats, "PART", 10_000)
    got, most = run()
    assert got == want and most < 0.7 * whole


def test_repeats_in_long_runs(spark):
    """5 MB of one byte and of a short period among short runs: every string that a smaller document has goes, at a bounded cost."""
    import resource

    texts = ["-" * n for n in (60, 49, 50, 2000)] + ["-" * 5_000_000, "ab" * 30_000, "xx" + "ab" * 50 + "yy", "ab" * 40_000 + "Z"]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.op2(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (60, 0, 0), 1: (49, 0, 0), 2: (50, 50, 1), 3: (2000, 2000, 1), 4: (5_000_000, 5_000_000, 1), 5: (60_000, 0, 0), 6: (104, 100, 1), 7: (80_001, 80_000, 1)}
    buf = np.frombuffer(b"-" * 3_000_000, np.uint8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    lists = pa.ListArray.from_arrays(pa.array([0, 1], pa.int32()), pa.StructArray.from_arrays([pa.array([0], pa.int32()), pa.array([len(buf) - 49], pa.int32()), pa.array([5], pa.int64()), pa.array([True])], ["start", "strings", "route", "wide"]))
    rows = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array([buf.tobytes().decode()]), lists], ["doc_id", "mark", "text", "pieces"])
    out = pa.Table.from_batches(list(repeats.fetch(iter([rows])))).to_pylist()
    assert len(out) == 15 and sum(p["strings"] for r in out for p in r["also"]) == len(buf) - 49
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB


def test_suffix_order():
    """The order and classes of suffixes against Python's sort: few letters, long equal beginnings, several lengths and groups."""
    r = np.random.default_rng(0)
    for trial in range(120):
        n = int(r.integers(90, 1500))
        buf = r.integers(97, 97 + int(r.integers(1, 4)), n).astype(np.uint8)
        if trial % 3 == 0:
            buf = np.tile(buf[:70], 20)[:n]
        at = r.integers(0, n - 80, int(r.integers(1, 400)))
        size = np.full(len(at), 50) if trial % 2 else r.integers(50, 80, len(at))
        group = np.zeros(len(at), np.uint64) if trial % 5 == 0 else r.integers(0, 4, len(at)).astype(np.uint64)
        order, kind = repeats.suffix_order(buf, at, size, group)
        keys = [(int(group[i]), int(size[i]), buf[at[i] : at[i] + size[i]].tobytes()) for i in order]
        assert sorted(order.tolist()) == list(range(len(at))) and keys == sorted(keys)
        assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], kind, kind[1:]))


def test_urls(spark):
    cases = ["http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x", "http://b.org", "http://b.org/", "http://x.com/fr/", "http://x.com/de/a#b", None, "nothing", "http://", "http://com/fr/x", "ftp://notcom/fr/"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.op3(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")).collect()}
    assert [got[i] for i in range(len(cases))] == [("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/fr/", "allow"), (None, "allow")]
    assert urls.op3(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mixing(spark, docs):
    got = mixing.op4(docs).collect()
    assert len(got) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["target"], []).append(r)
    for target, rs in by.items():
        assert target <= 2 * rs[0]["source_size"] and abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op4(docs).collect()))
    assert mixing.op4(docs.where("false")).count() == 0
    assert mixing.mix(docs).columns == docs.columns


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination(spark, docs, bound):
    own = [x for _, x in sorted(rows_of(docs))]
    items = [(0, " ".join(own[0].split()[50:90])), (1, "a"), (2, "A b c"), (3, None), (4, ""), (5, own[25]), (10, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    windows = {}
    for i, x in items:
        w = words(x)
        for k in range(len(w) - 12) if len(w) >= 13 else [0] if w else []:
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = []
    for i, x in rows_of(docs):
        w, met = words(x), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if q := windows.get(tuple(w[k : k + n])):
                    met |= q
                    hit[k : k + n] = [1] * n
        n = sum(hit)
        want.append((i, len(w), n, len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    assert sorted(map(tuple, decontam.contamination(docs, bench, bound=bound).collect())) == sorted(want)
    assert decontam.op5(docs, bench.where("false")).where("contaminated").count() == 0


def test_frequent_lines_by_joins(spark):
    """A line in many items and documents: both ways give the same rows."""
    line = " ".join(f"c{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"own{i} {line} end{i} " + " ".join(f"p{i}x{k}" for k in range(i % 40))) for i in range(300)] + [(900, line + " " + line), (901, "c1 c2 c3")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"item{i} {line} tail{i}") for i in range(60)] + [(70, "c1 c2"), (70, "c1 c2"), (None, "own7"), (71, line)], "item_id long, text string")
    one, other = (sorted(map(tuple, decontam.contamination(docs, bench, bound=b).collect())) for b in (10**6, 0))
    assert one == other and all(x[3] >= 61 for x in one[:300]) and one[7][3] == 63


def test_inclusion_by_weight(spark):
    """Documents of one source with unequal weights are taken as often as their weights say, near the target's words."""
    weights = {0: 0.4, 1: 1.0, 2: 2.6}
    docs = spark.createDataFrame([(i, "a b c d", "t", weights[i % 3]) for i in range(6000)] + [(i, "a b c d", "s", 1.0) for i in range(6000, 12000)], "doc_id long, text string, source string, w double")
    ids = []
    for seed in ("", "other"):
        got = mixing.mix(docs, weight="w", seed=seed).where("source = 't'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
        assert abs(sum(r["n"] for r in got) * 4 - 24000) <= 4
        for k, w in weights.items():
            assert abs(sum(r["n"] for r in got if r["doc_id"] % 3 == k) / 2000 - 0.75 * w) < 0.05
        ids.append({r["doc_id"] for r in got})
    assert ids[0] != ids[1]


def test_pareto_order(spark):
    """By hand: with unequal p the taken documents are those of the smallest odds ratios, not of the smallest draws."""
    w = lambda i: 1.0 if i % 2 else 0.25
    docs = spark.createDataFrame([(i, "a b", "s", w(i)) for i in range(400)] + [(i, "a b", "t", 1.0) for i in range(400, 500)] + [(i, "a b", "u", 1.0) for i in range(500, 3000)], "doc_id long, text string, source string, w double")
    d, targets, cut = mixing.plan_mix(docs, weight="w")
    rows = mixing.copied(d, cut, F.col("size")).where("source = 'u' or source = 's'").collect()
    for source in ("s", "u"):
        own = [r for r in rows if r["source"] == source]
        mass, target = sum(r["size"] * r["weight"] for r in own), own[0]["target"]
        left, order = target, []
        for r in own:
            x = min(2.0, target / mass * r["weight"])
            left -= int(x) * r["size"]
            u, p = (r["draw"] + 0.5) / (1 << 48), x - int(x)
            if p > 0:
                order.append((u / (1 - u) * (1 - p) / p, r["draw"], r["doc_id"], r["size"], int(x)))
        want = {r["doc_id"]: int(min(2.0, target / mass * r["weight"])) for r in own}
        for _, _, i, size, sure in sorted(order):
            if 2 * left >= size:
                want[i] = sure + 1
            left -= size
        assert {r["doc_id"]: r["copies"] for r in own} == want


def test_mixing_of_repeated_rows(spark):
    """One row repeated very often: just as many of it are taken as fit, by the query and by the mixed table."""
    docs = spark.createDataFrame([(7, "a b c", "s", k) for k in [0] * 500] + [(None, "x " * (k % 5), "s", 1) for k in range(200)] + [(i, "q r s t", "t", 2) for i in range(100, 700)], "doc_id long, text string, source string, copies int")
    got = mixing.op4(docs).groupBy("target", "source_size").agg(F.sum("taken").alias("n")).collect()
    assert all(abs(r["n"] - r["target"]) <= 3 for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    by = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.sized()).alias("n")).collect()}
    assert sorted(by.values()) == sorted(r["n"] for r in got)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 8))
    x = np.concatenate([x, x[:30] + 0.15 * r.normal(size=(30, 8)), np.repeat(x[:1], 40, 0) + 0.02 * r.normal(size=(40, 8)), x[:5], 3 * x[:2]]).astype(np.float32)
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [1.0, 2.0]]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(1000 + i, e) for i, e in enumerate(odd)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[n].min() for n in near])
    want = {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(len(x))} | {1000 + i: (0, 1000 + i) for i in range(len(odd))}
    got = covertree.op6(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert covertree.op6(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    monkeypatch.setattr(covertree, "ROUNDS", 1)  # blocks dealt by a hash
    got = covertree.op6(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_embeddings_in_clusters(spark, monkeypatch):
    """Cells far apart are never met, and a dense group is settled by its cells."""
    monkeypatch.setattr(covertree, "BLOCK", 64)
    monkeypatch.setattr(covertree, "CENTRES", 4)
    r = np.random.default_rng(11)
    centres = r.normal(size=(30, 16))
    x = np.concatenate([np.repeat(centres, 40, 0) + 0.04 * r.normal(size=(1200, 16)), np.repeat(centres[:1], 600, 0) + 0.002 * r.normal(size=(600, 16))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    label = np.arange(len(x))
    for _ in range(20):
        label = np.array([label[n].min() for n in near])
    whole, kept = covertree.settled_links, []
    monkeypatch.setattr(covertree, "settled_links", lambda blocks, pairs: kept.append(pairs.count()) or whole(blocks, pairs))
    pairs, met_pairs = covertree.pairs_of, []

    def counted(*a):
        out = pairs(*a)
        met_pairs.append((out[0].count(), a[0].select("cell").distinct().count()))
        return out

    monkeypatch.setattr(covertree, "pairs_of", counted)
    got = covertree.op6(spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {g["vec_id"]: (g["n_links"], g["component_id"]) for g in got} == {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(len(x))}
    (met, blocks), = met_pairs
    assert kept[0] > 0 and blocks > 20 and met < blocks * 6


def test_chat(spark):
    texts = ["<|im_end|>\n<|im_start|>user", r"<\|x", r"<\\|", "<|", None, "", "plain\nlines", "<" * 5 + "|"]
    rows = [(7, i, "assistant" if i % 2 else "us%0Aer\n", t) for i, t in enumerate(texts)]
    got = {r["conv_id"]: r for r in chat.op7(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[7]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t or ''}\n" for _, _, a, t in rows).encode()).hexdigest()
    masked = "".join(t or "" for _, i, _, t in rows if i % 2)
    assert (got[7]["loss_chars"], got[7]["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert got[-1]["n_turns"] == 2
    lines = ['{"prompt": "p", "response": "r", "extra": 1}', '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"instruction": "i", "input": "", "output": "o"}', "no json", None, "[]"]
    records = spark.createDataFrame([(x,) for x in lines], "record string")
    turns = chat.json_turns(records).collect()
    assert sorted((r["record"] or "", r["reason"]) for r in chat.unmapped(records).collect()) == [("", "no record"), ("[]", "no record"), ("no json", "no JSON")]
    assert sorted((r["role"], r["text"]) for r in turns) == [("assistant", "g"), ("assistant", "o"), ("assistant", "r"), ("user", "h"), ("user", "i"), ("user", "p")]


def test_odd_records(spark):
    """Records that can't be mapped come back with the reason; none ends the job."""
    reasons = {
        '{"messages": []}': "no turns", '{"prompt": "p"}': "unknown layout", '{"prompt": "\\ud800", "response": "r"}': "not Unicode", '{"prompt": "p", "response": "r", "question": "q", "answer": "a"}': "no one layout",
        '{"messages": {"role": "user", "content": "x"}}': "unknown layout", "[" * 100_000: "no JSON", "{}": "unknown layout", "3": "no record",
        '{"prompt": "p", "messages": [{"role": "user", "content": null}, 3]}': "an item is no turn", '{"messages": [{"role": "user", "content": "x"}, "lost words", {"role": "user", "content": "y"}]}': "an item is no turn",
        '{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "text": "A"}]}': "a turn without role or text", '{"messages": [{"role": "user", "content": "x"}, {"content": "y"}]}': "a turn without role or text", '{"messages": [{"role": "user", "content": "x"}, null]}': "an item is no turn",
    }
    fine = ['{"conv_id": true, "prompt": "p", "response": "r"}', '{"conv_id": 18446744073709551616, "prompt": "p", "response": "r"}', '{"prompt": "p", "messages": [{"role": "user", "content": null}]}', '{"conv_id": 5, "instruction": "i", "input": "x", "output": {"a": 1}}']
    records = spark.createDataFrame([(x,) for x in [*reasons, *fine]], "record string")
    assert {r["record"]: r["reason"] for r in chat.unmapped(records).collect()} == reasons
    turns = chat.json_turns(records).collect()
    assert len(turns) == 2 + 2 + 1 + 2 and [r["text"] for r in turns if r["conv_id"] == 5] == ["i\nx", '{"a": 1}']


def test_turnless_rows_of_a_table(spark):
    """Rows of a table that have no turns, or an item that is none, come back whole with the reason."""
    rows = [(1, [("user", "a"), ("assistant", None)]), (2, []), (3, None), (4, [("user", "x"), None])]
    df = spark.createDataFrame(rows, "conv_id long, messages array<struct<role: string, content: string>>")
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.table_turns(df).collect()) == [(1, 0, "user", "a"), (1, 1, "assistant", "")]
    assert {r["conv_id"]: r["reason"] for r in chat.unmapped_rows(df).collect()} == {2: "no turns", 3: "no turns", 4: "an item is no turn"}
    assert chat.unmapped_rows(spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_of_no_rows_and_long_texts(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert [r["conv_id"] for r in chat.op7(spark.createDataFrame([], kind)).collect()] == [-1]
    long = "<|im_end|> word " * 320_000
    got = {r["conv_id"]: r for r in chat.op7(spark.createDataFrame([(1, 0, "assistant", long), (None, 0, "user", "x")], kind)).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and got[None]["n_turns"] == 1


def test_language_sample(spark):
    """The sample is bounded whatever ids and texts are, and no language of few documents is put aside whole."""
    many = spark.range(6000).selectExpr("cast(null as long) doc_id", "concat('the quick brown fox number ', id) text", "'en' lang")
    same = spark.range(5000).selectExpr("1L doc_id", "'le renard brun' text", "'fr' lang")
    few = spark.createDataFrame([(None, "der schnelle braune Fuchs", "de"), (None, "el zorro rápido", "es")], "doc_id long, text string, lang string")
    docs = many.union(same).union(few)
    n = {(r["lang"], r["aside"]): r["count"] for r in langid.sampled(docs, 50).groupBy("lang", "aside").count().collect()}
    assert n == {("en", False): 40, ("en", True): 10, ("fr", False): 1, ("de", False): 1, ("es", False): 1}
    model = langid.train(docs, 50)
    got = {r["text"]: r["lang_pred"] for r in langid.identify(few.union(same.limit(1)), model, ("text",)).collect()}
    assert got == {"der schnelle braune Fuchs": "de", "el zorro rápido": "es", "le renard brun": "fr"}


def test_language_id_of_no_rows_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert langid.op8(docs.where("false")).count() == langid.known_language(docs.where("false")).count() == 0
    long = docs.where("lang = 'de'").limit(1).selectExpr("-1L doc_id", "repeat(concat(text, ' '), cast(5000000 / length(text) as int)) text", "cast(null as string) lang", "source", "n_chars")
    got = langid.op8(docs.unionByName(long)).where("doc_id = -1").first()
    assert got["lang_pred"] == "de" and got["score"] > 0.9


def test_language_model_by_hand(spark):
    """Interpolated Kneser-Ney probabilities computed from the definition, gram by gram."""
    texts = {"x": ["abab cab", "bca abc aab"], "y": ["ccb bcc", "cabcabb bbb"]}
    counts = {}
    for lang, own in texts.items():
        chars, first, _ = langid.characters(pa.array(own))
        counts[lang] = tuple(np.unique(langid.grams(chars, first), return_counts=True))
        counts[lang] = (counts[lang][0], counts[lang][1].astype(float))
    model = langid.Model(["x", "y"], counts)
    tables = {}
    alphabet = set()
    for lang in texts:
        four = {tuple((int(g) >> (16 * k)) & 0xFFFF for k in (3, 2, 1, 0)): int(n) for g, n in zip(*counts[lang])}
        tables[lang] = {4: four}
        for n in (3, 2, 1):
            tables[lang][n] = {}
            for g in tables[lang][n + 1]:
                tables[lang][n][g[1:]] = tables[lang][n].get(g[1:], 0) + 1
        alphabet |= {g[0] for g in tables[lang][1]}

    def probability(lang, gram):
        if not gram:
            return 1 / (len(alphabet) + 1)
        table = tables[lang][len(gram)]
        same = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        if not same:
            return probability(lang, gram[1:])
        one, two = (sum(n == k for n in table.values()) for k in (1, 2))
        d = min(0.95, one / (one + 2 * two)) if one else 0.5
        total = sum(same.values())
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * probability(lang, gram[1:])

    probe = ["abc cab bbb", "zab q", "c"]
    h, n, _ = model.entropies(pa.array(probe))
    for i, text in enumerate(probe):
        s = [32] * 3 + [32] + [ord(c) for c in text]
        want = [-sum(np.log(probability(lang, tuple(s[k - 3 : k + 1]))) for k in range(4, len(s))) for lang in ("x", "y")]
        base = [-np.log(probability(lang, (32, 32, 32, 32))) for lang in ("x", "y")]
        # a text may begin by a space of its own
        got = h[i] * n[i]
        assert np.allclose(got, want, atol=1e-4) or np.allclose(got, np.add(want, base), atol=1e-4)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op8(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "a")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in langid.identify(odd, langid.train(docs)).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert langid.identify(odd, None).where("lang_pred = 'und' and rejected").count() == 4


def test_chain_by_enumeration():
    """Viterbi against all labellings, and the fitted likelihood's gradient against differences of enumerated likelihoods."""
    from itertools import product

    r = np.random.default_rng(2)
    chain = htmltext.Chain({f"f{i}": i for i in range(6)}, r.normal(size=(6, 2)), r.normal(size=(2, 2)))
    for _ in range(60):
        rows = [{f"f{i}" for i in range(6) if r.random() < 0.4} for _ in range(int(r.integers(1, 8)))]
        sums = chain.sums(rows)
        value = lambda ys: sum(s for s, y in zip(sums, ys) if y) + sum(chain.pair[a][b] for a, b in zip(ys, ys[1:]))
        assert value(chain.decode(sums)) == max(map(value, product((0, 1), repeat=len(sums))))
    data = [([{"*", "a"}, {"*", "b"}, {"*", "a"}], [1, 0, 1]), ([{"*", "b"}, {"*"}], [0, 0]), ([{"*", "a"}, {"*", "b"}], [1, 1])]

    def likelihood(c):
        total = 0.0
        for rows, ys in data:
            score = lambda ls: sum(c.weights[c.names[k], y] for f, y in zip(rows, ls) for k in f) + sum(c.moves[a, b] for a, b in zip(ls, ls[1:]))  # noqa: B023, E731
            total += score(ys) - np.log(sum(np.exp(score(ls)) for ls in product((0, 1), repeat=len(rows))))
        return total / len(data) - 5e-4 * ((c.weights**2).sum() + (c.moves**2).sum())

    c = htmltext.fit(data, steps=3000, rate=0.02)
    best = likelihood(c)
    for where in (c.weights, c.moves):  # the fitted weights are a maximum of the enumerated likelihood
        for i in np.ndindex(where.shape):
            for step in (0.05, -0.05):
                where[i] += step
                assert likelihood(c) < best + 1e-4
                where[i] -= step


def test_html_of_any_depth():
    """Work in proportion to the page, whatever is nested or left open; formulas and fallbacks are text."""
    import time

    chain = htmltext.fit()
    deep = 100_000
    pages = ["<div>x" * deep, "<b>" * deep + "</i>" * deep, '<a "' * deep, "<h1>" * deep, "<div class='c%d'>" * 1 + "<p>" * deep, "<head>" * deep, "<svg>" * 3 + "</span>" * deep, "".join(f"<div class='n{i}'>y" for i in range(20_000)), "<i><div>" + "<b>" * deep + "</i>" * deep, "word " * 1_000_000]
    for html in pages:
        began = time.process_time()
        htmltext.main_text(html, chain)
        assert time.process_time() - began < 12, html[:40]
    page = "<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be. More of this text follows here.</p><p><svg><path d=''>An icon left open does not end the page at all.</p></article></body>"
    assert htmltext.main_text(page, chain) == "Title of it\n\nLet x=2 be. More of this text follows here.\n\nAn icon left open does not end the page at all."


LINE = "This is a long sentence of a page that goes on for a while, so that it reads like an article. "
MENU = "<div><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/b>News</a></li></ul></div>"
FOOT = "<footer>&copy; 2024 Site</footer>"


@pytest.mark.parametrize("html,want", [
    (f"<body><p>{LINE}</p><p>{LINE * 2}</p></body>", [LINE, LINE * 2]), (f"<body>{MENU}<div id=c1><p>{LINE}</p><p>{LINE * 2}</p></div>{FOOT}</body>", [LINE, LINE * 2]),
    (f"<body>{MENU}<table><tr><td>{LINE}</td><td>{LINE * 2}</td></tr></table>{FOOT}", [LINE, LINE * 2]), (f"<body><main><article><h1>Title of it</h1><p>{LINE}</p></article></main><div class=comments><p>{LINE}</p></div>{FOOT}", ["Title of it", LINE]),
    (f"<body><nav>{MENU}</nav><h1>Heading</h1><p>{LINE}</p><p>Short one.</p><p>{LINE}</p><form><p>Search</p></form>{FOOT}", ["Heading", LINE, "Short one.", LINE]), (f"<body>{MENU}<div><div class=x><div><p>{LINE}</p><p>{LINE}</p></div></div></div>{FOOT}", [LINE, LINE]),
])
def test_html_without_names(html, want):
    """Main text in the bare body, in elements that say nothing, in tables, with comments outside."""
    assert htmltext.main_text(html, htmltext.fit()) == "\n\n".join(x.strip() for x in want)


def test_html_of_given_pages(spark):
    """Each given page has one article, so its whole text is known without the chain; nearly all pages keep it when their article tags are gone."""
    chain, kept = htmltext.fit(), []
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.op9(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in pages:
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want = "\n\n".join(t for t, (around, _), _ in htmltext.leaf_blocks(f"<article>{article}</article>") if not around & {"name:ad", "name:comment", "name:comments"})
        assert got[r["page_id"]] == (want, len(want))
        kept += [htmltext.main_text(re.sub("</?article>", "", r["html"]), chain) == want, htmltext.main_text(r["html"].replace("<article>", "<div id=c1>").replace("</article>", "</div>"), chain) == want]
    assert np.mean(kept) > 0.97
    assert htmltext.op9(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


def test_html(spark):
    chain = htmltext.fit()
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; b</h1><p>One\n two<br>three<p>Four.</article><div class=comments><p>nice!</p></div><footer>&copy; x</footer>"
    assert htmltext.main_text(page, chain) == "A & b\n\nOne two three\n\nFour."
    held = htmltext.training_rows(100, 50_000)
    assert np.mean([x == y for f, l in held for x, y in zip(chain.decode(chain.sums(f)), l)]) > 0.97
    got = htmltext.op9(spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p>")], "page_id long, url string, html string")).collect()
    assert [r["n_chars"] for r in got] == [0, 0, 0]


def test_minhash(docs):
    def shingles(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(x) for i, x in rows_of(docs)}
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    got = minhash.op10(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), low[i]) for i, s in sets.items()}
    assert minhash.op10(docs.where("false")).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_pipeline(spark):
    import corpus_pipeline

    docs, ids = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append(docs.count())
    assert ids[0] >= ids[1] >= ids[2] > 0
    out = corpus_pipeline.token_output(spark, docs, SF)
    assert out.count() == ids[3] and out.where(F.element_at("ids", -1) != 0).count() == 0


CLASHING = "start n_tokens part part_start ids size source_size target taken node component component_id block n u v a b low band hash word words text_id key kept score lang_pred held_out n_words n_hit item_id position rest host path rule verdict rep unit dim links turn_id i j"


def awkward(df):
    """The same rows with a null in every column, a repeated row and columns whose names the operators use themselves."""
    rows = df.unionByName(df.limit(1)).unionByName(df.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)))
    return rows.select("*", *(F.lit("x").alias(c) for c in CLASHING.split() if c not in df.columns))


def test_stages_pass_clashing_names(spark):
    """Every stage of the corpus keeps columns whose names operators use themselves."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    wide = awkward(docs).select("*", *(F.lit("x").alias(c) for c in "rejected contaminated copies row id weight draw certain more s full edge last m n copy c0 c1 component_id_ key own".split() if c not in CLASHING.split()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        assert plain(out.select(docs.columns)) == plain(stage(spark, wide.select(docs.columns), SF))


def plain(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_nulls_and_clashing_names(spark, name):
    """Columns that an operator doesn't need change nothing; rows that are null throughout have a result."""
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    docs = docs.where("doc_id < 60")
    table, make = {
        "op1": (docs, lambda d: tokens.op1(spark, d, public_tokenizers.path("byte_bpe_50k.json"))),
        "op2": (docs, repeats.op2), "op3": (pages.limit(50), urls.op3), "op4": (docs, mixing.op4),
        "op5": (docs, lambda d: decontam.op5(d, awkward(spark.read.parquet(f"{SF}/benchmark.parquet")))),
        "op6": (spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 100"), covertree.op6),
        "op7": (spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 20"), chat.op7),
        "op8": (docs, langid.op8), "op9": (pages.limit(30), htmltext.op9), "op10": (docs, minhash.op10),
    }[name]
    wide = awkward(table)
    got = plain(make(wide))
    assert got == plain(make(wide.select(table.columns)))
    assert len(got) == (wide.select("conv_id").distinct().count() + 1 if name == "op7" else wide.count())


def shingle_set(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_groups(texts, percent):
    """The group of each text: the place of its first member."""
    sets = [shingle_set(x) for x in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return group


def test_near_dedup_stage(spark, docs):
    """The stage of the corpus links from 0.8 on, the query from 0.85 on."""
    import corpus_pipeline

    r = np.random.default_rng(8)
    texts = [x for _, x in sorted(rows_of(docs.dropDuplicates(["doc_id"])))]
    for changes in range(4, 14):
        w = [f"w{v}" for v in r.integers(0, 10**9, 250)]
        texts += [" ".join(w), " ".join("NEW" + x if i % 19 == 9 and i < 19 * changes else x for i, x in enumerate(w))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low, high = near_groups(texts, 80), near_groups(texts, 85)
    assert len(set(low)) < len(set(high)) < len(texts)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, df, SF).collect()) == sorted(set(low))
    assert {x["doc_id"]: x["component_id"] for x in minhash.op10(df).collect()} == dict(enumerate(high))


def test_near_dedup_of_repeated_and_null_ids(spark, docs):
    """One row of each group stays, also where ids repeat, are null or have several texts."""
    r = np.random.default_rng(9)
    words = lambda n: [f"w{v}" for v in r.integers(0, 10**9, n)]
    near = lambda w: " ".join("NEW" if i == 5 else x for i, x in enumerate(w))
    a, b, c, d, e = (words(120) for _ in range(5))
    rows = [
        (1, " ".join(a)), (1, " ".join(a)), (1, " ".join(a)), (None, " ".join(a)), (2, near(a)),  # repeated rows, a null copy, a near copy
        (None, " ".join(b)), (None, " ".join(b)), (None, near(b)), (None, "only one"),  # groups of null ids alone
        (7, " ".join(c)), (7, " ".join(d)), (8, near(d)), (5, " ".join(c)),  # an id with two texts, one of them a copy of a smaller id
        (9, " ".join(e)), (None, near(e)), (10, None), (10, None), (None, ""),
    ]
    df = spark.createDataFrame([(i, t, k % 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    group = near_groups([t for _, t in rows], 80)
    kept = minhash.keep_one(df).collect()
    place = {t: g for (_, t), g in reversed(list(zip(rows, group, strict=True))) if shingle_set(t)}
    assert sorted(place[x["text"]] for x in kept if x["text"]) == sorted(set(place.values()))
    assert sum(not x["text"] for x in kept) == 3
    least = {g: min((i is None, i or 0) for (i, t), h in zip(rows, group, strict=True) if g == h) for g in set(group)}
    assert all((x["doc_id"] is None, x["doc_id"] or 0) == least[place[x["text"]]] for x in kept if x["text"])
    assert [x["k"] for x in kept if x["doc_id"] == 1] == [0]
    want = sorted(((i, len(shingle_set(t)), None if least[g][0] else least[g][1]) for (i, t), g in zip(rows, group, strict=True) if shingle_set(t)), key=repr)
    got = minhash.op10(df).where("n_shingles > 0").collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=repr) == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_minhash_rounds(spark, monkeypatch):
    """The round over all likely pairs is always run: links that no star and no best partner shows are found there, in
    tiles of any size."""
    monkeypatch.setattr(minhash, "TILE", 7)
    monkeypatch.setattr(minhash, "propose", lambda percent: lambda t: t.select(["doc", "component"]).rename_columns(["a", "b"]).slice(0, 0))
    r = np.random.default_rng(12)
    base = [f"w{v}" for v in r.integers(0, 10**9, 200)]
    texts = []
    for _ in range(60):  # a cloud around the limit: some pairs link, most don't
        at = set(r.choice(200, int(r.integers(2, 6)), replace=False).tolist())
        texts.append(" ".join(f"n{r.integers(10**9)}" if k in at else x for k, x in enumerate(base)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_groups(texts, 85)
    assert 1 < len(set(want)) < 60
    assert [x["component_id"] for x in minhash.near_duplicates(df).orderBy("doc_id").collect()] == want


def test_minhash_of_texts_that_fool_sums_of_powers(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, " ".join([word[:32], "x y z w"])), (4, " ".join([other[:32], "x y z w"]))], "doc_id long, text string")
    assert [x["component_id"] for x in minhash.op10(df).orderBy("doc_id").collect()] == [1, 2, 3, 4]


def test_minhash_of_sets_with_one_digest(spark):
    """Different sets of which one digest is equal keep their texts and names: nothing is joined but what is near."""
    r = np.random.default_rng(8)
    base = [f"w{v}" for v in r.integers(0, 10**9, 120)]
    texts = [" ".join(base), " ".join(base[:60] + ["X"] + base[61:]), *(" ".join(f"w{v}" for v in r.integers(0, 10**9, 80)) for _ in range(12)), " ".join(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    slim, rows = minhash.signed_docs(df, 85)
    got = minhash.joined(slim, rows.withColumn("k1", F.lit(5).cast("long")), 85).orderBy("doc_id").collect()
    assert [x["first"]["doc_id"] for x in got] == near_groups(texts, 85)


def test_minhash_of_long_and_no_texts(spark):
    """5 MB of different words against the same with a few changed, and empty tables."""
    words = [f"w{i}" for i in range(600_000)]
    near = [*words]
    near[100::5000] = ["changed"] * len(near[100::5000])
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "other words of a text that has five"), (None, " ".join(words))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.op10(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, None: 1}
    assert minhash.op10(df.where("false")).count() == minhash.keep_one(df.where("false")).count() == 0


def test_minhash_of_a_large_star(spark, monkeypatch):
    """Many near copies of one text, more than a part of a star, and one document that links to another's near copy only."""
    monkeypatch.setattr(minhash, "PARTNERS", 20)
    r = np.random.default_rng(4)
    base = [f"w{v}" for v in r.integers(0, 10**9, 150)]
    texts = [" ".join(base)] + [" ".join("N%d" % i if k == j else x for k, x in enumerate(base)) for i, j in enumerate(r.integers(0, 150, 120))]
    far = texts[1].split()
    texts.append(" ".join("FAR" if k in (40, 80) else x for k, x in enumerate(far)))
    want = near_groups(texts, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x["component_id"] for x in minhash.op10(df).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_recall(percent):
    """Of pairs at and just above the limit nearly all share a band and pass the bar of signatures."""
    r, each, size = np.random.default_rng(1), minhash.band_rows(percent), 400
    missed = 0
    for k in range(2000):
        both = -(-percent * 2 * size // (100 + percent)) + k % 8  # |A & B| of two sets of `size`, from the limit on
        x = r.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(x[:size]), np.sort(x[size - both :])
        s = (minhash.signatures(np.concatenate([a, b]), np.array([0, size, 2 * size])) >> np.uint64(40)).astype(np.uint8)
        same = s[0] == s[1]
        bands = same[: minhash.BINS // each * each].reshape(-1, each).all(1).any()
        missed += not bands or same.sum() < minhash.likely(percent)
    assert missed <= 2


def test_range_hashes():
    buf = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    start = np.repeat(np.arange(16), 100)
    end = start + np.tile(np.arange(100), 16)
    h = [int(x) for x in minhash.range_hashes(buf, start, end)]
    same = {}
    for i, j, v in zip(start, end, h, strict=True):
        same.setdefault(bytes(buf[i:j]), set()).add(v)
    assert all(len(x) == 1 for x in same.values()) and len(set(h)) == len(same)
