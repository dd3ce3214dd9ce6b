"""The corpus pipeline, stage by stage against brute force over what the stage before has kept; long texts and empty tables in every stage."""

import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larkfeed.llm import langid, mixing, tokens, urls
from larkfeed.llm.queries import MIX_SQL

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Given documents with near copies around 0.8, benchmark passages, texts of no language, nulls and repeated rows; with its benchmark."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).limit(110).collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    r = np.random.default_rng(3)
    for k, (i, text, lang, source, n) in enumerate(rows[:25]):
        w = text.split()
        for j in r.integers(0, len(w), max(1, len(w) // 45)):  # a changed word takes up to five shingles
            w[j] = f"zz{j}"
        rows.append((1000 + k, " ".join(w), lang, source, n))
    rows += [(2000 + k, f"{rows[k][1][:300]} {items[k]['text']}", "en", "src9", 1) for k in range(6)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "src0", 0), (3002, "12 !! 34", "en", None, 1), (3003, "ϣϥϧ ϩϫϭ ϯⲀⲂ ⲄⲆⲈ " * 30, None, "src1", 9), rows[3], rows[3], (None, rows[4][1], "en", "src2", 5)]
    spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items).write.parquet(f"{path}/benchmark.parquet")
    return path


def key(row):
    return repr(tuple(row))


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]

    # language ID: each text alone through the model
    model = langid.train(docs)
    kept = []
    for row in rows:
        h, n, letter = model.entropies(pa.array([row[1]], pa.string()))
        best = int(h[0].argmin())
        if letter[0] and h[0][best] <= model.allowed(n)[0][best]:
            kept.append(row)
    docs = corpus_pipeline.materialize(STAGES["language ID"](spark, docs, corpus), "t")
    assert sorted(map(key, docs.collect())) == sorted(map(key, kept))
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert {3000, 3001, 3002, 3003} <= gone and len(gone) < 8

    # near copies: the first row of each group, by id (null last)
    rows = kept
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    sets = []
    for row in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(row[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    docs = corpus_pipeline.materialize(STAGES["MinHash near-dedup"](spark, docs, corpus), "t")
    got = [tuple(r) for r in docs.collect()]
    firsts = {}
    for g, row in zip(group, rows):
        firsts[g] = min(firsts.get(g, row), row, key=lambda r: (r[0] is None, r[0] or 0))
    assert Counter(r[0] for r in got) == Counter(r[0] for r in firsts.values()) and set(map(key, got)) <= set(map(key, rows))
    assert 10 < len(rows) - len(got) < 60

    # benchmark: windows of 13 words
    rows, words = got, lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s or ""))
    windows = set()
    for item in spark.read.parquet(f"{corpus}/benchmark.parquet").collect():
        w = words(item["text"])
        windows |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)} if len(w) >= 13 else {tuple(w)} if w else set()
    kept = []
    for row in rows:
        w = words(row[1])
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [1] * n
        if not (sum(hit) and 20 * sum(hit) >= len(w)):
            kept.append(row)
    docs = corpus_pipeline.materialize(STAGES["benchmark decontamination"](spark, docs, corpus), "t")
    assert sorted(map(key, docs.collect())) == sorted(map(key, kept)) and 0 < len(rows) - len(kept) < 30

    # mixing: the copies that its SQL takes
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = Counter()
    for doc_id, size, _, _, taken in con.execute(MIX_SQL).fetchall():
        want[doc_id] += taken // size if size else 0
    docs = corpus_pipeline.materialize(STAGES["source mixing"](spark, docs, corpus), "t")
    rows = [tuple(r) for r in docs.collect()]
    assert Counter(r[0] for r in rows if r[1]) == +want and docs.columns == COLUMNS

    # token ids: the library's plain call, in order
    t, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*t.encode(row[1], add_special_tokens=False).ids, 0]
        out.append((row[0], start, len(ids), ids))
        start += len(ids)
    got = STAGES["token ids"](spark, docs, corpus).select("doc_id", "start", "n_tokens", "ids").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == out


def test_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.count() == 0 and (name == "token ids" or out.columns == COLUMNS)


def test_long_texts(spark, corpus):
    """A text of 5 MB through mixing, decontamination and tokens, among short ones, with a passage of a benchmark item at its very end."""
    item = max((r["text"] for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()), key=len)
    long = "words of a very long text, " * 190_000
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, item, "en", "a", 1), (3, long + item, "en", "b", 1), (None, "short", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in STAGES["benchmark decontamination"](spark, docs, corpus).select("doc_id").collect()} == {1, 3, None}
    from larkfeed.llm import decontam

    hits = {r["doc_id"]: (r["n_words"], r["n_hit"] > 0) for r in decontam.op5(docs, spark.read.parquet(f"{corpus}/benchmark.parquet")).collect()}
    assert hits[1] == (6 * 190_000, False) and hits[3][1] and hits[2][1]
    sizes = {r["doc_id"]: r["size"] for r in mixing.op4(docs).collect()}
    assert sizes[1] == 6 * 190_000 and sizes[None] == 1
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.op1(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got[1] == len(t.encode(long, add_special_tokens=False).ids) + 1 and got[None] == 2
    far = spark.createDataFrame([(1, "http://EXAMPLE.org/es/" + "x" * 5_000_000), (2, "http://" + "a." * 300_000 + "com/fr/")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.op3(far.where("page_id = 1")).collect()} == {1: ("example.org/es/", "block")}
