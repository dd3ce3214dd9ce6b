"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from .tokens import op1

    return op1(spark, table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    from .repeats import op2

    return op2(table(spark, d, "documents"))


def _urls(spark: SparkSession, d: str) -> DataFrame:
    from .urls import op3

    return op3(table(spark, d, "pages"))


def _mixing(spark: SparkSession, d: str) -> DataFrame:
    from .mixing import op4

    return op4(table(spark, d, "documents"))


def _decontamination(spark: SparkSession, d: str) -> DataFrame:
    from .decontam import op5

    return op5(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    from .covertree import op6

    return op6(table(spark, d, "embeddings"))


def _chat(spark: SparkSession, d: str) -> DataFrame:
    from .chat import op7

    return op7(table(spark, d, "conversations"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    from .langid import op8

    return op8(table(spark, d, "documents"))


def _html(spark: SparkSession, d: str) -> DataFrame:
    from .htmltext import op9

    return op9(table(spark, d, "pages"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    from .minhash import op10

    return op10(table(spark, d, "documents"))


def _exact(spark: SparkSession, d: str) -> DataFrame:
    from .quotient import op11

    return op11(table(spark, d, "documents"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    from .merkle import op12

    return op12(table(spark, d, "documents"))


def _alignment(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from .alignment import op13

    return op13(spark, table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": _tokens,
    "op2_suffix_dedup": _repeats,
    "op3_url_filter": _urls,
    "op4_source_mixing": _mixing,
    "op5_decontamination": _decontamination,
    "op6_embedding_dedup": _embeddings,
    "op7_chat_format": _chat,
    "op8_language_id": _languages,
    "op9_html_extraction": _html,
    "op10_minhash_dedup": _near,
    "op11_exact_dedup": _exact,
    "op12_merkle_manifest": _manifest,
    "op13_token_alignment": _alignment,
    "pipeline": _pipeline,
}

URL_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
d AS (SELECT DISTINCT host, path FROM h),
m AS (SELECT host, path, rh || rp AS rule, verdict,
             row_number() OVER (PARTITION BY host, path ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, verdict DESC) AS k
      FROM d JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON m.host = h.host AND m.path = h.path AND k = 1
"""

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, sum(size) AS n FROM d GROUP BY source),
w AS (SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT source, n, weight, n * 2 AS cap,
             (sum(n) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(n * 2) OVER b, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY n / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, sum(CASE WHEN level * weight < cap THEN 1 ELSE 0 END) OVER (ORDER BY n / CAST(weight AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING) AS below FROM l),
t AS (SELECT source, n, weight, cap, below, max(CASE WHEN level * weight < cap AND below = 1 THEN level END) OVER () AS open FROM v),
g AS (SELECT source, CAST(n AS BIGINT) AS source_size, CASE WHEN below = 0 THEN CAST(cap AS DOUBLE) ELSE open * weight END AS target FROM t),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS x
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(floor(x) AS BIGINT) AS sure, x - floor(x) AS p, (draw + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END AS odds FROM c),
a AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS rest,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, sure + CASE WHEN p > 0 AND 2 * (rest - ahead) >= size AND rest > ahead THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM a
"""

EXACT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


def manifest_sql(levels: int = 6) -> str:
    """SQL of the manifest for groups of up to 16 ** levels rows, and as many groups. A group of one node keeps it at the next level."""
    field = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit: a number of the list is mixed in, -1 shifts
    bits = "flatten(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda k: [CAST(ascii(CAST(doc_id AS VARCHAR)[k + 1]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"
    ctes = [f"d0 AS (SELECT doc_id, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS x, '' AS siblings FROM documents)", "n0 AS (SELECT g, i, leaf AS h FROM d0)"]

    def tree(a: int) -> None:
        for k in range(a, a + levels):
            ctes.append(f"""s{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n,
 coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
 coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{k})""")
            ctes.append(f"n{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM s{k} GROUP BY g, i // 16)")
            ctes.append(f"d{k + 1} AS (SELECT d.* REPLACE (d.i // 16 AS i, d.siblings || l || r AS siblings, CASE WHEN n = 1 THEN x ELSE sha256(l || x || r) END AS x) FROM d{k} d JOIN s{k} s ON s.g IS NOT DISTINCT FROM d.g AND s.i = d.i)")

    tree(0)
    k = levels
    ctes.append(f"u AS (SELECT g AS name, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM n{k})")
    ctes.append(f"n{k + 1} AS (SELECT 0 AS g, i, subroot AS h FROM u)")
    ctes.append(f"d{k + 1} AS (SELECT doc_id, leaf, x, siblings, subroot, 0 AS g, u.i FROM d{k} d JOIN u ON u.name IS NOT DISTINCT FROM d.g)")
    tree(k + 1)
    k += 1 + levels
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(siblings) AS proof_sha256, x AS folded_root, x = h AS verified FROM d{k} CROSS JOIN n{k}"


ORACLES = {"op3_url_filter": URL_SQL, "op4_source_mixing": MIX_SQL, "op11_exact_dedup": EXACT_SQL, "op12_merkle_manifest": manifest_sql()}
