"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. The last returns a row for
each mixed document in ascending doc_id order of writing: doc_id, start, n_tokens and its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkfeed.llm.common import materialize, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkfeed.llm.langid import known_language

    return known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkfeed.llm.minhash import keep_one

    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkfeed.llm.decontam import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from larkfeed.llm.mixing import mix

    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from larkfeed.llm.tokens import read_tokens, write_tokens

    path = scratch(spark, "corpus")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), metadata=("lang", "source"))
    return read_tokens(spark, path).select("doc_id", "lang", "source", "start", "n_tokens", "ids")


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("source mixing", source_mixing), ("token ids", token_output)]
#: Language models, MinHash and tokenizers have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
