"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, chat, langid, lattice, mixing, quality_mil, quality_rules, sharding, simhash, spelling, toxicity, trie, warc
from seqloom.llm.common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("component_fp")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), modulus=3, held_out=1)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), modulus=4, held_out=2)


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])
    return coded.select("rec.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"), modulus=3, held_out=1)


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.write_shards(read_table(spark, sf_dir, "documents"), 40))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_controls(read_table(spark, sf_dir, "conversations"))
    return chat.digests(chat.event_log(turns), chat.hot_conversations(turns))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    ops = (
        op1_simhash, op2_toxicity, op3_quality, op4_rules, op5_mixing,
        op6_bpe, op7_langid, op8_lattice, op9_sharding, op10_warc,
        op11_chat, op12_trie, op13_spelling,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.oracle(), "op8_lattice": lattice.oracle(), "op10_warc": warc.oracle(), "op11_chat": chat.oracle(), "op12_trie": trie.oracle(), "op13_spelling": spelling.oracle()}
