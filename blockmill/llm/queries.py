"""The driver's queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockmill.llm import bpe, chat, embeddings, lloyd, media, merkle, minhash, mixing, quality, sharding, tokenfiles, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chat": chat.op2_chat,
    "op3_sharding": sharding.op3_sharding,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe": bpe.op5_bpe,
    "op6_media": media.op6_media,
    "op7_warc": warc.op7_warc,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_quality": quality.op9_quality,
    "op10_minhash": minhash.op10_minhash,
    "op11_merkle": merkle.op11_merkle,
    "op12_clusters": lloyd.op12_clusters,
    "op13_tokens": tokenfiles.op13_tokens,
}
SQL: dict[str, str] = {"op4_mixing": mixing.SQL, "op11_merkle": merkle.SQL}
