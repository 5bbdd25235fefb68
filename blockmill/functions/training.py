"""Elementwise maths, losses and schedules of training, over array columns and plain numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inputs(tokens: Column) -> Column:
    """All tokens but the last."""
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def targets(tokens: Column) -> Column:
    """All tokens but the first."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))


def next_token_pairs(blocks: DataFrame, *keys: str) -> DataFrame:
    """One row per position of tokens: keys, pos, input, target."""
    pairs = F.posexplode(F.arrays_zip(inputs(F.col("tokens")).alias("input"), targets(F.col("tokens")).alias("target")))
    return blocks.select(*keys, pairs.alias("pos", "pair")).select(*keys, "pos", "pair.input", "pair.target")


def flatten(batches: DataFrame, *keys: str) -> DataFrame:
    """One row per token: keys, pos (its place in tokens), token."""
    return batches.select(*keys, F.posexplode("tokens").alias("pos", "token"))


def softcap(x: Column, cap: float = 15.0) -> Column:
    return F.transform(x, lambda v: F.tanh(v / cap) * cap)


def relu_squared(x: Column) -> Column:
    return F.transform(x, lambda v: F.pow(F.greatest(v, F.lit(0.0)), F.lit(2)))


def clip(x: Column, limit: float) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target], target from 0; the largest logit is taken out first."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    return F.log(total) + top - F.element_at(logits, (target + 1).cast("int"))


def embed(tokens: DataFrame, vectors: DataFrame, token_col: str = "token") -> DataFrame:
    """Rows of tokens with the vector of their token. vectors: token, vector."""
    return tokens.join(vectors, token_col)


def learning_rate(step: int, rate: float, steps: int, warmup: int = 300, start: float = 1e-10, least: float = 0.0) -> float:
    """A linear warm-up from start to 1, times a cosine from rate to least over steps."""
    up = min(1.0, start + (1 - start) * step / warmup) if warmup else 1.0
    t = min(step, steps) / steps if steps else 1.0
    return up * (least + 0.5 * (rate - least) * (1 + math.cos(math.pi * t)))


def learning_rate_column(step: Column, rate: float, steps: int, warmup: int = 300, start: float = 1e-10) -> Column:
    up = F.least(F.lit(1.0), F.lit(start) + (1 - start) * step / warmup)
    return up * 0.5 * rate * (1 + F.cos(F.pi() * F.least(step, F.lit(steps)) / steps))


def human_size(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.1f} {unit}"
        n /= 1024
    return ""


@dataclass(frozen=True)
class GptConfig:
    init_seq_len: int = 1024
    max_seq_factor: int = 10
    vocab_size: int = 50304
    n_layer: int = 12
    n_head: int = 6
    n_kv_head: int = 6
    n_embed: int = 768
    softcap: float = 15.0
    expansion: int = 4

    @property
    def head_dim(self) -> int:
        return self.n_embed // self.n_head

    @property
    def hidden_size(self) -> int:
        return self.n_embed * self.expansion

    @property
    def max_seq_len(self) -> int:
        return self.init_seq_len * self.max_seq_factor

    def flops_per_token(self, params: int, embedding_params: int) -> int:
        return 6 * (params - embedding_params) + 12 * self.n_layer * self.n_head * self.head_dim * self.init_seq_len
