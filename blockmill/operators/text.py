"""The text column: projection, counters, and its tokens."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from blockmill.errors import Invalid

#: runs of letters, of digits, and of other signs, each with one blank before it; else white space. No look-around, so any engine runs it.
LEXER = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def select_text(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The column (as text) of the rows where it is not null; empty strings stay. keep: columns that stay beside it."""
    return df.where(F.col(column).isNotNull()).select(*keep, F.col(column).alias("text"))


def byte_length(text: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(text).cast("long")


def watch(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df and an observation that holds the counters once an action has run through it."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in counters.items())), seen


def byte_tokens(text: Column) -> Column:
    """One token for each UTF-8 byte, 0 to 255."""
    # read as Latin-1, the bytes are one character each
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.when(F.octet_length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(chars, F.ascii))


def lex(text: Column, pattern: str = LEXER) -> Column:
    """The words that a byte-pair encoder would merge within."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokenize(df: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], column: str = "text") -> DataFrame:
    """df with tokens array<int>. encoder makes, once in each Python worker, a function from texts to token lists.

    A null text has null tokens; no special tokens are added; an encoder's error fails the query.
    """
    rest = df.drop("tokens")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "tokens array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            texts = batch[column].to_pylist()
            found = iter(encode([t for t in texts if t is not None]))
            tokens = pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], names=[*batch.schema.names, "tokens"])

    return rest.mapInArrow(run, schema)


def file_encoder(path: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """An encoder for tokenize() of a tokenizer's JSON file (vocabulary, merges, rules), which every worker must be able to read."""

    def make() -> Callable[[list[str]], list[list[int]]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return make


class Vocabulary:
    """Token ids by their text, and special tokens."""

    def __init__(self, tokens: dict[str, int], special: dict[str, int] | None = None):
        self.tokens, self.special = dict(tokens), dict(special or {})

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Of a file: JSON of a tokenizer (model.vocab and added_tokens) or of a plain map, or lines of a token in base64 and its id."""
        with open(path, "rb") as f:
            data = f.read()
        if not data.lstrip().startswith(b"{"):
            pairs = [line.split() for line in data.splitlines() if line.strip()]
            return cls({base64.b64decode(t).decode("utf-8", "surrogateescape"): int(i) for t, i in pairs})
        made = json.loads(data)
        if "model" not in made:
            return cls(made)
        special = {t["content"]: t["id"] for t in made.get("added_tokens") or [] if t.get("special")}
        vocab = made["model"]["vocab"]
        tokens = vocab if isinstance(vocab, dict) else {t: k for k, (t, _) in enumerate(vocab)}
        return cls({t: i for t, i in tokens.items() if t not in special}, special)

    @property
    def max_token(self) -> int:
        ids = [*self.tokens.values(), *self.special.values()]
        if not ids:
            raise Invalid("an empty vocabulary")
        return max(ids)

    def __len__(self) -> int:
        return len(self.tokens) + len(self.special)

    def add_special(self, text: str) -> int:
        """The id of the special token: that it has already, or one more than the largest."""
        return self.special.setdefault(text, self.special.get(text, self.max_token + 1))
