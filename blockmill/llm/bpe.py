"""Byte-pair encoding and decoding with a public vocabulary, as its tokenizer file defines them.

A text is cut at the special tokens, normalised, split into words, and each word's bytes become a doubly linked list of symbols. A
priority queue holds the merge ranks of neighbouring symbols; the lowest rank (leftmost first) is merged, its neighbours' new pairs are
pushed, and entries whose symbols have changed meanwhile are skipped as stale. Decoding concatenates vocabulary strings.

Words repeat, so each Python worker keeps the ids of chunks between white space, in CACHE_BYTES, and of words, in half as much. Keys beyond
KEY characters are encoded each time and not kept, so a worker holds those bytes, and beside them one batch. One narrow pass over whole texts, no shuffle.

Defined cases: a null text is an empty one and has no ids; repeated rows are encoded alike; an empty table gives no rows; the outputs
replace input columns of the same names.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm.common import table, tokenizer_path

FILE = "word_bpe_49k.json"
CACHE_BYTES = 80 << 20
ENTRY_BYTES = 200  # of a dictionary's entry, its string and its tuple, without what they hold
KEY = 64
ROWS = 512  # of one output batch
#: Unicode white space
SPACE = "\t-\r \x85\xa0  -     　"
#: below this code point the regex module and the tokenizer's own engine agree on every character; texts that reach further use the latter
PLAIN = "԰"
_loaded: dict[str, Bpe] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in Latin-1, else the next from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Kept:
    """What has been computed lately: two generations of at most half the bytes each; the older one is dropped when the younger is full."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], most: int):
        self.make, self.half, self.size, self.young, self.old = make, most // 2, 0, {}, {}

    def add(self, key: str) -> tuple[int, ...]:
        if len(key) > KEY:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.size += ENTRY_BYTES + 4 * len(key) + 8 * len(found)
        if self.size >= self.half:
            self.size, self.young, self.old = 0, {}, self.young
        self.young[key] = found
        return found


class Bpe:
    def __init__(self, spec: dict, cache: int = CACHE_BYTES):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rank: dict[int, int] = {}  # by left id * 2**32 + right id
        self.made: list[int] = []  # by rank, the merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            self.rank[self.ids[a] << 32 | self.ids[b]] = rank
            self.made.append(self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        self.inner, self.final = [self.ids.get(c) for c in symbols], [self.ids.get(c + self.suffix) for c in symbols]
        self.value = {c: b for b, c in enumerate(symbols)}
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(json.dumps(spec))
        self.normalizer, self.pre = whole.normalizer, whole.pre_tokenizer
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.odd = re.compile("[\x1c-\x1f]")  # white space to str.split() alone
        self.kept_words, self.kept_chunks = Kept(lambda w: tuple(self.coded(w.encode())), cache // 2), Kept(self.chunk, cache)

    @classmethod
    def load(cls, name: str = FILE) -> Bpe:
        path = tokenizer_path(name)
        if path not in _loaded:
            with open(path, encoding="utf-8") as f:
                _loaded[path] = cls(json.load(f))
        return _loaded[path]

    def merge(self, alive: list[int]) -> list[int]:
        """The ids that are left of a list of symbols when no neighbouring pair has a rank."""
        n, get, made = len(alive), self.rank.get, self.made
        # of each place the rank of the pair that begins there, -1 for none. A queue's entry is rank * n + place; it is stale if another
        # rank, or none, stands at its place by now
        now = [get(a << 32 | b, -1) for a, b in zip(alive, alive[1:])]
        queue = [rank * n + k for k, rank in enumerate(now) if rank >= 0]
        if not queue:
            return alive
        now.append(-1)
        heapq.heapify(queue)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, k = divmod(pop(queue), n)
            if now[k] != rank:
                continue
            r = right[k]
            new = alive[k] = made[rank]
            alive[r] = now[r] = -1
            right[k] = after = right[r]
            if after >= 0:
                left[after] = k
                now[k] = found = get(new << 32 | alive[after], -1)
                if found >= 0:
                    push(queue, found * n + k)
            else:
                now[k] = -1
            before = left[k]
            if before >= 0:
                now[before] = found = get(alive[before] << 32 | new, -1)
                if found >= 0:
                    push(queue, found * n + before)
        return [i for i in alive if i >= 0]

    def coded(self, word: bytes) -> list[int]:
        """The ids of one word; a byte that the vocabulary lacks is left out."""
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.final[word[-1]]
        if None in symbols:
            symbols = [i for i in symbols if i is not None]
        return self.merge(symbols) if len(symbols) > 1 else symbols

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of normalised text without white space, word by word."""
        kept = self.kept_words
        if chunk.isalpha():  # one word
            ids = kept.young.get(chunk)
            return kept.add(chunk) if ids is None else ids
        out: list[int] = []
        for w in self.words.findall(chunk):
            ids = kept.young.get(w)
            out += kept.add(w) if ids is None else ids
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        kept = self.kept_chunks
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif not part:
                continue
            elif (part.isascii() or max(part) < PLAIN) and not self.odd.search(part):
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower() alone has a form for the end of a word
                # words never span white space, and white space is dropped
                for c in part.lower().split():
                    ids = kept.young.get(c)
                    out += kept.add(c) if ids is None else ids
            else:
                for w, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    out += self.coded(bytes(map(self.value.__getitem__, w)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: vocabulary strings, a space between them."""
        return " ".join(map(self.strings.__getitem__, ids))


def encode(docs: DataFrame, text_col: str = "text", name: str = FILE, decoded: bool = False) -> DataFrame:
    """docs with ids array<int> and n_tokens long; with decoded also the string that decoding the ids gives."""
    new = {"ids": "array<int>", "n_tokens": "bigint"} | ({"decoded": "string"} if decoded else {})
    rest = docs.drop(*new)
    # mapInArrow() takes plain column names alone
    at = rest.columns.index(text_col)
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(rest.schema)), *(f"{k} {v}" for k, v in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(name)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids = [bpe.encode(t) for t in part.column(at).to_pylist()]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
                cols = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat)), pa.array(n)]
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in ids]))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *new])

    return rest.toDF(*(f"c{k}" for k in range(len(rest.columns)))).mapInArrow(run, schema).toDF(*rest.columns, *new)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True))
