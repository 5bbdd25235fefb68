"""Token ids as flat binary files: unsigned integers one after another, and 64-bit offsets of the documents in them, to be memory-mapped.

The documents are range-partitioned by doc_id and sorted, one file pair to a partition, and each task encodes and writes its own as it reads, a
batch at a time. `<name>.bin` holds the ids of its documents and nothing else, little-endian, of 2 bytes where the vocabulary fits them and
of 4 otherwise. `<name>.idx` holds, after a header of six 64-bit integers (MAGIC, bytes of an id, documents, the ids of all files
before, ids, an end id or -1), documents + 1 offsets counted from the start of the whole set, the documents' ids, and for each a byte that is 1
where its id is null. So a document's place is found from the two files alone.

Offsets need the ids of all files before. Tasks write files with offsets of their own first and give a row of counts each; the prefix sums
over those rows, one a file, are the bases, and a second, small job rewrites the index files with them.

Committing: file names are made for each attempt, and the manifest (Parquet, committed by Spark) lists those of the attempts that
counted; files that it does not list are leftovers of lost tasks, and sweep() deletes them. Paths may be local to a shared mount or any that
pyarrow's file systems open; only local ones are memory-mapped, others are read in whole.

Encoding is the tokenizers library's, a word at a time. Where a text stays below U+0530 it is normalised and cut into words here, by the
rules of the file, as in bpe; a worker keeps the ids of words and of what stands between white space, about KEEP of them of at most KEEP_CHARS
characters each, the older half dropped when the younger is full, and the library encodes new words many at once, each ending in a token
that ends a word. Other texts go through the library whole.

Defined cases: a null text is an empty one and has its end id alone; null ids come first; rows of one doc_id are ordered by a hash of their
text, and equal rows are all kept; an empty table gives no files and no rows; columns other than doc_id and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockmill.llm.bpe import PLAIN, SPACE
from blockmill.llm.common import batches_of, new_path, release, slices, staged, table, tokenizer_path

FILE = "word_bpe_49k.json"
END = 1
FILE_BYTES = 32 << 20  # of text, whose ids become one file, on average
BATCH = 512  # documents encoded or read at a time
KEEP, KEEP_CHARS = 1_000_000, 32
WORDS = 1000  # encoded in one call
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
MARKS = ".,;:!?"  # other signs that one word may end with
ODD = re.compile("[\x1c-\x1f]")  # white space to str.split() alone
MAGIC = 0x424C4F434B4D494C
HEADER = 6
MANIFEST = "part int, name string, n_docs long, n_tokens long"
_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """Packed ids of texts by a tokenizer file."""

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.whole.no_padding()
        self.whole.no_truncation()
        self.width = 2 if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        vocab = self.whole.get_vocab(with_added_tokens=True)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        # a file of other rules goes through the library whole
        self.known = bool(suffix) and name_of_rules(spec)
        self.half, self.young, self.old = keep // 2, {}, {}

    @classmethod
    def load(cls, name: str = FILE) -> Encoder:
        path = tokenizer_path(name)
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), WORDS):
            part = words[k : k + WORDS]
            ids = np.array(self.whole.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                data, w = ids.tobytes(), self.width
                at = (ends * w).tolist()
                out += [data[a:b] for a, b in zip([0, *at], at)]
            else:
                out += self.packed(part)
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Puts the ids of chunks into the younger generation, which lacks them; gives those that are too long to be kept."""
        long_: dict[str, bytes] = {}
        words: set[str] = set()
        cut: list[tuple[str, list[str]]] = []
        young, old = self.young, self.old
        for c in chunks:
            if (ids := old.get(c)) is not None:
                young[c] = ids
            elif c.isalpha():
                words.add(c)
            else:
                own = [c[:-1], c[-1]] if c[-1] in MARKS and c[:-1].isalpha() else WORD.findall(c)
                cut.append((c, own))
                words.update(own)
        todo = []
        for w in words:
            if w not in young:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                else:
                    todo.append(w)
        for w, ids in zip(todo, self._new_words(todo), strict=True):
            (young if len(w) <= KEEP_CHARS else long_)[w] = ids
        for c, own in cut:
            (young if len(c) <= KEEP_CHARS else long_)[c] = b"".join([young[w] if w in young else long_[w] for w in own])
        return long_

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, one after another."""
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str], list[bytes | None]]] = []
        whole: list[int] = []
        missing: set[str] = set()
        get = self.young.get
        for k, t in enumerate(texts):
            if not t:
                continue
            if not self.known or not (t.isascii() or max(t) < PLAIN) or ODD.search(t) or self.special.search(t):
                whole.append(k)
                continue
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
            words = t.lower().split()
            ids = list(map(get, words))
            if None in ids:
                missing.update([w for w, i in zip(words, ids) if i is None])
                cut.append((k, words, ids))
            else:
                out[k] = b"".join(ids)
        long_ = self._learn(missing)
        for k, words, ids in cut:
            out[k] = b"".join([i if i is not None else get(w) or long_.get(w, b"") for w, i in zip(words, ids)])
        for k in whole:
            out[k] = self.packed([texts[k]])[0]
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        return out


def name_of_rules(spec: dict) -> bool:
    """Whether a tokenizer file normalises and cuts as encode() does: composed, in small letters, runs of letters, single digits, runs of other signs."""
    return "lowercase" in json.dumps(spec["normalizer"]).lower() and "NFC" in json.dumps(spec["normalizer"]) and "[\\\\p{L}]+|[\\\\p{N}]" in json.dumps(spec["pre_tokenizer"])


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _index(width: int, base: int, lengths: np.ndarray, ids: np.ndarray, null: np.ndarray, end: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum(lengths)]) + base
    head = np.array([MAGIC, width, len(lengths), base, lengths.sum(), end], "<i8")
    return head.tobytes() + offsets.astype("<i8").tobytes() + ids.astype("<i8").tobytes() + null.astype("u1").tobytes()


class TokenFile:
    """A file pair, mapped: documents by their place in it."""

    def __init__(self, path: str, name: str):
        self.ids = self._open(f"{path}/{name}.idx")
        head = np.frombuffer(self.ids, "<i8", HEADER)
        if head[0] != MAGIC:
            raise ValueError(f"{name}.idx is no index of token ids")
        self.width, self.n_docs, self.base, self.n_tokens = (int(x) for x in head[1:5])
        self.end = int(head[5])
        at = 8 * HEADER
        self.offsets = np.frombuffer(self.ids, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.doc_ids = np.frombuffer(self.ids, "<i8", self.n_docs, at)
        self.null = np.frombuffer(self.ids, "u1", self.n_docs, at + 8 * self.n_docs)
        self.tokens = np.frombuffer(self._open(f"{path}/{name}.bin"), f"<u{self.width}") if self.n_tokens else np.empty(0, f"<u{self.width}")

    @staticmethod
    def _open(path: str) -> pa.Buffer:
        system, at = _system(path)
        if isinstance(system, pafs.LocalFileSystem):
            with pa.memory_map(at) as f:
                return f.read_buffer()
        with system.open_input_file(at) as f:
            return f.read_buffer()

    def __getitem__(self, k: int) -> np.ndarray:
        a, b = self.offsets[k] - self.base, self.offsets[k + 1] - self.base
        return self.tokens[a:b]


def write(docs: DataFrame, path: str | None = None, text_col: str = "text", name: str = FILE, end: int | None = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes and writes docs (doc_id, text); gives the manifest: path, part, name, n_docs, n_tokens, base (the ids of all files before)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()[0]
    files = max(1, -(-size // file_bytes))
    # equal rows are spread by the place that they were read at
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = slim.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("at").asc()]
    ranged = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(name)
        tail = b"" if end is None else np.array([end], encoder.kind).tobytes()
        part = TaskContext.get().partitionId()
        own = f"tokens-{part:06d}-{uuid.uuid4().hex}"
        system, at = _system(path)
        lengths, ids, nulls, out = [], [], [], None
        for batch in slices(batches, BATCH):
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(at, recursive=True)
                out = system.open_output_stream(f"{at}/{own}.bin")
            coded = [c + tail for c in encoder.encode(batch["text"].to_pylist())]
            out.write(b"".join(coded))
            lengths.append(np.fromiter(map(len, coded), np.int64, len(coded)) // encoder.width)
            nulls.append(batch["doc_id"].is_null().to_numpy(zero_copy_only=False))
            ids.append(batch["doc_id"].fill_null(0).to_numpy())
        if out is None:
            return
        out.close()
        every = np.concatenate(lengths)
        with system.open_output_stream(f"{at}/{own}.part") as f:
            f.write(_index(encoder.width, 0, every, np.concatenate(ids), np.concatenate(nulls), -1 if end is None else end))
        yield pa.RecordBatch.from_pylist([{"part": part, "name": own, "n_docs": len(every), "n_tokens": int(every.sum())}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    with batches_of(spark, BATCH):
        written = staged(ranged.mapInArrow(run, MANIFEST), "token-files", BATCH)
    base = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")  # a row a file
    based = written.withColumn("base", base).withColumn("file", (F.row_number().over(Window.orderBy("part")) - 1).cast("int"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _system(path)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{at}/{r['name']}.part") as f:
                    data = f.read()
                head = np.frombuffer(data, "<i8", HEADER).copy()
                head[3] = r["base"]
                n = r["n_docs"]
                offsets = np.frombuffer(data, "<i8", n + 1, 8 * HEADER) + r["base"]
                # a rerun writes the same bytes again; the name appears when they are all there
                draft = f"{at}/{r['name']}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as f:
                    f.write(head.tobytes() + offsets.tobytes() + data[8 * (HEADER + n + 1) :])
                system.move(draft, f"{at}/{r['name']}.idx")
            yield batch

    done = staged(based.repartitionById(files, F.col("file")).mapInArrow(finish, f"{MANIFEST}, base long, file int"), "token-manifest")
    out = done.select(F.lit(path).alias("path"), "part", "name", "n_docs", "n_tokens", "base", "file")
    release(written)
    out.files = files
    return out


def sweep(manifest: DataFrame) -> int:
    """Deletes what the manifest's folder holds beside the files that it lists; returns how many files went. The listing is on the driver, a name a file."""
    rows = manifest.select("path", "name").collect()
    if not rows:
        return 0
    kept = {f"{r.name}.{end}" for r in rows for end in ("bin", "idx")}
    system, at = _system(rows[0].path)
    found = [f.path for f in system.get_file_info(pafs.FileSelector(at)) if os.path.basename(f.path) not in kept]
    for f in found:
        system.delete_file(f)
    return len(found)


def read(manifest: DataFrame) -> DataFrame:
    """The documents of the files, in their order within each: doc_id, start (ids of all documents before), n_tokens, ids (32-bit little-endian binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = TokenFile(r["path"], r["name"])
                for a in range(0, f.n_docs, BATCH):
                    b = min(a + BATCH, f.n_docs)
                    start = f.offsets[a : b + 1]
                    ids = [f[k].astype("<u4").tobytes() for k in range(a, b)]
                    yield pa.record_batch([pa.array(f.doc_ids[a:b], mask=f.null[a:b].astype(bool)), pa.array(start[:-1]), pa.array(np.diff(start)), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    files = getattr(manifest, "files", None) or max(1, manifest.count())
    return manifest.repartitionById(files, F.col("file")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(write(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
