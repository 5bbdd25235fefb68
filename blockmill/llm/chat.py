"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: TURN role TEXT text END for every turn, in order. The three markers are special tokens of their own, so
no token spans a marker and its neighbour. Control strings inside roles and texts (the markers, and those of common chat formats) get a
backslash after their first character, or one more where they have some; removing one restores the text, and no other text changes.

The rendered conversation is encoded once, with offsets. Both the turns' text spans and the token spans are sorted, so the tokens of an
assistant turn are a range found by binary search; they make up the loss mask. A character of several byte tokens is in all their spans,
so the masked text is the union of the spans of each masked run.

Rows meet by conversation in one shuffle; a conversation is the unit that is rendered, so its text must fit in a task. Encodings, which take
some 160 times the text, are made of SEGMENT characters at a time: short conversations together, a long one in runs of whole turns. Since no
token spans a marker, its tokens and offsets are those of encoding it in one piece.

Defined cases: a null text or role is an empty one; a null conv_id is a conversation of its own; rows are ordered by turn (null first),
then role and text, and repeated rows are all kept; an empty table gives no rows; columns other than conv_id, turn, role and text are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm.common import table, tokenizer_path

FILE = "byte_bpe_50k.json"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: fixed control strings of common chat formats, escaped as well so that a text cannot pass for a marker of theirs
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>"]
LEARNT = "assistant"
ROWS = 256  # conversations held at a time
SEGMENT = 1 << 18  # characters encoded at a time, or one turn

_rest = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
# every control string begins with < or [ ; what follows holds neither but for the second < of <<, which begins no control string there
_escape = re.compile(rf"([<\[])(\\*)(?=(?:{_rest}))")
_unescape = re.compile(rf"([<\[])\\(\\*)(?=(?:{_rest}))")
_turns = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)
_tokenizers: dict = {}


def escape(text: str) -> str:
    return _escape.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        role, body = role or "", escape(text or "")
        head = f"{TURN}{escape(role)}{TEXT}"
        at += len(head)
        if role == LEARNT:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _turns.findall(formatted)]


def _tokenizer(name: str):
    if name not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(tokenizer_path(name))
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
        t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, TEXT, END)])
        _tokenizers[name] = t
    return _tokenizers[name]


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token whose span meets one of the sorted spans. offsets: tokens x 2, sorted."""
    out = np.zeros(len(offsets), np.int8)
    if len(offsets):
        begin, end = np.array(spans, np.int64).reshape(-1, 2).T
        first = np.searchsorted(offsets[:, 1], begin, "right")
        last = np.searchsorted(offsets[:, 0], end, "left")
        for a, b in zip(first, last, strict=True):
            out[a:b] = 1
    return out


def masked_spans(offsets: np.ndarray, m: np.ndarray) -> list[tuple[int, int]]:
    """The characters under each run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], m, [0]])))
    return [(int(offsets[a:b, 0].min()), int(offsets[a:b, 1].max())) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def segments(text: str) -> Iterator[tuple[int, str]]:
    """A rendered text in runs of whole turns of SEGMENT characters at most (or one turn), each with its place."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SEGMENT:
            last = text.rfind(END, at, at + SEGMENT)
            last = last if last >= 0 else text.find(END, at)
            end = last + len(END)
        yield at, text[at:end]
        at = end


def encode(tokenizer, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and offsets (tokens x 2) of each text."""
    ids: list[list[np.ndarray]] = [[] for _ in texts]
    offsets: list[list[np.ndarray]] = [[] for _ in texts]

    def flush(jobs: list[tuple[int, int, str]]) -> None:
        for (k, at, _), e in zip(jobs, tokenizer.encode_batch([p for *_, p in jobs], add_special_tokens=False), strict=True):
            ids[k].append(np.array(e.ids, np.int32))
            offsets[k].append(np.array(e.offsets, np.int64).reshape(-1, 2) + at)

    jobs, size = [], 0
    for k, text in enumerate(texts):
        for at, part in segments(text):
            if jobs and size + len(part) > SEGMENT:
                flush(jobs)
                jobs, size = [], 0
            jobs.append((k, at, part))
            size += len(part)
    flush(jobs)
    none = [np.empty(0, np.int32)], [np.empty((0, 2), np.int64)]
    return [np.concatenate(x or none[0]) for x in ids], [np.concatenate(x or none[1]) for x in offsets]


def format_conversations(rows: DataFrame, name: str = FILE) -> DataFrame:
    """One row per conversation: conv_id, formatted, input_ids and loss_mask (arrays of one length), and loss_spans of formatted."""
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(name)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"].to_pylist()]
                ids, offsets = encode(tokenizer, [t for t, _ in made])
                masks = [mask(o, own) for o, (_, own) in zip(offsets, made, strict=True)]
                spans = [[{"from": a, "to": b} for a, b in masked_spans(o, m)] for o, m in zip(offsets, masks, strict=True)]
                yield pa.record_batch(
                    [batch["conv_id"], pa.array([t for t, _ in made], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8())), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                    names=["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"],
                )

    kind = rows.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<tinyint>, loss_spans array<struct<from:int,to:int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations and their masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["from"] : s["to"]]) for s in spans)
                out.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), loss, len(text)))
            sha = lambda k: pa.array([hashlib.sha256(x[k].encode("utf-8", "replace")).hexdigest() for x in out], pa.string())
            yield pa.record_batch(
                [batch["conv_id"], pa.array([x[0] for x in out], pa.int64()), sha(1), pa.array([len(x[2]) for x in out], pa.int64()), sha(2), pa.array([x[3] for x in out], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, LEARNT, probe)], "conv_id long, turn long, role string, text string")
    # apart, so that a conversation -7 of the table's own stays one of its own
    return digests(format_conversations(rows)).unionByName(digests(format_conversations(own)))
