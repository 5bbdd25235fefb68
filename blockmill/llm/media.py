"""Media columns: chroma fingerprints of audio, and the search for recordings that align.

A recording (WAV, 16-bit PCM, any channels and rate) becomes frames of energy in the 12 pitch classes. Over the integral image of those
frames, FILTERS compare the sums of rectangles, each quantised to two bits by three thresholds in Gray code, which packs one integer of 32
bits for each place in time. Two recordings match at an offset if over the overlap there, of MIN_OVERLAP integers or more (of a shorter
recording, all), at most MAX_ERROR of all bits differ, and at most MAX_SHARE of those that would by chance. They align at the matching
offset of most equal integers, then of fewest bit errors.

Rows of one fingerprint are one class, which is searched once and counts its rows. Searches go in cells, a task each, of a block of the stated
queries and a block of the rows: BLOCK fingerprints and BLOCK_INTEGERS integers on average, by hash, whatever their number. Nothing is
broadcast or reaches the driver but counts. Every offset of every pair is held against the rule: bit errors at all offsets are a correlation of the bits, made by Fourier transforms of whole batches, and what
passes is verified bit by bit. No integer need be equal. Nothing is emitted but matches.

The corpus tables hold no audio, so the query renders each row of embeddings as a recording of one tone a component; vectors that are
nearly equal then sound nearly the same.

Of each query row, alignments() gives how many rows and classes align with it, and the class of fewest bit errors, in aggregates that are
summed before they are shuffled; search() gives the pairs of classes themselves.

Defined cases: null, empty or unreadable audio has no fingerprint and matches nothing; recordings too short for one integer likewise;
repeated rows are of one class and counted each; null ids are no queries, and are counted; an empty table gives no rows. Columns other than the id and the audio are not read.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm.common import staged, table

WINDOW_S, HOP_S = 0.128, 0.064
LOWEST_HZ, HIGHEST_HZ = 400.0, 1800.0
MAX_ERROR = 0.25
MAX_SHARE = 0.5
MIN_OVERLAP = 12
BLOCK = 1024
BLOCK_INTEGERS = 1 << 18
CHUNK = 1 << 23  # pairs times offsets that are held at a time
SPAN = 8  # frames that the widest filter sees
#: (kind, first pitch class, pitch classes, frames): 16 filters of 2 bits each, made by rule
KINDS = ("sum", "low_high", "early_late", "quarters", "band", "pulse")
FILTERS = [(KINDS[k % 6], (5 * k) % 12, 2 + k % 3 * 2, 2 + k % 4 * 2) for k in range(16)]
CUTS = (-0.35, 0.0, 0.35)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def samples(audio: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1 and the rate; none where the bytes are no 16-bit PCM WAV."""
    none = np.empty(0), 1
    if not audio:
        return none
    try:
        with wave.open(io.BytesIO(audio)) as w:
            if w.getsampwidth() != 2:
                return none
            raw, channels, rate = w.readframes(w.getnframes()), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return none
    x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(axis=1) / 32768
    return x, rate


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """frames x 12: each frame's energy by pitch class, of length 1 (0 for silence)."""
    size, hop = max(2, round(WINDOW_S * rate)), max(1, round(HOP_S * rate))
    n = (len(x) - size) // hop + 1
    if n < 1:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[:: hop][:n]
    energy = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)) ** 2
    hz = np.fft.rfftfreq(size, 1 / rate)
    used = np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ))
    pitch = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12
    to_class = np.zeros((len(used), 12))
    to_class[np.arange(len(used)), pitch] = 1
    out = energy[:, used] @ to_class
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0.0)


def integral(frames: np.ndarray) -> np.ndarray:
    """(frames + 1) x 25: sums of all frames before, and all pitch classes below, over two octaves of the same classes."""
    out = np.zeros((len(frames) + 1, 25))
    np.cumsum(np.cumsum(np.concatenate([frames, frames], axis=1), axis=0), axis=1, out=out[1:, 1:])
    return out


def parts(kind: str, y: int, height: int, width: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """The rectangles (frame from, to, class from, to) whose sums a filter compares."""
    h, w = height // 2, width // 2
    whole = (0, width, y, y + height)
    if kind == "sum":
        return [whole], [(0, width, (y + 6) % 12, (y + 6) % 12 + height)]
    if kind == "low_high":
        return [(0, width, y, y + h)], [(0, width, y + h, y + height)]
    if kind == "early_late":
        return [(0, w, y, y + height)], [(w, width, y, y + height)]
    if kind == "quarters":
        return [(0, w, y, y + h), (w, width, y + h, y + height)], [(0, w, y + h, y + height), (w, width, y, y + h)]
    if kind == "band":
        return [(0, width, y + height, y + 2 * height)], [(0, width, y, y + height)]
    return [(0, w, y, y + height)], [(w, width, (y + 3) % 12, (y + 3) % 12 + height)]


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One integer for each place at which SPAN frames begin."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = integral(frames)
    at = np.arange(n)
    area = lambda r: image[at + r[1], r[3]] - image[at + r[0], r[3]] - image[at + r[1], r[2]] + image[at + r[0], r[2]]
    out = np.zeros(n, np.uint32)
    for f in FILTERS:
        a, b = parts(*f)
        value = np.log((1 + sum(map(area, a))) / (1 + sum(map(area, b))))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(CUTS, value, "right")]
    return out


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Integers in the overlap of a and b, b beginning offset later in a, and the share of their bits that differ."""
    first, last = max(0, offset), min(len(a), len(b) + offset)
    if last <= first:
        return 0, 1.0
    x = a[first:last] ^ b[first - offset : last - offset]
    return last - first, int(np.bitwise_count(x).sum()) / (32 * (last - first))


def chance(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """The share of bits that would differ in that overlap if the integers stood in any order."""
    first, last = max(0, offset), min(len(a), len(b) + offset)
    x, y = (np.unpackbits(np.ascontiguousarray(z).view(np.uint8)).reshape(-1, 32).mean(axis=0) for z in (a[first:last], b[first - offset : last - offset]))
    return float((x * (1 - y) + y * (1 - x)).mean())


def fingerprints(media: DataFrame, id_col: str, audio_col: str = "audio") -> DataFrame:
    """id_col and fingerprint (array of int, its bits those of the unsigned integers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(chroma(*samples(a.as_py()))).view(np.int32) for a in batch[audio_col]]
            yield pa.record_batch([batch[id_col], pa.array(prints, pa.list_(pa.int32()))], names=[id_col, "fingerprint"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, audio_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint array<int>")


def bits(prints: list[np.ndarray]) -> np.ndarray:
    """prints x integers x 32, of prints of one length, as 0 and 1."""
    flat = np.ascontiguousarray(np.stack(prints)).view(np.uint8)
    return np.unpackbits(flat, axis=1).reshape(len(prints), -1, 32).astype(np.float32)


def passing(q: list[np.ndarray], p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and in p, and offsets, at which they may match; never misses one that does. All of q have one length, and all of p."""
    n, m = len(q[0]), len(p[0])
    shift = np.arange(-m + 1, n)
    first, last = np.maximum(0, shift), np.minimum(n, m + shift)
    long_ = last - first >= max(min(MIN_OVERLAP, n, m), min(n, m) / 2)
    shift, first, last = shift[long_], first[long_], last[long_]
    overlap = (last - first).astype(np.float32)[:, None, None]
    size = 1 << (n + m - 1).bit_length()
    kind = np.float32 if size <= 1 << 12 else np.float64  # sums of bits stay exact to less than a bit
    x, y = bits(q), bits(p)
    fx, fy = (np.fft.rfft((2 * z - 1).astype(kind), size, axis=1).transpose(1, 0, 2) for z in (x, y))
    agree = np.fft.irfft(fx @ fy.conj().transpose(0, 2, 1), size, axis=0)[shift % size]
    errors = (1 - agree / (32 * overlap)) / 2
    sums = [np.concatenate([np.zeros((len(z), 1, 32)), np.cumsum(z, axis=1, dtype=np.float64)], axis=1) for z in (x, y)]
    mx, my = ((z[:, b] - z[:, a]).transpose(1, 0, 2).astype(np.float32) / overlap for z, a, b in ((sums[0], first, last), (sums[1], first - shift, last - shift)))
    by_chance = (mx.sum(axis=2)[:, :, None] + my.sum(axis=2)[:, None, :] - 2 * (mx @ my.transpose(0, 2, 1))) / 32
    at, i, j = np.nonzero((errors <= MAX_ERROR + 1e-3) & (errors <= MAX_SHARE * by_chance + 1e-3))
    return i, j, shift[at]


class Block:
    """Some queries' fingerprints, by length."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        self.by_length = lengths(prints)

    def match(self, p: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(query id, offset, equal integers there, overlap, bit errors) of each query that p matches."""
        return self.match_all([p])[0]

    def match_all(self, rows: list[np.ndarray]) -> list[list[tuple[int, int, int, int, float]]]:
        best: list[dict] = [{} for _ in rows]
        for m, of_rows in lengths(rows).items():
            for n, of_queries in self.by_length.items():
                pairs = max(1, CHUNK // (n + m))
                wide = min(len(of_queries), max(1, math.isqrt(pairs)))
                tall = max(1, pairs // wide)
                for a in range(0, len(of_queries), wide):
                    for b in range(0, len(of_rows), tall):
                        qs, rs = of_queries[a : a + wide], of_rows[b : b + tall]
                        for i, j, s in zip(*(v.tolist() for v in passing([self.prints[k] for k in qs], [rows[k] for k in rs])), strict=True):
                            self._verify(qs[i], rows[rs[j]], s, best[rs[j]])
        return [[(self.ids[k], shift, -equal, overlap, errors) for k, (equal, errors, _, shift, overlap) in sorted(found.items())] for found in best]

    def _verify(self, k: int, p: np.ndarray, shift: int, found: dict) -> None:
        q = self.prints[k]
        overlap, errors = bit_errors(q, p, shift)
        if errors <= MAX_ERROR and errors <= MAX_SHARE * chance(q, p, shift) + 1e-12:
            first = max(0, shift)
            equal = int((q[first : first + overlap] == p[first - shift : first - shift + overlap]).sum())
            found[k] = min(found.get(k, (1,)), (-equal, errors, abs(shift), shift, overlap))


def lengths(prints: list[np.ndarray]) -> dict[int, list[int]]:
    """Of each length but 0 the places of its prints."""
    out: dict[int, list[int]] = {}
    for k, p in enumerate(prints):
        if len(p):
            out.setdefault(len(p), []).append(k)
    return out


def _cell(queries: pa.Table, rows: pa.Table) -> pa.Table:
    """The matches of one block of queries and one block of rows."""
    if not queries.num_rows or not rows.num_rows:
        return pa.table({c: pa.array([], t) for c, t in MATCH.items()})
    as_prints = lambda t: [np.array(p, np.int32).view(np.uint32) for p in t["fingerprint"].to_pylist()]
    block = Block(queries["id"].to_pylist(), as_prints(queries))
    found = [(q, i, *m) for i, ms in zip(rows["id"].to_pylist(), block.match_all(as_prints(rows)), strict=True) for q, *m in ms]
    cols = list(zip(*found, strict=True)) if found else [[]] * len(MATCH)
    return pa.table({c: pa.array(v, t) for (c, t), v in zip(MATCH.items(), cols, strict=True)})


MATCH = {"query_id": pa.int64(), "id": pa.int64(), "offset": pa.int32(), "equal": pa.int32(), "overlap": pa.int32(), "error_rate": pa.float64()}


def _blocks(prints: DataFrame) -> int:
    """Into how many blocks fingerprints go, by their number and by their integers."""
    n, size = prints.agg(F.count("*"), F.sum(F.size("fingerprint"))).first()
    return max(1, math.ceil(n / BLOCK), math.ceil((size or 0) / BLOCK_INTEGERS))


def search(queries: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Of every query (id_col, fingerprint) the rows it aligns with: query_id, id_col, offset, equal, overlap, error_rate."""
    # aliases keep the columns of the two sides apart where both come from one table
    with_id = [d.where(F.size("fingerprint") > 0).select(F.col(id_col).cast("long").alias("id"), F.col("fingerprint").alias("fingerprint")) for d in (queries, rows)]
    n = [_blocks(d) for d in with_id]
    block = [F.pmod(F.xxhash64("id", "fingerprint"), F.lit(k)).cast("int") for k in n]
    every = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in n]
    asked = with_id[0].select("id", "fingerprint", block[0].alias("q"), every[1].alias("r"))
    others = with_id[1].select("id", "fingerprint", every[0].alias("q"), block[1].alias("r"))
    schema = "query_id long, id long, offset int, equal int, overlap int, error_rate double"
    found = asked.groupBy("q", "r").cogroup(others.groupBy("q", "r")).applyInArrow(_cell, schema)
    return found.withColumnRenamed("id", id_col)


def alignments(queries: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """One row per row of queries (id_col, fingerprint), itself among rows: query_id, class_id (the smallest id of its fingerprint, null if it
    has none), n_matches (rows that align with it, but for itself), n_classes (their fingerprints, its own included), and best_class, best_offset
    and best_error of the other class, of those with an id, of fewest bit errors."""
    every = rows.where(F.size("fingerprint") > 0).groupBy("fingerprint").agg(F.min(F.col(id_col).cast("long")).alias("class_id"), F.count("*").alias("copies"))
    # a class whose rows all lack an id is counted as well, so classes have keys of their own
    classes = staged(every.withColumn("key", F.monotonically_increasing_id()), "chroma-classes")
    asked = staged(queries.select(F.col(id_col).cast("long").alias("query_id"), "fingerprint").join(classes, "fingerprint", "left"), "chroma-asked")
    own = asked.where("class_id is not null").select("key", "class_id", "fingerprint").distinct()
    found = search(own, classes, "key").join(classes.select("key", "class_id", "copies"), "key")
    best = F.min(F.when((F.col("key") != F.col("query_id")) & F.col("class_id").isNotNull(), F.struct("error_rate", "class_id", "offset")))
    per = found.groupBy("query_id").agg(F.sum("copies").alias("n"), F.count("*").alias("n_classes"), best.alias("best")).withColumnRenamed("query_id", "own")
    return asked.join(per, asked["key"] == per["own"], "left").select(
        "query_id",
        "class_id",
        F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_matches"),
        F.coalesce("n_classes", F.lit(0)).alias("n_classes"),
        F.col("best.class_id").alias("best_class"),
        F.col("best.offset").alias("best_offset"),
        F.col("best.error_rate").alias("best_error"),
    )


RATE = 4000
TONE = 256  # samples of a tone, one hop


def render(values: list[float] | None) -> bytes | None:
    """A recording of one tone a component, 440 Hz and up in whole tones: three for how large it is, and other three if it is negative."""
    if not values:
        return None
    v = np.array([0.0 if x is None or not math.isfinite(x) else x for x in values], np.float64)
    top = np.abs(v).max()
    level = np.minimum(np.floor(np.abs(v) / (top or 1.0) * 3), 2) + np.where(v < 0, 3, 0)
    hz = 440.0 * 2 ** (level / 6)
    phase = np.cumsum(np.repeat(2 * np.pi * hz / RATE, TONE))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.sin(phase) * 16000).astype("<i2").tobytes())
    return out.getvalue()


def recordings(vectors: DataFrame) -> DataFrame:
    """vec_id and audio, in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                yield pa.record_batch([part["vec_id"], pa.array([render(v.as_py()) for v in part["embedding"]], pa.binary())], names=["vec_id", "audio"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, audio binary")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = staged(fingerprints(recordings(table(spark, sf_dir, "embeddings")), "vec_id"), "chroma")
    return alignments(prints.where("vec_id % 100 = 0"), prints, "vec_id")
