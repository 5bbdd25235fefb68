import io
import wave

import numpy as np

from blockmill.llm import media as m


def test_integral_image_equals_direct_sums():
    rng = np.random.default_rng(0)
    frames = rng.random((20, 12))
    two, image = np.concatenate([frames, frames], axis=1), m.integral(frames)
    for kind, y, h, w in m.FILTERS:
        for rects in m.parts(kind, y, h, w):
            for a, b, c, d in rects:
                assert 0 <= a < b <= m.SPAN and 0 <= c < d <= 24
                assert np.isclose(image[3 + b, d] - image[3 + a, d] - image[3 + b, c] + image[3 + a, c], two[3 + a : 3 + b, c:d].sum())


def wav(x, rate=4000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(np.asarray(x, "<i2")[:, None], channels, axis=1).tobytes())
    return out.getvalue()


def test_a_tone_is_its_pitch_class():
    t = np.arange(8000) / 4000
    for hz, pitch in ((440, 0), (466.16, 1), (880, 0), (659.26, 7)):
        for channels in (1, 2):
            frames = m.chroma(*m.samples(wav(np.sin(2 * np.pi * hz * t) * 9000, channels=channels)))
            assert len(frames) and (frames.argmax(axis=1) == pitch).all()


def test_bad_audio_has_no_fingerprint():
    for bad in (None, b"", b"RIFF", b"no audio", wav([]), wav([1] * 100)):
        assert len(m.fingerprint(m.chroma(*m.samples(bad)))) == 0
    assert len(m.fingerprint(m.chroma(*m.samples(wav([0] * 16000))))) > 0


def brute(query, p):
    """The offset that most equal integers agree on, by all pairs."""
    count = {}
    for i, a in enumerate(query):
        for j, b in enumerate(p):
            if a == b:
                count[i - j] = count.get(i - j, 0) + 1
    if not count:
        return None
    shift = min(count, key=lambda s: (-count[s], abs(s), s))
    overlap, errors = 0, 0
    for i, a in enumerate(query):
        if 0 <= i - shift < len(p):
            overlap += 1
            errors += bin(int(a) ^ int(p[i - shift])).count("1")
    rate = errors / (32 * overlap)
    bits = [[[int(v) >> k & 1 for k in range(32)] for v in x] for x in (query[max(0, shift) : max(0, shift) + overlap], p[max(0, -shift) : max(0, -shift) + overlap])]
    a, b = ([sum(col) / overlap for col in zip(*x)] for x in bits)
    chance = sum(x * (1 - y) + y * (1 - x) for x, y in zip(a, b)) / 32
    good = overlap >= max(m.MIN_OVERLAP, min(len(p), len(query)) / 2) and rate <= m.MAX_ERROR and rate <= m.MAX_SHARE * chance + 1e-12
    return (shift, count[shift], overlap, rate) if good else None


def test_matches_equal_brute_force_and_find_offsets():
    rng = np.random.default_rng(1)
    prints = [rng.integers(0, 40, 50).astype(np.uint32) for _ in range(6)]
    prints.append(np.concatenate([rng.integers(0, 1 << 32, 7).astype(np.uint32), prints[0]]))
    block = m.Block(list(range(6)), prints[:6])
    for p in prints:
        got = {q: tuple(x) for q, *x in block.match(p)}
        want = {q: b for q in range(6) if (b := brute(prints[q], p))}
        assert got == want
    assert {q: s for q, s, *_ in block.match(prints[6])}[0] == -7


def test_shifted_recordings_align():
    rng = np.random.default_rng(3)
    v = list(rng.normal(size=80))
    v[50] = 4.0  # both recordings have the loudest component
    a, b = (m.fingerprint(m.chroma(*m.samples(m.render(list(x))))) for x in (v, v[10:]))
    found = m.Block([5], [a]).match(b)
    assert found and found[0][0] == 5 and found[0][1] == 10


def test_query_finds_itself_and_near_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    rows = [(100, base), (101, base), (102, base * 1.0001), (200, rng.normal(size=64)), (300, None), (7, None)]
    rows = [(i, None if v is None else [float(x) for x in v], "x") for i, v in rows] + [(None, [1.0] * 64, "y"), (8, [], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, audio string")
    prints = m.fingerprints(m.recordings(df), "vec_id")
    assert prints.count() == len(rows)
    got = {(r.query_id, r.vec_id): (r.offset, r.error_rate) for r in m.search(prints.where("vec_id % 100 = 0"), prints, "vec_id").collect()}
    assert got[100, 100] == got[100, 101] == got[200, 200] == (0, 0.0) and got[100, 102][0] == 0
    assert not any({a, b} == {100, 200} or 300 in (a, b) for a, b in got)
    none = prints.limit(0)
    assert m.search(none, prints, "vec_id").count() == 0 and m.search(prints, none, "vec_id").count() == 0


def by_bit_errors(q, p):
    """Whether any offset passes the rule, by all of them."""
    least = max(min(m.MIN_OVERLAP, len(q), len(p)), min(len(q), len(p)) / 2)
    for s in range(-len(p) + 1, len(q)):
        overlap, errors = m.bit_errors(q, p, s)
        if overlap >= least and errors <= m.MAX_ERROR and errors <= m.MAX_SHARE * m.chance(q, p, s) + 1e-12:
            return True
    return False


def test_recall_by_bit_errors_at_all_offsets():
    """Copies with a bit that is always flipped, with 20 % errors, and short ones: few or no integers are equal."""
    rng = np.random.default_rng(8)
    queries = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (56, 56, 80, 5, 1)]
    rows = [q ^ np.uint32(1 << 7) for q in queries[:3]] + [queries[3], queries[4], queries[0][10:], np.empty(0, np.uint32)]
    for q in queries[:3] * 10:
        noise = np.packbits(rng.random((len(q), 32)) < 0.2, axis=1).view(np.uint32)[:, 0]
        rows.append(np.concatenate([rng.integers(0, 1 << 32, 9, dtype=np.uint32), q ^ noise]))
    block = m.Block(list(range(5)), queries)
    got = [{k for k, *_ in found} for found in block.match_all(rows)]
    assert got == [{k for k in range(5) if by_bit_errors(queries[k], p)} for p in rows]
    assert got[:6] == [{0}, {1}, {2}, {3}, {4}, {0}] and all(got[7 + k] == {k % 3} for k in range(30))
    assert {s for found in block.match_all(rows[7:]) for _, s, *_ in found} == {-9}


def test_alignments_count_all_rows(spark, monkeypatch):
    """Counts by classes equal those of all pairs of rows, by brute force over all offsets, whatever the blocks; other columns do not matter."""
    rng = np.random.default_rng(12)
    base = [rng.integers(0, 1 << 32, 40, dtype=np.uint32) for _ in range(4)]
    prints = {}
    for k in range(60):
        p = base[k % 4].copy()
        if k % 3:
            p ^= np.uint32(1) << np.uint32(k % 5)
        prints[k * 50] = p if k % 7 else p[5:]
    prints[90001] = np.empty(0, np.uint32)
    prints[90000] = None
    rows = [(i, None if p is None else p.view(np.int32).tolist(), i, "x") for i, p in prints.items()] + [(None, base[0].view(np.int32).tolist(), 1, "n")] * 2
    rows += [(None, (base[1] ^ np.uint32(1 << 9)).view(np.int32).tolist(), 1, "n")] * 3  # a class of its own, without ids
    df = spark.createDataFrame(rows, "vec_id long, fingerprint array<int>, class_id long, copies string").select("vec_id", "fingerprint")
    every = [(i, np.array(p or [], np.int32).view(np.uint32)) for i, p, *_ in rows]
    want = {q: sum(by_bit_errors(prints[q], p) for i, p in every) - 1 for q in prints if q % 100 == 0 and prints[q] is not None and len(prints[q])}
    got = {r.query_id: r for r in m.alignments(df.where("vec_id % 100 = 0"), df, "vec_id").collect()}
    assert {q: r.n_matches for q, r in got.items() if r.class_id is not None} == want and got[90000].n_matches == got[90000].n_classes == 0
    for r in got.values():
        if r.best_class is not None:
            assert m.bit_errors(prints[r.query_id], prints[r.best_class], r.best_offset)[1] == r.best_error > 0 or len(prints[r.best_class]) != len(prints[r.query_id])
    monkeypatch.setattr(m, "BLOCK", 4)
    monkeypatch.setattr(m, "BLOCK_INTEGERS", 100)
    assert {r.query_id: tuple(r) for r in m.alignments(df.where("vec_id % 100 = 0"), df, "vec_id").collect()} == {q: tuple(r) for q, r in got.items()}


def test_op6_on_the_table(spark):
    got = m.op6_media(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.query_id for r in got) == [r.vec_id for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 100 = 0").orderBy("vec_id").collect()]
