import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from blockmill.llm import tokenfiles as t
from blockmill.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(t.FILE))


def expected(library, rows):
    """doc_id, start, n_tokens, crc32 of rows in the order of their ids (of one id: by the hash that the files use)."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, t.END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_chunks_are_encoded_as_whole_texts_are(library):
    rng = random.Random(5)
    pools = ["abc 's'll'VE  \t\n\x0b\x0c\r\x85\xa0 　!?#12²½ÄÖΣσς İıǅßﬁÅ", "".join(chr(rng.randrange(1, 0x3000)) for _ in range(400)), "日本語漢字​\x1c\x1d\x1e\x1f\x00̸́"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) + rng.choice(["", "<|endoftext|>x", " <|startoftext|>", "ΑΣ ΑΣ."]) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, None, "x́ ́y", "e ́"]
    small = t.Encoder(tokenizer_path(t.FILE), keep=64)
    for encoder in (small, t.Encoder.load()):
        for k in range(0, len(texts), 100):
            for text, got in zip(texts[k : k + 100], encoder.encode(texts[k : k + 100]), strict=True):
                assert np.frombuffer(got, encoder.kind).tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert all(len(c) <= t.KEEP_CHARS for c in [*small.young, *small.old])


def test_what_is_kept_is_bounded():
    """Distinct chunks, long ones and short ones: neither stays beyond the bound."""
    e = t.Encoder(tokenizer_path(t.FILE), keep=400)
    for k in range(50):
        e.encode([" ".join(f"w{k}x{j}" for j in range(100)), "q" * 20000 + str(k)])
    held = [*e.young.items(), *e.old.items()]
    assert len(held) < 400 + 2 * 300 and sum(len(c) + len(i) for c, i in held) < 60_000


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in t.op13_tokens(spark, sf).collect())
    assert got == expected(library, rows)


def test_many_files_edge_cases_and_extra_columns(spark, library, tmp_path):
    rows = [(k * 3 % 200, f"text {k} " * (k % 9)) for k in range(200)] + [(None, "b"), (None, None), (7, "same"), (7, "same"), (500, "long word " * 20000)] + [(None, "hot")] * 300
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, start int, ids string").repartition(5)
    made = t.write(df, str(tmp_path / "out"), file_bytes=1500)
    files = made.orderBy("part").collect()
    assert len(files) > 5 and [f.base for f in files] == np.concatenate([[0], np.cumsum([f.n_tokens for f in files])[:-1]]).tolist()
    got = sorted(t.read(made).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted([a for a, _ in rows], key=lambda a: -1 if a is None else a)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    by_id: dict = {}
    for a, b in rows:
        by_id.setdefault(a, []).append([*library.encode(b or "", add_special_tokens=False).ids, t.END])
    for r in got:
        by_id[r.doc_id].remove(np.frombuffer(r.ids, "<u4").tolist())
    # the hot id is in several files, and a file maps by itself
    assert sum(f.n_docs for f in files) == len(rows) and max(f.n_docs for f in files) < 300
    one = t.TokenFile(files[3].path, files[3].name)
    assert one.width == 2 and one.end == t.END and one.base == files[3].base and len(one[0]) == one.offsets[1] - one.offsets[0]
    assert (tmp_path / "out" / f"{files[3].name}.bin").stat().st_size == 2 * files[3].n_tokens
    # leftovers go, what the manifest lists stays
    (tmp_path / "out" / "tokens-lost.bin").write_bytes(b"x")
    assert t.sweep(made) == 1 + len(files) and t.read(made).count() == len(rows)


def test_reruns_empty_table_and_no_end(spark, tmp_path):
    df = spark.createDataFrame([(2, "b c"), (1, None), (2, "a")], "doc_id long, text string")
    one, two = (sorted(map(tuple, t.read(t.write(df)).collect())) for _ in range(2))
    assert one == two
    assert t.read(t.write(df.limit(0))).count() == 0
    bare = t.read(t.write(df, end=None)).collect()
    assert sorted(r.n_tokens for r in bare) == [0, 1, 2]
