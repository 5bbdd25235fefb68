import hashlib
import random

from tokenizers import Tokenizer

from blockmill.llm import bpe
from blockmill.llm.common import tokenizer_path


def library():
    return Tokenizer.from_file(tokenizer_path(bpe.FILE))


def check(texts):
    theirs, mine = library(), bpe.Bpe.load()
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids, repr(t)
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False), repr(t)


def test_random_strings():
    rng = random.Random(5)
    pools = ["abc 's'll'VE  \t\n\x85\xa0!?#12²½ÄÖΣσς İıǅßﬁÅ", "".join(chr(rng.randrange(1, 0x3000)) for _ in range(400)), "".join(map(chr, range(0x10000, 0x10400))) + "日本語漢字​\x1c\x1f\x00"]
    check("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(50))) + rng.choice(["", "<|endoftext|>x", "<|startoftext|>"]) for _ in range(1500))


def test_long_and_odd_texts():
    check(["", " ", "a" * 3000, "x" * 500 + "é" * 500, "<|endoftext|>" * 3, "a<|endoftext|>", "Don't'S it'll", "ΑΣ ΑΣ. ΣΣ", "a\x1cb", "é é", "￾퟿"])


def test_caches_may_be_dropped():
    import json

    with open(tokenizer_path(bpe.FILE), encoding="utf-8") as f:
        small = bpe.Bpe(json.load(f), cache=2000)
    text = "the quick brown fox jumps over the lazy dog and the quick red fox again " * 3
    assert small.encode(text) == bpe.Bpe.load().encode(text)


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    theirs = library()
    got = {r.doc_id: r for r in bpe.op5_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = theirs.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b", None), (2, "word " * 50000, "z"), (2, "a b", "z")], "doc_id long, text string, ids string")
    got = bpe.encode(df, decoded=True)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    assert sorted(r.n_tokens for r in got.collect()) == [0, 0, 2, 2, 50000]
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.ids_sha256 for r in bpe.digests(got).where("n_tokens = 0").collect()} == {empty}
    assert bpe.encode(df.limit(0)).count() == 0


def test_what_is_kept_is_bounded_by_bytes():
    """Long chunks without blanks, chunks of many ids, and many short ones."""
    import json
    import sys

    with open(tokenizer_path(bpe.FILE), encoding="utf-8") as f:
        b = bpe.Bpe(json.load(f), cache=1 << 20)
    rng = random.Random(3)
    for k in range(300):
        b.encode("".join(rng.choice("abcdefgh!?") for _ in range(20_000)))
        b.encode(" ".join(f"w{k}q{j}" for j in range(100)) + " " + "".join(rng.choice("äöü") for _ in range(60)))
    held = [(k, v) for kept in (b.kept_words, b.kept_chunks) for part in (kept.young, kept.old) for k, v in part.items()]
    assert held and all(len(k) <= bpe.KEY for k, _ in held)
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in held) + sum(sys.getsizeof(p) for kept in (b.kept_words, b.kept_chunks) for p in (kept.young, kept.old)) < 1.6 * (1 << 20)


def test_column_names_with_backticks(spark):
    df = spark.createDataFrame([(1, "a b", 5)], ["doc_id", "text", "odd`name"])
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "text", "odd`name", "ids", "n_tokens"] and got.first()[2] == 5
