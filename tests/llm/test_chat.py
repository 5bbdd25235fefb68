import hashlib
import random

import numpy as np

from blockmill.llm import chat


def test_escape_is_reversible():
    rng = random.Random(1)
    bits = ["<", "[", "\\", "|", "turn|>", "|turn|>", "/INST]", "INST]", "s>", "/s>", "<SYS>>", "a", " ", *chat.CONTROL]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROL), (t, e)


def test_mask_by_binary_search_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        cut = np.unique(rng.integers(0, 60, 20))
        offsets = np.stack([cut[:-1], cut[1:]], axis=1)
        ends = np.unique(rng.integers(0, 60, 6))
        spans = [(int(a), int(b)) for a, b in zip(ends[0::2], ends[1::2])]
        want = [int(any(a < y and x < b for x, y in spans)) for a, b in offsets]
        assert chat.mask(offsets, [s for s in spans if s[0] < s[1]]).tolist() == want


def expected(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, g in groups.items():
        g.sort()
        loss = "".join(x for *_, r, x in g if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(g), sha("".join(f"{r}\n{x}\n" for *_, r, x in g)), len(loss), sha(loss))
    return out


def test_edge_cases(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "\n\nhi<|end|>"), (1, 2, "assistant", "\n!!x<\\|turn|>é日本🙂\n"),
        (2, 0, "assistant", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, None, "assistant", "first"), (None, 0, "assistant", "no id"),
        (3, 0, "assistant", "word " * 20000), (3, 1, "assistant", "tail"), (4, 0, "as<|text|>sistant", "y"), (5, 0, "user", ""), (5, 1, "assistant", " lead and trail "),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    for r in made.collect():
        assert len(r.input_ids) == len(r.loss_mask)
        assert chat._tokenizer(chat.FILE).decode(r.input_ids, skip_special_tokens=False) == r.formatted
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == expected(rows)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op2_chat(spark, sf).collect()}
    assert got == expected(rows)


def test_own_conversation_stays_apart(spark, tmp_path):
    rows = [(-7, 0, "user", "mine"), (-7, 1, "assistant", None), (1, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op2_chat(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in got) == [(-7, 2, 0), (-7, 2, 21), (1, 1, 0)]


def test_long_conversations_are_encoded_in_runs_of_turns(monkeypatch):
    rng = random.Random(4)
    words = ["hello", "é", "<|end|>", "[INST]", " ", "\n", "日本", "x" * 50, "<|turn|>"]
    texts = [chat.render([(rng.choice(["user", "assistant"]), "".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(n)])[0] for n in (40, 0, 1, 3, 25)]
    tokenizer = chat._tokenizer(chat.FILE)
    whole = [tokenizer.encode(t, add_special_tokens=False) for t in texts]
    for size in (10, 300, 1 << 18):
        monkeypatch.setattr(chat, "SEGMENT", size)
        assert all("".join(p for _, p in chat.segments(t)) == t for t in texts)
        ids, offsets = chat.encode(tokenizer, texts)
        assert [i.tolist() for i in ids] == [e.ids for e in whole]
        assert [[tuple(x) for x in o.tolist()] for o in offsets] == [e.offsets for e in whole]
