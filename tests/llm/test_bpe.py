import base64
import random

import pytest

bpe = pytest.importorskip("corpusloom.llm.bpe")
tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Encoder(bpe.default_ranks()), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern():
    assert bpe.PATTERN == P.PATTERN


def test_against_tiktoken(both):
    enc, tik = both
    rnd = random.Random(5)
    texts = ["", " ", "\n\n x", "<|endoftext|>", "灯台の朝。", "ー" * 5000, "a" * 5000, "ab" * 3000, "=" * 999, "\x00​", "🌙✨", "naïve café's"]
    texts += ["".join(rnd.choice("ab ーあaa-=*\n1🌙é") for _ in range(rnd.randrange(400))) for _ in range(200)]
    got = enc.encode([None, *texts])
    assert len(got[0]) == 0
    assert [list(x) for x in got[1:]] == [tik.encode_ordinary(t) for t in texts]
    assert all(tik.decode(list(x)) == t for x, t in zip(got[1:], texts))


def test_rows(spark):
    d = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (1, "a b", 9)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encoded(d, "doc_id", "text", bpe.default_ranks()).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert bpe.encoded(d.where("false"), "doc_id", "text", bpe.default_ranks()).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.counted(d, "doc_id", "text", bpe.default_ranks()).collect()} == {1: 2, 2: 0, 3: 0}


def test_long_runs(both):
    enc, tik = both
    rnd = random.Random(7)
    for text in ("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "ab" * 10_000 + "a", "あい" * 4_000):
        assert list(enc.encode([text])[0]) == tik.encode_ordinary(text)
    # a million letters without a break end in seconds, and nothing is lost
    text = "".join(rnd.choice("abcdefghijklmnop") for _ in range(1_000_000))
    assert tik.decode(list(enc.encode([text])[0])) == text


def test_linked_rows_like_matrices(both):
    import numpy as np

    enc, _ = both
    rnd = random.Random(8)
    for alphabet in ("ab", "abc ", "あいé0"):
        for n in (2, 3, 17, 400):
            raw = "".join(rnd.choice(alphabet) for _ in range(n)).encode()
            ids = enc.bytes[np.frombuffer(raw, np.uint8)]
            assert list(enc._merge_long(ids)) == list(enc._merge(ids[None, :])[0])
