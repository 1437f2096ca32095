import hashlib
import random

import numpy as np
import pytest
import tiktoken

from stockbook.llm.byte_bpe import PATTERN, WIDE, ByteBpe, decode, digests, encode, op11_byte_bpe, read_ranks

TOKENS = read_ranks()
OURS = ByteBpe(TOKENS)
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def same(texts):
    for text, ids in zip(texts, OURS.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == THEIRS.encode_ordinary(text), text[:80]
        assert OURS.decode(ids) == text.encode()


def test_random_texts_as_the_library_has_them():
    r = random.Random(1)
    alphabet = "ab the ing tion éèñ日本 \n\t \u0085 1234 .,;!'sST漢😀\x00\x1ć"
    same(["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(2000)] + ["<|endoftext|>", "", " ", "it's I'LL we'd"])


@pytest.mark.parametrize("unit", ["a", "ab", " ", "\n", "=-", "é", "日本", "the", "abcdefgh", "ing"])
def test_long_pieces(unit):
    same([unit * n for n in (WIDE - 1, WIDE, WIDE + 1, 3001)])


def test_long_random_pieces():
    r = random.Random(2)
    same(["".join(r.choice(a) for _ in range(4000)) for a in ("ab", "abcdeth", "etaoinshrdlu", "日本語", "=-_*", "0123456789")])


def test_rounds_with_a_made_vocabulary():
    """Merges whose token has a lower rank than its parts' merges, in rows and in long pieces."""
    r = random.Random(3)
    for trial in range(30):
        made = [bytes([b]) for b in range(256)]
        pool = {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(25)}
        made += sorted(pool, key=lambda _: r.random())
        own = ByteBpe(made, "(?s).+")
        want = tiktoken.Encoding(f"t{trial}", pat_str="(?s).+", mergeable_ranks={t: i for i, t in enumerate(made)}, special_tokens={})
        texts = ["".join(r.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 3, 9, 40, 99, 300, 700)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text)


def test_dictionary_is_bounded(monkeypatch):
    monkeypatch.setattr("stockbook.llm.byte_bpe.MOST", 10)
    own = ByteBpe(TOKENS)
    for k in range(5):
        list(own.encode([f"word{k}x{i}" + "z" * 60 for i in range(20)]))
    assert len(own.known) <= 10 + 20 * 4 and not any(len(w) > 48 for w in own.known)


def test_frames(spark):
    texts = [None, "", "Ça va? " * 50, "x" * 1000, "a\tb\n\n c", "a\tb\n\n c"]
    docs = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    ids = {r["key"]: r["ids"] for r in encode(docs).collect()}
    assert ids == {i or None: THEIRS.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r["key"]: bytes(r["data"]).decode() for r in decode(encode(docs)).collect()} == {i or None: t or "" for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, [-1, 99_999_999, None, 64]), (2, None)], "key long, ids array<long>")
    assert {r["key"]: bytes(r["data"]) for r in decode(odd).collect()} == {1: TOKENS[64], 2: b""}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in digests(docs).collect():
        t = texts[r["key"] or 0] or ""
        want = THEIRS.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(np.array(want, "<u4").tobytes()), sha(t.encode()))
    assert digests(docs.where("false")).count() == 0


def test_query_against_the_library(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        want = THEIRS.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
