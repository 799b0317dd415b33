import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tapeline.llm import bpe, simple8b

TEXTS = ["", "Hello  world's 123 it'll\n\n x", "a" * 300, "<|endoftext|> x <|ENDOFTEXT|>", "é́ Éà ß，。 \x1c\x1d\x85y 　 z", "ab, cd. e,, f'S don't", "İstanbul ΣΑΣ \U0001f600‍日本語", " \t \n ", "x y ᠎ z"]


def _random_texts(n=300):
    rng = random.Random(4)
    pool = [*"abcdeé Éß.,'\n\t 019!<|>", "the", " ing", "<|endoftext|>", " ", "\x1c", "\x85", "日", "́", "ſ", "ª", "²", "Ⅷ"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_byte_bpe_matches_library():
    path = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.Encoder(path)
    for t in TEXTS + _random_texts():
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(t)
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    own = bpe.Encoder(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(50):
        parts = [own.first[rng.choice(b"thein ao")] for _ in range(rng.randrange(1, 200))]
        assert own.merge(list(parts)) == own.merge_long(list(parts))


def test_word_bpe_matches_library():
    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), simple8b.Encoder(path)
    for t in TEXTS + _random_texts():
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("top", [1, 2, 40, 49408, 2**32, 2**60, 2**64])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 7, 61, 4096, 10000):
        v = np.array([rng.integers(0, top, dtype=np.uint64, endpoint=False) if top < 2**64 else rng.integers(0, 2**64 - 1, dtype=np.uint64, endpoint=True) for _ in range(min(n, 5000))], np.uint64)
        if len(v):
            v[rng.integers(0, len(v), len(v) // 2)] //= np.uint64(max(1, top // 3))
        offsets, data = simple8b.pack(v)
        assert (simple8b.unpack(offsets, data) == v).all()


def test_token_files(spark):
    docs = spark.createDataFrame([(5, "b c", 1), (None, "n", 2), (3, None, 3), (5, "a", 4), (1, "x " * 70000, 5), (9, "", 6)], "doc_id long, text string, shard int")
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = [r.asDict() for r in simple8b.read_tokens(simple8b.write_tokens(docs, path)).orderBy("start").collect()]
    order = [(None, "n"), (1, "x " * 70000), (3, None), (5, "a"), (5, "b c"), (9, "")]
    at = 0
    for row, (doc, text) in zip(got, order, strict=True):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert zlib.crc32(bytes(row["ids"])) == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert simple8b.read_tokens(simple8b.write_tokens(docs.limit(0), path)).count() == 0


def test_token_files_at_a_destination(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string")
    path, to = P.path("word_bpe_49k.json"), str(tmp_path / "tokens")
    want = simple8b.read_tokens(simple8b.write_tokens(docs, path, to=to)).orderBy("start").collect()
    assert simple8b.read_tokens(spark.read.parquet(to)).orderBy("start").collect() == want and [r.doc_id for r in want] == [1, 2]
    with pytest.raises(Exception, match="exist"):
        simple8b.write_tokens(docs, path, to=to)


def test_bpe_operator(spark):
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (2, None, "z")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in rows) == [(1, 2, "a b"), (1, 2, "a b"), (2, 0, "")]
    assert bpe.encode(docs.limit(0), path).count() == 0
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("text", ["T̈ Ẅ Y̊ T̨̈", "Für K̂ T⃐̈", "A：B ABC，日 I’m T恤", "Ḍ̇ D̴̈ ﬞאT"])
def test_capitals_before_marks(text):
    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), simple8b.Encoder(path)
    assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_word_memories_are_bounded_by_bytes():
    from tapeline.llm import common

    class Echo(common.Memory):
        def make(self, word):
            return word * 2

    m = Echo(40)
    for k in range(3000):
        assert m[b"%d" % k] == b"%d" % k * 2
    assert len(m) + len(m.older) < 100 and m[b"1"] == b"11"
    own = simple8b.Encoder(P.path("word_bpe_49k.json"))
    paragraph = "日本語の文章" * 400  # a text without white space is one long word, which is not kept
    for k in range(50):
        own.encode(paragraph + chr(0x4E00 + k))
    assert sum(map(len, own)) + sum(map(len, own.older)) < 1000
