"""Operator 9: the same ids as the tiktoken library, and exact decoding."""

import hashlib
import random
import time

import public_tokenizers as public
import pytest
import tiktoken

from tessella.llm import tokens

PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tokens.read_ranks(PATH), special_tokens={})


def _texts():
    rng = random.Random(3)
    letters = " \n\t a b'sé   '1!ñ  \r日x\u0085\x1c　🙂"
    return ["", " ", "  a", "a  ", "It's  fine\n\n ok ", "x" * 3000, "<|endoftext|>", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]]


def test_round_trip(spark, encoding):
    rows = [(i, t) for i, t in enumerate(_texts())] + [(None, None), (0, "again")]
    got = tokens.round_trip(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string"), PATH, public.PATTERN).collect()
    for (i, t), r in zip(rows, got, strict=True):
        ids = encoding.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert tokens.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, public.PATTERN).count() == 0


def test_encode_and_decode_columns(spark, encoding):
    texts = _texts()[:60]
    df = spark.createDataFrame([(t, "clash") for t in texts], "text string, ids string")
    back = tokens.decode(tokens.encode(df, PATH, public.PATTERN), PATH, public.PATTERN).collect()
    assert [r.ids for r in back] == [encoding.encode_ordinary(t) for t in texts]
    assert [bytes(r.decoded).decode() for r in back] == texts
    with pytest.raises(Exception, match="outside the vocabulary"):
        tokens.decode(spark.createDataFrame([([70_000],)], "ids array<int>"), PATH, public.PATTERN).collect()


def test_long_matches(encoding):
    rng = random.Random(8)
    own = tokens.Codec(PATH, public.PATTERN)
    vocabulary = list(own.ranks)
    for n in (31, 32, 33, 64, 65, 300, 2000):
        words = [bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(n)), bytes(rng.randrange(256) for _ in range(n)), bytes(rng.choice(b"ab") for _ in range(n))]
        words += [(one * n)[:n] for one in (b"x", b"=", b"ha", b"aab", b"\xd0\xb0", b" ", b"0")]
        words.append(b"".join(rng.choice(vocabulary) for _ in range(n // 4)))
        for word, ids in zip(words, own.contract(words), strict=True):
            want = [own.ranks[word]] if word in own.ranks else encoding._core_bpe.encode_single_piece(word)
            assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
    own.close()


def test_a_match_of_a_megabyte(spark, encoding):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    begin = time.perf_counter()
    got = tokens.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, public.PATTERN).first()
    assert time.perf_counter() - begin < 60
    ids = encoding.encode_ordinary(text)
    assert got.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_null_rows_in_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "k long, text string")
    assert [r.ids for r in tokens.encode(df, PATH, public.PATTERN).orderBy("k").collect()][:2] == [[], []]
    back = tokens.decode(spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>"), PATH, public.PATTERN)
    assert [bytes(r.decoded) for r in back.collect()] == [b"", b""]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 4000)
    own = tokens.Codec(PATH, public.PATTERN)
    rng = random.Random(4)
    for k in range(40):
        text = " ".join(["often", "again", *(f"w{rng.randrange(10**9)}" for _ in range(20))])
        pieces, order, ends = tokens.pieces_of([text])
        coded = own.learn(pieces)
        assert tokens.Sequences(own.decode(coded), order, ends).joined() == [text.encode()]
        assert k < 3 or " again" in own.pieces_known
        assert max(map(len, (own.words_known, own.pieces_known, own.decoded_known))) < 120
    own.close()


def test_matches_of_earlier_slices_are_not_merged_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 25_000)
    own, merged = tokens.Codec(PATH, public.PATTERN), []
    contract = own.contract
    monkeypatch.setattr(own, "contract", lambda words: merged.append(len(words)) or contract(words))
    for k in range(8):
        text = " ".join(f"{'eo'[k % 2]}{n:c}word," for n in range(0x4E00, 0x4E32))
        pieces, order, ends = tokens.pieces_of([text])
        assert tokens.Sequences(own.decode(own.learn(pieces)), order, ends).joined() == [text.encode()]
    assert merged[0] and merged[1] and not any(merged[2:])
    own.close()


def test_an_idle_codec_goes(monkeypatch):
    monkeypatch.setattr(tokens, "IDLE", 0.2)
    with tokens.codec(PATH, public.PATTERN) as first:
        pass
    with tokens.codec(PATH, public.PATTERN) as second:
        assert second is first
        time.sleep(0.5)
        assert second.learn([" still open"])
    time.sleep(0.6)
    assert not tokens._open


def test_sequences_are_joined_in_parts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(tokens, "JOINED", 7)
    pieces, order, ends = [b"ab", b"", b"cde", b"f" * 20], np.array([0, 2, 1, 3, 0, 0, 2]), np.array([0, 2, 3, 4, 4, 7])
    assert tokens.Sequences(pieces, order, ends).joined() == [b"", b"abcde", b"", b"f" * 20, b"", b"ababcde"]
    assert tokens.Sequences([], np.zeros(0, np.int64), np.array([0, 0])).joined() == [b"", b""]
    assert tokens.Sequences([], np.zeros(0, np.int64), np.zeros(0, np.int64)).joined() == []
