"""Token counts, encoding and decoding against the libraries and as round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsframe.llm import byte_bpe, catalog
from newsframe.llm.byte_bpe import Codec, decode, encode
from newsframe.llm.pretokens import find_pretokens
from newsframe.llm.token_counts import count_texts, count_tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def odd_texts(n=300):
    dice = random.Random(11)
    fixed = ["", " ", "a", "aaaaaaa", "a" * 1000, "the " * 50, "x" * 300 + "y" * 301 + "abcabcabc" * 100, "!" * 700, "  \n\n x\t", "don't we'll", "naïve café Äöü ৯ জুন 日本語 🙂🙂", "\x85\xa0 　x\x1c\x1f", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c<|endoftext|"]
    return fixed + ["".join(chr(dice.choice([dice.randrange(1, 0x3000), dice.randrange(32, 127), dice.randrange(0x10000, 0x11000)])) for _ in range(dice.randrange(1, 60))) for _ in range(n)]


def sample(spark, sf_dir):
    return [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(spark, sf_dir):
    texts = odd_texts() + sample(spark, sf_dir)
    library = Tokenizer.from_file(JSON)
    assert count_texts(texts, JSON) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_tokens_keeps_rows_and_columns(spark):
    rows = [(1, None, 7), (1, "", 7), (None, "a b c", None), (2, "a b c", 1), (2, "a b c", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = count_tokens(frame, JSON, limit=2)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 5, 3, True), (2, 5, 3, True), (2, 5, 3, True)], key=key)
    assert count_tokens(frame.limit(0), JSON).collect() == []


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library_and_decodes(spark, sf_dir, library):
    texts = odd_texts(100) + sample(spark, sf_dir)[:60] + [None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = encode(frame, RANKS, outputs=("ids", "ids_text", "decoded")).orderBy("id").collect()
    for text, row in zip(texts, rows, strict=True):
        assert row["ids"] == library.encode_ordinary(text or "") and row["n_tokens"] == len(row["ids"])
        assert row["ids_text"] == ",".join(map(str, row["ids"])) and bytes(row["decoded"]) == (text or "").encode()
    again = decode(encode(frame, RANKS), RANKS).orderBy("id").collect()
    assert [bytes(r["decoded"]) for r in again] == [(t or "").encode() for t in texts]
    assert encode(frame.limit(0), RANKS).collect() == []


def test_decoding_single_ids(library):
    ids = [0, 255, 256, 1000, 50_000]
    own = Codec(RANKS)
    assert own.decode(np.array(ids, np.int32), np.ones(5, np.int64)) == [library.decode_single_token_bytes(i) for i in ids]
    assert own.decode(np.array(ids, np.int32), np.array([0, 2, 0, 3])) == [b"", library.decode_bytes(ids[:2]), b"", library.decode_bytes(ids[2:])]
    with pytest.raises(ValueError):
        own.decode(np.array([60_000], np.int32), np.ones(1, np.int64))


def test_decoding_longer_than_a_group(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "GROUP_IDS", 7)
    monkeypatch.setattr(byte_bpe, "DECODED_IDS", 20)
    texts = ["one two three four five six seven eight nine ten eleven", "", "a", "x y z " * 40]
    ids = [library.encode_ordinary(t) for t in texts]
    assert Codec(RANKS).decode(np.concatenate(ids).astype(np.int32), np.array(list(map(len, ids)))) == [t.encode() for t in texts]


@pytest.mark.parametrize("cut, long, chunk", [(32, 128, 64), (8, 24, 11), (100_000, 8, 5)])
def test_long_pieces_equal_the_library(library, monkeypatch, cut, long, chunk):
    """Wherever a piece is cut and of whatever chunks it is put together."""
    for name, value in (("CUT_PIECE", cut), ("LONG_PIECE", long), ("CHUNK", chunk), ("CHUNKS", 1000), ("BESIDE", 1 if chunk < 64 else 3)):
        monkeypatch.setattr(byte_bpe, name, value)
    dice = random.Random(cut)
    tokens = [t.decode() for t in library.token_byte_values() if t.isalpha()]
    words = ["".join(dice.choice(tokens) for _ in range(dice.randrange(10, 60))) for _ in range(60)]
    words += ["".join(dice.choice("thean") for _ in range(dice.randrange(30, 400))) for _ in range(30)] + ["a" * 3000, "=" * 1501, "thethe" * 200, "的一是不了" * 150]
    assert Codec(RANKS).encode(words)[0].to_pylist() == [",".join(map(str, library.encode_ordinary(w))) for w in words]


def test_pieces_of_a_megabyte_equal_the_library(library):
    dice = random.Random(9)
    tokens = [t.decode() for t in library.token_byte_values() if t.isalpha()]
    runs = ["ab" * 500_000, "a" * 1_000_003, "".join(chr(dice.randint(0x4E00, 0x9FFF)) for _ in range(340_000)), "".join(chr(dice.randint(0xE01, 0xE2E)) for _ in range(340_000)), "".join(dice.choice(tokens) for _ in range(100_000))]
    own = Codec(RANKS)
    for text in runs:
        assert own.encode([text])[1].tolist() == library.encode_ordinary(text)
        own.forget()


def test_any_merge_table(monkeypatch, tmp_path):
    """Tables in which parts rank below the whole, against the rule one step at a time."""

    def plain(word, ranks):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    dice = random.Random(5)
    for n in range(6):
        texts = {bytes(dice.choice(b"abc") for _ in range(dice.randrange(2, 6))) for _ in range(25)}
        order = dice.sample(sorted(texts), len(texts))
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        path = tmp_path / f"{n}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        words = ["".join(dice.choice("abc") for _ in range(dice.randrange(1, 60))) for _ in range(120)]
        for cut, long, chunk in ((32, 128, 64), (4, 2, 1), (1000, 5, 4)):
            for name, value in (("CUT_PIECE", cut), ("LONG_PIECE", long), ("CHUNK", chunk), ("CHUNKS", 1000), ("BESIDE", 1)):
                monkeypatch.setattr(byte_bpe, name, value)
            assert Codec(str(path)).encode(words)[0].to_pylist() == [",".join(map(str, plain(w.encode(), ranks))) for w in words]


def test_pretokens_are_the_public_pattern(spark, sf_dir):
    public = regex.compile(P.PATTERN)
    for text in odd_texts(600) + sample(spark, sf_dir):
        assert find_pretokens(text or "") == public.findall(text or "")


def test_encoding_repeated_long_and_clashing_rows(spark, library):
    very_long = "word " * 60_000 + "x" * 20_000
    rows = [(1, "same text", "n"), (1, "same text", "n"), (2, very_long, "n"), (None, None, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("ids_text", F.lit("old"))
    got = encode(frame, RANKS, outputs=("ids_text", "decoded"))
    assert got.columns == ["doc_id", "n_tokens", "ids_text", "decoded"]
    found = sorted(((r["doc_id"] or 0, r["ids_text"], bytes(r["decoded"])) for r in got.collect()), key=lambda r: r[0])
    want = [(d or 0, ",".join(map(str, library.encode_ordinary(t or ""))), (t or "").encode()) for d, t, _ in rows]
    assert found == sorted(want, key=lambda r: r[0])


def test_counting_very_long_texts(spark):
    very_long = "word " * 60_000 + "x" * 20_000
    frame = spark.createDataFrame([(1, very_long)], "doc_id long, text string")
    assert [tuple(r) for r in count_tokens(frame, JSON).collect()] == [(1, len(very_long), len(Tokenizer.from_file(JSON).encode(very_long, add_special_tokens=False).ids), True)]


def test_registered_token_queries_over_the_tables(spark, sf_dir, library):
    """op6 and op10 row by row against the libraries."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in catalog.op6_byte_bpe(spark, sf_dir).collect()}
    ids = {d: library.encode_ordinary(t) for d, t in texts.items()}
    assert got == {d: (len(ids[d]), sha(",".join(map(str, ids[d])).encode()), sha(t.encode())) for d, t in texts.items()}
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in catalog.op10_token_counts(spark, sf_dir).collect()}
    json_ids = Tokenizer.from_file(JSON).encode_batch(list(texts.values()), add_special_tokens=False)
    assert counts == {d: (len(t.encode()), len(e.ids), len(e.ids) > 512) for (d, t), e in zip(texts.items(), json_ids, strict=True)}
