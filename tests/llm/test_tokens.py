"""BPE and token files against the public libraries, and round trips."""

import base64
import hashlib
import weakref
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from registra.llm import bpe, tokenfile

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", "a", "  \n\t x ", "héllo wörld", "don't we'll I'm", "日本語 テスト", "a_b api_key=1", "½ ²³ ٣", "\x1c\x85 ", "😀👍🏽", "ab" * 3000, " " * 500, "x" * 2000, " a", "a ", "a  ", "a\n ", "a \n b", "a\n b", " \n", "  b  c ", "a 's it's 'll", "a\u00a0 b", " \u2028 x", "a \x1c b"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts):
    return [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.encoder(RANKS, public_tokenizers.PATTERN)(texts)]


def test_odd_texts(library):
    assert ids(ODD) == [library.encode_ordinary(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=40), max_size=30))
def test_any_text(library, texts):
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\t.1é\u00a0\u3000'", max_size=14), max_size=8))
def test_white_space(library, texts):
    want = [library.encode_ordinary(t) for t in texts]
    assert ids(texts) == want
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in tokenfile._encoder(JSON, public_tokenizers.PATTERN, False)(texts)] == want


def test_memo_is_a_bound_on_memory_only(library):
    one = bpe.Units(bpe.piecewise(lambda new: bpe.encode_pieces([p.encode() for p in new], bpe.ranks_at(RANKS)), public_tokenizers.PATTERN, 3), 3)
    for texts in (["one two three four", "five six"], ["one " + "x" * 500, "seven"], [], ["two two"]):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in one(texts)] == [library.encode_ordinary(t) for t in texts]


def test_trees_of_all_sizes(library):
    pieces = [("ab" * k)[:k].encode() for k in range(1, 70)] * 30  # enough of a width for the arrays of trees
    ranks = bpe.ranks_at(RANKS)
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.encode_pieces(pieces, ranks)]
    assert got == [library.encode_ordinary(p.decode()) for p in pieces]
    assert got == [np.frombuffer(bpe._encode_tree(p, ranks), dtype="<u4").tolist() for p in pieces]


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(1, None), (1, None), (None, "x"), *[(100000 + i, t) for i, t in enumerate(ODD)]], docs.schema)
    every = docs.union(more).withColumn("n_tokens", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(map(tuple, bpe.encode_documents(every, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in docs.union(more).collect():
        found = library.encode_ordinary(t or "")
        want.append((i, len(found), hashlib.sha256(np.array(found, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(none, JSON, public_tokenizers.PATTERN)).count() == 0


@pytest.mark.parametrize("n", [1, 127, 128, 129, 4000])
@pytest.mark.parametrize("top", [1, 2, 50257, 1 << 32])
def test_blocks(n, top):
    rng = np.random.default_rng(n)
    x = (rng.random(n) ** 8 * top).astype(np.uint64).astype(np.uint32)
    packed = tokenfile.pack(x)
    assert (tokenfile.unpack(packed)[:n] == x).all()
    if n == 4000:
        assert (tokenfile.unpack(packed, 5, 9) == x[5 * 128 : 9 * 128]).all()


def test_token_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*ODD, None])], docs.schema)
    every = docs.union(more).withColumn("shard", F.lit(7))
    path = tokenfile.write_tokens(every, JSON, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in tokenfile.read_tokens(spark, path, with_ids=True).collect()}
    library, start = Tokenizer.from_file(JSON), 0
    rows = sorted(docs.union(more).collect())
    assert len(got) == len(rows)
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i].ids == want and got[i].start == start and got[i].n_tokens == len(want)
        assert got[i].ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        start += len(want)


@pytest.mark.parametrize("plain", [False, True])
def test_strings_of_special_tokens(spark, plain):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c d", "no such string", "<|endoftext |>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenfile.read_tokens(spark, tokenfile.write_tokens(docs, JSON, public_tokenizers.PATTERN, plain=plain), with_ids=True).collect()}
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = plain
    assert [got[i] for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert (50256 in got[0]) == (not plain)


def test_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(5, "b"), (5, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens) for r in tokenfile.read_tokens(spark, tokenfile.write_tokens(rows, JSON, public_tokenizers.PATTERN)).collect())
    assert sum(n for _, n in got) == 7 and len(got) == 4


def test_units_are_given_to_the_library_together(monkeypatch):
    """Units of all kinds, many to a text, have the ids that the library gives each text."""
    monkeypatch.setattr(tokenfile, "TOGETHER", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(7)
    pieces = ["word", "it's", "12", "Ünïcödé", "漢字", "😀", "a\nb", "\n", "x y", " ", "...", "'", "é", "\x1c", "\t", "", "<|x|>", "_", "a-b", "\r\n"]
    texts = [" ".join("".join(rng.choice(pieces, rng.integers(1, 4))) for _ in range(rng.integers(40))) for _ in range(400)]
    run, plain = tokenfile._encoder(path, bpe.AT_SPACES, False), Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in run(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoders_end_with_their_task():
    """A worker that waits for its next task holds no pieces or units of the ones before, and no long pieces ever."""
    encode = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    encode(["some words"])
    assert encode.memo
    held = weakref.ref(encode)
    del encode
    assert held() is None
    assert not bpe.encoder(RANKS, public_tokenizers.PATTERN).memo
    given = []
    run = bpe.piecewise(lambda new: given.extend(new) or [p.encode() for p in new], public_tokenizers.PATTERN)
    long = "x" * (bpe.LONGEST + 1)
    assert run([long, "y " + long]) == [long.encode(), b"y " + long.encode()]
    assert run([long, "y"]) == [long.encode(), b"y"]
    assert given.count(long) == 2 and given.count("y") == 1


def test_slices_of_the_token_file(monkeypatch):
    """Units are looked up once for each 4,000 rows, not for each 2,000."""
    given = []
    monkeypatch.setattr(tokenfile, "_encoder", lambda *_: lambda texts: given.append(len(texts)) or [b"\1\0\0\0"] * len(texts))
    monkeypatch.setattr(tokenfile.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    rows = pa.RecordBatch.from_pydict({"id": list(range(5000)), "text": ["a"] * 5000})
    (segment,) = tokenfile._segments(iter([rows]), JSON, public_tokenizers.PATTERN, 0, False)
    assert given == [4000, 1000] and segment["doc_ids"] == list(range(5000)) and segment["sizes"] == [2] * 5000
