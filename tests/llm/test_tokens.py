"""BPE coding, token counts and token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from xylem.llm import repair  # noqa: E402
from xylem.llm.bpe import bpe_decode, bpe_encode, codec  # noqa: E402
from xylem.llm.token_count import counter, simple_rows, token_counts  # noqa: E402

WORD, BYTE = str(public.path("word_bpe_49k.json")), str(public.path("byte_bpe_50k.json"))
CASES = [None, "", " ", "the", "The  Cat\n\nsat.", "don't WE'LL 'S", "aaaaaaaaaaaaaaaa shshshshsh", "x" * 3000, "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İ ﬁ é 日本 😀", "a\x1cb\x85c\xa0d e", "\x01 a\x01b", "12 345", "the", " lead", "trail \n", "a \n b", "\t\t"]


@pytest.fixture(scope="module")
def word():
    return tokenizers.Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return tokenizers.Tokenizer.from_file(BYTE)


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, n_tokens string")


def test_encode_decode(frame, word):
    out = bpe_encode(frame, WORD, digests=True, decode=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    for r in out.collect():
        ids = word.encode(r.text or "", add_special_tokens=False).ids
        back = word.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), back)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    again = bpe_decode(out.drop("decoded"), WORD).select((F.col("decoded_sha256") == F.sha2("decoded", 256)).alias("same"))
    assert all(r.same for r in again.collect())


def test_empty_tables(frame):
    none = frame.filter("doc_id < 0")
    assert bpe_encode(none, WORD).count() == 0
    assert token_counts(none, BYTE).count() == 0


def test_counts(frame, byte):
    for r in token_counts(frame, BYTE, limit=3).collect():
        n = len(byte.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 3)


SOME = st.text(alphabet=st.one_of(st.sampled_from("abcAB  \n\t'strelvm.,!12Éé²Σ日\x1c\x85\xa0"), st.characters(codec="utf-8", exclude_categories=["Cs"])), max_size=30)


def test_every_code_point(word, byte):
    c, n = codec(open(WORD, "rb").read()), counter(open(BYTE, "rb").read())
    texts = [f"a{chr(i)}1" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        assert [x.tolist() for x in c.encode(part)] == [e.ids for e in word.encode_batch(part, add_special_tokens=False)]
        assert [n.count(t, False) for t in part] == [len(e.ids) for e in byte.encode_batch(part, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(SOME, max_size=4))
def test_like_the_library(word, byte, texts):
    import pyarrow as pa

    from xylem.llm.common import string_buffers

    c, n = codec(open(WORD, "rb").read()), counter(open(BYTE, "rb").read())
    assert [x.tolist() for x in c.encode(texts)] == [word.encode(t, add_special_tokens=False).ids for t in texts]
    easy = simple_rows(*string_buffers(pa.array(texts, pa.string())))
    assert [n.count(t, e) for t, e in zip(texts, easy.tolist(), strict=True)] == [len(byte.encode(t, add_special_tokens=False).ids) for t in texts]
    lib = repair.library(open(WORD, "rb").read())
    ids, sizes = lib.encode(*string_buffers(pa.array(texts, pa.string())))
    assert ids.tolist() == [i for t in texts for i in word.encode(t, add_special_tokens=False).ids]
    assert int(sizes.sum()) == len(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([1, 5, 6, 7, 49000]), max_size=60), min_size=1, max_size=5))
def test_grammar_round_trip(docs):
    rows = [np.array([*d, 1], np.uint32) for d in docs]
    flat = np.concatenate(rows)
    rules, body = repair.grammar(flat, 49408, 1, least=2)
    length = repair.expansions(rules, 49408)
    assert repair.expand(body, rules, length, 49408).tolist() == flat.tolist()
    s = repair.Shard(repair.pack(list(range(len(rows))), np.array([len(r) for r in rows]), flat, 49408, 1))
    assert s.all().tolist() == flat.tolist()
    assert [s.one(i).tolist() for i in range(len(rows))] == [r.tolist() for r in rows]


def test_small_memory_keeps_results(word):
    import pyarrow as pa

    from xylem.llm.common import string_buffers

    lib = repair.LibraryCodec(open(WORD, "rb").read(), chunks=8)
    texts = [" ".join(f"w{i}x{j}" for i in range(30)) for j in range(5)]
    for t in texts:
        ids, _ = lib.encode(*string_buffers(pa.array([t])))
        assert ids.tolist() == word.encode(t, add_special_tokens=False).ids


def test_chunks_of_one_hash(word, monkeypatch):
    """Chunks that share a hash get their own ids all the same (up to eight bytes none do)."""
    import pyarrow as pa

    from xylem.llm.common import string_buffers

    real = repair.span_hashes
    monkeypatch.setattr(repair, "span_hashes", lambda raw, a, b: np.where(b - a > 8, np.uint64(9), real(raw, a, b)))
    lib = repair.LibraryCodec(open(WORD, "rb").read())
    for texts in (["the catcatcatcat", "dogdogdogdog", "", "a  catcatcatcats sat"], ["sat catcatcatcat", "thethethethe x"]):
        ids, per = lib.encode(*string_buffers(pa.array(texts)))
        want = [word.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and per.tolist() == [len(w) for w in want]


def test_twin_words(spark, tmp_path, word):
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    twin = t.translate(str.maketrans("ab", "ba"))
    path = str(tmp_path / "twins")
    repair.write_token_files(spark.createDataFrame([(1, t), (2, twin)], "doc_id long, text string"), path, WORD)
    got = {r.doc_id: r.ids for r in repair.read_token_files(spark, path).collect()}
    assert got == {i: [*word.encode(x, add_special_tokens=False).ids, 1] for i, x in ((1, t), (2, twin))}


def test_copies_collapse():
    """A passage copied thousands of times costs a few symbols each time."""
    rng = np.random.default_rng(3)
    docs = [np.r_[rng.integers(2, 49000, 200), 1] for _ in range(20)]
    flat = np.concatenate([docs[i] for i in rng.integers(0, 20, 4000)]).astype(np.uint32)
    rules, body = repair.grammar(flat, 49408, 1)
    assert len(body) < len(flat) // 60
    assert repair.expand(body, rules, repair.expansions(rules, 49408), 49408).tolist() == flat.tolist()
    many = rng.integers(2, 49000, 40_000).astype(np.uint32)
    rules, body = repair.grammar(np.concatenate([many] * 40), 49408, 1, per_round=8000)
    assert 49408 + len(rules) > 1 << 16  # beyond two bytes
    assert repair.expand(body, rules, repair.expansions(rules, 49408), 49408).tolist() == [*many.tolist()] * 40


def test_token_files(spark, tmp_path, word):
    rows = [(i, t) for i, t in enumerate(CASES)][::-1] + [(3, "the"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "tokens")
    repair.write_token_files(df, path, WORD, shard_ids=40)
    got = repair.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*word.encode(t or "", add_special_tokens=False).ids, 1])
    for r in got:
        assert r.ids in texts[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    repair.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, WORD)
    assert repair.read_token_files(spark, path).count() == 0
