"""Token files, counts and the lexicon against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crosscut.llm import lexicon, token_counts, token_files
from crosscut.llm.bpe import Bpe

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
byte_lib, word_lib = tokenizers.Tokenizer.from_file(BYTES), tokenizers.Tokenizer.from_file(WORDS)
TEXTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'s", "É", "é", "1", "!!", ".", "<|endoftext|>", "\x01", " ", "\x1c", "中", "가", "aaa", "\x00", "Σ", "İ", "ing"]) | st.text(max_size=4), max_size=14).map("".join)


def ids(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec(tmp_path_factory):
    bpe, path = Bpe(BYTES), str(tmp_path_factory.mktemp("lexicon"))
    words = [w.encode() for w in (" the", " aaa", "ing", " ", ".", "the")]
    flat, n = bpe.merge(words)
    ends = np.cumsum(n)
    lexicon.Transducer.save(lexicon.Transducer.build({w: flat[e - k : e].tolist() for w, e, k in zip(words, ends, n)}), path)
    return lexicon.Codec(BYTES, path)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_kernels_agree_with_the_library(texts):
    counter, encoder = token_counts.Counter(BYTES), token_files.chunk_encoder(WORDS)
    assert counter(pa.array(texts, pa.string())).tolist() == [len(ids(byte_lib, t)) for t in texts]
    got, n = encoder(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == [ids(word_lib, t) for t in texts] if texts else len(got) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, max_size=5), st.lists(st.integers(0, 50256), max_size=8))
def test_codec_agrees_with_the_library(codec, texts, tokens):
    for t, x in zip(texts, codec.encode(pa.array(texts, pa.string()))):
        assert np.frombuffer(x, "<u4").tolist() == ids(byte_lib, t)
        assert codec.decode(x) == byte_lib.decode(ids(byte_lib, t), skip_special_tokens=False)
    assert codec.decode(np.array(tokens, "<u4").tobytes()) == byte_lib.decode(tokens, skip_special_tokens=False)


def test_memos_may_overflow():
    small = token_files.ChunkEncoder(WORDS, 2, 2)
    texts = ["one two three four", "five two, six. seven", "one two three four"]
    for _ in range(2):
        got, n = small(pa.array(texts))
        assert [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == [ids(word_lib, t) for t in texts]


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): [i] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "a", "ab"])}
    arrays = lexicon.Transducer.build(words)
    t = lexicon.Transducer(arrays)
    order = sorted(words)
    assert t.find(order).tolist() == list(range(len(order)))
    assert t.find([b"", b"ta", b"tapsx", b"zzz", b"\xff"]).tolist() == [-1] * 5
    assert len(arrays["final"]) < sum(len(w) for w in words) // 2  # suffixes are shared


def test_empty_lexicon():
    assert lexicon.Transducer(lexicon.Transducer.build({})).find([b"a", b""]).tolist() == [-1, -1]


def test_token_files(spark, odd, empty):
    path, parts = token_files.write_token_files(odd, WORDS, 1, partitions=3)
    got = token_files.read_token_files(path, parts).collect()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
    crc = lambda t: (len(i := [*ids(word_lib, t), 1]), zlib.crc32(np.array(i, "<u4").tobytes()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), *crc(t)) for d, t in rows)
    assert token_files.read_token_files(*token_files.write_token_files(empty, WORDS, 1)).count() == 0


def test_token_files_of_extreme_ids_and_many_slices(spark, monkeypatch):
    """The least and the greatest id stay themselves beside null; a doc_id may lie in several partitions; slices add up."""
    monkeypatch.setattr(token_files, "SLICE_BYTES", 50)
    rows = [(-(1 << 63), "least one"), ((1 << 63) - 1, "greatest one"), (None, "none"), (None, None)] + [(5, f"words of row {i % 40}") for i in range(300)] + [(6, "many words " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n in (None, 1, 9):
        got = token_files.read_token_files(*token_files.write_token_files(df, WORDS, 1, partitions=n)).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is None, d or 0))
        assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
        crc = lambda t: (len(i := [*ids(word_lib, t), 1]), zlib.crc32(np.array(i, "<u4").tobytes()))
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), *crc(t)) for d, t in rows)


def test_counts_and_codec_on_odd_tables(odd, empty):
    for r in token_counts.count_tokens(odd, BYTES, limit=3).collect():
        n = len(ids(byte_lib, r["text"] or "")) if "text" in r else None
        assert n is None or (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 3)
    out = lexicon.encode_decode(odd, BYTES)
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        i = ids(byte_lib, r["text"])
        assert (r["n_tokens"], r["decoded"]) == (len(i), r["text"] or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()
    assert token_counts.count_tokens(empty, BYTES).count() == lexicon.encode_decode(empty, BYTES).count() == 0
