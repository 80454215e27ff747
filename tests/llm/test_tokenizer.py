import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import tokenizer as T

tokenizers = pytest.importorskip("tokenizers")
own = T.Tokenizer()
reference = tokenizers.Tokenizer.from_file(f"{T.DEFAULT_FOLDER}/byte_bpe_50k.json")
reference.encode_special_tokens = True

ODD = ["", " ", "\n\n \t x", "<|endoftext|> plain", "don't they'll I'M", "naïve größe 日本語 ру́сский 🙂🙂", "a\u0085b\u00a0c\u2028d", "x" * 5000, "ab" * 3000 + " " * 300,
       "\x1c\x1d\x00\x0b", "1234567 3.14e-5", "\r\n\r\nend \r\n", "fooBarBaz_quux(z)=>{}", "e\u0301\u200d\ufeff"]


def ids(texts):
    flat, off = own.encode(texts)
    return [flat[off[i] : off[i + 1]].tolist() for i in range(len(texts))]


def expected(texts):
    return [e.ids for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts():
    assert ids([*ODD, None]) == expected([*ODD, None])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="aeinorst '\n", max_size=80), max_size=5))
def test_any_text(texts):
    assert ids(texts) == expected(texts)


def test_pair_check_is_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, len(own.tokens), (2, 4000))
    fits = own.compatible(a, b)
    for x, y, f in zip(a.tolist(), b.tolist(), fits.tolist()):
        assert f == (own._merge(own.tokens[x] + own.tokens[y]) == [x, y])


def test_exact_merging_ways_agree():
    words = ["internationalization", "xqzjv", "aaaaaaaaaaaaaaaa", "größebrai", "a", "the"]
    raw = [w.encode() for w in words]
    token, sizes = own._merge_all(raw)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, r in enumerate(raw):
        assert token[at[i] : at[i + 1]].tolist() == own._merge(r) == own._merge_long(r)


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    monkeypatch.setattr(T, "SLICE_CHARS", 50)
    text = "".join(f"line {i}'s  end\n\n  next\t{i}\r\n" for i in range(200))
    assert len(list(T._pieces(text))) > 50
    assert ids([text]) == expected([text])


def test_operator(spark):
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "hello world", "a", "b"), (3, "hello world", "a", "b"), (None, "x", "a", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens string")
    got = sorted(((r.doc_id, list(r.ids)) for r in T.encode_texts(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, expected(["hello world"])[0]), (3, expected(["hello world"])[0]), (None, expected(["x"])[0])], key=str)
    counts = T.count_tokens(df.select("doc_id", "text"), "text").collect()
    assert sorted(r.n_tokens for r in counts) == [0, 0, 1, 2, 2]
    assert T.encode_texts(df.limit(0), "doc_id", "text").count() == 0
