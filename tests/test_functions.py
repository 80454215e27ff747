import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.bitmap import Bitmap
from weftline.functions.jsonvalue import canonical
from weftline.functions.structural import StructuralIndex

sets = st.one_of(
    st.sets(st.integers(0, 300_000), max_size=300),
    st.tuples(st.integers(0, 100_000), st.integers(0, 20_000)).map(lambda t: set(range(t[0], t[0] + t[1]))),
)


@settings(max_examples=60, deadline=None)
@given(sets, sets)
def test_bitmap_is_a_set(a, b):
    x, y = (Bitmap.of(np.array(sorted(s), np.int64)) for s in (a, b))
    assert x.and_not(y).ordinals().tolist() == sorted(a - b)
    assert x.and_(y).ordinals().tolist() == sorted(a & b)
    assert len(x) == len(a)


def test_canonical_json():
    assert canonical('{"a": 1, "b": [1.0, 2e1]}') == canonical('{"b":[1,20],"a":1.00}')
    assert canonical('{"a": "na\\u00efve"}') == canonical('{"a":"naïve"}')
    assert canonical('{"a": 1}') != canonical('{"a": "1"}')
    assert canonical('{"a": true}') != canonical('{"a": 1}')
    assert canonical('{"a": null}') != canonical("{}")
    assert canonical(None) is None and canonical("null") is not None
    assert canonical("{broken") != canonical("{broken ")


values = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4),
    max_leaves=15,
)


def _valid(x: str) -> bool:
    def refuse(_):
        raise ValueError

    try:
        json.loads(x, parse_constant=refuse)
        return True
    except (ValueError, RecursionError):
        return False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(values, st.integers(0, 60), st.sampled_from('"\\[]{},: 1ae-.\n\x01')), min_size=1, max_size=6), st.booleans())
def test_structural_validity(cases, spoil):
    texts = []
    for v, at, c in cases:
        x = json.dumps(v, ensure_ascii=bool(at % 2), indent=at % 3 or None)
        if spoil:
            at %= len(x) + 1
            x = x[:at] + c + x[at + (at % 2) :]
        texts.append(x)
    index = StructuralIndex([t.encode("utf-8", "replace") for t in texts])
    assert index.valid.tolist() == [_valid(t) for t in texts]


def test_structural_values():
    s = StructuralIndex([b'{"a": [1, {"b": "x\\"y"}, null], "a": [true]}', b"", b"[1,]", b'{"k": {"a": 2}}'])
    assert s.valid.tolist() == [True, False, False, True]
    parent, child = s.child(s.roots(), "a")
    assert [s.text(c) for c in child] == ["[true]"]  # the last of a repeated key
    _, e = s.elements(child)
    assert [(s.text(v), s.pos[v]) for v in e] == [("true", 0)]
    assert StructuralIndex([]).valid.size == 0


def _one(spark, expr, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(expr).first()[0]


def test_text_expressions(spark):
    v = F.col("v")
    assert X.tokenize("  Foo_bar, baz/Baz  ") == ["foo_bar", "baz", "baz"]
    assert X.tokenize("") == []
    assert X.without_connectors('find a "to the" b') == 'find "to the" b'
    assert [X.term_kind(w) for w in ("/api/x", "src/a.ts", "--flag", "a.toml", "camelCase", "word")] == ["route", "path", "command", "artifact", "symbol", "word"]
    assert _one(spark, X.lines(v), "a\r\nb\n") == ["a", "b"]
    assert _one(spark, X.lines(v), "") == []
    assert _one(spark, X.lines(v), "a\n\n") == ["a", ""]
    assert _one(spark, X.lines(v), None) is None
    assert _one(spark, X.literal_pieces(v, "\\E."), "a\\E.b") == ["a", "b"]
    assert _one(spark, X.literal_pieces(v, "aa"), "aaa") == ["", "a"]
    assert _one(spark, X.shorten(v), "x " * 100) == ("x " * 100)[:117] + "..."
    assert _one(spark, X.normalize(v), "a/./b//../c/../../d") == "d"
    assert _one(spark, X.normalize(v), "../a") == "../a"
    assert _one(spark, X.encode_component(v), "a b!'()*~é/") == "a%20b!'()*~%C3%A9%2F"
    paths = {"a/b.ts": True, "/a": False, "a\\b": False, "C:/a": False, "a/../b": False, "a//b": False, "": False}
    for p, good in paths.items():
        assert _one(spark, X.canonical_path(v), p) is good
