import random

from weftline.llm import spans as S
from weftline.session import scratch


def brute(docs):
    """Maximal runs of characters in stretches of 200 that another doc_id's text holds."""
    where = {}
    for i, x in docs.items():
        for s in range(len(x) - 199):
            where.setdefault(x[s : s + 200], set()).add(i)
    out = set()
    for i, x in docs.items():
        a = b = None
        for s in range(len(x) - 199):
            if len(where[x[s : s + 200]]) > 1:
                if b is not None and s <= b:
                    b = s + 200
                else:
                    if b is not None:
                        out.add((i, a, b - a))
                    a, b = s, s + 200
        if b is not None:
            out.add((i, a, b - a))
    return out


def make(rnd, n, alphabet="abcdefghij klmno\n"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def corpus():
    rnd = random.Random(3)
    shared = [make(rnd, n) for n in (199, 200, 201, 260, 500, 900)]
    docs = {i: make(rnd, rnd.randrange(0, 700)) for i in range(40)}
    n = 100
    for s in shared:
        for _ in range(3):
            docs[n] = make(rnd, rnd.randrange(0, 300)) + s + make(rnd, rnd.randrange(0, 300))
            n += 1
    head = make(rnd, 250)  # a header that many texts begin with
    for i in range(60):
        docs[200 + i] = head + make(rnd, 40 + i)
    docs |= {300: "ab" * 300, 301: "ba" * 250, 302: "x" * 450, 303: "x" * 200, 304: "x" * 199}
    docs |= {310: shared[4] + shared[3], 311: shared[3] + shared[4], 312: shared[5][100:400] + shared[5][500:]}
    docs |= {320: "é🙂" * 120 + "tail", 321: "lead" + "é🙂" * 120, 322: docs[200], 323: docs[200], 324: "", 325: " " * 300}
    docs |= {330: shared[5] + "q" * 10 + shared[5], 331: "w" + shared[5][:450]}
    return docs


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, kin string, n int")
    got = [tuple(r) for r in S.shared_spans(spark, df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    rows = list(docs.items()) + [(1000, None), (None, docs[200]), (200, docs[200])]
    want = brute(docs)
    assert run(spark, rows) == want
    assert run(spark, rows, batches=5) == want  # with compaction of the runs
    monkeypatch.setattr(S, "SLICE_CHARS", 700)
    assert {(d, p) for d, p in zip(*(x.tolist() for x in S.fingerprints([docs[310]])[:2]))}  # a slice of its own


def test_long_texts_in_pieces(spark, monkeypatch):
    rnd = random.Random(9)
    long = make(rnd, 6000)
    docs = {1: long, 2: make(rnd, 100) + long[2000:4500] + make(rnd, 50), 3: long[5500:]}
    monkeypatch.setattr(S, "PIECE_CHARS", 1000)
    texts = [(i, i, t) for i, t in docs.items()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts]), pa.array([t[2] for t in texts])], names=["doc_id", "kin", "text"])
    cut = {(d, p, h) for b in S._print(iter([batch])) for d, p, h in zip(b["doc"].to_pylist(), b["pos"].to_pylist(), b["h"].to_pylist())}
    monkeypatch.setattr(S, "PIECE_CHARS", 1 << 25)
    whole = {(d, p, h) for b in S._print(iter([batch])) for d, p, h in zip(b["doc"].to_pylist(), b["pos"].to_pylist(), b["h"].to_pylist())}
    assert cut == whole
    assert run(spark, list(docs.items())) == brute(docs)


def test_append_gives_what_older_runs_hold(spark):
    rnd = random.Random(4)
    common = make(rnd, 400)
    frame = lambda *r: spark.createDataFrame(list(r), "doc_id bigint, text string")
    index = S.SpanIndex(spark, scratch(spark, "index"), 4)
    assert index.append(frame((1, common), (2, make(rnd, 300)))).count() == 0
    assert {r.doc for r in index.append(frame((3, "new" + common), (4, make(rnd, 300)))).collect()} == {1, 3}
    plan = index.append(frame((6, make(rnd, 300))))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan  # the new run is merge-joined with the older ones
    runs = index.manifest()["runs"]
    assert len(runs) == 2 and runs[0]["rows"] > runs[1]["rows"]  # the first two became one
    again = S.SpanIndex(spark, index.path, 99)  # opened again: same buckets, same rows
    assert again.buckets == 4 and {r.doc for r in again.append(frame((5, common + "z"))).collect()} == {1, 3, 5}
    index.close()
    again.close()


def test_a_later_batch_against_a_kept_index(spark):
    docs = corpus()
    old = {k: v for k, v in docs.items() if k % 3}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id bigint, text string")
    index = S.SpanIndex(spark, scratch(spark, "index"), 4)
    got = {tuple(r) for r in S.shared_spans(spark, frame(old), 2, index).collect()}
    assert got == brute(old)
    new = {k: v for k, v in docs.items() if not k % 3}
    more = {tuple(r) for r in S.shared_spans(spark, frame(new), 1, index, frame(docs)).collect()}
    index.close()
    cover = lambda spans: {(d, i) for d, a, n in spans for i in range(a, a + n)}
    assert cover(got) | cover(more) == cover(brute(docs))


def test_hash_of_many_texts_in_differing_surroundings(spark):
    """A header too short to be shared, and pairs that share a little more than it: hot rows meet by their stretches."""
    rnd = random.Random(11)
    head = make(rnd, 160)
    docs = {}
    for i in range(80):
        docs[i] = make(rnd, rnd.randrange(0, 60)) + head + make(rnd, 90 + i)
    for i in range(0, 40, 2):
        tail = make(rnd, 60)
        docs[100 + i] = "p" + head + tail + make(rnd, 50)
        docs[101 + i] = "q" + head + tail + make(rnd, 50)
    rows = [(d, d, t) for d, t in docs.items()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], names=["doc_id", "kin", "text"])
    first = pa.RecordBatch.from_arrays([c.slice(0, 60) for c in batch.columns], names=batch.schema.names)
    states = [s for b in S._print(iter([first, batch.slice(60)])) for s in b["state"].to_pylist()]
    assert S.HOT in states and S.MARK in states
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        for batches in (1, 3):
            assert {tuple(r) for r in S.shared_spans(spark, df, batches).collect()} == brute(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, "short"), (2, "short")]) == set()


def test_shares(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, ""), (3, None)], "doc_id bigint, text string")
    spans = spark.createDataFrame([(1, 0, 1), (1, 2, 1)], "doc_id bigint, span_start bigint, span_chars bigint")
    assert sorted(tuple(r) for r in S.shared_parts(docs, spans).collect()) == [(1, 4, 2, 0.5), (2, 0, 0, 0.0)]
