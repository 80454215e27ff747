from collections import Counter

from weftline.llm.mixing import mix_documents

SIZES = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "mix string, source string, weight double, max_repeats int, size_factor double"


def run(spark, sizes, targets):
    docs, shares = mix_documents(spark, spark.createDataFrame(sizes, SIZES), spark.createDataFrame(targets, TARGETS))
    return [tuple(r) for r in docs.collect()], {(r.mix, r.source): r for r in shares.collect()}


def test_shares_are_reached(spark):
    sizes = [(i, ("big", "mid", "small")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], 20 + i % 37) for i in range(6000)]
    sizes += [(9000, None, 500), (9001, "unlisted", 500), (9002, "big", 0)]
    targets = [("m", "big", 5.0, 1, 0.5), ("m", "mid", 3.0, 2, 0.5), ("m", "small", 2.0, 3, 0.5), ("m", "absent", 1.0, 4, 0.5),
               ("n", "big", 1.0, 1, 0.1), ("n", "small", 1.0, 2, 0.1), ("zero", "big", 0.0, 1, 1.0), (None, "big", 1.0, 1, 1.0)]
    docs, shares = run(spark, sizes, targets)
    total = sum(s[2] for s in sizes)
    tokens, most = Counter(), {}
    for mix, doc, source, n, repeats in docs:
        tokens[mix, source] += n * repeats
        most[mix, source] = max(most.get((mix, source), 0), repeats)
        assert repeats >= 1 and source == dict((s[0], s[1]) for s in sizes)[doc]
    caps = {(t[0], t[1]): t[3] for t in targets}
    weights = {"m": 11.0, "n": 2.0}
    for mix, source, weight, cap, factor in targets[:6]:
        want = weight / weights[mix] * factor * total
        have = sum(s[2] for s in sizes if s[1] == source)
        aim = min(want, cap * have)
        assert abs(tokens[mix, source] - aim) <= 60  # one document
        assert most.get((mix, source), 0) <= caps[mix, source]
        assert shares[mix, source].reached_tokens == tokens[mix, source]
    assert set(shares) == {(t[0], t[1]) for t in targets[:6]}
    # budgets of one source are nested
    small, large = ({d[1] for d in docs if d[0] == m and d[2] == "big"} for m in ("n", "m"))
    assert small < large


def test_one_heavy_document_and_repeats(spark):
    docs, shares = run(spark, [(1, "a", 1000), (2, "b", 10)], [("m", "a", 1.0, 3, 2.0), ("m", "b", 1.0, 50, 2.0)])
    assert Counter({(d[1], d[4]) for d in docs}) == Counter({(1, 1): 1, (2, 50): 1})
    assert shares["m", "b"].reached_tokens == 500 and shares["m", "b"].most_repeats == 50


def test_empty(spark):
    assert run(spark, [], []) == ([], {})
    docs, shares = run(spark, [], [("m", "a", 1.0, 1, 1.0)])
    assert docs == [] and shares["m", "a"].reached_tokens == 0 and shares["m", "a"].reached_share is None
    assert run(spark, [(1, "a", 5)], [])[0] == []
