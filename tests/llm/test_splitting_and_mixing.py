import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing as M
from leafmill.llm import splitting as S
from leafmill.llm.tokens import TOKEN, token_count

PAGE = "# Head\n\nOne sentence here. Another one, with a clause; and more.\n\nNext paragraph\nwith a line break. " * 12


def test_tokens_agree_between_jvm_and_python(spark):
    texts = ["a_b c-d", "Ünï 3.14!", "...", "", None, "x y z", "日本語 text", PAGE]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    assert got == [len(TOKEN.findall(t or "")) for t in texts]


@pytest.mark.parametrize(("limit", "overlap"), [(40, 0), (40, 8), (7, 3), (1, 0), (5, 99)])
def test_pieces_cover_overlap_and_stay_under_the_limit(limit, overlap):
    for text in (PAGE, "word " * 200, "x" * 50 + "," * 9 + "yy " * 40):
        tokens, pieces = TOKEN.findall(text), S.split_text(text, limit, overlap)
        at = 0
        for i, (start, end, n, shared) in enumerate(pieces):
            own = TOKEN.findall(text[start:end])
            assert len(own) == n <= limit
            assert shared == (min(overlap, limit - 1, at) if i else 0)
            assert own == tokens[at - shared : at - shared + n]
            at += n - shared
        assert at == len(tokens) and pieces[0][0] == 0 and pieces[-1][1] == len(text)


def test_cuts_cost_least():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, limit, overlap = 14, 6, 1
        penalty = rng.choice([0.05, 0.3, 0.8], n + 1)
        penalty[0] = penalty[n] = 0.0
        pieces = 1 + -(-(n - limit) // (limit - overlap))
        even = min(limit - overlap, n / pieces)

        def cost(cuts):
            if cuts[1] > limit or any(b - a > limit - overlap for a, b in zip(cuts[1:], cuts[2:], strict=False)):
                return np.inf
            return sum(S.BALANCE * ((b - a - even) / limit) ** 2 + penalty[b] + 1.0 for a, b in zip(cuts, cuts[1:], strict=False))

        best = min((cost([0, *c, n]) for k in range(1, 7) for c in itertools.combinations(range(1, n), k)))
        assert cost(S.choose_cuts(penalty, limit, overlap)) == pytest.approx(best)


def test_split_table(spark):
    docs = spark.createDataFrame([(1, PAGE, "a", "z"), (1, PAGE, "a", "z"), (2, "short", "a", "z"), (3, None, "a", "z"), (4, PAGE, None, "z"), (5, PAGE, "other", "z"), (6, "", "a", "z")], "doc_id int, text string, doc_kind string, kind string")
    limits = spark.createDataFrame([("a", 40, 5), ("a", 50, 5), ("b", 1, 0)], "doc_kind string, max_tokens int, overlap_tokens int")
    pieces = S.split_oversized(docs, limits)
    assert {r["doc_id"] for r in pieces.collect()} == {1} and pieces.agg(F.max("n_tokens")).first()[0] <= 40
    assert pieces.where("piece_no = 1").count() == 2
    assert S.split_oversized(docs.limit(0), limits).count() == 0 and S.split_oversized(docs, limits.limit(0)).count() == 0


def _mix(spark, docs, targets, budget=None, **names):
    d = spark.createDataFrame(docs, "doc_id int, text string, source string, upto int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return M.mix_sources(d, t, budget), t


def test_shares_repeats_and_budget(spark):
    docs = [(i, "tok " * (1 + i % 9), "big", 1) for i in range(900)] + [(1000 + i, "tok " * 5, "small", 1) for i in range(40)] + [(5000, "x", "unused", 1), (5001, None, "big", 1), (5002, "", "small", 1), (5003, "x", None, 1)]
    mix, targets = _mix(spark, docs, [("big", 0.7, 1), ("small", 0.3, 4), ("absent", 0.5, 2)])
    rows = mix.orderBy("position").collect()
    total = sum(r["tokens"] for r in rows)
    shares = {s: sum(r["tokens"] for r in rows if r["source"] == s) / total for s in ("big", "small")}
    assert shares["big"] == pytest.approx(0.7, abs=0.02) and shares["small"] == pytest.approx(0.3, abs=0.02)
    assert max(r["use"] for r in rows) <= 4 and len({(r["doc_id"], r["use"]) for r in rows}) == len(rows)
    assert [r["position"] for r in rows] == list(itertools.accumulate(r["tokens"] for r in rows))
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    reported = {r["source"]: r["actual_share"] for r in M.mix_shares(mix, targets).collect()}
    assert reported["absent"] == 0 and reported["big"] == pytest.approx(shares["big"])


def test_small_buckets_give_the_same_mix(spark, monkeypatch):
    docs = [(i, "tok " * (1 + i % 7), "ab"[i % 2], 1) for i in range(200)]
    want = [tuple(r) for r in _mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], 300)[0].orderBy("position").collect()]
    monkeypatch.setattr(M, "BUCKET_ROWS", 7)
    got = [tuple(r) for r in _mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], 300)[0].orderBy("position").collect()]
    assert got == want and got[-1][-1] <= 300


def test_budget_beyond_all_and_empty(spark):
    docs = [(1, "a b c", "s", 1)]
    assert _mix(spark, docs, [("s", 1.0, 3)], 10**9)[0].count() == 3
    assert _mix(spark, [], [("s", 1.0, 3)])[0].count() == 0
    assert M.served_at(20, [(5, 0.5), (100, 0.5)]) == pytest.approx(30)
