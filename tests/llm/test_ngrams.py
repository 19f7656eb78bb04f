import re
from collections import Counter

from leafmill.llm import ngrams as N


def brute_force(texts, max_n):
    occurrences, records = Counter(), Counter()
    for text in texts:
        terms = [t for t in (x.lower().strip("._+-") for x in re.findall(r"[\w.+-]+", text or "")) if len(t) >= 2]
        own = [" ".join(terms[i : i + n]) for n in range(1, max_n + 1) for i in range(len(terms) - n + 1)]
        occurrences.update(own)
        records.update(set(own))
    return {t: (occurrences[t], records[t]) for t in occurrences}


TEXTS = ["The red-blue fox; the fox. a b", None, "", "..", "the the the", "Ünï_code x 3.14 fox", "the red-blue fox", "word " * 50_000] + ["hot term"] * 300


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "id int, text string, cnt int, t1 string").repartition(5)
    for n in (1, 2, 3):
        got = {r["term"]: (r["occurrences"], r["records"]) for r in N.term_frequencies(df, ["text"], n).collect()}
        assert got == brute_force(TEXTS, n)


def test_small_flushes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "FLUSH_SUFFIXES", 3)
    df = spark.createDataFrame([(t,) for t in TEXTS[:8]], "text string").coalesce(1)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in N.term_frequencies(df, ["text"], 2).collect()}
    assert got == brute_force(TEXTS[:8], 2)


def test_marks_and_fields(spark):
    df = spark.createDataFrame([("aa bb", "tt")] * 3 + [("aa", None)] * 7, "text string, section_title string")
    marked = {(r["field"], r["term"]): r["mark"] for r in N.mark_terms(N.term_frequencies(df, ["text", "section_title"], 1), 10).collect()}
    assert marked == {("text", "aa"): "common", ("text", "bb"): "common", ("section_title", "tt"): "common"}
    marked = {r["term"]: r["mark"] for r in N.mark_terms(N.term_frequencies(df, ["section_title"], 1), 15).collect()}
    assert marked == {"tt": None}  # a fifth isn't more than a fifth


def test_empty_table(spark):
    assert N.term_frequencies(spark.createDataFrame([], "text string"), ["text"]).count() == 0
