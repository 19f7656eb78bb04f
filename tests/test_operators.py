import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as V
from leafmill.operators import chunking as C
from leafmill.operators import context as X
from leafmill.operators import phrases as P
from leafmill.operators import records as R
from leafmill.operators import search as S
from leafmill.operators import vocabulary as W


def test_bm25_equals_its_formula(spark):
    texts = ["red apple apple tree", "green tree", "", None, "apple"]
    got = {r["id"]: r["bm25"] for r in S.bm25(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "apple apple tree", "id", "text").collect()}
    docs = [(t or "").split() for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    for i, words in enumerate(docs):
        want, counts = 0.0, Counter(words)
        for term in ["apple", "apple", "tree"]:
            df = sum(term in w for w in docs)
            if counts[term]:
                want += math.log(1 + (5 - df + 0.5) / (df + 0.5)) * counts[term] * 2.5 / (counts[term] + 1.5 * (0.25 + 0.75 * max(len(words), 1) / max(mean, 1)))
        assert got[i] == pytest.approx(want)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, text string")
    assert S.bm25(empty, "apple", "id", "text").count() == 0
    assert S.tfidf(empty, "apple", "id", "text").count() == 0


def test_search_leaves_references_out(spark):
    rows = [(1, "c1", "Results", "results", "the apple threshold rises in the field"), (2, "c2", "References", "references", "apple threshold"), (3, "c1", "Results", "results", "apple threshold once more")]
    chunks = spark.createDataFrame(rows, "row_id int, chunk_id string, section_title string, section_type string, text string")
    hits = [r["row_id"] for r in S.search_chunks(chunks, "apple threshold").collect()]
    assert len(hits) == 1 and hits[0] in (1, 3)
    assert 2 in [r["row_id"] for r in S.search_chunks(chunks, "apple threshold", include_low_quality=True).collect()]


def test_cosine_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.normal(size=(40, 8))
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "vec_id int, embedding array<double>")
    got = S.cosine_top_k(v, v.where("vec_id % 10 = 0"), 3).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(0, 40, 10):
        best = [int(i) for i in np.argsort(-(unit @ unit[q])) if i != q][:3]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best


TEXT = "Preamble line.\n\n# One\nFirst sentence here. Second one follows! Third?\n\n## Two ##\n\nBody of two.\n"


def test_sections_cover_the_text(spark):
    rows = C.explode_sections(spark.createDataFrame([(1, TEXT), (2, "no heading"), (3, None), (4, "")], "id int, text string"), "id", "text").orderBy("id", "section_no").collect()
    first = [r for r in rows if r["id"] == 1]
    assert [r["title"] for r in first] == ["Document", "One", "Two"]
    assert "".join(TEXT[r["char_start"] : r["char_end"]] for r in first) == TEXT
    assert [r["title"] for r in rows if r["id"] == 2] == ["Document"] and not [r for r in rows if r["id"] == 3]


def test_packing_respects_size_and_covers(spark):
    text = " ".join(f"Sentence number {i} of the text." for i in range(60))
    pieces = [tuple(p) for p in spark.createDataFrame([(text,)], "t string").select(C.pack(F.col("t"), 200, 40)).first()[0]]
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(end - start <= 200 for start, end in pieces)
    assert all(b[0] <= a[1] and a[1] - b[0] <= 40 for a, b in zip(pieces, pieces[1:], strict=False))
    chunks = C.build_chunks(spark.createDataFrame([(1, TEXT), (2, "  ")], "doc_id int, text string"), "doc_id", F.lit("d"), "text", 30, 0).collect()
    assert [c["chunk_index"] for c in chunks] == list(range(1, len(chunks) + 1)) and len({c["chunk_id"] for c in chunks}) == len(chunks)


def test_record_keys(spark):
    rows = [("a", 1, [("title", "T One"), ("doi", "10.1234/x")]), ("b", 2, [("title", "t  one"), ("eprint", "2101.00001")]), ("c", 3, [("doi", "10.48550/arXiv.2101.00001")]), ("d", 4, []), ("e", 5, None)]
    m = R.manifest_records(spark.createDataFrame(rows, "id string, pos int, fields array<struct<k:string,v:string>>"))
    got = {r["key"]: (r["doi"], r["arxiv"], r["title_norm"]) for r in m.collect()}
    assert got["a"] == ("10.1234/x", "", "t one") and got["c"] == ("", "2101.00001", "") and got["d"] == ("", "", "")
    match = {r["key"]: (r["match_kind"], r["existing_key"]) for r in R.multi_key_match(m, m).collect()}
    assert match["b"] == ("arxiv", "b") and match["c"] == ("arxiv", "b")
    assert [r["unique_key"] for r in R.unique_keys(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "base string, o int"), "base", "o").orderBy("o").collect()] == ["x", "x-2", "y"]


def test_budget(spark):
    rows = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("h", 1, 200)], "g string, rank int, size int")
    kept = {(r["g"], r["rank"], r["cut"]) for r in X.within_budget(rows, F.col("size"), 100, ["g"], ["rank"]).collect()}
    assert kept == {("g", 1, False), ("h", 1, True)}
    with pytest.raises(ValueError):
        X.context_pack(rows, rows, rows)


def test_phrases(spark):
    df = spark.createDataFrame([("cryogenic muon detector rises; cryogenic muon detector falls",)], "t string")
    counts = {r["term"]: r["count"] for r in P.phrase_counts(df, "t").collect()}
    assert counts["cryogenic muon"] >= 2
    assert all("experiments" not in t.split() for t in counts)
    useful = spark.createDataFrame([("cryogenic muon", 2, "cryogenic muon", False, 20.0), ("cryogenic muon veto", 2, "cryogenic muon veto", False, 25.0), ("phonon flux", 9, "phonon flux", False, 30.0)], "term string, count long, norm string, protected boolean, quality double")
    assert {r["term"] for r in P.undominated(useful).collect()} == {"cryogenic muon veto", "phonon flux"}


def _phrases_by_hand(texts):
    word = r"(?:[A-Z][A-Za-z0-9+-]{2,}|[a-z][a-z0-9+-]{3,})"
    found = Counter()
    for text in texts:
        for m in re.finditer(rf"\b{word}(?:[\s/-]+{word}){{0,4}}\b", text):
            whole = re.sub(r"\s+", " ", m[0]).strip(" -/")
            parts, seen = whole.split(), set()
            for n in range(len(parts), 0, -1):
                for i in range(len(parts) - n + 1):
                    own = parts[i : i + n]
                    if len(whole) < 4 or (n < len(parts) and (n < 2 or len(" ".join(own)) < 4)):
                        continue
                    while len(own) > 1 and own[0].lower() in V.EDGE_WORDS:
                        own = own[1:]
                    while len(own) > 1 and own[-1].lower() in V.EDGE_WORDS + V.TRAILING_WORDS:
                        own = own[:-1]
                    low = " ".join(own).lower()
                    if low not in seen and not set(low.split()) & set(V.STOPWORDS):
                        seen.add(low)
                        found[low] += 1
    return found


def test_phrase_counts_equal_a_count_by_hand(spark):
    texts = ["The first RELICS run: low-threshold Time-Projection Chamber/veto detector, a single\nelectron signal.", "RELICS (RELICS). Ünter the über-cooled H2O2 target, phonon flux of 3 keV", "", None, "muon/neutron - background+ rate", "x" * 50 + " " + "word " * 300]
    got = Counter()
    for r in P.phrase_counts(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect():
        got[r["term"].lower()] += r["count"]
    assert got == _phrases_by_hand([t for t in texts if t])


def test_acronyms_stay_and_fragments_go(spark):
    df = spark.createDataFrame([("(RELICS).",)] * 5 + [("phonon flux limit",)] * 3, "t string")
    useful = P.useful_phrases(P.phrase_counts(df, "t"))
    assert ("RELICS", 5) in {(r["term"], r["count"]) for r in useful.collect()}
    assert [r["term"] for r in P.extract_terms([(df, "t")], 5).collect()][0] in ("RELICS", "phonon flux limit")
    rows = [(f"aa bb{i} cc dd", f"aa bb{i} cc dd", 9, 90.0 - i, False) for i in range(30)] + [(f"bb{i} cc", f"bb{i} cc", 9, 50.0 - i, False) for i in range(30)] + [("zz yy", "zz yy", 1, 1.0, False), ("bb3 cc dd", "bb3 cc dd", 1, 0.5, True)]
    phrases = spark.createDataFrame(rows, "term string, norm string, count long, quality double, protected boolean")
    for limit, front in ((40, 400), (40, 3), (5, 2), (31, 7)):
        got = [r["term"] for r in P.without_fragments(phrases, limit, front).orderBy("rank").collect()]
        assert got == ([f"aa bb{i} cc dd" for i in range(30)] + ["zz yy", "bb3 cc dd"])[:limit]
    assert P.without_fragments(phrases.limit(0)).count() == 0

def test_similarity_guards(spark):
    pairs = [("elastic scattering", "inelastic scattering"), ("cross section", "Cross sections"), ("muon", "Muon detector"), ("elastic neutrino scattering", "elastic neutrino scattering rates")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(W.match_score(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.0 and got[1] == 1.0 and got[2] == 0.0 and 0.8 < got[3] < 1.0


def test_best_similar_equals_all_pairs(spark):
    labels = ["Elastic neutrino scattering rates", "Neutrino scattering", "Muon veto detector", "Cross section", "Total cross section"]
    terms = spark.createDataFrame([(i, f"id{i}", label) for i, label in enumerate(labels)], "pos int, canonical_id string, label string")
    asked = ["elastic neutrino scattering", "cross sections", "veto muon detector", "unknown thing", None]
    mentions = spark.createDataFrame([(a,) for a in asked], "raw_term string")
    got = {r["raw_term"]: r["canonical_id"] for r in W.best_similar(mentions, terms).collect()}
    all_pairs = mentions.where("raw_term IS NOT NULL").crossJoin(terms).withColumn("s", W.match_score(F.col("raw_term"), F.col("label"))).where(F.col("s") >= W.LEAST_SIMILARITY)
    want = {r["raw_term"]: r["b"]["canonical_id"] for r in all_pairs.groupBy("raw_term").agg(F.max(F.struct("s", (-F.col("pos")).alias("p"), "canonical_id")).alias("b")).collect()}
    assert got == want and "cross sections" in got
