from pyspark.sql import functions as F

from leafmill.operators import pages as P

ENTRY = "id string, pos int, fields array<struct<k:string,v:string>>"
MANIFEST = "doc_id string, citation_key string, route string, parsed_markdown string, original_pdf string, original_tex string, source_sha256 string, parser string, parser_version string, created_at string"


def _pages(spark):
    entries = [("a", 1, [("title", "{A} title"), ("author", "Doe, J. and Roe, R."), ("eprint", "2101.00001"), ("date", "2021-05")]), ("a", 2, [("title", "second")]), ("b", 3, [("title", "B"), ("doi", "10.1/b"), ("year", "1999")]), ("c", 4, None)]
    return P.page_skeletons(spark.createDataFrame(entries, ENTRY), "2026-01-01")


def test_skeletons_evidence_and_edges(spark):
    pages = {r["citation_key"]: r for r in _pages(spark).collect()}
    a, b, c = pages["a"], pages["b"], pages["c"]
    assert (a["doc_id"], a["source"]["title"], a["source"]["year"], a["source"]["source_type"], len(a["source"]["authors"])) == ("arxiv:2101.00001", "A title", "2021", "arxiv_source", 2)
    assert (b["doc_id"], b["identifiers"]["arxiv"], b["identifiers"]["doi"]) == ("10.1/b", None, "10.1/b") and c["doc_id"] == "" and len(a["edges"]) == 8
    assert [r["citation_key"] for r in P.new_pages(_pages(spark), spark.createDataFrame([("a",), (None,)], "citation_key string")).orderBy("citation_key").collect()] == ["b", "c"]
    manifests = spark.createDataFrame([("x", "a", "pdf_mineru", "p.md", None, None, "s", "m", "1", "2024-01-02"), ("y", "a", "arxiv_source", "o.md", None, None, "s", "m", "1", "2023-01-02"), ("z", None, "r", "", "", "", "", "", "", "")], MANIFEST)
    filled = {r["citation_key"]: r for r in P.with_evidence(_pages(spark), manifests).collect()}
    assert filled["a"]["source"]["primary_evidence"] == "p.md" and filled["a"]["quality"]["metadata_conflicts"] == ["route fallback: arxiv_source -> pdf_mineru"] and filled["a"]["doc_id"] == "x"
    assert filled["b"]["source"]["primary_evidence"] == "" and filled["b"]["quality"]["needs_human_review"]
    gone = P.without_evidence(P.with_evidence(_pages(spark), manifests)).where("citation_key = 'a'").first()
    assert gone["source"]["primary_evidence"] == "" and gone["chunk_manifest"] == "" and gone["source"]["title"] == "A title"
    items = spark.createDataFrame([("a", "models", "local:x"), ("a", "models", "local:x"), ("a", "odd", " "), ("a", None, "q"), ("b", "models", None)], "citation_key string, category string, canonical_id string")
    edges = P.with_edges(_pages(spark), items)
    assert {tuple(r) for r in P.page_edges(edges).collect()} == {("a", "models", "local:x")}
    there = spark.createDataFrame([("models", "local_x")], "category string, name string")
    assert P.edge_pages(edges, there).first()["path"] == "summary/models/local_x.md" and P.edge_pages(edges, there.limit(0)).first()["path"] == ""
    rules = {(r["subject"], r["rule"]) for r in P.page_issues(edges, spark.createDataFrame([("other",)], "canonical_id string"), spark.createDataFrame([], "chunk_id string"), spark.createDataFrame([], "path string"), strict=True).collect()}
    assert rules == {("a", "unknown_edge_category"), ("a", "off_vocabulary"), ("b", "no_edges"), ("c", "no_edges")}


def test_claims(spark):
    body = "x\n```claim\nclaim_id: c1\nevidence:\n  - chunk_id: k1\n  - chunk_id: lost\n```\n```claim\nclaim_id: c2\n```\n```claim\nevidence:\n  - chunk_id:\n```\n"
    pages = spark.createDataFrame([("p", body), ("q", None), ("r", "none")], "citation_key string, body string")
    chunks = spark.createDataFrame([("k1",), (None,)], "chunk_id string")
    got = {(r["subject"], r["rule"], r["detail"]) for r in P.claim_issues(pages, chunks).collect()}
    assert got == {("p#c1", "missing_chunk", "lost"), ("p#c2", "claim_without_evidence", ""), ("p#<missing>", "evidence_without_chunk", "")}
    assert {r["rule"] for r in P.claim_issues(pages, chunks.limit(0)).collect()} == {"claim_without_evidence", "evidence_without_chunk"}


def test_bodies(spark):
    body = "# T\n\n## Key Results\n\n_To be filled._\n\n## Methods\n\nown text\n\n## Empty\n"
    df = spark.createDataFrame([(body, "r1\nr2", None)], "b string, r string, n string")
    got = df.select(P.fill_sections(F.col("b"), {"key results": F.col("r"), "methods": F.lit("no"), "empty": F.lit("e"), "trace index": F.lit("t"), "lost": F.col("n")})).first()[0]
    assert got == "# T\n\n## Key Results\n\nr1\nr2\n\n## Methods\n\nown text\n\n## Empty\n\ne\n\n## Trace Index\n\nt\n"
    assert df.select(P.fill_sections(F.col("n"), {"a": F.lit("b")})).first()[0] == "\n## A\n\nb\n"
    auto = f"keep k1\n{P.AUTO_BEGIN}\n- k1\n- k2\n{P.AUTO_END}\nkeep k1"
    scrub = lambda text, key: spark.createDataFrame([(text,)], "t string").select(P.scrub_auto(F.col("t"), F.lit(key))).first()[0]
    assert scrub(auto, "k1") == f"keep k1\n{P.AUTO_BEGIN}\n- k2\n{P.AUTO_END}\nkeep k1" and scrub("k1", "k1") == "k1" and scrub(auto, "") == auto
    states = spark.createDataFrame([(None,), ("",), ("x _No summary yet._",), ("done",)], "b string").select(P.is_placeholder(F.col("b")).alias("p"), P.summary_status(F.col("b")).alias("s")).collect()
    assert [(r["p"], r["s"]) for r in states] == [(True, "no source page"), (True, "summarized"), (True, "placeholder"), (False, "summarized")]
    one = spark.createDataFrame([((1, 2), (None, 5), None)], "d struct<a:int,b:int>, e struct<a:int,b:int>, n struct<a:int,b:int>").select(P.merged(F.col("d"), F.col("e"), ["a", "b"]).alias("m"), P.merged(F.col("d"), F.col("n"), ["a", "b"]).alias("k")).first()
    assert tuple(one["m"]) == (1, 5) and tuple(one["k"]) == (1, 2)


def test_page_texts(spark):
    texts = spark.createDataFrame([("a", 1, "Abstract\nWe measured the long thing with much care indeed.\n\nIntroduction\nx"), ("a", 2, "later"), (None, 3, "x")], "citation_key string, order int, text string")
    got = {r["citation_key"]: r for r in P.text_summaries(_pages(spark), texts).collect()}
    assert got["a"]["metadata"] == "A title (2021) by Doe, J., Roe, R.. Extracted abstract: We measured the long thing with much care indeed."
    assert got["a"]["findings"] == "- We measured the long thing with much care indeed." and "DOI: 10.1/b" in got["b"]["links"]
    assert got["b"]["metadata"].endswith("bibliographic metadata only.") and "We measured" in got["a"]["body"] and "## Methods" in got["a"]["body"]
