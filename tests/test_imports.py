import json

import pytest

from leafmill.operators import records as R
from leafmill.plans import changes as P
from leafmill.plans import imports as M

KV = "array<struct<k:string,v:string>>"


def test_provider_rows(spark):
    hit = {"id": 7, "metadata": {"control_number": 12, "titles": [{"title": "T"}, {"title": "U"}], "authors": [{"full_name": "A, B."}, {"full_name_unicode_normalized": "c"}, {"full_name": " "}] + [{"full_name": f"N{i}"} for i in range(9)], "preprint_date": "2020-03-01", "publication_info": [{"year": 2021}], "dois": [{"value": "https://doi.org/10.1234/AB."}], "arxiv_eprints": [{"value": "arXiv:2003.00001v2"}]}}
    rows = [(json.dumps(hit),), ("{}",), ("no json",), (None,), (json.dumps({"metadata": {"control_number": "5", "imprints": [{"date": "1999-01"}], "preprint_date": "2000"}}),)]
    got = M.provider_rows(spark.createDataFrame(rows, "hit string")).collect()
    assert tuple(got[0])[1:] == ("7", "T", ["A, B.", "c", "N0", "N1"], "2020", "10.1234/ab", "2003.00001v2", "12")
    assert all(tuple(r)[1:] == ("", "", [], "", "", "", "") for r in got[1:4]) and (got[4]["record_id"], got[4]["pub_year"]) == ("5", "1999")
    results = spark.createDataFrame([(i,) for i in range(5)], "n int")
    assert M.nth_result(results, 2, ["n"]).first()["n"] == 1
    for n in (0, 6):
        with pytest.raises(ValueError):
            M.nth_result(results, n, ["n"])


def test_inputs_planned_and_applied(spark):
    batch = spark.createDataFrame([(1, [("ID", "a"), ("title", "Old")], "zip_batch", None), (2, [("ID", "a"), ("title", "New one")], "bib_file", "r"), (3, [("ID", "b"), ("title", "New one")], "bib_file", ""), (4, None, None, None)], f"cand_id long, entry {KV}, source string, record_id string")
    results = spark.createDataFrame([(9, "Third", ["Mör, J.", "K"], "2020", None, "", "x")], "result_id long, title string, authors array<string>, pub_year string, doi string, arxiv string, record_id string")
    entries = spark.createDataFrame([("a", 1, [("title", "old")]), ("mör2020", 2, [("title", "z")]), ("mör2020-2", 3, [("title", "y")])], f"id string, pos int, fields {KV}")
    plan = M.planned_imports(M.import_inputs(batch, results), entries)
    got = {r["cand_id"]: (r["origin"], r["manifest_action"], r["duplicate_of"]) for r in plan.collect()}
    assert got[1] == ("zip", "skip-duplicate", "a") and got[2] == ("bib", "append", "") and got[3] == ("bib", "skip-duplicate", "2") and got[9] == ("search", "append", "")
    keys = [r["id"] for r in M.applied_imports(plan, entries).orderBy("pos").collect()]
    assert keys == ["a", "mör2020", "mör2020-2", "a-2", "untitled", "mör2020-3"]


def test_unique_keys_pass_over_keys_that_are_there(spark):
    rows = [("x", 1), ("x", 2), ("x", 3), ("x-2", 4), ("x-2", 5), ("y", 6)]
    got = [r["unique_key"] for r in R.unique_keys(spark.createDataFrame(rows, "b string, o int"), "b", "o").orderBy("o").collect()]
    assert got == ["x", "x-3", "x-4", "x-2", "x-2-2", "y"] and len(set(got)) == 6


def test_caches_upserts_and_attachments(spark):
    cache = spark.createDataFrame([("d", "1", "5feceb66ffc86f38d952786c6d696c79c2dbc239dd4e91b46729d73a27fb57e9"), (None, "1", "x")], "doc_id string, parser_version string, source_sha256 string")
    wanted = spark.createDataFrame([("d", "1", "0"), ("d", "2", "0"), ("d", "1", "1"), ("e", "1", None)], "doc_id string, parser_version string, content string")
    assert [r["hit"] for r in M.valid_cache(wanted, cache).orderBy("doc_id", "parser_version", "content").collect()] == [True, False, False, False]
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    assert {tuple(r) for r in M.upserted(old, new, "k", "v").collect()} == {("a", 1), ("b", 3), ("c", 1)}
    items = spark.createDataFrame([("i", ["x"]), ("j", None)], "item string, links array<string>")
    attachments = spark.createDataFrame([("x", None, "C:\\f\\one.pdf"), ("y", "j", "files/two.pdf"), ("z", "nobody", "one.pdf"), ("x", "i", "one.pdf")], "attachment string, of string, path string")
    files = spark.createDataFrame([("/t/one.pdf",), ("/t/two.pdf",)], "path string")
    assert {tuple(r) for r in M.linked_attachments(items, attachments, files).collect()} == {("i", "/t/one.pdf"), ("j", "/t/two.pdf")}


def test_terms_tags_and_cached_concepts(spark):
    terms = spark.createDataFrame([(1, "physh:1", "Dark matter", "research_areas", ["wimp"])], "pos int, canonical_id string, label string, category string, aliases array<string>")
    resolved = spark.createDataFrame([("physh:1", "Other", "c", "x"), ("physh:2", "dark matter ", "c", "x"), ("physh:3", "Muon", "c", "muons"), ("physh:3", "Muon", "c", "Muon"), ("", "q", "c", "q")], "canonical_id string, label string, category string, raw_term string")
    assert [(r["canonical_id"], r["aliases"]) for r in M.appended_terms(terms, resolved).collect()] == [("physh:3", [])]
    tags = spark.createDataFrame([("k", " wimp "), ("k", "wimp"), ("k", "odd thing"), ("k", " "), ("k", None)], "citation_key string, tag string")
    assert {(r["tag"], r["canonical_id"], r["confidence"]) for r in M.migrated_tags(tags, terms).collect()} == {("wimp", "physh:1", 1.0), ("odd thing", "local:odd-thing", 0.0)}
    cache = spark.createDataFrame([("muon flux", 2, "b", "B"), ("Muon Flux", 1, "a", "A"), ("flux", 1, "f", "F")], "query string, rank int, canonical_id string, label string")
    got = {r["raw_term"]: (r["cached_id"], r["by_word"]) for r in M.cached_concepts(spark.createDataFrame([(" muon flux",), ("the flux",), ("none",), (None,)], "raw_term string"), cache).collect()}
    assert got == {" muon flux": ("a", False), "the flux": ("f", True), "none": (None, None), None: (None, None)}


def test_updates_by_time_and_provider_titles(spark):
    entries = spark.createDataFrame([("a", [("year", "1"), ("doi", "d")])], f"id string, fields {KV}")
    updates = spark.createDataFrame([("a", "year", "9", 1), ("a", "year", "2", 2), ("a", "note", "n", 1)], "key string, field string, new_value string, at int")
    assert [tuple(x) for x in P.apply_updates(entries, updates).first()["fields"]] == [("year", "2"), ("doi", "d"), ("note", "n")]
    records = R.manifest_records(spark.createDataFrame([("a", 1, [("title", "Some work")]), ("b", 2, [("title", "Some work"), ("doi", "10.1234/b")])], f"id string, pos int, fields {KV}"))
    found = spark.createDataFrame([(1, "10.1234/b", None, "77", "Else"), (2, None, "2001.00001", None, "Some Work!")], "result_id int, doi string, arxiv string, control_number string, title string")
    got = {(r["key"], r["field"], r["new_value"], r["action"]) for r in P.provider_plan(records, found).collect()}
    assert got == {("b", "inspire", "77", "fill"), ("a", "eprint", "2001.00001", "fill")}
    told = M.fallback_bibtex(spark.createDataFrame([("a", " "), ("b", "P")], "key string, bibtex string"), spark.createDataFrame([("a", "L"), ("b", "L"), ("c", "L")], "key string, bibtex string"))
    assert {tuple(r) for r in told.collect()} == {("a", "L", True), ("b", "P", False), ("c", "L", True)}
