import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.plans import changes as P
from leafmill.sources import bibtex as B
from leafmill.sources import files as S
from leafmill.streaming import incremental as I

BIB = """% comment
@article{one,
  title = {A {Nested} title},
  author = "Quoted and Other",
  year = 2020,
  note = {a lone " quote},
}
@string{x = {y}}
@misc{two, title = {Second}}
@misc{broken, title = {never closed
"""


def test_bibtex_source_and_round_trip(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB, encoding="utf-8")
    B.register(spark)
    for df in (spark.read.format("bibtex").load(str(tmp_path)), B.read_bibtex(spark, str(tmp_path))):
        rows = {r["id"]: r for r in df.collect()}
        assert {f["k"]: f["v"] for f in rows["one"]["fields"]} == {"title": "A {Nested} title", "author": "Quoted and Other", "year": "2020", "note": 'a lone " quote'}
        assert rows["two"]["problem"] is None and rows["broken"]["problem"]
    B.write_bibtex(df.where("problem IS NULL"), str(tmp_path / "out"))
    again = {r["id"]: r["fields"] for r in B.read_bibtex(spark, str(tmp_path / "out")).collect()}
    assert again["one"] == rows["one"]["fields"] and again["two"] == rows["two"]["fields"]


def test_chunk_lines(spark, tmp_path):
    good = {"chunk_id": "c1", "doc_id": "d/1", "text": "x", "equation_ids": []}
    (tmp_path / "x.jsonl").write_text(json.dumps(good) + "\n\nnot json\n[1]\n", encoding="utf-8")
    path = str(tmp_path / "x.jsonl")
    with pytest.raises(Exception):  # noqa: B017
        S.read_chunks(spark, path).collect()
    assert [r["chunk_id"] for r in S.read_chunks(spark, path, "DROPMALFORMED").collect() if r["chunk_id"]] == ["c1"]
    assert {(r["line_no"], r["problem"]) for r in S.chunk_parse_issues(spark, path).collect()} == {(3, "invalid JSON"), (4, "not an object")}
    S.write_chunks(S.read_chunks(spark, path, "DROPMALFORMED").where("chunk_id IS NOT NULL").drop("file"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "document=d_1").exists()


def test_pages_and_vocabulary(spark, tmp_path):
    (tmp_path / "k1.md").write_text("---\ntitle: T\ntags: [a, b]\n---\nBody\n", encoding="utf-8")
    (tmp_path / "k2.md").write_text("no frontmatter", encoding="utf-8")
    pages = {r["key"]: r for r in S.read_pages(spark, str(tmp_path)).collect()}
    assert json.loads(pages["k1"]["frontmatter"]) == {"title": "T", "tags": ["a", "b"]} and pages["k1"]["body"] == "Body\n"
    assert pages["k2"]["frontmatter"] == "{}" and pages["k2"]["body"] == "no frontmatter"
    assert spark.createDataFrame([("x\n```yaml\nterms: []\n```\n",)], "t string").select(S.vocabulary_block(F.col("t"))).first()[0] == "terms: []"


RDF = """<rdf:RDF xmlns:rdf="r" xmlns:bib="b" xmlns:dc="d" xmlns:foaf="f" xmlns:z="z">
<bib:Article rdf:about="#1"><dc:title>Title A</dc:title><dc:date>2020</dc:date><dc:identifier>DOI 10.1234/AB</dc:identifier><dc:identifier>arXiv:2101.00001</dc:identifier>
<bib:authors><rdf:Seq><rdf:li><foaf:Person><foaf:surname>Doe</foaf:surname><foaf:givenName>Jo</foaf:givenName></foaf:Person></rdf:li><rdf:li><foaf:Person><foaf:surname>others</foaf:surname></foaf:Person></rdf:li></rdf:Seq></bib:authors></bib:Article>
</rdf:RDF>"""


def test_rdf_and_archives(spark, tmp_path):
    (tmp_path / "e.rdf").write_text(RDF, encoding="utf-8")
    row = S.read_rdf(spark, str(tmp_path / "e.rdf")).first()
    assert (row["title"], row["doi"], row["arxiv"], row["authors"]) == ("Title A", "10.1234/ab", "2101.00001", ["Doe, Jo"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/x.pdf", b"%PDF-1")
        z.writestr("../evil", b"no")
    members = {r["member"]: r["content"] for r in S.read_archives(spark, str(tmp_path / "z.zip")).collect()}
    assert bytes(members["a/x.pdf"]) == b"%PDF-1" and members["../evil"] is None


def test_pdfs(spark, tmp_path):
    (tmp_path / "key1 paper.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "other.pdf").write_bytes(b"html")
    pdfs = S.list_pdfs(spark, str(tmp_path))
    assert {r["name"]: r["is_pdf"] for r in pdfs.collect()} == {"key1 paper": True, "other": False}
    records = spark.createDataFrame([("key1", "T", "10.1/zzzz"), ("nope", "Nothing here", "")], "key string, title string, doi string")
    assert [(r["key"], r["points"]) for r in S.match_pdfs(records, pdfs).collect()] == [("key1", 100)]
    assert spark.createDataFrame([(r"Full Text:files/a\;b.pdf:application/pdf;c.pdf",)], "f string").select(S.file_paths(F.col("f"))).first()[0] == ["files/a;b.pdf", "c.pdf"]


def test_notes(spark):
    text = "# Head\n- Decision: use [@k1] and [@k2]\nplain\n## Sub\nFailed: it broke\r\n"
    rows = S.note_items(spark.createDataFrame([("n", text), ("m", None)], "id string, t string"), "id", "t").orderBy("line_no").collect()
    assert [(r["line_no"], r["heading"], r["bucket"], r["text"]) for r in rows] == [(2, "Head", "decisions", "use [@k1] and [@k2]"), (5, "Sub", "failures", "it broke")]
    assert rows[0]["citations"] == ["k1", "k2"]


RECORD = "key string, pos int, doi string, arxiv string, title_norm string, authors array<string>, year string"


def test_import_and_delete_plans(spark):
    old = spark.createDataFrame([("o1", 1, "10.1/a", "", "alpha", ["A"], "2000")], RECORD)
    new = spark.createDataFrame([("n1", 1, "10.1/a", "", "other", ["B"], "2001"), ("n2", 2, "", "", "beta", ["C"], "2002"), ("n3", 3, "10.9/z", "", "beta", ["D"], "2003"), ("n4", 4, "", "", "gamma", ["E"], "2004")], RECORD)
    plan = {r["key"]: (r["status"], r["duplicate_of"], r["duplicate_match"]) for r in P.import_plan(new, old).collect()}
    assert plan == {"n1": ("duplicate", "o1", "doi"), "n2": ("new", "", ""), "n3": ("duplicate", "n2", "title"), "n4": ("new", "", "")}
    assert [r["reason"] for r in P.delete_targets(new, title="Beta").collect()] == ["title", "title"]
    with pytest.raises(ValueError):
        P.delete_targets(new)


def test_updates_and_versions(spark, tmp_path):
    entries = spark.createDataFrame([("a", [("title", "x"), ("year", "1")]), ("b", [])], "id string, fields array<struct<k:string,v:string>>")
    updates = spark.createDataFrame([("a", "year", "2"), ("a", "doi", "10")], "key string, field string, new_value string")
    after = {r["id"]: [tuple(f) for f in r["fields"]] for r in P.apply_updates(entries, updates).collect()}
    assert after == {"a": [("title", "x"), ("year", "2"), ("doi", "10")], "b": []}
    root = str(tmp_path / "t")
    first, second = P.write_version(entries, root), P.write_version(entries.limit(1), root)
    assert first != second and P.read_version(spark, root).count() == 1 and spark.read.parquet(first).count() == 2


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 3)], "chunk_id string, n int")
    rows.write.parquet(source)
    for _ in range(2):  # what arrives twice is added once
        rows.write.mode("append").parquet(source)
        I.sync_into(I.read_stream(spark, source, "chunk_id string, n int"), target, "chunk_id", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(target).collect()) == ["c1", "c2"]


def test_stateful_counts(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").write.parquet(source)
    query = I.running_counts(I.read_stream(spark, source, "k string"), "k").writeStream.format("memory").queryName("running_counts_test").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["key"], r["n"]) for r in spark.table("running_counts_test").collect()} == {("a", 2), ("b", 1)}
