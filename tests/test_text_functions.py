import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T


def value(spark, function, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} {'array<string>' if isinstance(a, list) else 'int' if isinstance(a, int) else 'string'}" for i, a in enumerate(args)))
    return df.select(function(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(
    ("function", "args", "want"),
    [
        (T.normalize_doi, ("https://doi.org/10.1234/ABC.",), "10.1234/abc"),
        (T.normalize_doi, (" Not a DOI ",), "not a doi"),
        (T.normalize_arxiv, ("arXiv:2101.00001v2",), "2101.00001v2"),
        (T.normalize_arxiv, (" None ",), "none"),
        (T.normalize_arxiv, ("arXiv:hep-ex/0101001v2 [hep-ex]",), "hep-ex/0101001v2"),
        (T.find_arxiv, ("None",), ""),
        (T.normalize_doi, ("doi:10.1234/x, see",), "10.1234/x"),
        (T.normalize_doi, ("[10.1234/(A)_b:c;d]?",), "10.1234/(a)_b:c;d"),
        (T.arxiv_of_doi, ("10.99999/arXiv-2101.00001v3",), "2101.00001v3"),
        (T.arxiv_of_doi, ("10.1234/abc",), ""),
        (T.abstract_of, ("Title\nABSTRACT\n 12 \nWe find\nit.\n\n1. Introduction\nmore",), "We find it."),
        (T.abstract_of, ("Received: today " + "x " * 100 + "\n\n" + "y " * 100,), ("y " * 100).strip()),
        (T.normalize_title, ("{The}  Grün-Test: ν!",), "the grün test ν"),
        (T.normalize_authors, ("{A}, B and C, D AND E",), ["A, B", "C, D", "E"]),
        (T.year_of, (None, "2020-03"), "2020"),
        (T.slugify, ("A b C",), "a-b-c"),
        (T.safe_doc_id, ("arxiv:2101/1 x",), "arxiv_2101_1_x"),
        (T.safe_doc_id, (":",), "unknown"),
        (T.canonical_route, ("pdf_mineru",), "pdf_pymupdf"),
        (T.stable_anchor, ("  Results & More: Ünïcode ",), "#results-more-ünïcode"),
        (T.stable_anchor, ("!!",), "#section"),
        (T.tokenize, ("A x-1 foo. _b_ 3.14 é",), ["x-1", "foo.", "3.14"]),
        (T.label_tokens, ("Cross Sections gas",), ["cros", "section", "gas"]),  # only a closing s goes, whatever the word
        (T.looks_like_acronym, ("CEvNS",), True),
        (T.looks_like_acronym, ("detector",), False),
        (T.guess_category, ("Muon detector", "x"), "physical_systems"),
        (T.guess_category, ("Something", "models"), "models"),
        (T.namespace_of, ("physh:1",), "physh"),
        (T.section_type, ("Introduction", "text"), "introduction"),
        (T.section_type, ("", ""), "body"),
        (T.section_type, ("X", "[1] a b\n[2] c d\n[3] e f"), "references"),
        (T.section_type, ("X", "---\ndoc_id: 1\n---"), "metadata"),
        (T.note_bucket, ("Open Question",), "open_questions"),
        (T.arxiv_pdf_url, ("hep-th/9901001",), "https://arxiv.org/pdf/hep-th/9901001"),
        (T.page_name, ("local:a/b",), "local_a_b"),
    ],
)
def test_values(spark, function, args, want):
    assert value(spark, function, *args) == want


@pytest.mark.parametrize("function", [T.normalize_doi, T.normalize_title, T.tokenize, T.squeeze, T.slugify, T.page_name])
def test_null_gives_null(spark, function):
    assert spark.createDataFrame([(None,)], "c string").select(function(F.col("c"))).first()[0] is None


def test_chunk_and_equation_ids(spark):
    row = spark.createDataFrame([("a:b", "#sec", 7, "x $$1$$ y $$2$$")], "d string, a string, i int, t string").select(T.chunk_id(F.col("d"), F.col("a"), F.col("i"), F.col("t")), T.equation_ids(F.col("t"), F.col("a"), F.col("i"))).first()
    assert row[0].startswith("a_b::sec::chunk-007-") and len(row[0].rsplit("-", 1)[1]) == 10
    assert row[1] == ["eq-sec-007-01", "eq-sec-007-02"]


def test_excerpts(spark):
    long = "This first sentence has more than thirty characters. And more."
    df = spark.createDataFrame([(long,)], "t string")
    assert df.select(T.sentence(F.col("t"))).first()[0] == "This first sentence has more than thirty characters."
    assert df.select(T.truncate(F.col("t"), 10)).first()[0] == "This first..."
    assert df.select(T.abstract_of(F.lit("# Abstract\n\nShort one.\n\nKeywords: a, b"))).first()[0] == "Short one."
