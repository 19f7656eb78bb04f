"""Source pages as a table: a row for each key with nested blocks and a Markdown body.

A page is made from an entry, filled from the manifest and the edges of its key, and checked by rules; its parts are
read and written as columns, so files are only a way to hold the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from .records import field, keep_first, keep_last
from .validation import row_issues

AUTO_BEGIN, AUTO_END = "<!-- AUTO:BEGIN -->", "<!-- AUTO:END -->"
PLACEHOLDER = "_To be filled._"
PLACEHOLDERS = ("_No summary yet._", PLACEHOLDER)
SECTIONS = ("One-line contribution", "Key results", "Methods", "Limitations", "Trace index")


def skeleton_body(title: Column, sections: Sequence[str] = SECTIONS) -> Column:
    """The title and each section with its anchor and a placeholder."""
    parts = [F.lit(f"\n## {s}\n{{#{s.lower().replace(' ', '-').replace('/', '-')}}}\n\n{PLACEHOLDER}\n") for s in sections]
    return F.concat(F.lit("\n# "), title, F.lit("\n"), *parts)


def page_skeletons(entries: DataFrame, today: str, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """A new page for each key: identifiers and source from the entry, empty evidence, edges to fill, low quality, unread.

    Of entries with equal ids the first counts; missing fields are ``''`` or null as the page has them.
    """
    value = {name: F.coalesce(field("fields", name), F.lit("")) for name in ("title", "author", "year", "date", "doi", "eprint", "journal", "zotero_key")}
    plain = lambda x: F.trim(F.regexp_replace(x, "[{}]", ""))
    arxiv, doi, title = F.trim(value["eprint"]), F.trim(value["doi"]), plain(value["title"])
    empty = lambda x: F.nullif(x, F.lit(""))
    blank = [F.lit("").alias(n) for n in ("source_sha256", "parser", "parser_version", "parsed_at")]
    source = F.struct(
        title.alias("title"), T.normalize_authors(value["author"]).alias("authors"), T.year_of(value["year"], value["date"]).alias("year"), empty(F.trim(value["journal"])).alias("venue"), F.lit("").alias("abstract"),
        F.when(arxiv != "", "arxiv_source").otherwise("pdf_pymupdf").alias("source_type"), F.lit("").alias("primary_evidence"), F.concat(F.lit("../../reference/pdfs/"), "id", F.lit(".pdf")).alias("original_pdf"), F.lit(None).cast("string").alias("original_tex"), *blank,
    )
    edges = F.map_from_arrays(F.array(*[F.lit(c) for c in V.EDGE_CATEGORIES]), F.array_repeat(F.array().cast("array<string>"), len(V.EDGE_CATEGORIES)))
    return keep_first(entries, ["id"], ["pos"]).select(
        F.col("id").alias("citation_key"), F.lit(V.SOURCE_SCHEMA).alias("schema_version"), F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).otherwise(doi).alias("doc_id"),
        F.struct(empty(arxiv).alias("arxiv"), empty(doi).alias("doi"), F.lit(None).cast("string").alias("inspire"), empty(F.trim(value["zotero_key"])).alias("zotero_key"), F.lit(None).cast("string").alias("url")).alias("identifiers"),
        source.alias("source"), edges.alias("edges"), F.lit("").alias("chunk_manifest"),
        F.struct(F.lit("low").alias("extraction_confidence"), F.lit(True).alias("needs_human_review"), F.lit("unknown").alias("math_extraction_quality"), F.array().cast("array<string>").alias("metadata_conflicts")).alias("quality"),
        F.struct(F.lit("unread").alias("reading_status"), F.lit("unknown").alias("relevance"), F.lit(today).alias("last_checked")).alias("status"),
        skeleton_body(title, sections).alias("body"),
    )


def new_pages(skeletons: DataFrame, existing: DataFrame) -> DataFrame:
    """The skeletons whose key has no page yet; pages that are there stay as they are."""
    return skeletons.join(existing.select("citation_key").where("citation_key IS NOT NULL").distinct(), "citation_key", "left_anti")


def with_evidence(pages: DataFrame, manifests: DataFrame) -> DataFrame:
    """Pages with the evidence of the newest manifest of their key; a route other than the planned one is noted as a conflict."""
    kept = keep_last(manifests.where("citation_key IS NOT NULL"), ["citation_key"], ["created_at", "doc_id", "parser_version"])
    m = kept.select("citation_key", F.struct(*[c for c in manifests.columns if c != "citation_key"]).alias("m"))
    s, q = F.col("source"), F.col("quality")
    filled = s.withField("source_type", F.coalesce("m.route", s["source_type"]))
    for name, of in (("primary_evidence", "parsed_markdown"), ("original_pdf", "original_pdf"), ("original_tex", "original_tex"), ("source_sha256", "source_sha256"), ("parser", "parser"), ("parser_version", "parser_version"), ("parsed_at", "created_at")):
        filled = filled.withField(name, F.col(f"m.{of}") if of == "original_tex" else F.coalesce(F.col(f"m.{of}"), F.lit("")))
    fallback = F.coalesce(F.col("m.route") != s["source_type"], F.lit(False)) & (F.col("m.route") != "")
    note = F.concat(F.lit("route fallback: "), s["source_type"], F.lit(" -> "), "m.route")
    conflicts = F.when(fallback, F.array_append(q["metadata_conflicts"], note)).otherwise(q["metadata_conflicts"])
    has = F.col("m").isNotNull()
    rows = pages.join(m, "citation_key", "left")
    return rows.withColumns({
        "doc_id": F.when(has, F.col("m.doc_id")).otherwise(F.col("doc_id")),
        "source": F.when(has, filled).otherwise(s),
        "quality": F.when(has, q.withField("metadata_conflicts", conflicts).withField("needs_human_review", F.lit(False))).otherwise(q),
        "chunk_manifest": F.when(has, T.evidence_path(F.col("m.doc_id"), "chunks")).otherwise(F.col("chunk_manifest")),
    }).drop("m")


def without_evidence(pages: DataFrame) -> DataFrame:
    """Pages with their evidence fields blanked, as after the evidence is removed."""
    source = F.col("source")
    for name in ("primary_evidence", "source_sha256", "parser", "parser_version", "parsed_at"):
        source = source.withField(name, F.lit(""))
    return pages.withColumns({"source": source.withField("original_tex", F.lit(None).cast("string")), "chunk_manifest": F.lit("")})


def with_edges(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages with the ids of edge items added to their edges, each once and in order; items are gathered a category at a time."""
    ids = items.where("citation_key IS NOT NULL AND category IS NOT NULL AND canonical_id IS NOT NULL").groupBy("citation_key", "category").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))
    own = ids.groupBy("citation_key").agg(F.map_from_entries(F.collect_list(F.struct("category", "ids"))).alias("added"))
    none = F.array().cast("array<string>")
    joined = pages.join(own, "citation_key", "left").withColumn("added", F.coalesce("added", F.create_map().cast("map<string,array<string>>")))
    merged = F.map_zip_with("edges", "added", lambda k, a, b: F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))))
    return joined.withColumn("edges", merged).drop("added")


def page_edges(pages: DataFrame) -> DataFrame:
    """(citation_key, category, canonical_id) of the pages' edges."""
    by_category = pages.select("citation_key", F.explode("edges").alias("category", "ids"))
    return by_category.select("citation_key", "category", F.explode("ids").alias("canonical_id")).where(F.trim("canonical_id") != "")


def edge_pages(pages: DataFrame, category_pages: DataFrame) -> DataFrame:
    """(citation_key, category, canonical_id, path): each edge with the page of its term, ``''`` where the term has none.

    ``category_pages`` has category and name of the pages that are there.
    """
    wanted = page_edges(pages).withColumn("name", T.page_name(F.trim("canonical_id")))
    there = category_pages.select("category", "name", F.concat(F.lit("summary/"), "category", F.lit("/"), "name", F.lit(".md")).alias("path")).distinct()
    return wanted.join(there, ["category", "name"], "left").select("citation_key", "category", "canonical_id", F.coalesce("path", F.lit("")).alias("path"))


def claims(pages: DataFrame) -> DataFrame:
    """(citation_key, claim_id, chunk_ids) of the claim blocks in the bodies; a block without an id is ``<missing>``."""
    blocks = pages.select("citation_key", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)```claim\n(.*?)\n```"), F.lit(1))).alias("block"))
    claim = F.coalesce(F.nullif(F.regexp_extract("block", r"(?m)^claim_id:\s*[\"']?([^\s\"']+)", 1), F.lit("")), F.lit("<missing>"))
    return blocks.select("citation_key", claim.alias("claim_id"), F.regexp_extract_all("block", F.lit(r"(?m)^[\s-]*chunk_id:[ \t]*[\"']?([^\s\"']*)"), F.lit(1)).alias("chunk_ids"))


def claim_issues(pages: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Claims without evidence, evidence without a chunk id, and chunk ids that no chunk has (not asked where there are no chunks)."""
    found = claims(pages)
    subject = F.concat_ws("#", "citation_key", "claim_id")
    own = row_issues(found, subject, [("claim_without_evidence", F.size("chunk_ids") == 0, None), ("evidence_without_chunk", F.array_contains("chunk_ids", ""), None)])
    known = chunk_ids.select("chunk_id").where("chunk_id IS NOT NULL").distinct()
    cited = found.select(subject.alias("subject"), F.explode("chunk_ids").alias("chunk_id")).where("chunk_id <> ''")
    lost = cited.join(known, "chunk_id", "left_anti").select("subject", F.lit("missing_chunk").alias("rule"), F.lit("error").alias("severity"), F.col("chunk_id").alias("detail"))
    return own.unionByName(lost if not known.isEmpty() else lost.limit(0))


def page_issues(pages: DataFrame, terms: DataFrame, chunks: DataFrame, paths: DataFrame, strict: bool = False) -> DataFrame:
    """Everything that is wrong with pages: schema, blocks, source type, ids, edges, links to files (``paths`` has path) and claims."""
    arxiv, kind = F.coalesce("identifiers.arxiv", F.lit("")), F.coalesce("source.source_type", F.lit(""))
    ids = F.coalesce(F.flatten(F.map_values("edges")), F.array().cast("array<string>"))
    rules = [("wrong_schema", F.coalesce(F.col("schema_version") != V.SOURCE_SCHEMA, F.lit(True)), F.col("schema_version"))]
    rules += [(f"missing_{block}", F.col(block).isNull(), None) for block in ("identifiers", "source", "edges", "quality", "status")]
    rules += [
        ("unknown_source_type", (kind != "") & ~kind.isin("arxiv_source", "pdf_mineru", "pdf_pymupdf"), kind),
        ("doc_id_not_arxiv", (arxiv != "") & (F.coalesce("doc_id", F.lit("")) != "") & (F.concat(F.lit("arxiv:"), arxiv) != F.col("doc_id")), F.col("doc_id")),
        ("unknown_edge_category", F.exists(F.map_keys("edges"), lambda x: ~x.isin(*V.EDGE_CATEGORIES)), None),
    ]
    found = row_issues(pages, F.col("citation_key"), rules).unionByName(row_issues(pages, F.col("citation_key"), [("no_edges", F.col("edges").isNotNull() & (F.size(ids) == 0), None)], "error" if strict else "warning"))
    edges = page_edges(pages).where(F.col("category").isin(*V.EDGE_CATEGORIES))
    known = terms.select("canonical_id").where("canonical_id <> ''").distinct()
    off = edges.join(known, F.trim(edges["canonical_id"]) == known["canonical_id"], "left_anti")
    links = pages.select("citation_key", F.explode(F.array(F.struct(F.lit("primary_evidence").alias("kind"), F.col("source.primary_evidence").alias("path")), F.struct(F.lit("chunk_manifest").alias("kind"), F.col("chunk_manifest").alias("path")))).alias("l")).select("citation_key", "l.*").where("path <> ''")
    lost = links.join(paths.select("path").distinct(), "path", "left_anti")
    one = lambda df, rule, detail: df.select(F.col("citation_key").alias("subject"), rule.alias("rule"), F.lit("error").alias("severity"), detail.alias("detail"))
    found = found.unionByName(one(off, F.lit("off_vocabulary"), F.concat_ws(":", "category", F.trim("canonical_id")))).unionByName(one(lost, F.concat(F.lit("missing_"), "kind"), F.col("path")))
    return found.unionByName(claim_issues(pages, chunks))


def files_missing(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(citation_key, path): PDFs that pages name and that aren't among the files, compared by their names."""
    base = lambda c: F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    wanted = pages.select("citation_key", F.col("source.original_pdf").alias("path")).where("path <> ''").withColumn("name", base(F.col("path")))
    return wanted.join(files.select(base(F.col("path")).alias("name")).distinct(), "name", "left_anti").select("citation_key", "path")


def pages_that_mention(pages: DataFrame, needles: Sequence[str], text: str = "body") -> DataFrame:
    """(citation_key, needle): pages whose text contains one of a few given texts."""
    listed = F.filter(F.array(*[F.lit(n) for n in needles]).cast("array<string>"), lambda x: F.col(text).contains(x))
    return pages.select("citation_key", F.explode(listed).alias("needle"))


# --- bodies ---------------------------------------------------------------------------------------------------------


def is_placeholder(body: Column) -> Column:
    """Whether a body is empty or still has a section to fill."""
    return F.coalesce(F.trim(body) == "", F.lit(True)) | T.any_of(body, PLACEHOLDERS)


def summary_status(body: Column) -> Column:
    return F.when(body.isNull(), "no source page").when(T.any_of(body, PLACEHOLDERS), "placeholder").otherwise("summarized")


def fill_sections(body: Column, sections: dict[str, Column]) -> Column:
    """A body whose sections of the given names (lower case) have the given texts where they were empty or placeholders.

    Sections with a text of their own stay; those that aren't there are appended; a null text fills nothing.
    """
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(body, F.lit(""))), r"\n(?=## )")

    def filled(part: Column) -> Column:
        name, current = F.lower(F.trim(F.regexp_extract(part, r"\A## ([^\n]*)", 1))), F.regexp_replace(part, r"\A## [^\n]*\n?", "")
        result = part
        for key, text in sections.items():
            open_ = part.startswith("## ") & (name == key) & text.isNotNull() & is_placeholder(T.squeeze_ends(current))
            result = F.when(open_, F.concat(F.regexp_extract(part, r"\A(## [^\n]*)", 1), F.lit("\n\n"), text, F.lit("\n"))).otherwise(result)
        return result

    names = F.transform(parts, lambda p: F.lower(F.trim(F.regexp_extract(p, r"\A## ([^\n]*)", 1))))
    added = [F.when(~F.array_contains(names, key) & text.isNotNull(), F.concat(F.lit(f"\n## {key.title()}\n\n"), text)).otherwise(F.lit("")) for key, text in sections.items()]
    whole = F.concat(F.regexp_replace(F.array_join(F.transform(parts, filled), "\n"), r"\s+\z", ""), *[F.when(a != "", F.concat(F.lit("\n"), a)).otherwise(F.lit("")) for a in added])
    return F.concat(F.regexp_replace(F.regexp_replace(whole, r"\A\n", ""), r"\s+\z", ""), F.lit("\n"))


def scrub_auto(body: Column, key: Column) -> Column:
    """A body without the lines of its generated block that name a key; what people wrote stays."""
    begin, end = F.instr(body, AUTO_BEGIN), F.instr(body, AUTO_END)
    start = begin + len(AUTO_BEGIN)
    block = F.substring(body, start, end - start)
    kept = F.array_join(F.filter(F.split(block, "\n"), lambda x: ~x.contains(key)), "\n")
    scrubbed = F.concat(F.substring(body, F.lit(1), start - 1), kept, F.substring(body, end, F.length(body)))
    return F.when((begin > 0) & (end > begin) & (key != ""), scrubbed).otherwise(body)


def merged(defaults: Column, existing: Column, names: Sequence[str]) -> Column:
    """A struct with the existing values over the defaults, field by field, one level deep; null counts as not there."""
    return F.when(existing.isNull(), defaults).otherwise(F.struct(*[F.coalesce(existing[n], defaults[n]).alias(n) for n in names]))


# --- texts of pages -------------------------------------------------------------------------------------------------


def metadata_sentence(title: Column, year: Column, authors: Column, abstract: Column, text: Column) -> Column:
    """A page's metadata as one sentence, with its abstract, else the begin of its text, else that there is none."""
    people = F.when(F.size(authors) > 0, F.concat(F.lit(" by "), F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))).otherwise("")
    told = F.when(abstract != "", F.concat(F.lit("Extracted abstract: "), abstract)).when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("No clear abstract heading was extracted; first-page text begins: "), F.substring(T.squeeze(text), 1, 900)))
    return F.concat(title, F.lit(" ("), year, F.lit(")"), people, F.lit(". "), F.coalesce(told, F.lit("PDF text was not available; this source page currently contains bibliographic metadata only.")))


def links_text(doi: Column, arxiv: Column, pdf: Column) -> Column:
    lines = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), x)) for name, x in (("DOI", doi), ("arXiv", arxiv), ("PDF", pdf))]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("- No external identifiers recorded.")


def text_summaries(pages: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(citation_key, metadata, findings, links, body): pages summarised from the text of their source; placeholders are filled."""
    rows = pages.join(keep_first(texts.where(F.col("citation_key").isNotNull()), ["citation_key"], ["order"]).select("citation_key", F.col(text).alias("_text")), "citation_key", "left")
    abstract = F.coalesce(T.abstract_of(F.col("_text")), F.lit(""))
    rows = rows.withColumn("_abstract", abstract)
    found = T.key_findings(F.col("_abstract"))
    findings = F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.concat(F.lit("- Needs manual/AI review of the PDF for detailed findings. Current indexed topic: "), "source.title", F.lit(".")))
    told = rows.select("citation_key", metadata_sentence(F.col("source.title"), F.col("source.year"), F.col("source.authors"), F.col("_abstract"), F.col("_text")).alias("metadata"), findings.alias("findings"), links_text(F.col("identifiers.doi"), F.col("identifiers.arxiv"), F.col("source.original_pdf")).alias("links"), "body")
    return told.withColumn("body", fill_sections(F.col("body"), {"one-line contribution": F.col("metadata"), "key results": F.col("findings"), "links": F.col("links")}))


def page_index(pages: DataFrame) -> DataFrame:
    """(place, line): the list of pages in order of their keys; a line a row, so an index of any length is written in parts."""
    line = F.concat(F.lit("- ["), "citation_key", F.lit("](summary/sources/"), "citation_key", F.lit(".md)"))
    return pages.select("citation_key", line.alias("line")).orderBy("citation_key")


def reading_list(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(citation_key, item): each page as an item of a reading list, with the links it has and whether it is summarised."""
    there = files.select(F.substring_index("path", "/", -1).alias("_name")).distinct().withColumn("_pdf", F.lit(True))
    rows = pages.join(there, F.concat("citation_key", F.lit(".pdf")) == F.col("_name"), "left")
    line = lambda cond, *parts: F.when(cond, F.concat(F.lit("\n  - "), *parts)).otherwise("")
    key = F.col("citation_key")
    item = F.concat(
        F.lit("- **"), "source.title", F.lit("** ("), "source.year", F.lit(")\n  - Key: `"), key, F.lit("`"),
        line(F.col("identifiers.arxiv").isNotNull(), F.lit("arXiv: "), F.coalesce("identifiers.arxiv", F.lit(""))), line(F.col("identifiers.doi").isNotNull(), F.lit("DOI: "), F.coalesce("identifiers.doi", F.lit(""))),
        F.lit("\n  - Source: ["), key, F.lit("](summary/sources/"), key, F.lit(".md)"), line(F.coalesce("_pdf", F.lit(False)), F.lit("PDF: ["), key, F.lit(".pdf](reference/pdfs/"), key, F.lit(".pdf)")),
        F.lit("\n  - Summary status: "), summary_status(F.col("body")),
    )
    return rows.select("citation_key", item.alias("item"))


def wiki_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, body): a page for each vocabulary term of ``nodes`` with the keys that have an edge to it in its generated block."""
    keys = edges.where("canonical_id IS NOT NULL AND citation_key IS NOT NULL").groupBy("canonical_id").agg(F.array_sort(F.collect_set("citation_key")).alias("keys"))
    rows = nodes.join(keys, "canonical_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    listed = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("- [[../sources/"), k, F.lit("]]\n"))), "")
    head = F.concat(F.lit("# "), "label", F.lit("\n\n`"), "canonical_id", F.lit(f"`\n\n{AUTO_BEGIN}\n## Source pages ("), F.size("keys").cast("string"), F.lit(")\n"))
    return rows.select(F.concat(F.lit("summary/"), "category", F.lit("/"), T.page_name(F.col("canonical_id")), F.lit(".md")).alias("path"), F.concat(head, listed, F.lit(f"{AUTO_END}\n")).alias("body"))


def notes_by_bucket(items: DataFrame) -> DataFrame:
    """(bucket, place, line): synced note items as lines under their bucket, in order of note and line."""
    cites = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("[@"), c, F.lit("]"))), ", ")
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" > "), "heading")).otherwise("")
    line = F.concat(F.lit("- <!-- "), "id", F.lit(" --> **"), F.initcap(F.col("category")), F.lit("**: "), "text", F.lit(" "), cites, F.lit(" _(from `"), "note", F.lit("`:"), F.col("line_no").cast("string"), heading, F.lit(")_"))
    return items.select("bucket", "note", "line_no", line.alias("line"))


def operation_log(spark_rows: DataFrame, operation: str, today: str) -> DataFrame:
    """(day, operation, input, result) of what was done, to be appended to the log; the day is given, not taken from a clock."""
    return spark_rows.select(F.lit(today).alias("day"), F.lit(operation).alias("operation"), F.regexp_replace("input", r"^/?(.*/)?(?=(?:reference|summary)/)", "").alias("input"), F.col("result").cast("string").alias("result"))
