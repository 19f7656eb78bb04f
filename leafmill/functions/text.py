"""Text as columns: normalisers, tokenisers, anchors, ids, excerpts and scores, all inside the JVM.

Every function takes and returns columns. Null in gives null out, unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

#: Letters, digits and ``_`` of any script, as a character class of Java and of RE2.
WORD = r"\p{L}\p{N}_"
BLANK = r"\s\p{Z}"
#: Identifiers in lower-case text: a DOI, an arXiv id, and an arXiv id behind the prefix of any DOI registrant.
DOI = r"(10\.\d{4,9}/[-._;()/:a-z0-9]+)"
ARXIV = r"(\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+/\d{7}(?:v\d+)?)"
ARXIV_DOI = r"10\.\d{4,}/arxiv[./-](\d{4}\.\d{4,5}(?:v\d+)?)"


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether the text contains one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


def squeeze_ends(text: Column) -> Column:
    """A text without blanks and line breaks at its ends."""
    return F.regexp_replace(text, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def normalize_doi(value: Column) -> Column:
    """The DOI in a text in lower case without a closing dot; where there is none, the trimmed lower-case text."""
    text = F.lower(F.trim(value))
    found = F.regexp_extract(text, DOI, 1)
    return F.when(found == "", text).otherwise(F.regexp_replace(found, r"\.+$", ""))


def find_arxiv(value: Column) -> Column:
    """The arXiv id in a text, with its version; ``''`` where there is none."""
    return F.regexp_extract(F.lower(value), ARXIV, 1)


def normalize_arxiv(value: Column) -> Column:
    """The arXiv id in a text, with its version; where there is none, the trimmed lower-case text."""
    return F.coalesce(F.nullif(find_arxiv(value), F.lit("")), F.lower(F.trim(value)))


def normalize_title(value: Column) -> Column:
    """Lower case; all that isn't a letter, digit or ``_`` becomes one space."""
    return F.trim(F.regexp_replace(F.lower(value), f"[^{WORD}]+", " "))


def normalize_authors(value: Column) -> Column:
    """The names of an author field joined by "and", without braces and empty names."""
    names = F.transform(F.split(F.regexp_replace(value, "[{}]", ""), r"(?i)[\s\p{Z}]+and[\s\p{Z}]+"), lambda x: squeeze(x))
    return F.filter(names, lambda x: x != "")


def arxiv_of_doi(doi: Column) -> Column:
    """The arXiv id that a DOI wraps; ``''`` where it wraps none."""
    return F.regexp_extract(F.lower(doi), ARXIV_DOI, 1)


def is_datacite_arxiv(doi: Column) -> Column:
    return arxiv_of_doi(doi) != ""


def best_identifier(doi: Column, arxiv: Column, title_norm: Column, key: Column) -> Column:
    """The first of a record's identifiers that isn't empty, its key at last."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (doi, arxiv, title_norm)], key)


def year_of(year: Column, date: Column) -> Column:
    """The year field, else the first four characters of the date; ``''`` where both are missing."""
    return F.coalesce(F.nullif(F.trim(year), F.lit("")), F.substring(date, 1, 4), F.lit(""))


def slugify(value: Column) -> Column:
    return F.replace(normalize_title(value), F.lit(" "), F.lit("-"))


def safe_doc_id(doc_id: Column) -> Column:
    """A document id that can be a file name; ``unknown`` where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(doc_id), "[:/]", "_"), r"[^a-zA-Z0-9_.-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def canonical_route(route: Column) -> Column:
    for alias, name in V.ROUTE_ALIASES.items():
        route = F.when(route == alias, name).otherwise(route)
    return route


def is_allowed_route(route: Column) -> Column:
    return F.coalesce(route.isin(*V.ALLOWED_ROUTES), F.lit(False))


def evidence_path(doc_id: Column, kind: str) -> Column:
    """Where the ``parsed`` text, its ``manifest`` or the ``chunks`` of a document lie."""
    folder, ending = {"parsed": ("parsed", ".md"), "manifest": ("parsed", ".manifest.json"), "chunks": ("chunks", ".jsonl")}[kind]
    return F.concat(F.lit(f"reference/{folder}/"), safe_doc_id(doc_id), F.lit(ending))


def stable_anchor(title: Column) -> Column:
    """The anchor of a heading: lower case, without punctuation, ``-`` for blanks; ``#section`` where nothing is left."""
    clean = F.regexp_replace(F.lower(F.trim(title)), f"[^{WORD}{BLANK}-]", "")
    clean = F.regexp_replace(F.regexp_replace(clean, f"[{BLANK}]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("#"), F.coalesce(F.nullif(clean, F.lit("")), F.lit("section")))


def anchor_name(anchor: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(anchor, "^#+", ""), F.lit("")), F.lit("section"))


def chunk_id(doc_id: Column, anchor: Column, index: Column, text: Column) -> Column:
    number = F.lpad(index.cast("string"), F.greatest(F.lit(3), F.length(index.cast("string"))), F.lit("0"))
    return F.concat(safe_doc_id(doc_id), F.lit("::"), anchor_name(anchor), F.lit("::chunk-"), number, F.lit("-"), F.substring(F.sha1(text), 1, 10))


def equation_ids(text: Column, anchor: Column, index: Column) -> Column:
    """An id for each ``$$...$$`` of a text."""
    count = F.regexp_count(text, F.lit(r"(?s)\$\$(.*?)\$\$"))
    name = F.concat(F.lit("eq-"), anchor_name(anchor), F.lit("-"), F.lpad(index.cast("string"), 3, "0"), F.lit("-"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(name, F.lpad(i.cast("string"), 2, "0")))).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Search tokens: runs of letters, digits and ``_.+-`` of which two characters are left without ``._-`` around; lower case."""
    # two characters that aren't cut from the ends, so no run has to be looked at again
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([._-]*[\p{{L}}\p{{N}}+](?:[._-]*[\p{{L}}\p{{N}}+])[{WORD}.+-]*)"), F.lit(1))


def words(text: Column) -> Column:
    """Words of two characters or more, lower case, as a TF-IDF vectoriser by convention takes them."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]{{2,}})"), F.lit(1))


def section_weight(section_type: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in V.SECTION_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, section_type), F.lit(1.0))


def section_type(title: Column, text: Column) -> Column:
    """The type of a section by its title and the first 500 characters of its text; the first rule that holds counts."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    start = F.ltrim(F.substring(text, 1, 2000))
    hay = F.lower(F.trim(F.concat_ws(" ", title, F.substring(text, 1, 500))))
    numbered = F.regexp_count(F.substring(text, 1, 2000), F.lit(r"(?m)^\s*(?:\[\d+\]|\d+\.)\s+\S+"))
    frontmatter = start.startswith("---") & any_of(F.substring(start, 1, 500), ("doc_id:", "citation_key:"))

    def told(h: Column) -> Column:
        return (
            F.when(frontmatter, "metadata")
            .when(h == "", "body")
            .when(any_of(h, V.REFERENCE_MARKERS) | (numbered >= 3), "references")
            .when(any_of(h, V.METADATA_MARKERS), "metadata")
            .when(any_of(h, ("appendix", "supplement")), "appendix")
            .when(h.contains("abstract"), "abstract")
            .when(h.contains("introduction") | h.startswith("intro"), "introduction")
            .when(any_of(h, V.METHOD_MARKERS), "methods")
            .when(any_of(h, V.RESULT_MARKERS), "results")
            .when(h.contains("discussion"), "discussion")
            .when(any_of(h, V.CONCLUSION_MARKERS), "conclusion")
            .otherwise("body")
        )

    return F.get(F.transform(F.array(hay), told), F.lit(0))  # bound once, as some thirty conditions look at it


def truncate(text: Column, most: int) -> Column:
    """A text cut to ``most`` characters, with an ellipsis after them."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), f"[{BLANK}]+$", ""), F.lit("..."))).otherwise(text)


def sentence(text: Column, most: int = 260) -> Column:
    """The first sentence if it has 30 to ``most`` characters, else the front of the text."""
    text = squeeze(text)
    result = F.rtrim(F.substring(text, 1, most))
    for mark in ("。", "; ", ". "):
        at = F.instr(text, mark)
        first = F.concat(F.trim(F.substring(text, F.lit(1), at - 1)), F.lit(mark.strip()))
        result = F.when((at > 0) & F.length(first).between(30, most), first).otherwise(result)
    return result


def key_findings(text: Column, most: int = 3) -> Column:
    """The first sentences of more than 40 characters."""
    parts = F.transform(F.split(squeeze(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: F.length(x) > 40), 1, most)


def abstract_of(text: Column) -> Column:
    """What stands between the word "Abstract" and the introduction or keywords, else the first paragraph of at least 180
    characters that isn't a journal's boilerplate; at most 1,200 characters. Lines that are only a number don't count.
    """
    text = F.regexp_replace(F.regexp_replace(text, "\r", ""), r"(?m)^\s*\d+\s*$", "")
    told = squeeze(F.regexp_extract(text, V.ABSTRACT_PATTERN, 1))
    told = F.btrim(F.regexp_replace(told, "Abstract[—-]", ""), F.lit(" :-"))
    paragraphs = F.transform(F.split(text, r"\n\s*\n"), lambda x: squeeze(x))
    paragraph = F.get(F.filter(paragraphs, lambda x: (F.length(x) >= 180) & ~any_of(F.lower(x), V.BOILERPLATE)), F.lit(0))
    return F.substring(F.when(text.rlike(V.ABSTRACT_PATTERN), told).otherwise(F.coalesce(paragraph, F.lit(""))), 1, 1200)


def term_tokens(term: Column) -> Column:
    return F.regexp_extract_all(F.lower(term), F.lit("([a-z0-9]+)"), F.lit(1))


def label_tokens(label: Column) -> Column:
    """Tokens of a label without the plural ``s`` of words longer than three letters."""
    return F.transform(term_tokens(label), lambda x: F.when((F.length(x) > 3) & x.endswith("s"), F.regexp_replace(x, "s$", "")).otherwise(x))


def opposed(one: Column, other: Column) -> Column:
    """Whether two token arrays hold opposite words."""
    found = F.lit(False)
    for a, b in V.OPPOSITES:
        for x, y in ((a, b), (b, a)):
            found = found | (F.array_contains(one, x) & F.array_contains(other, y) & ~F.array_contains(other, x))
    return found


def looks_like_acronym(term: Column) -> Column:
    compact = F.regexp_replace(term, "[^A-Za-z0-9]", "")
    letters, upper = F.length(F.regexp_replace(compact, "[^A-Za-z]", "")), F.length(F.regexp_replace(compact, "[^A-Z]", ""))
    return F.length(compact).between(2, 12) & (letters > 0) & ((F.upper(compact) == compact) | (upper >= F.greatest(F.lit(2), letters - 1)))


def has_domain_signal(term: Column, domain: Iterable[str] = V.DOMAIN_WORDS) -> Column:
    return F.arrays_overlap(term_tokens(term), F.array(*[F.lit(w) for w in domain]))


def quality_score(term: Column, count: Column) -> Column:
    """How good a candidate phrase is: its count with bonuses for length, domain words and acronyms."""
    tokens = term_tokens(term)
    n, last, first = F.size(tokens), F.element_at(tokens, -1), F.get(tokens, F.lit(0))
    points = count.cast("double")
    for condition, value in (
        (n >= 2, F.lit(8.0) + F.least(n, F.lit(5))),
        (n.between(3, 5), F.lit(4.0)),
        (has_domain_signal(term), F.lit(10.0)),
        (looks_like_acronym(term), F.lit(5.0)),
        (n == 1, F.lit(-6.0)),
        ((n == 1) & first.isin(*V.BROAD_WORDS), F.lit(-8.0)),
        ((n == 2) & F.array_join(tokens, " ").isin(*V.FRAGMENT_PHRASES), F.lit(-6.0)),
        (F.coalesce(F.when(n > 0, last.isin(*V.TRAILING_WORDS)), F.lit(False)), F.lit(-4.0)),
    ):
        points = points + F.when(condition, value).otherwise(F.lit(0.0))
    return points


def guess_category(label: Column, given: Column) -> Column:
    """The given category if it is one, else that of the first word list with a word in the label."""
    lower = F.lower(label)
    result = F.when(given.isin(*V.EDGE_CATEGORIES), given).when(lower.isin(*V.EXPERIMENT_NAMES), "experiments").when(any_of(lower, V.PROPERTY_WORDS), "properties")
    for name, listed in V.CATEGORY_WORDS.items():
        result = result.when(any_of(lower, listed), name)
    return result.otherwise("research_areas")


def confidence_of(source: Column, match_score: Column) -> Column:
    return F.when(source == "unresolved", 0.0).when(source == "local_cache", 0.9).when((source == "physh_api") & (match_score > 0), match_score).otherwise(1.0)


def namespace_of(canonical_id: Column) -> Column:
    return F.when(canonical_id.contains(":"), F.substring_index(canonical_id, ":", 1)).otherwise("")


def category_of_facet(facet: Column) -> Column:
    result = F.lit("")
    for name, category in V.FACETS.items():
        result = F.when(facet == name, category).otherwise(result)
    return result


def sanitize_key(raw: Column) -> Column:
    """A citation key of letters, digits and ``_:-``; ``untitled`` where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(raw, r"[^\p{L}\p{N}_:-]+", ""), F.lit("")), F.lit("untitled"))


def note_bucket(category: Column) -> Column:
    c = F.lower(F.trim(category))
    return F.when(c == "decision", "decisions").when(c == "method", "methods").when(c == "failed", "failures").when(c.isin("open question", "dispute"), "open_questions").otherwise("claims")


def note_item_id(note: Column, line: Column, text: Column) -> Column:
    return F.concat(F.lit("note:"), F.substring(F.sha1(F.concat_ws(":", note, line.cast("string"), text)), 1, 10))


def arxiv_pdf_url(arxiv: Column) -> Column:
    return F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/pdf/"), F.replace(F.url_encode(arxiv), F.lit("%2F"), F.lit("/")))).otherwise("")


def pdf_action(exists: Column, source: Column, arxiv: Column, url: Column) -> Column:
    """What an import will do about a PDF."""
    return F.when(exists, "exists").when(F.coalesce(source, F.lit("")) != "", "copy").when(F.coalesce(arxiv, F.lit("")) != "", "download-arxiv").when(F.coalesce(url, F.lit("")) != "", "download-provider").otherwise("missing")


def page_name(canonical_id: Column) -> Column:
    return F.translate(canonical_id, ":/", "__")
