"""Names, weights and word lists that results depend on. They are data; nothing is computed here."""

# Section types kept out of a search and the weights of all types (others weigh 1).
LOW_QUALITY_SECTIONS = ("references", "metadata")
SECTION_WEIGHTS = {
    "abstract": 1.25, "results": 1.25, "conclusion": 1.2, "discussion": 1.15, "methods": 1.05,
    "introduction": 1.0, "body": 1.0, "appendix": 0.8, "metadata": 0.2, "references": 0.05,
}

# What marks a section's type.
REFERENCE_MARKERS = ("references", "bibliography", "works cited", "literature cited")
METADATA_MARKERS = (
    "online content", "publisher", "acknowledg", "author contribution", "competing interest", "data availability",
    "code availability", "supplementary information", "peer review", "reporting summary",
)
METHOD_MARKERS = ("method", "experimental setup", "materials")
RESULT_MARKERS = ("result", "finding", "measurement", "observation")
CONCLUSION_MARKERS = ("conclusion", "summary", "outlook")

# Search scores.
BM25_K1, BM25_B = 1.5, 0.75
TFIDF_WEIGHT, BM25_WEIGHT, PHRASE_BONUS, MIN_SCORE = 0.55, 0.45, 0.05, 0.05

# Names of the schema.
EDGE_CATEGORIES = ("research_areas", "physical_systems", "techniques", "properties", "models", "observables", "datasets", "experiments")
ALLOWED_ROUTES = ("arxiv_source", "pdf_pymupdf", "pdf_mineru")
ROUTE_ALIASES = {"pdf_mineru": "pdf_pymupdf"}
CHUNK_SCHEMA, MANIFEST_SCHEMA, SOURCE_SCHEMA = "darw-chunk-v1", "darw-parsed-evidence-v1", "darw-source-v1"
CHUNK_FIELDS = ("chunk_id", "doc_id", "citation_key", "source_type", "parser", "source_sha256", "section_title", "section_anchor", "text")
MANIFEST_FIELDS = ("doc_id", "citation_key", "route", "parser", "source_sha256", "parsed_markdown", "created_at")
FACETS = {
    "Research Areas": "research_areas", "Physical Systems": "physical_systems", "Techniques": "techniques",
    "Properties": "properties", "Models": "models", "Observables": "observables",
}

# Words by which a label's category is guessed, in the order in which they are tried.
EXPERIMENT_NAMES = ("coherent", "conus", "cresst", "nucleus", "relics-10", "relics-50")
PROPERTY_WORDS = ("electric field", "efficiency", "lifetime", "threshold")
CATEGORY_WORDS = {
    "physical_systems": ("detector", "crystal", "resonator", "wafer", "film", "sensor", "xenon", "cawo4", "bolometer"),
    "techniques": ("spectroscopy", "microscopy", "lithography", "deposition", "measurement", "fabrication", "analysis", "imaging", "noise", "calibration", "getter", "purification", "pulse-shape"),
    "properties": ("conductivity", "temperature", "density", "frequency", "resistance", "noise", "loss", "efficiency", "resolution", "threshold", "magnetic moment"),
    "models": ("model", "theory", "framework", "simulation", "dft", "monte carlo"),
    "observables": ("cross section", "rate", "spectrum", "signal", "background", "recoil"),
    "datasets": ("dataset", "catalog", "survey", "database"),
    "experiments": ("experiment", "facility", "telescope", "collider", "observatory"),
}

# Pairs of words that exclude each other in a term.
OPPOSITES = (("elastic", "inelastic"), ("coherent", "incoherent"), ("bound", "unbound"), ("linear", "nonlinear"))

# Words of the candidate phrases.
STOPWORDS = (
    "abstract", "introduction", "method", "methods", "result", "results", "discussion",
    "conclusion", "figure", "table", "using", "based", "shown", "paper", "study", "analysis",
    "measurement", "measurements", "data", "model", "models", "effect", "effects", "system",
    "systems", "sample", "samples", "experiment", "experiments", "background", "source",
    "used", "use", "with", "this", "report", "reports", "reported", "compare", "compares",
    "compared", "observable", "observables", "article", "articles", "which", "there", "interest",
    "region", "july", "phys", "lett", "picture", "pictures", "omitted", "intentionally",
    "copyright", "published", "received", "accepted", "license", "author", "authors",
    "where", "function", "found", "events", "moreover", "start", "hours", "nature",
    "letters", "publishing", "group", "journal", "review", "caption", "assets", "refer",
    "approx", "displaystyle", "langle", "rangle", "parsed", "pdf", "text", "domain",
    "domains", "obtained", "from", "have", "been", "the", "and", "for", "during",
    "between", "whereas", "however", "while", "respectively", "approximately",
    "expected", "predicted", "included", "described", "observed", "measured",
    "about", "addition", "measure", "shows", "total", "factor",
    "order", "number", "similarly", "important", "improve", "improves", "improved",
    "signature", "signatures", "constrain", "constrains", "constrained",
)
GENERIC_SINGLE_WORDS = (
    "energy", "signal", "physics", "impact", "uncertainty", "counts", "device", "detector", "detectors", "reactor",
    "reactors", "nature", "october", "january", "february", "march", "april", "june", "august", "september", "november", "december",
)
BROAD_WORDS = ("detector", "detectors", "reactor", "reactors")
FRAGMENT_PHRASES = ("coherent elastic", "elastic neutrino", "elastic neutrino nucleus", "coherent elastic neutrino nucleus", "neutrino magnetic", "reactor neutrino")
DOMAIN_WORDS = (
    "background", "bolometer", "calibration", "cawo4", "cevns", "coherent",
    "conus", "cooper", "cryogenic", "dark", "detector", "detectors", "elastic",
    "electron", "field", "flux", "gamma", "getter", "graphene", "lifetime",
    "liquid", "magnetic", "matter", "microwave", "muon", "muons", "neutrino",
    "neutrinos", "nuclear", "nucleus", "outgassing", "phonon", "purification",
    "reactor", "resonator", "scattering", "shield", "superconducting",
    "threshold", "xenon",
)
EDGE_WORDS = (
    "a", "an", "the", "each", "every", "other", "another", "this", "that",
    "these", "those", "first", "second", "third", "former", "latter",
    "future", "current", "previous", "next", "technical", "physics",
    "new", "old", "single", "double", "triple", "three",
)
TRAILING_WORDS = ("detector", "detectors", "experiment", "experiments", "measurement", "measurements", "signal", "signals", "system", "systems", "setup")
SECTION_TITLES_LEFT_OUT = ("abstract", "introduction", "results", "discussion", "conclusion", "references", "acknowledgments", "acknowledgements", "appendix", "technical run", "physics run")

# Where an abstract ends, and marks of paragraphs that a journal puts in.
ABSTRACT_PATTERN = r"(?is)\babstract\b\s*(.*?)(?:\n\s*(?:1\.?\s+)?(?:introduction|keywords|index terms)\b|\n\s*I\.\s+INTRODUCTION\b)"
BOILERPLATE = ("article", "https://doi.org", "received:", "accepted:", "published online", "check for updates")
