from leafmill.llm import canonical as C

TERMS = [
    (1, "id:1", "Phonon lifetime", "properties", ["PL", " lifetime, phonon "]),
    (2, "id:2", "Thin vibrational drift field", "properties", None),
    (3, "id:3", "Thick acoustic threshold", "properties", []),
    (4, "id:4", "Crystal lattice transition", "research", ["CLT"]),
    (5, "id:5", "Crystal lattice threshold", "properties", ["CLT"]),
    (6, "id:6", "γ-ray resonator", "systems", ["ΓRR", "zöner section no. 108"]),
    (7, "id:7", "Microwave response function", "models", [None, "", "  "]),
]
CASES = [
    ("phonon lieftime", None, "id:1"), ("  PHONON_LIFETIME [6]", None, "id:1"), ("lifetime of the phonon type", None, "id:1"), ("P.L.", None, "id:1"), ("PX", None, ""),
    ("thick vibrational drift field", None, ""), ("Thin vibrational drift fields #3", None, "id:2"), ("CLT", "properties", "id:5"), ("clt", None, "id:4"), ("CLT", "nothing", ""),
    ("the gamma-ray resonator (see Sec. 4)", None, "id:6"), ("zöner section no. 109", None, ""), ("zoner section no. 108", None, "id:6"), ("misrowvae response function", None, "id:7"),
    ("crystallatticetransition, cf. note 3", None, "id:4"), (None, None, ""), ("", None, ""), ("??", "models", ""), ("x" * 20_000, None, ""),
]


def _tables(spark):
    terms = spark.createDataFrame(TERMS, "pos int, canonical_id string, label string, category string, aliases array<string>")
    mentions = spark.createDataFrame([(i, a, b, "old", 9) for i, (a, b, _) in enumerate(CASES)], "mention_id int, raw_term string, category string, canonical_id string, size int")
    return mentions, terms


def test_cases(spark):
    mentions, terms = _tables(spark)
    got = {r["mention_id"]: r["canonical_id"] for r in C.map_values(mentions, terms).collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES))] == [(a, c) for a, _, c in CASES]


def test_pigeonhole_join_finds_all_that_levenshtein_finds(spark):
    """Without the rule of other words, the join must equal a comparison of every pair."""
    import random

    rng = random.Random(5)
    labels = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 22))) for _ in range(40)]
    values = []
    for label in labels * 4:
        text = list(label)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = [rng.choice("abcde")] * rng.randint(0, 1)
        values.append("".join(text))
    refs = spark.createDataFrame([(i, f"id{i}", "c", x, 1, x, ["w"]) for i, x in enumerate(labels)], "pos int, canonical_id string, category string, name string, is_label int, form string, words array<string>")
    asked = spark.createDataFrame([(v, "", v, ["w"]) for v in sorted(set(values)) if v], "raw_term string, category string, form string, words array<string>")
    segments = C._run(spark, C._SEGMENTS, refs=refs)
    probes = C._run(spark, C._PROBES.replace("{most}", str(C.MOST_EDITS)), values=asked, shapes=segments.select("size", "k", "seg_no", "seg_start", "seg_len").distinct())
    got = {(r["raw_term"], r["name"]) for r in C._run(spark, C._NEAR, probes=probes, segments=segments).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def most(n):
        return next((k for size, k in C.EDITS if n <= size), C.MOST_EDITS)

    want = {(v, x) for v in set(values) if v for x in labels if most(len(x)) and edits(v, x) <= most(len(x))}
    assert got == want


def test_unmatched_and_empty_tables(spark):
    mentions, terms = _tables(spark)
    lost = {r["raw_term"] for r in C.unmatched_values(mentions, C.map_values(mentions, terms)).collect()}
    assert "PX" in lost and "P.L." not in lost
    assert C.map_values(mentions.limit(0), terms).count() == 0
    assert {r["canonical_id"] for r in C.map_values(mentions, terms.limit(0)).collect()} == {""}


def test_repeated_rows(spark):
    mentions, terms = _tables(spark)
    assert C.map_values(mentions.unionByName(mentions), terms.unionByName(terms)).count() == 2 * len(CASES)
