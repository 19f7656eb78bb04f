import random

from pyspark.sql import functions as F

from leafmill.llm import scans as S

SENTENCES = [
    "The single-crystal detector was measured twice during the cooling of the {a} chamber.",
    "Each resonator of the {a} array remained superconducting below the critical temperature.",
    "One finds a background of several counts for the phonon-mediated {a} readout.",
    "Because the amplifier is stable, its response cannot be told from a {a} substrate.",
    "Only few pulses pass the threshold on the calibrated {a} thermometer of the cryostat.",
]
NAMES = ["electrothermal", "heterogeneous", "longitudinal", "transverse", "polycrystalline", "background", "magnetic", "interfacial"]


def _text(rng, n=6):
    return "## Results of the {} run\n\n".format(rng.choice(NAMES)) + "\n\n".join(" ".join(rng.choice(SENTENCES).format(a=rng.choice(NAMES)) for _ in range(n // 2)) for _ in range(2))


def _pages(seed, count):
    """Noisy pages with the truth about their lines."""
    rng = random.Random(seed)
    rows, truth = [], set()
    titles = ["Electrothermal readout of magnetic detectors at low temperature", "Longitudinal background in the cryostat"]
    for i in range(count):
        lines, kinds, breaks = S.noisy_page(_text(rng), titles, rng)
        truth |= {(i, n, k) for n, k in enumerate(kinds, 1) if k != "text"}
        ends = {left + mark for left, mark, _, joined in breaks if joined}
        body = [n for n, k in enumerate(kinds) if k == "text" and lines[n]]
        truth |= {(i, n + 1, "hyphen") for n in body[:-1] if any(lines[n].endswith(e) for e in ends)}
        for n in body:
            words = lines[n].split()
            for w, word in enumerate(words[:-1]):
                if len(word) > 6 and word.isalpha() and rng.random() < 0.03 and (found := S.misread(word, rng)) and found[0] != word:
                    words[w] = found[0]
                    lines[n] = " ".join(words)
                    truth.add((i, n + 1, "misread"))
                    break
        rows.append((i, "\n".join(lines), 1, 2))
    return rows, truth


SCHEMA = "row_id int, text string, page_start int, page_end int"


def test_held_out_pages(spark):
    rng = random.Random(9)
    clean = [(10_000 + i, _text(rng), None, None) for i in range(150)]
    rows, truth = _pages(77, 60)
    got = {(r["row_id"], r["line_no"], r["kind"]) for r in S.page_traces(spark.createDataFrame(rows + clean, SCHEMA)).collect()}
    for kind in ("header", "page_number", "hyphen", "misread"):
        t, g = {x for x in truth if x[2] == kind}, {x for x in got if x[2] == kind}
        assert len(t & g) >= 0.85 * len(t), (kind, sorted(t - g)[:5])
        assert len(t & g) >= 0.85 * len(g), (kind, sorted(g - t)[:5])


def test_clean_and_odd_rows_have_no_traces(spark):
    rng = random.Random(9)
    rows = [(i, _text(rng), 1, 2) for i in range(40)] + [(100, None, 1, 1), (101, "", 1, 1), (102, "\r\n\r\n", 1, 1), (103, "one line", None, None), (104, "word " * 30_000, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("x")).withColumn("word", F.lit(1))
    assert S.page_traces(df).count() == 0
    assert S.page_traces(df.limit(0)).count() == 0


def test_repeated_rows_each_come_out(spark):
    rng = random.Random(9)
    clean = [(10_000 + i, _text(rng), None, None) for i in range(60)]
    rows, _ = _pages(5, 6)
    once = S.page_traces(spark.createDataFrame(rows + clean, SCHEMA)).select("row_id", "line_no", "kind").distinct().count()
    again = [(r[0] + 500, *r[1:]) for r in rows]
    assert S.page_traces(spark.createDataFrame(rows + again + clean, SCHEMA)).select("row_id", "line_no", "kind").distinct().count() == 2 * once


def test_only_scanned_rows(spark):
    rows, _ = _pages(5, 6)
    assert S.page_traces(spark.createDataFrame(rows, SCHEMA)).count() > 0


def _paragraphs(seed, count):
    """Noisy pages with the clean text of each."""
    rng = random.Random(seed)
    titles = ["Electrothermal readout of magnetic detectors at low temperature", "Longitudinal background in the cryostat"]
    rows, want = [], {}
    for i in range(count):
        text = _text(rng)
        lines, kinds, _ = S.noisy_page(text, titles, rng)
        want[i] = text + ("\n\n" + "\n".join(lines[-n:]) if (n := next((k for k, x in enumerate(reversed(lines)) if not x), 0)) and lines[-n].endswith(":") else "")
        for n, kind in enumerate(kinds):
            words = lines[n].split()
            if kind == "text" and len(words) > 4 and rng.random() < 0.1 and len(words[2]) > 6 and words[2].isalpha() and (found := S.misread(words[2], rng)):
                words[2] = found[0]
                lines[n] = " ".join(words)
        rows.append((i, "\n".join(lines), 1, 2))
    return rows, want


def test_pages_come_out_as_paragraphs(spark):
    rng = random.Random(9)
    clean = [(10_000 + i, _text(rng), None, None) for i in range(150)] + [(20_000, None, 1, 1), (20_001, "", 1, 1), (20_002, "two\r\n\r\nlines", None, None)]
    rows, want = _paragraphs(78, 60)
    got = {r["row_id"]: r["text"] for r in S.repaired_text(spark.createDataFrame(rows + clean, SCHEMA)).collect()}
    assert len(got) == len(rows) + len(clean) and all(got[r[0]] == r[1] for r in clean)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 6, [(got[i], want[i]) for i in wrong[:3]]


def test_rebuilt_lines():
    lines = ["A long enough line of prose with a sensi-", "J. CRYO. 25", "", "tive phonom at KF-", "30971 and the pre-", "and post-scan crystal.", "", "Values:", "12", "35"]
    at = [line.rfind(" ") + 1 for line in lines]
    breaks = [(1, 4, at[0], 0, "sensi-", "tive", True, None), (4, 5, at[3], 0, "KF-", "30971", False, None), (5, 6, at[4], 0, "pre-", "and", False, None)]
    want = "A long enough line of prose with a sensitive phonon at KF-30971 and the pre- and post-scan crystal.\n\nValues:\n12\n35"
    assert S.rebuild("\n".join(lines), {2}, breaks, [(4, 5, "phonom", "phonon")]) == want
    split = [(1, 2, 4, 0, "detec-", "tar", True, "detector")]
    assert S.rebuild("The detec-\ntar of it", set(), split, []) == "The detector of it"
