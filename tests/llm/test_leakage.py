import random

import numpy as np

from leafmill.llm import leakage as L

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mu", "ri", "sto", "ven", "xan") for b in ("dor", "fim", "gal", "hep", "jun", "kra", "lis", "mov", "nep", "pol", "qui", "rast")]


def corpus():
    rng = random.Random(4)
    item = lambda: [rng.choice(WORDS) for _ in range(rng.randint(50, 90))]
    items = {i: item() for i in range(30)}
    noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
    docs, true = [], set()
    for i, words in items.items():
        docs.append((i, " ".join(noise(60) + words + noise(40))))
        true.add((i, i))
        half = words[: int(len(words) * 0.65)]
        docs.append((100 + i, "> " + "\n> ".join([" ".join(noise(9))] + [" ".join(half[k : k + 7]).upper() for k in range(0, len(half), 7)])))
        true.add((100 + i, i))
        docs.append((200 + i, " ".join(noise(80) + words[: int(len(words) * 0.35)] + noise(80))))  # too little
        cut = len(words) // 2
        docs.append((300 + i, " ".join(words[:cut] + noise(50) + words[cut:])))
        true.add((300 + i, i))
        edited = [rng.choice(WORDS) if rng.random() < 0.06 else w for w in words if rng.random() > 0.02]
        docs.append((400 + i, " ".join(noise(30) + edited)))
        true.add((400 + i, i))
        docs.append((500 + i, " ".join(noise(20) + words[cut:] + noise(10) + words[:cut])))  # half of it in order, either way
        true.add((500 + i, i)) if max(cut, len(words) - cut) * 2 >= len(words) else None
    docs += [(900 + i, " ".join(noise(200))) for i in range(50)]
    return {i: " ".join(w) for i, w in items.items()}, docs, true


def test_recall_and_precision_against_what_was_planted(spark):
    items, docs, true = corpus()
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert not found - true
    assert len(found & true) >= 0.97 * len(true)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items, docs, _ = corpus()
    d, e = spark.createDataFrame(docs[:60], "doc_id int, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string")
    want = {tuple(r) for r in L.leaked_items(d, e).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(L, "BLOCK_BYTES", 3000)
    assert {tuple(r) for r in L.leaked_items(d, e).select("doc_id", "item_id").collect()} == want


def test_nulls_empties_repeats_long_texts_and_other_columns(spark):
    items, _, _ = corpus()
    long = " ".join(random.Random(1).choice(WORDS) for _ in range(60_000)) + " " + items[3]
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "short", 0), (4, items[3], 0), (4, items[3], 0), (5, long, 0)], "doc_id int, text string, item int")
    table = spark.createDataFrame([(3, items[3], 0), (4, items[3], 0), (5, None, 0), (6, "", 0)], "item_id int, text string, key int")
    got = sorted((r["doc_id"], r["item_id"]) for r in L.leaked_items(docs, table).collect())
    assert got == [(4, 3), (4, 3), (4, 4), (4, 4), (5, 3), (5, 4)]
    assert L.leaked_items(docs.limit(0), table).count() == 0 and L.leaked_items(docs, table.limit(0)).count() == 0


def test_short_items_stand_anywhere_in_a_text(spark):
    rng = random.Random(8)
    # plenty of words, so that half of a short item never stands in a text by chance
    many = [f"{a}{b}{n}" for a in ("ba", "ke", "lo", "mu") for b in ("dor", "fim", "gal") for n in range(60)]
    items = {n * 10 + k: rng.sample(many, n) for n in (1, 2, 3, 4, 6, 8, 10, 11, 12, 14, 20, 30) for k in range(5)}
    docs = [(i, " ".join([*rng.sample(WORDS, 60), *words, *rng.sample(WORDS, 40)])) for i, words in items.items()]
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id int, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert {(i, i) for i in items} <= found


def test_recall_where_words_are_changed_regularly(spark):
    rng = random.Random(12)
    many = [f"{a}{b}{n}" for a in ("ba", "ke", "lo", "mu") for b in ("dor", "fim", "gal") for n in range(60)]
    items = [[rng.choice(many) for _ in range(60)] for _ in range(60)]
    docs = []
    for every in (4, 5, 6, 8, 12):
        for i, words in enumerate(items):
            changed = [w if n % every != every - 1 else rng.choice(WORDS) for n, w in enumerate(words)]
            docs.append((every * 1000 + i, " ".join([rng.choice(WORDS) for _ in range(50)] + changed + [rng.choice(WORDS) for _ in range(50)])))
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    for every in (4, 5, 6, 8, 12):
        assert sum((every * 1000 + i, i) in found for i in range(60)) >= 0.95 * 60, every
    assert all(d % 1000 == i for d, i in found)


def _chain(item, text, opening):
    """The best chain by trying, for each pair of places, every way on."""
    best = {}
    for i in range(len(item) - 1, -1, -1):
        for j in range(len(text) - 1, -1, -1):
            ways = [(0, 0)]
            if i + 1 < len(item) and j + 1 < len(text):
                for a in range(i + 1, len(item)):
                    for b in range(j + 1, len(text)):
                        score, n = best.get((a, b), (-99, 0))
                        edits = max(a - i, b - j) - 1
                        ways += [(score - L.EDIT_COST * edits, n), (score - opening, n)]
            if item[i] == text[j]:
                score, n = max(ways)
                best[i, j] = score + 1, n + 1
    return max(best.values(), default=(0, 0))


def test_best_chains_against_brute_force():
    rng = random.Random(5)
    items, texts = [], []
    for _ in range(60):
        items.append(np.array([rng.randint(2, 6) for _ in range(rng.randint(1, 9))], dtype=np.int32))
        texts.append(np.array([rng.randint(2, 6) for _ in range(rng.randint(1, 14))], dtype=np.int32))
    got = L.best_chains(items, texts, 3).tolist()
    common = L.common_words(items, texts).tolist()
    for item, text, n, bound in zip(items, texts, got, common, strict=True):
        assert n == _chain(item.tolist(), text.tolist(), 3)[1], (item, text)
        table = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
        for i, a in enumerate(item):
            for j, b in enumerate(text):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        assert bound == table[-1][-1] >= n
