import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.llm import fusion as S

CAND = "cand_id long, entry array<struct<k:string,v:string>>, source string, duplicate_of string, imported_at timestamp, group int, value string"
CHANGE = "change_id long, entry_key string, field string, old_value string, new_value string, changed_at timestamp"


def at(n):
    return datetime.datetime(2024, 1, n)


def _c(i, key, of, when, source="a", **fields):
    return (i, [("ID", key), *fields.items()], source, of, at(when) if when else None, 0, "x")


def _found(spark, cands, changes=()):
    sources = spark.createDataFrame([("a", 1), ("b", 3)], "source string, trust int")
    survivors, members = S.surviving_values(spark.createDataFrame(cands, CAND), spark.createDataFrame(list(changes), CHANGE), sources)
    return {tuple(r) for r in S.surviving_members(survivors, members).collect()}, {(r["group"], r["field"]): r["value"] for r in survivors.collect()}


@pytest.mark.parametrize(
    ("field", "value", "good"),
    [
        ("title", "A whole title", True), ("title", "A title of", False), ("title", "A title …", False), ("title", "A [truncated]", False), ("title", "TBD", False), ("title", " ", False), ("title", None, False),
        ("author", "Doe, J. and Roe, R.", True), ("author", "Doe, J. et al.", False), ("author", "Doe and Roe", False), ("author", "John Doe and Roe, R.", True), ("author", "Doe, J. and others", False), ("author", "KlÃ¶r, M.", False), ("author", "Klör, M.", True),
        ("year", "2020", True), ("year", "20", False), ("year", "201?", False), ("journal", "Journal of Things", True), ("journal", "J. Things", False), ("journal", "Journal of..", False),
        ("doi", "10.1234/ab.1", True), ("doi", "10.1234/", False), ("doi", "10.1234/ab...", False), ("pages", "1--9", True), ("pages", "1--", False), ("pages", "12", False),
        ("abstract", "One. Two.", True), ("abstract", "One. Two", False),
    ],
)
def test_look_of_values(spark, field, value, good):
    assert spark.createDataFrame([(field, value)], "f string, v string").select(S.whole(F.col("f"), F.col("v"))).first()[0] is good


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 200)] + [(300, 301), (301, 302), (302, 300), (400, 400)]
    got = {r["node"]: r["group"] for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in range(100, 200)} == {100} and {got[i] for i in (300, 301, 302)} == {300} and 400 not in got
    assert S.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_latest_trusted_and_cut_values(spark):
    cands = [
        _c(1, "k1", None, 5, title="The rate of", year="2019", doi="10.1234/ab.12"), _c(2, "k2", "[@K1] ", 3, title="The rate of change", year="2020", doi="10.1234/ab.123"), _c(3, "k3", "k2", 3, "b", title="The rate of change", year="2021", doi=None),
        _c(4, "k4", "", 9, title="Alone"), _c(5, "k5", "missing", 9, title="Alone"), _c(6, "k6", "k6", 9, title="Alone"),
    ]
    found, values = _found(spark, cands)
    assert values[1, "title"] == "The rate of change" and values[1, "year"] == "2019" and values[1, "doi"] == "10.1234/ab.123"
    assert found == {(2, "title"), (3, "title"), (1, "year"), (2, "doi")}
    cands[0] = _c(1, "k1", None, 3, title="The rate of", year="2019", doi="x")
    assert _found(spark, cands)[1][1, "year"] == "2021"  # the same time: the most trusted source


def test_changes_back_and_forth(spark):
    cands = [_c(1, "k1", None, 5, year="2019"), _c(2, "k2", "k1", 1, year="2020")]
    forth = (1, "@k2", "year", "2019", "2020", at(10))
    assert _found(spark, cands, [forth, forth, (2, "k1", "year", "2019", "2019", at(20)), (3, "other", "year", "2020", "2019", at(30)), (4, "k1", "year", "2020", "2019", None)])[0] == {(2, "year")}
    assert _found(spark, cands, [(9, "k1", "year", "2020", "2019", at(12)), forth])[0] == {(1, "year")}


def test_currency_orders_values_without_time(spark):
    learnt = [(i, f"z{i}", "title", f"Work {i}: interim note", f"Work {i}", at(3)) for i in range(8)]
    cands = [_c(1, "k1", None, None, "b", title="Big work: interim note"), _c(2, "k2", "k1", None, title="Big work")]
    assert _found(spark, cands, learnt)[0] == {(2, "title")}
    assert _found(spark, cands)[0] == {(1, "title")}  # nothing learnt: the most trusted source


def test_equal_values_unusable_groups_and_empty_tables(spark):
    cands = [_c(1, "k1", None, 5, title="Same", author="???"), _c(2, "k2", "k1", 3, title="Same", author=None), _c(2, "k2", "k1", 3, title="Same", author=None)]
    assert _found(spark, cands)[0] == set()
    assert _found(spark, []) == (set(), {})


def test_group_of_a_third_of_all_rows(spark):
    cands = [_c(i, f"k{i}", "k1" if i > 1 else None, 1 + i % 20, title=f"Title number {i % 7} here", year="2020") for i in range(1, 400)] + [_c(1000 + i, f"s{i}", None, 5, title="x") for i in range(800)]
    found, values = _found(spark, cands)
    assert len(values) == 2 and {f for _, f in found} == {"title"}
    assert all(f"Title number {c % 7} here" == values[1, "title"] for c, _ in found) and len(found) == sum(1 for i in range(1, 400) if f"Title number {i % 7} here" == values[1, "title"])


def test_currency_over_values_that_the_group_lacks(spark):
    many = [(2000 + i, f"v{i}", "title", f"Item {i}: old", f"Item {i}", at(2)) for i in range(6)]
    titles = [_c(1, "k1", None, 5, "b", title="Big item: old"), _c(2, "k2", "k1", 5, "b", title="Big item")]
    assert _found(spark, titles, many)[0] == {(2, "title")}
    undated = [_c(1, "k1", None, None, "b", title="Big item: new: old"), _c(2, "k2", "k1", None, title="Big item")]
    more = [(3000 + i, f"u{i}", "title", f"Thing {i}: new", f"Thing {i}", at(2)) for i in range(6)]
    assert _found(spark, undated, many + more)[0] == {(2, "title")}  # over "Big item: new", which nobody has
    assert _found(spark, undated, many)[0] == {(1, "title")}  # a step short
    assert _found(spark, [_c(1, "k1", None, 9, "b", title="Big item: old"), _c(2, "k2", "k1", 5, title="Big item")], many)[0] == {(1, "title")}  # times decide
