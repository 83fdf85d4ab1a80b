import pytest
from pyspark.sql import functions as F

from tests.helpers import lines_of, rows
from tidemark.operators import cast, graph


def films(spark, *lines):
    return [r.movie for r in cast.parse_cast_record(lines_of(spark, "Actor\t\t" + "\n\t\t\t".join(lines)), True).collect()]


def test_titles(spark):
    assert films(spark, '"Series" (2012)', "A (b) (2012)", "A (2010)", "A (2011/I)", "B (2012) (V)", "C") == ["A (2011/I)", "B (2012)"]
    assert films(spark, "2012 odd)") == ["2012 odd)"]


def test_records_without_films(spark):
    assert cast.parse_cast_record(lines_of(spark, "", "\n", "Only Name", "A\t\tX (2000)"), True).isEmpty()


def memberships(spark, *pairs):
    return spark.createDataFrame(pairs, "id long, grp string")


def path(spark):
    """0 - 1 - .. - 6, with 8 - 9 apart, a film with a repeated member, and one nobody shares."""
    pairs = [(i + d, f"g{i}") for i in range(6) for d in (0, 1)]
    return memberships(spark, *pairs, (0, "g0"), (8, "h"), (9, "h"), (3, "alone"))


def people(spark):
    return spark.range(10).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), (F.col("id") % 2 == 0).alias("is_male"))


def test_hops(spark):
    assert rows(graph.shortest_hops(path(spark), 0), "id") == [(i, i) for i in range(7)]
    assert rows(graph.shortest_hops(path(spark), 3, max_hops=1), "id") == [(2, 1), (3, 0), (4, 1)]
    assert rows(graph.shortest_hops(path(spark), 9), "id") == [(8, 1), (9, 0)]


def test_hops_of_neighbours_differ_by_at_most_one(spark):
    pairs = [(i % 60, f"g{i * 7 % 45}") for i in range(150)]
    far = dict(rows(graph.shortest_hops(memberships(spark, *pairs), 0)))
    groups = {}
    for person, group in pairs:
        groups.setdefault(group, set()).add(person)
    for group in groups.values():
        known = [far[p] for p in group if p in far]
        assert not known or (len(known) == len(group) and max(known) - min(known) <= 1)


def test_hops_with_heavy_people_and_groups(spark, monkeypatch):
    heavy = graph.heavy_keys
    monkeypatch.setattr(graph, "heavy_keys", lambda weights, on, weight: heavy(weights, on, weight, min_rows=20))
    crowd = [(i, "crowd") for i in range(100)] + [(0, f"solo{i}") for i in range(50)] + [(100 + i, f"solo{i}") for i in range(50)]
    far = dict(rows(graph.shortest_hops(memberships(spark, *crowd), 120)))
    assert far == {120: 0, 0: 1, **{i: 2 for i in range(1, 100)}, **{100 + i: 2 for i in range(50) if i != 20}}


def test_edges_equal_the_self_join(spark):
    members = memberships(spark, (1, "a"), (2, "a"), (3, "a"), (3, "a"), (3, "b"), (4, "b"), (5, "c"))
    assert rows(graph.cooccurrence_edges(members), "via", "src") == [(1, "a", 2), (2, "a", 2), (3, "a", 2), (3, "b", 1), (4, "b", 1)]
    assert dict(rows(graph.cooccurrence_degrees(graph.cooccurrence_edges(members)))) == {1: 2, 2: 2, 3: 3, 4: 1}
    assert rows(graph.neighbours(members, spark.createDataFrame([(4,)], "id long")), "id") == [(3,), (4,)]


def test_build_graph(spark):
    casts = cast.parse_casts(lines_of(spark, "M\t\tX (2012)\n\t\t\tX (2012)"), lines_of(spark, "F\t\tX (2012)", "M\t\tY (2013)"))
    vertices, members = graph.build_graph(casts)
    assert rows(vertices, "id") == [(0, "M", True), (1, "F", False), (2, "M", False)]
    assert rows(members, "id") == [(0, "X (2012)"), (1, "X (2012)"), (2, "Y (2013)")]


def test_root(spark):
    assert graph.find_root(people(spark), "p4") == 4
    with pytest.raises(ValueError):
        graph.find_root(people(spark), "nobody")


def test_report(spark):
    far = graph.shortest_hops(path(spark), 0)
    assert rows(graph.distance_histogram(far, people(spark)), "distance")[:2] == [(1, 0, 1, 0.0, 20.0), (2, 1, 0, 20.0, 0.0)]
    last = rows(graph.distance_totals(graph.distance_histogram(far, people(spark)), people(spark)), "distance")[-1]
    assert last == (6, 3, 3, 6, 0.6, 0.6, 0.6)
    text = [r.line for r in graph.separation_report(far, people(spark), path(spark)).orderBy("section", "nth").collect()]
    assert text[:2] == [
        "Total number of actors = 10, out of which 5 (50%) are males while 5 (50%) are females.",
        "Total number of movies = 8",
    ]
    assert text[2] == "There are 0 (0.0%) actors and 1 (20.0%) actresses at distance 1"
    assert text[8:] == [
        "Total number of actors from distance 1 to 6 = 6, ratio = 0.600000",
        "Total number of male actors from distance 1 to 6 = 3, ratio = 0.600000",
        "Total number of female actors (actresses) from distance 1 to 6 = 3, ratio = 0.600000",
        "List of male actors at distance 6:",
        "1. p6",
        "List of female actors (actresses) at distance 6:",
    ]
