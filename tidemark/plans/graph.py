"""Separation queries: customers share a group when they bought the same quantity of the same part in the same year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cast, graph
from tidemark.plans.tables import table

AT = 4
HOP_BOUND = 30


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.concat_ws(
            "-", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.year("l_shipdate").cast("string")
        ).alias("grp"),
    )
    owners = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return items.join(owners, "o_orderkey").select("id", "grp")


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 2 == 0).alias("is_male")
    )


def cast_records(orders: DataFrame, is_male: bool) -> DataFrame:
    """Cast records, one per order: a film, a series, a title that hides its year, and a film with a suffix."""
    year = F.year("o_orderdate")
    return orders.filter((F.col("o_custkey") % 2 == 0) == F.lit(is_male)).select(
        F.concat(
            F.lit("Clerk, "),
            F.col("o_custkey").cast("string"),
            F.lit("\t\tOrder "),
            F.col("o_orderkey").cast("string"),
            F.lit(" ("),
            (year + 12).cast("string"),
            F.lit(')\n\t\t\t"Series ('),
            (year + 20).cast("string"),
            F.lit(')" (2015)\n\t\t\tPart (b) (2014)\n\t\t\tLot '),
            (F.col("o_orderkey") % 100).cast("string"),
            F.lit(" ("),
            (year + 14).cast("string"),
            F.lit("/I) (V)\n\t\t\tNo year"),
        ).alias("value")
    )


def cast_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return cast.parse_casts(cast_records(orders, True), cast_records(orders, False))


def cast_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, members = graph.build_graph(cast_parse(spark, sf_dir))
    films = members.groupBy("id").agg(F.count("*").alias("films"))
    return vertices.join(films, "id").select("id", "name", "is_male", "films")


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence_edges(_members(spark, sf_dir))


def cooccurrence_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence_degrees(cooccurrence_edges(spark, sf_dir))


def _root(spark: SparkSession, sf_dir: str) -> int:
    """The customer first by name, found by that name."""
    vertices = _vertices(spark, sf_dir)
    return graph.find_root(vertices, vertices.agg(F.min("name")).first()[0])


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _vertices(spark, sf_dir).filter(F.col("id") == _root(spark, sf_dir)).select("id")
    return graph.neighbours(_members(spark, sf_dir), root)


def shortest_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_hops(_members(spark, sf_dir), _root(spark, sf_dir))


def _near(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    """Distances up to what is asked for."""
    return graph.shortest_hops(_members(spark, sf_dir), _root(spark, sf_dir), max_hops=hops)


def population_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.population_summary(_vertices(spark, sf_dir), _members(spark, sf_dir))


def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distance_histogram(_near(spark, sf_dir, graph.MAX_DISTANCE), _vertices(spark, sf_dir))


def distance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = graph.distance_totals(distance_histogram(spark, sf_dir), _vertices(spark, sf_dir))
    return totals.withColumns({c: F.round(c, 6) for c in ("ratio", "male_ratio", "female_ratio")})


def at_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = graph.at_distance(_near(spark, sf_dir, AT), _vertices(spark, sf_dir), AT)
    return graph.numbered_names(people).orderBy("is_male", "nth")


def separation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    distances = _near(spark, sf_dir, AT)
    report = graph.separation_report(distances, _vertices(spark, sf_dir), _members(spark, sf_dir), AT)
    return report.orderBy("section", "nth")


QUERIES = {
    f.__name__: f
    for f in (
        cast_parse,
        cast_graph,
        cooccurrence_edges,
        cooccurrence_degrees,
        neighbours,
        shortest_hops,
        population_summary,
        distance_histogram,
        distance_totals,
        at_distance,
        separation_report,
    )
}

_CASTS = """
casts AS (
  SELECT 'Clerk, ' || o_custkey AS actor, o_custkey % 2 = 0 AS is_male,
    'Order ' || o_orderkey || ' (' || (year(o_orderdate) + 12) || ')' AS movie FROM orders WHERE year(o_orderdate) + 12 >= 2011
  UNION ALL
  SELECT 'Clerk, ' || o_custkey, o_custkey % 2 = 0,
    'Lot ' || o_orderkey % 100 || ' (' || (year(o_orderdate) + 14) || '/I)' FROM orders WHERE year(o_orderdate) + 14 >= 2011
)
"""

_MEMBERS = """
members AS (
  SELECT DISTINCT o_custkey AS id, l_partkey || '-' || CAST(l_quantity AS BIGINT) || '-' || year(l_shipdate) AS grp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
pairs AS (SELECT a.id AS src, b.id AS dst, a.grp AS via FROM members a JOIN members b ON a.grp = b.grp WHERE a.id <> b.id),
edges AS (SELECT DISTINCT src, dst FROM pairs),
root AS (SELECT c_custkey AS id FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)),
vertices AS (SELECT c_custkey AS id, c_name AS name, c_custkey % 2 = 0 AS is_male FROM customer)
"""

_HOPS = f"""{_MEMBERS},
walks AS (
  SELECT id, CAST(0 AS BIGINT) AS distance FROM root
  UNION
  SELECT e.dst, w.distance + 1 FROM walks w JOIN edges e ON e.src = w.id WHERE w.distance < {HOP_BOUND}
),
hops AS (SELECT id, min(distance) AS distance FROM walks GROUP BY id)
"""


def _histogram(up_to: int) -> str:
    return f"""{_HOPS},
people AS (SELECT count(*) FILTER (is_male) AS m, count(*) FILTER (NOT is_male) AS f, count(*) AS t FROM vertices),
counts AS (
  SELECT d.distance, count(*) FILTER (is_male) AS males, count(*) FILTER (NOT is_male) AS females
  FROM (SELECT unnest(generate_series(1, {up_to})) AS distance) d
  LEFT JOIN hops h ON h.distance = d.distance LEFT JOIN vertices v ON v.id = h.id GROUP BY d.distance
),
histogram AS (
  SELECT distance, males, females, round(males * 100.0::DOUBLE / m, 1) AS male_percent,
    round(females * 100.0::DOUBLE / f, 1) AS female_percent FROM counts CROSS JOIN people
),
running AS (
  SELECT distance, CAST(sum(males) OVER w AS BIGINT) AS males, CAST(sum(females) OVER w AS BIGINT) AS females
  FROM histogram WINDOW w AS (ORDER BY distance ROWS UNBOUNDED PRECEDING)
),
totals AS (
  SELECT distance, males, females, males + females AS people, (males + females)::DOUBLE / t AS ratio,
    males::DOUBLE / m AS male_ratio, females::DOUBLE / f AS female_ratio FROM running CROSS JOIN people
)
"""


_POPULATION = """
SELECT m AS males, f AS females, t AS total, m * 100 // t AS male_percent, f * 100 // t AS female_percent,
  (SELECT count(DISTINCT grp) FROM members) AS groups
FROM (SELECT count(*) FILTER (is_male) AS m, count(*) FILTER (NOT is_male) AS f, count(*) AS t FROM vertices)
"""

_AT = f"""
SELECT id, name, is_male, row_number() OVER (PARTITION BY is_male ORDER BY name, id) AS nth
FROM hops JOIN vertices USING (id) WHERE distance = {AT}
"""


ORACLES = {
    "cast_parse": f"WITH {_CASTS} SELECT actor, is_male, movie FROM casts",
    "cast_graph": f"""
WITH {_CASTS}
SELECT row_number() OVER (ORDER BY is_male DESC, actor) - 1 AS id, actor AS name, is_male, count(DISTINCT movie) AS films
FROM casts GROUP BY actor, is_male
""",
    "cooccurrence_edges": f"WITH {_MEMBERS} SELECT src, via, count(*) AS others FROM pairs GROUP BY src, via",
    "cooccurrence_degrees": f"WITH {_MEMBERS} SELECT src AS id, count(*) AS edges FROM pairs GROUP BY src",
    "neighbours": f"""
WITH {_MEMBERS}
SELECT DISTINCT m.id FROM members m JOIN members r ON m.grp = r.grp JOIN root ON root.id = r.id
""",
    "shortest_hops": f"WITH RECURSIVE {_HOPS} SELECT id, distance FROM hops",
    "population_summary": f"WITH {_MEMBERS} {_POPULATION}",
    "distance_histogram": f"WITH RECURSIVE {_histogram(6)} SELECT * FROM histogram",
    "distance_totals": f"""
WITH RECURSIVE {_histogram(6)}
SELECT distance, males, females, people, round(ratio, 6) AS ratio, round(male_ratio, 6) AS male_ratio,
  round(female_ratio, 6) AS female_ratio FROM totals
""",
    "at_distance": f"WITH RECURSIVE {_HOPS} {_AT}",
    "separation_report": f"""
WITH RECURSIVE {_histogram(AT)},
population AS ({_POPULATION}), named AS ({_AT}), overall AS (SELECT * FROM totals WHERE distance = {AT})
SELECT 1 AS section, 1::BIGINT AS nth, printf('Total number of actors = %d, out of which %d (%d%%) are males while %d (%d%%) are females.',
  total, males, male_percent, females, female_percent) AS line FROM population
UNION ALL SELECT 2, 1, printf('Total number of movies = %d', groups) FROM population
UNION ALL SELECT 3, distance, printf('There are %d (%.1f%%) actors and %d (%.1f%%) actresses at distance %d',
  males, male_percent, females, female_percent, distance) FROM histogram
UNION ALL SELECT 4, 1, printf('Total number of actors from distance 1 to {AT} = %d, ratio = %.6f', people, ratio) FROM overall
UNION ALL SELECT 5, 1, printf('Total number of male actors from distance 1 to {AT} = %d, ratio = %.6f', males, male_ratio) FROM overall
UNION ALL SELECT 6, 1, printf('Total number of female actors (actresses) from distance 1 to {AT} = %d, ratio = %.6f', females, female_ratio)
  FROM overall
UNION ALL SELECT 7, 0, 'List of male actors at distance {AT}:'
UNION ALL SELECT 8, 0, 'List of female actors (actresses) at distance {AT}:'
UNION ALL SELECT CASE WHEN is_male THEN 7 ELSE 8 END, nth, printf('%d. %s', nth, name) FROM named
""",
}
