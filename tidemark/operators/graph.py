"""Degrees of separation between people who share groups (actors and films).

The graph is kept as memberships (``id``, ``grp``). A group of k members stands for k * (k - 1) edges, which are never
written out: a step from people to people goes over their groups, and touches each membership once.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.positions import div
from tidemark.operators.ordering import ranked
from tidemark.operators.skew import SALT, copy_heavy, heavy_keys, skew_join, spread_heavy
from tidemark.session import bucketed, materialise, scratch_path

MAX_DISTANCE = 6  # fixed value: distances that are reported


def build_graph(casts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, name, is_male) and memberships (id, grp) from (actor, is_male, movie); ids run from 0."""
    casts = materialise(casts, "casts")
    people = casts.select("actor", "is_male").distinct()
    numbered = ranked(people, [F.desc("is_male"), "actor"], name="id").withColumn("id", F.col("id") - 1)
    members = skew_join(casts, numbered, ["actor", "is_male"]).select("id", F.col("movie").alias("grp")).distinct()
    return numbered.select("id", F.col("actor").alias("name"), "is_male"), members


def find_root(vertices: DataFrame, name: str):
    """Id of the person with this name."""
    found = vertices.filter(F.col("name") == name).select("id").first()
    if found is None:
        raise ValueError(f"no vertex named {name!r}")
    return found.id


def cooccurrence_edges(members: DataFrame) -> DataFrame:
    """(src, via, others): each person, a group they share, and how many others it leads to.

    Same edges as joining the memberships with themselves and dropping the pairs of a person with itself, in a form
    that grows with the memberships and not with the square of the group sizes.
    """
    members = members.select("id", "grp").distinct()
    sizes = members.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    edges = skew_join(members, sizes, ["grp"], weights=sizes, weight="size")
    return edges.select(F.col("id").alias("src"), F.col("grp").alias("via"), (F.col("size") - 1).alias("others"))


def cooccurrence_degrees(edges: DataFrame) -> DataFrame:
    """(id, edges): edges that leave each person, one per other member of each shared group."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("others").alias("edges"))


class _Side:
    """Memberships as one of the two joins of a step needs them: by person or by group, salted if some are heavy.

    The heavy keys (at most one per partition) are kept as a small table, because every step reads them.
    """

    def __init__(self, members: DataFrame, key: str):
        heavy = materialise(heavy_keys(members.groupBy(key).count(), [key], "count"), f"heavy-{key}")
        self.key = key
        self.heavy = None if heavy.isEmpty() else heavy
        self.on = [key] if self.heavy is None else [key, SALT]
        self.members = members if self.heavy is None else spread_heavy(members, [key], self.heavy)

    def having(self, keys: DataFrame) -> DataFrame:
        """Memberships of these keys, which must be distinct."""
        wanted = keys if self.heavy is None else copy_heavy(keys, [self.key], self.heavy)
        return self.members.join(wanted, self.on, "left_semi")


def neighbours(members: DataFrame, people: DataFrame) -> DataFrame:
    """(id): everyone who shares a group with one of ``people`` (distinct ids), those included."""
    members = materialise(members.select("id", "grp").distinct(), "members")
    groups = _Side(members, "id").having(people).select("grp").distinct()
    return _Side(members, "grp").having(groups).select("id").distinct()


def shortest_hops(members: DataFrame, source, max_hops: int | None = None) -> DataFrame:
    """(id, distance): fewest steps from ``source`` to everyone it is connected with (itself: 0).

    Each round reads the people reached in the last one, steps to their groups and on to their neighbours, and writes
    those not seen before as the table of its distance; no plan is longer than one round, and a lost executor costs one
    re-read. A group that a person of the last round is in can have been stepped to in the last round only, as it would
    have brought that person earlier, and who is in a new group is as far as the last round or one further. So a round
    reads the groups and people of the last one and nothing older. The memberships are bucketed once by person and once
    by group: a round shuffles what it found.
    """
    spark = members.sparkSession
    shared = cooccurrence_edges(members).select(F.col("src").alias("id"), F.col("via").alias("grp"))
    shared = materialise(shared, "members")
    by_id, by_grp = _Side(shared, "id"), _Side(shared, "grp")
    root = scratch_path(spark, "hops")
    schema = members.select("id").schema

    def reached(distance: int) -> str:
        return f"{root}/distance={distance}"

    spark.createDataFrame([(source,)], schema).write.parquet(reached(0))
    stepped = spark.createDataFrame([], shared.select("grp").schema)
    with (
        bucketed(by_id.members, "by-id", *by_id.on) as by_id.members,
        bucketed(by_grp.members, "by-grp", *by_grp.on) as by_grp.members,
    ):
        for distance in count(1):
            if max_hops is not None and distance > max_hops:
                break
            last = spark.read.schema(schema).parquet(reached(distance - 1))
            groups = by_id.having(last).select("grp").distinct().join(stepped, "grp", "left_anti")
            stepped = materialise(groups, "groups")
            found = by_grp.having(stepped).select("id").distinct().join(last, "id", "left_anti")
            found.write.parquet(reached(distance))
            if spark.read.schema(schema).parquet(reached(distance)).isEmpty():
                break
    everyone = spark.read.schema(schema.add("distance", "long")).parquet(root)
    return everyone.select("id", "distance")


def _total(df: DataFrame, value: Column) -> Column:
    """A single number of the table, as a scalar subquery."""
    return df.agg(value.alias("v")).scalar()


def population_summary(vertices: DataFrame, members: DataFrame) -> DataFrame:
    """One row: people by sex and in all, whole percentages, and the number of groups."""
    people = vertices.agg(
        F.count_if("is_male").alias("males"), F.count_if(~F.col("is_male")).alias("females"), F.count("*").alias("total")
    )
    return people.select(
        "*",
        div(F.col("males") * 100, F.col("total")).alias("male_percent"),
        div(F.col("females") * 100, F.col("total")).alias("female_percent"),
        _total(members, F.count_distinct("grp")).alias("groups"),
    )


def distance_histogram(distances: DataFrame, vertices: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(distance, males, females, male_percent, female_percent) for distances 1 to ``max_distance``."""
    near = distances.filter(F.col("distance").between(1, max_distance))
    counts = (
        near.join(vertices.select("id", "is_male"), "id")
        .groupBy("distance")
        .agg(F.count_if("is_male").alias("males"), F.count_if(~F.col("is_male")).alias("females"))
    )
    each = distances.sparkSession.range(1, max_distance + 1).withColumnRenamed("id", "distance")
    males, females = _total(vertices, F.count_if("is_male")), _total(vertices, F.count_if(~F.col("is_male")))
    return (
        each.join(counts, "distance", "left")
        .na.fill(0, ["males", "females"])
        .select(
            "distance",
            "males",
            "females",
            F.round(F.col("males") * 100.0 / males, 1).alias("male_percent"),
            F.round(F.col("females") * 100.0 / females, 1).alias("female_percent"),
        )
    )


def distance_totals(histogram: DataFrame, vertices: DataFrame) -> DataFrame:
    """Running totals over the distances and their share of the population; the last row is the overall total."""
    # one row per distance, so this window is as short as the histogram
    so_far = Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    males, females = _total(vertices, F.count_if("is_male")), _total(vertices, F.count_if(~F.col("is_male")))
    running = histogram.select(
        "distance", F.sum("males").over(so_far).alias("males"), F.sum("females").over(so_far).alias("females")
    )
    return running.select(
        "*",
        (F.col("males") + F.col("females")).alias("people"),
        ((F.col("males") + F.col("females")) / _total(vertices, F.count("*"))).alias("ratio"),
        (F.col("males") / males).alias("male_ratio"),
        (F.col("females") / females).alias("female_ratio"),
    )


def at_distance(distances: DataFrame, vertices: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, name, is_male) of the people at exactly this distance; sort by name to list them."""
    return distances.filter(F.col("distance") == distance).select("id").join(vertices, "id").select("id", "name", "is_male")


def numbered_names(people: DataFrame) -> DataFrame:
    """Add ``nth``: 1, 2, 3 .. by name within each sex."""
    return ranked(people, ["name", "id"], keys=["is_male"], name="nth")


def separation_report(
    distances: DataFrame, vertices: DataFrame, members: DataFrame, max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """(section, nth, line): the whole report as rows; sort by section and nth to print it.

    Sections: 1 population, 2 groups, 3 distances, 4 to 6 totals, 7 and 8 names of men and women at the last distance, each
    under its heading (nth 0).
    """
    population = population_summary(vertices, members)
    histogram = distance_histogram(distances, vertices, max_distance)
    overall = distance_totals(histogram, vertices).filter(F.col("distance") == max_distance)

    def ratio(name: str) -> Column:
        return F.format_string("%.6f", name)

    def lines(df: DataFrame, section: int, nth: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), nth.cast("long").alias("nth"), line.alias("line"))

    first = F.lit(1)
    # The sentences of the report.
    parts = [
        lines(
            population,
            1,
            first,
            F.format_string(
                "Total number of actors = %d, out of which %d (%d%%) are males while %d (%d%%) are females.",
                "total", "males", "male_percent", "females", "female_percent",
            ),
        ),
        lines(population, 2, first, F.format_string("Total number of movies = %d", "groups")),
        lines(
            histogram,
            3,
            F.col("distance"),
            F.format_string(
                "There are %d (%.1f%%) actors and %d (%.1f%%) actresses at distance %d",
                "males", "male_percent", "females", "female_percent", "distance",
            ),
        ),
    ]
    for section, (who, value, share) in enumerate(
        (("actors", "people", "ratio"), ("male actors", "males", "male_ratio"), ("female actors (actresses)", "females", "female_ratio")), 4
    ):
        text = F.format_string(f"Total number of {who} from distance 1 to {max_distance} = %d, ratio = %s", F.col(value), ratio(share))
        parts.append(lines(overall, section, first, text))
    for section, who in ((7, "male actors"), (8, "female actors (actresses)")):
        parts.append(lines(overall, section, F.lit(0), F.lit(f"List of {who} at distance {max_distance}:")))
    names = numbered_names(at_distance(distances, vertices, max_distance))
    parts.append(
        names.select(
            F.when(F.col("is_male"), 7).otherwise(8).alias("section"), "nth", F.format_string("%d. %s", "nth", "name").alias("line")
        )
    )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
