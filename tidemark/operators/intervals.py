"""Merging and intersecting intervals, in any number of tasks per contig."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.positions import bed_string, div, region_string
from tidemark.operators.ordering import ranked
from tidemark.operators.skew import lookup_join, skew_join
from tidemark.session import materialise

# Fixed value: reads this close to each other belong to one region.
READ_GAP = 51
SLAB = 65_536
INTERSECT_BIN = 1_024
EQUAL_ROWS = 1_000  # equal intervals that stay together
CROWDED = 1 << 22  # pairs of a bin up to which all are compared
STRIP = 64  # starts of a crowded bin that are compared together


def _islands(spans: DataFrame, gap: int, slab: int) -> DataFrame:
    """(key, contig, start, end) of the islands of (key, contig, start, end).

    First only the longest interval of every start is kept, so that a slab of ``slab`` positions has at most that many
    rows, whatever the depth: that bounds every window below. An island opens where the start lies beyond the reach of
    all intervals before it; its end is the reach that the next island finds, or that of the whole contig. What a slab
    needs to know of the slabs before and after it comes from one row per slab. The reduced intervals are written once,
    because both passes read them and the input should be read once.
    """
    longest = materialise(
        spans.groupBy("key", "start")
        .agg(F.max("end").alias("end"), F.min("contig").alias("contig"))
        .withColumn("slab", F.floor(F.col("start") / slab)),
        "spans",
    )
    slabs = longest.groupBy("key", "slab").agg(F.max("end").alias("reach"))
    contig_slabs = Window.partitionBy("key").orderBy("slab")
    reaches = slabs.select(
        "key",
        "slab",
        F.max("reach").over(contig_slabs.rowsBetween(Window.unboundedPreceding, -1)).alias("slab_before"),
        F.max("reach").over(Window.partitionBy("key")).alias("contig_reach"),
    )
    in_slab = Window.partitionBy("key", "slab").orderBy("start")
    before = F.greatest("slab_before", F.max("end").over(in_slab.rowsBetween(Window.unboundedPreceding, -1)))
    opened = (
        longest.join(reaches, ["key", "slab"])
        .withColumn("before", before)
        .filter(F.col("before").isNull() | (F.col("start") > F.col("before") + gap))
    )
    firsts = opened.groupBy("key", "slab").agg(F.min_by("before", "start").alias("first_before"))
    nexts = firsts.select("key", "slab", F.lead("first_before").over(contig_slabs).alias("next_slab"))
    ended = opened.withColumn("next_here", F.lead("before").over(in_slab)).join(nexts, ["key", "slab"])
    return ended.select("key", "contig", "start", F.coalesce("next_here", "next_slab", "contig_reach").alias("end"))


def merge_intervals(df: DataFrame, gap: int = READ_GAP, slab: int = SLAB, by: Sequence[str] = ()) -> DataFrame:
    """(by.., contig, start, end) of the islands of ``df``: an interval joins the island before it if it is on the same
    contig (and has the same ``by``) and starts at most ``gap`` after the island's end."""
    spans = df.select(F.struct(*by, "contig").alias("key"), "contig", "start", "end")
    return _islands(spans, gap, slab).select(*[f"key.{c}" for c in by], "contig", "start", "end")


def merge_intervals_padded(df: DataFrame, pad: int, slab: int = SLAB) -> DataFrame:
    """Islands of intervals widened to the left: joined if the contig is the same in any case of letters and
    ``start - pad`` lies before the island's end; islands start ``pad`` earlier, but not before 1."""
    spans = df.select(F.lower("contig").alias("key"), "contig", "start", "end")
    return _islands(spans, pad - 1, slab).select(
        "contig", F.greatest(F.col("start") - pad, F.lit(1)).alias("start"), "end"
    )


def _counted(df: DataFrame, prefix: str) -> DataFrame:
    """Distinct intervals with how often each occurs, in rows of ``EQUAL_ROWS`` at most: equal rows are then as few in a
    bin as any others, and rows of a pile are told apart by their number."""
    spans = df.filter(F.col("end") > F.col("start")).groupBy("contig", "start", "end").agg(F.count("*").alias("n"))
    piles = spans.withColumn("pile", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("n") - 1, EQUAL_ROWS))))
    times = F.least(F.lit(EQUAL_ROWS).cast("long"), F.col("n") - F.col("pile") * EQUAL_ROWS)
    named = {"start": f"{prefix}_start", "end": f"{prefix}_end", "pile": f"{prefix}_pile", "times": f"{prefix}_times"}
    return materialise(piles.withColumn("times", times).drop("n").withColumnsRenamed(named), f"spans-{prefix}")


def _binned(spans: DataFrame, width: int, prefix: str) -> DataFrame:
    first, last = div(f"{prefix}_start", width), div(F.col(f"{prefix}_end") - 1, width)
    return spans.withColumn("bin", F.explode(F.sequence(first, last)))


def _met_in_strips(points: DataFrame, spans: DataFrame, pos: str, low: Column, high: Column) -> DataFrame:
    """Each of ``points`` with each of ``spans`` of its bin for which low <= pos < high.

    The points of a bin are numbered by position and cut into strips of ``STRIP``. A sort of the points with both ends of the
    spans tells how many points lie before an end, thus which strips a span reaches. It is compared with the points of
    these: all of them but those of the first and the last strip are results.
    """
    names = spans.columns
    edges = spans.select(F.struct(*names).alias("span"), "contig", "bin", F.explode(F.array(low, high)).alias("at"))
    edges = edges.withColumn("point", F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType))
    marks = points.select(F.lit(None).cast(edges.schema["span"].dataType).alias("span"), "contig", "bin", F.col(pos).alias("at"), F.struct("*").alias("point"))
    is_point, keys = F.col("point").isNotNull(), ["contig", "bin"]
    among = materialise(ranked(edges.union(marks), ["at", is_point, "span", "point"], keys=keys, name="among"), "among")
    counted = ranked(among.filter(~is_point), ["among"], keys=keys, name="nth")
    before = counted.groupBy("contig", "bin", "span").agg(F.min(F.col("among") - F.col("nth")).alias("first"), F.max(F.col("among") - F.col("nth")).alias("last"))
    reached = before.filter("last > first").select("span.*", F.explode(F.sequence(div("first", STRIP), div(F.col("last") - 1, STRIP))).alias("strip"))
    numbered = ranked(among.filter(is_point), ["among"], keys=keys, name="nth")
    strips = numbered.select("point.*", div(F.col("nth") - 1, STRIP).alias("strip"))
    return skew_join(reached, strips, [*keys, "strip"]).filter((low <= F.col(pos)) & (F.col(pos) < high))


def _met_in_crowds(left: DataFrame, right: DataFrame, bin_width: int) -> DataFrame:
    """Pairs whose overlap begins in their bin: there begins one of the two, within the other."""
    starting = lambda rows, pos: rows.filter(F.col("bin") == div(pos, bin_width))
    columns = ["contig", "a_start", "a_end", "a_times", "b_start", "b_end", "b_times"]
    in_a = _met_in_strips(starting(right, "b_start"), left, "b_start", F.col("a_start"), F.col("a_end"))
    in_b = _met_in_strips(starting(left, "a_start"), right, "a_start", F.col("b_start") + 1, F.col("b_end"))
    return in_a.select(*columns).union(in_b.select(*columns))


def interval_intersect(a: DataFrame, b: DataFrame, bin_width: int = INTERSECT_BIN) -> DataFrame:
    """(contig, start, end, a_start, a_end, b_start, b_end): one row per overlap of half-open intervals.

    Intervals meet in the bins they cover and the pair is kept in the bin where the overlap begins, so there is no
    comparison beyond the neighbourhood and no row twice. Choose ``bin_width`` near the usual interval length. A bin with
    more than ``CROWDED`` pairs is cut by the order of its starts: n intervals with c overlaps take the sorting of n rows and
    the order of c + n comparisons, however crowded the bin. Equal intervals are counted first and repeated at the end.
    """
    left, right = (_binned(_counted(df, side), bin_width, side) for df, side in ((a, "a"), (b, "b")))
    start, end, keys = F.greatest("a_start", "b_start"), F.least("a_end", "b_end"), ["contig", "bin"]
    sizes = [side.groupBy(*keys).agg(F.count("*").alias(f"n_{name}")) for side, name in ((left, "a"), (right, "b"))]
    shared = materialise(sizes[0].join(sizes[1], keys), "bins")
    crowded = materialise(shared.filter(F.col("n_a").cast("double") * F.col("n_b") > CROWDED).select(*keys), "crowded")
    columns = ["contig", "a_start", "a_end", "a_times", "b_start", "b_end", "b_times"]
    if crowded.isEmpty():
        met = skew_join(left, right, keys, weights=shared, weight="n_a")
    else:
        plain = shared.join(crowded, keys, "left_anti")
        met = skew_join(lookup_join(left, crowded, keys, "left_anti"), right, keys, weights=plain, weight="n_a")
    met = met.filter((start < end) & (F.col("bin") == div(start, bin_width))).select(*columns)
    if not crowded.isEmpty():
        sides = [materialise(lookup_join(side, crowded, keys, "left_semi"), "crowd") for side in (left, right)]
        met = met.union(_met_in_crowds(*sides, bin_width))
    columns = ["contig", start.alias("start"), end.alias("end"), "a_start", "a_end", "b_start", "b_end"]
    each = met.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("a_times") * F.col("b_times"))).alias("_nth"))
    return each.drop("_nth")


def to_bed(df: DataFrame, half_open: bool = False) -> DataFrame:
    """BED lines as ``value``."""
    return df.select(bed_string(half_open=half_open).alias("value"))


def to_region(df: DataFrame) -> DataFrame:
    """``contig:start-end`` lines as ``value``."""
    return df.select(region_string().alias("value"))


def region_envelope(df: DataFrame, *group: str | Column) -> DataFrame:
    """Per group of regions: first start, end of the last region, number of regions, and a label made of them."""
    summary = df.groupBy(*group).agg(
        F.min(F.struct("contig", "start", "end")).alias("first"),
        F.max(F.struct("contig", "start", "end")).alias("last"),
        F.count("*").alias("regions"),
    )
    label = F.format_string("%dregions_%s-%d", "regions", "first.contig", "first.start")
    kept = [c for c in summary.columns if c not in ("first", "last", "regions")]
    return summary.select(
        *kept, F.col("first.start").alias("start"), F.col("last.end").alias("end"), "regions", label.alias("label")
    )
