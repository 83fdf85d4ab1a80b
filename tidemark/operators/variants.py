"""Keys, order and concordance of variant lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.positions import chrom_code

VARIANT_KEY = ["chrom", "pos", "ref", "alt"]
LAST_CHROMOSOME = 24  # fixed value: chromosomes 1 to 24 are written


def variant_key(variants: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt) of the variants on contigs named ``chr..``."""
    return variants.filter(F.col("chrom").contains("chr")).select(*VARIANT_KEY)


def _presence(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row per distinct key and in which of the two sets it is: a single shuffle of already distinct keys."""
    sides = variant_key(reference).select(*VARIANT_KEY, F.lit(1).alias("in_ref"), F.lit(0).alias("in_mine"))
    sides = sides.unionByName(
        variant_key(candidate).select(*VARIANT_KEY, F.lit(0).alias("in_ref"), F.lit(1).alias("in_mine"))
    )
    return sides.groupBy(*VARIANT_KEY).agg(F.max("in_ref").alias("in_ref"), F.max("in_mine").alias("in_mine"))


def variant_concordance(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row (total, matches, diff): distinct reference variants, those the candidate has too, and the rest."""
    counted = _presence(reference, candidate).agg(
        F.count_if(F.col("in_ref") == 1).alias("total"),
        F.count_if((F.col("in_ref") == 1) & (F.col("in_mine") == 1)).alias("matches"),
    )
    return counted.select("total", "matches", (F.col("total") - F.col("matches")).alias("diff"))


def missed_variants(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Distinct reference variants that the candidate lacks."""
    lacking = (F.col("in_ref") == 1) & (F.col("in_mine") == 0)
    return _presence(reference, candidate).filter(lacking).select(*VARIANT_KEY)


def sorted_variants(variants: DataFrame) -> DataFrame:
    """(code, pos, line) of the variants on chromosomes 1 to 24, in order; one range-partitioned sort."""
    coded = variants.select(chrom_code("chrom").alias("code"), "pos", "line")
    return coded.filter(F.col("code").isin(*range(1, LAST_CHROMOSOME + 1))).orderBy("code", "pos", "line")
