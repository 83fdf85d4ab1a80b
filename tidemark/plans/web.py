"""Phone number queries over ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import phones
from tidemark.plans.tables import table
from tidemark.session import materialise, scratch_path
from tidemark.sources import archives
from tidemark.sources.text import read_manifest

URLS_PER_ROW = 20
SPLIT_BYTES = 256 << 10  # small, so that the test tables have several ranges
INNER_RECORD = "\r\n\r\nWARC/1.0\r\nWARC-Target-URI: inside a page\r\nContent-Length: 3\r\n\r\nold\r\n\r\n"
ARCHIVES, CUT_ARCHIVES = 8, 3
CUT_RECORD = "WARC/1.0\r\nWARC-Target-URI: cut\r\nContent-Length: 1000\r\n\r\nshort"
# two that cannot be opened and two without a file system
BAD_ADDRESSES = ("file:/nowhere/at/all", "s3:/no-bucket", "nowhere://archive", "no scheme")


def _dutch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with Dutch numbers added in three spellings; one number is on a third of the pages."""
    digits = F.lpad((F.col("page_id") % 40).cast("string"), 7, "0")
    return table(spark, sf_dir, "pages").select(
        "url",
        F.concat(
            "html",
            F.lit(" tel +31 (0)20-"),
            digits,
            F.lit(" or 00 31-10 "),
            digits,
            F.when(F.col("page_id") % 3 == 0, F.lit(" call +31 6 12345678.")).otherwise(F.lit(".")),
        ).alias("html"),
    )


def phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones.extract_phones(_dutch_pages(spark, sf_dir), "html", "url")


def phone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones.phone_index(phone_extract(spark, sf_dir), urls_per_row=URLS_PER_ROW)


def phone_extract_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = (
        table(spark, sf_dir, "documents")
        .select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
        .unionByName(
            table(spark, sf_dir, "pages").select(
                F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
            )
        )
    )
    return phones.extract_phones(texts, "text", "origin", "id", country="1", digits=10)


def _record(html: Column) -> Column:
    """An HTTP response with this body, and before it a record without target."""
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), html)
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nabout\r\n\r\n"),
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        "url",
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )


def _archives(pages: DataFrame) -> str:
    """Folder of packed archives written from the pages."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "archives")
    written = pages.repartition("url").select(_record(F.col("html")).alias("value"))
    written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)
    return f"{folder}/*.gz"


def _manifest(spark: SparkSession, archives_path: str) -> DataFrame:
    """Their addresses, one a line."""
    manifest = scratch_path(spark, "manifest")
    spark.read.format("binaryFile").load(archives_path).select("path").write.text(manifest)
    return read_manifest(spark, manifest)


def warc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.scan_warc(_manifest(spark, _archives(table(spark, sf_dir, "pages"))))
    return found.select("target_uri", "payload")


def warc_phone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From archives to the phone index; the archives are opened by Spark, in whatever file system they are."""
    records = archives.scan_archive_files(spark, _archives(_dutch_pages(spark, sf_dir))).filter("failure is null")
    found = phones.extract_phones(records, "payload", "target_uri")
    return phones.phone_index(found, "target_uri", URLS_PER_ROW)


def warc_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two archives of all pages, each read by as many tasks as it has ranges; the pages hold archives themselves."""
    pages = table(spark, sf_dir, "pages").select("url", F.concat("html", F.lit(INNER_RECORD)).alias("html"))
    folder = scratch_path(spark, "archives")
    written = pages.repartition(2, "url").select(_record(F.col("html")).alias("value"))
    written.write.option("lineSep", "\r\n\r\n").text(folder)
    found = archives.scan_warc(_manifest(spark, f"{folder}/*.txt"), split_bytes=SPLIT_BYTES)
    return found.select("target_uri", "payload")


def _damaged_archives(pages: DataFrame) -> str:
    """Eight archives of the pages: a fifth of the pages is no UTF-8, three archives end within a record."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "archives")
    body = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("html"))
    whole = pages.select((F.col("page_id") % ARCHIVES).alias("archive"), "page_id", _record(body).alias("value"))
    cut = spark.range(CUT_ARCHIVES).select(F.col("id").alias("archive"), F.lit(None).cast("long").alias("page_id"), F.lit(CUT_RECORD).alias("value"))
    laid = whole.union(cut).repartition("archive").sortWithinPartitions("archive", F.col("page_id").asc_nulls_last())
    laid.drop("page_id").write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)
    return f"{folder}/archive=*/*.gz"


def warc_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive, outcome, n): what became of the records of damaged archives and of bad addresses, then the counters."""
    listed = spark.read.format("binaryFile").load(_damaged_archives(table(spark, sf_dir, "pages"))).select("path")
    bad = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in BAD_ADDRESSES])).alias("path"))
    manifest = scratch_path(spark, "manifest")
    listed.union(bad).write.text(manifest)
    scan, counters = archives.observed(archives.scan_archives(read_manifest(spark, manifest)))
    scanned = materialise(scan.drop("payload"), "scanned")
    archive = F.coalesce(F.nullif(F.regexp_extract("source", "archive=([0-9]+)", 1), F.lit("")), F.lit("none"))
    outcomes = scanned.groupBy(archive.alias("archive"), F.coalesce("failure", F.lit("read")).alias("outcome")).agg(F.count("*").alias("n"))
    counted = spark.createDataFrame([("all", name, n) for name, n in counters.get.items()], outcomes.schema)
    return outcomes.union(counted)


QUERIES = {
    f.__name__: f
    for f in (phone_extract, phone_index, phone_extract_us, warc_scan, warc_split_scan, warc_failures, warc_phone_index)
}


def _numbers(country: str, digits: int) -> str:
    """Distinct numbers of ``text``: without lookbehind the two prefixes are searched one after the other."""
    sep = r"[\(\)\- ]*"
    tail = rf"{sep.join(country)}(?:{sep}\( *?0 *?\))?(?:{sep}[0-9]){{{digits}}}"
    return rf"""list_distinct(list_transform(
      list_concat(regexp_extract_all(text, '[^\p{{Nd}}](00{sep}{tail})', 1), regexp_extract_all(text, '\+{sep}{tail}')),
      lambda x: regexp_replace(regexp_replace(x, '(?:{sep}\( *?0 *?\))|[\(\)\- ]+', '', 'g'), '^00', '+')))"""


_PAGES = """
texts AS (
  SELECT url, html || ' tel +31 (0)20-' || lpad(CAST(page_id % 40 AS VARCHAR), 7, '0') || ' or 00 31-10 '
    || lpad(CAST(page_id % 40 AS VARCHAR), 7, '0')
    || CASE WHEN page_id % 3 = 0 THEN ' call +31 6 12345678.' ELSE '.' END AS text FROM pages
)
"""

_INDEX = f"""
WITH {_PAGES}, found AS (SELECT url, unnest({_numbers('31', 9)}) AS num FROM texts),
placed AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY url) AS pos FROM found)
SELECT num, (pos - 1) // {URLS_PER_ROW} AS part, string_agg(url || chr(9), '' ORDER BY pos) AS urls
FROM placed GROUP BY num, part
"""

ORACLES = {
    "phone_extract": f"WITH {_PAGES} SELECT url, unnest({_numbers('31', 9)}) AS num FROM texts",
    "phone_index": _INDEX,
    "warc_phone_index": _INDEX,
    "warc_scan": "SELECT url AS target_uri, html AS payload FROM pages",
    "warc_split_scan": rf"""
SELECT url AS target_uri, html || replace('{INNER_RECORD.replace(chr(13) + chr(10), "~")}', '~', chr(13) || chr(10)) AS payload FROM pages
""",
    "warc_failures": f"""
SELECT CAST(page_id % {ARCHIVES} AS VARCHAR) AS archive, CASE WHEN page_id % 5 = 0 THEN 'record' ELSE 'read' END AS outcome,
  count(*) AS n FROM pages GROUP BY ALL
UNION ALL SELECT CAST(i AS VARCHAR), 'segment', 1 FROM range({CUT_ARCHIVES}) t(i)
UNION ALL SELECT 'none', 'segment', 2 UNION ALL SELECT 'none', 'skipped', 2
UNION ALL SELECT 'all', 'failed_segments', {CUT_ARCHIVES} + 2
UNION ALL SELECT 'all', 'failed_records', count(*) FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 'all', 'skipped_archives', 2
""",
    "phone_extract_us": f"""
WITH texts AS (
  SELECT 'documents' AS origin, doc_id AS id, text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages
)
SELECT origin, id, unnest({_numbers('1', 10)}) AS num FROM texts
""",
}
