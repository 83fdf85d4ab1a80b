"""Fingerprints from which two texts can work out what they do not share: invertible Bloom lookup sketches.

A text is cut into paragraphs (lines; longer ones every 256 code points). Each different paragraph has a 63-bit key: 40 bits
of its MD5, and above them 23 bits that follow from these, so that a key can be told from the XOR of several. A sketch has
four tables of eight cells; a key is XORed into one cell of each, which its own low bits name. The sketches of two texts are
subtracted by XOR: paragraphs of both vanish, and what is left is the sketch of those that one of them has. Peeling takes
every cell that holds one key, takes the key and XORs it out of its four cells, which frees further cells. Another hash of all
keys tells in the end whether the keys taken are the ones put in.

A sketch of 32 cells gives back some twenty keys. So the keys of a text are dealt into groups by further bits, as many as the
paragraphs of both texts ask for, each with its own 32 cells: the sketch grows with the text. Where cells are left over, the
group is retried with a sketch four times as large, and so on, until nothing is left. Keys with all bits equal are one key, so
this ends. The work follows the number of paragraphs, and no text is too long.

Sketches are sums by text and group. All that concerns a text is in one bucket of a table, so sketching, subtracting and
counting need no shuffle. The XOR of a text's groups is its sketch of 32 cells: this, with the number of paragraphs, is the
fingerprint, in hexadecimal, ``<paragraphs>:<32 cells>``.

Likeness is 2 * common / (paragraphs of one + paragraphs of the other), counted as different paragraphs; two texts without
any are alike. It does not see the order of paragraphs or how often one occurs. Only DataFrame operations are used.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text
from tidemark.operators.ordering import ranked
from tidemark.session import materialise, scratch_path

PARAGRAPH = r"[^\n]{1,256}\n*|\n+"
DIGEST_BITS = 40
TABLES, PLACES, PLACE_BITS = 4, 8, 3
CELLS = TABLES * PLACES
#: Check bits are (digest * FACTOR) % PRIME, the largest prime below 2^23; the product stays below 2^63.
FACTOR, PRIME = 7_654_321, 8_388_593
GROUP_KEYS = 12  # keys of two texts that a group holds at most on average
MOST_GROUP_BITS = DIGEST_BITS - TABLES * PLACE_BITS
RETRY_BITS = 2
RETRIES = DIGEST_BITS // RETRY_BITS
COPIES = 1000
CELL_NAMES = [f"c{i}" for i in range(CELLS)]
#: Whose sketch goes into which sum: own text, edited text, own less edited, own less next.
OWN, EDITED, NEAR_EDITED, NEAR_NEXT = range(4)
SUMS = {"keys": (OWN, NEAR_EDITED, NEAR_NEXT), "edited_keys": (EDITED, NEAR_EDITED), "next_keys": (NEAR_NEXT,)}
FACTS = ("key", "variant", "id", "n_chars", "copies", "edited_sha256", "sizes", "bits")


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _bits(key: Column, at: int | Column, n: int) -> Column:
    """``n`` bits of the key from bit ``at`` on."""
    moved = F.shiftright(key, at) if isinstance(at, int) else F.call_function("shiftright", key, at)
    return moved.bitwiseAND(_long((1 << n) - 1))


def _group(key: Column, bits: Column) -> Column:
    mask = F.call_function("shiftleft", _long(1), bits) - 1
    return F.shiftright(key, TABLES * PLACE_BITS).bitwiseAND(mask)


def _check(digest: Column) -> Column:
    return (digest * FACTOR) % PRIME


def _with_check(digest: Column) -> Column:
    return F.shiftleft(_check(digest), DIGEST_BITS) + digest


def paragraph_keys(text: Column) -> Column:
    """The keys of the different paragraphs of a text; null counts as empty, and an empty text has none."""
    parts = F.array_distinct(F.regexp_extract_all(whole_text(text), F.lit(PARAGRAPH), F.lit(0)))
    digest = lambda p: F.conv(F.substring(F.md5(p), 1, DIGEST_BITS // 4), 16, 10).cast("long")
    return F.array_distinct(F.transform(parts, lambda p: _bound(digest(p), _with_check)))


def _table(cells: Column, t: int) -> Column:
    return F.slice(cells, t * PLACES + 1, PLACES)


def _single(cells: Column) -> Column:
    """Keys that are alone in a cell."""

    def alone(t: int, value: Column, place: Column) -> Column:
        digest = value.bitwiseAND(_long((1 << DIGEST_BITS) - 1))
        whole = F.shiftright(value, DIGEST_BITS) == _check(digest)
        return (value != 0) & (_bits(value, t * PLACE_BITS, PLACE_BITS) == place) & whole

    return F.array_distinct(F.concat(*[F.filter(_table(cells, t), partial(alone, t)) for t in range(TABLES)]))


def _less(cells: Column, keys: Column) -> Column:
    """The cells without these keys."""

    def without(t: int, value: Column, place: Column) -> Column:
        out = lambda v, key: F.when(_bits(key, t * PLACE_BITS, PLACE_BITS) == place, _xor(v, key)).otherwise(v)
        return F.aggregate(keys, value, out)

    return F.concat(*[F.transform(_table(cells, t), partial(without, t)) for t in range(TABLES)])


def peel(cells: Column) -> Column:
    """struct(cells, single, found): the keys taken out, and the cells that are left, all zero if it succeeded."""

    def state(cells: Column, found: Column) -> Column:
        return F.struct(cells.alias("cells"), _single(cells).alias("single"), found.alias("found"))

    def round_(s: Column, _: Column) -> Column:
        taken = _bound(_less(s["cells"], s["single"]), lambda c: state(c, F.concat(s["found"], s["single"])))
        return F.when(F.size(s["single"]) == 0, s).otherwise(taken)

    nothing = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(CELLS)), _bound(cells, lambda c: state(c, nothing)), round_)


def _marks(keys: Column) -> Column:
    """The XOR of a hash of each key."""
    return F.aggregate(keys, _long(0), lambda sum_, key: _xor(sum_, F.xxhash64(key)))


def _done(peeled: Column, marks: Column) -> Column:
    """No cell is left, and the keys found are those that were put in: a sum of keys is not taken for a key."""
    return ~F.exists(peeled["cells"], lambda c: c != 0) & (_marks(peeled["found"]) == marks)


def sketch(keys: Column) -> Column:
    """The cells of a set of keys that stands in one row; ``_summed`` does the same for keys in rows."""

    def table(t: int) -> Column:
        def cell(place: Column) -> Column:
            add = lambda sum_, key: F.when(_bits(key, t * PLACE_BITS, PLACE_BITS) == place, _xor(sum_, key)).otherwise(sum_)
            return F.aggregate(keys, _long(0), add)

        return F.transform(F.array(*[_long(p) for p in range(PLACES)]), cell)

    return F.concat(*[table(t) for t in range(TABLES)])


def keys_apart(a: Column, b: Column, from_bit: Column) -> Column:
    """How many keys are in one of ``a`` and ``b`` only: their sketches are subtracted and peeled; on failure both sets are
    dealt into four by the bits from ``from_bit`` on, and the parts tried again."""

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    def dealt(group: Column, retry: Column) -> Column:
        at = (from_bit + retry * RETRY_BITS).cast("int")

        def part(value: Column) -> Column:
            mine = lambda key: _bits(key, at, RETRY_BITS) == value
            return pair(F.filter(group["a"], mine), F.filter(group["b"], mine))

        return F.transform(F.array(*[_long(v) for v in range(1 << RETRY_BITS)]), part)

    def attempt(state: Column, retry: Column) -> Column:
        def tried_(group: Column) -> Column:
            peeled = peel(F.zip_with(sketch(group["a"]), sketch(group["b"]), _xor))
            marks = _xor(_marks(group["a"]), _marks(group["b"]))
            result = lambda p: F.struct(_done(p, marks).alias("done"), F.size(p["found"]).alias("found"))
            return F.struct(group.alias("group"), _bound(peeled, result).alias("peeled"))

        tried = F.transform(state["pending"], tried_)

        def judged(tried: Column) -> Column:
            failed = F.filter(tried, lambda t: ~t["peeled"]["done"])
            pending = F.flatten(F.transform(failed, lambda t: dealt(t["group"], retry)))
            more = F.aggregate(tried, F.lit(0), lambda n, t: n + F.when(t["peeled"]["done"], t["peeled"]["found"]).otherwise(0))
            return F.struct(pending.alias("pending"), (state["found"] + more).alias("found"))

        return F.when(F.size(state["pending"]) == 0, state).otherwise(_bound(tried, judged))

    start = F.struct(F.array(pair(a, b)).alias("pending"), F.lit(0).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES)), start, attempt)["found"]


def _ring(rows: DataFrame) -> DataFrame:
    """One row per key of ``rows``, in a ring by falling id: with the key and half the length of the one before."""
    keys = materialise(rows.groupBy("key").agg(F.first("id").alias("id"), F.first("n_chars").alias("n_chars")), "keys")
    placed = materialise(ranked(keys, [F.col("id").desc_nulls_last(), F.col("key")], name="place"), "places")
    last = placed.count()
    after = F.when(F.col("place") == last, 1).otherwise(F.col("place") + 1)
    before = placed.select(after.alias("place"), F.col("key").alias("before"), F.expr("int(n_chars div 2)").alias("before_half"))
    return materialise(placed.join(before, "place").drop("place"), "ring")


def _paragraphs(rows: DataFrame) -> DataFrame:
    """Rows (key, id, text, n_chars) -> a row per key and what follows it: its facts, and the keys of its paragraphs, of those
    of its edited text and of the text that follows. Written in buckets of ``key``."""
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # the condition holds for all rows; it makes both uses read the same columns, so that the texts are shuffled once
    placed = texts.where("copies > 0").join(_ring(rows), "key")
    prefix = F.substring("text", F.lit(1), F.col("before_half"))
    ahead = placed.select(F.col("before").alias("key"), prefix.alias("after_text"), paragraph_keys(F.col("text")).alias("after_keys"))
    both = placed.withColumn("keys", paragraph_keys(F.col("text"))).join(ahead, "key")
    # of equal rows, all but the last are followed by themselves
    half = F.expr("int(n_chars div 2)")
    last = F.struct(F.lit(0).alias("variant"), F.col("after_text").alias("text"), F.col("after_keys").alias("keys"), _long(1).alias("copies"))
    own = F.substring("text", F.lit(1), half)
    others = F.struct(F.lit(1).alias("variant"), own.alias("text"), F.col("keys").alias("keys"), (F.col("copies") - 1).alias("copies"))
    followed = both.withColumn("next", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next.text"))
    facts = followed.select("key", "next.variant", "id", "n_chars", "next.copies", "keys", edited.alias("edited"), F.col("next.keys").alias("next_keys"))
    return facts.select("*", F.sha2("edited", 256).alias("edited_sha256"), paragraph_keys(F.col("edited")).alias("edited_keys")).drop("edited")


def _with_bits(rows: DataFrame) -> DataFrame:
    """Add ``sizes`` of the three sets, and how many bits name the group of a key."""
    sizes = F.struct(*[F.size(c).alias(c) for c in SUMS])
    most = F.size("keys") + F.greatest(F.size("edited_keys"), F.size("next_keys"))
    bits = F.ceil(F.log2(F.greatest(most, F.lit(1)) / F.lit(GROUP_KEYS))).cast("int")
    return rows.withColumn("sizes", sizes).withColumn("bits", F.least(F.greatest(bits, F.lit(0)), F.lit(MOST_GROUP_BITS)))


def _summed(rows: DataFrame) -> DataFrame:
    """Sketches of the three sets of each row, subtracted: rows (FACTS, sum, group, cells, marks). A row is in one bucket with all
    that is made from it, so nothing is shuffled."""
    sets = F.array(*[F.struct(F.lit(i).alias("set"), F.col(c).alias("keys")) for i, c in enumerate(SUMS)])
    each = rows.select(*FACTS, F.explode(sets).alias("s")).select(*FACTS, "s.set", F.explode_outer("s.keys").alias("k"))
    each = each.withColumn("group", F.coalesce(_group(F.col("k"), F.col("bits")), _long(0)))
    cell = lambda t, p: F.bit_xor(F.when(_bits(F.col("k"), t * PLACE_BITS, PLACE_BITS) == p, F.col("k")))
    cells = [F.coalesce(cell(t, p), _long(0)).alias(f"c{t * PLACES + p}") for t in range(TABLES) for p in range(PLACES)]
    cells.append(F.coalesce(F.bit_xor(F.when(F.col("k").isNotNull(), F.xxhash64("k"))), _long(0)).alias("marks"))
    sketches = each.groupBy(*FACTS, "set", "group").agg(*cells)
    into = F.array(*[F.array(*[F.lit(s) for s in sums]) for sums in SUMS.values()])
    shared = sketches.withColumn("sum", F.explode(into[F.col("set")]))
    group = F.when(F.col("sum") >= NEAR_EDITED, F.col("group")).otherwise(0)
    return shared.withColumn("group", group).groupBy(*FACTS, "sum", "group").agg(*[F.bit_xor(c).alias(c) for c in (*CELL_NAMES, "marks")])


def _printed(size: Column, cells: Column) -> Column:
    digits = F.transform(cells, lambda c: F.lpad(F.lower(F.hex(c)), 16, "0"))
    return F.concat(size.cast("string"), F.lit(":"), F.array_join(digits, ""))


def _peeled(sums: DataFrame) -> DataFrame:
    """Rows of ``_summed`` -> FACTS, the two fingerprints, how many keys were found apart, and the groups that failed."""
    cells = F.array(*CELL_NAMES)
    is_pair = F.col("sum") >= NEAR_EDITED
    taken = lambda p: F.struct(_done(p, F.col("marks")).alias("done"), F.size(p["found"]).alias("found"))
    tried = sums.select(*FACTS, "sum", "group", cells.alias("cells"), F.when(is_pair, _bound(peel(cells), taken)).alias("peeled"))
    done = is_pair & F.col("peeled.done")
    found = lambda s: F.sum(F.when((F.col("sum") == s) & done, F.col("peeled.found")).otherwise(0)).cast("int")
    size = F.when(F.col("sum") == OWN, F.col("sizes.keys")).otherwise(F.col("sizes.edited_keys"))
    return tried.groupBy(*FACTS).agg(
        F.map_from_entries(F.collect_list(F.when(~is_pair, F.struct("sum", _printed(size, F.col("cells")).alias("print"))))).alias("prints"),
        found(NEAR_EDITED).alias("apart_edited"),
        found(NEAR_NEXT).alias("apart_next"),
        F.collect_list(F.when(is_pair & ~done, F.struct("sum", "group"))).alias("failed"),
    )


def _retried(tried: DataFrame, rows: DataFrame) -> DataFrame:
    """Count what the failed groups hold, with larger sketches of their keys."""
    sets = rows.select(F.col("key"), F.col("variant").alias("of"), *SUMS)
    # one of a key's variants: not an equality of columns, so that the join stays one on the buckets
    back = tried.where(F.size("failed") > 0).join(sets, "key").where(F.col("variant") - F.col("of") == 0)

    def apart(sum_: int, other: str) -> Column:
        def of_group(n: Column, f: Column) -> Column:
            mine = lambda key: _group(key, F.col("bits")) == f["group"]
            keys = keys_apart(F.filter("keys", mine), F.filter(other, mine), F.col("bits") + TABLES * PLACE_BITS)
            return n + keys

        return F.aggregate(F.filter("failed", lambda f: f["sum"] == sum_), F.lit(0), of_group)

    more = back.withColumn("apart_edited", F.col("apart_edited") + apart(NEAR_EDITED, "edited_keys"))
    more = more.withColumn("apart_next", F.col("apart_next") + apart(NEAR_NEXT, "next_keys"))
    return tried.where(F.size("failed") == 0).union(more.select(*tried.columns))


def _likeness(a: Column, b: Column, apart: Column) -> Column:
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - apart) / (a + b))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id as ``doc_id``, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next document,
    or by all if it has fewer. Documents follow one another by falling id, then by the MD5 of their text; null ids come
    last, and after the last comes the first, so a single document follows itself. A null text counts as empty. Of rows with
    the same id and the same text, each is followed by the next of them, so all but one have their own text next. Other
    columns are not read. An empty table gives no row.

    A text is shuffled once, and the start that the document before it needs (at most as long as half of that one) once more.
    Only ids, lengths and sums are sorted. Rows that are equal in id and text are counted before they are shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), whole_text(F.col(text)).alias("text"))
    named = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.md5("text"))
    rows = rows.select("id", "text", named.alias("key"), F.length("text").cast("long").alias("n_chars"))
    path = scratch_path(spark, "paragraphs")
    name = "tidemark_" + path.rsplit("/", 1)[1].replace("-", "_")
    # as many buckets as the shuffle that the rows come from has partitions: a task writes one, or some neighbours
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _paragraphs(rows).write.format("parquet").option("path", path).bucketBy(buckets, "key").saveAsTable(name)
    try:
        laid = _with_bits(spark.table(name))
        tried = materialise(_peeled(_summed(laid)), "peeled")
        found = materialise(_retried(tried, laid), "apart")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    # a row for each of the copies, made in two steps so that no long array is built
    lots = F.explode(F.sequence(_long(0), F.expr(f"(copies - 1) div {COPIES}"))).alias("lot")
    left = F.least(F.col("copies") - F.col("lot") * COPIES, F.lit(COPIES)).cast("int")
    each = found.select("*", lots).withColumn("copy", F.explode(F.sequence(F.lit(1), left)))
    return each.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("prints")[OWN].alias("fingerprint"),
        F.col("prints")[EDITED].alias("edited_fingerprint"),
        _likeness(F.col("sizes.keys"), F.col("sizes.edited_keys"), F.col("apart_edited")).alias("near_edited"),
        _likeness(F.col("sizes.keys"), F.col("sizes.next_keys"), F.col("apart_next")).alias("near_next"),
    )
