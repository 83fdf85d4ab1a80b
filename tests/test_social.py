import datetime

from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.functions.social import hashtags as tags_of
from tidemark.functions.social import key_label, script_override, strip_social
from tidemark.operators import hashtags, language

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, user string, rt long, text string, ts timestamp_ntz"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


def test_hashtags(spark):
    assert one(spark, "#a b #C-d_e x#no ##z", tags_of("text")) == ["#a", "#C-d_e", "##z"]
    assert one(spark, "#a #a", tags_of("text")) == ["#a", "#a"]
    assert one(spark, "none", tags_of("text")) == []


def test_strip_social(spark):
    assert one(spark, "RT @bob: see https://x.y/z now RT", strip_social("text")) == " : see now RT"


def test_script_override(spark):
    df = spark.createDataFrame([("lt", "ひら"), ("lt", "한글"), ("en", "ひら"), ("lt", "abc")], "lang string, text string")
    assert [r[0] for r in rows(df.select(script_override("lang", "text")))] == ["ja", "ko", "en", "lt"]


def test_growth(spark):
    posts = [(1, "u", 5, "a", at(0)), (1, "u", 9, "b", at(1)), (1, "v", 7, "c", at(2)), (2, "w", 3, "d", at(1))]
    got = hashtags.retweet_growth(spark.createDataFrame(posts, SCHEMA), length=4, slide=2)
    by_window = {(r.id, r.window_start): (r.max_rt, r.min_rt, r.growth, r.user, r.text) for r in got.collect()}
    assert by_window[1, at(0)] == (9, 5, 5, "v", "c")
    assert by_window[1, at(-2)] == (9, 5, 5, "u", "b")
    assert by_window[1, at(2)] == (7, 7, 1, "v", "c")
    assert by_window[2, at(0)] == (3, 3, 1, "w", "d")
    assert len(by_window) == 5


def test_growth_equals_window_function_across_chunks(spark):
    posts = spark.range(3000).select(
        (F.col("id") % 7).alias("id"),
        F.lit("u").alias("user"),
        (F.col("id") * 37 % 101).alias("rt"),
        F.col("id").cast("string").alias("text"),
        (F.expr("timestamp_ntz'2024-01-01'") + F.make_dt_interval(secs=(F.col("id") * 29).cast("decimal(18,6)"))).alias("ts"),
    )
    got = hashtags.retweet_growth(posts, length=120, slide=2)
    want = posts.groupBy(F.window("ts", "120 seconds", "2 seconds").alias("w"), "id").agg(
        F.max("rt").alias("max_rt"), F.min("rt").alias("min_rt"), F.max_by("text", "ts").alias("text")
    )
    columns = ["window_start", "id", "max_rt", "min_rt", "text"]
    want = want.select(F.col("w.start").alias("window_start"), *columns[1:])
    assert got.count() == want.count()
    assert got.select(*columns).exceptAll(want).isEmpty()


def test_zoned_timestamps(spark):
    posts = spark.createDataFrame([(1, "u", 5, "a", at(3))], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    got = hashtags.retweet_growth(posts, length=4, slide=2)
    assert sorted(r.window_start for r in got.collect()) == [at(0), at(2)]


def test_flatten_retweets(spark):
    df = spark.createDataFrame(
        [(1, "a", 2, "t", False, None, None, None, None, T0), (3, "b", 0, "RT", True, 1, "a", 9, "t", T0)],
        "id long, user string, rt long, text string, is_retweet boolean, rt_id long, rt_user string, rt_rt long, "
        "rt_text string, ts timestamp_ntz",
    )
    assert [r[:4] for r in rows(hashtags.flatten_retweets(df), "rt")] == [(1, "a", 2, "t"), (1, "a", 9, "t")]


def growth_rows(spark, *posts):
    """Posts of one window: (id, growth, text)."""
    return spark.createDataFrame(
        [(at(0), at(120), i, f"u{i}", g, t) for i, g, t in posts],
        "window_start timestamp_ntz, window_end timestamp_ntz, id long, user string, growth long, text string",
    )


def test_trend_drops_single_tags_without_growth(spark):
    got = hashtags.hashtag_trend(growth_rows(spark, (1, 1, "#a"), (2, 2, "#b"), (3, 1, "x"), (4, 1, "#c #c")))
    assert sorted((r.key, r.n) for r in got.collect()) == [("#b", 1), ("#c", 2), ("#c", 2), ("3", 0)]


def test_topk_caps_tags_but_not_untagged(spark):
    posts = [(i, 5, "#a") for i in range(5)] + [(i, 5, "plain") for i in range(10, 18)]
    top = hashtags.hashtag_topk(hashtags.hashtag_trend(growth_rows(spark, *posts)))
    labels = [r.label for r in top.orderBy("place").collect()]
    assert labels == ["#a"] * 3 + ["None"] * 7
    assert one(spark, "#x", key_label("text")) == "#x"


def test_language_profiles(spark):
    known = spark.createDataFrame(
        [("the cat and the dog and the house", "en"), ("der hund und die katze und das haus", "de")], "text string, lang string"
    )
    profiles = language.lang_profiles(known, "text")
    assert rows(profiles.filter("lang = 'en' and trigram = 'the'")) == [("en", "the", 3)]
    texts = spark.createDataFrame([(1, "the dog"), (2, "und der Hund"), (3, "123 ..."), (4, "")], "id long, text string")
    found = {r.id: r.detected for r in language.detect_lang(texts, "id", "text", profiles).collect()}
    assert found == {1: "en", 2: "de", 3: None, 4: None}
    kept = language.keep_languages(spark.createDataFrame([("en",), ("fr",), ("no",)], "lang string"))
    assert sorted(r.lang for r in kept.collect()) == ["en", "no"]


def test_distance_is_that_of_the_frequency_vectors(spark):
    known = spark.createDataFrame([("abab", "x"), ("abcc", "y")], "text string, lang string")
    profiles = language.lang_profiles(known, "text")
    got = language.detect_lang(spark.createDataFrame([(1, "ab")], "id long, text string"), "id", "text", profiles).first()
    text = {"_ab": 0.5, "ab_": 0.5}
    vectors = {"x": {"_ab": 0.25, "aba": 0.25, "bab": 0.25, "ab_": 0.25}, "y": {"_ab": 0.25, "abc": 0.25, "bcc": 0.25, "cc_": 0.25}}
    full = {k: sum((v.get(t, 0) - text.get(t, 0)) ** 2 for t in v | text) for k, v in vectors.items()}
    assert got.detected == min(full, key=full.get)
    assert abs(got.distance + sum(p * p for p in text.values()) - full[got.detected]) < 1e-12


def test_words_are_counted_before_they_are_cut(spark):
    """No aggregate holds the trigrams of each text: only those of distinct words are spread."""
    texts = spark.createDataFrame([("en", "the this the")], "lang string, text string")
    plan = language.lang_profiles(texts, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [lang#" in plan and ", word#" in plan.split("Generate explode(transform")[1]
    posts = spark.createDataFrame([(1, "the this")], "id long, text string")
    found = language.detect_lang(posts, "id", "text", language.prepare_profiles(language.lang_profiles(texts, "text")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "trigram#" in line.split("]")[0]]
