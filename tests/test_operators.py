"""Edge cases worked out by hand, and brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import emoji, text as T
from tidemark.operators import cleaning, features, identity, kmedoids, levels, metrics, quality, similarity, states, temporal, transcripts


def ts(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


C = "era string, user_key string, comment_id long, media_id long, ts timestamp_ntz, words double"


def test_posts_at_the_same_instant_are_seen(spark):
    posts = frame(spark, [("E", ts(1, 10)), ("E", ts(1, 10)), ("E", ts(2, 9)), ("X", ts(1))], "era string, ts timestamp_ntz")
    comments = frame(spark, [("E", "u", i, 1, t, 1.0) for i, t in enumerate([ts(1, 9), ts(1, 10), ts(2, 8), ts(2, 9), ts(5)])], C)
    got = {r.comment_id: r.posts_seen for r in temporal.posts_seen(comments, posts, by=["era"]).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 3, 4: 3}


@pytest.mark.parametrize("bucket", ["HOUR", "DAY", "MONTH"])
def test_posts_seen_equals_brute_force(spark, bucket):
    r = random.Random(1)
    posts = [(e, ts(r.randint(1, 9), r.randint(0, 3))) for e in "AB" for _ in range(60)]
    comments = [(r.choice("ABC"), "u", i, 1, ts(r.randint(1, 9), r.randint(0, 3)), 1.0) for i in range(200)]
    got = {x.comment_id: x.posts_seen for x in temporal.posts_seen(frame(spark, comments, C), frame(spark, posts, "era string, ts timestamp_ntz"), by=["era"], bucket=bucket).collect()}
    assert got == {c[2]: sum(e == c[0] and t <= c[4] for e, t in posts) for c in comments}


def test_engagement_metrics_by_hand(spark):
    posts = frame(spark, [("E", ts(d)) for d in (1, 2, 2, 2, 8)], "era string, ts timestamp_ntz")
    comments = frame(spark, [("E", "a", 1, 1, ts(1, 5), 2.0), ("E", "a", 2, 1, ts(3), 4.0), ("E", "a", 3, 2, ts(4), 6.0), ("E", "b", 4, 1, ts(9), 1.0), ("E", "b", 5, 1, ts(9), 1.0)], C)
    (a,) = metrics.engagement_metrics(comments, posts, min_comments=3).collect()
    assert (a.user_key, a.comment_count, a.distinct_posts_count, a.engagement) == ("a", 3, 2, 4.0)
    assert a.recency == pytest.approx(1 / 5) and a.clumpiness == pytest.approx(1.5)  # seen 1, 4, 4: steps 3, 0
    with pytest.raises(ValueError):
        metrics.require_posts(posts, ["E", "F"])


def test_last_known_skips_nulls(spark):
    df = frame(spark, [("u", 1, "x", ts(1)), ("u", 2, None, ts(2)), ("v", 3, None, ts(1))], "user_key string, comment_id long, name string, ts timestamp_ntz")
    assert {r.user_key: r.n for r in df.groupBy("user_key").agg(metrics.last_known("name").alias("n")).collect()} == {"u": "x", "v": None}


def test_delay_and_concentration(spark):
    comments = frame(spark, [("P", "u", 1, 7, ts(1, 9, 2), 1.0), ("P", "u", 2, 7, ts(1, 12), 1.0), ("P", "u", 3, 8, ts(1), 1.0), ("P", "u", 4, 9, ts(5), 1.0)], C)
    posts = frame(spark, [(7, ts(1)), (8, ts(2, 3)), (9, ts(5, 1)), (10, ts(6))], "media_id long, ts timestamp_ntz")
    ref = {r.media_id: r.reference for r in metrics.delay_reference(comments, posts).collect()}
    assert ref == {7: ts(1, 9), 8: ts(2, 3), 9: ts(5, 1), 10: ts(6)}
    assert metrics.post_concentration(comments, ["user_key"]).first().gini == pytest.approx(0.625)


def test_cleaning(spark):
    rows = [("1", " ", " Ann ", None), ("2", "  77 ", "Bob", False), ("3", None, "CREATOR", False), ("4", None, None, False), ("5", "9", "x", True)]
    df = frame(spark, rows, "comment_id string, from_id string, from_username string, is_creator boolean")
    b = cleaning.Binding(("comment_id",), creator_names=frozenset({"creator"}))
    assert {r.comment_id: r.user_key for r in cleaning.clean_comments(df, b).collect()} == {"1": "username:ann", "2": "77", "5": "9"}
    flagged = cleaning.Binding(("comment_id",), creator_flag="is_creator")
    assert {r.comment_id for r in cleaning.clean_comments(df, flagged).collect()} == {"2", "3"}  # a null flag goes too
    roots = frame(spark, [(1, 0, 0), (2, None, None), (3, 5, 0)], "cid long, reply_id long, other long")
    assert [r.cid for r in roots.filter(cleaning.is_root(F.col("reply_id"), F.col("other"))).collect()] == [1, 2]
    assert cleaning.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]
    assert [r[0] for r in frame(spark, [("Yes",), (" t",), ("0",), (None,)], "x string").select(cleaning.as_bool(F.col("x"))).collect()] == [True, True, False, None]
    parts = cleaning.split_evenly(spark.range(23).toDF("id"), 5, 23, F.col("id")).groupBy("part").count().collect()
    assert sorted((r["part"], r["count"]) for r in parts) == [(0, 4), (1, 4), (2, 4), (3, 4), (4, 7)]
    filled = cleaning.fill(frame(spark, [(1.0, None), (None, "b"), (3.0, "c")], "v double, s string"), {"s": "none"}, ["v"])
    assert sorted((r.v, r.s) for r in filled.collect()) == [(1.0, "none"), (2.0, "b"), (3.0, "c")]
    canon = cleaning.canonical(frame(spark, [("1", "t"), (None, "u")], "videoId string, name string"), {"id": ["id", "videoid"], "title": ["title", "name"], "x": ["nope"]}, ["id"])
    assert [tuple(r) for r in canon.collect()] == [("1", "t", None)]


def test_windows():
    w = temporal.month_windows(dt.date(2023, 1, 1), dt.date(2026, 3, 31))
    assert len(w) == 36 and (w[0].start, w[0].end, w[0].days) == (dt.date(2023, 1, 1), dt.date(2023, 4, 30), 120) and (w[-1].label, w[-1].start, w[-1].end, w[-1].days) == ("w36", dt.date(2025, 12, 1), dt.date(2026, 3, 31), 121)


def test_window_edges(spark):
    w = temporal.month_windows(dt.date(2023, 1, 1), dt.date(2023, 12, 31))
    df = frame(spark, [(dt.datetime(2023, 4, 30, 23, 59, 59),), (dt.datetime(2022, 12, 31),)], "ts timestamp_ntz")
    assert sorted(r.window_id for r in temporal.explode_windows(df, "ts", w).collect()) == ["w01", "w02", "w03", "w04"]


def test_levels(spark):
    df = frame(spark, [(1.0,), (2.0,), (2.0,), (5.0,), (9.0,), (14.0,)], "v double").withColumn("g", F.lit("g"))
    assert tuple(levels.group_quantiles(df, ["g"], ["v"], [0.33, 0.67]).first())[1:] == pytest.approx((2.0, 6.4))
    cut = frame(spark, [(4.9,), (5.0,), (10.9,), (11.0,), (None,)], "v double").select(levels.three_levels(F.col("v"), 5.0, 11.0, strict=True).alias("l"))
    assert [r.l for r in cut.collect()] == ["Low", "Medium", "Medium", "High", "High"]
    assert [r[0] for r in frame(spark, [(1.0,), (1.1,), (3.1,), (None,)], "v double").select(levels.two_cut(F.col("v"), 1, 3)).collect()] == [1, 2, 3, None]
    t = frame(spark, [("r", 1.0), ("r", 2.0), ("f", 1.0)], "metric string, t double")
    with pytest.raises(ValueError):
        levels.check_thresholds(t, ["r", "f"])
    levels.check_thresholds(t, ["f"])
    same = levels.minmax(frame(spark, [(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"], ["a"]).collect()
    assert [(r.scaled_a, r.scaled_b) for r in same] == [(1.0, 0.5), (0.0, 0.5)]


def test_pam_equals_exhaustive_search_of_swaps():
    rng = np.random.default_rng(3)
    for _ in range(20):
        points = np.array(list({tuple(p) for p in rng.integers(1, 4, (12, 3))}), float)
        w = rng.integers(1, 9, len(points)).astype(float)
        found = kmedoids.pam(points, w, 3)
        dist = kmedoids.manhattan(points)
        cost = lambda m: (dist[list(m)].min(axis=0) * w).sum()
        assert found.cost == pytest.approx(cost(found.medoids))
        for i, c in itertools.product(range(3), range(len(points))):
            other = [*found.medoids[:i], c, *found.medoids[i + 1 :]]
            assert cost(other) >= found.cost - 1e-9
        best = min(cost(m) for m in itertools.combinations(range(len(points)), 3))
        assert kmedoids.alternating(points, w, 3, restarts=60).cost >= best - 1e-9


def test_weighted_silhouette_stands_for_copies():
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(1, 4, (10, 3)), axis=0).astype(float)
    w = rng.integers(1, 5, len(points))
    labels = np.arange(len(points)) % 3
    rows, own = np.repeat(points, w, axis=0), np.repeat(labels, w)
    dist = kmedoids.manhattan(rows)
    total = []
    for i in range(len(rows)):
        mine = own == own[i]
        if mine.sum() == 1:
            total.append(0.0)
            continue
        a = dist[i][mine].sum() / (mine.sum() - 1)
        b = min(dist[i][own == c].mean() for c in set(own.tolist()) - {own[i]})
        total.append((b - a) / max(a, b) if max(a, b) else 0.0)
    assert kmedoids.silhouette(kmedoids.manhattan(points), w.astype(float), labels) == pytest.approx(np.mean(total))


def test_spells_and_hazards(spark):
    df = frame(spark, [("u", i, s) for i, s in enumerate("AABBA", 1)] + [("v", i, s) for i, s in enumerate("ABB", 1)], "user_key string, window_index int, state string")
    runs = states.spells(df)
    got = sorted((r.user_key, r.spell_number, r.state, r.duration, r.next_state) for r in runs.collect())
    assert got == [("u", 1, "A", 2, "B"), ("u", 2, "B", 2, "A"), ("u", 3, "A", 1, None), ("v", 1, "A", 1, "B"), ("v", 2, "B", 2, None)]
    made = frame(spark, [("S", 1, True), ("S", 2, False), ("S", 2, True)], "state string, duration long, has_exit boolean")
    table = states.hazards(made)
    assert [r.hazard for r in table.orderBy("duration").collect()] == pytest.approx([1 / 3, 1 / 2])
    s = states.survival(table).first()
    assert (s.prob_d_ge_2, s.prob_d_ge_3, s.prob_d_ge_4) == pytest.approx((2 / 3, 1 / 3, 0.0))


def test_transition_table_has_every_cell(spark):
    steps = states.transitions(frame(spark, [("u", 1, "A"), ("u", 2, "A"), ("u", 3, "B")], "user_key string, window_index int, state string"))
    got = {(r.from_state, r.to_state): (r.n, r.probability) for r in states.transition_table(steps, ["A", "B", "C"]).collect()}
    assert got[("A", "A")] == (1, 0.5) and got[("A", "B")] == (1, 0.5) and got[("C", "A")] == (0, 0.0) and len(got) == 9


def test_flows_leave_out_the_always_idle(spark):
    df = frame(spark, [("u", 1, "A"), ("u", 2, "Inactive"), ("v", 1, "Inactive"), ("v", 2, "Inactive")], "user_key string, window_index int, state string")
    assert [tuple(r) for r in states.flows(df, [1, 2]).collect()] == [(1, "A", "Inactive", 1)]


@pytest.mark.parametrize(
    "text,single,runs",
    [("\U0001f600\U0001f600\U0001f602 hi", 3, 2), ("1️⃣", 1, 1), ("\U0001f1ee\U0001f1f9", 1, 1), ("\U0001f468‍\U0001f469‍\U0001f467", 1, 1), ("\U0001f44d\U0001f3fd", 1, 1), ("a\U0001f600b", 3, 3), ("", 0, 0), (None, 0, 0), ("it's #fun @me http://a.b/c?d", 4, 4), ("❤️❤️ ❤️", 2, 2)],
)
def test_emoji_words(text, single, runs):
    assert emoji.count_words(text) == single and emoji.count_words(text, True) == runs


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(T.iso_seconds(lit("PT1H2M3S"))) == 3723 and one(T.iso_seconds(lit("PT45S"))) == 45 and one(T.iso_seconds(lit("x"))) is None
    assert one(T.normal_hash(lit("A  b"))) == one(T.normal_hash(lit("a b")))
    assert one(T.token_estimate(lit("12345"))) == 2 and one(T.token_estimate(lit(None).cast("string"))) == 0
    words = " ".join(str(i) for i in range(1500))
    parts = one(T.chunks(lit(words)))
    assert [p.split()[0] for p in parts] == ["0", "1320"] and len(parts[0].split()) == 1440
    assert one(T.chunks(lit("  "))) is None
    raw = "WEBVTT - x\n\n1\n00:00:01.000 --> 00:00:02.000\n<b>Hi</b> there\r\n12\n01:02.5 --> 01:03.5\nyou 1:02.33 end"
    assert one(T.clean_transcript(lit(raw))) == "Hi there you end"
    assert one(T.social_clean(lit("@ann  looove #pizza http://x.y!!!!"))) == "[UTENTE] loove pizza [URL]"
    text = "see youtu.be/abcdefghij1 and https://www.youtube.com/watch?v=abcdefghij2 youtube.com/shorts/abcdefghij3 youtu.be/abcdefghij2"
    assert one(T.links(lit(text), lit("abcdefghij3"))) == ["abcdefghij2", "abcdefghij1"]
    own = lit("abcdefghij1")
    pick = lambda href, text: tuple(one(T.connection(own, T.link_target(lit(href)), T.links(lit(text), own))))
    assert pick("/shorts/abcdefghij2", "") == ("connected", "short", "abcdefghij2", "overlay_link")
    assert pick("/watch?v=abcdefghij1", "youtu.be/abcdefghij4") == ("connected", "long", "abcdefghij4", "description")
    assert pick(None, "") == ("no_connection", "none", None, "not_found")
    got = spark.range(1).select(*[c.alias(n) for n, c in T.comment_features(lit("  Hi @x #y! see https://a.b 7? ")).items()]).first().asDict()
    assert (got["text_length"], got["word_count"], got["url_count"], got["mention_count"], got["hashtag_count"], got["question_count"], got["has_numbers"]) == (28, 6, 1, 1, 1, 1, 1)
    ent = spark.range(1).select(*[c.alias(n) for n, c in T.emoji_features(F.array(lit("a"), lit("a"), lit("b"), lit("c")), lit(8)).items()]).first()
    assert ent.emoji_entropy == pytest.approx(-(0.5 * math.log(0.5) + 0.5 * math.log(0.25))) and ent.emoji_variety_ratio == 0.75
    assert one(T.categories(F.array(lit("x"), lit("y"), lit("x")), {"x": "joy"})) == {"joy": 2, "other": 1}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_ratio():
    assert identity.indel_ratio("abcd", "abed") == 75
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert identity.indel_ratio(a, b) == (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)


def test_fuzzy_matches_equal_brute_force(spark):
    r = random.Random(6)
    names = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 16))) for _ in range(60)]
    b = [(i, n) for i, n in enumerate(names)]
    a = [(i, "".join(ch for k, ch in enumerate(r.choice(names)) if k != r.randint(0, 20)) + r.choice(["", "x", ""])) for i in range(80)]
    want = {}
    for i, n in a:
        if n and n not in names:
            s, j = max(((identity.indel_ratio(n, m), -j) for j, m in b), default=(0, 0))
            if s >= 80:
                want[i] = (-j, s)
    schema = "id long, name string"
    got = {x.a_id: (x.b_id, x.score) for x in identity.fuzzy_matches(frame(spark, a, schema), frame(spark, b, schema), threshold=80).collect()}
    assert got == want and len(want) > 10


def test_containment_equals_brute_force(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(80)]
    longs = [(i, r.choice("AB"), " ".join(r.choice(vocab) for _ in range(60))) for i in range(25)]
    shorts = []
    for i in range(30):
        w = r.choice(longs)[2].split()
        at = r.randint(0, 40)
        shorts.append((i, r.choice("AB"), " ".join(x if r.random() > 0.12 else r.choice(vocab) for x in w[at : at + 15])))
    words = lambda t: t.lower().split()
    want = {}
    for i, ch, t in shorts:
        best = (0, None)
        for j, c, u in longs:
            s, l = words(t), words(u)  # noqa: E741
            if c == ch and len(set(s) & set(l)) / len(set(s)) >= 0.8 and (x := transcripts.matched_share(s, l)) > best[0]:
                best = (x, j)
        if best[0] >= 0.8:
            want[i] = (best[1], best[0])
    schema = "id long, channel string, text string"
    got = {x.short_id: (x.long_id, x.ratio) for x in transcripts.containment(frame(spark, shorts, schema), frame(spark, longs, schema), "channel", "id", "text").collect()}
    assert got == want and len(want) > 3


def test_similarity(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(similarity.cosine(v(1, 0), v(1, 1))) == pytest.approx(2**-0.5)
    assert one(similarity.cosine(v(0, 0), v(1, 1))) == 0.0 and one(similarity.cosine(v(0, 0), v(1, 1), None)) is None
    assert one(similarity.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(similarity.truncated(v(3, 4, 9), 2)) == pytest.approx([0.6, 0.8])


def test_reports(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=400), rng.normal(0.4, 1, 300)
    a, b = (frame(spark, [(float(v),) for v in s], "v double") for s in (x, y))
    grid = np.sort(np.concatenate([x, y]))
    want = np.abs(np.searchsorted(np.sort(x), grid, "right") / 400 - np.searchsorted(np.sort(y), grid, "right") / 300).max()
    ks = quality.ks_statistic(a, b, "v")
    assert ks.first().statistic == pytest.approx(want)
    flags = quality.shift_flags(quality.moments_shift(a, b, "v"), ks)
    assert flags["shifted"] and flags["p_value"] < 0.01
    assert quality.ks_p_value(0.01, 100, 100) == 1.0
    hist = quality.smooth(quality.histogram(a, "v", 24, -6.0, 6.0)).collect()
    assert sum(r.n for r in hist) == 400 and sum(r.smoothed for r in hist) == pytest.approx(sum(r.density for r in hist), rel=1e-3)


def test_media_and_user_features(spark):
    rows = [(1, "m", "a", "ig", None, "hi?"), (2, "m", "a", "ig", 1, "see http://x.y"), (3, "m", "b", "ig", None, "#tag !"), (4, "n", "b", "ig", None, None)]
    df = features.with_comment_features(frame(spark, rows, "comment_id long, media_id string, author_id string, platform string, reply_to long, text string"))
    m = {r.media_id: r for r in features.media_features(df).collect()}
    assert m["m"].comment_volume == 3 and m["m"].author_concentration == pytest.approx(1 / 3) and m["m"].reply_ratio == pytest.approx(1 / 3) and m["m"].interrogative_ratio == pytest.approx(1 / 3)
    assert m["n"].mean_word_count == 0
    u = {r.author_id: r for r in features.user_matrix(df).collect()}
    assert u["a"].total_comments == 2 and u["a"].post_concentration_ratio == 0.5 and u["a"].link_inclusion_rate == 50


def test_selection_guards(spark):
    from tidemark.operators import selection

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k long, w string")
    with pytest.raises(ValueError, match="right side has 2 rows for 1"):
        selection.one_to_one(a, b, ["k"])
    rows = spark.createDataFrame([(None, 3), (None, 1), (1, 5), (1, 4)], "k long, v long")
    assert sorted(map(tuple, selection.prefer(rows, "k", [F.col("v")]).collect()), key=str) == [(1, 4), (None, 1)]
    urls = spark.createDataFrame([("http://x/abc12/1",), ("http://x/zz",), (None,)], "url string")
    names = spark.createDataFrame([("abc1",), ("c12",), ("",), (None,)], "name string")
    assert {r.url: r.folder for r in selection.match_folders(urls, names).collect()} == {"http://x/abc12/1": "abc1", "http://x/zz": None, None: None}


def test_quantiles_equal_exact_ones_on_skewed_values(spark):
    import numpy as np

    from tidemark.operators import quality

    r = np.random.default_rng(3)
    v = np.concatenate([np.zeros(500), r.lognormal(0, 5, 1500), [1e12]])
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate(v)] + [(None, 0)], "v double, g int")
    at = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.999, "e": 1.0}
    got = quality.quantiles(df, "v", at).first()
    assert np.allclose([got[k] for k in at], np.quantile(v, list(at.values())))
    for row in quality.quantiles(df, "v", at, ["g"]).collect():
        assert np.allclose([row[k] for k in at], np.quantile(v[row["g"] :: 2], list(at.values())))
    e = quality.ecdf(df, "v").orderBy("value").collect()
    assert e[0]["cumulative"] == 500 and e[-1]["share"] == 1 and [x["cumulative"] for x in e] == sorted(x["cumulative"] for x in e)


def test_topic_vectors_stop_on_empty_vectors(spark):
    from tidemark.operators import similarity

    w = spark.createDataFrame([("a", "t", 0.0), ("b", "t", 1.0)], "o string, t string, w double")
    assert {(r.o, r.share) for r in similarity.topic_vectors(w, "o", "t", "w", ["t"]).collect()} == {("a", None), ("b", 1.0)}
    with pytest.raises(Exception, match="no weight at all"):
        similarity.topic_vectors(w, "o", "t", "w", ["t"], strict=True).collect()


def test_kmeans_of_several_starts(spark):
    from tidemark.operators import clusters

    df = spark.createDataFrame([(float(i % 3) * 10 + 0.1 * (i % 2), float(i % 3)) for i in range(60)], "x double, y double")
    got = clusters.kmeans(df, ["x", "y"], 3, starts=3, labels={1: 7}).groupBy("cluster").count().collect()
    assert {(r.cluster, r["count"]) for r in got} == {(7, 20), (2, 20), (3, 20)}
