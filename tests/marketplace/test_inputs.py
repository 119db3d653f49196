"""Images, validators, settings, sessions and the trigram index against loops over small tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quoin.operators import validation
from quoin.operators.images import first_images, image_rows, list_verdict, replace_images
from quoin.operators.sessions import presented
from quoin.operators.settings import json_number, json_type, typed, upsert
from quoin.operators.text_index import build_index, containing, trigrams
from quoin.operators.validation import tag, validate

IMAGES = "product_id long, images array<string>"


def test_lists_of_images_are_replaced_as_a_whole(spark):
    old = {1: ["/a", "/b", "/c"], 2: ["/d"], 3: ["/e"], 4: ["/f"], 5: ["/g"]}
    asked = {1: ["/a", "/x"], 2: [], 3: None, 4: ["ftp://no"], 6: ["/n", "https://ok.example/1.jpg"], 7: [f"/{k}" for k in range(9)], 8: []}
    df = spark.createDataFrame([(p, k, u) for p, urls in old.items() for k, u in enumerate(urls)], "product_id long, sort_order int, url string")
    changes = spark.createDataFrame(list(asked.items()), IMAGES)
    assert {r.product_id: r.v for r in changes.select("product_id", list_verdict("images").alias("v")).collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "invalid", 6: "ok", 7: "too_many", 8: "ok"}
    rows = sorted(map(tuple, replace_images(df, changes).collect()))
    assert rows == [(1, 0, "/a", "keep"), (1, 1, "/x", "change"), (1, 2, "/c", "remove"), (2, 0, "/d", "remove"), (3, 0, "/e", "keep"), (4, 0, "/f", "keep"), (5, 0, "/g", "keep"), (6, 0, "/n", "add"), (6, 1, "https://ok.example/1.jpg", "add")]
    left = replace_images(df, changes).filter("action <> 'remove'")
    assert sorted(map(tuple, first_images(left).collect())) == [(1, "/a", 2), (3, "/e", 1), (4, "/f", 1), (5, "/g", 1), (6, "/n", 2)]
    assert image_rows(changes.filter("images is null")).collect() == [] and replace_images(df, changes.limit(0)).count() == 7


def test_types_of_settings(spark):
    values = ["0.12", "-3", "1.5e-1", "1E3", '"0.2"', '{"a": 1}', "[1]", "null", "true", "", "{", None, " 7 ", "00x", "123456789012345678901234567890"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", json_type(F.col("v")).alias("t"), json_number(F.col("v")).alias("n")).orderBy("i").collect()
    assert [r.t for r in rows] == ["number", "number", "number", "number", "string", "object", "array", "null", "boolean", None, None, None, "number", None, "number"]
    assert [r.n for r in rows] == [0.12, -3.0, 0.15, 1000.0, *[None] * 8, 7.0, None, pytest.approx(1.2345678901234568e29)]
    table = spark.createDataFrame([("commission_rate", "0.2"), ("banner", "1")], "key string, value string")
    changes = spark.createDataFrame([("commission_rate", '"0.3"', 1), ("delivery_fee", "0", 1), ("delivery_fee", "4000", 3), ("delivery_fee", "1", 2)], "key string, value string, seq int")
    after = upsert(table, changes)
    assert sorted(map(tuple, after.collect())) == [("banner", "1"), ("commission_rate", '"0.3"'), ("delivery_fee", "4000")]
    assert [tuple(typed(t).first()) for t in (table, after, table.limit(0))] == [(0.2, 5000.0), (0.1, 4000.0), (0.1, 5000.0)]


def test_sessions_against_a_loop(spark):
    rnd, day = random.Random(4), datetime.datetime(2024, 1, 1)
    sessions = [(c, 100 + c, day + datetime.timedelta(hours=c)) for c in range(8)]
    users = [(100 + c, c == 3) for c in range(7)]  # the last session's user isn't there
    log = [(k, rnd.choice([None, *range(9)]), rnd.choice([0, 0, 1, 1, 2, 3, None]), day + datetime.timedelta(hours=rnd.randint(0, 90)), rnd.choice(["refresh"] * 6 + ["logout"])) for k in range(400)]
    got = presented(spark.createDataFrame(sessions, "chain long, user_id long, created_at timestamp_ntz"), spark.createDataFrame(log, "id long, chain long, number long, at timestamp_ntz, kind string").repartition(5), spark.createDataFrame(users, "id long, is_blocked boolean"), days=1).collect()
    state = {c: [0, at, True] for c, _, at in sessions}
    blocked = {c: dict(users).get(u, True) for c, u, _ in sessions}
    begun = {c: at for c, _, at in sessions}
    want = {}
    for k, c, n, at, kind in sorted(log, key=lambda x: (x[3], x[0])):
        s = state.get(c)
        known = s is not None and n is not None and n <= s[0] and at >= begun[c]
        if kind == "logout":
            want[k] = ("ok", None)
            if known and n == s[0]:
                s[2] = False
        elif not known:
            want[k] = ("unknown", None)
        elif n < s[0] or not s[2]:
            want[k] = ("revoked", None)
        elif at >= s[1] + datetime.timedelta(days=1):
            want[k] = ("expired", None)
        else:
            s[0], s[1] = s[0] + 1, at
            want[k] = ("blocked", None) if blocked[c] else ("ok", s[0])
    assert {r.id: (r.verdict, r.issued) for r in got} == want and len(got) == 400
    assert {v for v, _ in want.values()} == {"ok", "unknown", "revoked", "expired", "blocked"}


def test_validators_count_and_reject_in_one_pass(spark):
    rows = [(1, "Good", None), (2, " x ", "a@b.example"), (3, None, "broken"), (4, "n" * 61, ""), (5, "ok", "a b@c.de"), (5, "ok", "x@y.org")]
    df = spark.createDataFrame(rows, "id int, name string, email string")
    want = {1: [], 2: ["profile.name"], 3: ["profile.name", "profile.email"], 4: ["profile.name"], 5: ["profile.email"]}
    done = validate(df.withColumn("broken", F.lit("clash")), "profile")
    assert sorted((r.id, r.broken) for r in done.rejected.collect()) == sorted((k, v) for k, v in want.items() if v)
    assert sorted(r.id for r in done.accepted.collect()) == [1, 5] and done.total == 6
    assert done.counts == {"profile.name": 3, "profile.email": 2}
    none = validate(df.limit(0), "profile")
    assert none.total == 0 and set(none.counts.values()) == {0} and none.accepted.collect() == none.rejected.collect() == []
    platform = spark.createDataFrame([(1, 0.0, 0), (2, 1.01, 100001), (3, None, None)], "id int, commission_rate double, delivery_fee long")
    assert {r.id: r.broken for r in tag(platform, "platform").collect()} == {1: [], 2: ["platform.commission_rate", "platform.delivery_fee"], 3: []}
    assert sum(len(r) for r in validation.rules_by_kind().values()) == 43


def test_trigrams_and_search(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 30))) for _ in range(300)] + [None, "", "ab", "😀😀b", "x" * 500 + "end", "abc" * 200]
    rows = spark.createDataFrame([(k * 700, t) for k, t in enumerate(texts)] + [(None, "abc")], "id long, title string")
    got = {r.id: set(r.g) for r in rows.filter("id is not null").select("id", trigrams(F.col("title")).alias("g")).collect()}
    assert got == {k * 700: {t[i : i + 3] for i in range(len(t) - 2)} if t else set() for k, t in enumerate(texts)}
    index = build_index(rows.filter("id % 1400 = 0"), "id", "title", buckets=8).add(rows.filter("id % 1400 <> 0"), "id", "title").add(rows.limit(5), "id", "title")
    for words in (["abc"], ["a b", "cab"], ["abcabc"], ["ab"], ["ab", "c a"], ["zzz"], [], ["xend"], ["😀😀b"]):
        want = sorted(k * 700 for k, t in enumerate(texts) if (t is not None or not words) and all(w in (t or "") for w in words))
        assert sorted(r.id for r in containing(rows.filter("id is not null"), words, index, text="title").collect()) == want, words
    plan = index.postings(["abc", "bca"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan
    changed = rows.withColumn("title", F.when(F.col("id") == 700, "now abcd").otherwise(F.col("title"))).filter("id is not null")
    index.add(changed.filter("id = 700"), "id", "title")
    assert 700 in {r.id for r in containing(changed, ["abcd"], index, text="title").collect()}
