import random
from math import floor, isfinite

import numpy as np
import pytest

from quoin.llm import hard_negatives
from quoin.llm.hard_negatives import integer_vectors, mine_hard_negatives


def brute(rows, anchors, positives=5, negatives=10):
    out = []
    for a, label, v in {(i, b, tuple(x)) for i, b, x in anchors}:
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, b) for i, b, w in rows if len(w) == len(v)]
        for s, p in sorted((s, i) for s, i, b in scored if b == label and i != a)[:positives]:
            near = sorted((n, i) for n, i, b in scored if b != label and 30 * -s <= 100 * -n <= 90 * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    schema = "vec_id long, label long, v array<long>"
    return sorted(map(tuple, mine_hard_negatives(spark.createDataFrame(rows, schema), spark.createDataFrame(anchors, schema), **more).collect()))


def test_against_brute_force(spark):
    rnd = random.Random(2)
    for scale, dim in ((60, 8), (2, 3)):  # the second has ties everywhere
        rows = [(k, rnd.randrange(4), [rnd.randint(-scale, scale) for _ in range(dim)]) for k in range(400)]
        rows += [(1000 + k, 1, rows[0][2]) for k in range(300)]  # a large group of copies
        rnd.shuffle(rows)
        anchors = [r for r in rows if r[0] % 20 == 0]
        want = brute(rows, anchors)
        assert mined(spark, rows, anchors) == want and want
        assert mined(spark, rows, anchors, block=7) == want
        assert mined(spark, rows, anchors, positives=2, negatives=3) == brute(rows, anchors, 2, 3)


def test_several_digits_and_full_counters(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELLS", 64)
    monkeypatch.setattr(hard_negatives, "HELD", 100)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(3), [rnd.randint(-300, 300) for _ in range(5)]) for k in range(500)]
    anchors = rows[::100]
    assert mined(spark, rows, anchors) == brute(rows, anchors)


@pytest.mark.parametrize("scale", [3, 10**5, 10**8])
def test_scores_are_exact_in_every_type(spark, scale):
    rnd = random.Random(4)
    rows = [(k, k % 2, [rnd.randint(scale - 2, scale) for _ in range(6)]) for k in range(80)]
    assert mined(spark, rows, rows[::20]) == brute(rows, rows[::20])


def test_odd_rows(spark):
    rows = [(1, 0, [5, 5]), (2, 0, [4, 4]), (3, 1, [3, 3]), (4, 1, [3, 3, 3]), (5, 1, []), (6, 0, []), (2, 0, [4, 4]), (1, 0, [5, 5]), (1, 1, [2, 3])]
    anchors = [rows[0], rows[0], rows[5], (9, 7, [1, 1, 1, 1])]
    assert mined(spark, rows, anchors) == brute(rows, anchors)
    assert mined(spark, rows, []) == [] and mined(spark, [], anchors) == []
    negative = [(0, 0, [1]), (1, 0, [-2]), (2, 1, [-1]), (3, 1, [0]), (4, 0, [0])]
    assert mined(spark, negative, negative[:1]) == brute(negative, negative[:1]) == [(0, 4, 1, 3, 0, 0)]
    with pytest.raises(ValueError):
        mined(spark, [(1, 0, [2**40]), (2, 0, [2**40]), (3, 1, [1])], [(1, 0, [2**40])])


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, -0.001]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [nan]), (5, 1, [-inf]), (6, 1, []), (None, 1, [1.0]), (8, 2, [0.1])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    want = [(k, b, [floor(256 * float(np.float32(x))) for x in v]) for k, b, v in rows if k is not None and b is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    assert sorted((r.vec_id, r.label, r.v) for r in integer_vectors(df).collect()) == want
    clash = df.withColumnsRenamed({"embedding": "v"}).selectExpr("*", "vec_id as score", "label as window")
    assert sorted((r.vec_id, r.label, r.v) for r in integer_vectors(clash, vector="v").collect()) == want
