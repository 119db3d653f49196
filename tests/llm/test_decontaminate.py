import random
import re

import numpy as np
import pytest

from quoin.llm.decontaminate import BLOCKS, RADIUS, WIDTH, candidates, distances, find_passages, near, op5_benchmark_decontamination, prepare, prints_of, probe, signs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words):
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(docs, items, threshold=0.8):
    """The best window of each item over all windows of all documents, without fingerprints."""
    low = lambda t: [w.lower() for w in WORD.findall(t or "")]
    items = {i: low(t) for i, t in items if low(t)}
    df = {}
    for ws in items.values():
        for s in shingles(ws):
            df[s] = df.get(s, 0) + 1
    weight = lambda ss: sum(np.log1p(len(items) / df[s]) if s in df else np.log1p(len(items)) for s in ss)
    out = {}
    for d, t in docs:
        ws = low(t)
        for i, iw in items.items():
            w = min(len(iw), len(ws))
            if w < min(5, len(iw)):
                continue
            k = min(5, len(iw))
            target = shingles(iw)
            for s in range(len(ws) - w + 1):
                own = {tuple(ws[j : j + k]) for j in range(s, s + w - k + 1)}
                if own & target:
                    p = weight(own & target) / weight(own | target)
                    if p >= threshold - 1e-12 and p > out.get((d, i), (0, 0, 0))[0] + 1e-12:
                        out[d, i] = (p, s, w)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(150)]
    fresh = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, fresh(rnd.choice([2, 4, 5, 14, 30, 31, 59]))) for k in range(20)]
    items.append((20, items[5][1][:10] + fresh(10)))
    docs = []
    for d in range(120):
        words = fresh(rnd.choice([0, 3, 20, 200]))
        if d % 2:
            passage = list(rnd.choice(items)[1])
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                k = rnd.randrange(len(passage))
                passage[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["new"], ["new", "words"]])
            at = rnd.randint(0, len(words))
            words[at:at] = passage
        docs.append((d, rnd.choice([" ", "\n", "  "]).join(words)))
    docs += [(500, None), (501, ""), (502, " \t")]
    return docs, [(i, " ".join(ws)) for i, ws in items] + [(30, None), (31, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_passages_against_all_windows(spark, seed):
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, similarity double").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    rows = find_passages(frame, bench).collect()
    got = {(r.doc_id, r.item_id): (pytest.approx(r.similarity), r.start, r.n_words) for r in rows}
    assert len(rows) == len(got) and len(want) > 30 and {k: want[k] for k in got} == got
    assert len(want) - len(got) <= 0.01 * len(want)
    if seed == 1:
        blocks = find_passages(frame, bench, max_broadcast_items=6)
        assert {(r.doc_id, r.item_id) for r in blocks.collect()} >= {k for k, v in want.items() if v[0] == pytest.approx(1)}


def test_blocks_give_the_same_rows_as_no_blocks(spark):
    rnd = random.Random(9)
    fresh = lambda n: [f"w{rnd.randrange(2000)}" for _ in range(n)]
    template = fresh(16)
    items = [(k, template + fresh(14)) for k in range(18)] + [(k % 3, fresh(20)) for k in range(6)]
    docs = []
    for d in range(150):
        passage = list(items[d % len(items)][1])
        for _ in range(d % 4):
            passage[rnd.randrange(len(passage))] = "new"
        docs.append((d, " ".join(fresh(10) + passage + fresh(10))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string").repartition(3)
    whole, *blocks = (sorted(map(tuple, find_passages(frame, bench, max_broadcast_items=n).collect())) for n in (100, 12, 3, 1))
    assert blocks == [whole] * 3 and len(whole) > 40


def test_multi_index_finds_all_within_the_radius():
    rnd = np.random.default_rng(5)
    prepared = prepare([(i, " ".join(f"x{i}y{k}" for k in range(20))) for i in range(50)])
    prints = prepared.prints[rnd.integers(0, 50, 400)].copy()
    for row in prints:
        for bit in rnd.choice(BLOCKS * WIDTH, rnd.integers(0, 40), replace=False) if rnd.random() < 0.95 else ():
            row[bit // WIDTH] ^= 1 << (bit % WIDTH)
    want = {(a, i) for a, p in enumerate(prints) for i, q in enumerate(prepared.prints) if int(np.bitwise_count(p ^ q).sum()) <= RADIUS}
    assert set(candidates(prepared, prints, np.full(400, 20))) == want and len(want) > 100 and candidates(prepared, prints, np.full(400, 21)) == []
    assert len(near(2)) == 1 + 20 + 190


def test_the_index_keeps_few_pairs_and_loses_few_links():
    rnd = np.random.default_rng(6)
    fresh = lambda n: rnd.integers(0, 2**63, n, dtype=np.uint64)
    prints = lambda sets: prints_of(np.stack([signs(s, np.ones(len(s))).sum(0) for s in sets]))
    items = [fresh(46) for _ in range(2000)]
    prepared = prepare([(0, "a b c d e")])
    prepared.prints, prepared.words = prints(items), np.full(2000, 50)
    pairs = probe(prepared.index, prints([fresh(46) for _ in range(500)]), RADIUS)
    assert len(pairs) < 0.05 * 500 * 2000
    alike = [np.concatenate([s[: len(s) - k], fresh(k)]) for s, k in zip(items, rnd.integers(0, 6, 2000))]  # 41 of 51 shingles shared at least
    close = distances(prints(alike), prepared.prints) <= RADIUS
    assert close.mean() >= 0.99
    close = distances(prints([np.concatenate([s[:41], fresh(5)]) for s in items]), prepared.prints) <= RADIUS
    assert close.mean() >= 0.98


def test_many_items(spark):
    rnd = random.Random(17)
    fresh = lambda n: " ".join(f"v{rnd.randrange(9000)}" for _ in range(n))
    items = [(k, fresh(30)) for k in range(4000)]
    docs = [(d, f"{fresh(20)} {items[37 * d][1]} {fresh(20)}") for d in range(100)]
    got = find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast_items=3000).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got) == [(d, 37 * d, 1.0) for d in range(100)]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "A b c d e f g"), (7, "A b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op5_benchmark_decontamination(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, 7, 0, 7, 1.0), (1, 7, 0, 7, 1.0), (None, 7, 0, 7, 1.0)]
    docs, items = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert find_passages(docs, items.limit(0)).count() == 0 and find_passages(docs.limit(0), items).count() == 0
