import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from quoin.llm.components import connected_components
from quoin.llm import ngram_join
from quoin.llm.ngram_join import near_duplicates, op2_ngram_jaccard_join, without_near_duplicates
from quoin.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "Of", "and", "x,", "ÉÉ", *(f"w{k}" for k in range(400))]
    fresh = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage = fresh(60)
    rows, texts = [], []
    for _ in range(40):
        texts.append(fresh(rnd.choice([3, 8, 40, 90, 200])))
    for _ in range(60):
        texts.append(passage[: rnd.randint(40, 60)] + fresh(rnd.choice([0, 1, 3, 10, 80])))
    base = fresh(150)
    for _ in range(120):
        own = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 6, 9])):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
        texts.append(own)
    chain = fresh(120)
    for _ in range(25):
        for _ in range(2):
            chain[rnd.randrange(len(chain))] = f"c{rnd.randrange(10**6)}"
        texts.append(list(chain))
    lines = [" ".join(t) for t in texts] + ["", None, " \t\n", "one", "ONE", "a b c d", "a b c d", "a b c d e", "word " * 2000]
    lines += [rnd.choice(lines) for _ in range(60)]
    rnd.shuffle(lines)
    rows = list(enumerate(lines, 5))
    return rows


def test_hashes_against_plain_words():
    rnd = random.Random(11)
    texts = [None, "", "x" * 600_000 + " a " + "y" * 300_000, ("ab " * 200_000) + "b", *("".join(rnd.choice(["a", "B", "é", " ", "\t", "\n", "\x0b", "\x1c", " ", "ab", "ba"]) for _ in range(rnd.randint(0, 30))) for _ in range(500))]
    plain = [[w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t or "")] for t in texts]
    column = pa.array(["x", *texts, "y"]).slice(1, len(texts))
    known = {}
    for first, words, bounds in word_hashes(column):
        for i in range(len(bounds) - 1):
            own = words[bounds[i] : bounds[i + 1]].tolist()
            assert len(own) == len(plain[first + i])
            for w, h in zip(plain[first + i], own, strict=True):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    shingles = {}
    for t, s in zip(texts, shingle_sets(column), strict=True):
        assert len(s) == len(brute_set(t)) and np.all(s[1:] > s[:-1])
        shingles.setdefault(brute_set(t), s.tobytes())
        assert shingles[brute_set(t)] == s.tobytes()
    assert len(set(shingles.values())) == len(shingles)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 99), (7, 3), (200, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99, 200: 99}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
        want = brute(rows)
        assert got == want
        assert len({c for _, c in want.values()}) < len(rows) - 100


def test_empty_and_repeated_rows(spark, tmp_path):
    spark.createDataFrame([(1, "same text of five words"), (1, "same text of five words"), (2, "same text of five words"), (None, "same text of five words"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op2_ngram_jaccard_join(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 0, None), (None, 1, 1)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert near_duplicates(docs.limit(0)).count() == 0


def brute_rows(rows):
    """The least doc_id of each row's class, rows being judged one by one, whatever their ids."""
    sets = [brute_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for k, s in enumerate(sets):
        for j in range(k):
            if s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                top[find(k)] = find(j)
    return [min(i for x, (i, _) in enumerate(rows) if find(x) == find(k)) for k in range(len(rows))]


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    rnd = random.Random(21)
    fresh = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    near = lambda ws: [*ws[:-1], "changed"]
    a, b = fresh(60), fresh(70)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (3, b), (4, fresh(30)), (4, fresh(30)), (4, []), (5, near(a)), (5, [])]
    rows = [(i, " ".join(t)) for i, t in rows]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
        assert got == sorted((i, len(brute_set(t)), c) for (i, t), c in zip(rows, brute_rows(rows), strict=True))
        kept = sorted((r.doc_id, r.text) for r in without_near_duplicates(docs).collect())
        assert kept == sorted([rows[0], rows[1], *rows[5:8], rows[9]])


def test_stock_passages_make_few_pairs(spark):
    rnd = random.Random(22)
    stock = [[f"p{k}w{j}" for j in range(30)] for k in range(20)]
    rows = [(i, " ".join(w for p in rnd.sample(stock, 10) for w in p)) for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} tail {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    whole = ngram_join.across_components

    def counted(*a):
        out = whole(*a)
        made.append(out.count())
        return out

    ngram_join.across_components = counted
    split, ngram_join.SPLIT = ngram_join.SPLIT, 50
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    finally:
        ngram_join.across_components, ngram_join.SPLIT = whole, split
    assert got == brute(rows)
    assert made[0] < 300


def test_a_shingle_in_very_many_unlinked_documents(spark):
    docs = spark.range(100_000).selectExpr("id as doc_id", "concat_ws(' ', 'one very common line of words', transform(sequence(1, 20), k -> concat('u', id, 'x', k))) as text")
    got = near_duplicates(docs)
    assert got.filter("component_id = doc_id and n_shingles = 22").count() == 100_000


def by_sql(rows):
    """The registered SQL over rows (doc_id, text)."""
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    return sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ngram_join.ORACLE_SQL})").fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_sql_equals_brute_force(seed):
    rows = corpus(seed)
    assert by_sql(rows) == sorted((i, n, c) for i, (n, c) in brute(rows).items())


def test_sql_and_operator_agree_on_repeated_ids(spark):
    rnd = random.Random(8)
    a, b = ([f"w{rnd.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "end"])), (3, " ".join([*b, "end"])), (3, None), (4, ""), (5, "x y"), (6, "X\ty"), (6, "X\ty")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got)) == by_sql(rows)
    assert by_sql([]) == []


def test_extra_columns_with_clashing_names(spark):
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(1, words, 7, "a", 1), (1, "another text of some six words", 7, "b", 2), (2, words, 8, "c", 3), (None, words, 9, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_n int, row string, set_id int")
    out = without_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.row for r in out.collect()) == ["a", "b", "d"]
