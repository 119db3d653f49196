import random
import re
from itertools import permutations

import numpy as np

from quoin.llm import filter_audit
from quoin.llm.filter_audit import FILTERS, all_orders, audit_filters, count_prefixes, prefix_sums, with_repeats

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def simulate(rows, filters="ABCDE"):
    """rows: (part, failures, good, toxic). Every order is applied to the rows one filter after another."""
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations(filters):
            left = list(own)
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step + 1, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted(tuple(r[:-1]) + (shapley[r[0], r[-1]],) for r in out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_bitsets_count_as_sets_do():
    rnd = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 1000):
        flags = rnd.random((n, 5)) < 0.4
        for prefix, k, kept, removed, a, b in count_prefixes(flags, 3).tolist():
            left = ~np.any(flags[:, [j for j in range(3) if prefix >> j & 1]], axis=1)
            hit = left & flags[:, k]
            assert (kept, removed, a, b) == ((left & ~flags[:, k]).sum(), hit.sum(), (hit & flags[:, 3]).sum(), (hit & flags[:, 4]).sum())


def test_every_order_against_a_simulation(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK", 50)
    rnd = random.Random(4)
    rows = [(rnd.choice([None, "", "en", "de", "x" * 300]), *(rnd.choice([True, False, None]) for _ in range(3)), rnd.random() < 0.5, rnd.random() < 0.2) for _ in range(700)]
    df = spark.createDataFrame(rows, "lang string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    sums = prefix_sums(df, list("ABC"), ["good", "toxic"], part="lang")
    want = simulate([(r[0] or "", {f for f, x in zip("ABC", r[1:4], strict=True) if x}, r[4], r[5]) for r in rows], "ABC")
    assert got(all_orders(sums, list("ABC"), ["good", "toxic"]).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})) == want


def test_documents_against_brute_force(spark):
    rnd = random.Random(8)
    base = ["", "one two", "A" * 30, "a$ b", "w " * 150, " ".join(f"w{k}" for k in range(120)), " ".join(f"W{k}X" for k in range(120)), "é x " * 60, "same text # here " * 30, "\x0b\x0c tab\tnew\n" * 3, " ".join(f"q{k % 81}" for k in range(100)), "x" * 200_000]
    rows = [(k, rnd.choice(base), rnd.choice(["en", "de", None, ""]), "web", 1, "clash") for k in range(300)]
    rows += [(None, base[5], "en", None, None, None), (400, None, "de", None, None, None), (5, base[3], "en", "web", 1, None), (5, base[3], "en", "web", 1, None), (-7, base[3], "fr", "web", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), None if k % 5 else k % 4 // 2) for k in range(0, 300, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    said = {}
    for r in labels.collect():
        good, toxic = said.get(r.doc_id, (False, False))
        said[r.doc_id] = (good or r.quality == 1, toxic or r.toxic == 1)
    plain = []
    for k, t, lang, *_ in rows:
        t, words = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if k is not None and any(q[0] is not None and q[0] < k and (q[1] or "") == t for q in rows) else set()
        plain.append((lang or "", fails, *(said.get(k, (False, False)) if k is not None else (False, False))))
    assert got(audit_filters(docs, labels)) == simulate(plain)
    assert audit_filters(docs.limit(0), labels).collect() == []
    assert all(r.good_lost == r.toxic_lost == 0 for r in audit_filters(docs, labels.limit(0)).collect())


def test_common_and_rare_keys_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k % 7 if k % 3 else 100) for k in range(200)] + [(None, 100)], "doc_id long, key long")
    want = None
    for share in (0.0001, 0.1, 2.0):
        monkeypatch.setattr(filter_audit, "COMMON", share)
        found = sorted(map(tuple, with_repeats(rows, "key", "doc_id", "again").collect()), key=repr)
        want = want or found
        assert found == want and len(found) == 201
    assert sum(r[2] for r in want) == 200 - 8
    assert FILTERS == list("ABCDE")
