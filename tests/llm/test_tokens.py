import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quoin.llm.best_fit import pack_best_fit, plan
from quoin.llm.packed_ids import best_fit_decreasing, digest, pack_ids
from quoin.llm.tokens import Encoder, encoder, pieces

TEXTS = ["", " ", "a", "a  b", "a   b ", " lead", "don't they're 'S x's", "tab\tand\nline \n next", "\n\n x", "é ü 東京 　 y", "a <|endoftext|> b<|endoftext|>", "x" * 3000, "n 1 23 456.7%", "one two " * 40, "mixed   nbsp", "end\n", "a\n b", "a\r\n b"]


def test_ids_equal_the_library():
    own, theirs = Encoder(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice(["a", "th", " ", " ", "\n", "'s", "é", "12", ".", "!!", "\t", " "]) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)


def check_plan(counts, capacity):
    runs = plan(counts, capacity)
    seen, rows = defaultdict(list), defaultdict(list)
    for n, first, items, sequence, each, offset in runs:
        for k in range(items):
            seen[n].append(first + k)
            rows[sequence + k // each].append((offset + k % each * n, n))
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for held in rows.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= capacity
    assert sorted(rows) == list(range(len(rows)))
    return len(rows)


def test_plans_hold_every_piece_without_gaps():
    rnd = random.Random(7)
    for _ in range(400):
        capacity = rnd.choice([10, 31, 64, 200])
        counts = {rnd.randint(1, capacity): rnd.randint(0, 30) for _ in range(rnd.randint(0, 25))}
        made = check_plan(counts, capacity)
        total = sum(n * c for n, c in counts.items())
        assert made <= max(1.25 * -(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity)) + 4


def test_pieces_are_lossless():
    for n in (0, 1, 6, 7, 8, 13, 14, 15, 40):
        ids = np.arange(1, n + 1).astype("<u4").tobytes()
        got = list(pieces(ids, 7, 0))
        assert b"".join(p for _, _, p in got) == ids + b"\0\0\0\0" and [k for k, _, _ in got] == list(range(len(got)))
        assert all(len(p) // 4 == 7 for _, _, p in got[1:]) and all(len(p) // 4 <= 7 for _, _, p in got)


def test_best_fit_decreasing_against_a_plain_search():
    rnd = random.Random(8)
    for _ in range(200):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 60))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(20 - n)
            else:
                rooms[rooms.index(fit)] = fit - n
        got = best_fit_decreasing(lengths, 20)
        assert len(got) == len(rooms) and sorted(i for s in got for i in s) == list(range(len(lengths)))
        assert sorted(20 - sum(lengths[i] for i in s) for s in got) == sorted(rooms)


def rows_of(spark):
    rnd = random.Random(9)
    texts = [None, *TEXTS, "copy of a text", "copy of a text"] + [" ".join(rnd.choice(["th", "and", "of", "xyz,"]) for _ in range(rnd.choice([3, 30, 300, 3000]))) for _ in range(60)]
    return texts, spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, length string").repartition(4)


def test_packing_round_trip(spark):
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts, docs = rows_of(spark)
    want = {i: theirs.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    got = pack_best_fit(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in want.items():
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 2048
    assert pack_best_fit(docs.limit(0)).count() == 0
    matrices = pack_ids(docs, group_tokens=20_000)
    rebuilt = defaultdict(dict)
    for r in matrices.collect():
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 2048 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            rebuilt[d][p] = ids[a:b].tolist()
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in rebuilt.items()} == want
    assert digest(matrices).count() == matrices.count()
    wide = pack_ids(docs.limit(3), last_id=70_000).first()
    assert wide.id_bytes == 4 and np.frombuffer(bytes(wide.ids), "<u4")[-1] == 70_000


def test_known_words_are_bounded_and_go_with_the_task():
    with encoder() as own:
        own.cache_bytes = 20_000
        for k in range(3000):
            own.encode(f"word w{k} x")
            assert own.held < 21_000 and len(own.cache) < 120
    assert not own.cache and not own.held
    own.cache_bytes = 48 << 20
