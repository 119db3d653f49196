import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quoin.llm.bpe import Bpe, decode_bpe, digest_bpe, encode_bpe

TEXTS = ["", " ", "a", "a  b", "a   b ", " lead", "don't they're 'S x's 'll", "tab\tand\nline \n next", "\n\n x", "é ü 東京 　 y", "a <|endoftext|> b<|endoftext|><|endoftext|", "x" * 3000, "ab" * 5000, " " * 3000, "n 1 23 456.7%", "mixed   nbsp", "a\x1cb\x1f c\x85d", "😀👩‍👩‍👧 ﷺ", "\x00\x01", " \n x", "a \n", "a \xa0b", "  a  ", "a \u2028 b", "x\ny " * 50]


def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(bpe, text):
    return np.frombuffer(bpe.encode(text), "<i4").tolist()


def test_ids_equal_the_library_with_and_without_kept_words():
    own, theirs, rnd = Bpe(), library(), random.Random(5)
    letters = ["a", "th", " ", " ", "\n", "'s", "é", "12", ".", "!!", "\t", " ", "<|endoftext|>", "東", " ", "😀"]
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for _ in range(2):
        for t in texts:
            assert ids_of(own, t) == theirs.encode(t, add_special_tokens=False).ids, repr(t)
            assert own.decode(ids_of(own, t)) == t
    assert own.kept
    assert own.encode_all(pa.array(texts)).to_pylist() == [ids_of(own, t) for t in texts]
    assert own.encode_all(pa.array([], pa.string())).to_pylist() == [] and own.encode_all(pa.array(["", ""])).to_pylist() == [[], []]
    small = Bpe(cache_bytes=2000)
    assert [ids_of(small, t) for t in texts[:200]] == [ids_of(own, t) for t in texts[:200]]
    assert small.held < 1000 + 500 and small.old


def test_any_ids_are_decoded_as_the_library_does():
    own, theirs, rnd = Bpe(), library(), random.Random(6)
    for _ in range(3000):
        ids = [rnd.randrange(50300) for _ in range(rnd.randint(0, 8))]
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
        lists = pa.array([[7], ids, None, [], [None, 50256, 10**6, -5]], pa.list_(pa.int32()))
        assert own.decode_all(lists).to_pylist() == [own.decode([7]), own.decode(ids), "", "", "<|endoftext|>"] and own.decode_all(lists[1:2]).to_pylist() == [own.decode(ids)]


def test_merges_go_by_rank_then_place():
    """A plain loop over the whole word: the best rank first, of equals the leftmost."""
    bpe, rnd = Bpe(), random.Random(7)
    for _ in range(500):
        word = bytes(rnd.choice(b" aaeinrstth") for _ in range(rnd.randint(1, 40)))
        ids = [bpe.first[b] for b in word]
        pair = lambda i: bpe.pairs.get(ids[i] << bpe.bits | ids[i + 1])
        while found := [(pair(i) >> bpe.bits, i) for i in range(len(ids) - 1) if pair(i) is not None]:
            _, i = min(found)
            ids[i : i + 2] = [pair(i) & (1 << bpe.bits) - 1]
        assert bpe.merge(word) == ids


def test_rows_nulls_repeats_and_clashing_names(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    theirs = library()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t, _ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, digest_bpe(docs).collect()), key=repr) == sorted(want, key=repr)
    again = decode_bpe(encode_bpe(docs), text="text")  # both columns are replaced, in place
    assert again.columns == ["doc_id", "text", "ids"]
    assert {(r.doc_id, r.text) for r in again.collect()} == {(k, t or "") for k, t, _ in rows}
    assert digest_bpe(docs.limit(0)).collect() == []
    bad = spark.createDataFrame([(1, [None, 15496, 999999]), (2, None)], "k int, ids array<int>")
    assert [r.decoded for r in decode_bpe(bad).orderBy("k").collect()] == ["Hello", ""]
    assert encode_bpe(docs.select(F.lit(5).alias("text"))).first().ids == ids_of(Bpe(), "5")
