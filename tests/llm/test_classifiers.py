import random
import re
import time
import zlib

import numpy as np
import pytest

from quoin.llm.quality import WIDTH, Voters, fit_voters, leading, op4_quality_classifier, score_quality, text_vector
from quoin.llm.toxicity import EVENTS, PART, TRANSDUCERS, Grammar, clause_events, fit_grammar, logistic, machine, op6_toxicity, quotation_marks, score_toxicity, symbol_of


def events(text, weights, transducers=TRANSDUCERS):
    sums = {}
    clause_events(text, 0, len(text), quotation_marks(text, 0, len(text)), lambda w: weights.get(w, 0.0), machine(transducers), sums)
    return {EVENTS[e]: v for e, v in sums.items()}


def test_transducers_compose():
    got = lambda s, *a: events(s, {"fool": 2.0, "ass": 1.0}, *a)
    assert got("the fool") == {"insult": 2} and got("a fine day") == got("") == {}
    assert got("you fool") == got("fool you") == {"insult+target": 2} and got("fool ass you") == {"insult": 2, "insult+target": 1}
    assert got("not a fool") == {"insult+negated": 2} and got("not that one saw such a fool") == {"insult": 2} and got("not that he was such a fool") == {"insult+target": 2}
    assert got("she called him a fool") == {"insult+target+reported": 2} and got('a "fool" and ass') == {"insult+reported": 2, "insult": 1}
    assert got("i will kill you") == {"threat": 1} and got("i will kill time") == got("they kill you") == {} and got("she said i will not kill you") == {"threat+negated+reported": 1}
    assert got("fool fool") == {"insult": 4}
    assert got("she said you fool", ("target",)) == {"insult+target": 2} and got("she said you fool", ()) == {"insult": 2}


PAIRS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "”": "”", "‘": "’"}


def plain_events(line, weight):
    """The same events of a line by looking around each word."""
    parts = [(m[0], m.start()) for m in re.finditer(PART.pattern + r"|[.!?;:]", line)]
    quoted, marks, k = set(), set(), 0
    while k < len(parts):  # a quotation: an opening mark and the nearest one that closes it
        closing = next((c for c in range(k + 1, len(parts)) if parts[c][0] in PAIRS.get(parts[k][0], "")), None)
        if closing is not None:
            quoted |= set(range(k, closing))
            marks |= {k, closing}
            k = closing
        k += 1
    out, clause = {}, []
    for k, (part, _) in enumerate([*parts, (".", 0)]):
        if part in ".!?;:":
            add_clause(clause, weight, out)
            clause = []
        elif part[0].isalpha() or k in marks:
            clause.append((part, k in quoted))
    return out


def add_clause(clause, weight, out):
    words = [(w, q, k) for k, (w, q) in enumerate(clause) if w[0].isalpha()]
    kind = [None if weight(w) else symbol_of(w) for w, _, _ in words]
    addressed = ("target", "object", "predicate")
    add = lambda e, v: out.update({e: out.get(e, 0.0) + v})

    def left(i):
        """How many words on a target before word i still reaches."""
        for j in range(i - 1, -1, -1):
            far = 3 if kind[j] in ("target", "object") else 8 if kind[j] == "predicate" or kind[j] == "copula" and left(j) else None
            if far or kind[j] == "contrast":
                return max(0, (far or 0) - (i - 1 - j))
        return 0

    waits = near = 0
    for i, (w, q, k) in enumerate(words):
        since = max((j for j in range(i) if kind[j] == "contrast"), default=-1) + 1
        tail = ("+negated" if "negation" in kind[max(since, i - 3) : i] else "") + ("+reported" if q or "speech" in kind[since:i] else "")
        if weight(w):
            before = i + 1 < len(words) and kind[i + 1] in addressed and words[i + 1][2] == k + 1
            add(f"insult{'+target' * bool(left(i) or before)}{tail}", weight(w))
        if kind[i] in ("target", "object") and waits or kind[i] == "harm" and near and "intent" in kind[:i]:
            add(f"threat{tail}", 1.0)
            waits = near = 0
        else:
            waits = 3 if kind[i] == "harm" and "intent" in kind[:i] else max(0, waits - 1)
            near = 3 if kind[i] == "object" else max(0, near - 1)


WORDS = ["you", "fool", "ass", "not", "said", "will", "kill", "him", "te", "are", "you're", "but", "going to", "don't", "x", "y", '"', "“", "”", "‘", "’"]


def test_the_composition_against_looking_around_each_word():
    rnd = random.Random(14)
    weights = {"fool": 2.0, "ass": 1.0}
    for _ in range(20_000):
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 14)))
        assert events(text, weights) == pytest.approx(plain_events(text, lambda w: weights.get(w, 0.0))), text
    assert len(machine()) > 100


def brute(grammar, text):
    sums = {}
    for line in text.lower().split("\n"):
        for e, v in plain_events(line, grammar.weight).items():
            sums[e] = sums.get(e, 0.0) + v
    return sums


def test_search_finds_the_clauses_that_a_full_parse_finds():
    rnd = random.Random(4)
    grammar = Grammar({"fool": 2.0, "idio": 3.0, "bad$": 1.0})
    automaton = grammar.automaton()
    for _ in range(3000):
        text = " ".join(rnd.choice(["you", "fool", "fools", "idiotic", "bad", "badly", "xfool", "not", "said", "x.", "will", "kill", "him", "ok;", "Fool\n", "é", '"', "“", "”", "but", "are"]) for _ in range(rnd.randint(0, 18)))
        assert {EVENTS[e]: v for e, v in grammar.events(text, automaton).items()} == pytest.approx(brute(grammar, text)), text
    assert Grammar().events("anything", Grammar().automaton()) == {}


def test_sentences_of_the_grammar():
    grammar = Grammar({"stup": 2.0, "idio": 3.0})
    automaton = grammar.automaton()
    got = lambda text: {EVENTS[e]: v for e, v in grammar.events(text, automaton).items()}
    assert got('"You are stupid. You are an idiot," he said.') == {"insult+target+reported": 5}
    for text in ("I want to kill you", "I am going  to kill you", "I'll kill you", "I’ll kill you", "Je vais te tuer", "Ich werde dich töten", "Te voy a matar"):
        assert got(text) == {"threat": 1}, text
    assert got("I won't say that. I will kill time") == {} and got("They don't want to hurt you") == {"threat+negated": 1} and got("They don't ever want to hurt you") == {"threat": 1}
    assert got("He never said that, but you are an idiot.") == {"insult+target": 3}
    assert got("‘You are an idiot’, they told us") == got("»You are an idiot«") == {"insult+target+reported": 3} and got("the dogs’ idiot") == {"insult": 3}
    for text in ("You are a big fat ugly lazy idiot", "You are, I think, an idiot", "You’re such a complete and utter idiot"):
        assert got(text) == {"insult+target": 3}, text
    assert got('a 5" idiot') == {"insult": 3} and got('"open\nidiot" and "no') == {"insult": 3}


def test_long_lines_take_linear_time():
    grammar = Grammar({"stup": 2.0})
    automaton = grammar.automaton()
    for text in ("stupid. " * 100_000, '"stupid. ' * 100_000, "‘stupid, " * 100_000, "« stupid\n" * 100_000):
        start = time.process_time()
        grammar.events(text, automaton)
        assert time.process_time() - start < 4, text[:12]


def test_each_transducer_decides_documents(spark):
    """A planted table: an eighth of the clean documents hold the same words as the toxic ones, used in another way."""
    rnd = random.Random(8)
    toxic = ["you are a {f} {f} idiot", "I am going to kill you", "he never said that, but you are an idiot"]
    twins = ["one idiot of {f} and {f}", "they said that you are an idiot", '"{f} you are an idiot. you are an idiot," as they put it', "you are not an idiot", "I never want to kill you"]
    plain = ["I am going to see the {f} but you are {f}", "he never said that {f}", "people kill {f} and {f}", "you are a {f}"]
    names = [a + b for a in "tree stone river cloud lamp chair paper glass".split() for b in "abcdefghij"]
    rows = []
    for k in range(3000):
        y = k % 3 == 0
        some = [rnd.choice(toxic if y else twins if rnd.random() < 1 / 8 else plain), rnd.choice(plain), *["{f} {f} {f} {f}"] * 4]
        rnd.shuffle(some)
        rows.append((k, re.sub("{f}", lambda _: rnd.choice(names), ".\n".join(some)), int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = fit_grammar(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    automaton = grammar.automaton()

    def wrong(transducers):
        model = Grammar(grammar.stems, grammar.bias, grammar.coefficients, transducers)
        return sum((model.score(model.events(text, automaton)) >= 0.5) != y for _, text, y in rows)

    changed = {t: wrong(tuple(u for u in TRANSDUCERS if u != t)) for t in TRANSDUCERS}
    assert wrong(TRANSDUCERS) <= 60, (wrong(TRANSDUCERS), changed, grammar)
    assert min(changed.values()) > wrong(TRANSDUCERS) + 20, (wrong(TRANSDUCERS), changed)


def test_coefficients_are_learned():
    rnd = np.random.default_rng(1)
    x = np.zeros((4000, len(EVENTS)))
    y = (rnd.random(4000) < 0.3).astype(float)
    x[:, EVENTS.index("insult+target")] = 3 * y * (rnd.random(4000) < 0.7)
    x[:, EVENTS.index("insult+reported")] = 3 * (rnd.random(4000) < 0.5)
    bias, c = logistic(x, y, np.ones(4000))
    assert bias < 0 and c[EVENTS.index("insult+target")] > 1 and c[EVENTS.index("insult+reported")] < 0.1


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(6)
    words = ["".join(rnd.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 60))]
        toxic, bad = i % 5 == 1, i % 4 == 0
        for _ in range(3 if toxic else 0):
            text.insert(rnd.randint(0, len(text)), rnd.choice(["dreckling", "dreckig", "muckface"]))
        line = " ".join(text).capitalize() + "."
        docs.append((i, " | ".join(text) if bad else line, "x", 0.5))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(1000, None, "x", 0.5), (1001, "", "x", 0.5), (1002, "Er on " * 30_000, "x", 0.5), (0, docs[0][1], "x", 0.5)]
    labels += [(1000, None, None), (0, 0, 0), (None, 1, 1)]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(docs, "doc_id long, text string, Quality string, TOXICITY double").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {i: (q, t) for i, q, t in labels}, len(docs)


@pytest.mark.parametrize(("query", "which", "least"), [(op6_toxicity, 1, 0.97), (op4_quality_classifier, 0, 0.97)])
def test_held_out_accuracy(spark, tables, query, which, least):
    path, labels, n = tables
    rows = query(spark, path).collect()
    assert len(rows) == n
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if which else 0.3))
    held = [r for r in rows if r.held_out and labels.get(r.doc_id, (None, None))[which] is not None]
    assert len(held) > 100 and np.mean([r.predicted == labels[r.doc_id][which] for r in held]) >= least


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.toxicity < 0.5 for r in score_toxicity(docs, fit_grammar(docs, none)).collect()} == {True}
    assert {r.quality for r in score_quality(docs, fit_voters(docs, none)).collect()} == {0.5}
    assert score_quality(docs.limit(0), fit_voters(docs, none)).count() == 0


def test_votes_against_brute_force():
    rnd = np.random.default_rng(3)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rnd.normal(size=(n, 6)))
    voters = Voters(np.ones(1), np.zeros((1, 6)), unit(80), rnd.integers(0, 2, 80).astype(float))
    asked = unit(40)
    for v, got in zip(asked, voters.vote(asked), strict=True):
        near = sorted(range(80), key=lambda k: -(v @ voters.vectors[k]))[:15]
        w = [max(v @ voters.vectors[k], 1e-3) ** 12 for k in near]
        assert got == pytest.approx(sum(a * voters.labels[k] for a, k in zip(w, near)) / sum(w))


def test_held_out_labels_change_no_score(spark):
    rows = [(i, f"w{i % 17}er w{i % 13}er you are a {'dreckling' if i % 4 == 0 else 'neighbour'} w{i % 11}er") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grammars = []
    for flipped in (False, True):
        labels = [(i, 1 if flipped and zlib.crc32(str(i).encode()) % 5 == 0 else int(i % 4 == 0)) for i, _ in rows]
        grammars.append(fit_grammar(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert grammars[0] == grammars[1]


def test_ties_go_by_the_order_of_the_sample():
    copies = np.tile([[1.0, 0.0]], (40, 1))
    voters = Voters(np.ones(1), np.zeros((1, 2)), np.concatenate([copies, [[0.0, 1.0]]]), np.array([1.0] * 10 + [0.0] * 31))
    assert voters.vote(np.array([[1.0, 0.0]])) == pytest.approx([10 / 15])


def test_the_latent_space_against_a_full_decomposition():
    rnd = np.random.default_rng(2)
    matrix = (rnd.standard_normal((60, 8)) * np.arange(8, 0, -1) ** 2) @ rnd.standard_normal((8, 90)) + rnd.standard_normal((60, 90)) * 0.01
    ours, theirs = leading(matrix.astype(np.float32), 5), np.linalg.svd(matrix)[2][:5].T
    assert np.abs(ours.T @ theirs).diagonal() == pytest.approx(np.ones(5), abs=1e-3)


def test_vectors_of_any_text():
    for text in ("", " ", "a", "ab", "\n\n", "A Word " * 3000, "é\ud800", "x" * 100_000):
        at, values = text_vector(text)
        assert len(at) == len(values) == len(set(at.tolist())) and at.max() < WIDTH and np.isfinite(values).all()
