"""Toxicity by a weighted finite-state grammar over clauses.

Each word of a clause is read as a symbol: an insult (a learned stem), a negation, a verb of speech, a quotation mark, an
intent, a harm, a target, an object (a target that may stand before its verb), a form of "to be", a word of contrast, or another
word. Some symbols are runs of words (``going to``) or endings (``n't``). Four transducers rewrite the symbols, and
their composition is one machine: *threat* (intent, harm, then a target within a few words, or an object just before the harm),
*target* (an insult close behind a target, farther behind a target with a form of "to be", or just before a target),
*negation* (what follows within a few words) and *reported* (behind a verb of speech, or inside quotation marks); a word of
contrast ends negation and speech. *Insult* is the weighted acceptor of stems below them. Quotations are paired within a line,
go on over the ends of clauses, and need their closing mark: one that is never closed quotes nothing. The machine turns a clause into events such as ``insult+target+negated``; an
insult's event carries its stem's weight. A document's score is a logistic of the sums by event. Stems' weights and events'
coefficients are learned from labelled rows; word classes are given below. A clause without a stem or a harm word has no
event, so whole texts are first searched for these by an Aho-Corasick automaton, and only clauses around its
matches are parsed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import held_out, in_batches, store, table
from quoin.llm.shingles import shingle_sets

# Word classes of the grammar, in the four languages of the corpus.
TARGETS = frozenset("you your he she they him them her these those du ihr sie er vous tu toi ils elle vosotros usted ustedes tú él ella".split())
OBJECTS = frozenset("te dich euch os ihn lui leur".split())
COPULAS = frozenset("are is am was were be being been bist ist sind seid war es est sont êtes suis eres son soy sois".split())
PREDICATES = frozenset("you're he's she's they're t'es c'est".split())
NEGATIONS = frozenset("not never no nicht kein keine nie pas jamais nunca tampoco".split())
SPEECH = frozenset("said says wrote writes called calls quoted reported alleged sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
INTENTS = frozenset("will gonna wanna shall werde werden wird vais allons va veux voy vamos quiero".split())
#: Symbols of several words, each written with single spaces.
INTENT_RUNS = ("going to", "want to", "wants to", "plan to", "about to", "have to", "need to", "möchte gern", "envie de", "tengo que")
HARMS = frozenset("kill hurt destroy beat burn shoot stab töten umbringen schlagen verletzen tuer frapper blesser matar golpear herir".split())
CONTRASTS = frozenset("but however yet though although aber doch sondern mais pourtant pero sino aunque".split())
GROUPS = {"target": TARGETS, "object": OBJECTS, "copula": COPULAS, "predicate": PREDICATES, "intent": INTENTS | {*INTENT_RUNS}, "speech": SPEECH, "negation": NEGATIONS, "harm": HARMS, "contrast": CONTRASTS}
CLASSES = {w: name for name, words in GROUPS.items() for w in words}
ENDINGS = {"n't": "negation", "'ll": "intent"}
#: What events weigh before anything is learned; after how many words negation, a target and a harm lose hold, and a target with
#: a form of "to be".
RAISED, LOWERED, REPORTED, THREAT, REACH, FAR = 1.3, 0.35, 0.5, 2.0, 3, 8

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Opening marks of quotations with the marks that close them. An apostrophe never opens one.
MARKS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "”": "”", "‘": "’"}
MARK = re.compile(r"[\"“”„«»‘’]")
PART = re.compile(r"\b(?:" + "|".join(r.replace(" ", r"[^\S\n]+") for r in INTENT_RUNS) + r")\b|" + WORD.pattern + "|" + MARK.pattern)
SIGNS = frozenset("\"“”„«»‘’")
SPACE = re.compile(r"\s+")
CLAUSE_ENDS = ".!?;:\n"
CLAUSE_END = re.compile(r"[.!?;:\n]")
STEMS = (4, 5, 6, 7, 8)
END = "end"
SYMBOLS = ("insult", "quote", *GROUPS, "other", END)
TRANSDUCERS = ("threat", "target", "negation", "reported")
EVENTS = tuple(f"{kind}{n}{r}" for kind in ("insult", "insult+target", "threat") for n in ("", "+negated") for r in ("", "+reported"))
PRIOR = np.array([(THREAT if "threat" in e else 1.0) * (RAISED if "target" in e else 1.0) * (LOWERED if "negated" in e else 1.0) * (REPORTED if "reported" in e else 1.0) for e in EVENTS])


@dataclass(frozen=True)
class Transducer:
    """Deterministic: for each state and symbol the next state and the symbols written. State 0 is the first one."""

    arcs: tuple[dict[str, tuple[int, tuple[str, ...]]], ...]

    @staticmethod
    def of(first: Hashable, symbols: tuple[str, ...], step: Callable) -> Transducer:
        """All states that step(state, symbol) -> (state, symbols written) reaches from the first one."""
        number, todo, arcs = {first: 0}, deque([first]), []
        while todo:
            state, row = todo.popleft(), {}
            for symbol in symbols:
                after, written = step(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row[symbol] = number[after], tuple(written)
            arcs.append(row)
        return Transducer(tuple(arcs))

    def written(self) -> tuple[str, ...]:
        return tuple(sorted({o for row in self.arcs for _, out in row.values() for o in out}))

    def compose(self, after: Transducer) -> Transducer:
        """The machine that hands what this one writes to ``after``."""

        def step(state, symbol):
            (a, b), out = state, []
            a, middle = self.arcs[a][symbol]
            for m in middle:
                b, more = after.arcs[b][m]
                out += more
            return (a, b), out

        return Transducer.of((0, 0), tuple(self.arcs[0]), step)


def _is_word(symbol: str) -> bool:
    return symbol not in ("quote", "threat", END)


def _threat(state, symbol):
    """State: intent seen, words that a harm still reaches, whether an object stands within two words before."""
    intent, left, near = state
    if symbol == END:
        return (False, 0, 0), (END,)
    if symbol in ("target", "object") and left:
        return (intent, 0, 0), ("threat", symbol)
    if symbol == "harm" and intent and near:
        return (intent, 0, 0), ("threat", symbol)
    if _is_word(symbol):
        left = REACH if symbol == "harm" and intent else max(0, left - 1)
        near = 3 if symbol == "object" else max(0, near - 1)
    return (intent or symbol == "intent", left, near), (symbol,)


def _target(state, symbol):
    """State: words that a target still reaches, whether an insult waits for the next word."""
    left, waiting = state
    addressed = symbol in ("target", "object", "predicate")
    if symbol == "threat":  # its target, or its harm, is next
        return (left, False), (*(("insult+target",) if waiting else ()), symbol)
    out = [("insult+target" if addressed else "insult")] if waiting else []
    if symbol in ("quote", END):
        return (left if symbol == "quote" else 0, False), (*out, symbol)
    if symbol == "insult":
        return (max(0, left - 1), not left), (*out, *(("insult+target",) if left else ()))
    if symbol == "contrast":
        left = 0
    elif symbol == "predicate" or symbol == "copula" and left:
        left = FAR
    else:
        left = REACH if addressed else max(0, left - 1)
    return (left, False), (*out, symbol)


def _negation(left, symbol):
    if symbol == END:
        return 0, (END,)
    out = symbol + "+negated" if left and symbol.startswith(("insult", "threat")) else symbol
    return (REACH if symbol == "negation" else 0 if symbol == "contrast" else max(0, left - _is_word(symbol))), (out,)


def _reported(state, symbol):
    speech, quoted = state
    if symbol == END:
        return (False, False), (END,)
    out = symbol + "+reported" if (speech or quoted) and symbol.startswith(("insult", "threat")) else symbol
    return ((speech or symbol == "speech") and symbol != "contrast", quoted != (symbol == "quote")), (out,)


STEPS = {"threat": ((False, 0, 0), _threat), "target": ((0, False), _target), "negation": (0, _negation), "reported": ((False, False), _reported)}


@lru_cache(maxsize=16)
def machine(transducers: tuple[str, ...] = TRANSDUCERS) -> list[dict[str, tuple[int, tuple[int, ...]]]]:
    """The composition of the transducers: for each state and symbol the next state and the positions of events in EVENTS."""
    whole = Transducer.of(0, SYMBOLS, lambda state, symbol: (0, (symbol,)))
    whole = reduce(lambda m, name: m.compose(Transducer.of(STEPS[name][0], m.written(), STEPS[name][1])), transducers, whole)
    return [{s: (to, tuple(EVENTS.index(o) for o in out if o in EVENTS)) for s, (to, out) in row.items()} for row in whole.arcs]


def symbol_of(part: str) -> str:
    """The symbol of a word, or of a run of words, that is no insult."""
    part = part.replace("’", "'") if "’" in part else part
    found = CLASSES.get(part)
    if found is None and " " in (run := SPACE.sub(" ", part)):
        found = CLASSES.get(run)
    return found or ENDINGS.get(part[-3:], "other")


def quotation_marks(text: str, start: int, end: int) -> list[int]:
    """Where quotations open and close in a line text[start:end], in order: an opening mark counts if a mark that closes it
    follows, and inside a quotation no other mark does."""
    marks = [(m.start(), m[0]) for m in MARK.finditer(text, start, end) if m[0] != "’" or not inside_word(text, m.start())]
    last = {}  # where each mark stands last
    for at, sign in marks:
        last[sign] = at
    out, closes = [], ""
    for at, sign in marks:
        if closes:
            if sign in closes:
                out.append(at)
                closes = ""
        elif sign in MARKS and any(last.get(c, -1) > at for c in MARKS[sign]):
            out.append(at)
            closes = MARKS[sign]
    return out


def inside_word(text: str, at: int) -> bool:
    """Whether the mark at this place is an apostrophe between two letters."""
    return text[at - 1 : at].isalpha() and text[at + 1 : at + 2].isalpha()


def clause_events(text: str, start: int, end: int, marks: list[int], weight: Callable[[str], float], arcs: list, sums: dict[int, float]) -> None:
    """Adds the events of the clause text[start:end] to sums. ``marks`` are the line's quotation marks; ``weight`` maps a word to
    its weight as an insult, 0 if it is none."""
    held, k = deque(), bisect_left(marks, start)
    state = arcs[0]["quote"][0] if k % 2 else 0
    for m in chain(PART.finditer(text, start, end), (None,)):
        if m is None:
            symbol = END
        elif m[0] in SIGNS:
            if k == len(marks) or marks[k] != m.start():
                continue
            symbol, k = "quote", k + 1
        elif w := weight(m[0]):
            symbol = "insult"
            held.append(w)
        else:
            symbol = symbol_of(m[0])
        state, events = arcs[state][symbol]
        for e in events:
            sums[e] = sums.get(e, 0.0) + (1.0 if EVENTS[e].startswith("threat") else held.popleft())


@dataclass
class Grammar:
    """stems: word stem (a '$' at its end: the whole word) -> weight. A document's score is
    1 / (1 + exp(-(bias + coefficients . sums by event)))."""

    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    coefficients: list[float] = field(default_factory=lambda: PRIOR.tolist())
    transducers: tuple[str, ...] = TRANSDUCERS

    def weight(self, word: str) -> float:
        stems = self.stems
        return max(stems.get(word + "$", 0.0), *[stems.get(word[:n], 0.0) for n in STEMS])

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for stem in [*self.stems, *HARMS]:
            out.add_word(stem.rstrip("$"), len(stem.rstrip("$")))
        if len(out):
            out.make_automaton()
        return out

    def events(self, text: str, automaton) -> dict[int, float]:
        """Sums by event over the clauses of a text."""
        low, arcs = text.lower(), machine(self.transducers)
        sums, done, line, marks = {}, -1, -1, []
        for at, n in automaton.iter(low) if len(automaton) else ():
            if at < done or (at - n >= 0 and low[at - n].isalpha()):
                continue
            start = max(low.rfind(c, 0, at) for c in CLAUSE_ENDS) + 1 if done < 0 else max(done, max(low.rfind(c, done, at) for c in CLAUSE_ENDS) + 1)
            ends = CLAUSE_END.search(low, at)
            done = ends.start() + 1 if ends else len(low)
            if start > line:  # the clause stands in another line than the one before
                first = low.rfind("\n", 0, start) + 1
                line = low.find("\n", start)
                line = len(low) if line < 0 else line
                marks = quotation_marks(low, first, line)
            clause_events(low, start, done, marks, self.weight, arcs, sums)
        return sums

    def score(self, sums: dict[int, float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.coefficients[e] * v for e, v in sums.items())))))


def stems_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w + "$" for w in words if len(w) > 2} | {w[:n] for w in words for n in STEMS if len(w) >= n}


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(text, y, part) of at most train_rows labelled documents outside the held-out fold, in the order of their ids' hashes,
    half of them of either label if there are so many. Part 0 of 2 is for calibration.

    Of copies one stays, as words that copies share would look like evidence from many documents: of the rows with one label
    and the same least shingle of three words, and then of those with the same greatest one, that with the smallest id.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna().filter(~held_out(F.col("doc_id")))
    halves = [picked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2) for y in (0, 1)]
    few = halves[0].unionByName(halves[1]).groupBy("doc_id").agg(F.max("y").alias("y"))

    def keys(batches):
        for batch in batches:
            ends = [(int(s[0]), int(s[-1])) if len(s) else (0, 0) for s in shingle_sets(batch.column("text"), 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64())], names=[*batch.schema.names, "least", "most"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "text", "y")
    rows = store(in_batches(rows, keys, "doc_id long, text string, y int, least long, most long"), "labelled")
    firsts = rows.groupBy("least", "y").agg(F.min_by(F.struct("most", "doc_id"), F.struct("doc_id", "most")).alias("r")).select("y", "r.*")
    firsts = firsts.groupBy("most", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id")  # train_rows at most
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    return rows.join(F.broadcast(firsts), "doc_id", "left_semi").select("text", "y", part.alias("part"))


def fit_grammar(docs: DataFrame, labels: DataFrame, train_rows: int = 24_000, most_stems: int = 3_000, least_seen: int = 6, least_odds: float = 1.5) -> Grammar:
    """Learns stems on one half of a bounded sample: those in at least ``least_seen`` toxic documents whose log odds, less two
    standard errors, are above ``least_odds``, the ``most_stems`` with the highest odds at most. Of a word and its stems the
    shortest that does nearly as well is kept. The events' coefficients are a logistic over the sums by event in the other
    half, at the proportions of the labels that aren't held out; events that are rare there stay near their prior weights.
    Held-out labels are never read. Without labels of both kinds every score is the same and below one half."""
    sample = labelled(docs, labels, train_rows)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, y, part in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "part")), strict=True):
                seen[("", y)] += 1
                if part:
                    seen[(" ", y)] += 1
                    seen.update((s, y) for s in stems_of(text or ""))
        rows = list(seen.items())
        for i in range(0, len(rows), 50_000):
            some = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.int32()), pa.array([n for _, n in some], pa.int64())], names=["stem", "y", "n"])

    counts = store(in_batches(sample, count, "stem string, y int, n long").groupBy("stem").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q")), "stems")
    totals = {r.stem: (r.p, r.q) for r in counts.filter(F.col("stem").isin("", " ")).collect()}
    if not all(totals.get(" ", (0, 0))):
        return Grammar()
    n_p, n_q = totals[" "]
    odds = F.log(((F.col("p") + 0.5) / (n_p + 1)) / ((F.col("q") + 0.5) / (n_q + 1))) - 2 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5)) + 2 * F.sqrt(F.lit(2.0) / F.lit(n_p))
    best = counts.filter(~F.col("stem").isin("", " ") & (F.col("p") >= least_seen)).withColumn("w", odds).filter(F.col("w") > least_odds).orderBy(F.desc("w"), "stem").limit(most_stems).collect()
    found = {r.stem: r.w for r in best}
    kept = {s: w for s, w in found.items() if not any(found.get(s.rstrip("$")[:n], 0) >= w - 0.3 for n in STEMS if s.rstrip("$")[:n] != s)}
    grammar = Grammar(stems=kept)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def sums(batches):
        seen: Counter = Counter()
        automaton = shared.value.automaton()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found = shared.value.events(text or "", automaton)
                seen[tuple(round(min(40.0, found.get(e, 0.0)), 1) for e in range(len(EVENTS))), y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.list_(pa.float64())), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["x", "y", "n"])

    rows = in_batches(sample.filter("part = 0"), sums, "x array<double>, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).orderBy("x", "y").collect()  # train_rows at most
    overall = labels.filter(~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double")).alias("share")).collect()[0].share
    x = np.array([r.x for r in rows], float).reshape(-1, len(EVENTS))
    y, n = (np.array([r[c] for r in rows], float) for c in ("y", "n"))
    here = totals[""][0] / sum(totals[""])
    grammar.bias, grammar.coefficients = logistic(x, y, n * np.where(y == 1, overall / here, (1 - overall) / (1 - here)))
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, list[float]]:
    """Bias and coefficients by Newton's steps on the likelihood of counts n: a common slope on the prior weights, hardly
    penalised, and for each event a penalised difference from it."""
    inputs = np.column_stack([np.ones(len(x)), x @ PRIOR, x])
    penalty = np.array([0.01, 0.05, *[5.0] * len(EVENTS)])
    at = np.zeros(inputs.shape[1])
    at[:2] = -3.0, 1.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(inputs @ at, -30, 30)))
        v = n * p * (1 - p)
        step = np.linalg.solve((inputs * v[:, None]).T @ inputs + np.diag(penalty), inputs.T @ (n * (y - p)) - penalty * at)
        at += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return min(float(at[0]), -0.5), np.maximum(max(at[1], 0.1) * PRIOR + at[2:], 0.0).tolist()


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Adds toxicity (0 to 1), replacing a column so named. Null and empty texts score as a text without any event;
    equal rows stay separate rows. Whole texts are searched, whatever their length."""
    kept = [c for c in docs.columns if c.lower() != "toxicity"]
    rows, at = docs.select(*kept), kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def score(batches):
        model = shared.value
        automaton = model.automaton()
        for batch in batches:
            found = [model.score(model.events(t or "", automaton)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*kept, "toxicity"])

    return in_batches(rows, score, T.StructType([*rows.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_grammar(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
