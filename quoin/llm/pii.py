"""Personal data by candidate generation and gradient boosting.

Generators of high recall propose spans, which may overlap. Spans of the four base kinds follow a fixed format and always
stay. Looser candidates (addresses with spelled-out signs, digit groups of unusual form, values that look like keys or stand
behind a naming word) are added if boosted trees score them above a threshold, and in no other way. A kind has two models:

* The first trees (``first_trees``) learn from examples written by rule (``pii_examples``), personal values and look-alikes.
  They read form, context and explicit evidence (naming words, bracketed signs, a plus) and are the same for every table.
* The table's trees are trained on a bounded number of candidates of each kind (``train_rows``) taken in hash order from the
  whole table, and carry over the forms that personal data have there. Explicit evidence is their label, so they see a
  candidate as if it weren't there: naming word, sign and quotes in front are cut out before any context is read, and an
  address is read with its signs replaced. Form comes first: the later trees, with smaller steps, are those on the context.
  Values without explicit evidence may be personal too, so they are unlabelled, not negative: the threshold is half the mean
  score of held-out named values.

A candidate that reaches either threshold is added; of overlapping ones the best scored.

A value behind a naming word is proposed whatever its length and signs. The exception is a word of letters alone that
follows a blank and is itself followed by another word ("password: must be long"): that is prose, not evidence.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import in_batches, table
from quoin.llm.pii_examples import PLACEHOLDERS, examples

KINDS = ("email", "ip", "card", "phone", "secret", "contact", "number")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser generators.
AT = re.compile(r"(?:\s?[(\[{<]\s?|\s)(?P<at>at)(?:\s?[)\]}>]\s?|\s)", re.I)
OPEN, CLOSED = "([{<", ")]}>"
AT_WORD = re.compile(r"[\s(\[{<][aA][tT][\s)\]}>]")
DOT = r"(?:\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s|\.)"
SPELLED_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)+", re.I)
SPELLED_DOT = re.compile(r"\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s", re.I)
LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/=-])")
GROUPS = re.compile(r"(?<![A-Za-z0-9])\(?[0-9]++(?:[\x20()./-]{1,3}+[0-9]++)+")
DIGITS = re.compile(r"[0-9]+")
NAMES = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s?"
NAME = re.compile(NAMES + "$")
SIGN = re.compile(r"[:=]{1,2}\s?[\"']?")
NAMED = re.compile(NAMES + SIGN.pattern + "$")
QUOTED = re.compile(r"[^\"'\r\n]++(?=[\"'])")
VALUE = re.compile(r"[^\s\"'<>,;&]++")
PROSE = re.compile(r"[^\W\d_]++[.,;]?\s\s?[^\W\d_]")
#: What names a group of digits in front of it.
NUMBERED = re.compile(r"(?i)\b(?:ssn|social security|phone|telephone|tel|mobile|cell|call|fax|passport|account|iban)\b(?: (?:no|number|is|me|us|at))*\.?\s?[#:=]?\s?$")
#: Words around a candidate that name nothing by themselves.
PRIVATE = re.compile(r"(?i)\b(?:login|auth\w*|user\w*|credential\w*|bearer|key|private|contact|customer|name)\b")
PUBLIC = re.compile(r"(?i)\b(?:commit|sha\w*|md5|hash|version|build|uuid|url|https?|isbn|page|pages|vol|date|years?)\b")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Found from each '@', so that the work is linear in the text."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            after = found.end()
        at = text.find("@", max(at + 1, after))


def ips(text: str) -> Iterator[Span]:
    """Each chain of numbers joined by dots is taken four numbers at a time; a four with a number above 255 is dropped."""
    for chain in DOTTED.finditer(text):
        parts = chain[0].split(".")
        start = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in four):
                yield "ip", start, end
            start = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in GROUPED.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """All spans of the base kinds, by start, then by kind."""
    found = [*(emails(text) if "@" in text else ()), *ips(text), *cards(text), *(phones(text) if "+" in text else ())]
    return sorted(found, key=order)


def order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def named_values(text: str) -> Iterator[Span]:
    """Values behind naming words: to the closing quote if there is an opening one, else to the next white space or sign."""
    after = 0
    for m in SIGN.finditer(text):
        if m.start() < after or not NAME.search(text, max(after, m.start() - 14), m.start()):
            continue
        quote = text[m.end() - 1] in "\"'" and QUOTED.match(text, m.end())
        found = quote or VALUE.match(text, m.end())
        if found and (quote or not (text[m.end() - 1].isspace() and PROSE.match(text, m.end()))):
            after = found.end()
            end = after if quote else m.end() + len(found[0].rstrip(".:!?)]}"))
            if end > m.end():
                yield "secret", m.end(), end


def digit_groups(text: str) -> Iterator[Span]:
    """Chains of groups of digits with 7 to 15 digits in all. Of a longer chain, all runs of two to five groups with so many."""
    for chain in GROUPS.finditer(text):
        parts = [m.span() for m in DIGITS.finditer(text, *chain.span())]
        if sum(b - a for a, b in parts) <= 15:
            runs = [(chain.start(), parts)]
        else:
            runs = [(parts[i][0] - (text[parts[i][0] - 1 : parts[i][0]] == "("), parts[i : i + k]) for i in range(len(parts)) for k in range(2, min(5, len(parts) - i) + 1)]
        for start, run in runs:
            if 7 <= sum(b - a for a, b in run) <= 15:
                yield "number", start, run[-1][1]


def bracketed(sign: str) -> bool:
    sign = sign.strip()
    return sign[0] in OPEN and sign[-1] in CLOSED


def contacts(text: str) -> Iterator[Span]:
    """Addresses with a spelled-out 'at', in brackets or not, and a domain with dots or spelled-out ones. Found from each 'at',
    so that the work is linear in the text."""
    after = 0
    for word in AT_WORD.finditer(text):
        at = word.start()
        spaced = at - 1 if text[at] in "([{<" else at - 2  # of white space and a bracket in front, where they begin
        m = next((m for k in range(max(0, spaced), at + 1) if (m := AT.match(text, k)) and m.start("at") == at + 1), None)
        if not m:
            continue
        start = m.start()
        while start > after and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if found and (bracketed(m[0]) or SPELLED_DOT.search(found[0])):
            after = found.end()
            yield "contact", start, found.end()


def loose_spans(text: str) -> list[Span]:
    """Candidates beyond the base formats; they may overlap each other. Work is linear in the text."""
    found: list[Span] = [("secret", m.start(), m.end()) for m in LONG_TOKEN.finditer(text) if DIGITS.search(m[0])]
    if ":" in text or "=" in text:
        known = set(found)
        found += [s for s in named_values(text) if s not in known]
    found += digit_groups(text)
    found += contacts(text)
    return found


#: Of the features, so many at the front are of a value's form, the others of its context.
FORM = 13
FEATURES = ("length", "digits", "upper", "lower", "other", "distinct", "entropy", "switches", "longest_letters", "hex", "vowels", "groups", "last_group", "private_words", "public_words", "letters_around", "digits_around", "upper_around", "code_signs_around", "word_before", "word_after", "line_start", "line_end")


def plain_form(text: str, span: Span) -> tuple[str, str, str]:
    """What stands before a candidate, the candidate and what stands behind it, without the explicit evidence: the naming word
    with its sign and quotes is cut out, and an address has '@' and '.' for its signs."""
    kind, start, end = span
    before = text[max(0, start - 120) : start]
    cut = (NUMBERED if kind == "number" else NAMED).sub("", before)
    value = text[start:end]
    if kind == "contact":
        value = SPELLED_DOT.sub(".", AT.sub("@", value, count=1))
    return cut.rstrip("\"'")[-40:], value, text[end : end + 41].lstrip("\"'")[:40]


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate in its plain form."""
    before, s, behind = plain_form(text, span)
    n = max(1, len(s))
    counts = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1] / n
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else "-" for c in s]
    around = before + " " + behind
    groups = DIGITS.findall(s) if span[0] != "secret" else []
    run = longest = 0
    for c in kinds:
        run = run + 1 if c == "a" else 0
        longest = max(longest, run)
    words_before, words_behind = before.split(), behind.split()
    m = len(around)
    return [
        float(len(s)), kinds.count("d") / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n, kinds.count("-") / n,
        len(counts) / n, float(-(counts * np.log2(counts)).sum()), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, longest / n,
        sum(c in "0123456789abcdefABCDEF" for c in s) / n, sum(c in "aeiouAEIOU" for c in s) / n,
        float(len(groups)), float(len(groups[-1])) if groups else 0.0, float(len(PRIVATE.findall(around))), float(len(PUBLIC.findall(around))),
        sum(c.isalpha() for c in around) / m, sum(c.isdigit() for c in around) / m, sum(c.isupper() for c in around) / m, sum(c in "{}()[];<>\\/_#$&|" for c in around) / m,
        float(len(words_before[-1])) if words_before else 0.0, float(len(words_behind[0])) if words_behind else 0.0,
        float(not before.strip(" \t") or before.rstrip(" \t")[-1] == "\n"), float(not behind.strip(" \t") or behind.lstrip(" \t")[0] == "\n"),
    ]


#: A plus before a number, or before a chain that the number ends.
PLUS = re.compile(r"\+[0-9\x20().-]{0,12}$")
EVIDENCE = ("named", "name_far", "private_front", "public_front", "bracketed", "signs", "placeholder", "letters_only", "code_value", "plus", "first_group", "second_group", "balanced", "upper_digits", "digits_behind")


def evidence(text: str, span: Span) -> list[float]:
    """What the first trees read besides features(): explicit evidence, words right in front, and more of the form."""
    kind, start, end = span
    value, front = text[start:end], text[max(0, start - 40) : start]
    groups = DIGITS.findall(value[:400]) if kind == "number" else []
    signs = [AT.search(value)[0], *SPELLED_DOT.findall(value)] if kind == "contact" else []
    last = " ".join(front.split()[-2:])
    return [
        float(candidate_label(text, span)), float(bool((NUMBERED if kind == "number" else NAMED).search(text[max(0, start - 80) : start].rstrip() + "="))), float(bool(PRIVATE.search(last))), float(bool(PUBLIC.search(last))),
        sum(map(bracketed, signs)) / max(1, len(signs)), float(len(signs)), float(value.rstrip(".,") in PLACEHOLDERS), float(value.isalpha()), float(sum(c in "$%{}()[]*" for c in value[:400])) / max(1, min(400, len(value))),
        float(bool(PLUS.search(front))), float(len(groups[0])) if groups else 0.0, float(len(groups[1])) if len(groups) > 1 else 0.0, float(value.count("(") - value.count(")")),
        float(value.isupper() and value.isalnum() and not value.isdigit()), float(text[end : end + 2].strip(" -.)/(")[:1].isdigit()),
    ]


@dataclass
class Trees:
    """Gradient boosting on logistic loss with trees of small depth over quantile bins; ``threshold`` is on the probability.
    ``numbers`` and ``contacts`` are the models for digit groups and addresses, with thresholds of their own. ``first`` has
    the first trees by kind; where it isn't given, they are those of first_trees()."""

    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    threshold: float = 1.0
    numbers: Trees | None = None
    contacts: Trees | None = None
    first: dict[str, Trees] | None = None

    def accepts(self, text: str, span: Span) -> float | None:
        """The best probability of a candidate by those of its kind's two models whose thresholds it reaches."""
        row = features(text, span)
        first = (self.first or first_trees())[span[0]]
        own = {"number": self.numbers, "contact": self.contacts}.get(span[0], self)
        reached = [p for m, r in ((first, row + evidence(text, span)), (own, row)) if m is not None and m.threshold <= 1 and (p := m.score(r)) >= m.threshold]
        return max(reached, default=None)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, form_rounds: int = 30, context_rounds: int = 10, form_rate: float = 0.3, context_rate: float = 0.1, least: int = 5, depth: int = 2, whole_rounds: int = 0) -> Trees:
        model = Trees(base=float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
        at = np.full(len(y), model.base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 19))) for j in range(x.shape[1])]

        def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
            best, kept = 1e-6, None
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for j in columns:
                for cut in cuts[j]:
                    left = rows[x[rows, j] <= cut]
                    if least <= len(left) <= len(rows) - least:
                        gl, hl = g[left].sum(), h[left].sum()
                        gain = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - whole
                        if gain > best:
                            best, kept = gain, (j, float(cut))
            return kept

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
            found = split(rows, g, h) if depth and len(rows) >= 2 * least else None
            if not found:
                return float(rate * g[rows].sum() / (h[rows].sum() + 1))
            j, cut = found
            low = x[rows, j] <= cut
            return j, cut, grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1)

        form, context = range(FORM), range(FORM, x.shape[1])
        for columns, rate in [(range(x.shape[1]), form_rate)] * whole_rounds + [(form, form_rate)] * form_rounds + [(context, context_rate)] * context_rounds:
            p = 1 / (1 + np.exp(-at))
            g, h = y - p, p * (1 - p)
            if np.abs(g).max() < 0.01:
                continue
            tree = grow(np.arange(len(y)), g, h, depth)
            model.trees.append(tree)
            at += np.array([walk(tree, r) for r in x])
        return model

    def score(self, row: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + sum(walk(t, row) for t in self.trees)))))


def walk(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def candidate_label(text: str, span: Span) -> int:
    """Explicit evidence, the training label of a table's trees: whether words in front name the value as a secret or number, or
    the spelled-out address has both signs in brackets."""
    kind, start, end = span
    if kind == "contact":
        signs = [AT.search(text, start, end)[0], *SPELLED_DOT.findall(text, start, end)]
        return int(len(signs) > 1 and all(map(bracketed, signs)))
    return int(bool((NUMBERED if kind == "number" else NAMED).search(text[max(0, start - 40) : start])))


MODELS = ("secret", "number", "contact")


@lru_cache(maxsize=2)
def first_trees(rows: int = 1500, seed: int = 0) -> dict[str, Trees]:
    """The first trees of each kind: on the candidates in four fifths of ``rows`` texts of pii_examples, with the threshold
    that has the best F1 on the others. Candidates that overlap a base span are never added, so they don't count."""
    out = {}
    for kind in MODELS:
        x, y, held = [], [], []
        for i, (text, place) in enumerate(examples(kind, rows, seed)):
            base = base_spans(text)
            for s in dict.fromkeys(loose_spans(text)):
                if s[0] == kind and not any(b[1] < s[2] and s[1] < b[2] for b in base):
                    x.append(features(text, s) + evidence(text, s))
                    y.append(float(s[1:] == place))
                    held.append(i % 5 == 0)
        x, y, held = np.array(x), np.array(y), np.array(held)
        model = Trees.fit(x[~held], y[~held], form_rounds=0, context_rounds=0, whole_rounds=25, depth=3)
        scores, truth = np.array([model.score(r) for r in x[held].tolist()]), y[held]
        f1 = lambda c, p=scores, t=truth: 2 * t[p >= c].sum() / max(1.0, (p >= c).sum() + t.sum())
        model.threshold = max((k / 20 for k in range(4, 19)), key=lambda c: (f1(c), -abs(c - 0.5)))
        out[kind] = model
    return out


def with_first(model: Trees | None) -> Trees:
    """The model with its first trees, so that tasks needn't train them."""
    return replace(model or Trees(threshold=2.0), first=(model and model.first) or first_trees())


def fit_trees(docs: DataFrame, text: str = "text", train_rows: int = 4000, least_score: float = 0.25) -> Trees:
    """Trees on at most train_rows candidates of each kind: for each label and each of train_rows / 2 hash slots, the candidate
    with the smallest hash of all rows. Tasks send one candidate a slot at most. Named values that no format proposes
    (short ones, those without digits) have no unnamed counterparts and are not trained on.

    The threshold of each kind is half the mean score of the named ones in a fifth of its candidates that is held out, and at least
    ``least_score``: where named values are a share c of all personal ones, the scores are c times the probability. With
    fewer than 20 candidates of either label the table has no forms to carry over (threshold above 1), and the first trees judge.
    """
    half = train_rows // 2

    def gather(batches):
        kept: dict[tuple[int, int, int], tuple[int, list[float]]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for span in loose_spans(t or ""):
                    if span[0] == "secret" and not (LONG_TOKEN.fullmatch(t, span[1], span[2]) and DIGITS.search(t, span[1], span[2])):
                        continue
                    around = f"{span[0]} {t[max(0, span[1] - 30) : span[2] + 30]}".encode("utf-8", "surrogatepass")
                    key = int.from_bytes(hashlib.blake2b(around, digest_size=7).digest(), "big")
                    at = MODELS.index(span[0]), candidate_label(t, span), key % half
                    if at not in kept or key < kept[at][0]:
                        kept[at] = key, features(t, span)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.int32()), pa.array([k[2] for k in kept], pa.int64()), pa.array([v[0] for v in kept.values()], pa.int64()), pa.array([v[1] for v in kept.values()], pa.list_(pa.float64()))],
            names=["model", "label", "slot", "key", "x"],
        )

    found = in_batches(docs.select(F.col(text).cast("string").alias("t")), gather, "model int, label int, slot long, key long, x array<double>")
    rows = found.groupBy("model", "label", "slot").agg(F.min("key").alias("key"), F.min_by("x", "key").alias("x")).orderBy("model", "label", "slot").collect()  # three times train_rows at most
    model, numbers, addresses = (calibrated([r for r in rows if r.model == k], least_score) for k in range(len(MODELS)))
    model.numbers, model.contacts = numbers, addresses
    return model


def calibrated(rows: list, least_score: float) -> Trees:
    """Trees on four fifths of rows (label, key, x), with the threshold from the others."""
    y = np.array([r.label for r in rows], float)
    if y.sum() < 20 or len(y) - y.sum() < 20:
        return Trees(threshold=2.0)
    x = np.array([r.x for r in rows], float)
    held = np.array([r.key % 5 == 0 for r in rows])
    model = Trees.fit(x[~held], y[~held])
    named = [model.score(r) for r in x[held & (y == 1)].tolist()]
    model.threshold = max(least_score, float(np.mean(named)) / 2) if named else 0.5
    return model


def find_pii(docs: DataFrame, text: str = "text", model: Trees | None = None) -> DataFrame:
    """Adds pii: array of (kind, start, end) by start, then kind; code points, end exclusive. A column so named is replaced.

    Base spans are all kept, also where kinds overlap. An added span must not overlap a base span or an earlier added one;
    the best scored come first. Without a model the first trees alone judge.
    Null and empty texts have an empty array. Work is linear in the text; equal rows stay separate rows.
    """
    kept = [c for c in docs.columns if c.lower() != "pii"]
    rows = docs.select(*kept)
    span_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = T.StructType([*rows.schema.fields, T.StructField("pii", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    at = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(with_first(model))

    def spans(batches):
        trees = shared.value
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                out.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in all_spans(t or "", trees)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(span_type))], names=[*kept, "pii"])

    return in_batches(rows, spans, schema)


def all_spans(text: str, trees: Trees) -> list[Span]:
    found = base_spans(text)
    kept = []
    for s in loose_spans(text):
        if (p := trees.accepts(text, s)) is not None:
            kept.append((p, s))
    taken = bytearray(len(text) if kept else 0)
    for _, start, end in found if kept else ():
        taken[start:end] = b"\1" * (end - start)
    for _, s in sorted(kept, key=lambda x: (-x[0], x[1][1], -x[1][2])):
        if taken.find(1, s[1], s[2]) < 0:
            found.append(s)
            taken[s[1] : s[2]] = b"\1" * (s[2] - s[1])
    return sorted(found, key=order)


def redact(docs: DataFrame, text: str = "text", model: Trees | None = None) -> DataFrame:
    """Replaces each span by its kind in angle brackets; of overlapping spans the union is replaced once, named after the
    first. Null texts stay null. Other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(with_first(model))
    at = docs.columns.index(text)

    def clean(batches):
        for batch in batches:
            out = [None if t is None else redacted(t, all_spans(t, shared.value)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return in_batches(docs, clean, docs.schema)


def redacted(text: str, spans: list[Span]) -> str:
    parts, end = [], 0
    for kind, start, stop in spans:
        if start >= end:
            parts += [text[end:start], f"<{kind}>"]
        end = max(end, stop)
    return "".join(parts) + text[end:]


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, model=fit_trees(docs)).select("doc_id", "pii")
    line = lambda p: F.array_join(F.transform(p, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))
