"""Toxicity by a weighted finite-state grammar of clauses.

A clause is a tape of symbols, one for each word: the set of roles that the word can have.  Five
transducers read it, each marking the symbols that it says something of: reported speech, negation,
threat and target from left to right, and target again from right to left, for a target that comes
after the insult.  `compose` makes one transducer of a chain, state by state as texts ask for them, and
the last one in the chain gives each insult or threat its final state: negated, reported, threat,
aimed at a target, or plain insult.  A clause weighs what its insults and threats weigh by final state,
and a text's score is a logistic function of what its clauses weigh.

The insult patterns (words and stems), their weights, how much evidence in each final state counts and
the logistic function are learned from labels, beside a short general list.  Clauses without an insult
or threat end in the empty state, so only clauses around the words that an Aho-Corasick automaton finds
are read, each as a whole however long it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import labelled
from cleanloom.llm.common import aside, cut, map_batches

# General words of the transducers, in the four languages of the corpus.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()
HARM = "kill hurt destroy shoot stab beat murder töten umbringen verletzen tuer frapper matar golpear".split()
INTENT = "will gonna shall should must going werde wirst soll vais va veux voy vas debe".split()
TARGETS = "you your you're he she they them him her these those all du dich ihr sie tu toi vous ils elle tú te ustedes ellos ella".split()
NEGATIONS = "not no never nobody isn't aren't don't nicht kein keine nie ne pas non jamais no nunca jamás".split()
SPEECH = "said says say called calls told tells wrote quoted sagte sagt nannte dit disait appelle dijo dice llamó".split()

#: Labelled rows that are learned from, at most.
TRAIN_ROWS = 12_000
#: Stems have this many letters; a word counts up to MOST times in a text.
SHORTEST, LONGEST, MOST = 3, 8, 4
#: Candidates that the second pass looks at, and patterns of the grammar, at most.
CANDIDATES, PATTERNS = 600, 80
#: Words that a negation governs, and how far a target may be from an insult.
SCOPE, AIM = 3, 6
THRESHOLD = 0.5
MADE = ("toxic_score", "toxic_predicted")

#: Roles of a word, and the marks that transducers add, as bits of a symbol.
INSULT, HARMS, INTENDS, TARGET, NEGATES, SPEAKS, REPORTED, NEGATED, THREAT, AIMED = (1 << i for i in range(10))
#: Final states, with how much evidence there counts beside a plain insult before labels have a say, and as how
#: many texts that counts.
STATES = {"insult": 1.0, "aimed": 1.25, "threat": 1.0, "reported": 0.5, "negated": 0.25}
WEAK = ("reported", "negated")
PRIOR = 20
#: What a threat weighs, as a pattern does.
THREAT_WEIGHT = 2.0

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
EDGE = re.compile(r"[.!?;:\n]")


def stems(word: str) -> list[str]:
    """A word's candidates: itself, marked by a blank, and its beginnings."""
    return [word + " ", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))]


class Transducer:
    """start and step: (state, symbol) to (state, symbol).  Arcs are kept once they were asked for."""

    def __init__(self, start: Hashable, step: Callable[[Hashable, int], tuple[Hashable, int | str]]):
        self.start, self.step = start, step
        self.arcs: dict[tuple[Hashable, int], tuple[Hashable, int | str]] = {}

    def read(self, tape: list[int]) -> list:
        state, out, arcs = self.start, [], self.arcs
        for symbol in tape:
            arc = arcs.get((state, symbol))
            if arc is None:
                arc = arcs[state, symbol] = self.step(state, symbol)
            state = arc[0]
            out.append(arc[1])
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what first reads and writes what second makes of it; a state is a pair of theirs."""

    def step(state, symbol):
        a, between = first.step(state[0], symbol)
        b, out = second.step(state[1], between)
        return (a, b), out

    return Transducer((first.start, second.start), step)


def within(trigger: int, reach: int, mark: int, needs: int = 0) -> Transducer:
    """Marks the symbols (those with a role of `needs`, if given) from a trigger on to `reach` words after it."""

    def step(left, symbol):
        left = reach + 1 if symbol & trigger else max(left - 1, 0)
        return left, symbol | mark if left and (not needs or symbol & needs) else symbol

    return Transducer(0, step)


def ever(trigger: int, mark: int) -> Transducer:
    """Marks the symbols from a trigger on to the end."""

    def step(seen, symbol):
        seen = bool(seen or symbol & trigger)
        return seen, symbol | mark if seen else symbol

    return Transducer(False, step)


def final() -> Transducer:
    """From marked symbols to final states; the empty text for words that are neither insult nor threat."""

    def step(state, symbol):
        if not symbol & (INSULT | THREAT):
            return state, ""
        for mark, name in ((NEGATED, "negated"), (REPORTED, "reported"), (THREAT, "threat"), (AIMED, "aimed")):
            if symbol & mark:
                return state, name
        return state, "insult"

    return Transducer(0, step)


class Grammar:
    """Patterns (stems, or words marked by a blank, to weights), what final states count, and the logistic weights."""

    def __init__(self, patterns: dict[str, float], states: list[float] | None = None, counts: dict[str, float] | None = None):
        self.patterns, self.states, self.counts = patterns, states, counts or STATES
        self.harm = set(HARM)
        self.roles: dict[str, int] = defaultdict(int)
        for role, words in ((HARMS, HARM), (INTENDS, INTENT), (TARGET, TARGETS), (NEGATES, NEGATIONS), (SPEAKS, SPEECH)):
            for w in words:
                self.roles[w] |= role
        self.backwards = within(TARGET, AIM, AIMED)
        self.forwards = reduce(compose, [ever(SPEAKS, REPORTED), within(NEGATES, SCOPE, NEGATED), within(INTENDS, SCOPE, THREAT, HARMS), within(TARGET, AIM, AIMED), final()])
        self.heads = ahocorasick.Automaton()
        for p in {x.strip() for x in patterns} | self.harm:
            self.heads.add_word(p, len(p))
        self.heads.make_automaton()

    def heads_in(self, text: str) -> list[int]:
        """Where words that may be insults or threats begin."""
        out = []
        for end, size in self.heads.iter(text):
            at = end - size + 1
            if (not out or out[-1] < at) and not (at and text[at - 1].isalpha()):
                out.append(at)
        return sorted(set(out))

    def weight(self, word: str) -> float:
        """Of the insult transducer: its longest pattern that the word is or begins with."""
        w = self.patterns.get(word + " ")
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1) if w is None else ():
            w = self.patterns.get(word[:n])
            if w is not None:
                break
        return w or 0.0

    def clause(self, words: list[str]) -> dict[str, float]:
        """The composed transducers over a clause: weight by final state."""
        weights = [self.weight(w) for w in words]
        tape = [self.roles.get(w, 0) | (INSULT if x else 0) for w, x in zip(words, weights, strict=True)]
        tape = self.backwards.read(tape[::-1])[::-1]
        out: dict[str, float] = defaultdict(float)
        for word, weight, state in zip(words, weights, self.forwards.read(tape), strict=True):
            if state:
                out[state] += THREAT_WEIGHT if state == "threat" or not weight else weight
        return out

    def weighed(self, text: str | None) -> dict[str, float]:
        """What the clauses of a text weigh by final state."""
        low = (text or "").lower()
        total: dict[str, float] = defaultdict(float)
        done = -1
        for at in self.heads_in(low):
            if at < done:
                continue
            begin = max((m.end() for m in EDGE.finditer(low, max(done, 0), at)), default=max(done, 0))
            edge = EDGE.search(low, at)
            done = edge.start() if edge else len(low)
            for state, w in self.clause(WORD.findall(low, begin, done)).items():
                total[state] += w
        return total

    def measured(self, total: dict[str, float], size: int) -> list[float]:
        """Features: weights on a logarithmic scale without and with weak states, whether there are any, and by the text's length."""
        plain = sum(self.counts[s] * w for s, w in total.items() if s not in WEAK)
        weak = sum(self.counts[s] * w for s, w in total.items() if s in WEAK)
        return [math.log1p(plain), math.log1p(plain + weak), float(plain + weak > 0), 1000 * (plain + weak) / (1000 + size)]

    def features(self, text: str | None) -> list[float]:
        return self.measured(self.weighed(text), len(text or ""))

    def score(self, text: str | None) -> float:
        x = self.states[0] + sum(a * b for a, b in zip(self.states[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def log_odds(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def gain(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    """The likelihood ratio statistic of a pattern that pos of n_pos toxic and neg of n_neg other texts hold."""
    n, hit = n_pos + n_neg, pos + neg
    out = 0.0
    for seen, row, column in ((pos, n_pos, hit), (neg, n_neg, hit), (n_pos - pos, n_pos, n - hit), (n_neg - neg, n_neg, n - hit)):
        if seen > 0 and row and column:
            out += seen * math.log(seen * n / (row * column))
    return 2 * out if pos * n_neg > neg * n_pos else 0.0


def choose(rows: list[tuple[int, dict[str, int]]]) -> dict[str, float]:
    """Patterns with weights, from each text's label and counts of the candidates it holds.

    Takes the pattern, with the least count at which it tells, that explains most of the texts left, and
    leaves out the toxic ones that hold it, until what is left is no better than chance.
    """
    n_neg = sum(1 for y, _ in rows if not y)
    left = [counts for y, counts in rows if y]
    n_pos = len(left)
    neg: Counter = Counter()
    for y, counts in rows:
        if not y:
            for p, n in counts.items():
                neg.update((p, k) for k in range(1, n + 1))
    bar = 2 * math.log(CANDIDATES * MOST * 10)
    out: dict[str, float] = {}
    while left and len(out) < PATTERNS:
        pos: Counter = Counter()
        for counts in left:
            for p, n in counts.items():
                pos.update((p, k) for k in range(1, n + 1))
        ranked = [(gain(v, neg[c], len(left), n_neg), c) for c, v in pos.items() if v >= 2]
        # of equals the shorter stem, which holds for words that were not seen
        best = max(ranked, key=lambda x: (round(x[0], 6), -len(x[1][0]), x[1]), default=None)
        if best is None or best[0] < bar:
            break
        (p, k), v = best[1], pos[best[1]]
        out[p] = max(out.get(p, 0.0), max(0.1, log_odds(v, neg[best[1]], n_pos, n_neg)) / k)
        left = [c for c in left if c.get(p, 0) < k]
    return out


def counted_for(found: list[tuple[int, dict[str, float]]]) -> dict[str, float]:
    """What evidence in each final state counts: its share of toxic texts beside that of plain insults.

    Most labels hold few clauses of a kind, so STATES counts as PRIOR texts more.
    """
    texts = {s: [y for y, total in found if total.get(s)] for s in STATES}
    plain = (sum(texts["insult"]) + 1) / (len(texts["insult"]) + 2)
    out = {}
    for s, before in STATES.items():
        share = (sum(texts[s]) + PRIOR * min(1.0, before * plain)) / (len(texts[s]) + PRIOR)
        out[s] = share / plain if before < 1 else max(before, share / plain)
    return out | {"insult": 1.0}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """The constant and weights of a logistic regression, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        penalty = ridge * np.r_[0.01, np.ones(x.shape[1] - 1)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Grammar:
    """A grammar learned from at most `rows` labelled rows that are not held out.

    Words and stems are counted by label where the rows are, with sums before the shuffle; CANDIDATES of
    them come to the driver, then for each of the rows its counts of those, and for each its few
    features.  All three are bounded by the parameters.  Without toxic rows the general list is the grammar.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]
        for b in batches:
            for one, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own: Counter = Counter()
                for word, n in Counter(WORD.findall(one.lower())).items():
                    for p in stems(word):
                        own[p] += n
                counts[1 if y else 0].update((p, k) for p, n in own.items() for k in range(1, min(n, MOST) + 1))
        for y, found in enumerate(counts):
            items = list(found.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                n = pa.array([v for _, v in part], pa.int64())
                zero = pa.array(np.zeros(len(part), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([p for (p, _), _ in part]), pa.array([k for (_, k), _ in part], pa.int32()), *((zero, n) if y else (n, zero))], names=["p", "k", "neg", "pos"])

    some = cut(labelled.sample(docs, labels, label, rows))  # read four times
    totals = some.groupBy().agg(F.count_if(F.col("label") != 0), F.count_if(F.col("label") == 0)).first()
    n_pos, n_neg = totals[0], totals[1]
    patterns: dict[str, float] = {}
    if n_pos and n_neg:
        sums = map_batches(some, counted, "p string, k int, neg long, pos long").groupBy("p", "k").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        hit, n = F.col("pos") + F.col("neg"), n_pos + n_neg
        part = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)
        value = 2 * (part(F.col("pos"), F.lit(n_pos), hit) + part(F.col("neg"), F.lit(n_neg), hit) + part(n_pos - F.col("pos"), F.lit(n_pos), n - hit) + part(n_neg - F.col("neg"), F.lit(n_neg), n - hit))
        best = sums.where((F.col("pos") >= 2) & (F.col("pos") * n_neg > F.col("neg") * n_pos)).withColumn("g", value)
        chosen = best.groupBy("p").agg(F.max("g").alias("g")).orderBy(F.desc("g"), "p").limit(CANDIDATES)
        patterns = {r["p"]: 1.0 for r in chosen.select("p").collect()}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(patterns)
        code = {p: i for i, p in enumerate(names)}
        for b in batches:
            which, much = [], []
            for one in b.column(1).to_pylist():
                own: Counter = Counter()
                for word, n in Counter(WORD.findall(one.lower())).items():
                    for p in stems(word):
                        if p in code:
                            own[code[p]] += n
                which.append(list(own))
                much.append([min(n, MOST) for n in own.values()])
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(which, pa.list_(pa.int32())), pa.array(much, pa.list_(pa.int32()))], names=["label", "which", "much"])

    seeds = {w + " ": 1.0 for w in INSULTS}
    if not patterns:
        return Grammar({w: 4.0 for w in seeds}, [-4.0, 2.0, 2.0, 2.0, 0.0])
    names = list(patterns)
    found = [(1 if r["label"] else 0, {names[i]: n for i, n in zip(r["which"], r["much"], strict=True)}) for r in map_batches(some, held, "label int, which array<int>, much array<int>").collect()]
    learned = choose(found)
    strong = max([2.0, *learned.values()])
    # a general word weighs as much as the strongest learned pattern unless labels say otherwise
    grammar = Grammar({w: strong for w in seeds} | learned)

    items = tuple(grammar.patterns.items())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _grammar(items)
        for b in batches:
            texts = b.column(1).to_pylist()
            totals = [own.weighed(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array([[x.get(s, 0.0) for s in STATES] for x in totals], pa.list_(pa.float64()))], names=["label", "size", "x"])

    rows_ = map_batches(some, measured, "label int, size long, x array<double>").collect()
    y = [1 if r["label"] else 0 for r in rows_]
    totals_ = [{s: w for s, w in zip(STATES, r["x"], strict=True) if w} for r in rows_]
    grammar = Grammar(grammar.patterns, None, counted_for(list(zip(y, totals_, strict=True))))
    x = np.array([grammar.measured(t, r["size"]) for t, r in zip(totals_, rows_, strict=True)])
    grammar.states = logistic(x, np.array(y, np.float64))
    return grammar


@lru_cache(maxsize=8)
def _grammar(items: tuple, states: tuple = (), counts: tuple = ()) -> Grammar:
    return Grammar(dict(items), list(states) or None, dict(counts) or None)


def score(docs: DataFrame, grammar: Grammar, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows and columns, with toxic_score (0 to 1) and toxic_predicted (1 from the threshold on).

    Null and empty texts have no clauses and get the score of a text without any match.  Repeated rows
    are scored each.  Columns of these two names are replaced; `keep` leaves them alone.
    """
    docs = docs.drop(*MADE)
    rows, back = aside(docs, ["__text"])
    items, states, counts, names = tuple(grammar.patterns.items()), tuple(grammar.states), tuple(grammar.counts.items()), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _grammar(items, states, counts)
        for b in batches:
            s = np.array([own.score(t) for t in b.column(len(names)).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, *MADE])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", toxic_score double, toxic_predicted int"
    return back(map_batches(rows.select("*", F.col(text).cast("string").alias("__text")), run, schema))


def evaluate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted."""
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", labelled.held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score as toxic; all columns stay, whatever they are called."""
    rows, back = aside(docs, MADE)
    return back(score(rows, train(docs, labels), threshold=threshold).where("toxic_predicted = 0").drop(*MADE))
