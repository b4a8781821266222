"""The toxicity grammar and the quality classifier: held-out accuracy and defined edge cases."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cleanloom.llm import labelled, quality, toxicity

WORDS = [a + b for a in "ba de fi go lu ma ne po ri su".split() for b in "ka len mir nos ra ta vel".split()]


def corpus(spark, n=600):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 80))]
        toxic, poor = rnd.random() < 0.15, rnd.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scum", "zorq" + rnd.choice(WORDS)]))
        if poor:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words) + ".", "en", "s", 1))
        labels.append((i, int(not poor), int(toxic)))
    extra = [(n, None, None, None, None), (n + 1, "", "", "", 0), (n + 2, "idiot " * 30_000, "en", "s", 1), (None, "no key", "en", "s", 1), (0, docs[0][1], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, label int"
    return spark.createDataFrame(docs + extra, schema), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def made(spark):
    return corpus(spark)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_rows_are_predicted(made, module, label):
    docs, labels = made
    rows = module.evaluate(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None and r["doc_id"] is not None}
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert len(test) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_training_is_the_same_again_and_without_labels_defined(made, module):
    docs, labels = made
    one, two = ({r["doc_id"]: r["score"] for r in module.evaluate(d, labels).collect()} for d in (docs, docs.repartition(5)))
    assert one == pytest.approx(two, abs=1e-9)
    assert module.evaluate(docs, labels.limit(0)).count() == docs.count()
    assert module.evaluate(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_filters_keep_columns(made, module):
    docs, labels = made
    out = module.keep(docs, labels)
    assert out.columns == docs.columns
    assert 0.7 * docs.count() < out.count() < docs.count()


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_columns_called_like_the_score_stay(made, module, kind):
    docs, labels = made
    clash = docs.select("doc_id", "text", F.lit("a").alias(f"{kind}_score"), F.col("label").alias(f"{kind}_predicted"), F.lit(3).alias("__text"))
    out = module.keep(clash, labels)
    assert out.columns == clash.columns
    assert {tuple(r)[2:] for r in out.collect()} <= {("a", 1, 3), ("a", None, 3), ("a", 0, 3)}
    assert out.count() == module.keep(docs, labels).count()


def test_held_out_rows_are_not_learned_from(made):
    docs, labels = made
    lying = labels.withColumn("toxic", F.when(labelled.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels).patterns == toxicity.train(docs, lying).patterns


def test_long_clauses_are_read_whole():
    grammar = toxicity.Grammar({"idiot ": 2.0, "zorq ": 1.0})
    weighed = lambda text: grammar.features(text)[0]
    both = math.log1p(3.0)
    for gap in range(225, 245):  # the second insult lies across what was the end of the first one's reach
        assert weighed("idiot" + " " + "x" * gap + " zorq") == pytest.approx(both)
    far = " ".join(["word"] * 200)
    assert weighed(f"she said {far} idiot") == 0 and weighed(f"she said. {far} idiot") == pytest.approx(math.log1p(2.0))
    assert weighed(f"idiot {far} she said {far} zorq") == pytest.approx(math.log1p(2.0))
    assert weighed("idiot not " + "x" * 300 + " zorq") == pytest.approx(math.log1p(2.0))


def test_the_sample_is_bounded(made):
    docs, labels = made
    assert labelled.sample(docs, labels, "toxic", 50).select("place").distinct().count() <= 50


def test_clauses_compose():
    grammar = toxicity.Grammar({"idiot ": 2.0, "zorq": 1.0})
    states = lambda text: {k: v for k, v in grammar.clause(text.split()).items() if v}
    assert states("what an idiot") == {"insult": 2.0}
    assert states("you are an idiot") == {"aimed": 2.0}
    assert states("idiot that you are") == {"aimed": 2.0}
    assert states("he is not an idiot") == {"negated": 2.0}
    assert states("peter called it a zorqly thing") == {"reported": 1.0}
    assert states("i will kill you") == {"threat": 2.0}
    assert states("they kill time") == {}
    assert states("a threat of rain") == {}


def plain_states(words, patterns):
    """What the grammar says, word by word from its definition and without automata."""
    out = {}
    near = lambda i, some, back, ahead=0: any(0 <= k < len(words) and words[k] in some for k in range(i - back, i + ahead + 1))
    for i, word in enumerate(words):
        fits = [p for p in patterns if p == word + " " or p[-1] != " " and 3 <= len(p) <= 8 and word.startswith(p)]
        weight = patterns[max(fits, key=lambda p: (p == word + " ", len(p)))] if fits else 0
        threat = word in toxicity.HARM and near(i, toxicity.INTENT, toxicity.SCOPE)
        if not weight and not threat:
            continue
        if near(i, toxicity.NEGATIONS, toxicity.SCOPE):
            state = "negated"
        elif near(i, toxicity.SPEECH, i):
            state = "reported"
        elif threat:
            state = "threat"
        else:
            state = "aimed" if near(i, toxicity.TARGETS, toxicity.AIM, toxicity.AIM) else "insult"
        out[state] = out.get(state, 0) + (2.0 if state == "threat" or not weight else weight)
    return out


def test_composed_clauses_are_as_defined():
    rnd, patterns = random.Random(21), {"idiot ": 2.0, "zorq": 1.0, "zorqua": 0.5, "stab ": 3.0}
    grammar = toxicity.Grammar(patterns)
    words = "idiot zorq zorquas stab kill hurt will said told not never you them a b c d e f g".split()
    for _ in range(3000):
        clause = [rnd.choice(words) if rnd.random() < 0.5 else rnd.choice("abcdefg") for _ in range(rnd.randint(0, 25))]
        assert {k: v for k, v in grammar.clause(clause).items() if v} == pytest.approx(plain_states(clause, patterns)), clause


def test_scores_are_as_defined(spark, made):
    """The query's score against sentences cut and weighed plainly with the grammar that was learned."""
    docs, labels = made
    grammar = toxicity.train(docs, labels)
    assert set(grammar.counts) == set(toxicity.STATES) and grammar.counts["insult"] == 1
    for r in toxicity.score(docs.select("doc_id", "text"), grammar).where("length(text) < 1000 or text is null").collect():
        low, total = (r["text"] or "").lower(), {}
        for clause in re.split(r"[.!?;:\n]", low):
            for state, w in plain_states(toxicity.WORD.findall(clause), grammar.patterns).items():
                total[state] = total.get(state, 0) + grammar.counts[state] * w
        weak = total.get("reported", 0) + total.get("negated", 0)
        plain = sum(total.values()) - weak
        x = [1.0, math.log1p(plain), math.log1p(plain + weak), float(plain + weak > 0), 1000 * (plain + weak) / (1000 + len(low))]
        assert r["toxic_score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, grammar.states, strict=True)))), rel=1e-9)


def test_ftrl_is_as_defined(monkeypatch):
    """The vector steps against the published update, one weight at a time."""
    import numpy as np

    monkeypatch.setattr(quality, "SPACE", 12)
    rnd = random.Random(22)
    rows = []
    for _ in range(40):
        grams = sorted(rnd.sample(range(12), 4)) + [12]
        rows.append((np.array(grams), np.array([rnd.random() for _ in range(4)] + [1.0]), int(3 in grams)))
    passes = min(quality.MOST_PASSES, max(1, round(quality.STEPS / len(rows))))
    z, n = [0.0] * 13, [0.0] * 13
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(passes):
        for grams, values, y in rows:
            w = [weight(i) for i in grams]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, values, strict=True))))
            for i, wi, v in zip(grams, w, values, strict=True):
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * wi
                n[i] += g * g
    assert quality.ftrl(rows) == pytest.approx([weight(i) for i in range(13)], rel=1e-6, abs=1e-9)


def test_ngrams_are_as_defined():
    import numpy as np
    import xxhash

    words = "a b a b a c a b a".split()
    of, grams, values = quality.ngrams([w.encode() for w in words], np.zeros(len(words), np.int64))
    got = {}
    for g, v in zip(grams.tolist(), values.tolist(), strict=True):
        got[g] = got.get(g, 0) + v
    top = (1 << 64) - 1

    def slot(x, kind):
        x = (x + kind * 0x9E3779B97F4A7C15) & top
        for _ in range(2):
            x = ((x ^ x >> 32) if _ else x) * 0xD6E8FEB86659FD93 & top
        return (x ^ x >> 32) >> 40 & quality.SPACE - 1

    word = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    for w in "abc":
        assert got[slot(xxhash.xxh3_64_intdigest(w.encode()), 1)] == pytest.approx(words.count(w) / len(words))
    pairs = [(a * 0x9FB21C651E98DF25 & top) ^ b for a, b in zip(word, word[1:], strict=False)]
    for p in set(pairs):
        assert got[slot(p, 2)] == pytest.approx(pairs.count(p) / len(pairs))
    seen, repeats = set(), 0
    for t in zip(words, words[1:], words[2:], strict=False):
        repeats += t in seen
        seen.add(t)
    assert got[slot(1, 6)] == pytest.approx(repeats / (len(words) - 2))
    assert sum(values) == pytest.approx(6)


def test_only_whole_words_and_beginnings_match():
    grammar = toxicity.Grammar({"idiot ": 2.0, "zorq": 1.0})
    assert grammar.features("idiotic and xzorq, an antiidiot") == [0.0, 0.0, 0.0, 0.0]
    assert grammar.features("Zorqan!")[0] > 0


def test_ngrams_do_not_cross_texts():
    import numpy as np

    alone = [quality.ngrams(w, np.zeros(len(w), np.int64)) for w in ([b"a", b"b"], [b"b", b"c", b"d"])]
    both = quality.ngrams([b"a", b"b", b"b", b"c", b"d"], np.array([0, 0, 1, 1, 1]))
    for k, (_, grams, values) in enumerate(alone):
        assert sorted(zip(both[1][both[0] == k], both[2][both[0] == k], strict=True)) == sorted(zip(grams, values, strict=True))
