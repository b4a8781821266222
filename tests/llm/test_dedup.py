"""Near-duplicates, repeated passages, components and vectors against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cleanloom.llm import components, simhash, substring, vectors


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# -- components ---------------------------------------------------------------------------------


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 3), (3, 4), (9, 8), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 29)]])
def test_components(spark, links):
    df = spark.createDataFrame([*links, (None, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    own = [(a, b) for a, b in links if a != b]
    assert got == roots({x for l in own for x in l}, own)


def test_random_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    own = [(a, b) for a, b in links if a != b]
    assert got == roots({x for l in own for x in l}, own)


# -- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] if words else []
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \t", "One Two", "one  two", "ÄÖ É x\x1cy z\x85w", "a b c d", "A B\nC D e f", "word " * 3000, "ends here."]


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [4096, 2, 1])
def test_links_connect_what_is_within_the_radius(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 6))))
    fps = sorted(fps)
    got = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    want = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 4]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in got)
    assert roots(fps, got) == roots(fps, want)


@pytest.mark.parametrize(("bucket", "rows"), [(4096, 1 << 16), (300, 4000)])
def test_a_dense_group_is_linked_without_its_pairs(spark, monkeypatch, bucket, rows):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "ROWS", rows)
    rnd, base = random.Random(12), random.Random(13).getrandbits(64)
    fps = {base ^ sum(1 << k for k in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 4, 4, 7, 9]))) for _ in range(5000)}
    fps = np.array(sorted(fps), np.uint64)
    got = simhash.links(spark.createDataFrame([(signed(int(x)),) for x in fps], "fp long"))
    rows_ = got.collect()
    a, b = (np.array([r[c] for r in rows_], np.int64).view(np.uint64) for c in ("a", "b"))
    assert np.bitwise_count(a ^ b).max() <= 4
    assert len(rows_) < 100 * len(fps)
    label = np.arange(len(fps))
    a, b = np.searchsorted(fps, a), np.searchsorted(fps, b)
    while (label[a] != label[b]).any():
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
    for i, x in enumerate(fps):
        assert (label[np.bitwise_count(fps ^ x) <= 4] == label[i]).all()


def test_groups(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = dict(enumerate(TEXTS, 100))
    for i in range(60):
        own = [rnd.choice(words) for _ in range(150)]
        for k in range(rnd.randint(1, 4)):
            changed = own.copy()
            for _ in range(k):
                changed[rnd.randrange(150)] = "new"
            texts[1000 + 10 * i + k] = " ".join(changed)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()] + [(1000, texts[1000], 1, "x")], "doc_id long, text string, fp int, root string")
    rows = simhash.groups(df).collect()
    fps = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = roots(list(texts), [(a, b) for a in texts for b in texts if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4])
    assert len(rows) == len(texts) + 1
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{fps[k]:016x}", want[k]) for k in texts}
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.groups(df.limit(0)).count() == 0


def test_null_and_shared_keys_do_not_lose_texts(spark):
    rnd = random.Random(8)
    make = lambda: " ".join(rnd.choice("abcdefghijklmnop") * 3 + str(rnd.randrange(90)) for _ in range(80))
    texts = [make() for _ in range(6)]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (5, texts[2], "a"), (5, texts[3], "a"), (None, texts[4], "a"), (7, texts[4], "a"), (5, texts[2], "b"), (None, texts[1], "a"), (8, texts[5], "a"), (8, texts[5], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4]), (8, texts[5])]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    clash = simhash.deduplicate(df.withColumnsRenamed({"source": "__mark"}).withColumn("fp", F.lit(1)).withColumn("component", F.lit("c")))
    assert clash.columns == ["doc_id", "text", "__mark", "fp", "component"]
    assert sorted(((r["doc_id"], r["text"]) for r in clash.collect()), key=str) == sorted(want, key=str)


# -- repeated passages --------------------------------------------------------------------------


def plain_removal(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def passages(seed):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = [make(n) for n in (20, 34, 35, 36, 60, 200)]
    texts = [None, "", "short text", " ".join(shared[3]), "same " * 100, "é\x1cx " * 40]
    for _ in range(80):
        own = []
        for _ in range(rnd.randint(1, 4)):
            own += make(rnd.randint(0, 60))
            if rnd.random() < 0.6:
                one = rnd.choice(shared).copy()
                if rnd.random() < 0.3:
                    one[rnd.randrange(len(one))] = "changed"
                own += one
        texts.append("\n".join(" ".join(own[i : i + 9]) for i in range(0, len(own), 9)))
    return texts + texts[-2:] + [texts[-1].replace("\n", "  ")]


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("block", [1 << 20, 64])
def test_repeated_passages(spark, monkeypatch, hot, block):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "BLOCK", block)
    texts = passages(hot + block)
    df = spark.createDataFrame([(i, t, 0, "a") for i, t in enumerate(texts)], "doc_id long, text string, start int, id1 string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.digests(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 35)


def test_repeated_rows_are_elsewhere_for_each_other(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = substring.digests(spark.createDataFrame([(1, text), (1, text), (1, "other"), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in rows) == [(False, 1, 0), (False, 50, 50), (False, 50, 50), (True, 50, 50)]


def test_cutting_keeps_rows_and_columns(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a  b {shared} c", "en"), (2, shared, "de"), (3, "left  alone\n", "fr"), (4, None, None)], "doc_id long, text string, found string")
    out = substring.deduplicate(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b c", 2: "", 3: "left  alone\n", 4: None}
    assert substring.deduplicate(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"found": "__repeated"}).withColumn("__row_1", F.lit(7)).withColumn("__text", F.lit("t"))
    again = substring.deduplicate(clash)
    assert again.columns == clash.columns
    assert {(r["doc_id"], r["text"], r["__repeated"], r["__row_1"], r["__text"]) for r in again.collect()} == {(r["doc_id"], r["text"], r["found"], 7, "t") for r in out.collect()}


# -- vectors ------------------------------------------------------------------------------------

INF, NAN = math.inf, math.nan


def clusters(seed, n=120, width=16):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, width))
    out = [(centres[i % 12] + rnd.normal(size=width) * rnd.choice([0.02, 0.2, 1.0])).tolist() for i in range(n)]
    return out + [out[0], out[0], [2 * x for x in out[1]], [0.0] * width, [NAN] + out[2][1:], [INF] + out[2][1:], None, [None] + out[3][1:]]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 17])
def test_near_duplicates_by_cosine(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = list(enumerate(clusters(block)))
    df = spark.createDataFrame([(i, v, 0) for i, v in rows] + [(0, rows[0][1], 0)], "vec_id long, embedding array<double>, n int").repartition(3)
    fit = {i: np.array(v) for i, v in rows if usable(v) and any(v)}
    links = [(a, b) for a in fit for b in fit if a < b and fit[a] @ fit[b] / math.sqrt((fit[a] @ fit[a]) * (fit[b] @ fit[b])) >= 0.95]
    of, degree = roots([i for i, _ in rows], links), Counter(x for l in links for x in l)
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (degree[i], of[i], of[i] == i) for i, _ in rows}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_a_repeated_key_has_its_smallest_vector(spark):
    rows = [(50, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()} == {50: (1, 1, False), 1: (1, 1, True), 2: (0, 2, True)}
    assert [tuple(r) for r in vectors.top_k(df).orderBy("rank").collect()] == [(50, 1, 1, 2 * 256 * 256), (50, 2, 2, 0)]


def test_vectors_of_other_lengths_do_not_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0]), (4, [])], "vec_id long, embedding array<float>")
    assert {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()} == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False), 4: (0, 4, True)}


def test_error_bounds_are_rigorous():
    rnd = np.random.default_rng(4)
    for width in (3, 64, 1500):
        a = rnd.normal(size=(80, width))
        b = np.vstack([a + rnd.normal(size=a.shape) * s for s in (0.0, 0.05, 0.32, 0.33, 1)])
        exact = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
        i, j = map(np.concatenate, zip(*vectors.linked(a, b, 0.95), strict=True))
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(exact >= 0.95)), strict=True))


def test_a_dense_tile_holds_no_list_of_its_pairs():
    rnd = np.random.default_rng(5)
    a = rnd.normal(size=(1, 64)) + 0.01 * rnd.normal(size=(3000, 64))
    part, n = np.arange(6000), 0
    tracemalloc.start()
    for i, j in vectors.linked(a, a, 0.95):
        n += len(i)
        components.join_parts(part, i, j + 3000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 9_000_000 and (part == 0).all()
    assert peak < 200e6


@pytest.mark.parametrize(("block", "size"), [(4096, 16 << 20), (13, 500)])
def test_top_k(spark, monkeypatch, block, size):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "ROWS", block)
    monkeypatch.setattr(vectors, "QUERY_BYTES", size)
    rows = [*enumerate(clusters(7, 200)), (300, [0.5] * 16), (350, [0.5] * 16), (351, [0.5] * 16), (400, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    fit = {i: [math.floor(256 * x) for x in v] for i, v in rows if usable(v)}
    want = defaultdict(list)
    for q in fit:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(fit[q], fit[c], strict=False)), c) for c in fit if c != q)
            want[q] = [(q, k, c, -s) for k, (s, c) in enumerate(scored[:5], 1)]
    got = defaultdict(list)
    for r in vectors.top_k(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(tuple(r))
    assert got == want
    few = vectors.top_k(df.where(F.col("vec_id").isin(0, 1, 2))).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few)] == [(0, 1), (0, 2)]
    assert vectors.top_k(df.limit(0)).count() == 0
