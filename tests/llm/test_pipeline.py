"""The registered queries and the corpus pipeline, each stage against brute force on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cleanloom.llm import common, registry
from cleanloom.llm.quality import evaluate as quality_of
from cleanloom.llm.toxicity import evaluate as toxicity_of

from .test_dedup import plain_fingerprint, plain_removal, roots
from .test_tokens import check_packing

WORDS = [a + b for a in "ba de fi go lu ma ne po ri su".split() for b in "ka len mir nos ra ta vel".split()]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd, folder = random.Random(4), str(tmp_path_factory.mktemp("corpus"))
    make = lambda n: [rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(n)]
    shared, texts = make(60), []
    for i in range(300):
        words = make(rnd.randint(20, 200))
        if i % 9 == 0:
            words[5:5] = shared
        if i % 7 == 0:
            for k in range(3):
                words.insert(4 * k, rnd.choice(["idiot", "scum"]))
        if i % 8 == 0:
            words = [w.upper() + "!!" for w in words]
        texts.append((" ".join(words), i % 7 == 0, i % 8 != 0))
    texts += [texts[1], (texts[2][0] + " end", *texts[2][1:]), texts[5]]
    rows = [(i, text, "en", f"s{i % 3}", len(text)) for i, (text, *_) in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(q), int(x)) for i, (_, x, q) in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, corpus)
        assert out.columns == columns
        path = common.new_folder(spark, name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity_of(docs, labels).where("predicted = 0").collect()}
        elif name == "quality":
            want = {r["doc_id"] for r in quality_of(docs, labels).where("predicted = 1").collect()}
        elif name == "near_duplicates":
            fps = {k: plain_fingerprint(t) for k, t in before.items()}
            want = set(roots(list(before), [(a, b) for a in before for b in before if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4]).values())
        else:
            want = set(before)
            removed = dict(zip(before, plain_removal(list(before.values()), 35), strict=True))
            for k, (n, gone, _) in removed.items():
                assert len((kept[name][k] or "").split()) == n - gone
            assert all(r["n_chars"] == len(r["text"]) for r in after.where("text is not null").collect())
        assert set(kept[name]) == want
        docs = after
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    poor = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(toxic & set(kept["toxicity"])) <= 2 and len(poor & set(kept["quality"])) <= 2
    assert len(set(kept["toxicity"]) - toxic) >= 0.98 * (303 - len(toxic))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    check_packing(rows, kept["repeats"], 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus).select("doc_id", "piece", "length", "ids_crc32").collect()), key=str) == sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, corpus, name):
    """Null keys and texts, repeated rows, columns of any name, a table without n_chars and an empty one."""
    stage, long = dict(corpus_pipeline.STAGES)[name], " ".join(rnd_words(70))
    rows = [(None, None, "a"), (None, long, "b"), (1, "", "c"), (1, "", "c"), (2, long, "d"), (3, "calm words " * 3000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("__text", F.lit(1)).withColumn("quality_score", F.lit("q")).withColumn("component", F.lit(2))
    out = stage(spark, docs, corpus)
    if name != "packing":
        assert out.columns == docs.columns
    got = out.collect()
    assert 0 < len(got) <= (len(rows) if name != "packing" else 20)
    assert stage(spark, docs.limit(0), corpus).count() == 0


def rnd_words(n):
    rnd = random.Random(6)
    return [rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(n)]


def test_the_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "repeats", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_have_their_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = {
        "op1_simhash": {"doc_id", "fingerprint", "component_id"}, "op2_topk": {"query_id", "rank", "vec_id", "score"}, "op3_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op4_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op5_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op7_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"}, "op8_token_counts": {"doc_id", "field", "section", "start", "end", "n_tokens", "n_shared"}, "op9_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op10_quality": {"doc_id", "held_out", "score", "predicted"},
    }
    queries = registry.queries()
    assert set(queries) == set(want)
    n = {t: registry.table(spark, sf_dir, t).count() for t in ("documents", "embeddings")}
    for name, columns in want.items():
        df = queries[name](spark, sf_dir)
        assert columns <= set(df.columns)
        if name not in ("op2_topk", "op4_packing", "op8_token_counts"):
            key = "vec_id" if "vec_id" in columns else "doc_id"
            assert (df.count(), df.select(F.count_distinct(key)).first()[0]) == (n["embeddings" if key == "vec_id" else "documents"],) * 2


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        common.shared_folder(session)
