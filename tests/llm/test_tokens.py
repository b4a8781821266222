"""Encoding, packing, token files and token counts against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cleanloom.llm import attribution, bpe, common, packing, tokenfiles, transcode

PATH = common.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    None, "", " ", "  a", "a  b", "a b ", "x\n y", "x \n\ny's 'll they'll", "<|endoftext|> a <|endoftext|>b", "ab<|endoftext|>", "é  è　x", "a\x1cb !\x1c!", "aaaaaaaaaaaaaaaaaaaaaaa",
    "你好世界" * 50, "'" * 30, "x" * 3000 + " y", "zq" * 700, "\n\n\n  \n", "😀 ok", "the same", "the same", "word " * 5000,
]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(3, "  a", "x", "y"), (None, "no key", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, shard string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab '\n\t é1.!　<|", max_size=40)), max_size=8))
def test_both_encoders_agree_with_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [library(t) for t in texts]
    for encoder in (bpe.library_encoder(PATH), bpe.stream_encoder(PATH)):
        assert [x.tolist() for x in encoder.many(texts)] == want


def test_long_words_stream_in_bounded_memory():
    merges, rnd = bpe.load_merges(PATH), random.Random(5)
    for word in ("".join(rnd.choice("etaoinshrdlu") for _ in range(6000)), "a" * 4000, "ab" * 3000):
        one, out, held = bpe.Transducer(merges), [], 0
        for k in range(0, len(word), 11):
            out += one.push(word[k : k + 11].encode())
            held = max(held, len(one.held))
        assert out + one.close() == library(word)
        assert held <= 2 * merges.lookahead + bpe.LONG


def test_no_future_changes_what_lies_behind_the_lookahead():
    merges, rnd = bpe.load_merges(PATH), random.Random(6)
    for _ in range(40):
        head = "".join(rnd.choice("etaoinshrdlu") for _ in range(merges.lookahead + 100))
        both = [library(head + "".join(rnd.choice("etaoinshrdlu") for _ in range(60))) for _ in range(2)]
        stable = len(head) - merges.lookahead
        cut = []
        for ids in both:
            end, own = 0, []
            for i in ids:
                end += len(merges.bytes_of[i])
                if end <= stable:
                    own.append(i)
            cut.append(own)
        assert cut[0] == cut[1]


def test_windows_of_a_long_text(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 50)
    text = "some words, in  a row\n and more of them " * 40 + "x" * 300 + " end"
    encoder = bpe.library_encoder(PATH)
    assert "".join(encoder.windows(text)) == text
    assert next(encoder.many([text])).tolist() == library(text)


def test_decoder_holds_back_unfinished_characters():
    merges = bpe.load_merges(PATH)
    text = "ä😀 你 fin"
    one, out = bpe.Decoder(merges), []
    for i in library(text):
        out.append(one.push([i]))
    assert "".join(out) + one.close() == text
    broken = bpe.Decoder(merges)
    first = library("😀")[:1]
    assert broken.push(first) + broken.close() == LIBRARY.decode(first, skip_special_tokens=False)


def test_round_trip(docs, none):
    got = transcode.round_trip(docs).collect()
    assert len(got) == docs.count()
    for r, (key, text, *_) in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0)), sorted(docs.collect(), key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        ids = library(text)
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert (r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert transcode.round_trip(none).count() == 0


def test_encode_then_decode(docs):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    back = transcode.decode(transcode.encode(some)).collect()
    assert {r[0]: r[1] for r in back} == {r[0]: r[1] or "" for r in some.collect()}


def test_token_files(spark, docs, none, tmp_path):
    path = str(tmp_path / "files")
    tokenfiles.write(docs, path, end_id=2)
    got = sorted(tokenfiles.digests(spark, path).collect(), key=lambda r: r["start"])
    want, start = [], 0
    for key, text in sorted(((r[0], r[1]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library(text), 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    one = tokenfiles.read(spark, path).where("doc_id = 18")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,18)]" in one._jdf.queryExecution().toString()
    assert one.first()["ids"][:-1] == library(ODD[18])
    empty = str(tmp_path / "none")
    tokenfiles.write(none, empty, end_id=2)
    assert tokenfiles.digests(spark, empty).count() == 0


def test_token_files_have_their_layout(docs, tmp_path):
    """Ids by dictionary, counters by deltas, and an index of each column's pages."""
    path = tmp_path / "files"
    tokenfiles.write(docs.coalesce(1), str(path), end_id=2)
    files = [pq.ParquetFile(f) for f in sorted(path.glob("*.parquet"))]
    seen = defaultdict(set)
    for f in files:
        for g in range(f.metadata.num_row_groups):
            for c in range(f.metadata.num_columns):
                column = f.metadata.row_group(g).column(c)
                seen[column.path_in_schema.split(".")[0]].update(column.encodings)
                assert column.has_offset_index and column.has_column_index
    assert "RLE_DICTIONARY" in seen["ids"] or "PLAIN_DICTIONARY" in seen["ids"]
    assert all("DELTA_BINARY_PACKED" in seen[c] for c in ("doc_id", "n_tokens", "start"))


def test_rows_of_one_key_may_lie_in_several_files(spark, tmp_path):
    texts = [f"{c}{i} some words" for c in "abcdefgh" for i in range(50)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, t) for t in texts], "doc_id long, text string")
    path = str(tmp_path / "files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one file
    tokenfiles.write(df, path, end_id=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tokenfiles.read(spark, path).where("doc_id = 1").select("shard").distinct().count() > 1
    got = sorted(tokenfiles.digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * len(texts) + [1] * len(texts)
    assert [r["ids_crc32"] for r in got] == 2 * [zlib.crc32(np.array([*library(t), 2], "<u4").tobytes()) for t in sorted(texts)]


def check_packing(rows, texts, room):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for key, own in by_doc.items():
        ids = [*library(texts[key]), 0]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and (r["length"] == room or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= room
    return len(by_bin)


@pytest.mark.parametrize("leaf", [50_000, 90])
def test_packing(spark, none, monkeypatch, leaf):
    monkeypatch.setattr(packing, "FAN", 2)
    monkeypatch.setattr(packing, "LEAF", leaf)
    rnd = random.Random(1)
    texts = {i: " ".join(rnd.choice(["one", "two", "three", "é"]) for _ in range(rnd.randint(0, 160))) for i in range(400)} | {400: None, 401: "a b c " * 900}
    df = spark.createDataFrame([(k, v, k) for k, v in texts.items()], "doc_id long, text string, sequence_id long").repartition(7)
    made = check_packing(packing.pack(df, 64).collect(), texts, 64)
    total = sum(len(library(t)) + 1 for t in texts.values())
    assert made <= 1.02 * -(-total // 64)
    assert packing.pack(none).count() == 0


def test_packing_ends_what_cannot_be_joined(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAF", 10)
    texts = {i: "one two three four five six" * 3 for i in range(50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert check_packing(packing.pack(df, 24).collect(), texts, 24) == 50


def test_packing_joins_sizes_that_lie_apart(spark, monkeypatch):
    """Sizes that only fit together, each in partitions of its own, more of each than a leaf takes."""
    monkeypatch.setattr(packing, "LEAF", 500)
    texts = {i: "a " * (32 if i < 1500 else 28) + "a" for i in range(3000)}
    assert {len(library(texts[i])) for i in (0, 2999)} == {33, 29}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(6, "doc_id")
    assert check_packing(packing.pack(df, 64).collect(), texts, 64) <= 1.1 * 1500


def test_packing_keeps_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["length"]) for r in packing.pack(df).collect()) == [(False, 3), (False, 3), (True, 2)]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_token_counts_by_section(docs, none, rule):
    rows = attribution.count_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), rule=rule).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for key, text in enumerate(ODD):
        own = sorted(by_doc[key], key=lambda r: r["section"])
        text = text or ""
        assert "".join(text[r["start"] : r["end"]] for r in own) == text
        assert all(text[r["start"] : r["end"]].find("\n") in (-1, r["end"] - r["start"] - 1) for r in own)
        counts = [0] * len(own)
        for begin, end in LIBRARY.encode(text, add_special_tokens=False).offsets:
            chars = [max(0, min(end, r["end"]) - max(begin, r["start"])) for r in own]
            touched = [i for i, n in enumerate(chars) if n]
            counts[touched[0] if rule == "first" else touched[-1] if rule == "last" else chars.index(max(chars))] += 1
        assert [r["n_tokens"] for r in own] == counts
    assert attribution.count_tokens(none).count() == 0


def test_token_counts_of_null_keys_repeats_and_borders(spark):
    df = spark.createDataFrame([(None, "a\nb"), (1, "x\n\n\ny"), (1, "x\n\n\ny"), (2, None)], "doc_id long, text string")
    rows = attribution.count_tokens(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["section"]) for r in rows) == sorted([(True, 0, 0), (True, 0, 1), (False, 2, 0)] + 2 * [(False, 1, i) for i in range(4)])
    offsets = LIBRARY.encode("x\n\n\ny", add_special_tokens=False).offsets
    over = sum(1 for a, b in offsets if len({0 if i < 2 else i - 1 for i in range(a, b)}) > 1)
    assert over and sum(r["n_shared"] for r in rows if r["doc_id"] == 1) == 2 * over
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 1) == 2 * len(offsets)


def test_token_counts_by_field(spark):
    df = spark.createDataFrame([(1, "a title", "the body\nof it", None), (2, None, "", "x")], "doc_id long, title string, body string, foot string")
    rows = attribution.count_tokens(df, fields=("title", "body", "foot")).collect()
    total = {r["doc_id"]: r["n"] for r in attribution.count_tokens(df, fields=("title", "body", "foot")).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert total == {1: len(library("a title\nthe body\nof it\n")), 2: len(library("\n\nx"))}
    assert {(r["doc_id"], r["field"], r["section"]) for r in rows} == {(1, "title", 0), (1, "body", 0), (1, "body", 1), (1, "foot", 0), (2, "title", 0), (2, "body", 0), (2, "foot", 0)}
    with pytest.raises(ValueError):
        attribution.count_tokens(df, rule="other")
