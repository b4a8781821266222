"""Encodes and decodes whole texts (BPE round trip)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from cleanloom.llm import bpe
from cleanloom.llm.common import map_batches, tokenizer_path


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, ids array<int>) for each row, by the streaming transducer; a null text is an empty one.

    Repeated rows are encoded each; no other column is read.
    """
    path = tokenizer or tokenizer_path()

    def run(batches):
        encoder = bpe.stream_encoder(path)
        for b in batches:
            ids = list(encoder.many(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return map_batches(df.select(key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(key, text) for each row of ids; null ids are none.  Bytes that are no text become U+FFFD."""
    path = tokenizer or tokenizer_path()

    def run(batches):
        merges = bpe.load_merges(path)
        for b in batches:
            texts = []
            for row in b.column(1).to_pylist():
                one = bpe.Decoder(merges)
                texts.append(one.push(row or ()) + one.close())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return map_batches(df.select(key, ids), run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """For each row what encoding gives and what decoding those ids gives, as digests.

    Columns: key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.  A null or
    empty text has no ids; both digests are those of the empty string.
    """
    path = tokenizer or tokenizer_path()

    def run(batches):
        encoder, merges = bpe.stream_encoder(path), bpe.load_merges(path)
        decimal = {i: str(i) for i in merges.bytes_of}
        for b in batches:
            counts, coded, decoded = [], [], []
            for ids in encoder.many(b.column(1).to_pylist()):
                counts.append(len(ids))
                digest, back, one = hashlib.sha256(), hashlib.sha256(), bpe.Decoder(merges)
                for at in range(0, len(ids), 1 << 16):
                    part = ids[at : at + (1 << 16)].tolist()
                    digest.update(("," * (at > 0) + ",".join(map(decimal.__getitem__, part))).encode())
                    back.update(one.push(part).encode())
                back.update(one.close().encode())
                coded.append(digest.hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(df.select(key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
