"""Counts tokens by field or section of a document that is encoded once, as a whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import bpe
from cleanloom.llm.common import map_batches, tokenizer_path

RULES = ("first", "last", "most")


def spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token.  Tokens that share a character's bytes both span it."""
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes[ids])
    return char[ends - sizes[ids]], char[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; starts: first character of each section, ascending.

    A token over a border goes by the rule: to the section of its first character, of its last, or
    to the one with most of its characters, the earlier one of equals.
    """
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    if rule == "first":
        return a
    if rule == "last":
        return b
    out = a.copy()
    for i in np.flatnonzero(a != b):  # few tokens, each over few sections
        edges = np.concatenate([[first[i]], starts[a[i] + 1 : b[i] + 1], [last[i] + 1]])
        out[i] = a[i] + int(np.argmax(np.diff(edges)))
    return out


def section_starts(text: str) -> np.ndarray:
    """Sections are lines, each with the line feed that ends it; an empty text is one empty section."""
    at = [i + 1 for i, c in enumerate(text) if c == "\n"] if len(text) < 200 else (np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1).tolist()
    return np.array([0, *(x for x in at if x < len(text))], np.int64)


def count_tokens(df: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """Tokens of each section: key, field, section, start, end, n_tokens, n_shared.

    The fields are joined by a line feed, which belongs to the field before it, and encoded once; a null
    field is empty.  start and end are characters of the field; n_shared are tokens that also span
    characters of another section.  A token is counted once, so that the sum over a document's sections
    is the length of its encoding.  Repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    path = tokenizer or tokenizer_path()

    def run(batches):
        encoder, table = bpe.library_encoder(path), bpe.token_bytes(path)
        sizes = np.zeros(max(table) + 1, np.int64)
        sizes[list(table)] = [len(x) for x in table.values()]
        for b in batches:
            columns = [[x or "" for x in b.column(i + 1).to_pylist()] for i in range(len(fields))]
            rows = list(zip(*columns, strict=True))
            out: list[list[np.ndarray]] = []
            for k, (parts, ids) in enumerate(zip(rows, encoder.many("\n".join(r) for r in rows), strict=True)):
                bases = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
                own = [section_starts(p) for p in parts]
                starts = np.concatenate([s + base for s, base in zip(own, bases, strict=True)])
                begin = np.concatenate(own)
                end = np.concatenate([np.append(s[1:], len(p)) for s, p in zip(own, parts, strict=True)])
                n = shared = np.zeros(len(starts), np.int64)
                if len(ids):
                    first, last = spans("\n".join(parts), ids, sizes)
                    section = allocate(first, last, starts, rule)
                    n = np.bincount(section, minlength=len(starts))
                    over = np.searchsorted(starts, first, "right") != np.searchsorted(starts, last, "right")
                    shared = np.bincount(section[over], minlength=len(starts))
                counts = [len(s) for s in own]
                out.append([np.full(len(starts), k), np.repeat(np.arange(len(fields)), counts), np.concatenate([np.arange(c) for c in counts]), begin, end, n, shared])
            if out:
                row, field, section, begin, end, n, shared = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.array(fields, object)[field], pa.string()), pa.array(section, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], names=[key, "field", "section", "start", "end", "n_tokens", "n_shared"])

    return map_batches(df.select(key, *(F.col(f).cast("string").alias(f) for f in fields)), run, f"{key} {df.schema[key].dataType.simpleString()}, field string, section int, start long, end long, n_tokens long, n_shared long")
