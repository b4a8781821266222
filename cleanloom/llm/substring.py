"""Removes passages that repeat in a corpus, by suffix automata over shards of its passages.

A passage is a window of WINDOW consecutive words.  The corpus is its own reference, so broadcasting
automata of all of it would grow with the data.  Instead the reference is cut into shards that need
only the documents which can match them, and each shard meets those in one task:

1. Each window has an anchor, the least hash among its runs of GRAM words (the leftmost of equals).
   Equal windows have equal anchors.  Neighbouring windows mostly share one; such a run of
   windows is a region, and every window lies in exactly one.  Anchors are counted.
2. Regions whose anchor occurs again go to their anchor's shard, the others need no more work.  A
   Bloom filter of at most FILTER_BITS bits says which; what it lets through wrongly costs
   time only.
3. In a shard equal regions are one reference with a weight.  Where regions differ, a suffix
   automaton over them counts the occurrences of all their subsequences; each region is streamed
   through it, and the windows that end in a state with two occurrences or more are repeated.
4. An anchor with more than HOT occurrences (a very common passage) would make one shard too large.
   Its equal regions are summed before the shuffle, and the windows of its different regions are
   counted as keys of their own, with partial sums.  A second Bloom filter names these anchors; one that it
   names wrongly is counted by windows too, which gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import aside, cut, map_batches

WINDOW = 35
GRAM = 16
#: Regions of an anchor that one task takes, and bits of a filter.
HOT = 20_000
FILTER_BITS = 1 << 27
#: Words that are worked on at once.
BLOCK = 1 << 20
#: Bytes of a word's hash in a region.
SYMBOL = 6
#: Columns of our own beside those of the input.
ID1, ID2, FOUND, CUT = "__row_1", "__row_2", "__repeated", "__text"
#: Multiplier of the rolling hash; odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than blank and tab to carriage return."""
    return text.encode().split() if text else []


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, which: str) -> np.ndarray:
    if len(_powers[which]) < n:
        step = BASE if which == "up" else pow(BASE, -1, 1 << 64)
        _powers[which] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, step, np.uint64)]))
    return _powers[which][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Regions:
    """The regions of a block of words.  `segment` is the number of the text part each word is of."""

    def __init__(self, words: list[bytes], segment: np.ndarray, window: int, gram: int):
        digest = xxhash.xxh3_64_intdigest
        self.hash = np.fromiter(map(digest, words), np.uint64, len(words))
        self.window, n = window, len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * powers(n, "up"), dtype=np.uint64)])
        starts = np.arange(n - window + 1)
        valid = segment[: len(starts)] == segment[window - 1 :]
        value = mixed(self.rolled(np.arange(n - gram + 1), np.arange(gram, n + 1)))
        place = np.arange(len(value))
        # least value of 2, 4, 8 ... grams, then of all in a window, the leftmost of equals
        width, most = 1, window - gram + 1
        while width < most:
            step = min(width, most - width)
            right = value[step:] < value[:-step]
            value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
            width += step
        at = starts[valid]
        place = place[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1) | (segment[at[1:]] != segment[at[:-1]])
        first = np.flatnonzero(new)
        self.start, self.count = at[first], np.diff(first, append=len(at))
        self.anchor = value[self.start].view(np.int64)
        self.segment = segment[self.start]
        self.origin = np.flatnonzero(np.diff(segment, prepend=-1))

    def rolled(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * powers(len(self.hash), "down")[begin]

    def same(self, which: np.ndarray) -> np.ndarray:
        """A hash of each region's words; with the anchor it names the region's content."""
        return mixed(self.rolled(self.start[which], self.start[which] + self.count[which] + self.window - 1)).view(np.int64)

    def symbols(self, which: np.ndarray) -> list[bytes]:
        raw = self.hash.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SYMBOL].tobytes()
        ends = (self.start[which] + self.count[which] + self.window - 1) * SYMBOL
        return [raw[a:b] for a, b in zip((self.start[which] * SYMBOL).tolist(), ends.tolist(), strict=True)]


def blocks(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple[Regions, np.ndarray, np.ndarray]]:
    """Regions of a batch's texts (last column), with the row and the first word's number of each segment."""
    words: list[bytes] = []
    sizes: list[int] = []
    rows: list[int] = []
    bases: list[int] = []

    def out() -> Iterator[tuple[Regions, np.ndarray, np.ndarray]]:
        if sizes:
            yield Regions(words, np.repeat(np.arange(len(sizes)), sizes), window, gram), np.array(rows), np.array(bases)
        words.clear(), sizes.clear(), rows.clear(), bases.clear()

    for row, text in enumerate(batch.column(batch.num_columns - 1)):
        whole = words_of(text.as_py())
        for base in range(0, len(whole) - window + 1, BLOCK):
            part = whole[base : base + BLOCK + window - 1]
            words += part
            sizes.append(len(part))
            rows.append(row)
            bases.append(base)
            if len(words) >= BLOCK:
                yield from out()
    yield from out()


class Automaton:
    """A suffix automaton over several sequences, with how often each state's subsequences occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list, weight: int) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.count[last] += weight

    def _extend(self, last: int, c) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.count.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def close(self) -> None:
        """From the occurrences that end at each state to those of all states above it."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def repeated(self, sequence: list, window: int) -> int:
        """Bit i: the window of the sequence that starts at i occurs at least twice."""
        out, v, matched = 0, 0, 0
        for i, c in enumerate(sequence):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v, matched = self.next[v][c], matched + 1
            while v and self.length[self.link[v]] >= window:
                v = self.link[v]
                matched = self.length[v]
            if matched >= window and self.count[v] > 1:
                out |= 1 << (i + 1 - window)
        return out


def masks(regions: dict[int, tuple[bytes, int]], window: int) -> dict[int, int]:
    """For each region of one anchor (words' symbols, occurrences) which of its windows are repeated."""
    if len(regions) == 1:
        (key, (symbols, n)), = regions.items()
        return {key: (1 << (len(symbols) // SYMBOL - window + 1)) - 1 if n > 1 else 0}
    sequences = {k: [s[i : i + SYMBOL] for i in range(0, len(s), SYMBOL)] for k, (s, _) in regions.items()}
    shard = Automaton()
    for k, (_, n) in regions.items():
        shard.add(sequences[k], n)
    shard.close()
    return {k: shard.repeated(s, window) for k, s in sequences.items()}


def _filter_of(anchors: DataFrame) -> np.ndarray:
    """A Bloom filter with two bits for each anchor, as bytes; its size follows the count up to FILTER_BITS."""
    n = anchors.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    low, high = F.col("anchor"), F.shiftrightunsigned("anchor", 32)
    at = anchors.select(F.explode(F.array(*(x.bitwiseAND(F.lit(bits - 1)) for x in (low, high)))).alias("bit"))
    filled = at.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v"))
    table = filled.toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits // 64, "<i8")
    out[table["word"].to_numpy()] = table["v"].to_numpy()
    return out.view(np.uint8)


def _passes(bloom: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchor), bool)
    for bit in (anchor, (anchor.view(np.uint64) >> np.uint64(32)).view(np.int64)):
        bit = bit & (8 * len(bloom) - 1)
        out &= (bloom[bit >> 3] >> (bit & 7) & 1).astype(bool)
    return out


def spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id1, id2, start, mask): bit i of mask says that the window at word start + i is repeated.

    rows: id1, id2 (long) and text; equal ids are the same document.
    """
    source = rows.select("id1", "id2", "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found, _, _ in blocks(b, window, gram):
                anchor, n = np.unique(found.anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n, pa.int64())], names=["anchor", "n"])

    counts = map_batches(source, anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    again = cut(counts.where("n > 1"))
    hot = again.where(F.col("n") > HOT)
    some_hot = not hot.isEmpty()
    context = rows.sparkSession.sparkContext
    known = context.broadcast((_filter_of(again), _filter_of(hot)))

    def regions(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
        bloom, hot = known.value
        for b in batches:
            id1, id2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for found, row, base in blocks(b, window, gram):
                at = np.flatnonzero(_passes(bloom, found.anchor) & (_passes(hot, found.anchor) == single))
                segment = found.segment[at]
                offset = found.start[at] - found.origin[segment] + base[segment]
                columns = [pa.array(found.anchor[at]), pa.array(found.same(at)), pa.array(id1[row[segment]]), pa.array(id2[row[segment]]), pa.array(offset, pa.int64()), pa.array(found.symbols(at), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "same", "id1", "id2", "start", "symbols"])

    fields = "anchor long, same long, id1 long, id2 long, start long, symbols binary"
    candidates = map_batches(source, lambda it: regions(it, False), fields)
    shards = candidates.repartition("anchor").sortWithinPartitions("anchor", "same")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, group = None, []

        def out(group: list) -> pa.RecordBatch:
            seen: dict[int, tuple[bytes, int]] = {}
            for same, _, _, _, symbols in group:
                known = seen.get(same)
                seen[same] = (symbols, known[1] + 1 if known else 1)
            mask = masks(seen, window)
            kept = [(i, j, s, mask[same]) for same, i, j, s, _ in group if mask[same]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*kept, strict=True) if kept else ((),) * 4)], names=["id1", "id2", "start", "mask"])

        for b in batches:
            for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != anchor:
                    if len(group) > 1:
                        yield out(group)
                    anchor, group = key, []
                group.append(tuple(row))
        if len(group) > 1:
            yield out(group)

    found = map_batches(shards, shard, "id1 long, id2 long, start long, mask long")
    if some_hot:
        common = cut(map_batches(source, lambda it: regions(it, True), fields))
        # kept, so that both sides of the join are shuffled for it and a very common region can be split
        masks_ = cut(common_masks(common, window))
        found = found.unionByName(common.select("anchor", "same", "id1", "id2", "start").join(masks_, ["anchor", "same"]).select("id1", "id2", "start", "mask"))
    return found


def common_masks(regions: DataFrame, window: int) -> DataFrame:
    """(anchor, same, mask) of the regions that have repeated windows, by counting windows over all regions."""
    different = regions.groupBy("anchor", "same").agg(F.count("*").alias("n"), F.max("symbols").alias("symbols"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size = xxhash.xxh3_64_intdigest, window * SYMBOL
        for b in batches:
            symbols = b.column(3).to_pylist()
            counts = np.array([(len(x) - size) // SYMBOL + 1 for x in symbols], np.int64)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes = np.array([digest(x[i : i + size]) for x, n in zip(symbols, counts.tolist(), strict=True) for i in range(0, n * SYMBOL, SYMBOL)], np.uint64)
            of = pa.array(np.repeat(np.arange(len(symbols)), counts))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in range(3)), pa.array(at), pa.array(hashes.view(np.int64))], names=["anchor", "same", "n", "at", "window"])

    each = map_batches(different, windows, "anchor long, same long, n long, at long, window long")
    twice = cut(each.groupBy("anchor", "window").agg(F.sum("n").alias("total")).where("total > 1").drop("total"))
    return each.join(twice, ["anchor", "window"]).groupBy("anchor", "same").agg(F.bit_or(F.expr("shiftleft(1L, cast(at as int))")).alias("mask"))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """ID1 and ID2 name a row by its key and text, so a repeated key is no trouble."""
    return df.withColumn(ID1, F.xxhash64(F.lit(1), key, text)).withColumn(ID2, F.xxhash64(F.lit(2), text, key))


def _keep(n: int, found: list[dict] | None, window: int) -> np.ndarray:
    """Which of n words no repeated window covers."""
    edges = np.zeros(n + 1, np.int64)
    for one in found or ():
        start, mask = one["start"], one["mask"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            run = mask >> low
            ones = (~run & (run + 1)).bit_length() - 1  # neighbouring windows
            edges[start + low] += 1
            edges[start + low + ones - 1 + window] -= 1
            mask &= ~(((1 << ones) - 1) << low)
    return np.cumsum(edges[:-1]) == 0


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """df's rows with FOUND, the repeated windows of each row's text."""
    rows = keyed(df, key, text)
    found = spans(rows.select(F.col(ID1).alias("id1"), F.col(ID2).alias("id2"), F.col(text).cast("string").alias("text")), window)
    # rows that are equal in key and text each get the windows of both: a window counts once
    each = found.groupBy(F.col("id1").alias(ID1), F.col("id2").alias(ID2)).agg(F.collect_set(F.struct("start", "mask")).alias(FOUND))
    return rows.join(each, [ID1, ID2], "left").drop(ID1, ID2)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row: key, n_words, n_removed, kept_sha256 (of the kept words joined by one blank).

    A word is removed if one of the windows that cover it also starts anywhere else in the corpus, the
    same text included.  Null and empty texts have no words; texts shorter than a window lose none.
    Repeated rows are documents of their own, so each is elsewhere for the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, digest = [], [], []
            for one, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(one)
                kept = list(compress(words, _keep(len(words), found, window).tolist())) if found else words
                total.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=[key, "n_words", "n_removed", "kept_sha256"])

    rows = removed(df.select(key, F.col(text).cast("string").alias(text)), key, text, window).select(key, text, FOUND)
    return map_batches(rows, run, f"{key} {df.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """df with the repeated passages cut out of its texts; all rows and columns stay.

    A text that loses words becomes its kept words joined by one blank, which may be empty; any other
    stays as it is.  Columns that are called like our own (ID1, ID2, FOUND, CUT) stay too.
    """

    df, back = aside(df, (ID1, ID2, FOUND, CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for one, found in zip(b.column(CUT).to_pylist(), b.column(FOUND).to_pylist(), strict=True):
                if found:
                    words = words_of(one)
                    one = b" ".join(compress(words, _keep(len(words), found, window).tolist())).decode()
                texts.append(one)
            names = [n for n in b.schema.names if n not in (CUT, FOUND)]
            at = [pa.array(texts, pa.string()) if n == text else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(at, names=names)

    rows = removed(df, key, text, window).withColumn(CUT, F.col(text).cast("string"))
    schema = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in df.schema)
    return back(map_batches(rows.select(*(F.col(f"`{c}`") for c in df.columns), CUT, FOUND), run, schema))
