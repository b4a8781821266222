"""Byte-pair encoding and decoding as streaming transducers.

The encoder reads bytes left to right.  For every prefix of its input it knows the last
token of that prefix's encoding: the longest vocabulary token ending there which fits the last
token of the prefix before it; an automaton over the vocabulary names those that end there.  Two neighbouring tokens fit if no merge rule ever joins
across their border, which the two tokens' own derivations decide.  A token is emitted as
soon as no future byte can change it.  How far the future can reach back is a property of
the merge list alone, its *sufficient lookahead*, and is computed once from the rules
(`Merges.lookahead`).  So the memory held is bounded by that constant plus the longest token,
whatever the length of a word.

The decoder is a state machine from ids to text that carries the bytes of an unfinished
character from one id to the next.

Texts are cut at the places where a run of white space starts, which no pretoken ever
crosses, and equal pieces of a group of texts are encoded once; so are equal pretokens, as long as a
memo of bounded size knows them.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: white space as the pre-tokenizer's expression sees it.
SPACE = " \t\n\r\x0b\x0c\x85\xa0                　"
#: Fixed value: the byte-level pre-tokenizer's expression.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of tokens and pretokens that are remembered, and bytes that are read at once.
PAIRS, PRETOKENS = 300_000, 300_000
LONG = 512
#: Characters that are encoded together.
WINDOW = 1 << 22


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list: tokens as bytes, the rule that makes each, and what follows from them."""

    def __init__(self, tokens: dict[bytes, int], rules: Iterable[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.special = dict(special or {})
        self.bytes_of = {i: t for t, i in tokens.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rule: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for order, (left, right) in enumerate(rules):
            pair = tokens[left], tokens[right]
            self.rule.setdefault(pair, order)
            self.made.setdefault(tokens[left + right], (order, *pair))
        self.ends: dict[int, tuple] = {}
        self.starts: dict[int, tuple] = {}
        self.fits_memo: dict[int, bool] = {}
        self.token = {t: i for t, i in tokens.items() if self._sound(i)}
        self.longest = max(map(len, self.token))
        self.tails = ahocorasick.Automaton()
        for t, i in self.token.items():
            self.tails.add_word(t.decode("latin-1"), (len(t), i))
        self.tails.make_automaton()
        self.lookahead = self._lookahead(tokens)

    def _spine(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """(token, order at which it is used up) along one edge of a token's derivation."""
        out, until = [(token, float("inf"))], token
        while until in self.made:
            order, *parts = self.made[until]
            until = parts[side]
            out.append((until, order))
        return tuple(out)

    def _sound(self, token: int) -> bool:
        """Whether a token's bytes encode to that token, given that shorter tokens were asked before."""
        if token not in self.made:
            return True
        order, left, right = self.made[token]
        return not any(rule < order for rule in self._across(left, right)) and self._sound(left) and self._sound(right)

    def _across(self, left: int, right: int) -> Iterator[int]:
        """Orders of the rules that would join across the border of two tokens."""
        if left not in self.ends:
            self.ends[left] = self._spine(left, 1)
        if right not in self.starts:
            self.starts[right] = self._spine(right, 0)
        rule = self.rule
        for a, a_until in self.ends[left]:
            for b, b_until in self.starts[right]:
                order = rule.get((a, b))
                # among equal rules the leftmost place comes first
                if order is not None and order < a_until and order <= b_until:
                    yield order

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) >= PAIRS:
                self.fits_memo.clear()
            known = self.fits_memo[key] = next(self._across(left, right), None) is None
        return known

    def _lookahead(self, tokens: dict[bytes, int]) -> int:
        """How many bytes behind the end of what is read a token can still change.

        reach[t]: how far a difference in the future can have come to the left when t stands
        directly right of it.  Rules apply in their order, so one pass over them follows every
        chain of influence: a rule whose right part is t moves the border by its left part.
        """
        size = {i: len(t) for t, i in tokens.items()}
        reach = dict(size)
        for (left, right), _ in sorted(self.rule.items(), key=lambda x: x[1]):
            product = tokens.get(self.bytes_of[left] + self.bytes_of[right])
            moved = size[left] + reach[right]
            whole = max(moved, reach[left], reach.get(product, 0))
            reach[left] = max(reach[left], moved)
            if product is not None:
                reach[product] = whole
        return max(reach.values()) + max(size.values())


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level `tokenizer.json`."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
    return {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)} | special


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """The merge list of a byte-level `tokenizer.json`."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    raw = lambda t: bytes(alphabet[c] for c in t)
    tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
    rules = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    return Merges(tokens, rules, {t["content"]: t["id"] for t in spec.get("added_tokens", ()) if t["content"]})


class Transducer:
    """Bytes in, ids out, over one pretoken of any length: `push` gives what is stable, `close` the rest."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held = b""  # bytes after the last emitted token
        self.last: list[int] = []  # last[i]: last token of the encoding of held[: i + 1]

    def push(self, data: bytes) -> list[int]:
        """Ids that no later byte can change."""
        out = []
        for k in range(0, len(data), LONG):
            out += self._step(data[k : k + LONG])
        return out

    def _step(self, data: bytes) -> list[int]:
        m, last, known, fits = self.merges, self.last, self.merges.fits_memo.get, self.merges.fits
        done = len(self.held)
        self.held += data
        for end, (size, t) in m.tails.iter(self.held.decode("latin-1"), max(0, done + 1 - m.longest)):
            if end < done:
                continue  # a longer token ends here, or the place was read before
            if size <= end:
                before = last[end - size]
                ok = known(before << 32 | t)
                if not (fits(before, t) if ok is None else ok):
                    continue
            last.append(t)
            done += 1
        if len(self.held) > 2 * m.lookahead:
            return self._emit(len(self.held) - m.lookahead)
        return []

    def _emit(self, stable: int) -> list[int]:
        size = self.merges.bytes_of
        out, end, cut = [], len(self.held), 0
        while end:
            t = self.last[end - 1]
            if end <= stable:
                cut = cut or end
                out.append(t)
            end -= len(size[t])
        self.held, self.last = self.held[cut:], self.last[cut:]
        return out[::-1]

    def close(self) -> list[int]:
        out = self._emit(len(self.held))
        self.held, self.last = b"", []
        return out


Ragged = tuple[np.ndarray, np.ndarray]  # all items one after the other, and the size of each


def ragged(items: list[list[int]]) -> Ragged:
    return np.fromiter(chain.from_iterable(items), np.int64), np.fromiter(map(len, items), np.int64, len(items))


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> Ragged:
    """The items named by `codes`, one after the other."""
    starts, got = np.cumsum(sizes) - sizes, sizes[codes]
    at = np.repeat(starts[codes] - (np.cumsum(got) - got), got)
    at += np.arange(len(at))
    return flat[at], got


def summed(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of runs of `values`; groups has the length of each run, some zero."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(groups)])])


def joined(items: pa.Array, between: str | bytes) -> str | bytes:
    kind = pa.binary() if isinstance(between, bytes) else pa.string()
    whole = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items.cast(kind))
    return pc.binary_join(whole, pa.scalar(between, kind))[0].as_py()


class Streaming:
    """Pieces of text to ids by the merge list: every pretoken goes through a `Transducer`."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pretoken = regex.compile(PRETOKEN)
        self.special = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.known: dict[str, list[int]] = {}

    def words(self, texts: list[str]) -> Ragged:
        """Ids of each pretoken."""
        coded = pa.array(texts, pa.large_string()).dictionary_encode()
        return gathered(*ragged([self._ids(w) for w in coded.dictionary.to_pylist()]), coded.indices.to_numpy())

    def _ids(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            data, one = word.encode(), Transducer(self.merges)
            whole = self.merges.token.get(data)  # such a token ends the word and fits its start, whatever lies between
            ids = one.push(data) + one.close() if whole is None else [whole]
            if len(word) <= LONG:
                if len(self.known) >= PRETOKENS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def spaced(self, pieces: pa.Array) -> Ragged:
        """Each piece has one blank before it and none in it, so a pretoken with a blank starts the next."""
        text = " " + joined(pieces, " ")
        if self.special and self.special.search(text):
            return self.other([" " + p for p in pieces.to_pylist()])
        pretokens = self.pretoken.findall(text)
        starts = np.array([i for i, w in enumerate(pretokens) if w[0] == " "])
        flat, sizes = self.words(pretokens)
        return flat, np.add.reduceat(sizes, starts)

    def other(self, pieces: list[str] | pa.Array) -> Ragged:
        """Any texts; the strings of special tokens are one id each."""
        pieces = pieces if isinstance(pieces, list) else pieces.to_pylist()
        found: list[str] = []
        counts, special = [], []
        for p in pieces:
            at, before = 0, len(found)
            for m in self.special.finditer(p) if self.special else ():
                found += self.pretoken.findall(p[at : m.start()])
                special.append(len(found))
                found.append("")
                at = m.end()
                special[-1] = (special[-1], self.merges.special[m[0]])
            found += self.pretoken.findall(p[at:])
            counts.append(len(found) - before)
        flat, sizes = self.words(found)
        if special:
            ends = np.cumsum(sizes)
            flat = np.insert(flat, [ends[i] for i, _ in special], [t for _, t in special])
            sizes[[i for i, _ in special]] = 1
        return flat, summed(sizes, np.array(counts, np.int64))


class Library:
    """Pieces of text to ids by the tokenizers library.

    Pieces without special tokens take the tiktoken library over the same vocabulary, whose ids
    must be in the order of the merge rules; else all pieces take tokenizers.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        made = [ranks.get(bytes(alphabet[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))) for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = None
        if plain and None not in made and made == sorted(made) and len(set(ranks.values())) == len(ranks):
            import tiktoken

            self.fast = tiktoken.Encoding("pieces", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
            self.starts = np.zeros(max(ranks.values()) + 1, bool)
            self.starts[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def other(self, pieces: list[str] | pa.Array) -> Ragged:
        pieces = pieces if isinstance(pieces, list) else pieces.to_pylist()
        return ragged([x.ids for x in self.full.encode_batch_fast(pieces, add_special_tokens=False)])

    def spaced(self, pieces: pa.Array) -> Ragged:
        """Each piece has one blank before it and none in it, so a token with a blank starts the next."""
        text = " " + joined(pieces, " ")
        if not self.fast or any(s in text for s in self.special):
            return self.other([" " + p for p in pieces.to_pylist()])
        ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return ids, np.diff(np.flatnonzero(self.starts[ids]), append=len(ids))


class TextEncoder:
    """Whole texts to ids.

    A piece is a run of white space with the run of other characters after it: the pre-tokenizer
    has a border at each start of such a run, so pieces encode independently, and each different
    piece of a group of about WINDOW characters is encoded once.
    """

    _unit = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
    _odd = re.compile(f"[{SPACE}] | [{SPACE}]")
    _odd_ascii = tuple(x for c in SPACE if c < "\x80" for x in (" " + c, c + " "))

    def __init__(self, pieces: Streaming | Library):
        self.pieces = pieces

    def _units(self, text: str) -> tuple[list[str], str | None]:
        """(the start or all pieces of a text, the rest: pieces with exactly one blank between)"""
        odd = any(x in text for x in self._odd_ascii) if text.isascii() else self._odd.search(text)
        if odd or text[0] == " " or text[-1] == " ":
            return self._unit.findall(text), None
        first, blank, rest = text.partition(" ")
        return [first], rest if blank else None

    def windows(self, text: str) -> Iterator[str]:
        """The text in parts of about WINDOW characters, each starting where a pretoken must start."""
        at = 0
        while len(text) - at > 2 * WINDOW:
            cut = text.rfind(" ", at + 1, at + WINDOW)
            while cut > at and text[cut - 1] in SPACE:
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                break  # one run without a blank: it stays whole
            yield text[at:cut]
            at = cut
        yield text[at:]

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text as uint32; null is as empty."""
        group: list[tuple[int, list[str], str | None]] = []
        chars = n = 0
        for text in texts:
            for part in self.windows(text) if text else ():
                group.append((n, *self._units(part)))
                chars += len(part)
            n += 1
            if chars >= WINDOW or n >= 50_000:
                yield from self._encoded(group, n)
                group, chars, n = [], 0, 0
        yield from self._encoded(group, n)

    def _encoded(self, group: list, n: int) -> list[np.ndarray]:
        head, head_ends = self._of([p for _, first, _ in group for p in first], [len(first) for _, first, _ in group], self.pieces.other)
        split = pc.split_pattern(pa.array([rest for _, _, rest in group], pa.large_string()), " ")
        rest, rest_ends = self._of(split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(), self.pieces.spaced)
        parts: list[list[np.ndarray]] = [[] for _ in range(n)]
        i = j = 0
        for (k, _, _), i2, j2 in zip(group, head_ends, rest_ends, strict=True):
            parts[k] += [head[i:i2], rest[j:j2]]
            i, j = i2, j2
        return [np.concatenate(x) if x else np.empty(0, np.uint32) for x in parts]

    @staticmethod
    def _of(pieces: list[str] | pa.Array, counts: list[int] | np.ndarray, encode: Callable[[pa.Array], Ragged]) -> tuple[np.ndarray, list[int]]:
        """Ids of all pieces, and where the ids of each run of `counts` pieces end."""
        if not len(pieces):
            return np.empty(0, np.uint32), [0] * len(counts)
        coded = pa.array(pieces, pa.large_string()).dictionary_encode() if isinstance(pieces, list) else pieces.dictionary_encode()
        flat, sizes = encode(coded.dictionary)
        flat, sizes = gathered(flat.astype(np.uint32, copy=False), sizes, coded.indices.to_numpy())
        return flat, np.cumsum(summed(sizes, np.asarray(counts, np.int64))).tolist()


class Decoder:
    """Ids in, text out; the bytes of an unfinished character wait for the next id."""

    def __init__(self, merges: Merges):
        self.table = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def close(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def stream_encoder(path: str) -> TextEncoder:
    """This module's encoder, one for each worker process and vocabulary."""
    return TextEncoder(Streaming(load_merges(path)))


@lru_cache(maxsize=4)
def library_encoder(path: str) -> TextEncoder:
    """The library's encoder, over the same pieces."""
    return TextEncoder(Library(path))
