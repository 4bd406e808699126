"""Byte-level BPE encoding and decoding with a rank queue of hierarchical bitmaps.

Many pre-tokens lie end to end in one linked list, with walls between them. Every merge rank has a bucket with the places of
nodes whose pair with the next node has that rank. A bitmap marks the ranks of a word of `1 << WORD` ranks that have places,
and an upper bitmap the words that have any; find-first-set in both gives the lowest rank. Its bucket merges at once, the
leftmost place of each pre-token; a place whose pair is no longer the one it was queued for is stale and skipped. Places of
a word of ranks are only dealt out to their buckets when the queue comes to that word.

A pre-token of over `LONG` bytes has a queue of its own, in which buckets are heaps: n bytes take O(n log n) steps.

`TextEncoder` cuts a run of texts into pieces at single spaces after something else than white space, where the pattern
always begins a new match, encodes each distinct pre-token of the run once, and copies ids together from there.

Cases: null or empty text has no ids; any text is encoded whole, a very long one by runs of its pieces; ties of rank go left
to right, as the usual library does; repeated rows are encoded alike, as ids are independent of rows and partitions; an empty
table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: log2 of the ranks in a word of the lower bitmap; the upper one is a single integer with a bit for each word.
WORD = 8
#: Bytes of a pre-token from which on it has a queue of its own.
LONG = 96
#: Bytes of text that are encoded together.
RUN_BYTES = 12 << 20
_WALL = 0x7FFFFFFF
_LETTER = np.zeros(256, np.int32)
_LETTER[[*range(65, 91), *range(97, 123)]] = 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Merge ranks of pairs of ids in an open hash table, the id that each rank makes, and the ids of single bytes. `whole`:
    byte strings that are one id whatever their merges say."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray, byte_ids: np.ndarray, whole: dict[bytes, int]):
        """`pairs`: rows of (first id, second id, rank)."""
        self.made, self.byte_ids, self.whole = made, byte_ids, whole
        bits = max(10, int(4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        key, rank = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2]
        slot = self._slots(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == -1)
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.ranks[taken] = key[free[first]], rank[free[first]]
            left = np.ones(len(key), bool)
            left[free[first]] = False
            key, rank, slot = key[left], rank[left], (slot[left] + 1) & self.mask

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where there is none."""
        key = first << 32 | second
        slot = self._slots(key)
        found = self.keys[slot]
        out = self.ranks[slot]
        wrong = found != key
        if wrong.any():
            out[wrong] = -1
            at = np.flatnonzero(wrong & (found != -1))
            while len(at):
                slot[at] = (slot[at] + 1) & self.mask
                found = self.keys[slot[at]]
                hit = found == key[at]
                out[at[hit]] = self.ranks[slot[at[hit]]]
                at = at[~hit & (found != -1)]
        return out


@lru_cache(4)
def merges_of_ranks(path: str, vocabulary: int | None = None) -> Merges:
    """Of a rank file: a pair's rank is that of its bytes. `vocabulary`: only the first so many ranks."""
    ranks = {k: v for k, v in read_ranks(path).items() if vocabulary is None or v < vocabulary}
    pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return Merges(np.array(pairs, np.int64).reshape(-1, 3), np.arange(1 + max(ranks.values())), np.array([ranks[bytes([b])] for b in range(256)], np.int64), ranks)


@lru_cache(2)
def merges_of_tokenizer(path: str) -> Merges:
    """Of a byte-level tokenizer's JSON file: a pair's rank is its place in the list of merges; only merges make words."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocabulary = model["vocab"]
    split = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = np.array([(vocabulary[a], vocabulary[b], k) for k, (a, b) in enumerate(split)], np.int64).reshape(-1, 3)
    return Merges(pairs, np.array([vocabulary[a + b] for a, b in split], np.int64), np.array([vocabulary[letters[b]] for b in range(256)], np.int64), {})


def lowest(bits: int) -> int:
    """Place of the lowest set bit."""
    return (bits & -bits).bit_length() - 1


def merge_long(merges: Merges, word: bytes) -> list[int]:
    """Ids of one pre-token of any length."""
    ids = merges.byte_ids[np.frombuffer(word, np.uint8)]
    pair = [*merges.rank(ids[:-1], ids[1:]).tolist(), -1]
    ids, made, keys, ranks, mask = ids.tolist(), merges.made, merges.keys, merges.ranks, merges.mask
    shift = int(merges.shift)

    def rank_of(a: int, b: int) -> int:
        key = a << 32 | b
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> shift
        while (found := keys[slot]) != key:
            if found == -1:
                return -1
            slot = slot + 1 & mask
        return int(ranks[slot])

    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    buckets: dict[int, list[int]] = {}
    low, top = {}, 0
    seen: dict[tuple[int, int], int] = {}

    def push(rank: int, i: int) -> None:
        nonlocal top
        if rank in buckets:
            heappush(buckets[rank], i)
        else:
            buckets[rank] = [i]
            w = rank >> WORD
            low[w] = low.get(w, 0) | 1 << (rank & (1 << WORD) - 1)
            top |= 1 << w

    def known(a: int, b: int) -> int:
        if (a, b) not in seen:
            seen[a, b] = rank_of(a, b)
        return seen[a, b]

    for i, rank in enumerate(pair):
        if rank >= 0:
            push(rank, i)
    while top:
        w = lowest(top)
        k = lowest(low[w])
        rank = w << WORD | k
        i = heappop(buckets[rank])
        if not buckets[rank]:
            del buckets[rank]
            low[w] &= low[w] - 1
            if not low[w]:
                top &= top - 1
        if pair[i] != rank:  # stale
            continue
        j = after[i]
        ids[i], ids[j], pair[j] = int(made[rank]), -1, -1
        after[i] = e = after[j]
        pair[i] = -1
        if e < n:
            before[e] = i
            pair[i] = known(ids[i], ids[e])
            if pair[i] >= 0:
                push(pair[i], i)
        h = before[i]
        if h >= 0:
            pair[h] = known(ids[h], ids[i])
            if pair[h] >= 0:
                push(pair[h], h)
    return [x for x in ids if x >= 0]


def _by_rank(places: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each rank and its places in order."""
    order = np.lexsort((places, ranks))
    places, ranks = places[order], ranks[order]
    cuts = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(ranks[lo]), places[lo:hi]


class RankQueue:
    """Merges many pre-tokens, laid end to end, in one queue."""

    def __init__(self, merges: Merges, data: np.ndarray, starts: np.ndarray):
        """Pre-token k is data[starts[k] : starts[k + 1]]; none is empty."""
        n = self.n = len(data)
        self.merges, self.starts = merges, starts
        self.ids = np.append(merges.byte_ids[data], _WALL)  # place n is a wall before and after every pre-token
        self.word = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        kind = np.int32 if n < 1 << 31 else np.int64
        self.after, self.before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
        self.after[starts[1:] - 1] = n
        self.before[starts[:-1]] = n
        self.alive = np.ones(n, bool)
        self.pair = np.append(merges.rank(self.ids[:n], self.ids[self.after[:n]]), np.int32(-1))
        self.waiting: list[list[np.ndarray]] = [[] for _ in range((len(merges.made) >> WORD) + 1)]  # places by word of ranks
        self.top = 0
        queued = np.flatnonzero(self.pair >= 0)
        self._push(queued, self.pair[queued])

    def _push(self, places: np.ndarray, ranks: np.ndarray) -> None:
        words = ranks >> WORD
        order = np.argsort(words, kind="stable")
        words, places = words[order], places[order]
        cuts = np.flatnonzero(np.diff(words, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            w = int(words[lo])
            self.waiting[w].append(places[lo:hi])
            self.top |= 1 << w

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, and where each one's begin (one more than pre-tokens)."""
        later: list[tuple[np.ndarray, np.ndarray]] = []  # to be pushed to words of ranks beyond the open one
        while self.top or later:
            if later:
                self._push(np.concatenate([p for p, _ in later]), np.concatenate([r for _, r in later]))
                later = []
            w = lowest(self.top)
            places = np.concatenate(self.waiting[w])
            self.waiting[w], self.top = [], self.top & (self.top - 1)
            ranks = self.pair[places]
            fresh = ranks >> WORD == w
            places, ranks = places[fresh], ranks[fresh]
            if not len(places):
                continue
            buckets = {r: [p] for r, p in _by_rank(places, ranks)}
            low = sum(1 << (r & (1 << WORD) - 1) for r in buckets)
            while low:
                rank = w << WORD | lowest(low)
                found = buckets.pop(rank)
                at = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
                at = at[self.pair[at] == rank]  # the others are stale
                if len(at) > 1:
                    word = self.word[at]
                    again = word[1:] == word[:-1]
                    if again.any():  # the leftmost of each pre-token; the rest waits, as a lower rank may come up before it
                        again = np.append(False, again)
                        buckets[rank], at = [at[again]], at[~again]
                if rank not in buckets:
                    low &= low - 1
                if not len(at):
                    continue
                places, ranks = self._merge(at, rank)
                if not len(places):
                    continue
                if (ranks.min() >> WORD) <= w:
                    words = ranks >> WORD
                    for r, p in _by_rank(places[words == w], ranks[words == w]):
                        buckets.setdefault(r, []).append(p)
                        low |= 1 << (r & (1 << WORD) - 1)
                    if (words < w).any():  # go down first; what is open waits
                        self._push(places[words < w], ranks[words < w])
                        if buckets:
                            self.waiting[w] += [p for found in buckets.values() for p in found]
                            self.top |= 1 << w
                        low = 0
                    places, ranks = places[words > w], ranks[words > w]
                if len(places):
                    later.append((places, ranks))
        return self.ids[:-1][self.alive], np.concatenate([[0], np.cumsum(self.alive)])[self.starts]

    def _merge(self, at: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges each place with its next node; gives the places with a new pair, and the pairs' ranks."""
        ids, after, before, pair = self.ids, self.after, self.before, self.pair
        gone = after[at]
        then, prior = after[gone], before[at]
        ids[at] = self.merges.made[rank]
        after[at], before[then] = then, at
        pair[gone], self.alive[gone] = -1, False
        changed = np.concatenate([prior, at])
        ranks = self.merges.rank(ids[changed], np.concatenate([ids[at], ids[then]]))
        pair[changed] = ranks
        new = ranks >= 0
        return changed[new], ranks[new]


def merge_words(merges: Merges, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (unsigned 32 bits) of distinct, not empty pre-tokens, and where each one's begin."""
    data, starts = common.binary_parts(words)
    length = np.diff(starts)
    counts = np.zeros(len(length), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pre-tokens, their ids, where these begin
    todo = length <= LONG
    if merges.whole:
        get = merges.whole.get
        one = np.array([get(x, -1) for x in words.to_pylist()], np.int64)
        found = np.flatnonzero(one >= 0)
        todo[found] = False
        length = np.where(one >= 0, 0, length)
        parts.append((found, one[found], np.arange(len(found) + 1)))
    short = np.flatnonzero(todo)
    if len(short):
        part, begins = common.binary_parts(words.take(pa.array(short)))
        parts.append((short, *RankQueue(merges, part[begins[0] : begins[-1]], begins - begins[0]).run()))
    for k in np.flatnonzero(length > LONG).tolist():
        ids = merge_long(merges, words[k].as_py())
        parts.append((np.array([k]), np.array(ids, np.int64), np.array([0, len(ids)])))
    for which, _, begins in parts:
        counts[which] = np.diff(begins)
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(at[-1]), np.uint32)
    for which, ids, begins in parts:
        out[np.repeat(at[which] - begins[:-1], np.diff(begins)) + np.arange(len(ids))] = ids
    return out, at


def _white_before(data: np.ndarray, at: np.ndarray, lo: int) -> np.ndarray:
    """Whether the character that ends before each place is white space (or, for bytes 0x1C to 0x1F, might count as such)."""
    a = data[at - 1]
    out = (a == 32) | ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 31))
    long = np.flatnonzero((a >= 0x80) & (a < 0xC0))  # the end of a longer character
    if len(long):
        a, b, c = a[long], data[np.maximum(at[long] - 2, lo)], data[np.maximum(at[long] - 3, lo)]
        two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
        spaces = (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F)
        out[long] = two | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE2) & spaces | (c == 0xE3) & (b == 0x80) & (a == 0x80)
    return out


def _cuts(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places of single spaces after something else than white space, within data[lo:hi] but not at its start."""
    at = lo + 1 + np.flatnonzero(data[lo + 1 : hi] == 32)
    return at[~_white_before(data, at, lo)]


def _runs(data: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about `limit` that end with texts or, within a longer text, at cuts."""
    lo, total = int(starts[0]), int(starts[-1])
    while lo < total:
        hi = min(lo + limit, total)
        if hi < total:
            whole = int(starts[np.searchsorted(starts, hi, "right") - 1])
            if whole > lo:
                hi = whole
            else:
                end = int(starts[np.searchsorted(starts, lo, "right")])
                found = _cuts(data, lo, hi)
                hi = int(found[-1]) if len(found) else end
        yield lo, hi
        lo = hi


@dataclass
class TextEncoder:
    """Ids of whole texts by merges and the pattern that cuts texts into pre-tokens."""

    merges: Merges
    pattern: str

    def __post_init__(self):
        import regex

        self.find = regex.compile(self.pattern).findall

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32 bits) of all texts, and where each one's begin (one more than texts)."""
        data, starts = common.text_bytes(column)
        out, before, done = [], np.zeros(len(starts), np.int64), 0
        for lo, hi in _runs(data, starts, RUN_BYTES):
            cuts = np.sort(np.concatenate([_cuts(data, lo, hi), starts[(starts > lo) & (starts < hi)], [lo]]), kind="stable")
            cuts = cuts[np.diff(cuts, prepend=-1) > 0]
            ids, begins = self._pieces(data[lo:hi], np.append(cuts, hi) - lo)
            here = (starts >= lo) & (starts < hi)
            before[here] = done + begins[np.searchsorted(cuts, starts[here])]
            out.append(ids)
            done += len(ids)
        before[starts >= starts[-1]] = done
        return np.concatenate(out) if out else np.zeros(0, np.uint32), before

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pieces, and where each one's begin."""
        known = common.binary_array(data, starts).dictionary_encode()
        pieces = known.dictionary
        part, begins = common.binary_parts(pieces)
        # a space and letters of ASCII are one match; a piece that begins with its space and ends with something else can be
        # matched together with the ones after it; the others are matched alone
        spaced = part[begins[:-1]] == 32
        letters = np.add.reduceat(_LETTER[part], begins[:-1]) if len(pieces) else np.zeros(0, np.int64)
        kind = np.where(spaced & (letters > 0) & (letters == np.diff(begins) - 1), 0, 1 + (~spaced | _white_before(part, begins[1:], int(begins[0]))))
        order = np.argsort(kind, kind="stable")
        plain, together = np.searchsorted(kind[order], [1, 2]).tolist()
        pieces = pieces.take(pa.array(order))
        part, begins = common.binary_parts(pieces)
        whole = part[begins[0] : begins[-1]].tobytes()
        begins = begins - begins[0]
        first = int(begins[plain])
        matches = self.find(whole[first : begins[together]].decode())
        for lo, hi in zip(begins[together:-1].tolist(), begins[together + 1 :].tolist(), strict=True):
            matches += self.find(whole[lo:hi].decode())
        ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        if len(whole) - first != (int(ends[-1]) if len(ends) else 0):  # characters to bytes
            leads = np.flatnonzero((np.frombuffer(whole, np.uint8)[first:] & 0xC0) != 0x80)
            ends = np.append(leads, len(whole) - first)[ends]
        spans = np.concatenate([begins[: plain + 1], first + ends])
        tokens = common.binary_array(np.frombuffer(whole, np.uint8), spans).dictionary_encode()
        ids, at = merge_words(self.merges, tokens.dictionary)
        # ids of a pre-token, of a piece, of the run: each time copied together as blobs
        joined, offsets = common.binary_parts(common.binary_array(ids.view(np.uint8), 4 * at).take(tokens.indices))
        of_piece = np.empty(len(order), np.int64)
        of_piece[order] = np.arange(len(order))
        pieces = common.binary_array(joined, offsets[np.searchsorted(spans, begins)])
        joined, offsets = common.binary_parts(pieces.take(pa.array(of_piece[known.indices.to_numpy()])))
        return joined[offsets[0] : offsets[-1]].view(np.uint32), (offsets - offsets[0]) // 4


class Decoder:
    """Bytes of ids: the vocabulary's bytes copied together."""

    def __init__(self, ranks: dict[bytes, int]):
        words = [b""] * (1 + max(ranks.values()))
        for k, v in ranks.items():
            words[v] = k
        self.words = pa.array(words, pa.large_binary())

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where each id's begin."""
        data, starts = common.binary_parts(self.words.take(pa.array(ids)))
        return data[starts[0] : starts[-1]], starts - starts[0]


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, schema: str, columns) -> DataFrame:
    """doc_id and the arrays that columns(ids, their starts by text, decoded bytes, their starts by text) gives."""
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches):
        merges = merges_of_ranks(ranks_path)
        encoder, decode = TextEncoder(merges, pattern), Decoder(merges.whole)
        for b in common.joined(batches, RUN_BYTES):
            ids, starts = encoder.texts(b.column("text"))
            back, at = decode(ids)
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                own = starts[lo : lo + part.num_rows + 1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns(ids, own, back, at[own])], names)

    return common.small_batches(docs.select("doc_id", "text")).mapInArrow(common.tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (bytes)."""

    def columns(ids, starts, back, at):
        return common.binary_array(ids.view(np.uint8), 4 * starts).cast(pa.binary()), common.binary_array(back, at).cast(pa.binary())

    return _encoded(docs, ranks_path, pattern, "ids binary, decoded binary", columns)


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests are taken where the ids are, which need not leave the worker."""

    def digests(data: np.ndarray, starts: np.ndarray) -> pa.Array:
        view = memoryview(np.ascontiguousarray(data)).cast("B")
        return pa.array([hashlib.sha256(view[lo:hi]).hexdigest() for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.string())

    def columns(ids, starts, back, at):
        return pa.array(np.diff(starts)), digests(ids.view(np.uint8), 4 * starts), digests(back, at)

    return _encoded(docs, ranks_path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
