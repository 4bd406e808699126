"""Language identification by language-bitmask n-gram filters: a bit-sliced Bloom filter gives, for every n-gram of a text,
the set of all languages that contain it; per-language counts of set bits, corrected for false positives, decide.

Slots of the filter are masks, a bit for each language, in as many 64-bit words as the languages need; an n-gram's languages
are the AND of its slots. An n-gram belongs to a language if enough of the language's training pieces contain it. The filter
is fitted on a bounded sample of pieces of at most `piece` characters: `per_language` of each language, and `most` in all,
chosen by a hash among all pieces of all texts, so that long texts count from end to end. Prediction reads every whole text.

Cases: `und` with score 0 if a text is null, empty or has no letter, or nothing was learned; texts with letters but no known
n-gram get the most frequent language, score 0; ties go to the first language by name; repeated rows are predicted alike; very
long texts are read whole; an empty table gives no rows; extra columns are not looked at, or carried along as a struct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
WIDTHS = (3, 5)
_FOLDED = np.full(256, 32, np.uint64)
_FOLDED[128:] = np.arange(128, 256)
_FOLDED[97:123] = _FOLDED[65:91] = np.arange(97, 123)


def ngrams(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` bytes with letters only between the first and the last byte, and the row of each.
    Other bytes than letters count as a space; a text has one before and one after it."""
    lo, hi = int(starts[0]), int(starts[-1])
    rows = len(starts) - 1
    folded = np.full(hi - lo + 2 * rows, 32, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(starts))
    folded[np.arange(hi - lo) + 2 * row + 1] = _FOLDED[data[lo:hi]]
    n = len(folded) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, inner = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(width):
        code = code << np.uint64(8) | folded[k : n + k]
        if 0 < k < width - 1:
            inner &= folded[k : n + k] != 32
    at = np.flatnonzero(inner)
    of = np.searchsorted(starts - lo + 2 * np.arange(rows + 1), at, "right") - 1
    return common.mix(code[at] + np.uint64(width)), of


@dataclass
class Filters:
    """`masks`: slots x words."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray  # of each language
    hashes: int = 2

    def _slots(self, grams: np.ndarray) -> list[np.ndarray]:
        size = np.uint64(len(self.masks) - 1)
        return [(grams >> np.uint64(21 * k) & size).astype(np.int64) for k in range(self.hashes)]

    def add(self, grams: np.ndarray, language: int) -> None:
        for slot in self._slots(grams):
            self.masks[slot, language >> 6] |= np.uint64(1 << (language & 63))

    def has(self, masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[:, language >> 6] >> np.uint64(language & 63) & np.uint64(1)).astype(bool)

    def close(self) -> None:
        self.false_rate = np.array([float(self.has(self.masks, k).mean()) for k in range(len(self.languages))]) ** self.hashes

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """The masks of the languages that contain each n-gram."""
        first, *rest = self._slots(grams)
        out = self.masks[first]
        for slot in rest:
            out &= self.masks[slot]
        return out

    def shares(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """rows x languages: the corrected share of a text's n-grams that a language contains."""
        rows = len(starts) - 1
        hits, total = np.zeros((rows, len(self.languages))), np.zeros(rows)
        for width in WIDTHS:
            grams, of = ngrams(data, starts, width)
            masks = self.containing(grams)
            total += np.bincount(of, minlength=rows)
            for k in range(len(self.languages)):
                hits[:, k] += np.bincount(of[self.has(masks, k)], minlength=rows)
        expected = total[:, None] * self.false_rate
        return np.clip((hits - expected) / np.maximum(total[:, None] - expected, 1e-9), 0, 1) * (total > 0)[:, None]


def fit(texts: list[str] | pa.ChunkedArray, languages: list[str], least_share: float = 0.02, slot_bits: int = 19) -> Filters:
    """`least_share`: of a language's texts that must contain an n-gram (two texts at least, if there are two)."""
    every = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    of_language = np.array(languages, object)
    names = sorted(set(languages))
    out = Filters(names, np.zeros((1 << slot_bits, max(1, -(-len(names) // 64))), np.uint64), np.zeros(len(names)))
    for k, name in enumerate(names):
        own = every.filter(pa.array(of_language == name, pa.bool_()))
        data, starts = common.text_bytes(own)
        least = max(min(2, len(own)), least_share * len(own))
        for width in WIDTHS:
            found = [np.zeros(0, np.uint64)]
            for lo, hi in common.chunks(starts):
                grams, of = ngrams(data, starts[lo : hi + 1], width)
                order = np.lexsort((grams, of))
                grams, of = grams[order], of[order]
                found.append(grams[np.concatenate([[True], (np.diff(of) != 0) | (grams[1:] != grams[:-1])])] if len(grams) else grams)
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            out.add(grams[n >= least], k)
    out.close()
    return out


def training_sample(docs: DataFrame, train: Column, per_language: int = 2000, most: int = 40_000, piece: int = 2000) -> tuple[list[str] | pa.ChunkedArray, list[str], str | None]:
    """Pieces of texts and their languages, and the language with most texts: about `per_language` pieces of each language,
    fewer where they would be more than `most` in all."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    pieces = F.ceil(F.char_length("text") / F.lit(piece)).cast("int")
    counts = [(r["lang"], r["n"], r["pieces"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(pieces).alias("pieces")).orderBy(F.desc("n"), "lang").collect()]
    if not counts:
        return [], [], None
    wanted = min(per_language, max(1, most // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, _, n in counts for x in (lang, min(1.0, wanted / max(1, n)))])[F.col("lang")]
    kept = F.filter(F.sequence(F.lit(0), pieces - 1), lambda k: F.pmod(F.xxhash64("doc_id", "text", k), F.lit(1_000_000)) < 1_000_000 * share)
    cut = F.explode(F.transform(kept, lambda k: F.substring(F.col("text"), k * piece + 1, F.lit(piece))))
    found = rows.where(F.col("text") != "").select("lang", cut.alias("text")).toArrow()
    return found.column("text"), found.column("lang").to_pylist(), counts[0][0]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, filters: Filters, usual: str, whole: bool = False) -> DataFrame:
    """doc_id (or, with `whole`, the struct `row` of all columns), lang_pred, score of every row, and whether it has a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def compute():
        filters = shared.value
        names = np.array([*filters.languages, usual, UNDETERMINED], object)

        def of(texts):
            data, starts = common.text_bytes(texts)
            rows = len(starts) - 1
            best, score, plain = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows, bool)
            for lo, hi in common.chunks(starts):
                if filters.languages:
                    shares = filters.shares(data, starts[lo : hi + 1])
                    best[lo:hi], score[lo:hi] = shares.argmax(axis=1), shares.max(axis=1)
                part = data[int(starts[lo]) : int(starts[hi])]
                letters = np.concatenate([[0], np.cumsum(~common.NOT_LETTER[part] & (part < 128))])
                plain[lo:hi] = np.diff(letters[starts[lo : hi + 1] - starts[lo]]) > 0
            best[score <= 0] = len(names) - 2
            for k in np.flatnonzero(~plain):  # no letter of ASCII, which settles most texts at once
                plain[k] = has_letter(texts[int(k)].as_py())
            best[~plain], score[~plain] = len(names) - 1, 0
            if not filters.languages:
                best[:], score[:] = len(names) - 1, 0
            return pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(plain)

        return of

    return common.with_columns(docs, "lang_pred string, score double, lettered boolean", compute, whole)


def identify(docs: DataFrame, train: Column | None = None, whole: bool = False) -> DataFrame:
    """Learns from rows of docs(doc_id, text, lang) where `train` holds, then predicts all rows."""
    texts, languages, usual = training_sample(docs, F.lit(True) if train is None else train)
    filters = fit(texts, languages)
    common.release()
    return predict(docs, filters, usual or UNDETERMINED, whole)
