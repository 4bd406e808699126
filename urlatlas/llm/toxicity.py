"""Toxicity by cumulative-link ordinal regression: P(grade > k) = sigmoid(w.x - b_k) with one weight vector for all ordered
thresholds b_1 < b_2, over sparse word features. The expected severity is the sum of those probabilities.

Labels say toxic or not; the grades of toxic training texts are 1 or 2 by how many cue words they hold against the median
of toxic texts. Words that the sample ties to toxic or to clean texts are the features (log of 1 + count, up to 7). The model is
fitted on a bounded sample of labelled rows (about `sample` of either kind, fewer where their texts would have over
`sample_bytes`), of which the distinct words' hashes and counts come to the driver; prediction reads every whole text.

Cases: null or empty text has no features and the grade of the thresholds alone; labels without text, texts without label
and repeated labels are fine; without labels of both kinds nothing is toxic; ties and repeated rows score alike; very long
texts are read whole; an empty table gives no rows; extra columns are not looked at, or carried along as a struct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Occurrences of a word in a text beyond these add nothing.
MOST = 7


@dataclass
class Ordinal:
    words: np.ndarray  # sorted hashes of the features
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """rows x thresholds: P(grade > k)."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -30, 30)))


def features(model_words: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and log(1 + count) of each feature of each row."""
    words, before = common.word_hashes(data, starts, common.NOT_LETTER)
    if not len(model_words) or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(model_words, words), len(model_words) - 1)
    hit = np.flatnonzero(model_words[at] == words)
    row = np.searchsorted(before, hit, "right") - 1
    cell, n = np.unique(row * len(model_words) + at[hit], return_counts=True)
    return cell // len(model_words), cell % len(model_words), np.log1p(np.minimum(n, MOST))


def word_counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct word hashes, sorted, and how often it has them, up to MOST."""
    data, starts = common.text_bytes(texts)
    out = []
    for lo, hi in common.chunks(starts):
        words, before = common.word_hashes(data, starts[lo : hi + 1], common.NOT_LETTER)
        for k in range(hi - lo):
            h, n = np.unique(words[before[k] : before[k + 1]], return_counts=True)
            out.append((h, np.minimum(n, MOST).astype(np.uint8)))
    return out


def fit(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, most_words: int = 2000, least_texts: int = 3, least_ratio: float = 15.0, steps: int = 400, l2: float = 1e-3) -> Ordinal:
    """From what `word_counts` gives of each text."""
    if not toxic.any() or toxic.all():
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([30.0, 31.0]))
    seen, of = [h for h, _ in texts], [np.full(len(h), kind) for (h, _), kind in zip(texts, toxic, strict=True)]
    words, at = np.unique(np.concatenate(seen), return_inverse=True)
    of = np.concatenate(of)
    n = np.stack([np.bincount(at[of == k], minlength=len(words)) for k in (0, 1)]).astype(float)
    texts_of = np.array([[(~toxic).sum()], [toxic.sum()]], float)
    share = (n + 0.5) / (texts_of + 1)
    odds = np.log(share[1] / share[0])
    # the likelihood ratio of each word's presence against the kind of text
    log = lambda x, whole: x * np.log(np.maximum(x, 1e-9) / np.maximum(whole, 1e-9))
    both, every = n.sum(axis=0), texts_of.sum()
    ratio = 2 * sum(log(n[k], both * texts_of[k] / every) + log(texts_of[k] - n[k], (every - both) * texts_of[k] / every) for k in (0, 1))
    use = (both >= least_texts) & (ratio > least_ratio)
    use &= ratio >= np.sort(ratio[use])[-most_words:].min(initial=np.inf)
    chosen, cue = words[use], (odds > 1)[use]

    rows, cols, values = [], [], []
    for k, (h, n) in enumerate(texts):
        at = np.minimum(np.searchsorted(chosen, h), max(0, len(chosen) - 1))
        hit = np.flatnonzero(chosen[at] == h) if len(chosen) else np.zeros(0, np.int64)
        rows.append(np.full(len(hit), k))
        cols.append(at[hit])
        values.append(np.log1p(n[hit].astype(float)))
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    held = np.bincount(rows, np.expm1(values) * cue[cols] if len(cols) else None, minlength=len(texts))
    grade = np.where(toxic, 1 + (held > np.median(held[toxic])), 0)

    # Adam on the mean log-likelihood of the two cumulative logits; both kinds weigh alike
    w, b = np.zeros(len(chosen)), np.array([0.0, 2.0])
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    m1, m2 = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    above = grade[:, None] > np.arange(2)
    for step in range(1, steps + 1):
        score = np.bincount(rows, values * w[cols], minlength=len(texts))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - b, -30, 30)))
        gap = (p - above) * weight[:, None]
        slope = np.bincount(cols, values * gap.sum(axis=1)[rows], minlength=len(w)) + l2 * w / max(1, len(w)) ** 0.5
        g = np.concatenate([slope, -gap.sum(axis=0)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-2], b - move[-2:]
        b[1] = max(b[1], b[0] + 0.1)
    return Ordinal(chosen, w, b)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Words and labels of about `sample` rows of either kind, chosen by a hash of the id; the chosen ids are broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    wanted = min(sample, sample_bytes * (rows or 0) // max(1, 2 * (size or 0)))
    share = lambda kind: F.lit(min(1.0, wanted / max(1, counts.get(kind, 0))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * F.when(F.col("toxic"), share(True)).otherwise(share(False)))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def run(batches):
        for b in batches:
            words = word_counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() for h, _ in words], pa.binary()), pa.array([n.tobytes() for _, n in words], pa.binary()), b.column("toxic")], ["words", "counts", "toxic"])

    got = common.small_batches(found).mapInArrow(common.tidy(run), "words binary, counts binary, toxic boolean").toArrow()
    texts = [(np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint8)) for h, n in zip(got.column("words").to_pylist(), got.column("counts").to_pylist(), strict=True)]
    return texts, np.array(got.column("toxic").to_pylist(), bool)


def score(docs: DataFrame, model: Ordinal, limit: float = 0.5, whole: bool = False) -> DataFrame:
    """doc_id (or, with `whole`, the struct `row` of all columns), severity (expected grade, 0 to 2), p_toxic, grade (how
    many thresholds are exceeded), toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        model = shared.value

        def of(texts):
            data, starts = common.text_bytes(texts)
            scores = np.zeros(len(starts) - 1)
            for lo, hi in common.chunks(starts):
                r, c, v = features(model.words, data, starts[lo : hi + 1])
                scores[lo:hi] = np.bincount(r, v * model.weights[c], minlength=hi - lo)
            p = model.exceed(scores)
            return pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= limit).sum(axis=1), pa.int32()), pa.array(p[:, 0] >= limit)

        return of

    return common.with_columns(docs, "severity double, p_toxic double, grade int, toxic boolean", compute, whole)


def grade_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 32 << 20, whole: bool = False) -> DataFrame:
    model = fit(*labelled_sample(docs, labels, sample, sample_bytes))
    common.release()
    return score(docs, model, whole=whole)
