"""Language-model scoring: a causal self-attention model over subword ids scores whole texts, beside a unigram base.

Text is lower-cased (A-Z) and cut at white space; a word is written as a space and its letters in the first `vocabulary`
ranks of a given byte-level BPE, and one more id ends a text. The model starts from `steps` steps over windows of a bounded
sample, `each` windows of each of `sample` distinct texts, which are chosen by their size; then every partition of the
training texts goes on with every window of each of its texts, and the parameters are averaged by the number of ids seen, in
a tree of fixed fan-in, so that what is learned follows the corpus.

Word counts for the base cover all training texts. Words that the sample has most often (`usual` of them) are counted by each
task; the others are sent with counts by hash bucket from batches of texts, which get the totals back. So no bucket has a
word that most batches send. Which words a text has stays with its batch; only the model and the usual words are broadcast.

Cases: null or empty text is the end token alone; without training texts the counts are 0 and the model is the initial one;
repeated rows and ties score alike; very long texts are scored window by window; an empty table gives no rows; extra columns
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention, common
from .byte_bpe import Merges, merge_words, merges_of_ranks

END_HASH = np.uint64(0xE4D0E4D0E4D0E4D1)
BATCH_BYTES = 8 << 20
BUCKET_WORDS = 4_000_000
#: Models that are averaged together, at most.
FAN_IN = 16
#: In place of a bucket: the row of a batch's texts, and that of a task's counts of the usual words.
TEXTS, USUAL = -1, -2


@dataclass
class Words:
    """The words of some texts: each distinct one, led by a space; which one stands at each place; words before each text."""

    names: pa.Array
    at: np.ndarray
    before: np.ndarray

    def hashes(self) -> np.ndarray:
        data, starts = common.binary_parts(self.names)
        return common.word_hashes(data, starts)[0]


def words_of(data: np.ndarray, starts: np.ndarray) -> Words:
    first, end, before = common.word_spans(data, starts)
    part = common.lower(data[int(starts[0]) : int(starts[-1])])
    # one space before each word, nothing else between them
    length = end - first
    begins = np.concatenate([[0], np.cumsum(length + 1)])
    spaced = np.full(int(begins[-1]), 32, np.uint8)
    letter = np.ones(len(spaced), bool)
    letter[begins[:-1]] = False
    spaced[letter] = part[~common.separates(part)]
    found = common.binary_array(spaced, begins).dictionary_encode()
    return Words(found.dictionary, found.indices.to_numpy().astype(np.int64), before)


@dataclass
class Subwords:
    """Ids of words in the first ranks of a byte-level BPE; the id `vocabulary` stands before and after each text."""

    merges: Merges
    vocabulary: int

    def texts(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each one's begin."""
        ids, at = merge_words(self.merges, words.names)
        ids, at = np.append(ids, np.uint32(self.vocabulary)), np.append(at, len(ids) + 1)
        ends = np.concatenate([words.before[:-1], words.before[1:]])
        places = np.insert(words.at, ends, len(words.names))
        blobs = common.binary_array(ids.view(np.uint8), 4 * at).take(pa.array(places))
        joined, offsets = common.binary_parts(blobs)
        rows = len(words.before) - 1
        starts = np.append(words.before[:-1] + 2 * np.arange(rows), len(places))
        return joined[offsets[0] : offsets[-1]].view(np.uint32).astype(np.int64), (offsets[starts] - offsets[0]) // 4


def subwords_of(ranks_path: str, vocabulary: int) -> Subwords:
    return Subwords(merges_of_ranks(ranks_path, vocabulary), vocabulary)


def _slices(batches):
    """Parts of the batches of about BATCH_BYTES of text, and their texts' bytes."""
    for b in common.joined(batches, BATCH_BYTES):
        data, starts = common.text_bytes(b.column("text"))
        for lo, hi in common.chunks(starts, BATCH_BYTES):
            yield b.slice(lo, hi - lo), data, starts[lo : hi + 1]


def window_sample(texts: DataFrame, total: int, ranks_path: str, vocabulary: int, sample: int, each: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of at most `each` windows of each of about `sample` texts, and the sample's most frequent words'
    hashes with their counts. A text's chance grows with its size; copies count once. `total`: bytes of all the texts."""
    size = F.octet_length("text")
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    chosen = texts.where(F.col("text").isNotNull() & (chance < size * (sample / max(1, total)))).select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"]).select("text")

    def run(batches):
        subwords, rng = subwords_of(ranks_path, vocabulary), np.random.default_rng(seed)
        for _, data, starts in _slices(batches):
            words = words_of(data, starts)
            found = attention.Windows(*subwords.texts(words), vocabulary + 1)
            picks = [lo + rng.permutation(hi - lo)[:each] for lo, hi in zip(found.before[:-1].tolist(), found.before[1:].tolist(), strict=True)]
            inputs, targets = found.at(np.concatenate(picks))
            counts = np.bincount(words.at, minlength=len(words.names))
            top = np.argsort(-counts, kind="stable")[:20_000]
            blobs = inputs.astype(np.int16), targets.astype(np.int16), words.hashes()[top], counts[top].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["inputs", "targets", "names", "counts"])

    found = common.small_batches(chosen).mapInArrow(common.tidy(run), "inputs binary, targets binary, names binary, counts binary").toArrow()
    of = lambda column, kind: np.frombuffer(b"".join(found.column(column).to_pylist()), kind)
    names, at = np.unique(of("names", np.uint64), return_inverse=True)
    counts = np.bincount(at, of("counts", np.int64), minlength=len(names))
    inputs = of("inputs", np.int16).astype(np.int64).reshape(-1, attention.WINDOW)
    return inputs, of("targets", np.int16).astype(np.int64).reshape(-1, attention.FRESH), names, counts


def first_model(inputs: np.ndarray, targets: np.ndarray, vocabulary: int, steps: int, block: int, seed: int) -> attention.Model:
    model = attention.start(np.bincount(targets[targets >= 0], minlength=vocabulary + 1).astype(float), seed)
    if len(inputs):
        steps = min(steps, max(30, 40 * len(inputs) // block))  # a small sample is not learned by heart
        trainer, rng = attention.Trainer(model, 4e-2, steps), np.random.default_rng(seed)
        for _ in range(steps):
            k = rng.integers(0, len(inputs), block)
            trainer.train(inputs[k], targets[k])
    return model


def _mean(group: pa.Table) -> pa.Table:
    """One model of several, each weighted by the ids it has seen."""
    seen = np.array(group.column("seen").to_pylist(), np.float64)
    mixed = sum(n * np.frombuffer(w.as_py(), np.float32).astype(np.float64) for n, w in zip(seen, group.column("weights"), strict=True)) / seen.sum()
    return pa.table({"slot": group.column("slot")[:1], "seen": pa.array([int(seen.sum())], pa.int64()), "weights": pa.array([mixed.astype(np.float32).tobytes()], pa.binary())})


def train(texts: DataFrame, model: attention.Model, ranks_path: str, vocabulary: int, block: int = 512, rate: float = 1e-2, seed: int = 11) -> attention.Model:
    """Goes on from `model` with every window of every text of texts(text)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def local(batches):
        own = attention.Model(shared.value.place, {k: v.copy() for k, v in shared.value.p.items()})
        subwords, rng, trainer, seen = subwords_of(ranks_path, vocabulary), np.random.default_rng(seed), attention.Trainer(own, rate), 0
        inputs, targets = np.zeros((0, attention.WINDOW), np.int64), np.zeros((0, attention.FRESH), np.int64)
        common.keep_freed()
        for _, data, starts in _slices(batches):
            found = attention.Windows(*subwords.texts(words_of(data, starts)), own.pad)
            chosen = rng.permutation(len(found))
            for lo in range(0, len(chosen), block):
                more = found.at(chosen[lo : lo + block])
                inputs, targets = np.concatenate([inputs, more[0]]), np.concatenate([targets, more[1]])
                if len(inputs) >= block:  # what is left over waits for the next windows
                    trainer.train(inputs[:block], targets[:block])
                    seen += int((targets[:block] >= 0).sum())
                    inputs, targets = inputs[block:], targets[block:]
        if len(inputs):
            trainer.train(inputs, targets)
            seen += int((targets >= 0).sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([attention.pack(own.p).astype(np.float32).tobytes()], pa.binary())], ["slot", "seen", "weights"])

    kind = "slot long, seen long, weights binary"
    path = common.scratch(texts.sparkSession, "lm-weights")
    common.small_batches(texts).mapInArrow(common.tidy(local), kind).write.parquet(path)
    found = texts.sparkSession.read.parquet(path)
    last = found.agg(F.max("slot")).first()[0]
    if last is None:
        return model
    while last >= FAN_IN:
        found = found.withColumn("slot", F.expr(f"slot div {FAN_IN}")).groupBy("slot").applyInArrow(_mean, kind)
        last //= FAN_IN
    mixed = _mean(found.toArrow()).column("weights")[0].as_py()
    common.remove(texts.sparkSession, path)
    return attention.Model(model.place, attention.unpack(np.frombuffer(mixed, np.float32), model.p))


def _batch_words(words: Words, training: np.ndarray, usual: np.ndarray, buckets: int):
    """Of a batch of texts: hashes of its distinct words in the order of their buckets, usual ones not included, and their
    buckets and counts in training texts; those counts of the usual words; per text its words' places (usual words follow the
    others) and how often it has them, and how many words it has. The end of a text is a word too."""
    rows = len(training)
    n_tokens = np.diff(words.before) + 1
    names = np.append(words.hashes(), END_HASH)
    of = np.concatenate([np.repeat(np.arange(rows), np.diff(words.before)), np.arange(rows)])
    at = np.append(words.at, np.full(rows, len(names) - 1))
    counts = np.bincount(at, training[of], minlength=len(names)).astype(np.int64)
    slot = np.minimum(np.searchsorted(usual, names), max(0, len(usual) - 1))
    common_ = usual[slot] == names if len(usual) else np.zeros(len(names), bool)
    usual_counts = np.bincount(slot[common_], counts[common_], minlength=len(usual)).astype(np.int64)
    rare = np.flatnonzero(~common_)
    bucket = ((names[rare] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rare, bucket = rare[order], bucket[order]
    place = np.empty(len(names), np.int64)
    place[rare] = np.arange(len(rare))
    place[common_] = len(rare) + slot[common_]
    width = len(rare) + len(usual)
    cell, times = np.unique(of * width + place[at], return_counts=True)
    return names[rare], bucket, counts[rare].astype(np.uint32), usual_counts, cell % width, times, np.bincount(cell // width, minlength=rows), n_tokens


def score(docs: DataFrame, is_train: Column, ranks_path: str, vocabulary: int = 1024, sample: int = 4000, each: int = 32, steps: int = 800, usual: int = 4096, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    rows = common.small_batches(docs.select("doc_id", "text", is_train.alias("train")))
    texts = rows.where("train").select("text")
    size = F.octet_length("text")
    of_training, total = (x or 0 for x in rows.agg(F.sum(F.when(F.col("train"), size)), F.sum(size)).first())
    inputs, targets, names, counts = window_sample(texts, of_training, ranks_path, vocabulary, sample, each, seed)
    usual_words = np.sort(np.append(names[np.argsort(-counts, kind="stable")[:usual]], END_HASH))
    model = train(texts, first_model(inputs, targets, vocabulary, steps, 512, seed), ranks_path, vocabulary)
    shared = spark.sparkContext.broadcast((model, usual_words))
    buckets = max(1, total // (6 * BUCKET_WORDS) + 1)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model, usual_words = shared.value
        subwords, task, number, scorer = subwords_of(ranks_path, vocabulary), TaskContext.get().partitionId(), 0, attention.Scorer(model)
        seen = np.zeros(len(usual_words), np.int64)
        ids = None
        common.keep_freed()
        for part, data, starts in _slices(batches):
            training = np.array(part.column("train").to_pylist(), bool)
            words = words_of(data, starts)
            scores = attention.score_texts(scorer, *subwords.texts(words))
            names, bucket, counts, usual_counts, places, times, each, n_tokens = _batch_words(words, training, usual_words, buckets)
            seen += usual_counts
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            sent = [(int(bucket[lo]), names[lo:hi].tobytes(), counts[lo:hi].tobytes()) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            ids = part.column("doc_id")
            yield rows_of(task, number, sent, ids, training, n_tokens, scores, places, times, each)
            number += 1
        if ids is not None:  # counts of the usual words, once a task
            nothing = np.zeros(0)
            yield rows_of(task, -1, [(USUAL, b"", seen.tobytes())], ids.slice(0, 0), nothing.astype(bool), nothing, nothing, nothing, nothing, nothing)

    def rows_of(task, number, sent, ids, training, n_tokens, scores, places, times, each) -> pa.RecordBatch:
        """A row for each bucket, and one for the texts of the batch."""
        k = len(sent)
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0] * (k + 1) + [len(x)], pa.int32()), x)
        blobs = lambda x: pa.array([None] * k + [x.astype(np.uint32).tobytes()], pa.binary())
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([
            long([task] * (k + 1)), long([number] * (k + 1)), long([x[0] for x in sent] + [TEXTS]),
            pa.array([x[1] for x in sent] + [None], pa.binary()), pa.array([x[2] for x in sent] + [None], pa.binary()),
            lists(ids), lists(pa.array(~training, pa.bool_())), lists(long(n_tokens.astype(np.int64))), lists(pa.array(scores, pa.float64())),
            blobs(places), blobs(times), blobs(each),
        ], ["task", "number", "bucket", "names", "counts", "doc_id", "held_out", "n_tokens", "score", "places", "times", "each"])

    kind = f"task long, number long, bucket long, names binary, counts binary, doc_id array<{id_type}>, held_out array<boolean>, n_tokens array<long>, score array<double>, places binary, times binary, each binary"
    path = common.scratch(spark, "lm")
    rows.mapInArrow(common.tidy(run), kind).write.option("compression", "zstd").parquet(path)  # both halves are read again
    done = spark.read.parquet(path)
    back = common.cut_lineage(done.where("bucket >= 0").select("task", "number", "bucket", "names", "counts").groupBy("bucket").applyInArrow(_count, "task long, number long, bucket long, totals binary, distinct long, tokens long"))

    def added(group: pa.Table) -> pa.Table:
        return pa.table({"task": group.column("task")[:1], "counts": pa.array([sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("counts")).tobytes()], pa.binary())})

    often = done.where(f"bucket = {USUAL}").select("task", "counts")
    last = often.agg(F.max("task")).first()[0] or 0
    while last >= FAN_IN:
        often = often.withColumn("task", F.expr(f"task div {FAN_IN}")).groupBy("task").applyInArrow(added, "task long, counts binary")
        last //= FAN_IN
    often = sum([np.frombuffer(x, np.int64) for x in often.toArrow().column("counts").to_pylist()], np.zeros(len(usual_words), np.int64))
    distinct, tokens = back.where("task < 0").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    distinct, tokens = distinct + int((often > 0).sum()), tokens + int(often.sum())
    whole = float(np.log10(tokens + 0.5 * (distinct + 1)))
    totals_of_usual = spark.sparkContext.broadcast(often)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy()) if right.num_rows else []
        blobs = right.column("totals")
        totals = np.concatenate([*[np.frombuffer(blobs[int(k)].as_py(), np.int64) for k in order], totals_of_usual.value])
        one = lambda c: np.frombuffer(left.column(c)[0].as_py(), np.uint32).astype(np.int64)
        places, times, each = one("places"), one("times"), one("each")
        row, n = np.repeat(np.arange(len(each)), each), np.array(left.column("n_tokens")[0].as_py(), np.int64)
        base = np.bincount(row, times * np.log10(totals[places] + 0.5), minlength=len(each)) - n * whole
        known = np.bincount(row, times * (totals[places] > 0), minlength=len(each)).astype(np.int64)
        flat = lambda c: left.column(c).combine_chunks().flatten()
        return pa.table({"doc_id": flat("doc_id"), "held_out": flat("held_out"), "n_tokens": flat("n_tokens"), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(each), tokens, np.int64)), "base_score": pa.array(base), "score": flat("score")})

    found = done.where(f"bucket = {TEXTS} and number >= 0").select("task", "number", "doc_id", "held_out", "n_tokens", "score", "places", "times", "each")
    return found.groupBy("task", "number").cogroup(back.where("task >= 0").groupBy("task", "number")).applyInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _count(group: pa.Table) -> pa.Table:
    """Totals of a bucket's words, for each batch that sent any, and a row with what the base needs of the bucket."""
    names = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("names")]
    every, at = np.unique(np.concatenate(names), return_inverse=True)
    totals = np.bincount(at, np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("counts")]), minlength=len(every)).astype(np.int64)
    back, lo = [], 0
    for x in names:
        back.append(totals[at[lo : lo + len(x)]].tobytes())
        lo += len(x)
    last = lambda column, x: pa.concat_arrays([column.combine_chunks(), pa.array([x], pa.int64())])
    zero = pa.array([0] * len(names), pa.int64())
    return pa.table({"task": last(group.column("task"), -1), "number": last(group.column("number"), -1), "bucket": last(group.column("bucket"), -1), "totals": pa.array([*back, None], pa.binary()), "distinct": last(pa.chunked_array([zero]), int((totals > 0).sum())), "tokens": last(pa.chunked_array([zero]), int(totals.sum()))})
