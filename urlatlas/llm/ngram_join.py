"""N-gram Jaccard join: which texts share enough of their word shingles, and the groups that such links make.

1. Texts with the same set of shingles become one class (copies are never compared with each other).
2. Shingle frequencies give a global order, rare first. Batches of texts send the distinct shingles of their classes,
   packed by hash bucket, each class from one batch only, and get back those that another class has too. A shingle that
   nothing shares only counts in the size of its set. Of a text that many rows share, one row goes to a batch.
3. Two sets that reach the threshold share one of their first `n - ceil(t*n) + 1` shingles. Classes that share such a
   shingle form a group. A group all of whose members share an earlier shingle too lies within that one's group and is
   left out; groups with the same members count once.
4. In a group the ordered sets are stored in a prefix tree. Each set walks it once: a node's shingles are compared once
   for all sets below it, overlaps add up on the way, and a subtree is left when even all that remains on both sides is
   too little for any of its lengths, or when all of it is linked to the walker already.
5. A group of over `block` sets is cut into blocks by a hash, dealt anew in a second round, so that the copies of one
   text grow together without a task that holds them all; pairs of blocks are compared only while the group still has
   several components. Alternating large-star and small-star steps turn links into components.

Cases: an empty table gives no rows; very long texts are read whole; null or empty text and text without words have an empty set, no links, and stay alone; fewer words than the width
are one shingle; ties in frequency are broken by hash; repeated rows and equal doc_ids are allowed (the component is the
smallest doc_id of its members); a null doc_id takes part and never is the smallest; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Shingles that one batch of texts, and one bucket of hashes, hold on average.
BATCH_SHINGLES = 1_000_000
BUCKET_SHINGLES = 2_000_000
#: Links from which on a step takes a further write for the sake of nodes that have a large share of them.
MANY_EDGES = 2_000_000


def _row_hash() -> F.Column:
    """Spreads rows over batches; equal for repeated rows only."""
    return F.xxhash64("doc_id", "text")


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


class PrefixTree:
    """Sets of ascending ints, sorted; a node covers sets[lo:hi] and `segment`, what they share from a depth on."""

    __slots__ = ("lo", "hi", "segment", "last", "rest", "least", "children", "ends")

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, lo: int, hi: int, depth: int, longest: int = 48):
        first, final = sets[lo], sets[hi - 1]
        stop = min(len(first), len(final), depth + longest)
        differ = np.flatnonzero(first[depth:stop] != final[depth:stop])
        end = depth + int(differ[0]) if len(differ) else stop
        self.lo, self.hi, self.segment = lo, hi, first[depth:end]
        self.last = int(first[end - 1]) if end else -1
        self.rest = max(len(s) for s in sets[lo:hi]) - end
        self.least = int(sizes[lo:hi].min())
        self.ends = lo
        while self.ends < hi and len(sets[self.ends]) == end:
            self.ends += 1
        self.children, at = [], self.ends
        while at < hi:
            head, to = sets[at][end], at + 1
            while to < hi and sets[to][end] == head:
                to += 1
            self.children.append((at, to, end))
            at = to


def tree_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int, labels: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all similar pairs of `sets` (ascending ints; `sizes` counts unshared shingles too) into their
    components. `labels`, changed in place, says which are joined already. With `sides`, only pairs of two sides count."""
    order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
    tree_sets, tree_sizes = [sets[k] for k in order], sizes[order]
    labels[:] = labels[order]
    side = sides[order] if sides is not None else None
    universe = 1 + max((int(s[-1]) for s in tree_sets if len(s)), default=0)
    mark, links, nodes = np.zeros(universe, bool), [], {}

    def node(lo: int, hi: int, depth: int) -> PrefixTree:
        if (lo, hi, depth) not in nodes:
            nodes[lo, hi, depth] = PrefixTree(tree_sets, tree_sizes, lo, hi, depth)
        return nodes[lo, hi, depth]

    for k, x in enumerate(tree_sets):
        mark[x] = True
        n, stack = int(tree_sizes[k]), [(0, len(tree_sets), 0, 0)]
        while stack:
            lo, hi, depth, shared = stack.pop()
            if (labels[lo:hi] == labels[k]).all():
                continue
            if side is not None and (side[lo:hi] == side[k]).all():
                continue
            at = node(lo, hi, depth)
            shared += int(np.count_nonzero(mark[at.segment]))
            left = len(x) - int(np.searchsorted(x, at.last, "right"))
            # 100 * o >= percent * (n + m - o), with the least m below
            if (100 + percent) * (shared + min(left, at.rest)) < percent * (n + at.least):
                continue
            for y in range(lo, at.ends):
                if labels[y] != labels[k] and (side is None or side[y] != side[k]) and (100 + percent) * shared >= percent * (n + int(tree_sizes[y])):
                    links.append((order[k], order[y]))
                    labels[labels == labels[y]] = labels[k]
            stack += [(*child, shared) for child in at.children]
        mark[x] = False
    back = labels.copy()
    labels[order] = back
    return links


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _shingles(texts: pa.Array, width: int):
    """Every row's place and its set of shingle hashes."""
    data, starts = common.text_bytes(texts)
    for lo, hi in common.chunks(starts):
        words, before = common.word_hashes(data, starts[lo : hi + 1])
        yield from enumerate(common.shingle_hashes(words, before, width), lo)


def shingle_classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_hash, text_hash, key (of the set; null if empty), n_shingles."""

    def run(batches):
        for b in batches:
            keys, sizes = [], []
            for _, h in _shingles(b.column("text"), width):
                sizes.append(len(h))
                keys.append(_digest(h) if len(h) else None)
            columns = b.column("doc_id"), b.column("row_hash"), b.column("text_hash"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "row_hash", "text_hash", "key", "n_shingles"])

    source = docs.select("doc_id", "text", _row_hash().alias("row_hash"), F.xxhash64("text").alias("text_hash"))
    return common.small_batches(source).mapInArrow(common.tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_hash long, text_hash long, key binary, n_shingles long")


def _frequency_code(counts: np.ndarray) -> np.ndarray:
    """Frequencies in steps of a quarter octave: all that the global order needs."""
    return np.minimum(255, np.floor(4 * np.log2(counts))).astype(np.uint8)


def _split_hash(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), h.astype(np.uint32)


def _owned(texts: pa.Array, owned: pa.Array, width: int) -> dict[bytes, np.ndarray]:
    """Each class that this batch sends, once, and its set of shingle hashes."""
    keys = set(owned.to_pylist())
    return {k: h for _, h in _shingles(texts, width) if len(h) and (k := _digest(h)) in keys}


def shared_shingles(texts: DataFrame, owners: DataFrame, buckets: int, width: int) -> DataFrame:
    """(batch, codes) of the distinct shingles of each batch's classes that another class has as well: 32 bits of the hash
    within its bucket, and the frequency's code. Within a batch, a shingle's occurrences are added up before they go."""

    def send(group: pa.Table, classes: pa.Table) -> pa.Table:
        found = _owned(group.column("text").combine_chunks(), classes.column("key").combine_chunks(), width)
        out = []
        if found:
            h, n = np.unique(np.concatenate(list(found.values())), return_counts=True)
            bucket, low = _split_hash(h, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, low, n = bucket[order], low[order], n[order].astype(np.uint32)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                many = n[lo:hi] > 1
                rows = np.concatenate([low[lo:hi][~many], low[lo:hi][many]])
                out.append((int(bucket[lo]), rows.tobytes(), n[lo:hi][many].tobytes()))
        batch = group.column("batch")[0].as_py() if group.num_rows else 0
        common.release()
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "batch": pa.array([batch] * len(out), pa.int64()), "low": pa.array([x[1] for x in out], pa.binary()), "many": pa.array([x[2] for x in out], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x, np.uint32) for x in group.column("low").to_pylist()]
        counts = []
        for low, many in zip(lows, group.column("many").to_pylist(), strict=True):
            n = np.ones(len(low), np.uint32)
            if many:
                n[-(len(many) // 4) :] = np.frombuffer(many, np.uint32)
            counts.append(n)
        every, n = np.concatenate(lows), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        at = np.flatnonzero(np.diff(every[order].astype(np.int64), prepend=-1))
        total = np.add.reduceat(n[order].astype(np.int64), at)
        length = np.diff(at, append=len(every))
        codes = np.empty(len(every), np.uint8)
        codes[order] = np.repeat(np.where(total > 1, _frequency_code(np.maximum(total, 2)), 0), length)
        out, lo = [], 0
        for low in lows:
            code = codes[lo : lo + len(low)]
            lo += len(low)
            out.append((low[code > 0].tobytes(), code[code > 0].tobytes()))
        common.release()
        return pa.table({"batch": group.column("batch").combine_chunks(), "bucket": group.column("bucket").combine_chunks(), "low": pa.array([x[0] for x in out], pa.binary()), "code": pa.array([x[1] for x in out], pa.binary())})

    sent = texts.groupBy("batch").cogroup(owners.groupBy("batch")).applyInArrow(send, "bucket long, batch long, low binary, many binary")
    return sent.groupBy("bucket").applyInArrow(count, "batch long, bucket long, low binary, code binary").where(F.length("low") > 0)


def ordered_sets(texts: DataFrame, owners: DataFrame, shared: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """key, n, shingles (shared ones in the global order, as 8-byte ints), codes, probes (those of the prefix), runs
    (where each probe's frequency begins), for the classes whose prefix holds a shared shingle, each in one batch."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("shingles", pa.binary()), ("codes", pa.binary()), ("probes", pa.list_(pa.int64())), ("runs", pa.list_(pa.int32()))])
        known = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        is_class = pc.is_null(right.column("bucket"))
        classes, right = right.filter(is_class).column("low").combine_chunks(), right.filter(pc.invert(is_class))
        if right.num_rows:
            lows = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32) for x, b in zip(right.column("low").to_pylist(), right.column("bucket").to_pylist(), strict=True)]
            ids, codes = np.concatenate(lows), np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8)
            order = np.argsort(ids, kind="stable")
            known = ids[order], codes[order]
        out = []
        if left.num_rows and len(known[0]):
            for key, h in _owned(left.column("text").combine_chunks(), classes, width).items():
                bucket, low = _split_hash(h, buckets)
                ids = (bucket.astype(np.uint64) << np.uint64(32)) | low
                at = np.minimum(np.searchsorted(known[0], ids), len(known[0]) - 1)
                has = known[0][at] == ids
                prefix = len(h) - _needed(len(h), percent) + 1 - int(len(h) - has.sum())
                if prefix <= 0 or not has.any():
                    continue
                code, h2 = known[1][at][has], h[has]
                order = np.lexsort((h2, code))
                out.append((key, len(h), h2[order].tobytes(), code[order].tobytes(), h2[order][:prefix].view(np.int64).tolist(), np.searchsorted(code[order], code[order][:prefix]).tolist()))
        common.release()
        return pa.Table.from_pylist([dict(zip(names.names, x, strict=True)) for x in out], names)

    shared = shared.unionByName(owners.select("batch", F.lit(None).cast("long").alias("bucket"), F.col("key").alias("low"), F.lit(None).cast("binary").alias("code")))
    return texts.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(run, "key binary, n long, shingles binary, codes binary, probes array<long>, runs array<int>")


def tree_join(members: DataFrame, percent: int, sides: bool) -> DataFrame:
    """Links (a, b) of each group of rows (cell, key, n, shingles, codes, label[, side])."""

    def run(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_pylist()
        hashes = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        codes = [np.frombuffer(x, np.uint8) for x in group.column("codes").to_pylist()]
        every = np.concatenate(hashes)
        names, at = np.unique(every, return_index=True)
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, np.concatenate(codes)[at]))] = np.arange(len(names))
        sets = [rank[np.searchsorted(names, h)] for h in hashes]
        label = np.unique(np.array([x.hex() for x in group.column("label").to_pylist()]), return_inverse=True)[1]
        side = np.array(group.column("side").to_pylist()) if sides else None
        if len(keys) > 200:
            common.release()
        links = tree_links(sets, np.array(group.column("n").to_pylist(), np.int64), percent, label, side)
        return pa.table({"a": pa.array([keys[i] for i, _ in links], pa.binary()), "b": pa.array([keys[j] for _, j in links], pa.binary())})

    return members.groupBy("cell").applyInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key of each component of (a, b), by alternating large-star and small-star steps. Of many
    edges, the least neighbours are written down before edges join them, so that adaptive execution can split the join at a
    node that has very many; it can't split one that an aggregation feeds."""

    def summary(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = common.cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = summary(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = common.cut_lineage(least) if before[0] > MANY_EDGES else least
        large = edges.select(F.col("b").alias("c"), F.col("a")).join(least.select(F.col("a").alias("c"), "m"), "c").select("a", F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        edges = common.cut_lineage(large.join(down, "a").select(pairs.alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        now = summary(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "key").unionByName(edges.select(F.col("b").alias("key"), F.col("b").alias("label")).distinct())


def joined_components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, label) of labels(key, label) after further links: only the components that these join are looked at again."""
    end = lambda df, c: df.join(labels.select(F.col("key").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(c, F.coalesce(f"{c}_label", c))
    between = end(end(common.cut_lineage(links.select("a", "b").distinct()), "a"), "b").select("a", "b")
    more = common.cut_lineage(components(between))
    moved = labels.join(more.select(F.col("key").alias("label"), F.col("label").alias("to")), "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    return moved.unionByName(more.join(labels.select("key"), "key", "left_anti").select("key", "label"))


def _probe_groups(probes: DataFrame) -> DataFrame:
    """probe, size: the groups of sets that share a probe, those left out that lie within another one."""
    within = [F.coalesce((F.min(e) == F.max(e)) & (F.count(e) == F.count(F.lit(1))), F.lit(False)) for e in ("e0", "e1", "e2")]
    groups = probes.groupBy("probe").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(7))).alias("y"),
        (within[0] | within[1] | within[2]).alias("within"),
    )
    alone = groups.where("size > 1 and not within")
    return alone.groupBy("size", "x", "y").agg(F.min("probe").alias("probe")).select("probe", "size")


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 1500) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = common.cut_lineage(shingle_classes(docs, width))
    reps = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("row_hash").alias("row_hash"))
    count, total = rows.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    total = total or 0
    batches, buckets = max(1, -(-total // BATCH_SHINGLES)), max(1, -(-total // BUCKET_SHINGLES))
    # a class is sent by one batch alone: that of its row with the smallest hash
    batch = lambda h: F.pmod(h, F.lit(batches)).alias("batch")
    # of the classes that a large share of rows have, of which there are few, only that row's text is sent at all
    often = rows.where("n_shingles > 0").groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("row_hash").alias("only")).where(F.col("n") > max(200, count // (4 * parts)))
    texts = docs.select("text", _row_hash().alias("row_hash"), F.xxhash64("text").alias("text_hash")).join(F.broadcast(often.select("text_hash", "only")), "text_hash", "left")
    texts = texts.where("only is null or row_hash = only").select(batch(F.col("row_hash")), "text")
    owners = reps.select(batch(F.col("row_hash")), "key")
    sets = common.cut_lineage(ordered_sets(texts, owners, shared_shingles(texts, owners, buckets, width), buckets, width, percent))

    # an earlier shingle of each probe's set: the one before it, the set's first, the first of the same frequency
    earlier = lambda p, at: F.nullif(F.get("probes", at), p)
    known = F.transform("probes", lambda p, i: F.struct(p.alias("probe"), earlier(p, i - 1).alias("e0"), earlier(p, F.lit(0)).alias("e1"), earlier(p, F.get("runs", i)).alias("e2")))
    probes = sets.select("key", F.explode(known).alias("p")).select("key", "p.*")
    member = common.cut_lineage(probes.select("probe", "key").join(_probe_groups(probes), "probe").select("probe", "size", "key"))
    small = member.where(F.col("size") <= block).select(F.struct("probe", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("cell"), "key")
    ways = F.ceil(F.col("size") / F.lit(block // 2)).cast("int")

    def blocks(salt: int) -> DataFrame:
        return member.where(F.col("size") > block).select("probe", "key", F.pmod(F.xxhash64("key", F.lit(salt)), ways).cast("int").alias("i"))

    def dealt(cells: DataFrame, labels: DataFrame | None, sides: bool) -> DataFrame:
        full = cells.join(sets.select("key", "n", "shingles", "codes"), "key")
        full = full.withColumn("label", F.col("key")) if labels is None else full.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        return tree_join(full, percent, sides)

    cell = lambda d: d.select(F.struct("probe", "i", F.lit(-1).alias("j")).alias("cell"), "key")
    labels = common.cut_lineage(components(dealt(small.unionByName(cell(blocks(1))), None, False)))
    if member.where(F.col("size") > block).limit(1).count():
        for salt in (2, 3):
            labels = common.cut_lineage(joined_components(dealt(cell(blocks(salt)), labels, False), labels))
        placed = blocks(3).join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        # blocks that still hold another component than the group's smallest are compared with all others
        kinds = placed.groupBy("probe", "i").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        p, q = kinds.alias("p"), kinds.alias("q")
        joined_already = (F.col("p.least") == F.col("p.most")) & (F.col("q.least") == F.col("q.most")) & (F.col("p.least") == F.col("q.least"))
        pairs = p.join(q, (F.col("p.probe") == F.col("q.probe")) & (F.col("p.i") < F.col("q.i")) & ~joined_already).select("p.probe", F.col("p.i").alias("i"), F.col("q.i").alias("j"))
        if pairs.limit(1).count():
            side = lambda c, v: pairs.join(placed.select("probe", F.col("i").alias(c), "key"), ["probe", c]).select(F.struct("probe", "i", "j").alias("cell"), "key", F.lit(v).alias("side"))
            labels = common.cut_lineage(joined_components(dealt(side("i", 0).unionByName(side("j", 1)), labels, True), labels))
    named = reps.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "label").select("key", "component_id")
    return rows.join(linked, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
