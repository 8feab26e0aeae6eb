"""Jaccard self-join of word 5-gram sets by chosen paths.

A set follows paths: at a path's node the node's hash draws one or two (1/threshold in the mean) min-wise
samples, and the set goes on to the child of each sampled token, so two sets stay together in a node with
their similarity, and sets of that similarity meet at a leaf with a chance that falls only with the
depth. Runs repeat until the target recall. Leaves are compared by brute force on the signatures, leaves
above ``limit`` block by block (every block with each other), so none of a leaf's pairs is left out.
What is similar by signature, with a margin of six standard errors, forms clusters; within clusters the
5-gram sets themselves are compared, large clusters block by block, so every link is exact.

Documents with equal sets are one node with a multiplicity, so copies need no pairs. One row per document is
returned: doc_id, class_id (smallest id of the class), n_links (other documents of similarity at least the
threshold), copies (documents with the same set).

Awkward rows: texts of fewer than five words have one n-gram of all their words; null texts and texts without words
have no links and are a class of their own; null ids and repeated rows are documents like others (a class of null ids
only has a null id); very long texts are read whole; pairs exactly at the threshold are linked (the test is in whole
numbers); an empty table gives an empty result; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, prepare, release, trim_memory, with_hot_keys
from weftline.llm.components import components

N_HASH, WORDS = 64, 5
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MUL = _mix(np.arange(1, N_HASH + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_ADD = _mix(np.arange(1, N_HASH + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_POW = _mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | _U(1)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_words = _Words()


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word 5-grams (lower case, split at white space)."""
    if len(_words) > 200_000:
        _words.clear()
    split = [(t or "").lower().split() for t in texts]
    flat = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), np.uint64, sum(map(len, split)))
    out, at = [], 0
    for words in split:
        w = flat[at : at + len(words)]
        at += len(words)
        if not len(w):
            out.append(w)
            continue
        k = min(WORDS, len(w))
        n = len(w) - k + 1
        h = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            h = h + w[i : i + n] * _POW[i]
        out.append(np.unique(_mix(h)))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    sig = np.empty(N_HASH, dtype=np.uint32)
    for lo in range(0, N_HASH, 16):
        part = np.full(16, np.iinfo(np.uint64).max, dtype=np.uint64)
        for a in range(0, len(s), 1 << 14):
            part = np.minimum(part, (s[a : a + (1 << 14), None] * _MUL[lo : lo + 16] + _ADD[lo : lo + 16]).min(axis=0))
        sig[lo : lo + 16] = part >> _U(32)
    return sig


def follow(path: np.ndarray, sig: np.ndarray, row: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One level: (path, row) of the children; ``row`` indexes ``sig``."""
    draw = _mix(path)
    second = ((draw >> _U(40)).astype(np.float64) / 2**24) < 1 / threshold - 1
    first_at = (draw % _U(N_HASH)).astype(np.int64)
    second_at = (first_at + 1 + ((draw >> _U(8)) % _U(N_HASH - 1)).astype(np.int64)) % N_HASH
    at = np.concatenate([first_at, second_at[second]])
    path, row = np.concatenate([path, path[second]]), np.concatenate([row, row[second]])
    return _mix(path ^ _mix(sig[row, at].astype(np.uint64) + (at.astype(np.uint64) << _U(32)))), row


def runs_needed(threshold: float, depth: int, recall: float) -> int:
    """Runs until a pair at the threshold meets with ``recall``; they share one signature, so the miss is averaged over how much of it agrees."""
    agree = np.arange(N_HASH + 1) / N_HASH
    chance = np.array([math.comb(N_HASH, m) * threshold**m * (1 - threshold) ** (N_HASH - m) for m in range(N_HASH + 1)])
    meet, two, runs = np.ones(N_HASH + 1), 1 / threshold - 1, 1
    for _ in range(depth):
        c = agree * meet
        meet = (1 - two) * c + two * (1 - (1 - c) ** 2)
    while chance @ (1 - meet) ** runs > 1 - recall:
        runs += 1
    return runs


def _batch(names, kinds, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _sets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, thash, text) to doc_id, thash, skey, size, sig."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingles(part.column(2).to_pylist())
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield _batch(["doc_id", "thash", "skey", "size", "sig"], [None, None, pa.binary(), pa.int64(), pa.binary()], [part.column(0), part.column(1), keys, [len(s) for s in sets], sigs])
        _words.clear()
        trim_memory()

    return docs.mapInArrow(run, "doc_id long, thash long, skey binary, size long, sig binary")


def _paths(rows: DataFrame, depth: int, runs: int, threshold: float) -> DataFrame:
    """(skey, sig) to (path, skey) at the end of ``runs`` roots' paths."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, N_HASH)
            path, row = np.repeat(_mix(np.arange(1, runs + 1, dtype=np.uint64)), n), np.tile(np.arange(n), runs)
            for _ in range(depth):
                path, row = follow(path, sig, row, threshold)
            for lo in range(0, len(row), 1 << 16):
                yield _batch(["path", "skey"], [pa.int64(), None], [path[lo : lo + (1 << 16)].view(np.int64), keys.take(pa.array(row[lo : lo + (1 << 16)]))])

    return rows.mapInArrow(run, "path long, skey binary")


def _grouped(batches, key: int = 0):
    """Batches of rows sorted by a column, cut so that no group spans two."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        column = now.column(key)
        last, k = column[len(column) - 1], len(column) - 1
        while k and column[k - 1] == last:
            k -= 1
        if k:
            yield now.slice(0, k).combine_chunks()
        held = now.slice(k)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _labels(match: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a boolean matrix."""
    n = len(match)
    label = np.arange(n)
    match = match | match.T
    np.fill_diagonal(match, True)
    while True:
        new = np.where(match, label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _leaf_edges(rows: DataFrame, least: float) -> DataFrame:
    """Leaves (path, skey, sig) to edges (a, b) of a spanning forest of the pairs similar by signature."""

    def run(batches):
        for table in _grouped(batches):
            path = table.column(0).to_numpy()
            keys = table.column(1).to_pylist()
            sig = np.frombuffer(b"".join(table.column(2).to_pylist()), dtype=np.uint32).reshape(len(keys), N_HASH)
            starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            sizes = np.diff(np.append(starts, len(path)))
            a, b = [], []
            two = starts[sizes == 2]
            hit = two[(sig[two] == sig[two + 1]).mean(axis=1) >= least] if len(two) else two
            a += [keys[i] for i in hit]
            b += [keys[i + 1] for i in hit]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = sig[s : s + n]
                match = np.zeros((n, n), dtype=bool)
                step = max(1, (1 << 22) // (n * N_HASH))
                for lo in range(0, n, step):
                    match[lo : lo + step] = (own[lo : lo + step, None, :] == own[None, :, :]).mean(axis=2) >= least
                for i, root in enumerate(_labels(match).tolist()):
                    if i != root:
                        a.append(keys[s + i])
                        b.append(keys[s + root])
            yield _batch(["a", "b"], [pa.binary()] * 2, [a, b])

    # in order of keys, so that the leaves of a large group take the same few roots
    return rows.repartition("path").sortWithinPartitions("path", "skey").mapInArrow(run, "a binary, b binary")


def _compare(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: tuple[int, int]) -> np.ndarray:
    """Boolean matrix of exact similarity of at least num/den, between the lists or (upper triangle) within the first."""
    num, den = threshold
    every = sets_a + (sets_b or [])
    values, inverse = np.unique(np.concatenate(every), return_inverse=True)
    sizes = np.array([len(s) for s in every])
    owner = np.repeat(np.arange(len(every)), sizes)
    shared = np.bincount(inverse, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col = owner[keep], column[inverse[keep]]
    na = len(sets_a)
    n_cols = int(shared.sum())
    inter = np.zeros((na, len(every) - na) if sets_b is not None else (na, na), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(64, (1 << 22) // max(1, len(every)))
    for lo in range(0, n_cols, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        dense = np.zeros((len(every), min(width, n_cols - lo)), dtype=np.float32)
        dense[row[i:j], col[i:j] - lo] = 1
        inter += dense[:na] @ (dense[na:] if sets_b is not None else dense).T
    left, right = sizes[:na], sizes[na:] if sets_b is not None else sizes
    match = inter.astype(np.int64) * (num + den) >= num * (left[:, None] + right[None, :])
    return match if sets_b is not None else np.triu(match, 1)


def _exact(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(task, skey, copies, side, set), ``side`` 0 or 1, or 2 for a task within one block, to (skey, links, root): partial link counts and forest edges."""

    def run(batches):
        for table in _grouped(batches):
            task = table.column(0).to_pylist()
            keys, copies, side = table.column(1).to_pylist(), np.array(table.column(2).to_pylist()), np.array(table.column(3).to_pylist())
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column(4).to_pylist()]
            out: tuple[list, list, list] = ([], [], [])
            at = 0
            while at < len(task):
                over = at
                while over < len(task) and task[over] == task[at]:
                    over += 1
                mine = np.arange(at, over)
                first = {}
                for i in mine.tolist():  # a repeated row is one set
                    first.setdefault((keys[i], int(side[i])), i)
                mine = np.array(list(first.values()))
                within = side[mine[0]] == 2
                a = mine if within else mine[side[mine] == 0]
                b = None if within else mine[side[mine] == 1]
                if len(a) and (within or len(b)):
                    match = _compare([sets[i] for i in a], None if within else [sets[i] for i in b], threshold)
                    if within:
                        full, ends = match | match.T, a
                        links = full @ copies[a]
                    else:
                        ends = np.concatenate([a, b])
                        full = np.zeros((len(ends), len(ends)), dtype=bool)
                        full[: len(a), len(a) :] = match
                        links = np.concatenate([match @ copies[b], match.T @ copies[a]])
                    for i, (n, root) in enumerate(zip(links.tolist(), _labels(full).tolist())):
                        if n:
                            out[0].append(keys[ends[i]])
                            out[1].append(n)
                            out[2].append(keys[ends[root]])
                at = over
            yield _batch(["skey", "links", "root"], [pa.binary(), pa.int64(), pa.binary()], out)
        trim_memory()

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "skey binary, links long, root binary")


def join(docs: DataFrame, threshold: tuple[int, int] = (4, 5), depth: int = 3, recall: float = 0.9999, limit: int = 1000, block_tokens: int = 1_000_000, block_rows: int = 1000) -> DataFrame:
    """``docs`` (doc_id, text, ...) to doc_id, class_id, n_links, copies, thash."""
    prepare(docs)
    t = threshold[0] / threshold[1]
    least = t - 6 * math.sqrt(t * (1 - t) / N_HASH)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("thash"), "text")
    rows = materialize(_sets(keyed), "ngram-sets")
    nodes = rows.where("skey is not null").groupBy("skey").agg(F.min(F.struct("doc_id", "thash")).alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    nodes = materialize(nodes, "ngram-nodes")

    def met(paths: DataFrame) -> DataFrame:
        of = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        return materialize(paths.join(of, "path"), "ngram-leaves")

    found = met(_paths(nodes.select("skey", "sig"), depth, runs_needed(t, depth, recall), t))
    parts = F.ceil(F.col("n") / limit).cast("int")
    large = found.where(F.col("n") > limit).withColumn("own", F.pmod(F.xxhash64("skey"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))  # should two tasks collide, more is compared, not less
    tasks = found.where(F.col("n") <= limit).select("path", "skey").union(large.where("own <> other").select(pair.alias("path"), "skey"))
    edges = _leaf_edges(tasks.join(nodes.select("skey", "sig"), "skey").select("path", "skey", "sig"), least)
    clusters = components(edges, "ngram-clusters").withColumnRenamed("node", "skey")
    release(found)

    member = clusters.join(nodes.drop("sig"), "skey")
    sized = member.groupBy("label").agg(F.count("*").alias("m"), F.sum("size").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("m") / block_rows)).cast("int")
    wanted = member.join(sized, "label").select("label", "skey", "copies", "rep.doc_id", "rep.thash", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("skey"), F.col("blocks")).cast("int"))
    w = wanted.withColumnsRenamed({"doc_id": "_id", "thash": "_th"})
    texts = keyed.join(w, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("thash") == F.col("_th"))).select("label", "skey", "copies", "blocks", "own", "text")

    def shingle(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [s.tobytes() for s in shingles(part.column(5).to_pylist())]
                yield _batch(["label", "skey", "copies", "blocks", "own", "set"], [None] * 5 + [pa.binary()], [*part.columns[:5], sets])
        _words.clear()
        trim_memory()

    tokens = texts.mapInArrow(shingle, "label binary, skey binary, copies long, blocks int, own int, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = tokens.select("*", other).select(
        F.concat_ws("/", F.hex("label"), F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        "skey",
        "copies",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "set",
    )
    exact = materialize(_exact(tasks, threshold), "ngram-links")
    links = exact.groupBy("skey").agg(F.sum("links").alias("links"))
    classes = components(exact.select(F.col("skey").alias("a"), F.col("root").alias("b")), "ngram-classes").withColumnRenamed("node", "skey")
    named = classes.join(nodes.select("skey", "least_id"), "skey")
    first = named.groupBy("label").agg(F.min("least_id").alias("class_id"))
    linked = named.join(first, "label").select("skey", "class_id")
    of = nodes.select("skey", "copies", "least_id").join(links, "skey", "left").join(linked, "skey", "left")
    of = of.select("skey", "copies", F.coalesce("class_id", "least_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of = materialize(of, "ngram-of")
    release(nodes, exact, clusters, classes)
    return with_hot_keys(rows.select("doc_id", "thash", "skey"), of, "skey", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "thash"
    )
