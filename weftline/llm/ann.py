"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by pseudo-rotations (three rounds of random signs and a Hadamard transform) and hashed
to the nearest signed axis; a table concatenates as many hashes, the last over fewer axes, as give about
``BUCKET`` vectors a bucket. All vectors are indexed once a table; queries probe the buckets nearest to
them. The number of probes is fitted: for a bounded sample of queries (``SAMPLE`` a length) the true neighbours
are found by brute force over all rows, and the place of their buckets among the query's probes tells how many
reach them with ``recall``; there is no upper limit. Queries that meet fewer than k candidates probe on, eight
times as far each time, until they have k or have seen every bucket.

What goes through the tables is a vector rounded to bytes with the length of its rounding error, so the cosine of
two of them is known within a bound; every candidate that may be among the k best by that bound is reranked by the
cosine of the original vectors in double precision.

Awkward rows: vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows
without an id; a vector is compared with those of its own length, as the cosine asks. Components are scaled by
powers of two, so the largest and the smallest doubles count like any other. Of equal vectors the k+1 smallest ids
are indexed (others can't be in any result), and equal query vectors are searched once. Repeated rows are one
candidate; equal scores go to the smaller id. Buckets with many vectors or queries are split into cells that are
compared one by one. Fewer than k candidates are all returned; an empty table gives an empty result; other columns
are not read, so their names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, prepare, release

BUCKET, TABLES, SAMPLE, CELL = 64, 10, 64, 8192
SCHEMA = "query_id long, rank int, vec_id long, score double"


class Hasher:
    def __init__(self, n: int, dim: int):
        self.size = 1 << max(1, (dim - 1).bit_length())
        left = max(2.0, n / BUCKET)
        self.axes: list[int] = []
        while left > 2 * self.size:
            self.axes.append(self.size)
            left /= 2 * self.size
        self.axes.append(int(min(self.size, max(1, round(left / 2)))))
        self.buckets = int(np.prod([2 * a for a in self.axes]))

    def turned(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """Signed coordinates (positive axes, then negative) for each hash of a table; ``x`` of unit length."""
        out = []
        for k, axes in enumerate(self.axes):
            signs = np.random.default_rng([table, k]).choice([-1.0, 1.0], (3, self.size))
            y = np.zeros((len(x), self.size))
            y[:, : x.shape[1]] = x
            for s in signs:
                y = _hadamard(y * s)
            out.append(np.concatenate([y[:, :axes], -y[:, :axes]], axis=1))
        return out

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), dtype=np.int64)
        for y in self.turned(x, table):
            code = code * y.shape[1] + y.argmax(axis=1)
        return code

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` nearest buckets of each row by squared distance from the best axes, nearest first."""
        cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for y in self.turned(x, table):
            gap = (y.max(axis=1, keepdims=True) - y) ** 2
            axis = np.argsort(gap, axis=1, kind="stable")[:, :n]
            gap = np.take_along_axis(gap, axis, 1)
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * y.shape[1] + axis[:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :n]
            cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
        return code

    def gaps(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each hash the squared distances of the rows' coordinates from the best one."""
        return [(y.max(axis=1, keepdims=True) - y) ** 2 for y in self.turned(x, table)]

    @staticmethod
    def place(gaps: list[np.ndarray], code: int) -> int:
        """At which probe of a row with these ``gaps`` bucket ``code`` comes (the last of those as near)."""
        cost = 0.0
        for gap in reversed(gaps):
            code, axis = divmod(code, len(gap))
            cost += gap[axis]
        near = [np.sort(gap[gap <= cost + 1e-12]) for gap in gaps]
        sums = np.zeros(1)
        for gap in near[:-1]:
            sums = (sums[:, None] + gap).ravel()
        return int(np.searchsorted(near[-1], cost - sums + 1e-12, side="right").sum())


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, flat[starts[rows][:, None] + np.arange(dim)]))
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that sums of squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``q`` (or its one row) and ``x``, each computed alike whatever the others are."""
    q, x = _scaled(q), _scaled(x)
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def nearest(query: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row indices, scores) of the k best rows; ties to smaller ids."""
    score = cosines(query[None, :], x)
    best = np.lexsort((ids, -score))[:k]
    return best, score[best]


def rounded(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes: the step, the length of the error (both float32), and the components in steps."""
    step = np.abs(unit).max(axis=1, keepdims=True) / 127
    code = np.rint(unit / step).astype(np.int8)
    step = step.astype("<f4")
    error = np.sqrt(((unit - code * step.astype(np.float64)) ** 2).sum(axis=1, keepdims=True)) * (1 + 1e-6) + 1e-7
    return np.concatenate([step.view(np.uint8), error.astype("<f4").view(np.uint8), code.view(np.uint8)], axis=1)


def _opened(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, errors) of rounded vectors."""
    head = np.ascontiguousarray(payload[:, :8]).view("<f4")
    return payload[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1].astype(np.float64)


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, key, dim, embedding) that take part; ``key`` tells vectors of one id apart."""
    fine = vectors.where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("embedding").alias("key"), F.size("embedding").alias("dim"), "embedding")


def _truth(rows: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> list:
    """For each sample query (by length and number) the embeddings of its k best rows, itself left out."""

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(5))
            for rows, x in _by_length(batch.column(1)) if batch.num_rows else []:
                vec = batch.column(0).to_numpy()[rows]
                for i, (own, query) in enumerate(zip(*sample.get(x.shape[1], ((), ())))):
                    at, score = nearest(query, x, vec, k + 1)
                    for r, s in zip(at.tolist(), score.tolist()):
                        if vec[r] != own:
                            for column, value in zip(out, (x.shape[1], i, int(vec[r]), s, x[r].tolist())):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())])], names=["dim", "q", "vec_id", "score", "embedding"])

    best = Window.partitionBy("dim", "q").orderBy(F.desc("score"), "vec_id")
    found = rows.select("vec_id", "embedding").mapInArrow(run, "dim int, q int, vec_id long, score double, embedding array<double>")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("dim", "q", "embedding").collect()  # at most SAMPLE * k a length


def fit_probes(rows: DataFrame, queries: DataFrame, hashers: dict[int, Hasher], k: int, recall: float) -> dict[int, int]:
    """Probes a table, by length, so that the sample's true neighbours lie in probed buckets with ``recall``."""
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample: dict[int, tuple[list, list]] = {}
    for r in queries.withColumn("draw", F.row_number().over(drawn)).where(F.col("draw") <= SAMPLE).select("dim", "vec_id", "embedding").collect():
        ids, x = sample.setdefault(r["dim"], ([], []))
        ids.append(r["vec_id"])
        x.append(r["embedding"])
    known = {dim: (np.array(ids), np.array(x, dtype=np.float64)) for dim, (ids, x) in sample.items()}
    true: dict[int, list] = {}
    for r in _truth(rows, known, k) if known else []:
        true.setdefault(r["dim"], []).append((r["q"], r["embedding"]))
    found = {}
    for dim, near in true.items():
        hasher, of, queries_ = hashers[dim], [q for q, _ in near], _unit(known[dim][1])
        unit, need = _unit(np.array([e for _, e in near])), [hashers[dim].buckets] * len(near)
        for table in range(TABLES):
            gaps, codes = hasher.gaps(queries_, table), hasher.bucket(unit, table)
            need = [min(n, hasher.place([g[q] for g in gaps], int(c))) for n, q, c in zip(need, of, codes)]
        found[dim] = sorted(need)[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]
    return {dim: min(h.buckets, found.get(dim, h.buckets)) for dim, h in hashers.items()}


def _indexed(rows: DataFrame, hashers: dict[int, Hasher], probes: dict[int, int] | None) -> DataFrame:
    """(vec_id, key, code, buckets): a row's bucket in each table, or with ``probes`` the buckets that it asks."""
    first, base = {}, 0
    for dim in sorted(hashers):
        first[dim], base = base, base + hashers[dim].buckets * TABLES

    def run(batches):
        for batch in batches:
            for at, x in _by_length(batch.column(2)) if batch.num_rows else []:
                dim = x.shape[1]
                hasher, unit = hashers[dim], _unit(x)
                step = max(1, (1 << 20) // (probes[dim] * 2 * hasher.size)) if probes else len(x)
                for lo in range(0, len(x), step):
                    part = unit[lo : lo + step]
                    codes = [(hasher.probes(part, t, probes[dim]) if probes else hasher.bucket(part, t)[:, None]) * TABLES + t + first[dim] for t in range(TABLES)]
                    each = np.concatenate(codes, axis=1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * each.shape[1], pa.int32()), pa.array(each.ravel()))
                    where = pa.array(at[lo : lo + step])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), _binary(rounded(part)), lists], names=["vec_id", "key", "code", "buckets"])

    return rows.select("vec_id", "key", "embedding").mapInArrow(run, "vec_id long, key long, code binary, buckets array<long>")


def _candidates(index: DataFrame, asked: DataFrame, cells: int, k: int) -> DataFrame:
    """(q, q_key, vec_id, key) that may be among the k best of those in the asked buckets."""
    left = index.select("vec_id", "key", "code", F.explode("buckets").alias("bucket"))
    right = asked.select("vec_id", "key", "code", F.explode("buckets").alias("bucket"))
    size = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    large = materialize(size(left, "parts").join(size(right, "q_parts"), "bucket").where("parts > 1 or q_parts > 1"), "ann-large")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    mine = lambda c: F.pmod(F.col("key"), F.coalesce(c, F.lit(1))).cast("int")
    left = left.join(large, "bucket", "left").withColumn("part", mine("parts")).withColumn("q_part", every("q_parts"))
    right = right.join(large, "bucket", "left").withColumn("part", every("parts")).withColumn("q_part", mine("q_parts"))
    cell = F.pmod(F.xxhash64("bucket", "part", "q_part"), F.lit(cells)).alias("cell")
    left, right = (df.select(cell, "bucket", "part", "q_part", "vec_id", "key", "code") for df in (left, right))

    def search_cell(base: pa.Table, ask: pa.Table) -> pa.Table:
        out: tuple[list, ...] = tuple([] for _ in range(6))
        if base.num_rows and ask.num_rows:
            order = [(c, "ascending") for c in ("bucket", "part", "q_part")]
            base, ask = base.sort_by(order).combine_chunks(), ask.sort_by(order).combine_chunks()
            places = [[t.column(c).to_numpy() for c in ("bucket", "part", "q_part", "vec_id", "key")] for t in (base, ask)]
            texts = [t.column("code").combine_chunks() if t.num_rows else None for t in (base, ask)]
            cuts = []
            for p in places:
                starts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in p[:3]], axis=0)]))
                cuts.append({tuple(int(x[a]) for x in p[:3]): (int(a), int(b)) for a, b in zip(starts, np.append(starts[1:], len(p[0])))})
            opened = lambda t, a, b: _opened(np.frombuffer(b"".join(t[a:b].to_pylist()), dtype=np.uint8).reshape(b - a, -1))
            for where, (a, b) in cuts[1].items():
                if where not in cuts[0]:
                    continue
                lo, hi = cuts[0][where]
                x, x_error = opened(texts[0], lo, hi)
                for c in range(a, b, 512):
                    d = min(c + 512, b)
                    q, q_error = opened(texts[1], c, d)
                    about = (q @ x.T).astype(np.float64)
                    off = q_error[:, None] + (1 + q_error[:, None]) * x_error[None, :] + 1e-5
                    low, high = about - off, about + off
                    bar = np.partition(low, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1] if hi - lo > k + 1 else np.full(d - c, -np.inf)
                    i, j = np.nonzero(high >= bar[:, None])
                    for column, values in zip(out, (places[1][3][c + i], places[1][4][c + i], places[0][3][lo + j], places[0][4][lo + j], low[i, j], high[i, j])):
                        column.append(values)
        names = ["q", "q_key", "vec_id", "key", "low", "high"]
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, np.int64 if n in names[:4] else np.float64) for n, c in zip(names, out)})

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search_cell, "q long, q_key long, vec_id long, key long, low double, high double")
    found = found.groupBy("q", "q_key", "vec_id", "key").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    of = Window.partitionBy("q", "q_key")
    ranked = found.withColumn("place", F.row_number().over(of.orderBy(F.desc("low")))).withColumn("bar", F.min(F.when(F.col("place") <= k + 1, F.col("low"))).over(of))
    return ranked.where("high >= bar").select("q", "q_key", "vec_id", "key")


def _scores(pairs: DataFrame) -> DataFrame:
    """(q, q_key, vec_id, asked, embedding) to (q, q_key, vec_id, score)."""

    def run(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if batch.num_rows:
                for (rows, q), (_, x) in zip(_by_length(batch.column(3)), _by_length(batch.column(4))):
                    score[rows] = cosines(q, x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["q", "q_key", "vec_id", "score"])

    return pairs.select("q", "q_key", "vec_id", "asked", "embedding").mapInArrow(run, "q long, q_key long, vec_id long, score double")


def search(vectors: DataFrame, is_query, k: int = 5, recall: float = 0.97) -> DataFrame:
    """``vectors`` (vec_id, embedding, ...); ``is_query`` is a condition on vec_id. Returns query_id, rank, vec_id, score."""
    prepare(vectors)
    spark = vectors.sparkSession
    fine = usable(vectors)
    same = Window.partitionBy("key", "embedding").orderBy("vec_id")
    rows = materialize(fine.withColumn("copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1).dropDuplicates(["vec_id", "key"]).drop("copy"), "ann-rows")
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a length
    if not counts:
        return spark.createDataFrame([], SCHEMA)
    asked = fine.where(is_query).select("vec_id", "key", "dim", "embedding").dropDuplicates(["vec_id", "key"])
    queries = materialize(asked.groupBy("key", "embedding").agg(F.min("vec_id").alias("vec_id"), F.first("dim").alias("dim")).select("vec_id", "key", "dim", "embedding"), "ann-queries")
    hashers = {dim: Hasher(n, dim) for dim, n in counts.items()}
    probes = fit_probes(rows, queries, hashers, k, recall)
    index = materialize(_indexed(rows, hashers, None), "ann-index")
    cells = max(1, sum(counts.values()) * TABLES // CELL)
    enough = F.element_at(F.create_map(*[F.lit(x) for dim, n in counts.items() for x in (dim, min(n, k + 1))]), F.col("dim"))
    todo, found = queries, []
    while True:
        pairs = materialize(_candidates(index, materialize(_indexed(todo, hashers, probes), "ann-asked"), cells, k), "ann-pairs")
        met = pairs.groupBy(F.col("q").alias("vec_id"), F.col("q_key").alias("key")).agg(F.count("*").alias("met"))
        few = todo.join(met, ["vec_id", "key"], "left").where(F.coalesce("met", F.lit(0)) < enough).drop("met")
        few = materialize(few.select("vec_id", "key", "dim", "embedding"), "ann-few")
        left = few.count() if any(probes[d] < hashers[d].buckets for d in hashers) else 0
        found.append(pairs.join(few.select(F.col("vec_id").alias("q"), F.col("key").alias("q_key")), ["q", "q_key"], "left_anti") if left else pairs)
        if not left:
            break
        todo, probes = few, {d: min(hashers[d].buckets, 8 * p) for d, p in probes.items()}
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    whole = pairs.join(rows.select("vec_id", "key", "embedding"), ["vec_id", "key"])
    whole = whole.join(queries.select(F.col("vec_id").alias("q"), F.col("key").alias("q_key"), F.col("embedding").alias("asked")), ["q", "q_key"])
    best = Window.partitionBy("q", "q_key").orderBy(F.desc("score"), "vec_id")
    scored = materialize(_scores(whole).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "ann-scores")
    release(index)
    to = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("own"), "embedding").join(queries.select(F.col("vec_id").alias("q"), F.col("key").alias("q_key"), "embedding"), "embedding").select("query_id", "own", "q", "q_key")
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))
    return to.join(scored, ["q", "q_key"]).where(F.col("vec_id") != F.col("query_id")).select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
