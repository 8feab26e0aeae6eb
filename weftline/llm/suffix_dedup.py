"""Removal of bytes covered by long strings that also start in an earlier document.

Windows of ``size`` bytes are dealt by their minimizer (the k-mer of least hash in it), so equal windows
meet in one bucket, as parts of segments: runs of windows with one minimizer. Segments whose minimizer
lies in one document only are left out first. In a bucket, equal segments become one, which is repeated in
all documents but its smallest; those that share their minimizer with others form a collection, built column by column (``collection``): each round inserts one more symbol of every segment into the collection's
Burrows-Wheeler transform and updates the common prefixes of neighbours, through sequential files in the
shared folder. Neighbours in the final order with a common prefix of ``size`` form an interval, and its
windows are repeats in all but its smallest document.

Segments are at most 76 bytes long, so that is the number of rounds, however long the documents. The files
belong to one task's attempt: a lost executor's buckets are built anew. Texts are cut into chunks that are
written once, so all passes see the same chunks. Minimizers met in very many chunks are dealt by whole
windows instead, so no bucket holds all neighbours of one frequent line.

Awkward rows: documents with a null id are kept whole and remove nothing; rows with the same id (repeated rows,
too) don't remove from one another; null and empty texts have no bytes; texts of any length are read whole, and a
very long one is a chunk of its own; of equal windows those of the smallest id stay (ties: all of that id);
an empty table gives an empty result; other columns are handed through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.collection import Store, build, read
from weftline.llm.common import materialize, prepare, release, remove, scratch_path, trim_memory

SIZE, K = 50, 24
CHUNK, BUCKET, HOT, TASK = 1 << 20, 8 << 20, 20_000, 16 << 20
_U = np.uint64
_TABLE = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64)
_A = np.random.default_rng(7).integers(1 << 62, 1 << 63, 6, dtype=np.uint64) | _U(1)


def _kmers(buf: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each position."""
    h, width, parts = _TABLE[buf], 1, {}
    for i in range(5):
        parts[width] = h
        if width * 2 > K:
            break
        h = h[:-width] * _A[i] + h[width:]
        width *= 2
    h, done = parts[16], 16
    h = h[: len(buf) - K + 1] * _A[5] + parts[8][done : done + len(buf) - K + 1]
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Sliding minimum over ``span`` values."""
    width, n = 1, len(h) - span + 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:n], h[span - width : span - width + n])


class Segments:
    """Of a chunk: ``start``, ``windows`` (count) and ``doc`` (index) of each segment, and its ``key`` (bucket in the upper bits)."""

    def __init__(self, buf: np.ndarray, lens: np.ndarray, has_id: np.ndarray, buckets: int):
        self.buf, self.buckets = buf, buckets
        ends = np.cumsum(lens)
        empty = np.zeros(0, np.int64)
        self.start, self.windows, self.doc, self.key = empty, empty, empty, empty
        if len(buf) < SIZE:
            return
        least = _least(_kmers(buf), SIZE - K + 1)
        n = len(least)
        valid = np.zeros(n + 1, dtype=np.int8)
        long = np.flatnonzero((lens >= SIZE) & has_id)
        mark = np.zeros(len(buf) + 1, dtype=np.int8)
        mark[ends[long] - lens[long]] += 1
        np.subtract.at(mark, ends[long] - SIZE + 1, 1)
        valid = np.cumsum(mark[:n], dtype=np.int8).astype(bool)
        new = np.ones(n, dtype=bool)
        new[1:] = least[1:] != least[:-1]
        first = ends - lens
        new[first[first < n]] = True
        new[1:] |= valid[1:] != valid[:-1]
        run = np.flatnonzero(new)
        size = np.diff(np.append(run, n))
        keep = valid[run]
        run, size = run[keep], size[keep]
        most = SIZE - K + 1
        pieces = -(-size // most)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = np.repeat(run, pieces) + piece * most
        self.windows = np.minimum(most, np.repeat(size, pieces) - piece * most)
        self.doc = np.searchsorted(ends, self.start, side="right")
        h = least[self.start]
        self.key = ((h >> _U(32)) % _U(buckets) << _U(32) | h & _U(0xFFFFFFFF)).astype(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and whether several documents here hold each."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        if not len(key):
            return key, np.zeros(0, bool)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.append(at[1:], len(key)) - 1
        return key[at], doc[at] != doc[last]

    def shared(self, keys: np.ndarray, shared: np.ndarray, hot: np.ndarray, ids: np.ndarray):
        """Distinct contents of segments with a shared key, in a fixed order: (bucket, start, windows, smallest id, lower half of the key), and for each occurrence (start, windows, id, content)."""
        at = np.searchsorted(keys, self.key)
        pick = shared[at] if len(at) else np.zeros(0, bool)
        start, windows, doc, key = self.start[pick], self.windows[pick], self.doc[pick], self.key[pick]
        if (split := hot[at[pick]] if len(at) else np.zeros(0, bool)).any():
            n = np.where(split, windows, 1)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            single = np.repeat(split, n)
            start, windows, doc, key = np.repeat(start, n) + off, np.where(single, 1, np.repeat(windows, n)), np.repeat(doc, n), np.repeat(key, n)
            own = _TABLE[self.buf[start[single][:, None] + np.arange(SIZE)]] * (np.arange(1, SIZE + 1, dtype=np.uint64) * _A[0] | _U(1))
            h = own.sum(axis=1, dtype=np.uint64)
            h = (h ^ (h >> _U(31))) * _A[1]
            key[single] = ((h >> _U(32)) % _U(self.buckets) << _U(32) | h & _U(0xFFFFFFFF)).astype(np.int64)
        width = 2 * SIZE - K + 1
        rows = np.zeros((len(start), width), dtype=np.uint8)
        padded = np.concatenate([self.buf, np.zeros(width, np.uint8)])
        for lo in range(0, len(start), 1 << 15):
            s, w = start[lo : lo + (1 << 15)], windows[lo : lo + (1 << 15)]
            got = padded[s[:, None] + np.arange(width)]
            got[np.arange(width)[None, :] >= (w + SIZE - 1)[:, None]] = 0
            got[:, -1] = w
            rows[lo : lo + (1 << 15)] = got
        content, order, first = distinct(rows, key >> 32)
        ids = ids[doc]
        least = np.minimum.reduceat(ids[order], first) if len(order) else np.zeros(0, np.int64)
        lead = order[first] if len(order) else order
        return (key[lead] >> 32, start[lead], windows[lead], least, (key[lead] & 0xFFFFFFFF).astype(np.uint32)), (start, windows, ids, content)


def distinct(rows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal rows, ordered by bucket: (group of each row, an order that sorts by group, where groups start in it)."""
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(np.uint64)
    a = np.zeros(len(rows), dtype=np.uint64)
    for i in range(words.shape[1]):
        a = (a ^ words[:, i]) * _A[2]
        a ^= a >> _U(31)
    order = np.lexsort((a, bucket))
    # Rows with one hash are told apart by their bytes: sorted fully where a hash is met with different bytes.
    same = (words[order][1:] == words[order][:-1]).all(axis=1)
    tie = (a[order][1:] == a[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
    if (tie & ~same).any():
        order = np.lexsort((*words.T[::-1], bucket))
        same = (words[order][1:] == words[order][:-1]).all(axis=1) & (bucket[order][1:] == bucket[order][:-1])
    first = np.flatnonzero(np.concatenate([[True], ~(same & (bucket[order][1:] == bucket[order][:-1]))]))
    group = np.empty(len(rows), dtype=np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return group, order, first


def repeats(text: np.ndarray, windows: np.ndarray, ids: np.ndarray, store: Store) -> np.ndarray:
    """For each segment (one after another in ``text``) a mask of the windows that also occur with a smaller id."""
    if not len(windows):
        return np.zeros(0, dtype=np.uint32)
    lens = (windows + SIZE - 1).astype(np.int64)
    rounds = build(text, np.cumsum(lens), lens, SIZE, store)
    segment, window, shared = (np.concatenate(x) for x in zip(*read(store, rounds)))
    first = np.flatnonzero(shared < SIZE)
    least = np.repeat(np.minimum.reduceat(ids[segment], first), np.diff(np.append(first, len(segment))))
    again = least < ids[segment]
    return np.bincount(segment[again], weights=2.0 ** window[again], minlength=len(windows)).astype(np.uint32)


def sort_bucket(text: np.ndarray, windows: np.ndarray, ids: np.ndarray, keys: np.ndarray, store: Store) -> np.ndarray:
    """Masks of repeated windows for segments that may be equal. Equal ones are one string of the collection, and one whose minimizer no other has is none: it shares no window."""
    lens = windows + SIZE - 1
    starts = np.cumsum(lens) - lens
    rows = np.zeros((len(windows), 2 * SIZE - K + 1), dtype=np.uint8)
    cell = np.arange(rows.shape[1])
    last = len(text) - 1
    for lo in range(0, len(windows), 1 << 13):
        got = text[np.minimum(starts[lo : lo + (1 << 13), None] + cell, last)]
        got[cell[None, :] >= lens[lo : lo + (1 << 13), None]] = 0
        got[:, -1] = windows[lo : lo + (1 << 13)]
        rows[lo : lo + (1 << 13)] = got
    group, order, first = distinct(rows, np.zeros(len(windows), np.int64))
    del rows
    least = np.minimum.reduceat(ids[order], first)
    lead = order[first]
    _, of, count = np.unique(keys[lead], return_inverse=True, return_counts=True)
    together = np.flatnonzero(count[of] > 1)
    own = lead[together]
    n = lens[own]
    at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    masks = np.zeros(len(lead), dtype=np.uint32)
    masks[together] = repeats(text[at], windows[own], least[together], store)
    # The content itself may stand in another chunk with a smaller id: then all its windows repeat.
    return np.where(ids > least[group], (1 << windows) - 1, masks[group]).astype(np.uint32)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _chunks(docs: DataFrame) -> DataFrame:
    """Rows of about CHUNK bytes: (chunk, size, ids, lens, data, rest), ``rest`` the other columns as an Arrow stream."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches):
        number, held, bytes_held = TaskContext.get().partitionId() << 24, [], 0

        def row():
            nonlocal number, held, bytes_held
            table = pa.Table.from_batches(held)
            ids, data = table.column(0), [b or b"" for b in table.column(1).to_pylist()]
            known = np.array(ids.is_valid().to_pylist(), dtype=np.int64)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (own := table.select(list(range(2, table.num_columns))).combine_chunks()).schema) as out:
                out.write_table(own)
            whole = b"".join(data)
            cells = [[number], [len(whole)], [np.stack([np.array(ids.fill_null(0).to_pylist(), dtype=np.int64), known]).tobytes()], [np.array([len(b) for b in data], dtype=np.int64).tobytes()], [_pack(whole)], [sink.getvalue().to_pybytes()]]
            number, held, bytes_held = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, [pa.int64()] * 2 + [pa.binary()] * 4)], names=["chunk", "size", "ids", "lens", "data", "rest"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                held.append(part)
                bytes_held += sum(len(b or b"") for b in part.column(1).to_pylist())
                if bytes_held >= CHUNK:
                    yield row()
        if held:
            yield row()
        trim_memory()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *rest)
    return plain.mapInArrow(run, "chunk long, size long, ids binary, lens binary, data binary, rest binary")


def _open(row: pa.Table, buckets: int) -> tuple[Segments, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.column("ids")[0].as_py(), dtype=np.int64).reshape(2, -1)
    lens = np.frombuffer(row.column("lens")[0].as_py(), dtype=np.int64)
    buf = np.frombuffer(_unpack(row.column("data")[0].as_py()), dtype=np.uint8)
    return Segments(buf, lens, ids[1] > 0, buckets), ids[0], lens


def _cut(bucket: np.ndarray):
    """(bucket, from, to) of the runs in sorted ``bucket``."""
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(bucket)))] if len(bucket) else []


def _bits(rows: pa.Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared and hot flags of a chunk's keys from its rows of kind 0."""
    shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    where = {b: (lo, hi) for b, lo, hi in _cut(keys >> 32)}
    for kind, bucket, a, b in zip(*[rows.column(c).to_pylist() for c in ("kind", "bucket", "a", "b")]):
        if kind == 0:
            lo, hi = where[bucket]
            shared[lo:hi] = np.unpackbits(np.frombuffer(a, np.uint8), count=hi - lo)
            hot[lo:hi] = np.unpackbits(np.frombuffer(b, np.uint8), count=hi - lo)
    return shared, hot


_REPLY = "chunk long, bucket int, kind int, a binary, b binary"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, texts: bool = False, hot: int = HOT, count_as: str = "n_removed") -> DataFrame:
    """``docs`` (doc_id, text, ...) to the digest, or with ``texts`` to its columns with what is left of the text (a character cut in two goes whole) and ``count_as``, the bytes taken out."""
    prepare(docs)
    spark = docs.sparkSession
    if not texts:
        docs = docs.select("doc_id", "text")
    rest_schema = docs.select(*[c for c in docs.columns if c not in ("doc_id", "text")]).schema
    chunks = materialize(_chunks(docs), "repeats-chunks")
    n_bytes = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(16, n_bytes // BUCKET)
    tasks = max(8, n_bytes // TASK)  # so that a task's share doesn't grow with the input
    dealt = lambda df, key: df.repartition(tasks, key).groupBy(key)
    folder = scratch_path(spark, "repeats-files")

    def post(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                segments, *_ = _open(pa.Table.from_batches([batch.slice(k, 1)]), buckets)
                keys, several = segments.keys()
                cut = _cut(keys >> 32)
                low = (keys & 0xFFFFFFFF).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, *_ in cut], pa.int32()),
                        pa.array([batch.column(0)[k].as_py()] * len(cut), pa.int64()),
                        pa.array([low[lo:hi].tobytes() for _, lo, hi in cut], pa.binary()),
                        pa.array([np.packbits(several[lo:hi]).tobytes() for _, lo, hi in cut], pa.binary()),
                    ],
                    names=["bucket", "chunk", "keys", "several"],
                )
        trim_memory()

    def meet(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("several").to_pylist(), keys)])
        _, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = (count > 1) | (np.bincount(at, weights=several) > 0)
        a, b = [], []
        ends = np.cumsum([len(k) for k in keys])
        for k, end in zip(keys, ends):
            own = at[end - len(k) : end]
            a.append(np.packbits(shared[own]).tobytes())
            b.append(np.packbits(count[own] >= hot).tobytes())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "kind": pa.array([0] * len(a), pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    posted = chunks.select("chunk", "ids", "lens", "data").mapInArrow(post, "bucket int, chunk long, keys binary, several binary")
    flags = materialize(dealt(posted, "bucket").applyInArrow(meet, _REPLY), "repeats-flags")

    def send(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        out: tuple[list, ...] = tuple([] for _ in range(6))
        if chunk.num_rows:
            segments, ids, _ = _open(chunk, buckets)
            keys, _ = segments.keys()
            (bucket, start, windows, least, low), _ = segments.shared(keys, *_bits(reply, keys), ids)
            for b, lo, hi in _cut(bucket):
                out[0].append(b)
                out[1].append(chunk.column("chunk")[0].as_py())
                out[2].append(windows[lo:hi].astype(np.uint8).tobytes())
                out[3].append(least[lo:hi].tobytes())
                n = windows[lo:hi] + SIZE - 1
                at = np.repeat(start[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out[4].append(_pack(segments.buf[at].tobytes()))
                out[5].append(low[lo:hi].tobytes())
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["bucket", "chunk", "windows", "ids", "data", "low"])

    def sort(table: pa.Table) -> pa.Table:
        windows = [np.frombuffer(x, np.uint8) for x in table.column("windows").to_pylist()]
        text = np.concatenate([np.frombuffer(_unpack(x), np.uint8) for x in table.column("data").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()])
        at = TaskContext.get()
        store = Store(f"{folder}/{at.stageId()}-{at.taskAttemptId()}-{table.column('bucket')[0].as_py()}")
        try:
            masks = sort_bucket(text, np.concatenate(windows).astype(np.int64), ids, low, store)
        finally:
            store.close()
        ends = np.cumsum([len(w) for w in windows])
        cells = [masks[e - len(w) : e].tobytes() for w, e in zip(windows, ends)]
        found = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "kind": pa.array([1] * len(cells), pa.int32()), "a": pa.array(cells, pa.binary()), "b": pa.array([b""] * len(cells), pa.binary())})
        del windows, text, ids, masks
        trim_memory()
        return found

    plain = chunks.select("chunk", "ids", "lens", "data")
    sent = dealt(plain, "chunk").cogroup(dealt(flags, "chunk")).applyInArrow(send, "bucket int, chunk long, windows binary, ids binary, data binary, low binary")
    masks = materialize(dealt(sent, "bucket").applyInArrow(sort, _REPLY), "repeats-masks")
    remove(spark, folder)

    def finish(chunk: pa.Table, reply: pa.Table) -> pa.Table | None:
        rows: list[tuple] = []
        rest = None
        if chunk.num_rows:
            segments, ids, lens = _open(chunk, buckets)
            keys, _ = segments.keys()
            (bucket, _, _, least, _), (start, windows, own, content) = segments.shared(keys, *_bits(reply, keys), ids)
            mask = np.zeros(len(bucket), dtype=np.int64)
            where = {b: (lo, hi) for b, lo, hi in _cut(bucket)}
            for kind, b, a in zip(*[reply.column(c).to_pylist() for c in ("kind", "bucket", "a")]):
                if kind == 1:
                    lo, hi = where[b]
                    mask[lo:hi] = np.frombuffer(a, np.uint32)
            mine = np.where(own > least[content], (1 << windows) - 1, mask[content]) if len(content) else np.zeros(0, np.int64)
            edge = np.zeros(len(segments.buf) + 1, dtype=np.int32)
            for off in range(SIZE - K + 1):
                hit = start[(mine >> off) & 1 == 1] + off
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + SIZE, -1)
            gone = np.cumsum(edge[:-1]) > 0
            known = np.frombuffer(chunk.column("ids")[0].as_py(), dtype=np.int64).reshape(2, -1)[1]
            at = 0
            for d, n in enumerate(lens.tolist()):
                mark, body = gone[at : at + n], segments.buf[at : at + n]
                at += n
                kept = body[~mark].tobytes()
                removed = n - len(kept)
                spans = int(mark[0]) + int((mark[1:] & ~mark[:-1]).sum()) if n else 0
                doc_id = int(ids[d]) if known[d] else None
                rows.append((doc_id, kept.decode("utf-8", "ignore"), removed) if texts else (doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest()))
            if texts:
                rest = pa.ipc.open_stream(chunk.column("rest")[0].as_py()).read_all()
        kinds = [pa.int64(), pa.string(), pa.int64()] if texts else [pa.int64()] * 4 + [pa.string()]
        names = ["doc_id", "text", count_as] if texts else [c.split()[0] for c in DIGEST.split(", ")]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)]
        if texts and rest_schema.names:
            rest = rest if rest is not None else empty
            columns += [rest.column(c).combine_chunks() for c in rest_schema.names]
            names = names + rest_schema.names
        return pa.table(columns, names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    empty = to_arrow_schema(rest_schema).empty_table()
    replies = flags.unionByName(masks)
    if texts:
        fields = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField(count_as, LongType()), *rest_schema.fields])
        return dealt(chunks.drop("size"), "chunk").cogroup(dealt(replies, "chunk")).applyInArrow(finish, fields)
    found = materialize(dealt(plain, "chunk").cogroup(dealt(replies, "chunk")).applyInArrow(finish, DIGEST), "repeats-digest")
    release(chunks, flags, masks)
    return found
