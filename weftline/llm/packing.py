"""Order-preserving packing by dynamic programming.

The documents of a partition form one stream of ids in row order. Cuts may lie at document ends (free),
sentence ends (a small truncation penalty) or, where neither comes for a while, every ``GAP`` ids (a
larger one). ``best[j]``, the least padding plus penalties up to boundary j, is the minimum over the
boundaries of the last ``size`` ids; a monotone queue over ``best[i] + position[i]`` yields it in
constant time. Windows whose length is a power of two need no padding and are tried as well. A stream is
solved buffer by buffer; the last windows of a buffer go into the next one and are solved again, so seams cost
next to nothing (a test holds the padding against that of a stream solved whole). Memory is bounded by one buffer
and the longest document.

Awkward rows: null and empty texts are their closing id; very long texts are cut into as many pieces as they need,
none of their ids is dropped; null and repeated ids are kept as they come; of windows that cost the same (ties) the
longest wins; an empty table gives no pieces; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import prepare
from weftline.llm.tokens import byte_bpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
GAP, SENTENCE, FORCED, BUFFER, HELD = 128, 2.0, 24.0, 1 << 19, 8
END_ID = 0


def cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indices of the boundaries (``at`` ascending from 0, gaps of ``size`` at most) that end windows, first and last included."""
    m = len(at)
    where = np.full(at[-1] + 1, -1, dtype=np.int32)
    where[at] = np.arange(m)
    ends, begins, power = [], [], 1
    while power <= size:  # windows whose length is a power of two
        far = int(np.searchsorted(at, power))
        i = where[at[far:] - power]
        hit = np.flatnonzero(i >= 0)
        ends.append(hit + far)
        begins.append(i[hit])
        power *= 2
    order = np.argsort(np.concatenate(ends), kind="stable")
    exact_end, exact_begin, e = [*np.concatenate(ends)[order].tolist(), m], np.concatenate(begins)[order].tolist(), 0
    at, penalty = at.tolist(), penalty.tolist()
    best, back = [0.0] * m, [0] * m
    queue, keys, head = [0], [0.0], 0  # boundaries with ascending best + position
    next_exact = exact_end[0]
    for j in range(1, m):
        here = at[j]
        least = here - size
        while at[queue[head]] < least:
            head += 1
        i = queue[head]
        cost = keys[head] - least
        while next_exact == j:
            if best[exact_begin[e]] < cost:
                i = exact_begin[e]
                cost = best[i]
            e += 1
            next_exact = exact_end[e]
        cost += penalty[j]
        best[j], back[j] = cost, i
        key = cost + here
        while keys[-1] >= key and len(queue) > head:
            queue.pop()
            keys.pop()
            if not keys:
                break
        queue.append(j)
        keys.append(key)
    path = [m - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


class Packer:
    def __init__(self, path: str, size: int, stream: int):
        self.bpe, self.size = byte_bpe(path), size
        ends = [bool(p) and (p.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in p) for p in self.bpe.pieces]
        self.ends_sentence = np.array([*ends, False])
        self.next = stream << 36
        self.ids, self.docs = [], []  # of the buffer; docs: [doc_id, ids before the buffer, ids in it, total]
        self.held = 0

    def add(self, doc_ids: list, texts: list[str]) -> pa.RecordBatch | None:
        ids, ends = self.bpe.encode(texts)
        ends = ends + np.arange(1, len(texts) + 1)
        whole = np.full(len(ids) + len(texts), END_ID, dtype="<u4")
        is_id = np.ones(len(whole), dtype=bool)
        is_id[ends - 1] = False
        whole[is_id] = ids
        self.ids.append(whole)
        for doc_id, n in zip(doc_ids, np.diff(ends, prepend=0).tolist()):
            self.docs.append([doc_id, 0, n, n])
        self.held += len(whole)
        return self.flush() if self.held >= BUFFER else None

    def flush(self, last: bool = False) -> pa.RecordBatch | None:
        if not self.docs:
            return None
        ids = np.concatenate(self.ids)
        doc_ends = np.cumsum([d[2] for d in self.docs])
        total = int(doc_ends[-1])
        soft = np.flatnonzero(self.ends_sentence[ids]) + 1
        rank = np.full(total + 1, 3, dtype=np.int8)
        rank[soft] = 1
        rank[doc_ends] = rank[0] = 0
        at = np.flatnonzero(rank < 3)
        wide = np.flatnonzero(np.diff(at) > GAP)
        if len(wide):
            extra = np.concatenate([np.arange(at[i] + GAP, at[i + 1], GAP) for i in wide])
            rank[extra] = 2
            at = np.flatnonzero(rank < 3)
        penalty = np.array([0.0, SENTENCE, FORCED])[rank[at]]
        path = cuts(at, penalty, self.size)
        ends = at[path]
        if not last and len(ends) > HELD + 1:
            ends = ends[:-HELD]
        stop = int(ends[-1])
        edges = np.union1d(ends, doc_ends[doc_ends < stop])
        lo, hi = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, lo, side="right")
        window = np.searchsorted(ends, lo, side="right") - 1
        before = np.array([d[1] for d in self.docs]) - np.concatenate([[0], doc_ends[:-1]])
        raw = ids.tobytes()
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
                pa.array(lo + before[doc], pa.int64()),
                pa.array(hi - lo, pa.int64()),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist())], pa.int64()),
                pa.array([self.docs[i][3] for i in doc.tolist()], pa.int64()),
                pa.array(window + self.next, pa.int64()),
                pa.array(lo - ends[window], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.next += len(ends) - 1
        gone = int(np.searchsorted(doc_ends, stop, side="right"))
        rest = self.docs[gone:]
        if rest:
            taken = stop - int(doc_ends[gone - 1] if gone else 0)
            rest[0][1] += taken
            rest[0][2] -= taken
        self.docs, self.ids, self.held = rest, [ids[stop:]], total - stop
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 1024) -> DataFrame:
    """``docs`` (doc_id, text, ...) to one row per piece; no shuffle, each partition is a stream of its own."""
    prepare(docs)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        packer = Packer(tokenizer, size, TaskContext.get().partitionId())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 64):
                out = packer.add(ids[lo : lo + 64], [t or "" for t in texts.slice(lo, 64).to_pylist()])
                if out is not None:
                    yield out
        if (out := packer.flush(last=True)) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
