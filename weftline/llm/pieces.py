"""SentencePiece encoding and decoding with the N best segmentations.

A text is normalised as the model does it (a leading mark, blanks to marks). The piece lattice falls apart before
every mark that follows another character, as no piece spans such a place (checked when the model is loaded). In a
part, forward Viterbi scores are the exact heuristic of a backward A* search: hypotheses grow from the end, the best
one first, and what reaches the start comes in order of its score. Parts combine exactly: of the N best of a text, none
changes a part outside the N-1 whose second segmentation loses least, so only these are searched beyond the second.

The search runs for many parts at once, one array cell each, up to the second segmentation's score: as the heuristic
is exact, the best hypothesis is always the one just extended, and the best of those left behind gives the second.
Parts that are long, hold characters of rare classes or have near ties, and the parts searched further, go through the
same search one by one, with a heap.

Scores are the model file's (for this BPE model the negated merge ranks), added up over the pieces; a character
without a piece costs ten less than the lowest ordinary score and becomes its bytes.

Awkward rows: null and empty texts have one segmentation without pieces, of score 0; texts with fewer than N
segmentations give fewer rows; equal scores (ties) go to fewer pieces; very long texts and parts are searched whole;
repeated rows and null ids are kept as they come; an empty table gives an empty result; other columns are not read, so
their names don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import prepare, trim_memory

MARK = "▁"
NONE = 0xFFFFFFFF  # stands for an unknown character until its bytes replace it
SCHEMA = "doc_id long, rank int, n_pieces long, ids_crc32 long, score double, n_unknown long, decoded_crc32 long, round_trip boolean"
_MIX = np.random.default_rng(8).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class Pieces:
    def __init__(self, path: str, short: int = 48):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.short = short
        size = model.get_piece_size()
        self.byte_ids = {bytes([int(model.id_to_piece(i)[1:-1], 16)])[0]: i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans a word boundary")
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.unknown = min(s for s in self.score.values() if s > -1e8) - 10
        self.longest = max(map(len, self.ids))
        #: piece to (score, id); a prefix of pieces that is none itself to ()
        self.nodes: dict[str, tuple] = {p[:k]: () for p in self.ids for k in range(1, len(p) + 1)} | {p: (s, self.ids[p]) for p, s in self.score.items()}
        bytes_of = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        own = [bytes_of.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(own), dtype=np.uint8)
        self.sizes = np.array([len(b) for b in own], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.length = {i: len(p) for p, i in self.ids.items()}
        self.searched: dict[tuple[str, int], list] = {}
        self.tables()

    def tables(self, classes: int = 256) -> None:
        """The prefixes of pieces as arrays: ``go`` (node and character class to node; the last two are an unknown character and dead), ``worth`` and ``piece`` of each node.

        Latin characters and the mark have a class first, then those that end most pieces; the last class is for characters in no piece.
        """
        number = {"": 0} | {p: k for k, p in enumerate(self.nodes, 1)}
        unknown, dead = len(number), len(number) + 1
        used = Counter(c for p in self.nodes for c in p[-1] if self.nodes.get(c) and ord(c) < 1 << 16)
        of = {c: k for k, c in enumerate(sorted(used, key=lambda c: (ord(c) >= 0x250 and c != MARK, -used[c], c))[: classes - 1])}
        self.class_of = np.full(1 << 16, classes - 1, dtype=np.int16)
        self.class_of[[ord(c) for c in self.nodes if len(c) == 1 and ord(c) < 1 << 16]] = -1
        self.class_of[[ord(c) for c in of]] = list(of.values())
        self.go = np.full((dead + 1, classes), dead, dtype=np.int32)
        edges = np.array([(number[p[:-1]], of[p[-1]], k) for p, k in number.items() if p and p[-1] in of], dtype=np.int64)
        self.go[edges[:, 0], edges[:, 1]] = edges[:, 2]
        self.go[0, classes - 1] = unknown
        self.worth, self.piece = np.full(dead + 1, -np.inf), np.zeros(dead + 1, dtype="<u4")
        for p, k in number.items():
            if node := self.nodes.get(p):
                self.worth[k], self.piece[k] = node
        self.worth[unknown], self.piece[unknown] = self.unknown, NONE
        self.dead = dead

    def search_equal(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parts of one length as rows of character classes: (score of the best, of the second or -inf, ids from the end, their number)."""
        n, length = codes.shape
        most, rows = min(length, self.longest), np.arange(n)
        node = np.full((length + 1, most + 1, n), self.dead, dtype=np.int32)  # by end and piece length
        ahead = np.full((length + 1, n), -np.inf)
        ahead[0] = 0
        for i in range(length):
            alive, at = rows, np.zeros(n, dtype=np.int32)
            for k in range(1, min(most, length - i) + 1):
                at = self.go[at, codes[alive, i + k - 1]]
                live = at != self.dead
                alive, at = alive[live], at[live]
                if not len(alive):
                    break
                node[i + k, k, alive] = at
                ahead[i + k, alive] = np.maximum(ahead[i + k, alive], ahead[i, alive] + self.worth[at])
        place, behind, second = np.full(n, length), np.zeros(n), np.full(n, -np.inf)
        ids, count = np.zeros((n, length), dtype="<u4"), np.zeros(n, dtype=np.int64)
        sizes = np.arange(1, most + 1)[:, None]
        active = rows
        while len(active):
            here = place[active]
            ways = node[here, sizes, active]
            total = behind[active] + self.worth[ways]
            cost = total + ahead[np.maximum(here - sizes, 0), active]
            best, own = cost.argmax(axis=0), np.arange(len(active))
            taken = ways[best, own]
            behind[active] = total[best, own]
            cost[best, own] = -np.inf
            second[active] = np.maximum(second[active], cost.max(axis=0))
            ids[active, count[active]] = self.piece[taken]
            count[active] += 1
            place[active] = here - best - 1
            active = active[place[active] > 0]
        return behind, second, ids, count

    def search(self, part: str, n: int) -> list[tuple[float, list[int], int]]:
        """The ``n`` best (score, ids, unknown characters), best first; ties by fewer pieces.

        ``edges`` holds the lattice by end; ``ahead`` and ``fewest`` are the forward Viterbi score of each prefix and the
        least number of pieces with it. Both are exact, so a hypothesis never has to be left for one as good.
        """
        length, nodes, longest = len(part), self.nodes, self.longest
        edges: list[list[tuple[int, float, int]]] = [[] for _ in range(length + 1)]
        ahead, fewest = [0.0] + [float("-inf")] * length, [0] * (length + 1)
        for i in range(length):
            base, count = ahead[i], fewest[i] + 1
            for j in range(i + 1, min(length, i + longest) + 1):
                node = nodes.get(part[i:j])
                if not node and j == i + 1:
                    node, goes_on = (self.unknown, -1), node is not None
                elif node is None:
                    break
                else:
                    goes_on = True
                if node:
                    edges[j].append((i, *node))
                    total = base + node[0]
                    if total > ahead[j] or (total == ahead[j] and count < fewest[j]):
                        ahead[j], fewest[j] = total, count
                if not goes_on:
                    break
        heap, order, out = [(-ahead[-1], fewest[-1], length, 0, 0, 0.0, None)], 0, []
        while heap and len(out) < n:
            _, _, at, _, depth, behind, tail = heappop(heap)
            while at:
                # Follow the best way on at once, and put the others on the heap.
                best, depth = None, depth + 1
                for i, s, piece in edges[at]:
                    total = behind + s
                    order += 1
                    way = (-(total + ahead[i]), depth + fewest[i], i, order, depth, total, (piece, i, at, tail))
                    if best is None or way < best:
                        best, way = way, best
                    if way is not None:
                        heappush(heap, way)
                if heap and heap[0] < best:
                    best = heapreplace(heap, best)
                _, _, at, _, depth, behind, tail = best
            ids, unknown = [], 0
            while tail:
                piece, start, end, tail = tail
                if piece < 0:
                    unknown += 1
                    ids.extend(self.byte_ids[b] for b in part[start:end].encode("utf-8", "replace"))
                else:
                    ids.append(piece)
            out.append((behind, ids, unknown))
        return out

    def of_part(self, part: str, n: int) -> list[tuple[float, list[int], int]]:
        """``search``, remembered for short parts."""
        if (found := self.searched.get((part, n))) is None:
            found = self.search(part, n)
            if len(part) <= self.short:
                if len(self.searched) > 50_000:
                    self.searched.clear()
                self.searched[part, n] = found
        return found

    def spell(self, part: str, ids: list[int]) -> tuple[np.ndarray, int]:
        """``ids`` with the bytes of unknown characters, and how many these are."""
        out, at, strange = [], 0, 0
        for i in ids:
            if i == NONE:
                out.extend(self.byte_ids[b] for b in part[at].encode("utf-8", "replace"))
                at, strange = at + 1, strange + 1
            else:
                out.append(i)
                at += self.length[i]
        return np.array(out, dtype="<u4"), strange

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, marks included."""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.sizes[ids]
        at = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[ids] - at, sizes) + np.arange(int(sizes.sum()))]

    def decode(self, ids) -> str:
        text = self.raw(ids).tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def parts(self, texts: list[str | None]):
        """All parts of the texts: (the normalised texts in one, first part of each text, start and length of each part)."""
        normal = [self.normal(t or "") for t in texts]
        whole = "".join(normal)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) for t in normal], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        mark = points == ord(MARK)
        opens = mark.copy()
        opens[1:] &= ~mark[:-1]
        opens[begins[sizes > 0]] = True
        start = np.flatnonzero(opens)
        length = np.diff(np.append(start, len(points)))
        return whole, points, np.searchsorted(start, np.append(begins, len(points))), start, length

    def best_two(self, whole: str, points: np.ndarray, start: np.ndarray, length: np.ndarray, cells: int = 1 << 21):
        """Of each part the ids of the best segmentation, its score, its lead over the second (inf if there is none) and its unknown characters: (ids one after another, number of ids, score, lead, unknown)."""
        n = len(start)
        score, lead, strange = np.zeros(n), np.full(n, np.inf), np.zeros(n, dtype=np.int64)
        count, at_pool = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        pool: list[np.ndarray] = []
        pooled = 0

        def keep(own: np.ndarray) -> int:
            nonlocal pooled
            pool.append(own)
            pooled += len(own)
            return pooled - len(own)

        classes = np.where(points < 1 << 16, self.class_of[np.minimum(points, (1 << 16) - 1)], -1)
        fits = (np.minimum.reduceat(classes, start) >= 0) & (length <= self.short) if n else np.zeros(0, bool)
        order = np.argsort(np.where(fits, length, 0), kind="stable")
        cuts = np.searchsorted(np.where(fits, length, 0)[order], np.arange(self.short + 2))
        alone = [order[: cuts[1]]]
        for size in range(1, self.short + 1):
            mine = order[cuts[size] : cuts[size + 1]]
            if not len(mine):
                continue
            rows = classes[start[mine][:, None] + np.arange(size)]
            _, first, same = np.unique((rows.astype(np.uint64) + np.uint64(1)) @ _MIX[:size], return_index=True, return_inverse=True)
            if (rows[first][same] != rows).any():  # two rows with one hash
                first = same = np.arange(len(rows))
            each = rows[first]
            step = max(1, cells // (size * min(size, self.longest)))
            for lo in range(0, len(each), step):
                best, second, ids, number = self.search_equal(each[lo : lo + step])
                used = np.arange(size)[None, :] < number[:, None]
                forward = np.take_along_axis(ids, np.maximum(number[:, None] - 1 - np.arange(size)[None, :], 0), axis=1)
                base = keep(forward[used])
                here = np.flatnonzero((same >= lo) & (same < lo + step)) if len(each) > step else np.arange(len(mine))
                of, to = same[here] - lo, mine[here]
                score[to], lead[to], count[to] = best[of], (best - second)[of], number[of]
                at_pool[to] = base + (np.cumsum(number) - number)[of]
                odd = (best - second <= 1e-6)[of]
                unknown = ((ids == NONE) & used).any(axis=1)[of] & ~odd
                alone.append(to[odd])
                for p, k in zip(to[unknown].tolist(), of[unknown].tolist()):
                    own, strange[p] = self.spell(whole[start[p] : start[p] + size], forward[k, : number[k]].tolist())
                    at_pool[p], count[p] = keep(own), len(own)
        for p in np.concatenate(alone).tolist():
            found = self.of_part(whole[start[p] : start[p] + length[p]], 2)
            score[p], strange[p] = found[0][0], found[0][2]
            lead[p] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            at_pool[p], count[p] = keep(np.array(found[0][1], dtype="<u4")), len(found[0][1])
        flat = np.concatenate(pool) if pool else np.zeros(0, dtype="<u4")
        ends = np.cumsum(count)
        ids = flat[np.repeat(at_pool - (ends - count), count) + np.arange(int(ends[-1]) if n else 0)]
        return ids.astype("<u4", copy=False), count, score, lead, strange

    def combine(self, parts: list[str], loose: list[int], n: int) -> list[tuple[float, dict[int, tuple]]]:
        """The ``n`` best changes of a text: (loss, segmentation of each part that is not at its best), where ``loose`` are the parts with the smallest leads."""
        combos: list[tuple[float, dict[int, tuple]]] = [(0.0, {})]
        for k in loose:
            found = self.of_part(parts[k] if isinstance(parts, list) else parts(k), n)
            ways = [(found[0][0] - f[0], {} if r == 0 else {k: f}) for r, f in enumerate(found)]
            combos = sorted(((loss + d, at | change) for loss, at in combos for d, change in ways), key=lambda c: (c[0], len(c[1])))[:n]
        return combos

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The N best (score, ids) of a whole text."""
        return [(r[2], r[5].tolist()) for r in self.rows([text], n, with_ids=True)[0]]

    def rows(self, texts: list[str | None], n: int, with_ids: bool = False) -> list[list[tuple]]:
        """For each text its segmentations: (pieces, crc of the ids, score, unknown characters, decoded bytes' crc, ids)."""
        whole, points, firsts, start, length = self.parts(texts)
        ids, count, score, lead, strange = self.best_two(whole, points, start, length)
        raw = self.raw(ids)
        id_ends = np.cumsum(count)
        raw_ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        raw_at = raw_ends[np.concatenate([[0], id_ends])]
        id_at = np.concatenate([[0], id_ends])
        text_of = np.repeat(np.arange(len(texts)), np.diff(firsts))
        ranked = np.lexsort((np.arange(len(start)), lead, text_of))
        mark, out = MARK.encode(), []
        sums, strange_sums = (np.concatenate([[0], np.cumsum(x)]) for x in (score, strange))
        for t in range(len(texts)):
            a, b = int(firsts[t]), int(firsts[t + 1])
            loose = [int(p) for p in ranked[a : min(a + n - 1, b)] if lead[p] < np.inf]
            combos = self.combine(lambda p: whole[start[p] : start[p] + length[p]], loose, n)
            own = ids[id_at[a] : id_at[b]]
            first_raw = raw[raw_at[a] : raw_at[b]].tobytes()
            base, unknown = float(sums[b] - sums[a]), int(strange_sums[b] - strange_sums[a])
            found = []
            for loss, changes in combos:
                if changes:
                    pieces, spelled, at, odd = [], [], a, unknown
                    for p in sorted(changes):
                        _, changed, unknown_there = changes[p]
                        pieces += [ids[id_at[at] : id_at[p]], np.array(changed, dtype="<u4")]
                        spelled += [raw[raw_at[at] : raw_at[p]].tobytes(), self.raw(changed).tobytes()]
                        odd += unknown_there - int(strange[p])
                        at = p + 1
                    now = np.concatenate([*pieces, ids[id_at[at] : id_at[b]]])
                    text = b"".join([*spelled, raw[raw_at[at] : raw_at[b]].tobytes()])
                else:
                    now, text, odd = own, first_raw, unknown
                # The bytes of a mark in the text and of a blank's mark decode alike, as the model defines it.
                decoded = text.replace(mark, b" ")
                decoded = decoded[1:] if decoded.startswith(b" ") else decoded
                found.append((len(now), zlib.crc32(now.tobytes()), base - loss, odd, decoded, now if with_ids else None))
            out.append(found)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str | None = None, n: int = 4) -> DataFrame:
    """``docs`` (doc_id, text, ...) to one row for each of a text's ``n`` best segmentations, best first: a digest of its ids, its score, and whether it decodes to the text."""
    prepare(docs)
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        pieces, mark = load(model), MARK.encode()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 1 << 20):
                    size += len(texts[hi] or "")
                    hi += 1
                rows = []
                for doc_id, text, found in zip(ids[lo:hi], texts[lo:hi], pieces.rows(texts[lo:hi], n)):
                    own = (text or "").encode("utf-8", "replace").replace(mark, b" ")
                    for rank, (number, crc, score, unknown, decoded, _) in enumerate(found, 1):
                        rows.append((doc_id, rank, number, crc, score, unknown, zlib.crc32(decoded), decoded == own))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])
                lo = hi
        trim_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
