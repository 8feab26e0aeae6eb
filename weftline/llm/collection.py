"""Column-wise construction of the Burrows-Wheeler transform and the common prefixes of a collection of strings.

Round j inserts, for every string longer than j, its suffix of length j + 1 among all suffixes so far: by rank, that
is, by the number of smaller symbols plus the number of equal symbols ahead of the place where the string's last
suffix lies. Ranks and common prefixes come from one sequential pass over the transform, block by block, with a
counter and a running minimum a symbol; the same pass writes the files of the next round. So a round reads and
writes each file once from its start to its end, and memory holds one block and a few numbers a string.

The files of a collection are: for each suffix, in order, the symbol before it and the length of the prefix that it
shares with the suffix ahead of it (in the upper bit whether it is at least ``size`` long); and for these long suffixes
which string and which place in it they are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs

SEPARATOR = 0xFF  # no byte of UTF-8; stands before the first symbol of a string
LONG = 0x80
BLOCK = 1 << 18
PAIR = np.dtype("<u2")  # a symbol in the upper byte, a prefix in the lower


class _Held(io.BytesIO):
    def close(self) -> None:
        """Stays readable."""


class Store:
    """Sequential files in a folder (a path or URI that Arrow can open; else, and for None, in memory), gone after ``close``."""

    def __init__(self, folder: str | None):
        self.held: dict[str, _Held] = {}
        self.fs = None
        if folder is not None:
            try:
                self.fs, self.folder = arrow_fs.FileSystem.from_uri(folder) if "://" in folder else (arrow_fs.LocalFileSystem(), folder.removeprefix("file:"))
                self.fs.create_dir(self.folder, recursive=True)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                self.fs = None

    def writer(self, name: str):
        if self.fs:
            return self.fs.open_output_stream(f"{self.folder}/{name}", compression=None, buffer_size=1 << 16)
        self.held[name] = out = _Held()
        return out

    def reader(self, name: str):
        if self.fs:
            return self.fs.open_input_stream(f"{self.folder}/{name}", compression=None)
        return io.BytesIO(self.held[name].getvalue())

    def close(self) -> None:
        self.held.clear()
        if self.fs:
            self.fs.delete_dir(self.folder)


class _Pass:
    """What a sequential pass knows of the blocks behind it: by symbol its number so far, whether its last one is new, and the least common prefix since."""

    def __init__(self):
        self.seen = np.zeros(256, dtype=np.int64)
        self.open = np.zeros(256, dtype=bool)
        self.least = np.full(256, 0xFF, dtype=np.uint8)

    def block(self, symbols: np.ndarray, prefix: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, ...]:
        """(symbol, rank, common prefix, is new, place in the block) of the suffixes that start with a new symbol, and of those right behind them."""
        n = len(symbols)
        counts = np.bincount(symbols, minlength=256)
        by = np.argsort(symbols, kind="stable")  # a counting sort of bytes: the places of each symbol in turn
        starts = np.cumsum(counts) - counts
        by = by[: starts[SEPARATOR]]
        present = np.flatnonzero(counts[:SEPARATOR])
        first, last = starts[present], starts[present] + counts[present] - 1
        fresh = new[by]
        behind = np.empty(len(by), dtype=bool)
        behind[1:] = fresh[:-1]
        behind[first] = self.open[present]
        hit = np.flatnonzero(fresh | behind)
        place = by[hit]
        symbol = symbols[place]
        leads = hit == starts[symbol]
        padded = np.append(prefix, np.uint8(0xFF))
        if len(hit):
            # Ranges from the symbol's place before to this one, from the last to the first, so that what lies between two ranges costs nothing.
            edges = np.empty(2 * len(hit), dtype=np.int64)
            edges[0::2] = np.where(leads, 0, by[hit - 1] + 1)[::-1]
            edges[1::2] = place[::-1] + 1
            least = np.minimum.reduceat(padded, edges)[0::2][::-1]
            least = np.where(leads, np.minimum(least, self.least[symbol]), least)
            shared = np.where(leads & (self.seen[symbol] == 0), 0, least + 1).astype(np.uint8)
        else:
            shared = np.zeros(0, dtype=np.uint8)
        found = symbol, self.seen[symbol] + hit - starts[symbol], shared, fresh[hit], place
        absent = counts == 0
        if n:
            self.least[absent] = np.minimum(self.least[absent], prefix.min())
        if len(present):
            edges = np.empty(2 * len(present), dtype=np.int64)
            edges[0::2] = by[last] + 1
            edges[1::2] = n
            self.least[present] = np.minimum.reduceat(padded, edges)[0::2]
            self.open[present] = fresh[last]
        self.seen += counts
        return found


def _read(source, n: int, kind) -> np.ndarray:
    return np.frombuffer(source.read(n * np.dtype(kind).itemsize), dtype=kind)


def build(text: np.ndarray, ends: np.ndarray, lens: np.ndarray, size: int, store: Store, block: int = BLOCK) -> int:
    """Write the files of the strings ``text[end - len : end]``; returns the number of the last round, which ``read`` takes."""
    m = len(ends)
    if not m or lens.max() >= LONG:
        raise ValueError("strings must be there, and shorter than 128 symbols")
    string = np.arange(m, dtype=np.int32)
    place, shared = np.arange(m, dtype=np.int64), np.zeros(m, dtype=np.uint8)
    moved_place, moved_shared = np.zeros(0, dtype=np.int64), shared[:0]
    total = 0
    for length in range(int(lens.max()) + 1):
        # The suffixes of this length are inserted at ``place``, each with the symbol before it.
        own_ends, own_lens = ends[string], lens[string]
        ahead = np.where(own_lens > length, text[np.maximum(own_ends - length - 1, 0)], SEPARATOR).astype(np.uint8)
        code = (string * 32 + (own_lens - length)).astype(np.int32) if length >= size else None
        total += len(string)
        old = [store.reader(f"{kind}-{(length - 1) % 2}") if length > least else None for kind, least in (("pair", 0), ("string", size))]
        out = [store.writer(f"{kind}-{length % 2}") if length >= least else None for kind, least in (("pair", 0), ("string", size))]
        pair = ahead.astype(PAIR) << 8 | shared | (LONG if code is not None else 0)
        state, found = _Pass(), []
        for lo in range(0, total, block):
            hi = min(lo + block, total)
            a, b = np.searchsorted(place, [lo, hi])
            at = place[a:b] - lo
            keep = np.ones(hi - lo, dtype=bool)
            keep[at] = False
            rest = hi - lo - (b - a)
            pairs = np.empty(hi - lo, dtype=PAIR)
            if rest:
                pairs[keep] = _read(old[0], rest, PAIR)
            pairs[at] = pair[a:b]
            u, v = np.searchsorted(moved_place, [lo, hi])
            if v > u:
                moved = moved_place[u:v] - lo
                pairs[moved] = pairs[moved] & (0xFF00 | LONG) | moved_shared[u:v]
            out[0].write(pairs.data)
            both = pairs.view(np.uint8)
            symbols, prefix = both[1::2].copy(), both[0::2]
            if code is not None:
                is_long = prefix >= LONG
                which = np.cumsum(is_long, dtype=np.int32)
                codes = np.empty(which[-1], dtype=np.int32)
                mine = np.zeros(len(codes), dtype=bool)
                mine[which[at] - 1] = True
                if len(codes) > b - a:
                    codes[~mine] = _read(old[1], len(codes) - int(b - a), np.int32)
                codes[mine] = code[a:b]
                out[1].write(codes.data)
            new = ~keep
            new[at[ahead[a:b] == SEPARATOR]] = False
            symbol, rank, value, fresh, where = state.block(symbols, prefix & (LONG - 1), new)
            found.append((symbol, rank, value, fresh, string[a:b][np.searchsorted(at, where[fresh])]))
        for f in (*old, *out):
            if f is not None:
                f.close()
        symbol, rank, value, fresh = (np.concatenate([f[k] for f in found]) for k in range(4))
        smaller = m + np.cumsum(state.seen[:SEPARATOR]) - state.seen[:SEPARATOR]
        goes = smaller[symbol] + rank
        owner = np.full(len(goes), -1, dtype=np.int32)
        owner[fresh] = np.concatenate([f[4] for f in found])
        if len(found) > 1:
            order = np.argsort(goes, kind="stable")
            goes, value, fresh, owner = goes[order], value[order], fresh[order], owner[order]
        place, shared, string = goes[fresh], value[fresh], owner[fresh]
        moved_place, moved_shared = goes[~fresh], value[~fresh]
    return int(lens.max())


def read(store: Store, rounds: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the long suffixes in order: (string, its length less that of the suffix, prefix shared with the suffix before)."""
    pairs, codes = store.reader(f"pair-{rounds % 2}"), store.reader(f"string-{rounds % 2}")
    while len(both := np.frombuffer(pairs.read(2 * block), dtype=np.uint8)):
        prefix = both[0::2]
        prefix = prefix[prefix >= LONG] & (LONG - 1)
        code = _read(codes, len(prefix), np.int32)
        yield code >> 5, code & 31, prefix
