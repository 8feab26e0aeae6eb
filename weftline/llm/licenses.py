"""License scans by a positional index of rare words.

The index posts every word of every licence text with its positions; a word's weight is its inverse document frequency
over the whole corpus. A file looks up its own highest-weight licence words, one after the other: each occurrence
votes for the starts that the word's postings give a text, and for each text as many words are looked up as any match
must share at least two of. Starts on which two votes agree, up to ``slack`` words, are verified: the share of the
text's weight found near its place must reach ``least``, and the text's mandatory phrases must stand there. Fixed
phrases give base labels that always stay.

Awkward rows: null or empty texts have no words, no labels and score 0; very long texts are scanned whole; of texts
with one label any match gives it, and equal shares (ties) give one score; repeated rows and null ids are kept as they
come; an empty table gives an empty result; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import prepare
from weftline.llm.license_texts import PHRASES, TEMPLATES

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_BLANK = bytes(b if b in _WORD else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of ``text`` in lower case (A-Z only), as bytes."""
    return (text or "").encode("utf-8", "replace").lower().translate(_BLANK).split()


def _places(words: list[bytes], phrase: list[bytes], at: list[int]) -> list[int]:
    k = len(phrase)
    return [i for i in at if words[i : i + k] == phrase]


class Index:
    """``df``: documents that hold a licence word, of ``n_docs``; ``slack``: how far a word may be from its place; ``least``: the share of a text's weight to be found."""

    def __init__(self, templates, df: dict[str, int], n_docs: int, slack: int = 6, least: float = 0.75):
        self.slack, self.least = slack, least
        self.idf = lambda w: math.log((n_docs + 1) / (df.get(w.decode(), 0) + 1)) + 1e-3
        self.templates = [(label, words_of(text), [words_of(p) for p in keys]) for label, text, keys in templates]
        self.weight = [[self.idf(w) for w in words] for _, words, _ in self.templates]
        self.total = [sum(w) for w in self.weight]
        #: A match misses at most this weight, so of more looked up by the heaviest word two are there.
        self.budget = [(1 - least) * total + max(w) for total, w in zip(self.total, self.weight)]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: set[bytes] = set()
        for t, (_, words, _) in enumerate(self.templates):
            for q, w in enumerate(words):
                self.postings[w].append((t, q))
            spent = 0.0  # no match without one of the heaviest words that together weigh more than it may miss
            for w in sorted(set(words), key=lambda w: (-self.idf(w), w)):
                if spent > (1 - least) * self.total[t] + 1e-9:
                    break
                self.needed.add(w)
                spent += self.idf(w) * words.count(w)
        self.phrases = [(words_of(p), label) for p, label in PHRASES.items()]
        self.first = {p[0] for p, _ in self.phrases}

    def scan(self, words: list[bytes]):
        """Base places, base labels, [(label, start, share)]."""
        held = set(words)
        rare = not self.needed.isdisjoint(held)
        if not rare and self.first.isdisjoint(held):
            return [], set(), []
        own = [w for w in held if w in self.postings]
        where: dict[bytes, list[int]] = {w: [] for w in own}
        for w in self.first & held:
            where.setdefault(w, [])
        for i, w in enumerate(words):
            if w in where:
                where[w].append(i)
        places, labels = [], set()
        for phrase, label in self.phrases:
            found = _places(words, phrase, where.get(phrase[0], []))
            places += found
            labels |= {label} if found else set()
        return places, labels, self._matches(words, own, where) if rare else []

    def _matches(self, words: list[bytes], own: list[bytes], where) -> list[tuple[str, int, float]]:
        there = [0.0] * len(self.templates)
        for w in own:
            for t, _ in self.postings[w]:
                there[t] += self.idf(w)
        fit = [a >= self.least * b - 1e-9 for a, b in zip(there, self.total)]
        if not any(fit):
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        spent = [0.0] * len(self.templates)
        for w in sorted(own, key=lambda w: (-self.idf(w), w)):
            open_ = {t for t, _ in self.postings[w] if fit[t] and spent[t] <= self.budget[t]}
            for t, q in self.postings[w]:
                if t in open_:
                    starts[t].extend(p - q for p in where[w])
                    spent[t] += self.idf(w)
        found = []
        for t, votes in starts.items():
            for start in _agreed(sorted(votes), min(2, len(self.templates[t][1])), self.slack):
                if (share := self.verify(t, start, words, where)) is not None:
                    found.append((t, start, share))
        return self.resolve(found)

    def verify(self, t: int, start: int, words: list[bytes], where) -> float | None:
        """The share of text ``t`` found at ``start``, if it is enough and the mandatory phrases stand there."""
        share = self._share(t, start, where)
        if share < self.least:
            return None
        _, template, keys = self.templates[t]
        lo, hi = max(0, start - self.slack), start + len(template) + 2 * self.slack
        return share if all(_places(words[lo:hi], key, range(hi - lo)) for key in keys) else None

    def resolve(self, found: list[tuple[int, int, float]]) -> list[tuple[str, int, float]]:
        """Of the verified (text, start, share) the best of each run of starts; of texts that lie one upon the other (by more than half of the smaller) the one with most weight found."""
        runs: dict[tuple[int, int], tuple[int, int, float]] = {}
        last: dict[int, tuple[int, int]] = {}
        for t, start, share in sorted(found):
            run = last[t][1] if t in last and start - last[t][0] <= 2 * self.slack else start
            last[t] = (start, run)
            if (t, run) not in runs or share > runs[t, run][2] + 1e-9:
                runs[t, run] = (t, start, share)
        kept: list[tuple[int, int, float]] = []
        for t, start, share in sorted(runs.values(), key=lambda r: (-r[2] * self.total[r[0]], r[0], r[1])):
            end = start + len(self.templates[t][1])
            if not any(2 * (min(end, s + len(self.templates[u][1])) - max(start, s)) > min(end - start, len(self.templates[u][1])) for u, s, _ in kept):
                kept.append((t, start, share))
        return [(self.templates[t][0], max(0, start), share) for t, start, share in sorted(kept, key=lambda r: (r[1], r[0]))]

    def _share(self, t: int, start: int, where) -> float:
        words, weight = self.templates[t][1], self.weight[t]
        got = 0.0
        for q, w in enumerate(words):
            at = where.get(w, ())
            if bisect_right(at, start + q + self.slack) > bisect_left(at, start + q - self.slack):
                got += weight[q]
        return got / self.total[t]


def _agreed(votes: list[int], need: int, slack: int):
    """Starts, ascending, that ``need`` of the sorted ``votes`` lie within ``slack`` of."""
    lo, done = 0, None
    for hi, vote in enumerate(votes):
        while vote - votes[lo] > 2 * slack:
            lo += 1
        if hi - lo + 1 >= need:
            for start in range(max(vote - slack, -(1 << 60) if done is None else done + 1), votes[hi - need + 1] + slack + 1):
                yield start
                done = start


def frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """Document frequencies of the templates' words over all documents (at most one entry a template word), and the number of documents."""
    vocabulary = {w for _, text, _ in templates for w in words_of(text)}

    def run(batches):
        count, n = defaultdict(int), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    count[w.decode()] += 1
        yield pa.RecordBatch.from_pydict({"word": [*count, ""], "n": [*count.values(), n]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    found = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``docs`` (doc_id, text, ...) to one row each: counts, base and all labels, best share, and ``spans`` (label@word, comma-joined)."""
    prepare(docs)
    df, n_docs = frequencies(docs, templates)

    def run(batches):
        index = Index(templates, df, n_docs)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                places, base, hits = index.scan(words)
                rows.append(
                    (
                        doc_id,
                        len(words),
                        len(places),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | {h[0] for h in hits})),
                        min(1.0, max((h[2] for h in hits), default=0.0)),
                        ",".join(f"{label}@{start}" for label, start, _ in hits),
                    )
                )
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
