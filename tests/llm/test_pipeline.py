"""The pipeline's stages against brute force on small rows, and the registered queries' SQL."""

import itertools
import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tests import oracle
from tests.llm.test_operators import as_sorted, brute_repeats, words
from weftline.llm import ngram_join, queries

SF = "/root/testdata/sf0.001"
#: Names of the operators' own columns, to clash with them.
CLASHES = "n_words long, kept string, n_removed long, symbols string, _doc int, _id int, _key int, start int, chunk int, size int, class_id int, label string, metric string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    base = [words(rng, 80) for _ in range(12)]
    passage = words(rng, 40)
    texts = [None, "", "too short", "é" * 200, "# " * 100, words(rng, 9000), *base, base[0], base[0], base[1] + " tail", base[2] + "\n" + passage, base[3] + "\n" + passage + "\n" + words(rng, 30), passage + " " + words(rng, 25), "a b c d e f g h " * 30]
    texts += [words(rng, 50) for _ in range(60)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s", "t", None]), len(t or ""), i, "k", 7, "s", 1, 2, 3, 4, 5, 6, 7, "l", "m") for i, t in enumerate(texts)]
    out += [out[7], out[7], out[1], (None, base[4], *out[0][2:]), (None, words(rng, 33), *out[0][2:]), (None, base[5] + " x", *out[0][2:])]
    rng.shuffle(out)
    return out


def quality_kept(rows):
    """The rows that the SQL of the quality rules keeps."""
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?, ?)", [(k, *r[1:4]) for k, r in enumerate(rows)])
    kept = {r[0] for r in db.execute(f"select doc_id from ({queries.oracle_sql()['op5_quality_rules']}) where kept").fetchall()}
    return [r for k, r in enumerate(rows) if k in kept]


def without_near_duplicates(rows):
    sets = [set(s.tolist()) for s in ngram_join.shingles([r[1] for r in rows])]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    out, done = [], set()
    for k, r in enumerate(rows):
        ids = [q[0] for j, q in enumerate(rows) if find(j) == find(k) and q[0] is not None]
        alone = sum(find(j) == find(k) for j in range(len(rows))) == 1
        if alone or (r[0] == min(ids) if ids else True) and (r[0], r[1]) not in done:
            out.append(r)
            done.add((r[0], r[1]))
    return out


def without_repeats(rows):
    out = []
    found = brute_repeats([r[:2] for r in rows])
    first = {}
    for d, t in sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for r, (_, _, removed, _, _) in zip(rows, found):
        if not removed:
            out.append(r)
            continue
        b = r[1].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < r[0]:
                gone[i : i + 50] = b"\x01" * 50
        left = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if left.strip(" "):
            out.append((r[0], left, *r[2:4], len(left), *r[5:]))
    return out


def test_stages_against_brute_force(spark, rows, tmp_path):
    names = [c.split()[0] for c in DOCS.split(", ")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    brute = [quality_kept, without_near_duplicates, without_repeats]
    want = rows
    for k, ((_, stage), plain) in enumerate(zip(corpus_pipeline.STAGES, brute)):
        want = plain(want)
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == names
        assert as_sorted(docs.collect()) == as_sorted(want)
    assert 0 < len(want) < len(rows) - 8
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in want}
    of = {}
    for r in packed:
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in found) <= 1024 for found in of.values())


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    ids = lambda df: {r[0] for r in df.select("doc_id").distinct().collect()}
    assert ids(corpus_pipeline.run(spark, SF)) == ids(docs)


def test_empty_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    assert oracle.difference(__spark_entry__.queries()[name](spark, SF), oracle.connect(SF), __spark_entry__.oracle_sql()[name]) == ""
