"""Each operator against brute force, on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, collection, html_blocks, licenses, ngram_join, packing, pieces, quality, sharding, suffix_dedup, url_rules
from weftline.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, bucket int"


def words(rng, n):
    return " ".join(rng.choice(["ann", "bo", "cyd", "dee", "eli", "fay", "gus", "hal"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, 60) for _ in range(6)]
    texts = [None, "", " \n ", "one two", "x" * 3000, "é" * 300, words(rng, 4000), *base, *base[:3], *[b + " tail" for b in base], base[0] + "\n" + base[1], "a b c d e f g h " * 20]
    texts += [base[0][:200] + words(rng, 20), words(rng, 30) + base[2][50:180]]
    ids = [None, *range(1, len(texts))]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s", "t", None]), 1, 2, "z", 3) for i, t in zip(ids, texts)]
    return out + [out[8], out[8], (None, base[3], "en", "s", 1, 2, "z", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def as_sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_packing_covers_every_id(docs, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    want = sorted([(r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows], key=repr)
    total = sum(len(ids) for _, ids in want)
    assert sum(r["length"] for r in got) == total
    for r in got:
        fits = [ids for d, ids in want if d == r["doc_id"] and len(ids) == r["doc_tokens"]]
        assert any(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"] for ids in fits)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for found in by.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
        n = sum(n for _, n in found)
        assert n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding < 0.1 * total
    assert packing.pack(none).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        at = np.array([0, *np.cumsum([rng.randrange(1, 9) for _ in range(rng.randrange(1, 14))])])
        penalty = np.array([0.0] + [rng.choice([0.0, 2.0, 5.0]) for _ in at[1:]])
        size = 16

        def cost(path):
            out = 0.0
            for a, b in zip(path, path[1:]):
                n = at[b] - at[a]
                if n > size:
                    return float("inf")
                out += (0 if n & (n - 1) == 0 else size - n) + penalty[b]
            return out

        best = min(cost([0, *p, len(at) - 1]) for k in range(len(at)) for p in itertools.combinations(range(1, len(at) - 1), k))
        assert cost(packing.cuts(at, penalty, size)) == pytest.approx(best)


def test_packing_in_buffers_costs_next_to_nothing(monkeypatch):
    """One stream solved whole and in buffers, some of which must solve their last windows again."""
    import public_tokenizers

    rng = random.Random(11)
    texts = [words(rng, rng.choice([5, 40, 300, 2000])) + rng.choice([".", "\n", ""]) for _ in range(150)]

    def padding(buffer):
        monkeypatch.setattr(packing, "BUFFER", buffer)
        packer = packing.Packer(public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)
        out = [o for k in range(0, len(texts), 4) if (o := packer.add(list(range(k, min(k + 4, len(texts)))), texts[k : k + 4])) is not None] + [packer.flush(last=True)]
        lens = {}
        for batch in out:
            for s, n in zip(batch.column(5).to_pylist(), batch.column(2).to_pylist()):
                lens[s] = lens.get(s, 0) + n
        return sum(0 if n & (n - 1) == 0 else 1024 - n for n in lens.values()), sum(lens.values())

    whole, total = padding(1 << 30)
    parts, same = padding(1 << 14)
    assert total == same and whole <= parts + 1 and parts - whole <= 0.002 * total


def test_ngram_join_finds_every_link(docs, none, rows):
    got = as_sorted(ngram_join.join(docs).select("doc_id", "class_id", "n_links").collect())
    sets = [set(s.tolist()) for s in ngram_join.shingles([r[1] for r in rows])]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[root(b)] = root(a)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), 1 << 60))
    want = as_sorted([(r[0], least.get(root(i), r[0]), links[i]) for i, r in enumerate(rows)])
    assert got == want
    assert ngram_join.join(none).count() == 0


def test_ngram_join_splits_large_groups(spark):
    rng = random.Random(1)
    base = words(rng, 200).split()
    texts = []
    for i in range(90):
        t = list(base)
        t[i * 2] = "changed"
        texts.append(" ".join(t))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.join(table, limit=20, block_rows=25).collect()}
    sets = [set(s.tolist()) for s in ngram_join.shingles(texts)]
    for i in range(90):
        assert got[i]["class_id"] == 0
        assert got[i]["n_links"] == sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(90) if j != i)


def test_ngram_join_finds_pairs_in_large_leaves(spark):
    rng = random.Random(2)
    shared, texts = words(rng, 128), []
    for _ in range(250):
        own = [f"w{rng.randrange(1 << 40)}" for _ in range(160)]
        texts.append(" ".join([shared, *own]))
        for at in range(5, 160, 26):
            own[at] = "changed"
        texts.append(" ".join([shared, *own]))
    sets = [set(s.tolist()) for s in ngram_join.shingles(texts)]
    assert all(5 * len(a & b) >= 4 * len(a | b) for a, b in zip(sets[::2], sets[1::2])) and 5 * len(sets[0] & sets[2]) < 4 * len(sets[0] | sets[2])
    got = ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), depth=1, limit=4).select("doc_id", "class_id", "n_links").collect()
    assert as_sorted(got) == as_sorted([(i, i - i % 2, 1) for i in range(500)])


def test_ngram_runs_count_the_shared_signature():
    assert ngram_join.runs_needed(0.8, 3, 0.9999) == 12


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)], "a long, b long")
    assert {(r["node"], r["label"]) for r in components(edges).collect()} == {(i, 0) for i in range(21)} | {(30, 30), (31, 30)}


def brute_shards(rows, total):
    """The records in their final order, one by one: ((doc_id, crc, size), shard, slot)."""
    out, ahead, slots = [], 0, {}
    for r in sorted(rows, key=lambda r: (r["range"], r["part"], r["key"], (r["doc_id"] is not None, r["doc_id"] or 0), r["text_crc32"], r["size"])):
        shard = min(15, ahead * 16 // total)
        out.append((r["doc_id"], r["text_crc32"], r["size"], shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        ahead += r["size"]
    return out


def test_sharding(spark, docs, none, rows):
    got = sharding.shard_by_bytes(docs, rows_per_part=4, block=2).collect()
    assert as_sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == as_sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    total = sum(r["size"] for r in got)
    digest = lambda rs: as_sorted((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in rs)
    assert digest(got) == as_sorted(brute_shards(got, total))
    keys = sorted((r["range"], r["key"]) for r in got)
    assert [k for _, k in keys] == sorted(r["key"] for r in got)  # ranges are ranges of the key
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(sizes) <= total / 16 + max(r["size"] for r in got)
    assert digest(sharding.shard_by_bytes(docs.repartition(7), rows_per_part=4).collect()) == digest(got)
    assert sharding.shard_by_bytes(none).count() == 0


def test_sharding_of_one_repeated_row(spark):
    table = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("shard"), F.lit(2).alias("at")).unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("other").alias("text"), F.lit(1).alias("shard"), F.lit(2).alias("at")))
    got = sharding.shard_by_bytes(table, rows_per_part=100, block=64).collect()
    total = sum(r["size"] for r in got)
    assert len(got) == 3050 and as_sorted((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == as_sorted(brute_shards(got, total))


def base_counts(text):
    gap = " \t\n\x0b\x0c\r"
    found = [w for w in re.split(f"[{gap}]+", text or "") if w]
    grams, cover = {}, set()
    for i in range(len(found) - 7):
        grams.setdefault(tuple(found[i : i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            for i in at:
                cover |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(gap)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_base(docs, none, rows, spark):
    got = as_sorted(quality.quality_rules(docs).select("doc_id", *quality.BASE, "base_failed").collect())
    assert got == as_sorted((r[0], *(c := base_counts(r[1])), c[0] < 20 or 100 * c[4] > 30 * c[0]) for r in rows)
    assert quality.quality_rules(none).count() == 0
    clean = [(i, words(random.Random(i), 50), "en", "s") for i in range(150)] + [(500, " ".join(f"w{k}###" for k in range(50)), "en", "s")]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(500) and all(kept.values())


def brute_repeats(rows):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int(((gone[1:] - gone[:-1]) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_are_exact(spark, docs, none, rows, hot):
    assert as_sorted(suffix_dedup.remove_repeats(docs, hot=hot).collect()) == as_sorted(brute_repeats([r[:2] for r in rows]))
    rng = random.Random(3)
    base = ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(4)]
    odd = [(i if i % 7 else None, rng.choice([base[i % 4][rng.randrange(50) : rng.randrange(60, 300)] + rng.choice(["", "x" * 200, "é" * 40]), "a" * rng.randrange(120), None, "", base[0]])) for i in range(80)] + [(5, "a" * 70)] * 2
    table = spark.createDataFrame(odd, "doc_id long, text string")
    assert as_sorted(suffix_dedup.remove_repeats(table, hot=hot).collect()) == as_sorted(brute_repeats(odd))
    assert suffix_dedup.remove_repeats(none).count() == 0
    left = suffix_dedup.remove_repeats(docs, texts=True)
    assert left.count() == len(rows) and set(left.columns) == {*docs.columns, "n_removed"}


@pytest.mark.parametrize("on_disk", [False, True])
def test_collection_in_order(tmp_path, on_disk):
    rng = random.Random(1)
    for trial in range(60):
        size = rng.choice([2, 3, 5])
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(size, size + 20))) for _ in range(rng.randrange(1, 30))]
        lens = np.array([len(s) for s in strings])
        store = collection.Store(str(tmp_path / str(trial)) if on_disk else None)
        rounds = collection.build(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lens), lens, size, store, block=rng.choice([3, 7, 1 << 18]))
        got = [tuple(map(int, x)) for part in collection.read(store, rounds, block=5) for x in zip(*part)]
        store.close()
        found = [strings[i][at:] for i, at, _ in got]
        assert found == sorted(s[k:] for s in strings for k in range(len(s) - size + 1))
        for (_, _, shared), a, b in zip(got[1:], found, found[1:]):
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared == same or (shared < size and same < size)  # a shorter suffix may lie between


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[50:80] = x[50]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    odd = [(1000, None, 1, 2), (1050, [0.0] * 24, 1, 2), (1100, [float("nan")] * 24, 1, 2), (1150, [None] * 24, 1, 2), (None, x[0].tolist(), 1, 2), (1250, [], 1, 2), (1300, [float("inf")] * 24, 1, 2), (100, x[100].tolist(), 1, 2)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int, key int")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 400, 50):
        order = sorted((-float(ann.cosines(x[[q]].astype(float), x[[i]].astype(float))[0]), i) for i in range(400) if i != q)[:5]
        found = sorted(got[q])
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
        hits += len({v for _, v, _ in found} & {i for _, i in order})
        total += 5
        for _, v, s in found:
            a, b = x[q].astype(float), x[v].astype(float)
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    assert hits >= 0.9 * total and set(got) == set(range(0, 400, 50))
    assert [v for _, v, _ in sorted(got[50])] == [51, 52, 53, 54, 55]
    few = ann.search(spark.createDataFrame(rows[:3], table.schema), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2
    assert ann.search(spark.createDataFrame([], table.schema), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_large_and_small_doubles_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5))
    scale = np.where(np.arange(60) % 3 == 0, 1e200, np.where(np.arange(60) % 3 == 1, 1e-200, 1.0))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, scale))] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(4)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50):
        assert [v for _, v in sorted(got[q])] == [int(i) for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:5]
    assert {v for _, v in got[1000]} == {1001, 1002, 1003}


def test_neighbours_probe_until_there_are_enough(spark, monkeypatch):
    monkeypatch.setattr(ann, "fit_probes", lambda rows, queries, hashers, k, recall: dict.fromkeys(hashers, 1))
    monkeypatch.setattr(ann, "TABLES", 1)
    monkeypatch.setattr(ann, "BUCKET", 2)
    monkeypatch.setattr(ann, "CELL", 16)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert as_sorted((r["query_id"], r["rank"]) for r in got) == as_sorted((q, k) for q in range(0, 300, 50) for k in range(1, 6))


def test_places_among_probes():
    rng = np.random.default_rng(7)
    for n in (500, 20_000, 3_000_000):
        hasher = ann.Hasher(n, 6)
        q = ann._unit(rng.normal(size=(1, 6)))
        order = hasher.probes(q, 1, hasher.buckets)[0]
        assert sorted(order.tolist()) == list(range(hasher.buckets))
        gaps = [g[0] for g in hasher.gaps(q, 1)]
        assert all(k + 1 <= hasher.place(gaps, int(order[k])) <= k + 5 for k in range(0, min(len(order), 200), 7))  # the last of those as near


def all_segmentations(model, part):
    def walk(i):
        if i == len(part):
            yield 0.0, []
            return
        for j in range(i + 1, len(part) + 1):
            s = model.score.get(part[i:j], model.unknown if j == i + 1 else None)
            if s is not None:
                own = [model.ids[part[i:j]]] if part[i:j] in model.ids else [model.byte_ids[b] for b in part[i:j].encode()]
                for score, ids in walk(j):
                    yield s + score, own + ids

    return sorted(walk(0), key=lambda x: -x[0])


def test_pieces(spark, docs, none, rows):
    import public_tokenizers

    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for part in ("▁hello", "▁▁x", "▁é日", "▁tions"):
        assert [s for s, *_ in model.search(part, 4)] == [s for s, _ in all_segmentations(model, part)[:4]]
    # Whole texts against all segmentations of the text, for several N.
    for text in ("to 日 x", "in a", "a  b", " le", "x", "t ", "été", "\U0001f600 ok"):
        every = all_segmentations(model, model.normal(text))
        for n in (1, 2, 4, 7):
            got = model.nbest(text, n)
            assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:n]])
            assert all((s, ids) in [(w, i) for w, i in every if w == s] for s, ids in got) and len({tuple(i) for _, i in got}) == len(got)
        assert model.decode(got[0][1]) == text
    # Parts searched together against the same parts one by one.
    text = f"plain words, \n breaks\nÉté número 5 {chr(0x1F600)} 日本 {chr(0x378)}x %%% " + "long" * 20 + " " + " ".join((r["text"] or "") for r in docs.select("text").collect())
    whole, points, firsts, start, length = model.parts([text, "", None, "again", " "])
    assert firsts.tolist()[1:4] == [firsts[1]] * 3
    ids, count, score, lead, strange = model.best_two(whole, points, start, length)
    ends = np.cumsum(count)
    for p in range(len(start)):
        found = model.search(whole[start[p] : start[p] + length[p]], 2)
        assert score[p] == found[0][0] and ids[ends[p] - count[p] : ends[p]].tolist() == found[0][1] and strange[p] == found[0][2]
        assert lead[p] == (found[0][0] - found[1][0] if len(found) > 1 else np.inf)
    got = pieces.encode(docs).collect()
    assert all(r["round_trip"] for r in got)
    assert as_sorted((r["doc_id"],) for r in got if r["rank"] == 1) == as_sorted((r[0],) for r in rows)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["decoded_crc32"]), []).append(r)
    for (d, _), found in by.items():
        copies = sum(r["rank"] == 1 for r in found)
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found[::copies]] == list(range(1, len(found) // copies + 1)) and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    empty = [r for r in got if r["doc_id"] == 1]
    assert [(r["rank"], r["n_pieces"], r["score"], r["decoded_crc32"]) for r in empty] == [(1, 0, 0.0, 0)]
    assert pieces.encode(none).count() == 0


PAGES = {  # labelled by hand, none of them a training page
    "menu and footer without names": ("<body><div><a href=a>Start</a> | <a href=b>Shop</a></div><h1>Cats</h1><p>Cats sleep for most of the day and hunt at night when the house is quiet.</p><p>They purr.</p><div><a href=c>Terms</a></div></body>", "Cats\n\nCats sleep for most of the day and hunt at night when the house is quiet.\n\nThey purr."),
    "last block": ("<article><h1>Title</h1><p>First paragraph here.</p><p>Last paragraph is lost here.</p></article>", "Title\n\nFirst paragraph here.\n\nLast paragraph is lost here."),
    "one block": ("<p>There is only this.</p>", "There is only this."),
    "links in text": ("<main><p>See <a href=x>the old plan</a> now and then.</p><p><a href=y>All of it is linked</a></p></main>", "See the old plan now and then.\n\nAll of it is linked"),
    "names by whole words": ('<article><p>One two.</p><div class="share-price">Up by three.</div><p class="side-note">A note.</p><div id="feedbackLoop"><p>Loops.</p></div></article>', "One two.\n\nUp by three.\n\nA note.\n\nLoops."),
    "parts of an article that are none": ('<article><nav>In this text</nav><p>Kept.</p><div class="ad-slot"><p>Buy now.</p></div><aside>More.</aside><form><p>Sign here</p></form><ul class="comment-list"><li>I agree with all of this.</li></ul><footer>By line</footer></article>', "Kept."),
    "shifted by capitals": ("<article><p>" + "İ" * 60 + "</p><SCRIPT>var p = '<p>no</p>';</Script ><p>The rest.</p></article>", "İ" * 60 + "\n\nThe rest."),
    "unclosed": ("<article><p><b>Bold<br>line<p>Next<ul><li>a<li>b</ul>", "Bold line\n\nNext\n\na\n\nb"),
    "references": ("<p>a &lt;b&gt; &amp;amp; &eacute;&nbsp;c &#x41; 1 < 2 &copy</p>", "a <b> &amp; é c A 1 < 2 ©"),
    "hidden and raw": ('<article><p hidden>no</p><p style="color:red; display : none">no</p><p>yes<span aria-hidden="true">no</span><textarea>no</textarea></p><noscript>no</noscript><style>no</style><!-- no --></article>', "yes"),
    "notices": ('<div role="alert"><p>We use cookies to make this page work as it should for you.</p></div><div class="post"><p>Text of the post.</p><p>More text.</p></div><div class="sidebar"><p>Side.</p></div>', "Text of the post.\n\nMore text."),
    "header of an article": ("<header><p>The site</p></header><article><header><h1>Head</h1></header><p>Body.</p></article>", "Head\n\nBody."),
    "link around blocks": ("<div><a href=x><div>Menu one</div><div>Menu two</div></a></div><p>A text that is long enough to be the text of this page, with nothing around it.</p>", "A text that is long enough to be the text of this page, with nothing around it."),
    "nothing": ("", ""),
    "cut in a tag": ("<p>one</p><p class='x", "one"),
}


@pytest.mark.parametrize("name", PAGES)
def test_html_pages(name):
    page, want = PAGES[name]
    assert html_blocks.main_text(page) == want


def test_html_blocks_against_a_plain_cutter(spark):
    """Blocks of simple pages, cut by a regular expression."""
    rng = random.Random(4)
    for _ in range(200):
        page, want = "", []
        for _ in range(rng.randrange(1, 9)):
            tag, text = rng.choice(["p", "div", "h2", "li", "td"]), " ".join(rng.choice(["a", "bb", "<b>c</b>", "&amp;", "d<br>e", "<i>f</i>g"]) for _ in range(rng.randrange(0, 6)))
            page += f"<{tag}>{text}</{tag}>" + rng.choice(["", "\n ", "<!-- x -->"])
            plain = " ".join(re.sub("<[^>]*>", "", text.replace("<br>", " ")).replace("&amp;", "&").split())
            want += [plain] if plain else []
        assert [b["text"] for b in html_blocks.blocks(page)] == want


@pytest.mark.parametrize("page", ["<a " * 60_000, '<a <a "' * 30_000, "<p title='" * 40_000, "<div>" * 80_000 + "x" + "</p>" * 80_000, "<p>x" * 80_000, "<!--" * 80_000, "<textarea>" * 60_000, "<li><a>" * 50_000, '<x y="z>' * 50_000, "<ul><li>" * 50_000 + "z", "&" * 400_000, "<table><tr><td>" * 30_000])
def test_html_time_is_linear(page):
    began = time.perf_counter()
    html_blocks.main_text(page)
    assert time.perf_counter() - began < 5


def test_html(spark):
    page = (
        '<html><head><title>T</title><script>x("</p>")</script></head><body><nav><a href="/">Home</a></nav><header>The site</header><article><h1>A&amp;B</h1>'
        "<p>One <b>bold<br>line</b> here.<p>Short.</p><div class=comments><p>I like this very much, it is the best text I have read.</p></div></article><footer>&copy; x</footer>"
    )
    table = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (None, "w", "<p>x", 1), (1, "u", page, 1)], "page_id long, url string, html string, text int")
    got = as_sorted(html_blocks.extract(table).collect())
    text = "A&B\n\nOne bold line here.\n\nShort."
    assert got == as_sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "x", 1)])
    assert html_blocks.extract(table.limit(0)).count() == 0
    tree = html_blocks.show(html_blocks.trained())
    assert all(f in tree for f in ("links", "next_words", "next_links", "prev_words", "inside", "comment", "chrome"))


def brute_labels(index, words):
    """Each text at each start, without the index."""
    where = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    found = []
    for t, (_, template, _) in enumerate(index.templates):
        for start in range(-len(template) - 10, len(words) + 10):
            share = index.verify(t, start, words, where)
            if share is not None:
                found.append((t, start, share))
    return index.resolve(found)


def test_licenses_against_every_start(spark):
    rng = random.Random(6)
    index = licenses.Index(licenses.TEMPLATES, {"the": 900, "of": 800, "and": 900, "software": 40, "license": 60, "version": 50}, 1000)
    texts = []
    for _ in range(120):
        parts = [words(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(1, 3)):
            own = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 2, 6, 20])):  # left out, put in, changed
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice([[], ["x"], ["the"], ["license", "software"]])
            parts += [" ".join(own[: rng.choice([len(own), len(own), len(own) * 3 // 4, 5])]), words(rng, rng.randrange(0, 20))]
        texts.append(" ".join(parts))
    hits = 0
    for text in texts:
        own = licenses.words_of(text)
        got, want = index.scan(own)[2], brute_labels(index, own)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and [c for *_, c in got] == pytest.approx([c for *_, c in want])
        hits += len(got)
    assert hits > 60


def test_licenses(spark, docs, none, rows):
    mit = next(t for label, t, _ in licenses.TEMPLATES if label == "mit")
    texts = ["See the MIT License, and the mit\n\nlicense.", "foo " * 30 + mit, "GNU General Public\tLicense; CC-BY.", "mitx license", None, "x\nLicensed under CC BY-NC 4.0.\ny", "This work is licensed under the GNU General Public License, version 3."]
    table = spark.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(texts)], "doc_id long, text string, labels int, score double")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"]) == (2, 2, 6, "mit")
    assert got[1]["base_labels"] == "" and got[1]["labels"] == "mit" and got[1]["score"] > 0.99
    assert got[2]["base_labels"] == "cc-by,gpl" and got[3]["n_base"] == 0 and got[4]["n_words"] == 0 and got[4]["labels"] == ""
    assert (got[5]["base_labels"], got[5]["labels"]) == ("cc-by", "cc-by,cc-by-nc-4.0") and got[6]["labels"] == "gpl,gpl-3.0"
    all_rows = licenses.scan_licenses(docs).collect()
    count = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    assert as_sorted((r["doc_id"], r["n_words"]) for r in all_rows) == as_sorted((r[0], count(r[1])) for r in rows)
    assert licenses.scan_licenses(none).count() == 0


def test_license_phrases_against_plain_search(spark):
    rng = random.Random(9)
    parts = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "GNU", "MIT-License", "Apache\nLicense", "CC_BY", "é"]
    texts = [rng.choice([" ", ". ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places, labels = [], set()
        for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
            p = phrase.split()
            at = [k for k in range(len(own)) if own[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want = (len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_url_rules(spark):
    bad = [(f"https://x{i}.spam.example.net/casino/{i}?q=1", True) for i in range(40)]
    good = [(f"https://x{i}.news.example.net/story/{i}", False) for i in range(200)]
    mined = url_rules.mine_rules(spark.createDataFrame(bad + good, "url string, bad boolean"))
    found = [set(r["tokens"]) for r in mined.collect()]
    assert {"h:spam"} in found and not any(a < b for a in found for b in found)
    urls = [
        ("https://A.Example.com/en/7", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("http://b.com/en/?x", "b.com", "/en/", "com/en/", "block"),
        ("http://notcom/en/", "notcom", "/en/", None, "allow"),
        ("https://z.example.net/de/8#q", "z.example.net", "/de/8", "example.net/de/8", "block"),
        ("x://y.spam.org/casino/9", "y.spam.org", "/casino/9", None, "block"),
        ("http://L.example.org/es/" + "a1/" * 20_000 + "?" + "k=v&" * 5_000, "l.example.org", "/es/" + "a1/" * 20_000, "org/es/", "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", 1.0) for i, u in enumerate(urls)] + [(0, urls[0][0], "h", 1.0)], "page_id long, url string, host string, confidence double")
    got = as_sorted(url_rules.judge_urls(pages, mined, RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == as_sorted([(i, *u[1:]) for i, u in enumerate(urls)] + [(0, *urls[0][1:])])
    empty = url_rules.mine_rules(spark.createDataFrame([], "url string, bad boolean"))
    assert empty.count() == 0 and url_rules.judge_urls(pages.limit(0), empty, RULES).count() == 0


def brute_rules(rows, least, min_confidence, min_lift):
    """All itemsets of each URL's tokens, counted one by one."""
    seen, bad, n_bad = {}, {}, sum(b for _, b in rows)
    for tokens, b in rows:
        for k in range(1, len(tokens) + 1):
            for items in itertools.combinations(sorted(tokens), k):
                seen[items] = seen.get(items, 0) + 1
                bad[items] = bad.get(items, 0) + b
    fits = {i: (bad[i] / seen[i], bad[i] / len(rows)) for i in seen if bad[i] >= least and bad[i] / seen[i] >= min_confidence and bad[i] / seen[i] >= min_lift * n_bad / len(rows)}
    return {i: v for i, v in fits.items() if not any(set(j) < set(i) and w[0] >= v[0] for j, w in fits.items())}


def test_mined_rules_against_all_itemsets(spark):
    """Labels planted on the URLs of a real table: bad where a token or a pair of tokens stands, and here and there."""
    rng = random.Random(8)
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    tokens = dict(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url is not null").select("url", url_rules.url_tokens(F.col("url"))).collect())
    labelled = []
    for u in urls + [None, "no scheme"]:
        t = tokens.get(u, [])
        labelled.append((u, ("p:es" in t and "h:org" in t) or "h:blog" in t and rng.random() < 0.8 or rng.random() < 0.05))
    table = spark.createDataFrame([*labelled, ("http://a.com/x", None)], "url string, bad boolean")
    got = {tuple(r["tokens"]): (r["confidence"], r["support"]) for r in url_rules.mine_rules(table, min_support=0.01).collect()}
    known = [(tokens.get(u, []), int(b)) for u, b in labelled if u is not None]
    want = brute_rules(known, max(10, 0.01 * len(known)), 0.6, 1.5)
    assert set(got) == set(want) and {("h:blog",), ("h:org", "p:es")} <= set(got)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    mined = url_rules.mine_rules(table, min_support=0.01)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "page_id long, url string")
    judged = {r["page_id"]: r for r in url_rules.judge_urls(pages, mined, []).collect()}
    for i, (u, _) in enumerate(labelled):
        fit = [c for k, (c, _) in want.items() if set(k) <= set(tokens.get(u, []))]
        assert judged[i]["verdict"] == ("block" if fit else "allow") and (judged[i]["confidence"] or 0) == pytest.approx(max(fit, default=0))
