"""Each operator against a brute-force version on small tables with nulls, ties, repeats, odd columns and no rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import common, decontaminate, language_id, license_scan, line_dedup, ngram_jaccard, packing, quality, topk_search, toxicity, warc
from docloom.llm.components import connected_components
from docloom.llm.license_rules import Rule, rules

DOCS = "doc_id long, text string, n long, label string, kept_text string"


def docs(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], DOCS)


def words(n, seed, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def copies():
    rng = random.Random(4)
    base = words(80, 1)
    rows = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, None), (3, ""), (4, " \n "), (5, "one two"), (6, "One  two"), (7, " ".join(words(60, 2)))]
    for i in range(8, 60):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    chain = words(120, 9)
    rows += [(60 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(12)]
    rows += [(7, " ".join(words(60, 2))), (None, "no id here at all")]
    return rows


def jaccard_brute(rows, width=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("tile, small, hot", [(512, 64, 256), (2, 0, 3)])
def test_ngram_jaccard(spark, monkeypatch, tile, small, hot):
    """Also with all lists in blocks, and with shingles that count as frequent in some tasks only."""
    monkeypatch.setattr(ngram_jaccard, "TILE", tile)
    monkeypatch.setattr(ngram_jaccard, "SMALL", small)
    monkeypatch.setattr(ngram_jaccard, "HOT", hot)
    monkeypatch.setattr(ngram_jaccard, "COPIES", 1 if tile < 3 else 1024)
    monkeypatch.setattr(common, "HELD", 1 if tile < 3 else 1024)
    rows = copies() + [(200 + k, "exactly one and the same text in many rows") for k in range(5)]
    got = ngram_jaccard.ngram_jaccard(docs(spark, rows)).collect()
    assert len(got) == len(rows) - 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_brute([r for r in rows if r[0] is not None])
    assert ngram_jaccard.ngram_jaccard(docs(spark, [])).count() == 0


def test_one_id_with_several_texts(spark):
    """It connects everything that any of its texts is linked with."""
    texts = [" ".join(words(30, 50 + k)) for k in range(4)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (7, texts[0]), (8, texts[1]), (9, texts[2]), (10, texts[3]), (5, ""), (11, "")]
    got = Counter((r.doc_id, r.component_id) for r in ngram_jaccard.ngram_jaccard(docs(spark, rows)).collect())
    assert got == Counter({(5, 5): 4, (7, 5): 1, (8, 5): 1, (9, 5): 1, (10, 10): 1, (11, 11): 1})


def test_tiles_find_every_pair():
    """Members of one list, in tiles, against all pairs."""
    import pandas as pd

    rng = random.Random(2)
    rows = pd.DataFrame({"cls": range(40), "n": [rng.randrange(20, 30) for _ in range(40)], "pos": [rng.randrange(6) for _ in range(40)], "label": [rng.randrange(3) for _ in range(40)], "o": -1, "hub": -1})
    rows["block"] = rows.cls % 4
    found = set()
    for i in range(4):
        for j in range(i, 4):
            own = rows[rows.block.isin((i, j))]
            found |= set(ngram_jaccard._tile((0, i, j), own, (3, 4))[["a", "b"]].itertuples(index=False, name=None))
    expected = {(a.cls, b.cls) for a, b in itertools.combinations(rows.itertuples(), 2) if a.label != b.label and 7 * min(a.n - a.pos, b.n - b.pos) >= 3 * (a.n + b.n)}
    assert found == expected


def test_overlaps_with_a_hub_bound_the_others():
    """No pair that links is dropped by what both share with a third set."""
    import pandas as pd

    rng = random.Random(12)
    hub = set(range(40))
    sets = [set(rng.sample(range(40), rng.randrange(15, 40))) | {100 + rng.randrange(12) for _ in range(rng.randrange(8))} for _ in range(60)]
    rows = pd.DataFrame({"cls": range(60), "n": [len(x) for x in sets], "pos": 0, "label": range(60), "o": [len(x & hub) for x in sets], "hub": -1, "block": 0})
    found = set(ngram_jaccard._tile((0, 0, 0), rows, (3, 4))[["a", "b"]].itertuples(index=False, name=None))
    linked = {(a, b) for a, b in itertools.combinations(range(60), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    without = set(ngram_jaccard._tile((0, 0, 0), rows.assign(o=-1), (3, 4))[["a", "b"]].itertuples(index=False, name=None))
    assert linked and linked <= found and len(found) < len(without)


@pytest.mark.parametrize("held", [1, 1024])
def test_overlaps_derived_from_the_hub(spark, monkeypatch, held):
    """What members lack of a hub and add to it gives the links that their whole sets give, and is shorter than they are."""
    monkeypatch.setattr(common, "HELD", held)
    rng, hub = random.Random(5), set(range(60))
    sets = [hub] + [set(rng.sample(range(60), rng.randrange(48, 60))) | {100 + rng.randrange(30) for _ in range(rng.randrange(8))} for _ in range(30)]
    table = spark.createDataFrame([(i, len(x), sorted(x)) for i, x in enumerate(sets)], "cls long, n long, toks array<long>")
    checked = ngram_jaccard._overlaps(spark.createDataFrame([(i, 0) for i in range(1, 31)], "a long, b long"), table, (3, 4)).collect()
    assert {(r.a, r.o, r.links) for r in checked} == {(i, len(x & hub), 100 * len(x & hub) >= 75 * len(x | hub)) for i, x in enumerate(sets) if i}
    assert {r.a for r in checked if not r.links} and all(len(r.lacks) + len(r.adds) < len(sets[r.a]) for r in checked)
    close = spark.createDataFrame([(r.b, r.a, r.n_a, r.size, r.lacks, r.adds) for r in checked], "hub long, cls long, n long, size int, lacks array<long>, adds array<long>")
    pairs = list(itertools.combinations(range(1, 31), 2))
    got = {(r.a, r.b) for r in ngram_jaccard._derived(spark.createDataFrame([(0, *x) for x in pairs], "hub long, a long, b long"), close, (3, 4)).collect()}
    expected = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert got == expected and len(expected) < len(pairs)


def test_hot_keys_meet_in_parts(spark):
    """One key of 50,000 rows among 20,000 others: every row meets its table's row, and no part holds a twentieth."""
    rows = spark.range(70_000).selectExpr("if(id < 50000, 7, id) key", "id other")
    hot = common.hot_keys(rows, "key")
    assert [r.key for r in hot.collect()] == [7]
    dealt = common.parted(rows, hot, ["key"], "other")
    assert dealt.groupBy("key", "part").count().agg(F.max("count")).first()[0] < 3500
    table = rows.groupBy("key").agg(F.count("*").alias("held"), F.min("other").alias("least"))
    both = dealt.join(common.in_parts(table, hot, ["key"]), ["key", "part"])
    assert both.agg(F.count("*"), F.countDistinct("other")).first() == (70_000, 70_000)
    met = common.meet(rows, table, "key", "other")
    assert met.agg(F.count("*"), F.countDistinct("other"), F.sum(F.when(F.col("key") == 7, F.col("least")))).first() == (70_000, 70_000, 0)


@pytest.mark.parametrize("held", [2, 1024])
def test_a_star_and_a_chain_through_its_centre(spark, monkeypatch, held):
    monkeypatch.setattr(common, "HELD", held)
    pairs = [(500, 1000 + i) for i in range(300)] + [(1000, 3), (7, 8), (8, 9)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 3 for i in (3, 500, *range(1000, 1300))} | {7: 7, 8: 7, 9: 7}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100), (200, 201), (201, 200), (203, 201)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {200: 200, 201: 200, 203: 200}


def dedup_brute(rows, least=20):
    keys = defaultdict(set)
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(strip(line)) >= least:
                keys[strip(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(keys.get(strip(x), ())) < 3 or i == max(keys[strip(x)])]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [f"This is the shared line number {k} of all" for k in range(6)]
    rows = [(i, "\n".join(rng.choice([*pool, "short", "  " + pool[0].upper() + "\t", f"only {i} has a line like this one"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "é" * 20), (63, "é" * 20), (64, "é" * 20), (65, "\n\n")]
    d = docs(spark, rows)
    got = line_dedup.kept_lines(d, line_dedup.repeated_lines(d), digest=True)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()} == dedup_brute(rows)
    assert line_dedup.repeated_lines(docs(spark, [])).count() == 0


def test_line_stream_of_one_key(monkeypatch):
    """A key longer than a partition's buffer is decided by its totals."""
    import pyarrow as pa

    n = 450_000
    batch = pa.record_batch([pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)[::-1].copy()), pa.array(np.zeros(n, np.int32))], ["hi", "lo", "doc_id", "pos"])
    out = pa.Table.from_batches(list(line_dedup._stream(iter([batch.slice(0, 250_000), batch.slice(250_000)]), 3)))
    assert out.num_rows == n and sum(out["first"].to_pylist()) == n and all(out["open"].to_pylist())


def test_minimum_bin_slack_is_near_the_bound():
    rng = random.Random(8)
    for _ in range(30):
        size = rng.choice([10, 64, 2048])
        counts = Counter(rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 300)))
        bins = packing.minimum_bin_slack(dict(counts), size)
        used = Counter()
        for times, inside in bins:
            assert times > 0 and sum(n * c for n, c in inside.items()) <= size
            for n, c in inside.items():
                used[n] += times * c
        assert used == counts
        need = math.ceil(sum(n * c for n, c in counts.items()) / size)
        assert sum(t for t, _ in bins) <= 1.25 * max(need, sum(c for n, c in counts.items() if 2 * n > size)) + 1
    assert packing.minimum_bin_slack({}, 8) == []


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["Hello", "naïve", "über,", "x1", "\n", "\t a", "don't", "Áb", "日本語"]) for _ in range(rng.randrange(60)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "<|endoftext|> A <|ENDOFTEXT|>"), (43, "word " * 100), (43, "word " * 100), (None, "lost")]
    got = packing.pack(docs(spark, rows), path, 32).collect()
    assert Counter(r.doc_id for r in got)[43] == 2 * math.ceil(101 / 32)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 32
    expected = set()
    for i, text in rows[:-1]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 32)):
            expected.add((i, k, at, len(ids[at : at + 32]), zlib.crc32(np.array(ids[at : at + 32], "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected
    assert packing.pack(docs(spark, []), path, 32).count() == 0


def test_more_words_than_a_worker_remembers(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "REMEMBER", 4)
    own = packing._Words(path)
    batches = [["one two"], ["one three four five six seven eight"], ["nine ten eleven twelve"], ["one two", "two nine", ""], ["", ""], ["one two three four five six"]]
    for texts in batches:
        ids, bounds = own.ids(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("size", [1 << 20, 16])
def test_top_k(spark, monkeypatch, size):
    monkeypatch.setattr(topk_search, "COMPONENTS", size)
    monkeypatch.setattr(topk_search, "QUERIES", 2048 if size > 16 else 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 40)]) for i in range(90)] + [(90, [0.5] * 40), (91, [0.5] * 40), (91, [0.5] * 40), (92, None), (93, [None] * 40), (94, [float("nan")] * 40), (95, [float("inf")] * 40), (96, [0.1] * 7), (97, []), (None, [0.1] * 40)]
    rows += [(98, [1e30] * 40), (99, [-1e30] + [1e30] * 39), (100, [3e9, *[0.25] * 39]), (101, [1e30, -1e30, *[1.0] * 38]), (110, [3e9, *[0.5] * 39])]
    v = spark.createDataFrame([(i, x, 3) for i, x in rows], "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in topk_search.top_k(v.where("vec_id % 10 = 0"), v, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = {i: [math.floor(64 * float(np.float32(c))) for c in x] for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)}
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in (i for i in ok if i % 10 == 0):
        scores = sorted((-held(sum(a * b for a, b in zip(ok[q], x))), i) for i, x in ok.items() if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in scores]
    assert topk_search.top_k(v.limit(0), v, 5).count() == 0


@pytest.mark.parametrize("scale", [10, 1e5, 1e9, 1e30])
def test_branch_and_bound_is_exact_and_skips(scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, scale, (32, 12))
    v = np.floor(centres[:, rng.integers(0, 12, 600)] + rng.normal(0, scale / 5, (32, 600)))
    v[:, ::9] = np.floor(v[:, ::9] / scale)
    ids, q = np.arange(600) * 3, v[:, :40]
    found, share = topk_search.search_block(q, ids[:40], ids, v, 4, 128)
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    for j, best in enumerate(found):
        scores = sorted((-held(sum(int(a) * int(b) for a, b in zip(q[:, j], v[:, i]))), int(ids[i])) for i in range(600) if i != j)
        assert best.rows == scores[:4]
    assert share < 0.9 or scale >= 1e9  # past a long all tie


def test_passages(spark):
    item = words(30, 11)
    short = ["alpha", "beta", "gamma"]
    changed = list(item)
    changed[0], changed[29] = "other", "thing"  # two of 26 shingles
    rows = [(0, " ".join(words(50, 12) + item + words(20, 13))), (1, " ".join(words(200, 14))), (2, " ".join(changed)), (3, " ".join(item[:15])), (4, None), (5, ""), (6, "x ALPHA, beta. gamma y"), (7, " ".join(item).upper() + "!"), (None, " ".join(item))]
    bench = spark.createDataFrame([(1, " ".join(item), "e"), (2, " ".join(short), "e"), (3, None, "e"), (4, "", "e"), (None, "x", "e")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_passages(docs(spark, rows), bench).collect()}
    assert set(got) == {(0, 1), (2, 1), (6, 2), (7, 1)}
    assert (got[0, 1].start_word, got[0, 1].n_words, got[0, 1].hamming, got[0, 1].similarity) == (50, 30, 0, 1.0)
    assert 0.75 <= got[2, 1].similarity < 1
    assert got[6, 2].start_word == 1
    left = decontaminate.without_passages(docs(spark, rows), bench)
    assert {r.doc_id for r in left.collect()} == {1, 3, 4, 5}
    assert left.columns == docs(spark, rows).columns
    assert decontaminate.find_passages(docs(spark, rows), bench.limit(0)).count() == 0


def test_passages_in_documents_shorter_than_the_item(spark):
    item = words(59, 15)
    rows = [(0, " ".join(item[:-1])), (1, " ".join(item[1:])), (2, " ".join(item[5:50])), (3, " ".join(item[:40])), (4, " ".join(item[:4])), (5, " ".join(words(58, 16))), (6, " ".join(item[:5])), (7, " ".join(item[5:53]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:8]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.find_passages(docs(spark, rows), bench).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 1), (3, 2), (7, 1)}
    assert got[0, 1] == (0, 58, pytest.approx(54 / 55)) and got[1, 1] == (0, 58, pytest.approx(54 / 55))
    assert {r.doc_id for r in decontaminate.without_passages(docs(spark, rows), bench).collect()} == {2, 4, 5, 6}


@pytest.mark.parametrize("radius", [3, 19, 21, 24])
def test_hamming_blocks_find_all_within_radius(radius):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**63, 20).astype(np.uint64)
    asked = np.array([prints[rng.integers(20)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.permutation(64)[: rng.integers(1, 30)].astype(np.uint64)) for _ in range(3000)])
    rows, items = decontaminate.HammingIndex(prints, radius).near(asked)
    distance = np.bitwise_count(asked[:, None] ^ prints[None, :])
    assert set(zip(rows.tolist(), items.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))
    lone = decontaminate.HammingIndex(prints[:1], radius)
    value = rng.integers(0, 2**63, 4000).astype(np.uint64)
    passed = np.zeros(4000, bool)
    for b, table in enumerate(lone.tables):
        block = lone._block(value, b)
        passed |= (table[block >> 3] >> (block & 7).astype(np.uint8) & 1).astype(bool)
    assert passed.mean() < 0.45 or radius > 21  # blocks do leave out most of what is random


def test_fingerprints_by_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    hashes, weights = rng.integers(0, 2**63, 700).astype(np.uint64), rng.integers(1, 6, 700).astype(np.uint8)
    starts = np.sort(rng.integers(0, 650, 90))
    ends = np.minimum(starts + rng.integers(1, 60, 90), 700)

    def brute(a, b):
        votes = [sum((1 if int(h) >> k & 1 else -1) * int(w) for h, w in zip(hashes[a:b], weights[a:b])) for k in range(64)]
        return sum(1 << k for k in range(64) if votes[k] > 0)

    for stretch, short in ((1 << 14, 6000), (50, 6000), (50, 1)):
        monkeypatch.setattr(decontaminate, "STRETCH", stretch)
        monkeypatch.setattr(decontaminate, "SHORT", short)
        for print_, a, b in zip(decontaminate.fingerprints(hashes, weights, [(starts, ends)])[0], starts, ends):
            assert int(print_) == brute(a, b)


def test_passages_against_all_windows():
    """Changed passages of a similarity of 0.75 and more: the share that SimHash finds, each with the exact best value."""
    import pyarrow as pa

    rng = random.Random(1)
    items = [(i, [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(14, 60))]) for i in range(40)]
    index = decontaminate.Items([(i, " ".join(t)) for i, t in items], 21)
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    mass = lambda b: sum(c * len(set(s)) for s, c in b.items())

    def best(doc, item):
        n, own, top = min(len(item), len(doc)), bag(item), 0.0
        for a in range(len(doc) - n + 1):
            w = bag(doc[a : a + n])
            both = sum(min(c, own[s]) * len(set(s)) for s, c in w.items() if s in own)
            top = max(top, both / (mass(own) + mass(w) - both))
        return top

    texts, expected = [], []
    for _ in range(500):
        i, words_ = rng.choice(items)
        changed = list(words_)
        for _ in range(rng.randrange(3)):
            j = rng.randrange(len(changed))
            changed[j : j + rng.randrange(2)] = [f"w{rng.randrange(3000)}"] * rng.randrange(2)
        doc = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(50))] + changed + [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(50))]
        s = best(doc, words_)
        texts.append(" ".join(doc))
        expected.append((i, s))
    got = index.matches(pa.array(texts), 0.75)
    due = {(r, i): s for r, (i, s) in enumerate(expected) if s >= 0.75}
    assert len(due) > 300 and all(abs(got[k][0] - s) < 1e-9 for k, s in due.items() if k in got)
    assert sum(k in got for k in due) >= 0.98 * len(due)
    assert not [k for r, (i, s) in enumerate(expected) if (k := (r, i)) in got and s < 0.75]


def _peak(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_very_long_text_takes_little_memory():
    import pyarrow as pa

    item = words(40, 31)
    text = pa.array([" ".join([*item, *words(400_000, 32), *item])])
    index = decontaminate.Items([(1, " ".join(item))], 21)
    found = {}
    assert _peak(lambda: found.update(index.matches(text, 0.75))) < 200 << 20
    assert found == {(0, 1): (1.0, 0, 40, 0)}


def license_brute(text, table):
    n = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = " " + " ".join(n) + " "
    found = []
    for i, r in enumerate(table):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm) if r.keyword in norm else ():
            a = norm[: m.start()].count(" ") - 1
            found.append((r.label, a, a + m.group().count(" ") + 1, r.priority, r.base, i))
    covers = lambda e, d: e[1] <= d[1] and e[2] >= d[2] and (e[5], e[1]) != (d[5], d[1]) and (e[3] > d[3] or e[3] == d[3] and (e[2] - e[1] > d[2] - d[1] or e[2] - e[1] == d[2] - d[1] and e[5] < d[5]))
    return len(n), sorted(found), sorted(d for d in found if not any(covers(e, d) for e in found))


def test_license_scan(spark):
    table = rules()
    texts = [None, "", "!!!", "Released under the MIT License.", "mit license mit license MIT LICENSE", "Licensed under the Apache License, Version 2.0 (the License)", "GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later", "permits licenses", "CC BY-NC-SA 4.0 CC BY 4.0", "é mit license ß", "mit\nlicense", "a " * 30000 + "apache license"]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        n, found, kept = license_brute(text, table)
        assert (got[i].n_words, sorted(map(tuple, got[i].found)), sorted(map(tuple, got[i].kept))) == (n, found, kept)
    report = {r.doc_id: r for r in license_scan.license_report(docs(spark, list(enumerate(texts)))).collect()}
    assert (report[4].n_base, report[4].first_word, report[4].last_word, report[4].base_labels) == (3, 0, 4, "mit")
    assert report[0].first_word is None and report[0].score == 0.0
    assert "gpl-3.0-or-later" in report[6].labels and "gpl" in report[6].base_labels
    assert license_scan.license_report(docs(spark, [])).count() == 0
    assert license_scan.license_report(docs(spark, [(1, "x y")]), [Rule("l", "x", "x y", 2)]).first().labels == "l"


def test_dense_license_texts(spark):
    """Many detections side by side, against brute force, and a text whose places would take minutes pair by pair."""
    import time

    rng = random.Random(13)
    phrases = ["mit license", "apache license version 2 0", "gnu general public license version 2", "license mit", "cc by sa 4 0", "x", "licensed under the apache license version 2 0", "all rights reserved", "see the license file for details"]
    texts = [" ".join(rng.choice(phrases) for _ in range(150)) for _ in range(4)]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        n, found, kept = license_brute(text, rules())
        assert (got[i].n_words, sorted(map(tuple, got[i].found)), sorted(map(tuple, got[i].kept))) == (n, found, kept)
    at = time.time()
    assert license_scan.license_report(docs(spark, [(1, "mit license " * 10_000)])).first().n_base == 10_000
    assert time.time() - at < 20


def test_every_license_rule_has_its_keyword():
    assert len(rules()) > 300
    for r in rules():
        re.compile(r.pattern)
        assert all(w in r.pattern for w in r.keyword.split())
        assert re.search(r"(?:^|[ (|]| \)\?)" + r.keyword.split()[0], r.pattern)  # it begins a word


def test_language_id(spark):
    rng = random.Random(3)
    kinds = {"aa": ["lorem", "dolor", "amet", "sit"], "bb": ["xyzzy", "quux", "plugh", "thud"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 30)] + [(100, None, "aa"), (101, "12 34 !", "bb"), (102, "lorem amet", None), (None, "quux thud quux", None)]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.predict(d, language_id.fit(d), (F.col("doc_id") % 2).alias("odd"), "score", "text").collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 and not got[i].rejected for i, _, lang in rows[:60])
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].rejected
    assert (got[102].lang_pred, got[None].lang_pred) == ("aa", "bb")
    empty = language_id.fit(d.limit(0))
    assert {r.lang_pred for r in language_id.predict(d, empty).collect()} == {"und"}


def test_language_vectors_against_plain_python():
    """N-gram counts, TF-IDF, cosines and rejection, redone text by text."""
    import pyarrow as pa

    rng = random.Random(21)
    texts = ["".join(rng.choice("abcdefg hié.,4Z") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["", None]
    counts = language_id._counts(pa.array(texts))

    def brute(text):
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode())
        row = np.zeros(language_id.WIDTH, int)
        for i, a in enumerate(raw):
            row[a] += 1
            if i + 1 < len(raw):
                row[language_id.ONE + ((a * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77) % 2**32 >> 12) % language_id.TWO] += 1
            if i + 2 < len(raw):
                row[language_id.ONE + language_id.TWO + ((a * 0xC2B2AE3D + raw[i + 1] * 0x27D4EB2F + raw[i + 2] * 0x165667B1) % 2**32 >> 10) % language_id.THREE] += 1
        row[32] = 0
        return row

    assert np.allclose(np.expm1(counts), [brute(t) for t in texts], atol=1e-3)


def test_language_nearest_centroid_against_plain_python(spark):
    rng = np.random.default_rng(8)
    centroids = rng.random((4, language_id.WIDTH)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = language_id.Model(["aa", "bb"], (rng.random(language_id.WIDTH) + 0.5).astype(np.float32), centroids, np.array([0, 1, 1, 0]), np.array([0.05, 0.2, 0.1, 0.3]))
    rows = [(i, " ".join(words(i % 9 + 1, i, 50))) for i in range(40)]
    got = {r.doc_id: r for r in language_id.predict(docs(spark, rows), model).collect()}
    import pyarrow as pa

    for i, text in rows:
        x = language_id._counts(pa.array([text]))[0] * model.idf
        cosine = [sum(float(a) * float(b) for a, b in zip(x, c)) / math.sqrt(sum(float(a) ** 2 for a in x)) for c in centroids]
        best = max(range(4), key=cosine.__getitem__)
        assert got[i].lang_pred == model.langs[model.owner[best]] and abs(got[i].score - cosine[best]) < 1e-4
        assert got[i].rejected == (cosine[best] < model.least[best])


def test_many_short_texts_take_little_memory(spark):
    import pyarrow as pa

    d = spark.createDataFrame([(i, "lorem ipsum" if i % 2 else "quux thud", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(d)
    batch = pa.record_batch([pa.array(["no"] * 10_000)], ["text"])

    def run():
        for own in language_id.slices(iter([batch]), "text", language_id.BYTES, language_id.ROWS):
            language_id._counts(own.column("text")) * model.idf

    assert _peak(run) < 100 << 20


def test_toxicity_against_plain_python():
    """Embeddings, convolution, pooling and the stretched thresholds, redone word by word."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(words(k, k, 40)) for k in (0, 1, 2, 3, 7, 30)] + ["the of der die und"]
    own, bounds = toxicity.words_of(pa.array(texts))
    bucket, mark = toxicity._hashed(own)
    known = np.unique(bucket[:, :2])[::2]
    m = toxicity.Model(known, rng.normal(0, 1, (len(known) + 1, 5)).astype(np.float32), {w: rng.normal(0, 1, (w, 5, 3)).astype(np.float32) for w in toxicity.WIDTHS}, {w: rng.normal(0, 1, 3).astype(np.float32) for w in toxicity.WIDTHS}, rng.normal(0, 1, 3 * len(toxicity.WIDTHS)).astype(np.float32), 0.3, np.array([0.2, 0.4, 0.6, 0.8, 0.5]))
    m.emb[0] = 0
    codes = own.indices.to_numpy(zero_copy_only=False)
    raw = m.raw(m.ids(bucket), codes, bounds)
    rows = {int(b): i + 1 for i, b in enumerate(known)}
    for k in range(len(texts)):
        vectors = [sum(m.emb[rows.get(int(b), 0)].astype(float) for b in bucket[c]) for c in codes[bounds[k] : bounds[k + 1]]]
        vectors += [np.zeros(5)] * max(toxicity.WIDTHS)
        z, at = m.out_bias, 0
        for w in toxicity.WIDTHS:
            for f in range(3):
                top = max(sum(float(vectors[s + j] @ m.filters[w][j][:, f].astype(float)) for j in range(w)) for s in range(len(vectors) - w + 1 - (max(toxicity.WIDTHS) - w)))
                z += float(m.out[at]) * max(top + float(m.bias[w][f]), 0)
                at += 1
        assert abs(raw[k] - 1 / (1 + math.exp(-z))) < 1e-4
    lang = toxicity._language(mark[codes], bounds)
    assert toxicity.LANGS[lang[-1]] == "de" and toxicity.LANGS[lang[0]] == "other"
    scores = m.score(raw.astype(float), lang)
    assert all((s >= 0.5) == (x >= m.cut[g]) for s, x, g in zip(scores, raw, lang))


def test_toxicity(spark):
    rng = random.Random(9)
    rows = [(i, " ".join([*words(rng.randrange(5, 40), i, 300), *(["Vilest", "grot!"] if i % 3 == 0 else []), *words(5, -i, 300)]), int(i % 3 == 0)) for i in range(300)]
    d = docs(spark, [r[:2] for r in rows] + [(900, None), (901, ""), (None, "vilest")])
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in rows if i % 5] + [(901, None, "t")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, labels), F.lit(1).alias("one"), F.lit("mine").alias("score")).collect()}
    held = [(i, y) for i, _, y in rows if i % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[900].score == got[901].score
    model = toxicity.fit(d, labels)
    dealt = [{r.doc_id: r.score for r in toxicity.score(d.repartition(n), model).collect()} for n in (1, 7)]
    assert dealt[0] == dealt[1]
    none = toxicity.score(d, toxicity.fit(d, labels.limit(0)))
    assert none.count() == d.count()


def test_quality(spark):
    good = lambda i: " ".join(words(60, i, 400)).capitalize() + "."
    rows = [(i, good(i) if i % 4 else "$%# @@ !!" * 20, "h" + str(i % 3), "p" + str(i % 2)) for i in range(200)] + [(500, None, None, None), (None, good(1), "h1", None)]
    d = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, host string, path string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200, 2)] + [(999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.site_quality(d, quality.fit(d, labels), F.col("host"), F.col("path")).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].keep == bool(i % 4) for i in range(200)) >= 195
    assert all(0 < r.path_posterior < 1 and 0 <= r.score <= 1 for r in got.values())
    assert quality.site_quality(d.limit(0), quality.fit(d, labels.limit(0)), F.col("host"), F.col("path")).count() == 0


def test_samples_are_bounded_in_rows(spark, monkeypatch):
    d = spark.createDataFrame([(i % 9, f"word{i % 5} and more {i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)], "doc_id long, quality int, toxic int")
    sizes = []
    monkeypatch.setattr(quality, "train", lambda x, y: sizes.append(len(x)) or quality.Classifier(np.zeros(1), np.ones(1), np.zeros(3)))
    monkeypatch.setattr(toxicity, "train", lambda texts, y: sizes.append(len(texts)))
    quality.fit(d, labels, 20)
    toxicity.fit(d, labels, 20)
    assert sizes == [80, 80]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Words and texts are counted over all rows, more than a sample would hold, and the shards' means don't depend on partitions."""
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "SHARD", 1500)
    rows = [(i, f"w{i % 40} w{i % 7} mine{i // 5} " + ("grot" if i % 2 else "fine"), i % 2) for i in range(4000)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    luck = F.xxhash64("doc_id", "text", F.lit(11))
    held = {r.doc_id for r in d.where(F.pmod(F.shiftright(luck, 40), F.lit(4)) == 3).collect()}
    assert 800 < len(held) < 1200
    counts = Counter()
    for i, text, _ in rows:
        if i not in held:
            own, _ = toxicity.words_of(pa.array([text]))
            counts.update(set(toxicity._hashed(own)[0].ravel().tolist()))
    first, second = (toxicity.fit(d.repartition(n), labels.repartition(n)) for n in (2, 7))
    assert first.buckets.tolist() == sorted(b for b, n in counts.items() if n >= 3)
    assert (first.emb == second.emb).all() and (first.cut == second.cut).all() and first.out_bias == second.out_bias
    got = {r.doc_id: r.predicted for r in toxicity.score(d, first).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 3960


def test_toxicity_moves_as_much_an_epoch_however_many_shards(spark, monkeypatch):
    """Shards are trained on by as many tasks as there are cores, and no text without a label is shuffled."""
    monkeypatch.setattr(toxicity, "SHARD", 20)
    rows = [(i, f"w{i % 40} w{i % 7} " + ("grot" if i % 2 else "fine"), i % 2) for i in range(1200)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3 == 0], "doc_id long, toxic int")
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    kept = {r.doc_id for r in toxicity._marked(d, labels).collect()}
    assert set(range(0, 1200, 3)) <= kept and len(kept) < 410
    options = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1m", "spark.sql.files.maxPartitionBytes": "1m"}
    before, sc = {k: spark.conf.get(k) for k in options}, spark.sparkContext
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few tasks", "")
        toxicity.fit(d, labels)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("few tasks") for s in told.getJobInfo(j).stageIds]
    summed = [s.numTasks for s in stages if s is not None and s.name.startswith("reduceByKey")]
    assert len(summed) == 11 and max(summed) <= sc.defaultParallelism


def test_quality_posteriors_against_plain_python(spark):
    """Shrinkage by the method of moments, hosts within all and paths within hosts, each document left out."""
    rng = random.Random(17)
    rows = [(i, "Good words here. " * rng.randrange(1, 9) if rng.random() < 0.7 else "@@ $$ " * 9, f"h{min(rng.randrange(9), 4)}", f"p{rng.randrange(4)}") for i in range(160)]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int("Good" in t)) for i, t, *_ in rows[::2]], "doc_id long, quality int")
    model = quality.fit(d, labels)
    got = {r.doc_id: r for r in quality.site_quality(d, model, F.col("host"), F.col("path")).collect()}
    import pyarrow as pa

    p = {i: 1 / (1 + math.exp(-float(z))) for (i, *_), z in zip(rows, model.logit(quality.features(pa.array([r[1] for r in rows]))))}
    sites, hosts = defaultdict(list), defaultdict(list)
    for i, _, h, q in rows:
        sites[h, q].append(p[i])
        hosts[h].append(p[i])
    mu = min(max(sum(p.values()) / len(p), 1e-4), 1 - 1e-4)

    def strength(level):
        n = [len(x) for x in level.values()]
        between = sum(len(x) * (sum(x) / len(x) - mu) ** 2 for x in level.values())
        spread = max((between - mu * (1 - mu) * (len(n) - 1)) / max(sum(n) - sum(k * k for k in n) / sum(n), 1e-9), 1e-6)
        return min(max(mu * (1 - mu) / spread - 1, 2), 1e4)

    kh, kp = strength(hosts), strength(sites)
    for i, _, h, q in rows:
        host = (sum(hosts[h]) - p[i] + kh * mu) / (len(hosts[h]) - 1 + kh)
        path = min(max((sum(sites[h, q]) - p[i] + kp * host) / (len(sites[h, q]) - 1 + kp), 1e-4), 1 - 1e-4)
        odds = math.log(p[i] / (1 - p[i])) + math.log(path / (1 - path)) - math.log(mu / (1 - mu))
        assert abs(got[i].doc_score - p[i]) < 1e-9 and abs(got[i].host_posterior - host) < 1e-9 and abs(got[i].path_posterior - path) < 1e-9
        assert abs(got[i].score - 1 / (1 + math.exp(-odds))) < 1e-7
    held = [(i, t) for i, t, *_ in rows[1::2]]
    assert sum(got[i].keep == ("Good" in t) for i, t in held) >= 0.95 * len(held)


CAPTURES = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, digest string"


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://www.A.org:80/x/?utm_source=q&b=2&a=1#f", 10, "response", '"e1"', None, h(Content_Type="t", ETag='"e1"', Date="1"), "d1"),
        (2, "https://a.org/x?a=1&b=2", 20, "response", None, "Mon", h(Content_Type="u"), "d2"),
        (3, "http://a.org/x?b=2&a=1", 15, "revisit", 'W/"e1"', None, h(Date="2", Server="no"), None),
        (4, "http://a.org/x?b=2&a=1", 25, "revisit", '"e1"', "Mon", h(), None),
        (5, "http://a.org/x?b=2&a=1", 26, "revisit", None, "Tue", None, None),
        (6, "http://a.org/x?b=2&a=1", 9, "revisit", '"e1"', None, h(), None),
        (7, None, 9, "revisit", '"e1"', None, h(), None),
        (8, "http://a.org/x?b=2&a=1", None, "revisit", '"e1"', None, h(), None),
        (9, "http://a.org/x?b=2&a=1", 20, "request", '"e1"', None, h(), None),
        (2, "https://a.org/x?a=1&b=2", 20, "response", None, "Mon", h(Content_Type="u"), "d2"),
        (10, "http://a.org/x?b=2&a=1", 27, "revisit", '"z"', None, h(), None),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert {k: (r.status, r.response_id) for k, r in got.items()} == {3: ("resolved", 1), 4: ("resolved", 2), 5: ("mismatch", 2), 6: ("no_response", None), 7: ("no_response", None), 8: ("no_response", None), 10: ("no_validator", 2)}
    assert got[3].headers == {"content-type": "t", "etag": '"e1"', "date": "2"} and got[3].digest == "d1" and got[5].headers is None
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


def test_hot_url_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h.org/{'hot' if i % 3 else i % 7}", rng.randrange(300), rng.choice(["response", "revisit"]), f'"{rng.randrange(2)}"', None, {}, str(i)) for i in range(600)]
    got = {r.record_id: (r.status, r.response_id) for r in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    for i, url, ts, kind, tag, *_ in rows:
        if kind == "revisit":
            before = max(((r[2], r[0], r[4]) for r in rows if r[3] == "response" and r[1] == url and (r[2], r[0]) < (ts, i)), default=None)
            assert got[i] == (("no_response", None) if before is None else ("resolved" if before[2] == tag else "mismatch", before[1]))


def test_one_time_for_all_captures_of_a_url(spark):
    rows = [(i, "http://h.org/", 5, "response" if i % 10 == 0 else "revisit", '"t"', None, {}, str(i)) for i in range(1, 400)]
    got = {r.record_id: (r.status, r.response_id) for r in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert got == {i: ("resolved", i // 10 * 10) if i > 10 else ("no_response", None) for i in range(1, 400) if i % 10}


def test_damaged_warc_files():
    import gzip

    good = [warc.format_record(f"<urn:{i}>", "response", "http://a/", "2024-01-01T00:00:00Z", 200, {}, b"body") for i in range(3)]
    ids = lambda data: [r[0] for r in warc.parse_records(data)]
    assert ids(b"".join(good)) == ["<urn:0>", "<urn:1>", "<urn:2>"]
    for bad in (b"many", b"-5", b"1e3", b"", "٣".encode()):
        broken = good[1].replace(b"Content-Length: " + str(len(good[1].split(b"\r\n\r\n", 1)[1]) - 4).encode(), b"Content-Length: " + bad)
        assert broken != good[1] and ids(good[0] + broken + good[2]) == ["<urn:0>"]
    assert ids(good[0] + good[1][:-10]) == ["<urn:0>"]
    packed = [gzip.compress(x) for x in good]
    assert ids(b"".join(packed)) == ["<urn:0>", "<urn:1>", "<urn:2>"]
    assert ids(packed[0] + packed[1][:-20]) == ["<urn:0>"]
    assert ids(packed[0] + packed[1][:30]) == ["<urn:0>"]
    assert ids(packed[0] + b"no gzip data" + packed[1]) == ["<urn:0>"]
    big = warc.format_record("<urn:9>", "response", "http://a/", "2024-01-01T00:00:00Z", 200, {}, bytes(500_000) + b"end")
    assert [len(r[-1]) for r in warc.parse_records(gzip.compress(big) + packed[0])] == [500_003, 4]
    assert ids(packed[0][:20]) == [] and ids(b"\x1f\x8b") == [] and ids(b"") == [] and ids(b"plain text") == []


def test_warc_round_trip(spark, tmp_path):
    import gzip

    records = [("<urn:1>", "response", "http://a/", "2024-01-01T00:00:00Z", 200, {"ETag": '"x"', "A": "b: c"}, b"body\r\n\r\nWARC/1.1"), ("<urn:2>", "revisit", "http://a/", "2024-01-02T00:00:00Z", 304, {}, b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(warc.format_record(*r) for r in records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.format_record(*r)) for r in records))
    got = warc.read_warc(spark, str(tmp_path)).orderBy("record_id").collect()
    assert len(got) == 4 and bytes(got[0].payload) == records[0][-1]
    assert got[0].headers == {"etag": '"x"', "a": "b: c"} and got[3].http_status == 304


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(words(60, 21, 900))
    passage = " ".join(words(40, 22, 900))
    rows = [(i, " ".join(words(80, 100 + i, 900)), "aa" if i else None) for i in range(30)]
    rows += [(30, base, "aa"), (31, base, "aa"), (32, " ".join(words(30, 23, 900)) + " " + passage, "aa"), (33, "12 34", "aa"), (34, None, "aa")]
    d = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i in range(31)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
