"""Source mixing against plain Python that sorts."""

import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def targets_by_hand(sizes, weights=(3, 1, 2), percent=150, most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, Fraction(percent * sum(sizes.values()), 100)
    while True:
        left = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / (sum(weight[s] for s in left) or 1)
        above = [s for s in left if share * weight[s] > most * sizes[s]]
        if not above:
            return {s: fixed.get(s, share * weight[s]) for s in order}
        fixed |= {s: Fraction(most * sizes[s]) for s in above}


def taken_by_hand(rows, **options):
    size = lambda t: len((t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")) - (t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ").count("")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    targets, out = targets_by_hand(sizes, **options), []
    for s, target in targets.items():
        own = {}
        for doc, text, source in rows:
            if source == s:
                own.setdefault(hashlib.md5(str(doc).encode()).hexdigest()[:15], []).append((doc, size(text)))
        rest = target - (target // sizes[s]) * sizes[s] if sizes[s] else 0
        before, open_ = 0, True
        for _, same in sorted(own.items()):
            after = before + sum(n for _, n in same)
            take = open_ and (after <= rest or after - rest < rest - before)
            open_ = open_ and after <= rest
            before = after
            out += [(doc, n, sizes[s], n * (int(target // sizes[s] if sizes[s] else 0) + take)) for doc, n in same]
    return sorted(out), targets


def run(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, SCHEMA), **options).collect()


def corpus():
    words = lambda i: (i * 7919) % 97 + (3000 if i % 131 == 0 else 0)
    return [(i, " ".join(["w"] * words(i)) + "\t \x0bend\n" * (i % 2), None if i % 17 == 0 else f"s{'é' if i % 3 == 0 else 'x'}{(i * i) % 11 if i % 3 else 0}") for i in range(1500)] + [(9000 + i, None, "zero") for i in range(3)]


@pytest.mark.parametrize("few", [10_000, 0])
def test_equals_sorting_by_hand(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)  # 0: targets are joined instead of sent to all tasks
    rows = corpus()
    found = run(spark, rows)
    expected, targets = taken_by_hand(rows)
    assert sorted((r.doc_id, r.size, r.source_size, r.taken) for r in found) == expected
    assert {r.source: r.target for r in found} == {s: float(t) for s, t in targets.items()}
    for s, target in targets.items():
        own = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2


def test_smaller_targets_take_part_of_larger_ones(spark):
    rows = corpus()
    copies = [{r.doc_id: r.copies for r in run(spark, rows, percent=p)} for p in (40, 90, 150, 260)]
    for less, more in zip(copies, copies[1:]):
        assert all(less[d] <= more[d] for d in less)
    assert {copies[-1][d] for d, text, _ in rows if text} == {2}  # every source stops at twice its size


def test_ties_missing_values_and_clashing_columns(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d", "s"), (None, "no id", "s"), (None, None, None), (2, "", ""), (3, "x " * 50_000, "long")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("own")).withColumn("hash", F.lit(1))
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    assert len({r.copies for r in found if r.doc_id == 1}) == 1
    assert all(r.taken <= 2 * r.size for r in found)
    assert next(r for r in found if r.doc_id == 3).size == 50_000
    assert [r.source_size for r in found if r.source is None] == [0]
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_one_source_of_equal_hashes_to_the_last_bit(spark):
    hashes = [(0, 5), ((1 << 60) - 1, 5), ((1 << 59) + 1, 5), (1 << 59, 5)]
    rows = spark.createDataFrame([("s", h, n) for h, n in hashes], "source_key string, hash long, size long")
    budgets = spark.createDataFrame([("s", 0, 12.0), ("s", 1, 0.5), ("s", 2, 99.0), ("s", 3, 8.0)], "source_key string, level int, budget double")
    found = {r.level: r.below for r in mixing.budget_thresholds(rows, budgets).collect()}
    assert found == {0: (1 << 59) + 1, 1: 0, 2: 1 << 60, 3: (1 << 59) + 1}


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert [(r.target, r.taken) for r in run(spark, [(1, None, "a"), (2, "", None)])] == [(0.0, 0), (0.0, 0)]


def test_targets_of_millions_of_words(spark):
    """A share of 1.5e9 is an int; times a weight it no longer is."""
    sizes = {"a": 8_000_000, "b": 2_000_000}
    sources = spark.createDataFrame([(f"s{k}", n) for k, n in sizes.items()], "source_key string, source_size long")
    got = {r.source_key[1:]: r.target for r in mixing.source_targets(sources).collect()}
    assert got == {k: float(v) for k, v in targets_by_hand(sizes).items()} == {"a": 11_250_000.0, "b": 3_750_000.0}
