"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"
LOWER = {i: i + 32 for i in range(65, 91)}


def counts_by_hand(rows, depth=4):
    out = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, depth + 1):
                for i in range(len(words) - m + 1):
                    out[lang or "und", tuple(words[i : i + m])] += 1
    return out


def by_hand(rows, least, depth=4):
    f = counts_by_hand(rows, depth)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, longer), b in candidates.items():
        for m in range(2, len(longer)):
            for i in range(len(longer) - m + 1):
                part = lang, longer[i : i + m]
                if 100 * b >= 80 * candidates[part]:
                    gone.add(part)
    n, out = Counter(), {}
    for (lang, words), a in f.items():
        n[lang] += a * (len(words) == 1)
    for (lang, words), a in candidates.items():
        if (lang, words) not in gone:
            cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {lang: [(i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(own), 1)] for lang, own in out.items()}


def corpus(seed=3):
    r = random.Random(seed)
    words = ["a", "B", "the", "of", "É", "日本", "x-y", "(", "\x00", " q", "Straße"]
    rows = []
    for i in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(r.randrange(60)))
        rows.append((i, text if i % 50 else r.choice([None, "", " \t", "...", "word"]), r.choice(["en", "en", "de", None, "und"])))
    return rows + [(1000 + i, "New York City hall", "en") for i in range(40)] + [(2000, "tick " * 5000, "fr")]


def run(spark, rows, least=30):
    found = C.top_collocations(C.collocations(spark.createDataFrame(rows, SCHEMA), least=least)).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    return out


@pytest.mark.parametrize(("shard", "least_bits"), [(6 << 20, 15), (2000, 15)])
def test_equals_counting_by_hand(spark, monkeypatch, shard, least_bits):
    monkeypatch.setattr(C, "SHARD_BYTES", shard)
    monkeypatch.setattr(C, "LEAST_BITS", least_bits)
    rows = corpus()
    found = run(spark, rows)
    assert found == by_hand(rows, 30)
    assert ("new york city hall" in {x[1] for x in found["en"]}) and not {"new york", "york city", "city hall", "new york city"} & {x[1] for x in found["en"]}


def test_a_full_bitmap_lets_rare_phrases_through_without_counting_them(spark, monkeypatch):
    monkeypatch.setattr(C, "_bitmap", lambda keys: (np.full(4096, 255, np.uint8), 15))
    rows = corpus(5)
    assert run(spark, rows, 3) == by_hand(rows, 3)


def test_states_of_the_automaton_are_classes_of_end_positions():
    rows = corpus(7)
    shard = C.Shard(pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows]))
    machine = C.Automaton(shard.letters, shard.pieces)
    for _ in range(3):
        machine.deepen()
    expected, found = counts_by_hand(rows), Counter()
    ends = {}  # a substring's end positions
    for m in range(1, 5):
        numbers, shortest = machine.states(m)
        langs = shard.langs.take(pa.array(shard.letters[machine.last[m][numbers]])).to_pylist()
        for lang, phrase, number, low in zip(langs, shard.phrases(machine, m, numbers).to_pylist(), numbers, shortest, strict=True):
            words = tuple(phrase.split(" "))
            for k in range(low, m + 1):
                assert (lang, words[m - k :]) not in found  # each substring is in one state
                found[lang, words[m - k :]] = int(machine.count[m][number])
                ends[lang, words[m - k :]] = frozenset(np.flatnonzero(machine.ends[m] == number))
            if low > 1:  # the link: a suffix that ends at more places
                link = machine.ends[low - 1][machine.last[m][number]]
                assert machine.count[low - 1][link] > machine.count[m][number]
    assert found == expected
    assert all(len(ends[k]) == n for k, n in expected.items())


def test_scores_past_64_bits(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a", 9 * 10**15), ("en", "b", 7 * 10**15)], "lang string, phrase string, f long")
    phrases = spark.createDataFrame([("en", "a b", 6 * 10**15 + 1)], "lang string, phrase string, f long")
    monkeypatch.setattr(C, "phrase_counts", lambda *_: (words, phrases))
    row = C.collocations(words).first()
    assert row.score == 2_000_000 * (6 * 10**15 + 1) // (16 * 10**15)


def test_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "x y. y x. x y", "en")] * 20 + [(None, "p q", "en")] * 40
    df = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit(1)).withColumn("n", F.lit("n"))
    found = C.top_collocations(C.collocations(df)).orderBy("rank").collect()
    assert [(r.phrase, r.a, r.n) for r in found] == [("p q", 40, 200), ("x y", 40, 200)]
    assert [r.phrase for r in C.top_collocations(C.collocations(df), 1).collect()] == ["p q"]


def test_empty_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None, None), (2, "", "en")]) == {}
