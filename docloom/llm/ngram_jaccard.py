"""Exact set-similarity join of documents on word shingles, reported as components.

How a link is found without comparing everything:

1. *Sets.* Each task turns its documents into sets of shingle hashes and keeps one of each set of equal
   documents (a class). Exact copies cost one row each from here on.
2. *Index.* Shingles are dealt by their hash, packed many to a row. A shingle held by one class alone is skipped at
   once: it can never be in an answer. One that many classes of a task hold is known to be shared, so it doesn't travel to
   the index at all; a mark tells the index to count it among the most frequent.
3. *Positions.* A class gets back its shared shingles with their frequency, rarest first. Unshared ones stand
   before them all, so lists are entered only at the positions where an overlap that is large enough can still
   begin; most classes have no such position and leave here.
4. *Answers from answers.* In each list the class with the smallest unshared part is the hub. Members are checked
   against the hub; those that link share its answer set, so two members of one component need no comparison. For the
   others the overlaps with the hub bound the overlap with each other: what both share with the hub, and what of
   both lies outside it, is all that they can share. A pair that the bound leaves gets its overlap from the hub's answers:
   of each member close to the hub only what it lacks of it and what it adds to it is kept and sent, never its whole set.
5. *Blocks.* What is left of a list is cut into blocks by component, size and what comes after the position. Two
   blocks are skipped as a whole where no pair of theirs can reach the overlap or all are of one component; other
   pairs of blocks are tiles of bounded size, each compared on its own.

All steps keep every link: 2, 3 and 5 are bounds, 4 skips pairs whose documents are known to be connected or can't link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, hash_strings, hot_keys, in_parts, meet, parted, partitions, shingles, slices, space_words
from .components import connected_components

PACKED = "kind int, key int, a binary, b binary"
LOW, BUCKET_BITS = np.uint64(0xFFFF), 20
#: The frequency that stands for all larger ones.
FREQUENT = 32767
#: Shingles that a task holds before it sends them off, and classes among them that make a shingle frequent.
FLUSH, HOT = 1_500_000, 256
#: Bytes of text whose shingles one bucket of the index holds.
BUCKET = 16 << 20
#: Copies from which on a class is joined in parts.
COPIES = 1024
#: Members of a list that are joined at once, and that one block holds beyond it.
SMALL, TILE = 64, 512


def _class_of(shingles_: np.ndarray) -> int:
    """A digest of a set of shingles, in 63 bits."""
    return int.from_bytes(hashlib.blake2b(shingles_.tobytes(), digest_size=8).digest(), "little") >> 1


EMPTY = _class_of(np.zeros(0, np.uint64))


def _needs(sim: tuple[int, int]) -> tuple[int, int]:
    """(p, q): sets of a and b elements link when q * overlap >= p * (a + b)."""
    return sim[0], sim[0] + sim[1]


def _pack(batches: Iterator[pa.RecordBatch], buckets: int, width: int, most: int) -> Iterator[pa.RecordBatch]:
    """kind 0: shingles of a bucket and their classes; kind 1: documents and their classes; kind 2: classes; kind 3: shingles
    that are frequent here, by their classes; kind 4: the same by bucket, without classes."""
    out: list[tuple[int, int, bytes, bytes]] = []
    seen: dict[int, list[int]] = {}
    docs: list[tuple[int, int]] = []
    tokens: list[np.ndarray] = []
    held, turn = 0, 0

    def flush() -> None:
        nonlocal held, turn
        if docs:
            d = np.array(docs, np.int64)
            out.append((1, (turn + int(d[0, 0])) % buckets, d[:, 0].tobytes(), d[:, 1].tobytes()))
            turn += 1
        table = np.array([[c, *x[:2]] for c, x in seen.items()], np.int64).reshape(-1, 3)
        home = table[:, 0] % buckets
        for k in np.unique(home):
            out.append((2, int(k), table[home == k].tobytes(), b""))
        if tokens:
            t = np.concatenate(tokens)
            index = np.repeat(np.array([x[2] for x in seen.values() if x[2] >= 0], np.uint64), [len(x) for x in tokens])
            classes = np.array([c for c, x in seen.items() if x[2] >= 0], np.int64)
            bucket = ((t & np.uint64((1 << BUCKET_BITS) - 1)) * np.uint64(buckets)) >> np.uint64(BUCKET_BITS)
            ordered = np.sort(t)
            hot = np.unique(ordered[most:][ordered[most:] == ordered[:-most]])
            if len(hot):
                at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
                frequent = hot[at] == t
                value = (t[frequent] >> np.uint64(16)) | np.uint64(FREQUENT << 48)
                _, one = np.unique(t[frequent], return_index=True)
                for k in np.unique(marks := bucket[frequent][one]):
                    out.append((4, int(k), value[one][marks == k].tobytes(), b""))
                out.extend(_by_class(3, value, classes[index[frequent].astype(np.int64)], buckets))
                t, index, bucket = t[~frequent], index[~frequent], bucket[~frequent]
            order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
            t, index, bucket = t[order], index[order], bucket[order]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(t)] if len(t) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, at = np.unique(index[a:b], return_inverse=True)
                out.append((0, int(bucket[a]), ((t[a:b] & ~LOW) | at.astype(np.uint64)).tobytes(), classes[own.astype(np.int64)].tobytes()))
        seen.clear(), docs.clear(), tokens.clear()
        held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        if out:
            kinds, keys, a, b = zip(*out, strict=True)
            out.clear()
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(keys, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["kind", "key", "a", "b"])

    for batch in slices(batches, "text"):
        words, bounds = space_words(batch.column("text"))
        hashes = hash_strings(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
        all_of, starts = shingles(hashes, bounds, width)
        for i, doc in enumerate(batch.column("doc_id").to_pylist()):
            own = np.unique(all_of[starts[i] : starts[i + 1]])
            cls = _class_of(own)
            docs.append((doc, cls))
            if cls in seen:
                seen[cls][1] = min(seen[cls][1], doc)
                continue
            seen[cls] = [len(own), doc, len(tokens) if len(own) else -1]
            if len(own):
                tokens.append(own)
                held += len(own)
            if held >= FLUSH or len(tokens) >= 60_000:
                flush()
                yield from sent()
    flush()
    yield from sent()


def _by_class(kind: int, value: np.ndarray, classes: np.ndarray, buckets: int) -> list[tuple[int, int, bytes, bytes]]:
    """Shingles with their frequency, packed for the buckets of their classes."""
    home = classes % buckets
    order = np.argsort(home, kind="stable")
    value, classes, home = value[order], classes[order], home[order]
    cuts = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
    return [(kind, int(home[a]), value[a:b].tobytes(), classes[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _index(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """One bucket of the inverted index: shingles of two classes at least go back to their classes, with frequency."""
    passed = pdf[pdf.kind.isin((1, 2, 3))]
    own = pdf[pdf.kind == 0]
    marked = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in pdf[pdf.kind == 4].a)])) & np.uint64((1 << 48) - 1)
    rows: list[tuple[int, int, bytes, bytes]] = []
    if len(own):
        parts = [np.frombuffer(x, np.uint64) for x in own.a]
        dicts = [np.frombuffer(x, np.int64) for x in own.b]
        x = np.concatenate(parts)
        classes = np.concatenate([d[(p & LOW).astype(np.int64)] for p, d in zip(parts, dicts, strict=True)])
        t = x >> np.uint64(16)
        del parts, x
        order = np.argsort(t)
        t, classes = t[order], classes[order]
        same = t[1:] == t[:-1]
        frequent = marked[np.minimum(np.searchsorted(marked, t), len(marked) - 1)] == t if len(marked) else np.zeros(len(t), bool)
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | frequent
        t, classes, frequent = t[shared], classes[shared], frequent[shared]
        order = np.lexsort((classes, t))
        t, classes, frequent = t[order], classes[order], frequent[order]
        if len(t):
            first = np.concatenate([[True], (t[1:] != t[:-1]) | (classes[1:] != classes[:-1])])  # repeats of a class
            t, classes, frequent = t[first], classes[first], frequent[first]
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            df = np.repeat(sizes := np.diff(np.concatenate([starts, [len(t)]])), sizes)
            df = np.where(frequent, FREQUENT, np.minimum(df, FREQUENT))
            kept = df > 1
            rows = _by_class(0, (df[kept].astype(np.uint64) << np.uint64(48)) | t[kept], classes[kept], buckets)
    return pd.concat([passed, pd.DataFrame(rows, columns=["kind", "key", "a", "b"])], ignore_index=True)


def _classes(pdf: pd.DataFrame, sim: tuple[int, int]) -> pd.DataFrame:
    """Documents (kind 1), classes (kind 2), and the classes that may link with their shared shingles (kind 0)."""
    frames = []
    for row in pdf[pdf.kind == 1].itertuples():
        frames.append(pd.DataFrame({"kind": 1, "cls": np.frombuffer(row.b, np.int64), "doc": np.frombuffer(row.a, np.int64), "n": 0, "toks": None}))
    if (pdf.kind == 2).any():
        table = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in pdf[pdf.kind == 2].a])
        table = table[np.lexsort((table[:, 2], table[:, 0]))]
        table = table[np.concatenate([[True], table[1:, 0] != table[:-1, 0]])]
        frames.append(pd.DataFrame({"kind": 2, "cls": table[:, 0], "doc": table[:, 2], "n": table[:, 1], "toks": None}))
        own = pdf[pdf.kind.isin((0, 3))]
        if len(own):
            value = np.concatenate([np.frombuffer(x, np.int64) for x in own.a])
            classes = np.concatenate([np.frombuffer(x, np.int64) for x in own.b])
            order = np.lexsort((value, classes))
            value, classes = value[order], classes[order]
            first = np.concatenate([[True], (value[1:] != value[:-1]) | (classes[1:] != classes[:-1])])
            value, classes = value[first], classes[first]
            starts = np.concatenate([np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])), [len(classes)]])
            ids, sizes = classes[starts[:-1]], np.diff(starts)
            n = table[np.searchsorted(table[:, 0], ids), 1]
            may = np.flatnonzero(sim[1] * sizes >= sim[0] * n)  # an overlap needs so many shared shingles at least
            frames.append(pd.DataFrame({"kind": 0, "cls": ids[may], "doc": 0, "n": n[may], "toks": [value[starts[i] : starts[i + 1]] for i in may]}))
    out = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({"kind": [], "cls": [], "doc": [], "n": [], "toks": []})
    return out.astype({"kind": "int32", "cls": "int64", "doc": "int64", "n": "int64"})[["kind", "cls", "doc", "n", "toks"]]


def _tile(key: tuple, pdf: pd.DataFrame, sim: tuple[int, int]) -> pd.DataFrame:
    """Pairs of two blocks of one list that can still link and whose components differ, with the hub that both are close
    to (-1: none)."""
    p, q = _needs(sim)
    _, i, j = key
    left, right = pdf[pdf.block == i], pdf[pdf.block == j]
    rn, rp, rl, rc, ro, rh = (right[c].to_numpy() for c in ("n", "pos", "label", "cls", "o", "hub"))
    pairs = []
    for cls, n, pos, label, o, hub in left[["cls", "n", "pos", "label", "o", "hub"]].itertuples(index=False):
        most = np.minimum(n - pos, rn - rp)
        if o >= 0:
            most = np.where(ro >= 0, np.minimum(most, np.minimum(o, ro) + np.minimum(n - o, rn - ro)), most)
        ok = (rl != label) & (q * most >= p * (n + rn)) & ((rc > cls) if i == j else (rc != cls))
        pairs += [(min(cls, x), max(cls, x), min(hub, h)) for x, h in zip(rc[ok], rh[ok], strict=True)]
    return pd.DataFrame(pairs, columns=["a", "b", "hub"], dtype="int64").drop_duplicates()


def _can(left: str, right: str, sim: tuple[int, int]) -> Column:
    """Whether the overlap can be large enough after the positions in a list."""
    p, q = _needs(sim)
    return F.expr(f"{q} * least({left}.n - {left}.pos, {right}.n - {right}.pos) >= {p} * ({left}.n + {right}.n)")


def _can_by_hub(left: str, right: str, sim: tuple[int, int]) -> Column:
    """Whether it can be, by both overlaps o with the list's hub (-1: unknown)."""
    p, q = _needs(sim)
    return F.expr(f"{left}.o < 0 or {right}.o < 0 or {q} * (least({left}.o, {right}.o) + least({left}.n - {left}.o, {right}.n - {right}.o)) >= {p} * ({left}.n + {right}.n)")


def _met(pairs: DataFrame, sets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` (a, b, ``keys``) with the columns of ``sets`` (cls, ``keys``, ...) for a and for b, named with an _a and
    an _b behind. A class of many pairs is met in parts."""
    out, hot = pairs, {side: hot_keys(pairs, *keys, side) for side in "ab"}
    for side, other in (("a", "b"), ("b", "a")):  # parts are dealt while rows are short
        out = parted(out, hot[side], [*keys, side], other, f"part_{side}")
    for side in "ab":
        own = sets.select(*keys, F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in sets.columns if c not in ("cls", *keys)])
        out = out.join(in_parts(own, hot[side], [*keys, side], f"part_{side}"), [*keys, side, f"part_{side}"])
    return out


def _links(sim: tuple[int, int]) -> Column:
    p, q = _needs(sim)
    return q * F.col("o") >= p * (F.col("n_a") + F.col("n_b"))


def _overlaps(pairs: DataFrame, sets: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) with their full overlap o, and whether they link. Where b is more than half of a and a of b, lacks holds
    what a has not of b, and adds what it has besides; ``size`` is that of b's set."""
    both = _met(pairs, sets).withColumn("o", F.size(F.array_intersect("toks_a", "toks_b")).cast("long")).withColumn("size", F.size("toks_b"))
    close = F.col("size") + F.size("toks_a") - 2 * F.col("o") < F.least(F.size("toks_a"), "size")
    differ = lambda x, y: F.when(close, F.array_except(x, y))
    return both.select("a", "b", "o", _links(sim).alias("links"), "n_a", "size", differ("toks_b", "toks_a").alias("lacks"), differ("toks_a", "toks_b").alias("adds"))


def _derived(pairs: DataFrame, close: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that link, of ``pairs`` (hub, a, b) whose both sides ``close`` (hub, cls, n, size, lacks, adds) knows. What
    they share is the hub's set without what either lacks, and what both add."""
    both = _met(pairs, close, ("hub",))
    inside = F.col("size_a") - F.size("lacks_a") - F.size("lacks_b") + F.size(F.array_intersect("lacks_a", "lacks_b"))
    return both.withColumn("o", inside + F.size(F.array_intersect("adds_a", "adds_b"))).where(_links(sim)).select("a", "b")


def _with_large(df: DataFrame, keys: list[str], name: str, most: int) -> DataFrame:
    """``df`` with how many rows have its ``keys``, where that is more than ``most``, else null. Only large counts are
    joined, each to every 32nd class of its rows, so that no task gets all of them."""
    large = df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > most)
    spread_ = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return df.withColumn("salt", F.pmod(F.col("cls"), F.lit(32)).cast("int")).join(spread_, [*keys, "salt"], "left").drop("salt")


def _tiles(large: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """Candidate pairs (a, b, hub) of long lists, by blocks."""
    p, q = _needs(sim)
    own = _with_large(large, ["v", "label"], "alike", TILE // 2).withColumn("main", F.when(F.col("alike").isNotNull(), F.col("label")).otherwise(-1))
    step = lambda c: F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / math.log(1.15))
    own = own.withColumn("size", step(F.col("n"))).withColumn("rest", step(F.col("n") - F.col("pos")))
    cell = ["v", "main", "size", "rest"]
    own = _with_large(own, cell, "cell", TILE)
    own = own.withColumn("block", F.xxhash64("main", "size", "rest", F.pmod(F.xxhash64("cls"), F.ceil(F.coalesce("cell", F.lit(1)) / TILE))))
    own = cut(own.select("v", "block", "main", "cls", "n", "pos", "label", "o", "hub"))
    blocks = own.groupBy("v", "block").agg(F.first("main").alias("main"), F.count("*").alias("held"), F.min("n").alias("n"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    x, y = blocks.alias("x"), blocks.alias("y")
    met = x.join(y, "v").where("x.block <= y.block and (x.main < 0 or x.main <> y.main) and (x.block <> y.block or x.held > 1)")
    met = met.where(F.expr(f"{q} * least(x.rest, y.rest) >= {p} * (x.n + y.n)")).select("v", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sent = own.join(met.select("v", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), ["v", "block"])
    return sent.groupBy("v", "i", "j").applyInPandas(lambda key, pdf: _tile(key, pdf, sim), "a long, b long, hub long")


def ngram_jaccard(documents: DataFrame, width: int = 5, similarity: tuple[int, int] = (3, 4)) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of ``documents`` (doc_id, text).

    Two documents link when their sets of ``width``-word shingles have Jaccard similarity >= similarity (a
    fraction above 1/2); component_id is the smallest doc_id reachable by links. class_id is the smallest
    doc_id with an equal set. Texts are taken whole; A-Z lower-cased, words are runs without ASCII white
    space; a text of fewer words is one shingle. Null, empty and blank texts have an empty set and link with
    nothing, not even each other. Rows without doc_id are left out. Rows that repeat a doc_id come back once
    each, and a doc_id with several texts is connected through them; equal rows are equal in the result.
    """
    spark, sim = documents.sparkSession, similarity
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(partitions(spark), -(-size // BUCKET)), 1 << BUCKET_BITS)
    most = HOT
    packed = rows.mapInArrow(lambda it: _pack(it, buckets, width, most), PACKED).repartition(buckets, "key")
    back = packed.groupBy("key").applyInPandas(lambda pdf: _index(pdf, buckets), PACKED).repartition(buckets, "key")
    table = cut(back.groupBy("key").applyInPandas(lambda pdf: _classes(pdf, sim), "kind int, cls long, doc long, n long, toks array<long>"), "kind")
    docs = table.where("kind = 1").select("cls", F.col("doc").alias("doc_id"))
    classes = table.where("kind = 2").select("cls", "n", F.col("doc").alias("class_id"))
    sets = table.where("kind = 0").select("cls", "n", "toks")

    first = F.col("n") - F.ceil(F.col("n") * sim[0] / sim[1]) + 1 - (F.col("n") - F.size("toks"))  # positions where a link can begin
    postings = cut(sets.where(first > 0).select("cls", "n", F.size("toks").alias("m"), F.posexplode(F.slice("toks", 1, first.cast("int"))).alias("i", "v")).select("v", "cls", "n", "m", (F.col("n") - F.col("m") + F.col("i")).alias("pos")))
    hubs = postings.groupBy("v").agg(F.count("*").alias("held"), F.min(F.struct((1 - F.col("m") / F.col("n")).alias("own"), "cls", "n", "pos")).alias("h")).where("held > 1")
    hubs = cut(hubs.select("v", "held", "h.cls", "h.n", "h.pos"))
    pairs = postings.alias("x").join(hubs.alias("y"), "v").where("x.cls <> y.cls").where(_can("x", "y", sim))
    pairs = cut(pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())
    checked = cut(_overlaps(pairs, sets, sim))
    star = checked.where("links").select("a", "b")

    labels = connected_components(star)
    known = postings.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = known.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
    known = known.join(mixed.join(hubs.select("v", "held", F.col("cls").alias("hub")), "v"), "v")
    answers = checked.select(F.col("a").alias("cls"), F.col("b").alias("hub"), "o", F.col("lacks").isNotNull().alias("near"))
    known = known.join(answers, ["cls", "hub"], "left")
    o = F.when(F.col("cls") == F.col("hub"), F.col("n")).otherwise(F.coalesce("o", F.lit(-1))).cast("long")
    known = cut(known.select("v", "held", "cls", "n", "pos", "label", o.alias("o"), F.when(F.col("near"), F.col("hub")).otherwise(-1).alias("hub")))
    drop(postings, hubs, pairs)
    small = known.where(F.col("held") <= SMALL)
    near = small.alias("x").join(small.alias("y"), "v").where("x.cls < y.cls and x.label <> y.label").where(_can("x", "y", sim)).where(_can_by_hub("x", "y", sim))
    near = near.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.least("x.hub", "y.hub").alias("hub"))
    far = _tiles(known.where(F.col("held") > SMALL), sim)
    left = cut(near.union(far).groupBy("a", "b").agg(F.max("hub").alias("hub")))
    close = checked.where("lacks is not null").select(F.col("b").alias("hub"), F.col("a").alias("cls"), F.col("n_a").alias("n"), "size", "lacks", "adds")
    more = _derived(left.where("hub >= 0"), close, sim)
    rest = left.where("hub < 0").select("a", "b")
    if not rest.isEmpty():
        more = more.union(_overlaps(rest, sets, sim).where("links").select("a", "b"))

    full = docs.where(F.col("cls") != EMPTY)
    several = full.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("doc_id", "a")
    tied = full.join(several, "doc_id").where("cls <> a").select("a", F.col("cls").alias("b"))  # a doc_id with several texts ties its classes
    joined = connected_components(star.union(more).union(tied))
    ends = joined.withColumnRenamed("node", "cls").join(classes, "cls")
    best = ends.groupBy("label").agg(F.min("class_id").alias("component_id"), F.count("*").alias("held"))
    ends = meet(ends.select("cls", "label"), best, "label", "cls").select("cls", "component_id")
    whole = classes.join(ends, "cls", "left")
    copied = docs.groupBy("cls").agg(F.count("*").alias("held")).where(F.col("held") > COPIES).join(whole, "cls")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
    copied = copied.select("cls", F.struct("n", "class_id", "component_id").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    met = docs.withColumn("salt", salt).join(copied, ["cls", "salt"], "left").drop("salt")  # a class of many copies in 64 parts
    out = met.where("of is not null").select("doc_id", "of.*").unionByName(met.where("of is null").select("doc_id", "cls").join(whole, "cls").drop("cls"))
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component_id", "class_id")).alias("component_id"))
