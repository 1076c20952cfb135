"""Corpus profiling, sequence statistics over segments, TF-IDF, topics and hidden Markov models."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import markov as M
from .fold import fold_groups
from .lineage import cut, drop


def media_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("media_type").agg(F.count("*").alias("n"))


def distribution(values: DataFrame, column: str, percentiles: tuple[int, ...]) -> DataFrame:
    """count, min, max, mean and nearest-rank percentiles p<k> of a column; zeros for no rows."""
    if list(percentiles) != sorted(set(percentiles)) or not all(1 <= p <= 100 for p in percentiles):
        raise ValueError("percentiles must rise from 1 to 100")
    at = [F.coalesce(F.expr(f"percentile_disc({p / 100}) within group (order by {column})"), F.lit(0.0)).cast("double").alias(f"p{p}") for p in percentiles]
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("double").alias(name)
    return values.agg(F.count(column).alias("n"), zero(F.min(column), "min"), zero(F.max(column), "max"), F.round(F.coalesce(F.avg(column), F.lit(0.0)), 9).alias("mean"), *at)


def tag_report(items: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(counts of tagged, untagged and different tags; the most frequent tags, each occurrence counted)."""
    tags = items.select(F.explode("tags").alias("tag"))
    some = F.size(F.coalesce("tags", F.array())) > 0
    counts = items.agg(F.count_if(some).alias("tagged"), F.count_if(~some).alias("untagged")).crossJoin(tags.agg(F.countDistinct("tag").alias("unique_tags")))  # two rows of totals
    return counts, tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(top)


def text_report(items: DataFrame, least: int = 1) -> DataFrame:
    """source, nonempty, empty and missing texts; shorter ones than ``least`` count as empty."""
    n = F.length(T.strip(F.col("text")))
    return items.agg(F.count("*").alias("source"), F.count_if(n >= least).alias("nonempty"), F.count_if(n < least).alias("empty"), F.count_if(F.col("text").isNull()).alias("missing"))


def tfidf(segments: DataFrame, max_features: int, sizes: tuple[int, int] = (1, 2)) -> DataFrame:
    """(key, term, value) of segments (key, text): count by terms in the vocabulary, times (n + 1) / (df + 1), without
    a logarithm. The vocabulary is the ``max_features`` terms of highest document frequency, ties by term."""
    def grams(words: Column, n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))

    tf = segments.select("key", F.explode(T.let(T.term_tokens(F.col("text")), lambda w: F.concat(*[grams(w, n) for n in range(sizes[0], sizes[1] + 1)]))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(max_features)
    total = segments.agg(F.count("*").alias("n"))
    kept = tf.join(vocabulary, "term")
    length = kept.groupBy("key").agg(F.sum("tf").alias("length"))
    return kept.join(length, "key").crossJoin(F.broadcast(total)).select("key", "term", F.round(F.col("tf") / F.col("length") * (F.col("n") + 1) / (F.col("df") + 1), 9).alias("value"))  # total is one row


def transitions(paths: DataFrame, by: str | None) -> DataFrame:
    """(prev, next, n, p) of steps (seq, idx, state), in one chain over all sequences, or inside each one by ``by``.

    One chain needs every sequence's first state after the last one of the sequence before: sequences are put in order
    by blocks of 4,096 numbers, and then the blocks' first states.
    """
    own = Window.partitionBy("seq").orderBy("idx")
    steps = paths.withColumn("next", F.lead("state").over(own)).where("next is not null").select(F.col("state").alias("prev"), "next")
    if by is None:
        ends = paths.groupBy("seq").agg(F.min_by("state", "idx").alias("first"), F.max_by("state", "idx").alias("last")).withColumn("block", F.floor(F.col("seq") / 4096))
        inside = ends.withColumn("next", F.lead("first").over(Window.partitionBy("block").orderBy("seq")))
        heads = ends.groupBy("block").agg(F.min_by("first", "seq").alias("first")).withColumn("after", F.lead("first").over(Window.orderBy("block"))).drop("first")
        over = inside.join(heads, "block").withColumn("next", F.coalesce("next", "after")).where("next is not null")
        steps = steps.union(over.select(F.col("last").alias("prev"), "next"))
    counts = steps.groupBy("prev", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prev")), 9))


def with_boundaries(segments: DataFrame) -> DataFrame:
    """Segments (seq, idx, text) with a START before and an END after each sequence, numbered from 1."""
    ends = segments.groupBy("seq").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    edge = ends.select("seq", F.explode(F.array(F.struct((F.col("lo") - 1).alias("idx"), F.lit("START").alias("text")), F.struct((F.col("hi") + 1).alias("idx"), F.lit("END").alias("text")))).alias("e")).select("seq", "e.idx", "e.text")
    return segments.select("seq", "idx", "text").unionByName(edge).withColumn("idx", F.row_number().over(Window.partitionBy("seq").orderBy("idx")))


def state_report(paths: DataFrame, exemplars: int) -> DataFrame:
    """(state, n, examples, label): the first texts of each state, and its most frequent label, ties to the first seen."""
    order = Window.partitionBy("state").orderBy("seq", "idx")
    first = paths.withColumn("i", F.row_number().over(order)).where(F.col("i") <= exemplars).groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x.text).alias("examples"))
    labels = paths.groupBy("state", "label").agg(F.count("*").alias("m"), F.min(F.struct("seq", "idx")).alias("seen"))
    best = labels.groupBy("state").agg(F.sum("m").alias("n"), F.max("m").alias("m"))
    top = labels.join(best, ["state", "m"]).groupBy("state", "n").agg(F.min_by("label", "seen").alias("label"))
    return top.join(first, "state")


def state_positions(paths: DataFrame, start: Column, end: Column) -> DataFrame:
    """(state, after_start, before_end, position): shares of what follows START and precedes END, and the mean place
    of states other than those in their sequence, 0 to 1."""
    own = Window.partitionBy("seq").orderBy("idx")
    rows = paths.withColumn("prev", F.lag("state").over(own)).withColumn("next", F.lead("state").over(own)).withColumn("at", F.row_number().over(own) - 1).withColumn("size", F.count("*").over(Window.partitionBy("seq"))).where("size > 1")
    inner = (F.col("state") != start) & (F.col("state") != end)
    out = rows.groupBy("state").agg(F.count_if(F.col("prev") == start).alias("s"), F.count_if(F.col("next") == end).alias("e"), F.coalesce(F.avg(F.when(inner, F.col("at") / (F.col("size") - 1))), F.lit(0.0)).alias("position"), F.count_if(inner).alias("m"))
    total = out.agg(F.greatest(F.sum("s"), F.lit(1)).alias("ts"), F.greatest(F.sum("e"), F.lit(1)).alias("te"))
    return out.where("m > 0 or s > 0 or e > 0").crossJoin(F.broadcast(total)).select("state", F.round(F.col("s") / F.col("ts"), 9).alias("after_start"), F.round(F.col("e") / F.col("te"), 9).alias("before_end"), F.round("position", 9).alias("position"))  # total is one row


def paths_of(states: DataFrame) -> DataFrame:
    """(seq, path): states of each sequence in order."""
    return states.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "state"))), lambda x: x.state).alias("path"))


def merge_adjacent(segments: DataFrame) -> DataFrame:
    """Segments without those that repeat, or are contained in, the one before; a longer one takes the place of a
    contained one before it. (seq, idx, text) in, numbered from 1 out. See ``stitch_segments``."""
    return stitch_segments(segments).select("seq", F.col("nth").alias("idx"), "text")


def stitch_segments(segments: DataFrame) -> DataFrame:
    """(seq, nth, idx, text) of segments (seq, idx, text), whose neighbours may overlap, as those of overlapping chunks do.

    In order of idx, a segment whose stripped text is in the last one's goes; one that holds the last one's takes its
    place, with its own idx; any other stays. Blank ones go. nth numbers what is left from 1. Only the last text is
    carried from row to row.
    """
    kind = dict(segments.dtypes)
    return _stitched(segments.select("seq", "idx", "text"), ["idx", "text"], f"seq {kind['seq']}, nth int, idx {kind['idx']}, text string")


def _stitched(rows: DataFrame, order: list[str], schema: str) -> DataFrame:
    """Rows without idx are numbered from 1, but for blank ones."""
    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        nth, met, last = state
        text = (row["text"] or "").strip()
        met += bool(text)
        if not text or last is not None and text in last["text"]:
            return (nth, met, last), []
        own = {"seq": row["seq"], "nth": nth + 1, "idx": row.get("idx", met), "text": text}
        if last is None:
            return (nth + 1, met, own), []
        if last["text"] in text:
            return (nth, met, own | {"nth": nth}), []
        return (nth + 1, met, own), [last]

    return fold_groups(rows, "seq", order, lambda: (0, 0, None), step, lambda _, state: [state[2]] if state[2] else [], schema)


def span_segments(items: DataFrame, mark: Callable[[Column], Column], chunk_characters: int | None = None, overlap: int = 0, label: str | None = None, prepend_label: bool = False) -> DataFrame:
    """(seq, nth, idx, text): the texts of marked spans of items (seq, text), in order.

    A text is cut into chunks of ``chunk_characters`` that overlap; ``mark`` puts span tags into each (what marks them is
    the caller's); spans are numbered over all of an item's chunks, blank ones left out, and those that overlapping chunks
    have twice, or in part, are stitched by ``stitch_segments``. With ``prepend_label`` the span's attribute ``label``
    stands on a line before its text, and a span without it is an error. Null and empty texts give no rows. Chunks, not
    items, are marked and parsed as rows of their own; a chunk's spans travel with its number.
    """
    from ..functions import markup as M
    from .chunk import char_windows

    if prepend_label and label is None:
        raise ValueError("prepend_label needs a label attribute")
    text = T.first_speaker(F.coalesce("text", F.lit("")))
    chunks = F.array(F.struct(text.alias("text"))) if chunk_characters is None else T.let(text, lambda t: F.transform(char_windows(t, chunk_characters, overlap, keep_blank=True), lambda c: F.struct(c.text.alias("text"))))  # once, not for every chunk
    # texts come whole in hundreds, chunks in Arrow batches, and of their spans only what is used
    read = M.span_values(label) if chunk_characters is not None else lambda c: F.transform(M.parse_spans(c), lambda s: F.struct(s.text.alias("text"), (F.element_at(s.attributes, label) if label else F.lit(None).cast("string")).alias("value")))
    marked = items.select("seq", F.posexplode(chunks).alias("chunk", "c")).where("c.text <> ''").select("seq", "chunk", read(mark(F.col("c.text"))).alias("spans"))
    each = marked.select("seq", "chunk", F.posexplode("spans").alias("place", "s")).where(~T.blank(F.col("s.text")))
    body = T.strip(F.col("s.text"))
    if prepend_label:
        own = T.strip(F.coalesce(F.col("s.value"), F.lit("")))
        body = F.concat(F.when(own == "", F.raise_error(F.lit(f"a span has no {label}"))).otherwise(own), F.lit("\n"), body)
    return _stitched(each.select("seq", "chunk", "place", body.alias("text")), ["chunk", "place"], f"seq {dict(items.dtypes)['seq']}, nth int, idx int, text string")


def topic_keywords(assigned: DataFrame, top: int) -> DataFrame:
    """(topic, term, score, rank): class-based TF-IDF, tf * ln(1 + mean words of a topic / frequency of the term)."""
    tf = assigned.select("topic", F.explode(T.term_tokens(F.col("text"))).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("tf"))
    tf = cut(tf)  # read three times: counts, not texts
    sizes = tf.groupBy("topic").agg(F.sum("tf").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    score = F.round(F.col("tf") / F.col("size") * F.log(1 + F.col("mean") / F.col("freq")), 9)
    scored = tf.join(tf.groupBy("term").agg(F.sum("tf").alias("freq")), "term").join(sizes, "topic").crossJoin(F.broadcast(mean)).select("topic", "term", score.alias("score"))  # mean is one row
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= top)


def cluster_topics(documents: DataFrame, k: int, features: int = 1 << 12, seed: int = 13) -> DataFrame:
    """(doc_id, text, topic): k-means over hashed TF-IDF, with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    words = documents.select("doc_id", "text", T.term_tokens(F.col("text")).alias("words"))
    tf = cut(HashingTF(inputCol="words", outputCol="tf", numFeatures=features).transform(words).drop("words"))  # words are taken once, not in every pass
    x = Normalizer(inputCol="idf", outputCol="features").transform(IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf))
    return KMeans(k=k, seed=seed, maxIter=10).fit(x).transform(x).select("doc_id", "text", F.col("prediction").alias("topic"))


def topic_run(items: DataFrame, assign: Callable[[DataFrame], DataFrame], extract: Callable[[Column], Column] | None = None, entities: Callable[[Column], Column] | None = None, least: int = 1, top: int = 10, name: Callable[[list[str]], str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, documents, report) of items (doc_id, text): collect, extract, remove entities, lexical form, assign, name.

    ``extract`` gives texts in place of an item's text, an array of them; ``entities`` takes out what isn't about the
    topic; then the lexical form is taken and texts of fewer than ``least`` characters go. ``assign`` adds topic to
    (doc_id, part, text), part being the text's place in its item. topics: (topic, n, label, keywords), by class-based
    TF-IDF; a topic's label is its first keyword unless ``name`` makes one of its keywords, topics being few.
    documents: (doc_id, part, topic). report: one row of items, texts after extraction, and texts left.
    """
    some = items.where(~T.blank(F.col("text")))
    texts = F.array("text") if extract is None else extract(F.col("text"))
    parts = some.select("doc_id", F.posexplode(texts).alias("part", "text"))
    clean = parts if entities is None else parts.withColumn("text", entities(F.col("text")))
    formed = clean.select("doc_id", "part", F.explode(F.array(T.lexical_form(F.col("text")))).alias("text"))  # a filter of its length stays behind it, or it would be worked out twice
    left = cut(formed.where(F.length("text") >= least))
    assigned = cut(assign(left).select("doc_id", "part", "text", "topic"))
    words = topic_keywords(assigned.select("topic", "text"), top).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term).alias("keywords"))  # top rows for each
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("n"))
    topics = sizes.join(words, "topic", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    label = F.get("keywords", F.lit(0)) if name is None else F.udf(name, "string")("keywords")
    report = items.agg(F.count("*").alias("items")).crossJoin(parts.agg(F.count("*").alias("texts"))).crossJoin(left.agg(F.count("*").alias("left")))  # single rows
    return topics.select("topic", "n", label.alias("label"), "keywords"), assigned.select("doc_id", "part", "topic"), report


def model_texts(documents: DataFrame, answer: Callable[[Column], Column], itemize: bool) -> tuple[DataFrame, DataFrame]:
    """(texts, report) of documents (doc_id, text) by a model's ``answer`` to each.

    texts: (doc_id, document_id, text): the stripped answer, or with ``itemize`` each stripped string of its JSON list,
    numbered from 1 behind the document's id. Documents with an empty answer, or one without items, have no row.
    report: one row of input_documents, output_documents and errors, the documents without a row.
    """
    answered = cut(documents.select("doc_id", T.strip(answer(F.col("text"))).alias("answer")))
    if itemize:
        items = F.filter(F.transform(T.json_items(F.col("answer")), T.strip), lambda x: x != "")
        parts = answered.select("doc_id", F.posexplode(items).alias("i", "text"))
        texts = parts.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i") + 1).alias("document_id"), "text")
        failed = F.coalesce(F.size(items), F.lit(0)) <= 0
    else:
        texts = answered.where("answer <> ''").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.col("answer").alias("text"))
        failed = F.coalesce(F.col("answer"), F.lit("")) == ""
    report = answered.agg(F.count("*").alias("input_documents"), F.count_if(failed).alias("errors")).crossJoin(texts.agg(F.count("*").alias("output_documents")))  # single rows
    return texts, report


def model_labels(topics: DataFrame, assigned: DataFrame, answer: Callable[[Column], Column], template: str, most_keywords: int = 8, most_documents: int = 5) -> DataFrame:
    """Topics (topic, label, keywords) named by a model, with label_source: ``llm``, or ``keywords`` where the answer is
    empty and the label stays.

    The template's {keywords} are a topic's first ones, joined by a comma; {documents} the texts of its documents of the
    smallest doc_id in assigned (topic, doc_id, text), a line each.
    """
    first = F.row_number().over(Window.partitionBy("topic").orderBy("doc_id", "text"))
    few = assigned.withColumn("nth", first).where(F.col("nth") <= most_documents)  # the limit cuts each task's rows before the shuffle
    shown = few.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x.text), "\n").alias("shown"))
    prompt = F.replace(F.replace(F.lit(template), F.lit("{keywords}"), F.array_join(F.slice("keywords", 1, most_keywords), ", ")), F.lit("{documents}"), F.coalesce("shown", F.lit("")))
    asked = topics.join(shown, "topic", "left").withColumn("answer", F.nullif(T.strip(answer(prompt)), F.lit("")))
    source = F.when(F.col("answer").isNotNull(), "llm").otherwise("keywords")
    return asked.withColumn("label", F.coalesce("answer", "label")).withColumn("label_source", source).drop("answer", "shown")


def boundary_state(states: list[dict], mark: str) -> int | None:
    """The state with most examples that say ``mark``, ties to more examples and the larger state."""
    same = lambda x: str(x).strip().upper() == mark.strip().upper()
    met = [(sum(map(same, s["examples"])), len(s["examples"]), s["state"]) for s in states]
    return max((m for m in met if m[0]), default=(0, 0, None))[2]


def name_states(report: DataFrame, ask: Callable[[str], str], most_words: int = 5, retries: int = 2) -> DataFrame:
    """(state, label) of a state report (state, examples), named by a model; a report has a row for each state.

    The states whose examples say START and END most often get these names, and such examples are left out of the
    others. ``ask`` gets the examples of all other states and must answer a JSON object of state: name. Every state
    needs a name, none twice, of ``most_words`` words at most; else it is asked again with what was wrong, ``retries``
    times, then an error is raised. Without other states nothing is asked.
    """
    states = [r.asDict() for r in report.select("state", "examples").orderBy("state").collect()]
    ends = {boundary_state(states, mark): mark for mark in ("END", "START")}
    ends.pop(None, None)
    others = [s for s in states if s["state"] not in ends]
    shown = [f"{s['state']}: " + " | ".join(x for x in s["examples"] if str(x).strip().upper() not in ("START", "END")) for s in others]
    prompt, wrong, names = "Name these states:\n" + "\n".join(shown), None, {}
    for _ in range(retries + 1 if others else 0):
        answer = ask(prompt if wrong is None else f"{prompt}\n\nYour answer was:\n{wrong}")
        wrong, names = _checked_names(answer, [s["state"] for s in others], most_words)
        if wrong is None:
            break
    if wrong is not None:
        raise ValueError(f"states could not be named: {wrong}")
    rows = [(s["state"], ends.get(s["state"], names.get(s["state"]))) for s in states]
    return report.sparkSession.createDataFrame(rows, f"state {dict(report.dtypes)['state']}, label string")


def _checked_names(answer: str, states: list, most_words: int) -> tuple[str | None, dict]:
    """What is wrong with an answer, if anything, and the names by state."""
    try:
        given = {str(k): str(v).strip() for k, v in json.loads(answer).items()}
    except (ValueError, AttributeError):
        return f"{answer}\nThis is no JSON object.", {}
    names = {s: given.get(str(s), "") for s in states}
    faults = [f"{s} has no name" for s, n in names.items() if not n]
    faults += [f"{s} has more than {most_words} words" for s, n in names.items() if len(n.split()) > most_words]
    faults += [f"{n} is given twice" for n in sorted(set(names.values())) if n and list(names.values()).count(n) > 1]
    return (f"{answer}\n{'; '.join(faults)}." if faults else None), names


def fit_hmm(symbols: DataFrame, states: int, n_symbols: int, rounds: int = 10, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transition, emission) of a categorical hidden Markov model for symbols (seq, idx, symbol 0..n-1).

    Every round's expected counts are taken in tasks, of many sequences side by side and of long ones block by block,
    and summed by Spark; what reaches the driver is the model's own size. Rows without any weight become uniform.
    """
    rng = np.random.default_rng(seed)
    model = [m / m.sum(-1, keepdims=True) for m in (rng.random(states) + 0.5, rng.random((states, states)) + 0.5, rng.random((states, n_symbols)) + 0.5)]
    blocks = symbol_blocks(symbols)
    for _ in range(rounds):
        _, *parts = np.split(M.summed(blocks, M.CategoricalModel(*model)), np.cumsum([1, states, states * states]))
        model = [_normal(parts[0]), _normal(parts[1].reshape(states, states)), _normal(parts[2].reshape(states, n_symbols))]
    drop(blocks)
    return tuple(model)


def _normal(m: np.ndarray) -> np.ndarray:
    total = m.sum(-1, keepdims=True)
    return np.where(total > 0, m / np.maximum(total, 1e-300), 1 / m.shape[-1])


def decode_hmm(symbols: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(seq, idx, state): the likeliest states of each sequence."""
    return M.decode_gaussian(symbol_blocks(symbols), M.CategoricalModel(*model))


def symbol_blocks(symbols: DataFrame) -> DataFrame:
    """Symbols (seq, idx, symbol) as ``markov.sequence_blocks``."""
    return M.sequence_blocks(symbols.select("seq", "idx", M.column_vector(F.col("symbol")).alias("vector")))


def codes(labels: DataFrame, column: str) -> DataFrame:
    """(column, code): different labels in order, numbered from 0; there are few of them."""
    kinds = labels.select(column).distinct()
    return kinds.withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def dot_graph(edges: DataFrame, least: float) -> str:
    """Graphviz text of transitions (prev, next, p) of at least that share, none out of END; a graph of few states."""
    rows = edges.where((F.col("p") >= least) & (F.col("prev").cast("string") != "END")).orderBy("prev", "next").collect()
    return "\n".join(["digraph states {", *(f'  "{r.prev}" -> "{r.next}" [label="{100 * r.p:.1f}%"];' for r in rows), "}"])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
