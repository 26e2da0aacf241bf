"""Toxic passages by maximum-scoring segments.

A word scores the log-odds of toxic against other documents, learned from labelled ones. Counts of a word are few, so
they are smoothed by a Dirichlet prior centred on what is known of its first letters: the word, then its first
six, five and four letters, then no preference. A word's score is lowered by one standard error and a
fixed cost, which makes ordinary words negative. In scripts without spaces between words, two neighbouring letters
count as a word.

One linear scan per text finds every maximal scoring segment: a run of words none of whose extensions or
parts scores higher. Segment scores S follow an extreme-value law in texts without toxic passages: in a text of n
words, K * n * exp(-lambda * S) segments reach S by chance. lambda solves sum p(s) * exp(lambda * s) = 1 over the word scores of
labelled clean texts, K comes from their best segments. A document's evidence is the sum of
-log(p) over its significant segments, and a logistic curve fitted to the labelled documents
turns it into a score.

All statistics cover every labelled document that may be learned from; repeated texts of one label count once. Nodes are
counted and smoothed as a table, and every one that changes a word's score is kept, however few texts have it. A table of up to
``MOST_SENT`` nodes is sent to the workers; a larger one is joined with the distinct words of the texts. Both give
the same scores. Besides, the driver holds histograms with a fixed number of bins.

Defined results: a null or empty text has no words and the lowest evidence, 0; bytes that are not UTF-8 are no letters; long texts are
scanned whole; labels of one doc_id are combined by maximum, null ones are no labels; without labels of both classes every score is
0; repeated rows get equal scores; of segments with equal scores none contains another; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import stored
from bazaarlens.llm.word_nodes import PREFIXES, NodeScores, Units, by_row, chunks, distinct_nodes

PRIOR = 2.0
WORD_COST = 1.0
#: A segment whose chance is below this is significant.
SIGNIFICANT = 0.05
#: Bins per unit of a word's score or of a document's evidence, and the largest evidence told apart.
BINS_PER_UNIT = 20
MOST_EVIDENCE = 300
PREDICT_FROM = 0.7
FOLDS = 3
HELD_OUT_FOLD = 1
#: Nodes, at sixteen bytes each, that are sent to the workers rather than joined.
MOST_SENT = 2_000_000

_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


# --- word model ---

def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, level, parent, yes, no): the toxic and the clean documents of a batch that hold a node."""
    for batch in batches:
        row, key, level, parent = distinct_nodes(batch.column(0))
        toxic = batch.column(1).to_numpy()[row.astype(np.int64)]
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        yes = np.bincount(place, weights=toxic, minlength=len(distinct)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(distinct.view(np.int64)), pa.array(level[first].astype(np.int32)), pa.array(parent[first].view(np.int64)),
            pa.array(yes), pa.array(np.bincount(place, minlength=len(distinct)) - yes),
        ], ["key", "level", "parent", "yes", "no"])


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the labelled documents that may be learned from, one row per text and label."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max("toxic").cast("int").alias("toxic"),
    ).where(~held_out(F.col("labelled")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out(F.col("doc_id")))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_key"))
    chosen = keyed.join(known, F.col("doc_id") == F.col("labelled")).groupBy("text_key", "toxic").agg(
        F.min("doc_id").alias("labelled"),
    ).select("labelled", "toxic", "text_key")
    return (
        texts.withColumn("own_key", F.xxhash64("text"))
        .join(chosen, (F.col("doc_id") == F.col("labelled")) & (F.col("own_key") == F.col("text_key")))
        .select("text", "toxic")
    )


@dataclass(frozen=True)
class WordModel:
    """The nodes that change a score (key, score), and how many there are."""

    nodes: DataFrame
    size: int
    most_sent: int = MOST_SENT


def node_counts(texts: DataFrame) -> DataFrame:
    """key, level, parent, and the toxic and the clean texts that have each node."""
    return stored(
        texts.where("toxic IN (0, 1)").select("text", F.col("toxic").cast("bigint"))
        .mapInArrow(_counted, "key bigint, level int, parent bigint, yes bigint, no bigint")
        .groupBy("key", "level", "parent").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "node-counts",
    )


def _smoothed(nodes: DataFrame, balance: float) -> DataFrame:
    """key, odds, score and above (the parent's score) of nodes (key, yes, no, prior, above).

    Log-odds under the prior of the node above, less one standard error towards 0.
    """
    share = 1 / (1 + F.exp(-F.col("prior")))
    yes, no = F.col("yes") + PRIOR * share, F.col("no") * balance + PRIOR * (1 - share)
    error = F.sqrt(1 / F.col("y") + 1 / F.greatest("n", F.lit(0.5)))
    return (
        nodes.select("key", "above", yes.alias("y"), no.alias("n"))
        .withColumn("odds", F.log(F.col("y") / F.col("n")))
        .select("key", "above", "odds", (F.signum("odds") * F.greatest(F.lit(0.0), F.abs("odds") - error)).alias("score"))
    )


def word_model(texts: DataFrame, most_sent: int = MOST_SENT) -> WordModel | None:
    """Scores of all nodes that change a word's score; None without texts of both classes."""
    totals = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return None
    balance = totals[1] / totals[0]
    counts = node_counts(texts)
    # From the shortest prefixes to whole words; a node's parent is on one of the levels before.
    done: DataFrame | None = None
    for level in range(len(PREFIXES) + 1):
        here = counts.where(F.col("level") == level)
        if done is None:
            nodes = here.withColumns({"prior": F.lit(0.0), "above": F.lit(0.0)})
        else:
            known = done.select(F.col("key").alias("parent"), F.col("odds").alias("prior"), F.col("score").alias("above"))
            nodes = here.join(known, "parent", "left").fillna(0.0, ["prior", "above"])
        level_scores = stored(_smoothed(nodes, balance), "node-scores")
        done = level_scores if done is None else done.unionAll(level_scores)
    # A word takes the score of its longest known node, so one that scores as its parent does is left out.
    nodes = stored(done.where("score <> above").select("key", "score"), "nodes")
    return WordModel(nodes, nodes.count(), most_sent)


@lru_cache(maxsize=2)
def _table(sent) -> NodeScores:
    keys, scores = sent.value
    return NodeScores(keys.view(_U), scores)


def word_scores(
    docs: DataFrame, columns: list[str], model: WordModel,
    rows: Callable[[pa.RecordBatch, Iterator[np.ndarray]], pa.RecordBatch], schema: str,
) -> DataFrame:
    """What ``rows`` makes of batches of the columns and of the scores of each text's words, in order."""
    def measure(table: NodeScores) -> Callable[[Units], np.ndarray]:
        return lambda units: table.of_words(units) - WORD_COST

    if model.size <= model.most_sent:
        found = model.nodes.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((found.column("key").to_numpy(), found.column("score").to_numpy()))

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch, by_row(batch.column(len(columns)), measure(_table(sent))))

        return docs.select(*columns, "text").mapInArrow(of_batches, schema)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scores(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            text, keys, values = (batch.column(len(columns) + i) for i in range(3))
            for i in range(batch.num_rows):
                known = [np.array(c[i].as_py() or [], kind) for c, kind in ((keys, np.int64), (values, float))]
                yield from by_row(text.slice(i, 1), measure(NodeScores(known[0].view(_U), known[1])))

        for batch in batches:
            yield rows(batch, scores(batch))

    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    known = scores_by_join(docs.select(digest.alias("digest"), "text").dropDuplicates(["digest"]), model.nodes)
    inputs = [F.col(c).alias(f"in_{i}") for i, c in enumerate(columns)]
    joined = docs.select(*inputs, "text", digest.alias("digest")).join(known, "digest", "left")
    return joined.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)], "text", "keys", "scores",
    ).mapInArrow(of_rows, schema)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, word, node_0 ...): each word of a text and its nodes, the longest first, null where there is none."""
    names = ["digest", "word", *[f"node_{i}" for i in range(len(PREFIXES) + 1)]]
    for batch in batches:
        for pieces in chunks(batch.column(1)):
            units = Units([text for _, text in pieces])
            row = np.repeat(np.array([at for at, _ in pieces]), np.diff(units.edges))
            nodes = [pa.array(units.keys.view(np.int64))]
            for size in reversed(PREFIXES):
                longer = units.lengths > size
                keys = np.zeros(len(longer), _U)
                keys[longer] = units.prefix_keys(np.flatnonzero(longer), size)
                nodes.append(pa.array(keys.view(np.int64), mask=~longer))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), nodes[0], *nodes], names)


def scores_by_join(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """digest, keys and scores: the distinct words of each text (digest, text) that a node gives a score.

    The nodes meet the vocabulary, of which each word is one row, and then the words of the texts; both sides of that join are
    plain shuffles, in which Spark can split a word that most texts have.
    """
    levels = [f"node_{i}" for i in range(len(PREFIXES) + 1)]
    words = stored(texts.mapInArrow(
        _distinct_words, "digest string, word bigint, " + ", ".join(f"{c} bigint" for c in levels),
    ).distinct(), "text-words")
    known = words.select("word", *levels).distinct()
    for c in levels:
        known = known.join(nodes.select(F.col("key").alias(c), F.col("score").alias(f"score_{c}")), c, "left")
    known = stored(
        known.select("word", F.coalesce(*[f"score_{c}" for c in levels]).alias("score")).where("score IS NOT NULL"), "word-scores",
    )
    return words.select("digest", "word").join(known, "word").groupBy("digest").agg(
        F.collect_list("word").alias("keys"), F.collect_list("score").alias("scores"),
    )


# --- segments ---

def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring runs, by the linear scan of Ruzzo and Tompa.

    Neighbouring positive scores are always in one run, and negative ones only move the running total, so the scan
    visits the stretches of positive scores.
    """
    positive = np.concatenate(([False], scores > 0, [False]))
    edges = np.flatnonzero(positive[1:] != positive[:-1])
    if not len(edges):
        return []
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    at_edges = totals[edges].tolist()
    edges = edges.tolist()
    found: list[list[float]] = []  # start, end, total before, total after, nearest earlier run with a lower start total
    for start, end, before, after in zip(edges[::2], edges[1::2], at_edges[::2], at_edges[1::2], strict=True):
        link = len(found) - 1
        while True:
            while link >= 0 and found[link][2] >= before:
                link = found[link][4]
            if link < 0 or found[link][3] >= after:
                found.append([start, end, before, after, link])
                break
            start, before, link_of = found[link][0], found[link][2], found[link][4]
            del found[link:]
            link = link_of
    return [(s, e, after - before) for s, e, before, after, _ in found]


def _kinds(docs: DataFrame, columns: list[str]) -> str:
    kinds = dict(docs.dtypes)
    return "".join(f"{c} {kinds[c]}, " for c in columns)


def scanned(docs: DataFrame, model: WordModel, columns: list[str], histogram: bool = False) -> DataFrame:
    """The columns, the number of words, the best score, and the scores of the segments of each text.

    With ``histogram`` the text's word scores too, as bins and the words in each.
    """
    def rows(batch: pa.RecordBatch, texts: Iterator[np.ndarray]) -> pa.RecordBatch:
        sizes, best, segments, bins, words = [], [], [], [], []
        for scores in texts:
            runs = [score for _, _, score in maximal_segments(scores)]
            sizes.append(len(scores))
            best.append(max(runs, default=float(scores.max()) if len(scores) else None))
            segments.append(runs)
            if histogram:
                values, numbers = np.unique(np.round(scores * BINS_PER_UNIT).astype(np.int64), return_counts=True)
                bins.append(values)
                words.append(numbers)
        found = [pa.array(sizes, pa.int64()), pa.array(best, pa.float64()), pa.array(segments, pa.list_(pa.float64()))]
        found += [pa.array(x, pa.list_(pa.int64())) for x in (bins, words)] if histogram else []
        return pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], *found], names)

    names = [*columns, "n_words", "best", "segments", *(["bins", "words"] if histogram else [])]
    schema = _kinds(docs, columns) + "n_words bigint, best double, segments array<double>"
    return word_scores(docs, columns, model, rows, schema + (", bins array<bigint>, words array<bigint>" if histogram else ""))


def passages(docs: DataFrame, model: WordModel, law: ExtremeValues) -> DataFrame:
    """doc_id, start and stop (words), score of every significant passage."""
    def rows(batch: pa.RecordBatch, texts: Iterator[np.ndarray]) -> pa.RecordBatch:
        ids, found = [], []
        for i, scores in enumerate(texts):
            for start, stop, score in maximal_segments(scores):
                if law.chance(score, len(scores)) < SIGNIFICANT:
                    ids.append(i)
                    found.append((start, stop, score))
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(ids, pa.int64())), pa.array(columns[0], pa.int64()),
            pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
        ], ["doc_id", "start", "stop", "score"])

    return word_scores(docs, ["doc_id"], model, rows, _kinds(docs, ["doc_id"]) + "start bigint, stop bigint, score double")


# --- calibration ---

@dataclass(frozen=True)
class ExtremeValues:
    """The law of chance segments: K * n * exp(-rate * S) of them reach a score S among n words."""

    rate: float
    log_k: float

    def chance(self, score: float, n_words: int) -> float:
        return -math.expm1(-math.exp(min(30.0, self.log_k + math.log(max(n_words, 1)) - self.rate * score)))

    def evidence(self, segments: Column, n_words: Column) -> Column:
        """The sum of -log(p) over the significant segments."""
        def strength(score: Column) -> Column:
            expected = F.exp(F.least(F.lit(30.0), F.lit(self.log_k) + F.log(F.greatest(n_words, F.lit(1))) - F.lit(self.rate) * score))
            return -F.log(F.greatest(-F.expm1(-expected), F.lit(1e-300)))

        significant = F.filter(F.transform(segments, strength), lambda x: x > -math.log(SIGNIFICANT))
        return F.coalesce(F.aggregate(significant, F.lit(0.0), lambda total, x: total + x), F.lit(0.0))


def rate_of(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p(s) * exp(rate * s) = 1, for scores negative on average; by bisection."""
    share = counts / counts.sum()
    if scores @ share >= 0 or not (scores[counts > 0] > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    while share @ np.exp(np.minimum(high * scores, 300)) < 1:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if share @ np.exp(np.minimum(middle * scores, 300)) >= 1 else (middle, high)
    return high


def extreme_values(clean: DataFrame) -> ExtremeValues:
    """The law's parameters from the word scores and the best segments of scanned clean texts, with histograms."""
    rows = clean.select(F.explode(F.arrays_zip("bins", "words")).alias("part")).groupBy("part.bins").agg(
        F.sum("part.words").alias("number"),
    ).collect()
    if not rows:
        return ExtremeValues(1.0, 0.0)
    bins, counts = np.array([r["bins"] for r in rows]), np.array([r["number"] for r in rows], float)
    rate = rate_of(bins / BINS_PER_UNIT, counts)
    # The mean of the standard extreme-value law is Euler's constant.
    mean = clean.where("n_words > 0").agg(F.avg(F.lit(rate) * F.col("best") - F.log("n_words")).alias("mean")).first()["mean"]
    return ExtremeValues(rate, (mean or 0.0) - 0.5772156649015329)


def logistic_curve(evidence: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the chance of a toxic label over evidence, from counts per bin."""
    features = np.column_stack([evidence, np.ones(len(evidence))])
    number, share, weights = toxic + clean, (toxic + 0.0) / (toxic + clean), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        gradient = features.T @ (number * (share - p)) - ridge * weights
        curvature = (features * (number * p * (1 - p))[:, None]).T @ features + ridge * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        weights += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return float(weights[0]), float(weights[1])


@dataclass(frozen=True)
class ToxicityModel:
    words: WordModel
    law: ExtremeValues
    slope: float
    offset: float


def fit(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> ToxicityModel | None:
    """What is learned from the labelled documents; None without both classes."""
    texts = stored(training_texts(docs, labels), "labelled-texts")
    words = word_model(texts, most_sent)
    if words is None:
        return None
    # One scan serves the law of chance and the curve.
    scans = stored(scanned(texts, words, ["toxic"], histogram=True), "labelled-scans")
    law = extreme_values(scans.where("toxic = 0"))
    evidence = law.evidence(F.col("segments"), F.col("n_words"))
    bins = scans.select(
        "toxic", F.round(F.least(evidence, F.lit(float(MOST_EVIDENCE))) * BINS_PER_UNIT).cast("int").alias("bin"),
    ).groupBy("bin").agg(
        F.sum((F.col("toxic") == 1).cast("int")).alias("toxic"), F.sum((F.col("toxic") != 1).cast("int")).alias("clean"),
    ).orderBy("bin").collect()
    slope, offset = logistic_curve(
        np.array([r["bin"] / BINS_PER_UNIT for r in bins]), np.array([float(r["toxic"]) for r in bins]),
        np.array([float(r["clean"]) for r in bins]),
    )
    return ToxicityModel(words, law, slope, offset)


def scored(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    if model is None:
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    evidence = F.least(model.law.evidence(F.col("segments"), F.col("n_words")), F.lit(float(MOST_EVIDENCE)))
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * evidence + F.lit(model.offset))))
    return scanned(docs, model.words, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
    ).withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
