"""Toxicity: a linear classifier over words, regularised so that swapping identity terms does not move its score."""

from __future__ import annotations

import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTER, cut, fold3, slices, word_hashes

#: Groups of identity terms that may stand for one another. Fixed values.
IDENTITY = [
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"), ("immigrants", "refugees", "foreigners", "locals"), ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"), ("musulmanes", "cristianos", "judíos"),
]
_SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")\b", re.I)
#: Where a group may be named in a sentence that names none: behind a determiner, by language, with that language's groups. Fixed values.
SLOTS = [(re.compile(r"\b(?:the|an?)\b", re.I), IDENTITY[:8]), (re.compile(r"\b(?:der|die|das)\b", re.I), [IDENTITY[8], IDENTITY[12]]), (re.compile(r"\b(?:el|los|las)\b", re.I), [IDENTITY[10], IDENTITY[13]]), (re.compile(r"\b(?:les?|la|une?)\b", re.I), [IDENTITY[9], IDENTITY[11]])]
SAMPLE = 40_000
#: A feature is held by three rows and this share of them at least, stands this many deviations from chance, and changes the log odds by this.
LEAST_SHARE, LEAST_Z, LEAST_EFFECT = 5e-5, 3.0, 1.0
#: Lengths in bytes of the word beginnings that are features beside whole words, so that inflected words share one.
PREFIXES = (3, 4, 5)
ROWS = "mark long, toxic int, words array<int>, first array<int>, second array<int>"


def words(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's words (runs of letters, in lower case) and of their beginnings."""
    return np.unique((word_hashes(text, NOT_LETTER, PREFIXES) & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by the next of its group; None if it has none."""
    out = _TERM.sub(lambda m: _SWAP.get(m[0].lower(), m[0]), text)
    return out if out != text else None


def named(text: str) -> tuple[str, str] | None:
    """Two sentences that differ in the group they name alone: the text with one term of a group put in at a slot, and with
    the next; which group and term follows the text's length, so that all take part. None where there is no slot.
    """
    for slot, groups in SLOTS:
        m = slot.search(text)
        if m:
            group = groups[len(text) % len(groups)]
            i = len(text) // len(groups) % len(group)
            return tuple(f"{text[: m.end()]} {group[(i + k) % len(group)]}{text[m.end() :]}" for k in (0, 1))
    return None


def counterfactual(text: str, own: np.ndarray) -> tuple[list[int], list[int]] | None:
    """Features that the first and only the first, and the second and only the second, of a pair of sentences has: the text
    and its swap where it names a group, else the two that `named` makes of it.
    """
    other = swapped(text)
    if other is not None:
        a, b = own, words(other)
    else:
        pair = named(text)
        if pair is None:
            return None
        a, b = (words(x) for x in pair)
    return np.setdiff1d(a, b).tolist(), np.setdiff1d(b, a).tolist()


def _labelled(batches):
    for rb in slices(batches):
        own = [words(t) for t in rb.column("text").to_pylist()]
        pairs = [counterfactual(t, w) or (None, None) for t, w in zip(rb.column("text").to_pylist(), own, strict=True)]
        kind = pa.list_(pa.int32())
        lists = [pa.array(x, kind) for x in ([w.tolist() for w in own], [p[0] for p in pairs], [p[1] for p in pairs])]
        yield pa.RecordBatch.from_arrays([rb.column("mark"), rb.column("toxic"), *lists], names=["mark", "toxic", "words", "first", "second"])


def _chosen(vocabulary: np.ndarray):
    """The rows' lists with the features alone that the model has."""

    def run(batches):
        for rb in slices(batches, 1024):
            keep = [pa.array([None if x is None else np.intersect1d(np.array(x, np.int32), vocabulary).tolist() for x in rb.column(c).to_pylist()], pa.list_(pa.int32())) for c in ("words", "first", "second")]
            yield pa.RecordBatch.from_arrays([rb.column("mark"), rb.column("toxic"), *keep], names=rb.schema.names)

    return run


class Model:
    """Hashes of the chosen words in ascending order, their weights, and the intercept; how many pairs of sentences took
    part, and in how many of them a chosen feature changes.
    """

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float, pairs: int = 0, active: int = 0):
        self.vocabulary, self.weights, self.bias, self.pairs, self.active = vocabulary, weights, bias, pairs, active

    def score(self, text: str) -> float:
        z = self.bias
        if len(self.vocabulary):
            w = words(text)
            at = np.searchsorted(self.vocabulary, w)
            at[at == len(self.vocabulary)] = 0
            z += float(self.weights[at[self.vocabulary[at] == w]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def learn(own: list[list[int]], pairs: list[tuple[list[int], list[int]] | None], y: np.ndarray, vocabulary: np.ndarray, fairness: float = 1.0, decay: float = 1e-4, rounds: int = 300, balance: float = 0.5) -> Model:
    """Logistic regression over presence features, by full-batch Adam with steps that shrink to nought.

    The loss is the mean log loss plus `fairness` times the mean squared change of the logit between the sentences of a
    pair (features of the first alone, and of the second alone), plus `decay` times the weights' squares. Toxic rows weigh (clean rows per toxic row) ** `balance`.
    """
    place = {int(v): i for i, v in enumerate(vocabulary)}
    rows = [np.array(sorted(place[x] for x in r if x in place), np.int64) for r in own]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.empty(0, np.int64)
    moves, pair, active = [], [], 0
    for both in pairs:
        if both is not None:
            a, b = ({place[x] for x in side if x in place} for side in both)
            moves += [(len(pair), k, 1.0) for k in sorted(a - b)] + [(len(pair), k, -1.0) for k in sorted(b - a)]
            pair.append(1)
            active += bool(a ^ b)
    mo = np.array([m[0] for m in moves], np.int64), np.array([m[1] for m in moves], np.int64), np.array([m[2] for m in moves])
    k, n = len(vocabulary), max(1, len(y))
    w, bias = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else -5.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    heavy = np.where(y > 0, (max(1.0, (1 - y.mean()) / max(y.mean(), 1e-9)) if len(y) else 1.0) ** balance, 1.0)
    heavy = heavy / max(1e-9, heavy.mean()) if len(y) else heavy
    for step in range(1, rounds + 1 if len(y) else 1):
        z = bias + np.bincount(owner, w[column], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        err = heavy * (p - y) / n
        g = np.append(np.bincount(column, err[owner], minlength=k) + 2 * decay * w, err.sum())
        if moves:
            change = np.bincount(mo[0], w[mo[1]] * mo[2], minlength=len(pair))
            g[:k] += 2 * fairness / len(pair) * np.bincount(mo[1], change[mo[0]] * mo[2], minlength=k)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (1 - (step - 1) / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:k], bias - move[k]
    return Model(vocabulary, w, float(bias), len(pair), active)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_labels: int = 200_000, fairness: float = 1.0) -> Model:
    """Learn from labelled rows whose fold is not 1.

    The labels are broadcast when they are at most `most_labels` rows, else joined by a shuffle. How many documents of
    either label hold each word is counted over all labelled rows, in Spark; every word that sets the labels apart by
    both a test and an effect, neither of which grows with the table, is a feature. A feature stands in LEAST_SHARE of the
    rows at least, so there are at most (features of a text) / LEAST_SHARE; they go to the driver and, once, to each
    task. The weights are fitted on at most `sample` rows, one for each cell of the rows' hash. Every one of these that
    names a group, or has a slot where one can be named, gives a pair of sentences whose scores are held together; the
    model says how many did, and a warning where no pair could move a score.
    """
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.filter((fold3() != 1) & F.col("doc_id").isNotNull())
    marks = F.broadcast(marks) if labels.count() <= most_labels else marks
    text = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = text.join(marks, "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text").alias("mark"))
    rows = cut(both.mapInArrow(_labelled, ROWS), "toxic-words")
    n, bad = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not bad or bad == n:
        return Model(np.empty(0, np.int32), np.empty(0), -5.0 if not bad else 5.0)
    seen = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("a"), F.sum("toxic").alias("t"))
    share = bad / n
    z = F.abs(F.col("t") - F.col("a") * share) / F.sqrt(F.col("a") * (share * (1 - share)) + 1.0)
    odds = lambda held, of: (held + 0.5) / (of + 1.0)
    effect = F.abs(F.log(odds(F.col("t"), bad) / odds(F.col("a") - F.col("t"), n - bad)))
    chosen = seen.filter((F.col("a") >= max(3, n * LEAST_SHARE)) & (z >= LEAST_Z) & (effect >= LEAST_EFFECT)).select("word").collect()
    words_ = np.sort(np.array([r["word"] for r in chosen], np.int32))
    slim = rows.mapInArrow(_chosen(words_), ROWS).groupBy(F.pmod("mark", F.lit(sample)).alias("cell")).agg(F.min_by(F.struct("toxic", "words", "first", "second"), "mark").alias("x")).select("x.*").collect()
    pairs = [None if r["first"] is None else (r["first"], r["second"]) for r in slim]
    model = learn([r["words"] for r in slim], pairs, np.array([r["toxic"] for r in slim], np.float64), words_, fairness)
    if fairness and not model.active:
        warnings.warn(f"no feature changes in any of {model.pairs} pairs of sentences: the penalty does not act", stacklevel=2)
    return model


def _scores(model: Model, cut_at: float):
    def run(batches):
        for rb in slices(batches):
            s = [model.score(t or "") for t in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= cut_at) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, cut_at: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score >= cut_at).

    A score reads the whole text alone. A null or empty text has the score of no words. Repeated rows each get a row and
    equal texts one score; of several labels for one id the highest counts; rows without an id are scored but teach
    nothing. Without labels of both kinds every score is the only label's (0 when there is none). An empty table gives
    an empty result; further columns are ignored.
    """
    model = model or fit(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold3() == 1).alias("held_out"), "text")
    return slim.mapInArrow(_scores(model, cut_at), "doc_id long, held_out boolean, score double, predicted int")
