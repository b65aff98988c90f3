"""Language identification as mixture inference: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold3, slices

BITS, UNIT, PIECE = 16, 4, 1 << 20
_FOLD: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> a number for its lower-case letter, 0 for what is no letter."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                table[c] = ord(x.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each letter the hashed trigram about it (word edges count as a blank), and its place in the text."""
    a = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    padded = np.zeros(len(a) + 2, np.uint32)
    padded[1:-1] = a
    at = np.flatnonzero(a)
    h = (padded[at] * np.uint32(0x9E3779B1) + padded[at + 1]) * np.uint32(0x85EBCA77) + padded[at + 2]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    return h >> np.uint32(32 - BITS), at


def pieces(text: str):
    """The text in parts of about a million characters, cut at white space where there is any."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            gap = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = gap + 1 if gap > at else end
        yield text[at:end]
        at = end


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for rb in batches:
        for text, lang in zip(rb.column("text").to_pylist(), rb.column("lang").to_pylist(), strict=True):
            c = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
            docs[lang] = docs.get(lang, 0) + 1
            for part in pieces(text):
                c += np.bincount(_trigrams(part)[0], minlength=1 << BITS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs[lang], *c[at].tolist()], pa.int64())], names=["lang", "gram", "n"])


class Model:
    """log p(trigram | language) of the learned languages and their log prior; at most 65,536 numbers a language."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.table, self.prior = langs, table, prior


def fit(docs: DataFrame, alpha: float = 0.05) -> Model:
    """Learn from all rows whose fold is not 1 and whose text and lang are not null: counts over every text, summed by Spark."""
    train = docs.filter((fold3() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    found = train.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = found.column("lang").to_pylist(), found.column("gram").to_numpy(), found.column("n").to_numpy()
    langs = sorted(set(lang))
    index = np.array([langs.index(x) for x in lang], np.int64)
    counts, docs_of = np.zeros((1 << BITS, len(langs))), np.ones(len(langs))
    grams = gram >= 0
    counts[gram[grams], index[grams]] = n[grams]
    docs_of[index[~grams]] += n[~grams]
    table = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * (1 << BITS))).astype(np.float32)
    return Model(langs, table, np.log(docs_of / docs_of.sum()) if langs else docs_of)


def unit_likelihoods(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of units of four words under each language, and the text each unit is from."""
    out, owner, held, size = [], [], [], 0

    def flush():
        nonlocal held, size
        if not held:
            return
        joined = "\n".join(t for _, t in held)
        gram, at = _trigrams(joined)
        if len(at):
            starts = np.cumsum([0, *(len(t) + 1 for _, t in held[:-1])])
            doc = np.searchsorted(starts, at, side="right") - 1
            word = np.cumsum(np.concatenate(([True], np.diff(at) > 1)))
            first = np.full(len(held), 1 << 60)
            np.minimum.at(first, doc, word)
            unit = (word - first[doc]) // UNIT
            new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) > 0) | (np.diff(unit) > 0))))
            out.append(np.add.reduceat(model.table[gram], new, axis=0))
            owner.append(np.array([i for i, _ in held])[doc[new]])
        held, size = [], 0

    for i, text in enumerate(texts):
        for part in pieces(text):
            held.append((i, part))
            size += len(part)
            if size >= PIECE:
                flush()
    flush()
    if not out:
        return np.empty((0, len(model.langs)), np.float32), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def _em(like: np.ndarray, start: np.ndarray, sets: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over each document's set of languages, and the log likelihood over the units' best language."""
    n = np.diff(np.append(start, len(like)))
    share = sets / sets.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = like * np.repeat(share, n, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(r, start, axis=0) / n[:, None]
    total = np.log(np.maximum((like * np.repeat(share, n, axis=0)).sum(axis=1), 1e-300))
    return share, np.add.reduceat(total, start)


def infer(texts: list[str], model: Model, penalty: float = 6.0, rounds: int = 12) -> list[tuple[str, float, list[float]]]:
    """lang_pred, score and the proportions of each text.

    Units of four words are drawn from one language each. Starting from the best single language, the language that
    could add most is tried: its proportions are estimated by EM and the set grows while the log likelihood rises by
    more than `penalty` and half a log of the number of units. Since a mixture's likelihood is at most that of each
    unit's best language, most texts need no EM.
    """
    none = ("und", 0.0, [0.0] * len(model.langs))
    result = [none] * len(texts)
    if not model.langs:
        return result
    logs, owner = unit_likelihoods(texts, model)
    if not len(logs):
        return result
    docs, start = np.unique(owner, return_index=True)
    n = np.diff(np.append(start, len(owner)))
    logs = logs.astype(np.float64)
    best = logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logs - best, -700))
    single = np.add.reduceat(logs, start, axis=0) + model.prior
    ahead = single.argmax(axis=1)
    sets = np.zeros((len(docs), len(model.langs)))
    sets[np.arange(len(docs)), ahead] = 1
    now = np.add.reduceat(logs - best, start, axis=0)[np.arange(len(docs)), ahead]
    share, cost = sets.copy(), penalty + 0.5 * np.log(n)
    tried = sets > 0
    while len(model.langs) > 1:
        reach = np.full(sets.shape, -np.inf)
        inside = np.where(np.repeat(sets, n, axis=0) > 0, logs, -np.inf).max(axis=1)
        for lang in range(len(model.langs)):
            reach[:, lang] = np.add.reduceat(np.maximum(inside, logs[:, lang]) - best[:, 0], start)
        reach[tried] = -np.inf
        add = reach.argmax(axis=1)
        go = np.flatnonzero(reach[np.arange(len(docs)), add] - now > cost)
        if not len(go):
            break
        wider = sets[go].copy()
        wider[np.arange(len(go)), add[go]] = 1
        rows = np.concatenate([np.arange(start[g], start[g] + n[g]) for g in go])
        mixed, total = _em(like[rows], np.concatenate(([0], np.cumsum(n[go])[:-1])), wider, rounds)
        tried[go, add[go]] = True
        grown = total - now[go] > cost[go]
        took = go[grown]
        sets[took], share[took], now[took] = wider[grown], mixed[grown], total[grown]
    others = np.where(sets > 0, -np.inf, single)
    rival = others.max(axis=1) - single.max(axis=1)
    sure = 1 / (1 + np.exp(np.clip(np.where(np.isfinite(rival), rival, -700), -700, 700)))
    for k, d in enumerate(docs):
        top = int(share[k].argmax())
        result[d] = (model.langs[top], float(min(1.0, share[k, top] * sure[k])), share[k].tolist())
    return result


def _predict(model: Model):
    def run(batches):
        for rb in slices(batches, 512):
            found = infer([t or "" for t in rb.column("text").to_pylist()], model)
            columns = [rb.column(c) for c in rb.schema.names if c != "text"]
            shares = ["".join(f",{x}:{s:.4f}" for x, s in zip(model.langs, f[2], strict=True) if s > 0)[1:] for f in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array(shares, pa.string())], names=[*(c for c in rb.schema.names if c != "text"), "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, mixture.

    lang_pred is the language of the largest share in the chosen mixture, score that share times the odds of the
    nearest language outside it, mixture the shares. held_out marks fold 1, from which nothing is learned. A prediction
    reads the text alone. `und` with score 0 stands for a null text, one without a letter, or nothing learned. A null
    doc_id is in fold 0. Repeated rows each get a row, equal texts the same answer; whole texts are read, at any length;
    an empty table gives an empty result; further columns are ignored.
    """
    model = model or fit(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold3() == 1).alias("held_out"), "text")
    return slim.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, mixture string")


def accept(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a language, with lang set to it; rows without a letter go, as do scores below `least`.

    All columns stay, and further ones may have any name.
    """
    model = fit(docs)

    def run(batches):
        for rb in slices(batches, 512):
            found = infer([t or "" for t in rb.column("text").to_pylist()], model)
            rb = rb.set_column(rb.schema.get_field_index("lang"), "lang", pa.array([f[0] for f in found], pa.string()))
            yield rb.filter(pa.array([f[0] != "und" and f[1] >= least for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


