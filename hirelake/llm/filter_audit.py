"""How five quality filters interact: what each removes in every order in which they can be applied."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, join_spread, slices, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: FIRST[failures as bits, order]: the step, from 0, that removes such a document; 5 where none does.
FIRST = np.array([[next((s for s, f in enumerate(o) if mask >> FILTERS.index(f) & 1), 5) for o in ORDERS] for mask in range(32)], np.int64)
WORDS, DISTINCT, CAPITALS = 200, 50, 2
_CAPITAL = bytes(range(ord("A"), ord("Z") + 1))
_MARK = b"#$%&*|"
#: Parts whose sums a task holds at once.
HELD = 64


def failures(text: str) -> int:
    """Filters A to D that a text fails, as bits 0 to 3."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: parts at 0x20 and 0x09 to 0x0D alone
    n, distinct = len(words), len(set(words))
    return (n < WORDS) | (100 * distinct < DISTINCT * n) << 1 | (100 * (len(raw) - len(raw.translate(None, _CAPITAL))) > CAPITALS * len(text)) << 2 | (len(raw.translate(None, _MARK)) < len(raw)) << 3


def _judge(batches):
    """Rows that share id, part and text within a batch become one row with their number."""
    for rb in batches:
        held: dict[tuple, list[int]] = {}
        ids, parts, same = (rb.column(n).to_pylist() for n in ("doc_id", "part", "same"))
        for at, key in enumerate(zip(ids, parts, same, strict=True)):
            if key in held:
                held[key][1] += 1
            else:
                held[key] = [at, 1]
        first = [at for at, _ in held.values()]
        keep = rb.take(pa.array(first, pa.int64()))
        masks = [failures(t) for some in slices([keep]) for t in some.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(keep.column(n) for n in ("doc_id", "part", "same")), pa.array(masks, pa.int32()), pa.array([n for _, n in held.values()], pa.int64())], names=["doc_id", "part", "same", "mask", "n"])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (failures, A to E, as bits 0 to 4), good, toxic, n: documents of one id, part and text, counted.

    A text's least doc_id comes from one aggregate; the text itself is not shuffled, its SHA-256 stands for it. Groups
    of copies and ids of any size are dealt over salts where they meet the one row of their text or label.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    slim = slim.withColumn("same", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    slim = cut(slim.mapInArrow(_judge, "doc_id long, part string, same binary, mask int, n long"), "judged")  # the texts are read once
    firsts = slim.groupBy("same").agg(F.min("doc_id").alias("first"))
    slim = join_spread(slim, firsts, ["same"], F.coalesce("doc_id", F.xxhash64("part")))
    mask = F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    slim = join_spread(slim.select("doc_id", "part", mask.alias("mask"), "same", "n"), marks, ["doc_id"], F.hex("same"), "left")
    return slim.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def removals(mask: np.ndarray, label: np.ndarray, code: np.ndarray, number: np.ndarray, parts: int) -> np.ndarray:
    """[part, order, step, label]: documents that fall there; step 5 holds those that stay, label = good + 2 * toxic."""
    n = len(ORDERS)
    cell = (code[:, None] * n + np.arange(n)) * 6 + FIRST[mask]
    sums = np.bincount((cell * 4 + label[:, None]).ravel(), np.repeat(number, n), parts * n * 24)
    return sums.astype(np.int64).reshape(parts, n, 6, 4)


COUNTS = ["removed", "good_lost", "toxic_lost", "fails", "only", "total"]


def _count(batches):
    """Per task and part one row for each order and step, of sums over all documents the task reads.

    At most HELD parts are summed at once; where a task sees more, the sums so far go out and begin anew.
    """
    held: dict[str, list[np.ndarray]] = {}
    letter = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    order, step = np.repeat(np.arange(len(ORDERS)), 5), np.tile(np.arange(5), len(ORDERS))

    def out():
        for part, (fell, fails, only) in held.items():
            cut_ = fell[:, :5]
            total = np.full(len(order), fell[0].sum())
            columns = [cut_.sum(axis=2).ravel(), cut_[..., [1, 3]].sum(axis=2).ravel(), cut_[..., [2, 3]].sum(axis=2).ravel(), fails[letter].ravel(), only[letter].ravel(), total]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(order), pa.string()), pa.array(order, pa.int32()), pa.array(step, pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], names=["part", "o", "s", *COUNTS])
        held.clear()

    for rb in slices(batches, 4096):
        names = rb.column("part").dictionary_encode()
        code, mask = names.indices.to_numpy(zero_copy_only=False), rb.column("mask").to_numpy(zero_copy_only=False)
        number = rb.column("n").to_numpy(zero_copy_only=False)
        label = rb.column("good").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * rb.column("toxic").to_numpy(zero_copy_only=False)
        for lo in range(0, len(names.dictionary), HELD):
            some = names.dictionary[lo : lo + HELD].to_pylist()
            if len(held.keys() | set(some)) > HELD:
                yield from out()
            here = (code >= lo) & (code < lo + HELD)
            fell = removals(mask[here], label[here], code[here] - lo, number[here], len(some))
            by_mask = np.bincount((code[here] - lo) * 32 + mask[here], number[here], 32 * len(some)).astype(np.int64).reshape(-1, 32)
            for i, part in enumerate(some):
                fails = np.array([by_mask[i, np.arange(32) >> f & 1 == 1].sum() for f in range(5)])
                new = [fell[i], fails, by_mask[i, 1 << np.arange(5)]]
                held[part] = [a + b for a, b in zip(held[part], new, strict=True)] if part in held else new
    yield from out()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document falls at the first filter of an order that it fails: a table of 32 failure masks by 120 orders says
    where. Each task counts its documents by part, order, step and label; the counts are then summed, 600 rows a part
    and task, so no part gathers its documents anywhere.

    A null text is empty, a null source the part "". Copies are told table-wide, also of removed texts: all but those
    of least doc_id fail E, a row without doc_id neither fails E nor makes others fail. Of several labels of one id any
    1 counts; rows that repeat are separate documents (a task counts those of one id, part and text together); an empty table gives an empty result; further columns are
    ignored.
    """
    rows = judged(docs, labels).mapInArrow(_count, "part string, o int, s int, " + ", ".join(f"{c} long" for c in COUNTS))
    rows = rows.groupBy("part", "o", "s").agg(*[F.sum(c).alias(c) for c in COUNTS])
    so_far = W.Window.partitionBy("part", "o").orderBy("s")
    letter = F.substring(F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("o") + 1), F.col("s") + 1, F.lit(1))
    rows = rows.withColumn("kept", F.col("total") - F.sum("removed").over(so_far)).withColumn("letter", letter)
    rows = rows.withColumn("shapley", F.sum("removed").over(W.Window.partitionBy("part", "letter")))
    # a filter's failing documents that are not removed here were removed before
    return rows.select(
        "part", F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("o") + 1).alias("filter_order"), (F.col("s") + 1).alias("step"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        F.col("only").alias("unique_fails"), "good_lost", "toxic_lost", "shapley",
    )
