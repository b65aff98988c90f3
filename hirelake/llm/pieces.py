"""SentencePiece encoding and decoding; giant documents by a parallel max-plus scan over chunks.

An encoding is the path of greatest weight through a lattice of pieces. Each chunk has a transfer matrix in the
(max, +) semiring over boundary states: entry (x, y) is the greatest weight of a path that enters the chunk in state x
and leaves it in state y. Matrices are combined associatively in a tree; the best path through the whole then fixes each
boundary's state, and every chunk is traced back on its own.

* In a unigram model an edge weighs its piece's log probability, and a state is how far the piece at the boundary reaches
  beyond it.
* In a byte-pair model an edge weighs 0 where two neighbouring pieces stand side by side in the encoding of their
  concatenation, and minus infinity elsewhere: a sequence of pieces is its text's encoding exactly when every
  neighbouring pair is that of its own text. A state is that reach and the piece itself.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, runs, slices

BAR = "▁"
GIANT, CHUNK, FAN = 16_384, 4_096, 64
#: Short words whose ids are remembered in a process.
KNOWN = 300_000
_MODELS: dict[bytes, Pieces] = {}


def model_bytes(path: str | None = None) -> bytes:
    """The model file's content, read on the driver; by default the public 32k byte-pair model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def model(proto: bytes) -> Pieces:
    if proto not in _MODELS:
        _MODELS[proto] = Pieces(proto)
    return _MODELS[proto]


def _fields(raw: bytes):
    """(number, value) of the fields of a serialised message that are whole numbers or byte strings."""

    def number(at):
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
            yield tag >> 3, value
        elif tag & 7 == 2:
            n, at = number(at)
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            at += 8 if tag & 7 == 1 else 4


def is_unigram(proto: bytes) -> bool:
    """Whether a model file is of unigram type: field 3 of its trainer settings (field 2), 1 where unset."""
    settings = next((v for f, v in _fields(proto) if f == 2), b"")
    return next((v for f, v in _fields(settings) if f == 3), 1) == 1


class Pieces:
    """A model: the library for whole texts, and the pieces' scores for the lattice of a chunk."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.unigram = is_unigram(proto)
        n = len(self.lib)
        special = lambda i: self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i)
        self.id = {self.lib.id_to_piece(i): i for i in range(n) if not special(i)}
        self.score = {p: self.lib.get_score(i) for p, i in self.id.items()}
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = self.lib.is_byte(self.byte[0])
        #: What the library gives a character that no piece covers: ten less than the least score.
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.id), default=1)
        self.splits = all(BAR not in p.lstrip(BAR) for p in self.id)
        self.known: dict[str, list[int]] = {}
        self.pair = lru_cache(1 << 18)(self._pair)
        self.alone = lru_cache(1 << 16)(self._alone)

    def merged(self, s: str) -> list[str]:
        """The byte-pair merges of a short string: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _alone(self, a: str) -> bool:
        return self.merged(a) == [a]

    def _pair(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.byte[b] for b in piece.encode("utf-8")] if self.bytes else [self.lib.unk_id()]

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Where no piece spans the start of a word, words are encoded one by one and remembered."""
        if not text or self.unigram or not self.splits or text[0] == " " or text[-1] == " " or "  " in text or BAR in text:
            return self.lib.encode(text)
        known, out = self.known, []
        for word in text.split(" "):
            ids = known.get(word)
            if ids is None:
                ids = self.lib.encode(word)
                if len(known) < KNOWN and len(word) <= 12:
                    known[word] = ids
            out += ids
        return out

    def encode_words(self, s: str) -> list[int]:
        """Ids of an escaped stretch that starts with the bar."""
        return self.encode(s[1:].replace(BAR, " ")) if len(s) > 1 else self.ids(s)

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)

    def safe(self, s: str, i: int) -> bool:
        """Whether no piece can span the place before s[i]: a bar that follows something else."""
        return self.splits and 0 < i < len(s) and s[i] == BAR and s[i - 1] != BAR


START = ""


class WeighedChunk:
    """Part [a, b) of an escaped text under a unigram model, seen with `longest` characters on either side."""

    def __init__(self, m: Pieces, seen: str, a: int, b: int, first: bool, last: bool):
        self.m, self.s, self.a, self.b, self.first, self.last = m, seen, a, b, first, last

    def _edges(self, p: int):
        """(end, weight) of the pieces that start at p; a character without a piece of its own may stand as unknown."""
        s, score, alone = self.s, self.m.score, False
        for k in range(1, min(self.m.longest, len(s) - p) + 1):
            w = score.get(s[p : p + k])
            if w is not None:
                alone = alone or k == 1
                yield p + k, w
        if not alone:
            yield p + 1, self.m.unknown

    def _best(self, starts: list[int]) -> np.ndarray:
        """Greatest weight from each start to each place up to `longest` beyond b, by pieces that start before b."""
        best = np.full((len(self.s) + 1 - self.a, len(starts)), -np.inf)
        for n, p in enumerate(starts):
            best[p - self.a, n] = 0.0
        for p in range(self.a, self.b):
            here = best[p - self.a]
            if np.isfinite(here).any():
                for end, w in self._edges(p):
                    np.maximum(best[end - self.a], here + w, out=best[end - self.a])
        return best

    def transfer(self) -> list[tuple[str, str, float]]:
        """The finite entries of the transfer matrix: reach at the start, reach at the end, weight."""
        reach = [0] if self.first else range(min(self.m.longest, len(self.s) + 1 - self.a))
        best = self._best([self.a + r for r in reach])
        exits = [self.b] if self.last else range(self.b, min(len(self.s), self.b + self.m.longest - 1) + 1)
        return [(str(r), str(e - self.b), float(w)) for n, r in enumerate(reach) for e in exits if np.isfinite(w := best[e - self.a, n])]

    def trace(self, entry: str, exit_: str) -> list[int]:
        """Ids of the pieces that start in this chunk, on the best path from one boundary state to the other."""
        start, end = self.a + int(entry), self.b + int(exit_)
        best = self._best([start])[:, 0]
        into: dict[int, list[int]] = {}
        for p in range(start, self.b):
            if np.isfinite(best[p - self.a]):
                for e, w in self._edges(p):
                    if best[p - self.a] + w == best[e - self.a]:
                        into.setdefault(e, []).append(p)
        out: list[list[int]] = []
        while end > start:
            p = into[end][0]
            out.append(self.m.ids(self.s[p:end]))
            end = p
        return [i for ids in reversed(out) for i in ids]


class Chunk:
    """Part [a, b) of an escaped text under a byte-pair model, seen with `longest` characters on either side.

    As weights are 0 or minus infinity, a state keeps the set of entries that reach it as the bits of a number.
    """

    def __init__(self, m: Pieces, seen: str, a: int, b: int, first: bool, last: bool):
        self.m, self.s, self.a, self.b, self.first, self.last = m, seen, a, b, first, last
        self.cut_from = self.cut_to = None
        at = seen.find(BAR, a, b)
        while at >= 0 and self.cut_from is None:
            if m.safe(seen, at):
                self.cut_from = at
            at = seen.find(BAR, at + 1, b)
        at = seen.rfind(BAR, a, b)
        while at >= 0 and self.cut_from is not None and self.cut_to is None:
            if m.safe(seen, at):
                self.cut_to = at
            at = seen.rfind(BAR, a, at)

    def entries(self) -> list[tuple[int, str]]:
        """Boundary states at the start: (reach, piece). The first chunk has only the start state."""
        if self.first:
            return [(0, START)]
        out = []
        for i in range(max(0, self.a - self.m.longest), self.a):
            for j in range(self.a, min(len(self.s), i + self.m.longest) + 1):
                p = self.s[i:j]
                if (p in self.m.id or len(p) == 1) and self.m.alone(p):
                    out.append((j - self.a, p))
        return out

    def _walk(self, sources: dict[int, dict[str, int]], stop: int):
        """Reach from sources (place -> piece -> mask of entries) up to `stop`; pieces that end at or beyond it are kept.

        Returns the states found, place -> piece -> mask, and for each the states that lead to it.
        """
        m, s = self.m, self.s
        found = {p: dict(x) for p, x in sources.items()}
        prior: dict[tuple[int, str], list[tuple[int, str, int]]] = {}
        for p in range(min(found, default=stop), stop):
            for t, mask in found.get(p, {}).items():
                for k in range(1, min(m.longest, len(s) - p) + 1):
                    c = s[p : p + k]
                    if k > 1 and c not in m.id:
                        continue
                    if p < stop < p + k and stop != self.b:
                        continue
                    if m.alone(c) if t == START else m.pair(t, c):
                        at = found.setdefault(p + k, {})
                        at[c] = at.get(c, 0) | mask
                        prior.setdefault((p + k, c), []).append((p, t, mask))
        return found, prior

    def _sources(self, entries):
        out: dict[int, dict[str, int]] = {}
        for n, (reach, piece) in enumerate(entries):
            at = out.setdefault(self.a + reach, {})
            at[piece] = at.get(piece, 0) | (1 << n)
        return out

    def _exits(self, found) -> list[tuple[tuple[int, str], int]]:
        """States at the end with the mask of entries that reach them; of the last chunk, the text's end alone."""
        return [((p - self.b, t), mask) for p, x in found.items() if p >= self.b and (p == self.b or not self.last) for t, mask in x.items()]

    def transfer(self) -> list[tuple[str, str, float]]:
        """The finite entries of the transfer matrix, all 0."""
        entries = self.entries()
        if self.cut_from is None:
            pairs = self._exits(self._walk(self._sources(entries), self.b)[0])
        else:
            sources = self._sources(entries)
            found, _ = self._walk({p: x for p, x in sources.items() if p <= self.cut_from}, self.cut_from)
            into = 0
            for mask in found.get(self.cut_from, {}).values():
                into |= mask
            pairs = [(e, into) for e, mask in self._exits(self._walk({self.cut_to: {START: 1}}, self.b)[0]) if mask]
        name = lambda x: f"{x[0]}:{x[1]}"
        return [(name(e), name(x), 0.0) for x, mask in pairs for n, e in enumerate(entries) if mask >> n & 1]

    def trace(self, entry: str, exit_: str) -> list[int]:
        """Ids of the pieces that start in this chunk, on the path from one boundary state to the other."""
        read = lambda x: (int(x.split(":", 1)[0]), x.split(":", 1)[1])
        (reach, piece), (far, last) = read(entry), read(exit_)
        source, end = {self.a + reach: {piece: 1}}, (self.b + far, last)
        if self.cut_from is None:
            return self._back(source, self.b, end)
        found, _ = self._walk(source, self.cut_from)
        at_cut = [(self.cut_from, t) for t in found.get(self.cut_from, {})]
        head = self._back(source, self.cut_from, at_cut[0])
        middle = self.m.encode_words(self.s[self.cut_from : self.cut_to]) if self.cut_to > self.cut_from else []
        return head + middle + self._back({self.cut_to: {START: 1}}, self.b, end)

    def _back(self, source, stop, end) -> list[int]:
        _, prior = self._walk(source, stop)
        out: list[list[int]] = []
        while end[0] not in source or end[1] not in source[end[0]]:
            out.append(self.m.ids(end[1]))
            p, t, _ = prior[end][0]
            end = (p, t)
        return [i for ids in reversed(out) for i in ids]


def escaped(text: str) -> str:
    return BAR + text.replace(" ", BAR)


Matrix = list[tuple[str, str, float]]


def compose(matrices: list[Matrix]) -> Matrix:
    """The (max, +) product of matrices given by their finite entries."""
    total = {(a, b): w for a, b, w in matrices[0]}
    for m in matrices[1:]:
        after: dict[str, list[tuple[str, float]]] = {}
        for a, b, w in m:
            after.setdefault(a, []).append((b, w))
        product: dict[tuple[str, str], float] = {}
        for (a, b), v in total.items():
            for c, w in after.get(b, ()):
                if v + w > product.get((a, c), -np.inf):
                    product[a, c] = v + w
        total = product
    return sorted((a, b, w) for (a, b), w in total.items())


def between(matrices: list[Matrix], entry: str, exit_: str) -> list[tuple[str, str]]:
    """Each matrix's own entry and exit on the best path from `entry` to `exit_`."""
    ahead, here = [], {entry: 0.0}
    for m in matrices:
        ahead.append(here)
        step: dict[str, float] = {}
        for a, b, w in m:
            if a in here and here[a] + w > step.get(b, -np.inf):
                step[b] = here[a] + w
        here = step
    out, end = [], exit_
    for m, here in zip(reversed(matrices), reversed(ahead), strict=True):
        start = max((here[a] + w, a) for a, b, w in m if b == end and a in here)[1]
        out.append((start, end))
        end = start
    return out[::-1]


def split(text: str, longest: int, chunk: int = CHUNK):
    """(seen, a, b) of each chunk: its text with `longest` characters on either side, and its bounds therein."""
    s = escaped(text)
    for at in range(0, len(s), chunk):
        lo, hi = max(0, at - longest), min(len(s), at + chunk + longest)
        yield s[lo:hi], at - lo, min(at + chunk, len(s)) - lo


def _id_column(ids: list[list[int]]) -> pa.Array:
    """A list column from Python lists, by way of one flat array."""
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1]))))


def _id_lists(column: pa.Array):
    """Each row's ids as a Python list; a null row has none."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def _whole(proto: bytes):
    def run(batches):
        m = model(proto)
        for rb in slices(batches):
            ids = [m.encode(t or "") for t in rb.column("text").to_pylist()]
            own = [c for c in rb.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in own], _id_column(ids)], names=[*own, "ids"])

    return run


def _split(proto: bytes, chunk: int):
    def run(batches):
        m = model(proto)
        for rb in slices(batches, 16):
            for rid, text in zip(rb.column("rid").to_pylist(), rb.column("text").to_pylist(), strict=True):
                parts = list(split(text, m.longest, chunk))
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rid] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array([len(parts)] * n, pa.int64()), pa.array([p[0] for p in some]), pa.array([p[1] for p in some], pa.int32()), pa.array([p[2] for p in some], pa.int32())],
                        names=["rid", "i", "n", "seen", "a", "b"],
                    )

    return run


_PAIRS = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("w", pa.float64())]))
_MATRIX = "rid long, i long, n long, pairs array<struct<a:string,b:string,w:double>>"


def _chunk(m, r) -> Chunk | WeighedChunk:
    return (WeighedChunk if m.unigram else Chunk)(m, r["seen"], r["a"], r["b"], r["i"] == 0, r["i"] == r["n"] - 1)


def _transfer(proto: bytes):
    def run(batches):
        m = model(proto)
        for rb in slices(batches, 64):
            rows = rb.to_pylist()
            pairs = [_entries(_chunk(m, r).transfer()) for r in rows]
            yield pa.RecordBatch.from_arrays([rb.column("rid"), rb.column("i"), rb.column("n"), pa.array(pairs, _PAIRS)], names=["rid", "i", "n", "pairs"])

    return run


def _trace(proto: bytes):
    def run(batches):
        m = model(proto)
        for rb in slices(batches, 64):
            ids = [_chunk(m, r).trace(r["entry"], r["exit"]) for r in rb.to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("rid"), rb.column("i"), _id_column(ids)], names=["rid", "i", "ids"])

    return run


def _entries(matrix: Matrix) -> list[dict]:
    return [{"a": a, "b": b, "w": w} for a, b, w in matrix]


def _pairs(value) -> Matrix:
    return [(x["a"], x["b"], x["w"]) for x in value]


def _up(fan: int):
    """Combine each run of `fan` neighbouring matrices of a text."""

    def run(batches):
        for group in runs(batches, ["rid", "up"]):
            group = group.sort_values("i")
            total = _entries(compose([_pairs(p) for p in group["pairs"]]))
            rid, up, n = (int(group[c].iloc[0]) for c in ("rid", "up", "n"))
            yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([up], pa.int64()), pa.array([-(-n // fan)], pa.int64()), pa.array([total], _PAIRS)], names=["rid", "i", "n", "pairs"])

    return run


def _down(batches):
    """From a run's entry and exit, those of each of its matrices."""
    for group in runs(batches, ["rid", "up"]):
        group = group.sort_values("i")
        path = between([_pairs(p) for p in group["pairs"]], group["entry"].iloc[0], group["exit"].iloc[0])
        yield pa.RecordBatch.from_arrays([pa.array(group["rid"].tolist(), pa.int64()), pa.array(group["i"].tolist(), pa.int64()), pa.array([p[0] for p in path]), pa.array([p[1] for p in path])], names=["rid", "i", "entry", "exit"])


def _scan(chunks: DataFrame, proto: bytes, fan: int) -> DataFrame:
    """rid and ids of the chunked texts, by the scan: matrices up the tree, boundary states down it, traces per chunk."""
    levels = [cut(chunks.mapInArrow(_transfer(proto), _MATRIX), "transfer")]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        low = levels[-1].withColumn("up", F.floor(F.col("i") / fan))
        low = low.repartition("rid", "up").sortWithinPartitions("rid", "up")
        levels.append(cut(low.mapInArrow(_up(fan), _MATRIX), "transfer"))
    whole = F.array_max(F.transform("pairs", lambda x: F.struct(x["w"], x["a"], x["b"])))
    states = levels[-1].select("rid", "i", whole["a"].alias("entry"), whole["b"].alias("exit"))
    for level in reversed(levels[:-1]):
        states = states.select("rid", F.col("i").alias("up"), "entry", "exit")
        low = level.withColumn("up", F.floor(F.col("i") / fan)).join(states, ["rid", "up"])
        states = low.repartition("rid", "up").sortWithinPartitions("rid", "up").mapInArrow(_down, "rid long, i long, entry string, exit string")
    traced = chunks.join(states, ["rid", "i"]).mapInArrow(_trace(proto), "rid long, i long, ids array<int>")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"]))
    done = traced.groupBy("rid").agg(ids.alias("ids"))
    m = model(proto)
    if not m.bytes:  # the library writes a run of unknown characters as one
        unknown = m.lib.unk_id()
        done = done.withColumn("ids", F.filter("ids", lambda x, k: (x != unknown) | (k == 0) | (F.get("ids", k - 1) != unknown)))
    return done


def encode(docs: DataFrame, text: str = "text", proto: bytes | None = None, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text) and ids, the model's encoding of each text, equal to the library's.

    The model may be of byte-pair or unigram type. Where two encodings of a unigram model weigh the same but for the
    rounding of their sums, the library, which sums in single precision, may name the other one.

    Texts of at most `giant` characters are encoded whole by the library. A longer one is split into chunks of `chunk`
    characters wherever that falls, and encoded by the scan that the module describes.

    A null or empty text has no ids. Repeated rows each get a row; an empty table gives an empty result. Further columns
    may have any name; one called ids gives way to the result.
    """
    proto = proto or model_bytes()
    keep = [c for c in docs.columns if c not in (text, "ids")] if keep is None else keep
    whole = F.coalesce(F.col(text), F.lit(""))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    short = docs.filter(F.length(whole) <= giant).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], whole.alias("text"))
    short = short.mapInArrow(_whole(proto), ", ".join([*(f"k{i} {types[c]}" for i, c in enumerate(keep)), "ids array<int>"]))
    short = short.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids")
    long = docs.filter(F.length(whole) > giant)
    long = cut(long.select(F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), whole.alias("text"), F.monotonically_increasing_id().alias("rid")), "giants")
    if long.isEmpty():
        return short
    kind = "rid long, i long, n long, seen string, a int, b int"
    chunks = cut(long.select("rid", "text").repartition(F.col("rid")).mapInArrow(_split(proto, chunk), kind), "chunks")
    ids = _scan(chunks, proto, fan)
    done = long.select("rid", "kept").join(ids, "rid").select(*([F.col("kept")[c].alias(c) for c in keep]), "ids")
    return short.unionByName(done)


def decode(encoded: DataFrame, proto: bytes | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `decoded`, the text of each row's ids."""
    proto = proto or model_bytes()
    keep = [c for c in encoded.columns if c != "ids"] if keep is None else keep
    types = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    def run(batches):
        m = model(proto)
        for rb in slices(batches):
            texts = [m.decode(x) for x in _id_lists(rb.column("ids"))]
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in rb.schema.names if c != "ids"], pa.array(texts, pa.string())], names=[*(c for c in rb.schema.names if c != "ids"), "decoded"])

    return encoded.select(*keep, "ids").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "decoded string"]))


def round_trip(docs: DataFrame, proto: bytes | None = None, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids, decoded_sha256, same.

    `same` tells whether decoding gives the text back; a text that holds U+2581 itself does not, as the model writes
    spaces so. Null and empty texts have no ids and decode to the empty text. Further columns are ignored.
    """
    proto = proto or model_bytes()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("own"), "text")
    enc = encode(slim, proto=proto, keep=["doc_id", "own"], **options)

    def run(batches):
        m = model(proto)
        for rb in slices(batches):
            ids = rb.column("ids")
            lists = _id_lists(ids)
            sha = [hashlib.sha256(m.decode(x).encode("utf-8")).hexdigest() for x in lists]
            same = [a == b for a, b in zip(sha, rb.column("own").to_pylist(), strict=True)]
            n = list(map(len, lists))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(n, pa.int64()), ids, pa.array(sha), pa.array(same)], names=["doc_id", "n_tokens", "ids", "decoded_sha256", "same"])

    return enc.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, same boolean")
