"""Language-model scoring with a hierarchical Pitman-Yor model whose seating is sampled by Gibbs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, byte_hashes, cut, discard, join_spread, mix, text_or_empty

STRENGTH, BURN, SAMPLES, MOVES = 1.0, 3, 4, 2
#: A word (a pair) with a 2,048th of all tokens or more is dealt apart; there are at most 2,048 such.
HOT = 2048
#: Tokens that a task turns into sorted blocks at a time, tokens a part is meant to have, pairs a stored block has about.
FLUSH, PART, BLOCK = 700_000, 2_000_000, 300_000
#: Tables of more tokens are scored in three goes, by the texts' hashes, so that the disk holds the messages of one.
ONE_GO, GOES = 8_000_000, 3
#: Bits of a sorting key.
WIDE = 63
_U = np.uint64
END = _U(0xD1B54A32D192ED03)
_ODD, _STEP = _U(0xA24BAED4963EE407), 0x9FB21C651E98DF25


# --- tokens and blocks -----------------------------------------------------------------------


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text's words and one END, and how many tokens each text has."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer((b"\n".join(raw) + b"\n").lower(), np.uint8)  # of bytes, A-Z alone
    word = ~_SPACE[b]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    n = np.diff(np.searchsorted(starts, bounds))
    out = np.full(len(starts) + len(raw), END)
    ends = np.cumsum(n + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = byte_hashes(b)
    return out, n + 1


def context(tok: np.ndarray) -> np.ndarray:
    """Each token's restaurant, the token before it; a text's first token follows an END."""
    return np.concatenate((np.array([END]), tok[:-1]))


def flushes(batches, keys: tuple[str, ...] = ()):
    """(tokens, contexts, tokens of each text, the texts' keys) of FLUSH tokens or a little more; with keys, equal texts of one flush once."""
    held, count, seen, some, size = [], 0, [], [], 0
    known: set = set()

    def hashed():
        nonlocal some, size, count
        if some:
            held.append(tokens(some))
            count += len(held[-1][0])
        some, size = [], 0

    def out():
        tok = np.concatenate([t for t, _ in held])
        return tok, context(tok), np.concatenate([n for _, n in held]), list(seen)

    for rb in batches:
        columns = [rb.column(k).to_pylist() for k in keys]
        for at, text in enumerate(rb.column("text")):
            if keys:
                key = tuple(c[at] for c in columns)
                if key in known:
                    continue
                known.add(key)
                seen.append(key)
            some.append(text.as_py())
            size += len(some[-1]) + 1
            if size >= 1 << 19:
                hashed()
                if count >= FLUSH:
                    yield out()
                    held, count, seen, known = [], 0, [], set()
    hashed()
    if held:
        yield out()


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    body = b"".join(a.tobytes() for a in arrays)
    return head + len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unpack(raw: bytes, kinds: str) -> list[np.ndarray]:
    kinds = kinds.split()
    sizes = np.frombuffer(raw, "<i8", len(kinds) + 1)
    body, out, at = pa.Codec("zstd").decompress(raw[8 * len(kinds) + 8 :], int(sizes[-1]), asbytes=True), [], 0
    for kind, n in zip(kinds, sizes, strict=False):
        out.append(np.frombuffer(body, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "block"])


@dataclass(frozen=True)
class Plan:
    """How words are dealt: `parts` by the word's hash, pairs of hot words (sorted) by word and context."""

    parts: int
    words: np.ndarray
    pairs: np.ndarray  # sorted hashes of the hot pairs
    goes: int = 1

    def among(self, words: np.ndarray) -> np.ndarray:
        """Each word's number among the hot ones, or -1."""
        return _found(self.words, words)

    def home(self, words: np.ndarray) -> np.ndarray:
        """The part of each word that is not hot."""
        return (mix(words ^ _ODD) % _U(self.parts)).astype(np.int32)

    def route(self, words: np.ndarray, w: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The part of each pair, by its word's number in `words` and its hash."""
        part = self.home(words)[w]
        hot = np.flatnonzero((self.among(words) >= 0)[w])
        part[hot] = (keys[hot] % _U(self.parts)).astype(np.int32)
        return part


def pair_hash(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(words + (contexts.astype(np.uint64) + _U(1)) * _ODD)


def _found(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _heavy(batches):
    """Words and pairs with a 2 * HOT-th of a flush's tokens: kind (0 all tokens, 1 words, 2 pairs), hash, number."""
    for tok, ctx, _, _ in flushes(batches):
        words, n = np.unique(tok, return_counts=True)
        big = n * 2 * HOT >= len(tok)
        near = np.flatnonzero(_found(words[big], tok) >= 0)
        pairs, m = np.unique(pair_hash(tok[near], ctx[near]), return_counts=True)
        some = m * 2 * HOT >= len(tok)
        kind = [0] + [1] * int(big.sum()) + [2] * int(some.sum())
        value = np.concatenate(([_U(0)], words[big], pairs[some])).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(value), pa.array(np.concatenate(([len(tok)], n[big], m[some])), pa.int64())], names=["kind", "hash", "n"])


def plan(docs: DataFrame, per_part: int = PART) -> Plan:
    """Number of parts and hot words, from all documents. A word or pair with a HOT-th of all tokens is found for certain:
    flushes that do not name it hold less than half of what it needs.
    """
    rows = cut(docs.select("text").mapInArrow(_heavy, "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n")), "heavy")
    total = rows.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    big = rows.filter((F.col("kind") > 0) & (F.col("n") * (2 * HOT) >= total)).collect()  # at most 4 * HOT rows
    discard(rows)
    hashes = lambda k: np.sort(np.array([r["hash"] for r in big if r["kind"] == k], np.int64).view(np.uint64))
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // per_part))
    return Plan(parts, hashes(1), hashes(2), GOES if total > ONE_GO else 1)


# --- counts ----------------------------------------------------------------------------------

COUNTS = "<u8 <u4 <u8 <u8"  # words, pairs of each word, contexts, customers
#: Rows of a part: words whose seating changes, words with their customers, and what words tell the parts of their contexts.
LIVE, WORDS, TOLD, SEATED = 1, 2, 3, 4
LIVELY = "<u8 <u4 <u4 <u8 <u8"  # words, pairs of each, those of two customers or more; their contexts and customers
REST = "<u8 <u8"  # words of one lone customer; hashes of the pairs of one customer
ROW = "kind int, part int, home int, block int, body binary, rest binary, sums binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    names = "kind part home block body rest sums".split()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _dealt(part: np.ndarray) -> np.ndarray:
    """Places by part, those of one part in their order; numbers of 16 bits are sorted in a pass."""
    return np.argsort(part.astype(np.int16) if part.max(initial=0) < 1 << 15 else part, kind="stable")


def _by_part(part: np.ndarray, order: np.ndarray | None = None):
    """(part, the places of its members in their order)."""
    order = _dealt(part) if order is None else order
    edges = [*np.flatnonzero(np.diff(part[order], prepend=-1)), len(order)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(part[order[a]]), order[a:b]


def _coded(tok: np.ndarray):
    """Distinct words, each token's number among them, and that of its context, which is a word of the same texts."""
    words, w = np.unique(tok, return_inverse=True)
    return words, w, np.concatenate(([np.searchsorted(words, END)], w[:-1]))


def _pairs(deal: Plan):
    def run(batches):
        for tok, _, _, _ in flushes(batches):
            words, w, c = _coded(tok)
            code, n = np.unique(w * len(words) + c, return_counts=True)
            w, c = np.divmod(code, len(words))
            rows = []
            for part, at in _by_part(deal.route(words, w, pair_hash(words[w], words[c]))):
                own, many = np.unique(w[at], return_counts=True)
                rows.append((part, pack(words[own], many.astype("<u4"), words[c[at]], n[at].astype("<u8"))))
            yield _batch(rows)

    return run


class Contexts:
    """The distinct contexts of a block's pairs: hot ones, whose numbers pass in sums, and others, which lie by part."""

    def __init__(self, deal: Plan, contexts: np.ndarray):
        self.all, self.of = np.unique(contexts, return_inverse=True)
        hot = deal.among(self.all)
        self.far, self.hot = np.flatnonzero(hot >= 0), hot[hot >= 0]
        near = np.flatnonzero(hot < 0)
        self.parts = [(part, near[at]) for part, at in _by_part(deal.home(self.all[near]))]

    def joined(self, customers: np.ndarray) -> np.ndarray:
        """Customers that opened no table, by context."""
        return np.bincount(self.of, customers, len(self.all))

    def messages(self, home: int, block: int, joined: np.ndarray):
        """For the part of each context, how many customers have joined (a number for each sample)."""
        return [(TOLD, part, home, block, pack(self.all[at], joined[at].ravel().astype("<f8")), None, None) for part, at in self.parts]

    def tables(self, answers: dict[int, bytes], hot: np.ndarray) -> np.ndarray:
        """Tables of each pair's context, from the answers of its part."""
        out = np.zeros(len(self.all))
        out[self.far] = hot[self.hot]
        for part, at in self.parts:
            out[at] = unpack(answers[part], "<f8")[0]
        return out[self.of]


def _merged(deal: Plan):
    """One part's blocks as one table, stored in blocks that end with a word."""

    def run(batches):
        raw = [(p, unpack(b, COUNTS)) for rb in batches for p, b in zip(rb.column("part").to_pylist(), rb.column("block").to_pylist(), strict=True)]
        for part in sorted({p for p, _ in raw}):
            own = [x for p, x in raw if p == part]
            words, w = np.unique(np.concatenate([np.repeat(w, m) for w, m, _, _ in own]), return_inverse=True)
            contexts, c = np.unique(np.concatenate([g for _, _, g, _ in own]), return_inverse=True)
            code = w * len(contexts) + c
            order = np.argsort(code)
            code, n = code[order], np.concatenate([k for _, _, _, k in own])[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            w, c = np.divmod(code[first], len(contexts))
            n, g = np.add.reduceat(n, first), contexts[c]
            many = np.bincount(w, minlength=len(words))
            ends = np.cumsum(many)
            at = block = 0
            while at < len(words):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
                lo, hi = (ends[at - 1] if at else 0), ends[to - 1]
                yield _rows(_stored(deal, part, block, words[at:to], many[at:to], g[lo:hi], n[lo:hi]))
                at, block = to, block + 1

    return run


def _stored(deal: Plan, part: int, block: int, words, many, g, n) -> list[tuple]:
    """A block's rows. sums: pairs of one and of two customers, words of one and of two contexts, words, customers,
    pairs, words of one lone customer; each hot word's customers, contexts and joined customers as a context; each hot
    pair's customers, and whether it is of one.
    """
    w, h = np.repeat(np.arange(len(words)), many), len(deal.words)
    keys, m = pair_hash(words[w], g), n.astype(np.float64)
    hot, multi = deal.among(words), n >= 2
    far = hot >= 0
    several, customers = np.bincount(w[multi], minlength=len(words)), np.bincount(w, m, len(words))
    live = far | (many >= 2) | (several > 0)
    contexts = Contexts(deal, g[multi])
    joined = contexts.joined(m[multi] - 1)
    at = _found(deal.pairs, keys)
    mine = at >= 0
    sums = np.concatenate([
        [(n == 1).sum(), (n == 2).sum(), (many[~far] == 1).sum(), (many[~far] == 2).sum(), (~far).sum(), m.sum(), len(n), (~live).sum()],
        np.bincount(hot[far], customers[far], h), np.bincount(hot[far], many[far], h), np.bincount(contexts.hot, joined[contexts.far], h),
        np.bincount(at[mine], m[mine], len(deal.pairs)), np.bincount(at[mine], n[mine] == 1, len(deal.pairs)),
    ])
    body = pack(words[live], many[live].astype("<u4"), several[live].astype("<u4"), g[multi], n[multi].astype("<u8"))
    rest = pack(words[~live], np.sort(keys[~multi]))
    told = live & ~far & (customers >= 2)
    return [
        (LIVE, part, part, block, body, rest, pack(sums.astype("<f8"))),
        (WORDS, part, part, block, pack(words[told], customers[told].astype("<u8")), None, None),
        *contexts.messages(part, block, joined),
    ]


def counts(docs: DataFrame, deal: Plan) -> DataFrame:
    """ROW: every pair of a context and a word in the documents with its number, all of a word (that is not hot) in one block."""
    rows = docs.select("text").mapInArrow(_pairs(deal), "part int, block binary")
    return cut(rows.repartitionById(deal.parts, F.col("part")).mapInArrow(_merged(deal), ROW), "pairs")


def _summed(batches):
    total = None
    for rb in batches:
        for raw in rb.column("sums").to_pylist():
            v = unpack(raw, "<f8")[0]
            total = v if total is None else total + v
    if total is not None:
        context = TaskContext.get()
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId() % 16], pa.int32()), pa.array([pack(total)], pa.binary())], names=["slot", "sums"])


def gathered(rows: DataFrame) -> np.ndarray | None:
    """The sum of the vectors in `sums`: by task, then in 16 tasks, then here."""
    part = rows.select("sums").filter("sums is not null").mapInArrow(_summed, "slot int, sums binary").repartitionById(16, F.col("slot"))
    found = [unpack(r["sums"], "<f8")[0] for r in part.mapInArrow(_summed, "slot int, sums binary").collect()]
    return sum(found[1:], found[0]) if found else None


# --- seating ---------------------------------------------------------------------------------


def enter(owner, size, customers, tables, k, fresh, discount, u, v):
    """k[i] customers enter restaurant i one after another, seen as one step; returns owner, size of its tables, and the new tables.

    A customer opens a table with weight fresh[i], else joins one with weight size - discount. One customer is one draw
    of the Chinese restaurant; more are dealt by systematic sampling with the same expectations.
    """
    held = customers - discount * tables
    new = np.floor(k * (fresh / (fresh + held)) + u).astype(np.int64)
    rest = (k - new).astype(np.float64)
    end = np.cumsum(size - discount)
    first = np.cumsum(tables) - tables
    last = first + tables - 1
    start = np.where(first > 0, end[first - 1], 0.0)
    hi = (end - start[owner]) * (rest / held)[owner] + v[owner]
    hi[last] = rest + v
    lo = np.concatenate(([0.0], hi[:-1]))
    lo[first] = v
    size = size + (np.floor(hi) - np.floor(lo)).astype(np.int64)
    if new.any():
        own = np.concatenate((owner, np.repeat(np.arange(len(k)), new)))
        order = np.argsort(own, kind="stable")
        owner, size = own[order], np.concatenate((size, np.ones(new.sum(), np.int64)))[order]
    return owner, size, new


def leave(owner, size, customers, tables, k, v):
    """k[i] customers, drawn from all of restaurant i, leave; returns owner, size of its tables, and the tables that fell empty."""
    end = np.cumsum(size)
    first = np.cumsum(tables) - tables
    start = np.where(first > 0, end[first - 1], 0)
    hi = (end - start[owner]) * (k / customers)[owner] + v[owner]
    hi[first + tables - 1] = k + v
    lo = np.concatenate(([0.0], hi[:-1]))
    lo[first] = v
    size = size - (np.floor(hi) - np.floor(lo)).astype(np.int64)
    stay = size > 0
    return owner[stay], size[stay], np.bincount(owner[~stay], minlength=len(k))


class Seating:
    """Tables of many restaurants side by side, each serving one dish: their sizes, in order of restaurant."""

    def __init__(self, customers: np.ndarray, fresh: np.ndarray, discount: float, draw):
        """Customers sit down in turn; from the sixteenth on, an eighth of those present at a time."""
        self.discount, self.customers = discount, customers.astype(np.int64)
        active, done = np.arange(len(customers)), []
        owner, size, tables, here, turn = active, np.ones(len(active), np.int64), np.ones(len(active), np.int64), np.ones(len(active), np.int64), 0
        while len(active):
            full = here >= self.customers[active]
            if full.any():
                done.append((active[owner[full[owner]]], size[full[owner]]))
                keep = np.flatnonzero(~full)
                place = np.full(len(active), -1)
                place[keep] = np.arange(len(keep))
                stay = ~full[owner]
                owner, size, active, tables, here = place[owner[stay]], size[stay], active[keep], tables[keep], here[keep]
                continue
            k = np.minimum(self.customers[active] - here, np.maximum(1, here // 8))
            owner, size, new = enter(owner, size, here, tables, k, fresh[active], discount, draw(2 * turn, active), draw(2 * turn + 1, active))
            tables, here, turn = tables + new, here + k, turn + 1
        owner = np.concatenate([o for o, _ in done]) if done else owner
        order = np.argsort(owner, kind="stable")
        self.owner, self.size = owner[order], (np.concatenate([s for _, s in done]) if done else size)[order]
        self.tables = np.bincount(self.owner, minlength=len(customers))

    def leave(self, k, v):
        self.owner, self.size, lost = leave(self.owner, self.size, self.customers, self.tables, k, v)
        self.customers, self.tables = self.customers - k, self.tables - lost
        return lost

    def enter(self, k, fresh, u, v):
        self.owner, self.size, new = enter(self.owner, self.size, self.customers, self.tables, k, fresh, self.discount, u, v)
        self.customers, self.tables = self.customers + k, self.tables + new
        return new


@dataclass(frozen=True)
class World:
    """What a block must know of the others: discounts, the root's customers and tables, hot words' root probabilities and
    their tables as contexts.
    """

    discount: float
    root_discount: float
    root_customers: float
    root_tables: float
    outcomes: float
    hot: np.ndarray
    hot_tables: np.ndarray

    @property
    def root_fresh(self) -> float:
        return (STRENGTH + self.root_discount * self.root_tables) / self.outcomes

    def root(self, less_discounts):
        """Root probability of words with so many customers less the discount of each table."""
        return (less_discounts + self.root_fresh) / (STRENGTH + self.root_customers)


def uniform(base: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) fixed by a restaurant and dish and a step, whatever block they lie in."""
    return (mix(base + _U(step * _STEP % (1 << 64))) >> _U(11)).astype(np.float64) * 2.0**-53


def chain(words, many, several, keys, n, context_tables, deal: Plan, world: World):
    """Gibbs sampling of one block's seating: for each kept sample, tables of each pair and the root's customers and tables of each word.

    In each move every pair of two or more customers has one get up, drawn from all of them, and sit down again; a
    table that falls empty takes its customer out of the root restaurant, a new one sends one there, and the root's own
    customers move too. Pairs move side by side: each sees the root as the step before left it, and the other blocks
    (tables of its context, the root's totals, hot words) as of the round before. A lone customer always comes back to
    a table of its own, and a word of one lone customer has one table everywhere; neither is given here.
    """
    size = len(words)
    mw = np.repeat(np.arange(size), several)
    hot = deal.among(words)
    far = hot >= 0
    word = mix(words ^ _U(_STEP))
    per_context = STRENGTH + world.discount * context_tables
    fixed = np.where(far, world.hot[hot] if len(world.hot) else 0.0, 0.0)
    fresh_root = np.full(size, world.root_fresh)
    p0 = lambda c, t: np.where(far, fixed, world.root(c - world.root_discount * t))
    kinds = many.astype(np.float64)
    seats = Seating(n, per_context * p0(kinds, 0.5 * kinds)[mw], world.discount, lambda turn, at: uniform(keys[at], turn))
    alone = many.astype(np.int64) - several
    root = Seating(alone + np.bincount(mw, seats.tables, size).astype(np.int64), fresh_root, world.root_discount, lambda turn, at: uniform(word[at], turn))
    one, step = np.ones(len(n), np.int64), 1 << 20
    for sweep in range(BURN + SAMPLES):
        for _ in range(MOVES):
            draw = lambda base, n, step=step: uniform(base, step + n)
            lost = seats.leave(one, draw(keys, 0))
            root.leave(np.bincount(mw, lost, size).astype(np.int64), draw(word, 1))
            new = seats.enter(one, per_context * p0(root.customers, root.tables)[mw], draw(keys, 2), draw(keys, 3))
            root.enter(np.bincount(mw, new, size).astype(np.int64), fresh_root, draw(word, 4), draw(word, 5))
            some = (root.customers >= 2).astype(np.int64)
            root.leave(some, draw(word, 6))
            root.enter(some, fresh_root, draw(word, 7), draw(word, 8))
            step += 9
        if sweep >= BURN:
            yield seats.tables, root.customers, root.tables


#: Words and their customers; customers of each pair, its hash and its tables, summed over samples; each word's root customers less discounts, by sample.
MODEL = "<u8 <u8 <u8 <u8 <u8 <f8"


def _context_tables(batches):
    """Answers to what blocks have told a part of its words as contexts: customers less those that joined a table."""
    words, told = [], []
    for rb in batches:
        for kind, part, home, block, body in zip(*[rb.column(c).to_pylist() for c in ("kind", "part", "home", "block", "body")], strict=True):
            if kind == WORDS:
                words.append((part, *unpack(body, "<u8 <u8")))
            else:
                told.append((part, home, block, *unpack(body, "<u8 <f8")))
    for part in sorted({x[0] for x in told}):
        own, asked = [x for x in words if x[0] == part], [x for x in told if x[0] == part]
        known, n = np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own])
        order = np.argsort(known)
        known, tables = known[order], n[order].astype(np.float64)
        at = [_found(known, x[3]) for x in asked]
        tables -= np.bincount(np.concatenate(at), np.concatenate([x[4] for x in asked]), len(tables))
        yield _rows([(TOLD, home, part, block, pack(tables[a]), None, None) for (_, home, block, _, _), a in zip(asked, at, strict=True)])


def _sampled(deal: Plan, world: World, last: bool):
    """The chain over each block. sums: by sample, the root's customers and tables, customers of hot words and joined
    customers of hot contexts; then tables of hot pairs over all samples. In the last round, the block's model.
    """

    def run(batches):
        live, answers = [], {}
        for rb in batches:
            for kind, part, home, block, body, rest in zip(*[rb.column(c).to_pylist() for c in ("kind", "part", "home", "block", "body", "rest")], strict=True):
                if kind == LIVE:
                    live.append((part, block, body, rest))
                else:
                    answers.setdefault((part, block), {})[home] = body
        for part, block, body, rest in live:
            words, many, several, g, n = unpack(body, LIVELY)
            keys, contexts, hot = pair_hash(np.repeat(words, several), g), Contexts(deal, g), deal.among(words)
            near, mine = hot < 0, hot >= 0
            customers_of = n.astype(np.int64)
            total, sums, less, joined = np.zeros(len(n), np.int64), [], [], []
            for t, customers, tables in chain(words, many, several, keys, n, contexts.tables(answers.pop((part, block), {}), world.hot_tables), deal, world):
                total += t
                less.append(customers - world.root_discount * tables)
                joined.append(contexts.joined(customers_of - t))
                sums += [[customers[near].sum(), tables[near].sum()], np.bincount(hot[mine], customers[mine], len(deal.words)), np.bincount(contexts.hot, joined[-1][contexts.far], len(deal.words))]
            at = _found(deal.pairs, keys)
            sums.append(np.bincount(at[at >= 0], total[at >= 0], len(deal.pairs)))
            model = None
            joined = np.stack(joined, axis=1)
            if last:
                lone, single = unpack(rest, REST)
                held = np.bincount(np.repeat(np.arange(len(words)), several), n, len(words)) + many - several
                less = np.concatenate((np.stack(less, axis=1), np.full((len(lone), SAMPLES), 1 - world.root_discount)))
                model = pack(
                    np.concatenate((words, lone)), np.concatenate((held.astype("<u8"), np.ones(len(lone), "<u8"))), np.concatenate((n, np.ones(len(single), "<u8"))),
                    np.concatenate((keys, single)), np.concatenate((total.astype("<u8"), np.full(len(single), SAMPLES, "<u8"))), less.ravel(),
                )
            else:
                joined = joined.mean(axis=1)[:, None]
            yield _rows([(SEATED, part, part, block, model, None, pack(np.concatenate(sums).astype("<f8"))), *contexts.messages(part, block, joined)])

    return run


@dataclass(frozen=True)
class Model:
    """The averaged predictive distribution: what is common to all words here, words and pairs in `blocks`, words as contexts in `told`."""

    deal: Plan
    discount: float
    scale: np.ndarray  # [sample]: root probability = (less + fresh) / scale
    fresh: np.ndarray
    total: float
    distinct: float
    hot_counts: np.ndarray
    hot_less: np.ndarray  # [hot word, sample]
    hot_tables: np.ndarray  # [hot word, sample], as contexts
    hot_pairs: np.ndarray  # (customers - discount * tables) of each hot pair
    blocks: DataFrame | None = None
    told: DataFrame | None = None

    def root(self, less: np.ndarray) -> np.ndarray:
        return (less + self.fresh) / self.scale

    def predictive(self, direct: np.ndarray, c: np.ndarray, root: np.ndarray, customers: np.ndarray | None = None, tables: np.ndarray | None = None) -> np.ndarray:
        """Probability after a context, averaged over samples: direct = customers - discount * tables of the pair (0: unseen).

        c is the context's place among `customers` and `tables` [context, sample]; without them none of the contexts was seen.
        """
        if customers is None or tables is None:
            return direct / STRENGTH + root.mean(axis=1)
        held = STRENGTH + customers
        back = (STRENGTH + self.discount * tables) / held[:, None]
        return direct / held[c] + np.einsum("ij,ij->i", back[c], root) / root.shape[1]

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.total + (self.distinct + 1)))


def _hot_root(customers: np.ndarray, words: np.ndarray, fresh: float, discount: float) -> np.ndarray:
    """Root tables of the hot words, seated here: at most 2 * HOT words."""
    base = mix(words ^ _U(_STEP))
    return Seating(np.maximum(1, np.rint(customers)).astype(np.int64), np.full(len(words), fresh), discount, lambda turn, at: uniform(base[at], turn)).tables.astype(np.float64)


def fit(docs: DataFrame, deal: Plan, rounds: int = 2) -> Model:
    """The model of the documents' text; a round samples every block's seating with the others as the last round left them.

    Each word follows its context once as often as the context stands, so a context has as many customers as the word
    has. In a round blocks tell the parts of their contexts how many customers have joined a table, and are told
    the tables that leaves; lone customers, which never join one, need not be told.
    """
    pairs = counts(docs, deal)
    h, q = len(deal.words), len(deal.pairs)
    v = gathered(pairs)
    v = np.zeros(8 + 3 * h + 2 * q) if v is None else v
    one, two, word_one, word_two, near, total, distinct, lone = v[:8]
    hot_counts, hot_contexts, hot_joined = v[8 : 8 + 3 * h].reshape(3, h)
    pair_counts, pair_lone = v[8 + 3 * h :].reshape(2, q)
    size = near + (hot_counts > 0).sum()
    usual = lambda a, b: float(np.clip(a / (a + 2 * b) if a + b else 0.5, 0.05, 0.95))
    world = World(usual(one, two), usual(word_one, word_two), float(distinct), float(size), float(size + 1), np.zeros(0), hot_counts - hot_joined)
    less = hot_contexts - world.root_discount * _hot_root(hot_contexts, deal.words, world.root_fresh, world.root_discount) if h else np.zeros(0)
    world = replace(world, hot=world.root(np.where(hot_counts > 0, less, 0.0)))
    words, told = pairs.filter(F.col("kind") == WORDS), pairs.filter(F.col("kind") == TOLD)
    for turn in range(rounds):
        last = turn == rounds - 1
        live = pairs.filter(F.col("kind") == LIVE).withColumns({"sums": F.lit(None).cast("binary")} | ({} if last else {"rest": F.lit(None).cast("binary")}))
        tables = words.unionByName(told).repartitionById(deal.parts, F.col("part")).mapInArrow(_context_tables, ROW)
        rows = live.unionByName(tables).repartitionById(deal.parts, F.col("part"))
        found, before = cut(rows.mapInArrow(_sampled(deal, world, last), ROW), "seating"), (found if turn else None)
        if before is not None:
            discard(before)
        told = found.filter(F.col("kind") == TOLD)
        v = gathered(found)
        v = np.zeros(SAMPLES * (2 + 2 * h) + q) if v is None else v
        by = v[: SAMPLES * (2 + 2 * h)].reshape(SAMPLES, -1)
        root, hot_root, hot_joined = by[:, :2] + lone, by[:, 2 : 2 + h], by[:, 2 + h :]
        hot_tables = np.array([_hot_root(c, deal.words, world.root_fresh, world.root_discount) for c in hot_root]) if h else np.zeros((SAMPLES, 0))
        hot_tables = np.where(hot_counts > 0, hot_tables, 0.0)
        root = root + np.stack([hot_root.sum(axis=1), hot_tables.sum(axis=1)], axis=1)
        hot_less = hot_root - world.root_discount * hot_tables
        if not last:
            mean = root.mean(axis=0)
            world = replace(world, root_customers=float(mean[0]), root_tables=float(mean[1]), hot_tables=hot_counts - hot_joined.mean(axis=0))
            world = replace(world, hot=world.root(hot_less.mean(axis=0)))
    discard(pairs)
    pair_tables = v[SAMPLES * (2 + 2 * h) :] / SAMPLES + pair_lone
    return Model(
        deal, world.discount, STRENGTH + root[:, 0], (STRENGTH + world.root_discount * root[:, 1]) / (size + 1), float(total), float(size), hot_counts, np.ascontiguousarray(hot_less.T),
        np.ascontiguousarray((hot_counts - hot_joined).T), pair_counts - world.discount * pair_tables, found.filter(F.col("kind") == SEATED).select("part", F.col("body").alias("block")), told.select("part", F.col("body").alias("block")),
    )


# --- scoring ---------------------------------------------------------------------------------

KNOWN, CONTEXTS, ASKED, ANSWERED, TEXTS = 1, 2, 3, 4, 5
REQUEST = "<u8 <u8"  # words, hashes of pairs
ANSWER = "<u8 <f4 <f4 <f4"  # each word's customers, root customers less discounts and tables as a context by sample; each pair's customers less discounts
#: Keys and tokens of each document; entries of each pair, hot pairs first, then by part; their documents; place of each
#: pair's word (by steps) and context, hot words first, then by part; numbers of the hot words and the hot pairs; answers to come.
LAYOUT = "<i8 <u4 <u4 <u4 <i4 <u4 <u4 <u4 <u4"


def _flush_id(keys: list[tuple]) -> int:
    """A flush is known by its texts, so that it has one name wherever it is put together; of two equal ones either will do."""
    return int.from_bytes(hashlib.blake2b(np.array(keys, "<i8").tobytes(), digest_size=8).digest(), "little", signed=True)


def _entries(tok: np.ndarray, each: np.ndarray):
    """Words; of each distinct pair the numbers of its word and context and how often it stands; of each time the document."""
    words, w, c = _coded(tok)
    doc = np.repeat(np.arange(len(each)), each)
    wide, deep = len(words).bit_length(), len(each).bit_length()
    if 2 * wide + deep <= WIDE:
        key = np.sort((w << (wide + deep)) | (c << deep) | doc)
        pair, doc = key >> deep, key & ((1 << deep) - 1)
        w, c = pair >> wide, pair & ((1 << wide) - 1)
    else:  # a text of very many words
        order = np.lexsort((doc, c, w))
        w, c, doc = w[order], c[order], doc[order]
    first = np.flatnonzero((np.diff(w, prepend=-1) != 0) | (np.diff(c, prepend=-1) != 0))
    return words, w[first], c[first], np.diff(np.append(first, len(w))), doc


def _asked(deal: Plan):
    """A flush's distinct words and pairs, for the parts that hold them; and which document has which, as the answers lie."""

    def run(batches):
        for tok, _, each, found in flushes(batches, ("a", "b")):
            words, w, c, times, doc = _entries(tok, each)
            keys, hot = pair_hash(words[w], words[c]), deal.among(words)
            hot_pair = np.full(len(w), -1)
            near = np.flatnonzero(hot[w] >= 0)
            hot_pair[near] = _found(deal.pairs, keys[near])
            home, part = np.where(hot >= 0, -1, deal.home(words)), deal.route(words, w, keys)
            part[hot_pair >= 0] = -1
            stands, order, lies = _dealt(home), _dealt(part), _dealt(np.repeat(part, times))
            own, of = {p: at for p, at in _by_part(home, stands) if p >= 0}, {p: at for p, at in _by_part(part, order) if p >= 0}
            none, flush = np.zeros(0, np.int64), _flush_id(found)
            rows = [(p, flush, ASKED, pack(words[own.get(p, none)], keys[of.get(p, none)])) for p in sorted(own.keys() | of.keys())]
            place = np.empty(len(words), np.int64)
            place[stands] = np.arange(len(words))
            steps = np.diff(place[w[order]], prepend=0)
            block = pack(
                np.array(found, "<i8").ravel(), each.astype("<u4"), times[order].astype("<u4"), doc[lies].astype("<u4"), steps.astype("<i4"), place[c[order]].astype("<u4"),
                hot[hot >= 0].astype("<u4"), hot_pair[order][: (hot_pair >= 0).sum()].astype("<u4"), np.array([len(rows)], "<u4"),
            )
            yield _messages([*rows, (flush % deal.parts, flush, TEXTS, block)])

    return run


MESSAGE = "part int, flush long, kind int, block binary"


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "flush", "kind", "block"])


class Lookup:
    """One part's words and pairs, for requests to be found in."""

    def __init__(self, blocks: list[list[np.ndarray]], deal: Plan, discount: float, hot_counts: np.ndarray, hot_less: np.ndarray, told: tuple = ()):
        samples = hot_less.shape[1]
        words, held, n, keys, tables, less = (np.concatenate([np.zeros(0, k), *(b[i] for b in blocks)]) for i, k in enumerate(MODEL.split()))
        blocks.clear()
        self.deal, self.hot_counts, self.hot_less = deal, hot_counts, hot_less
        self.words, of = np.unique(words, return_inverse=True)
        self.n = np.append(np.bincount(of, held.astype(np.float64), len(self.words)).astype(np.uint64), _U(0))
        self.less = np.zeros((len(self.words) + 1, samples))  # the last: no word that was seen
        self.less[of] = less.reshape(-1, samples)
        self.joined = np.zeros((len(self.words) + 1, samples))
        if told:
            at, joined = _found(self.words, np.concatenate([c for c, _ in told])), np.concatenate([j for _, j in told]).reshape(-1, samples)
            self.joined = np.stack([np.bincount(at, joined[:, s], len(self.words) + 1) for s in range(samples)], axis=1)
        order = np.argsort(keys)
        self.keys, self.direct = keys[order], np.append((n - discount * tables / samples)[order], 0.0)

    def known(self, words) -> tuple[np.ndarray, ...]:
        """Customers, root customers less discounts and tables as a context (by sample) of words that are not hot."""
        at = _found(self.words, words)
        return self.n[at], self.less[at], self.n[at][:, None] - self.joined[at]

    def pairs(self, keys) -> np.ndarray:
        return self.direct[_found(self.keys, keys)]

    def find(self, words, many, contexts) -> tuple[np.ndarray, ...]:
        """Words' customers and root customers less discounts, and the pairs' with contexts, `many` of each word; any may be hot."""
        n, less, _ = self.known(words)
        hot = self.deal.among(words)  # a hot word lies in many parts, its sums in the model
        far = hot >= 0
        n[far], less[far] = self.hot_counts[hot[far]].astype(np.uint64), self.hot_less[hot[far]]
        return n, less, self.pairs(pair_hash(np.repeat(words, many), contexts))


def _answered(model: Model):
    """The requests of each part answered from its blocks of the model; texts pass."""
    known = (model.deal, model.discount, model.hot_counts, model.hot_less)

    def run(batches):
        table, told, waiting = {}, {}, {}
        for rb in batches:
            for part, flush, kind, raw in zip(*[rb.column(c).to_pylist() for c in ("part", "flush", "kind", "block")], strict=True):
                if kind == TEXTS:
                    yield _messages([(part, flush, kind, raw)])
                else:
                    {KNOWN: table, CONTEXTS: told, ASKED: waiting}[kind].setdefault(part, []).append((flush, raw))
        for part in sorted(waiting):
            lookup = Lookup([unpack(raw, MODEL) for _, raw in table.pop(part, [])], *known, tuple(unpack(raw, "<u8 <f8") for _, raw in told.pop(part, [])))
            for flush, raw in waiting.pop(part):
                words, keys = unpack(raw, REQUEST)
                n, less, tables = lookup.known(words)
                yield _messages([(part, flush, ANSWERED, pack(n, less.ravel().astype("<f4"), tables.ravel().astype("<f4"), lookup.pairs(keys).astype("<f4")))])

    return run


def _summed_up(model: Model):
    """The documents of each flush, once all its answers are there; TEXTS say how many they wait for."""

    def run(batches):
        texts, answers = {}, {}
        for rb in batches:
            for part, flush, kind, raw in zip(*[rb.column(c).to_pylist() for c in ("part", "flush", "kind", "block")], strict=True):
                if kind == TEXTS:
                    texts[flush] = raw
                else:
                    answers.setdefault(flush, {})[part] = raw
        if answers.keys() - texts.keys():
            raise RuntimeError("answers without their texts: the documents were not read as before")
        for flush in list(texts):
            own = answers.pop(flush, {})
            keys, each, times, doc, w, c, hot_word, hot, asked = unpack(texts.pop(flush), LAYOUT)
            if len(own) != asked[0]:
                raise RuntimeError(f"{len(own)} answers of {asked[0]}: the documents were not read as before")
            samples = len(model.fresh)
            n, less, tables, direct = [model.hot_counts[hot_word]], [model.hot_less[hot_word]], [model.hot_tables[hot_word]], [model.hot_pairs[hot]]
            for _, answer in sorted(own.items()):
                found = unpack(answer, ANSWER)
                n.append(found[0].astype(np.float64))
                less.append(found[1].reshape(-1, samples).astype(np.float64))
                tables.append(found[2].reshape(-1, samples).astype(np.float64))
                direct.append(found[3].astype(np.float64))
            n, w, times = np.concatenate(n), np.cumsum(w), times.astype(np.int64)
            logs = np.log10(model.predictive(np.concatenate(direct), c, model.root(np.concatenate(less))[w], n, np.concatenate(tables)))
            of = lambda x, doc=doc, times=times, size=len(each): np.bincount(doc, np.repeat(x, times), size)
            keys = keys.reshape(-1, 2)
            known = pa.array(of(n[w] > 0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(of(logs)), pa.array(of(model.base(n)[w])), known, pa.array(each.astype(np.int64))], names=["a", "b", "score", "base", "n_known", "n_tokens"])

    return run


def score(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words between ASCII white space, A-Z lower-cased, then one END. The model is a hierarchical
    Pitman-Yor process of bigrams: a restaurant for each context (the previous token) over one shared root, whose base is
    uniform over the V known tokens and one unknown. Seating is sampled by Gibbs (`chain`); score sums log10 of the
    predictive probabilities, which are averaged over the samples. Discounts come from the counts of counts.

    Words are dealt by hash, so all pairs that end with a word lie together, and what is known of it as a context lies
    beside it; hot words are dealt by word and context, and their sums are vectors of fixed size. To score, each FLUSH of
    tokens asks the parts once for its distinct words and pairs (hot ones are known everywhere) and sums its texts when the
    answers are back: what is shuffled follows the tokens, however many parts there are. Words are told apart by 64-bit
    hashes, pairs by 64-bit hashes of both.

    Folds: crc32 of the id's text mod 7; 2 is held out, a null id is learned from. A null text is empty: one token.
    Repeated rows are learned from each, and equal texts have equal scores. With nothing to learn from all tokens are
    unknown. An empty table gives an empty result; further columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0)) == 2
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty().alias("text"))
    slim = slim.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(7), "text")})
    deal = plan(slim)
    model = fit(slim.filter("not held_out"), deal, rounds)
    bare = replace(model, blocks=None, told=None)
    known = [rows.select("part", F.lit(0).cast("long").alias("flush"), F.lit(kind).alias("kind"), "block") for rows, kind in ((model.blocks, KNOWN), (model.told, CONTEXTS))]
    sums = None
    for go in range(deal.goes):
        texts = slim.select("text", "a", "b")
        texts = texts.filter(F.pmod("a", F.lit(deal.goes)) == go) if deal.goes > 1 else texts
        rows = known[0].unionByName(known[1]).unionByName(texts.mapInArrow(_asked(deal), MESSAGE))
        rows = rows.repartitionById(deal.parts, F.col("part")).mapInArrow(_answered(bare), MESSAGE)
        rows = rows.repartitionById(deal.parts, F.pmod("flush", F.lit(deal.parts)).cast("int"))
        rows = rows.mapInArrow(_summed_up(bare), "a long, b long, score double, base double, n_known long, n_tokens long")
        rows = cut(rows, "scores") if deal.goes > 1 else rows
        sums = rows if sums is None else sums.unionByName(rows)
    # a text that several flushes hold has the same row from each
    sums = sums.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("score", "base", "n_known", "n_tokens")])
    out = join_spread(slim.select("doc_id", "held_out", "a", "b"), sums, ["a", "b"], F.coalesce("doc_id", F.lit(0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
