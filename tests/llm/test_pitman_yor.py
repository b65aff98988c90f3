"""Language-model scores: counts against plain Python, seating against the exact distribution, probabilities that sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import pitman_yor as py
from hirelake.llm.common import documents

from .helpers import DOCS, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def plain_tokens(text):
    return [w.encode("utf-8", "surrogatepass").lower() for w in WORD.findall(text or "")] + [None]


def plain(rows):
    count = Counter()
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update(plain_tokens(r.text))
    n, v = sum(count.values()), len(count)
    out = []
    for r in rows:
        t = plain_tokens(r.text)
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
        out.append((str(r.doc_id), held, len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 5)))
    return sorted(out)


def digest(got):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)


def test_counts_and_base_scores(spark):
    docs = documents(spark, SMALL)
    got = py.score(docs).collect()
    assert digest(got) == plain(docs.collect())
    held = [r for r in got if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.3  # contexts and sharing help on unseen texts
    assert all(r.score <= 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("score", F.lit("clash")).withColumn("a", F.lit(1))
    got = py.score(docs).collect()
    assert digest(got) == plain(docs.collect())
    by_text = {}
    for r in got:
        by_text.setdefault((r.n_tokens, r.base_score), set()).add(round(r.score, 9))
    assert all(len(v) == 1 for v in by_text.values())
    assert py.score(empty(spark)).collect() == []
    none = spark.createDataFrame([(i, f"Word{i} z", "en", "s", 7) for i in range(1, 60) if zlib.crc32(str(i).encode()) % 7 == 2], DOCS)
    got = py.score(none).collect()  # nothing to learn from
    assert digest(got) == plain(none.collect()) and all(r.score == pytest.approx(0) for r in got)


def test_the_same_whatever_the_parts_flushes_and_hot_words(spark, monkeypatch):
    """Hot words dealt by context, hot pairs scored where they are read, texts that several flushes hold."""
    docs = documents(spark, SMALL).filter("doc_id % 3 = 0")
    docs = docs.unionByName(docs.filter("doc_id % 2 = 0")).repartition(3)
    one = {(r.doc_id, r.n_tokens): r for r in py.score(docs).collect()}
    plain_plan = py.plan
    monkeypatch.setattr(py, "plan", lambda d: py.Plan(29, np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    none_hot = {(r.doc_id, r.n_tokens): r for r in py.score(docs).collect()}
    deal = plain_plan(docs)
    assert len(deal.words) > 10 and len(deal.pairs) > 3
    assert one.keys() == none_hot.keys()
    for k, r in one.items():
        assert (r.n_known, r.train_tokens) == (none_hot[k].n_known, none_hot[k].train_tokens)
        assert r.base_score == pytest.approx(none_hot[k].base_score) and r.score == pytest.approx(none_hot[k].score, rel=0.02)


def test_probabilities_sum_to_one(spark):
    docs = documents(spark, SMALL).filter("doc_id < 60")
    deal = py.plan(docs)
    model = py.fit(docs, deal)
    blocks = [py.unpack(r.block, py.MODEL) for r in model.blocks.collect()]
    lookup = py.Lookup(list(blocks), deal, model.discount, model.hot_counts, model.hot_less)
    words = lookup.words
    assert len(words) == model.distinct
    for g in {int(x) for x in np.concatenate([b[2] for b in blocks])[:2000:100]} | {12345}:
        n, less, direct = lookup.find(np.append(words, np.uint64(3)), np.ones(len(words) + 1, np.int64), np.full(len(words) + 1, g, "<u2"))
        assert n[-1] == 0 and (n[:-1] > 0).all()
        assert model.predictive(direct, np.full(len(n), g), model.root(less)).sum() == pytest.approx(1, abs=1e-9)


def stirling(c, d):
    """Generalised Stirling numbers S(c, 1..c): ways to seat c customers at t tables, each weighted by its sizes."""
    s = np.zeros((c + 1, c + 1))
    s[1, 1] = 1
    for n in range(1, c):
        for t in range(1, n + 2):
            s[n + 1, t] = s[n, t - 1] + (n - t * d) * s[n, t]
    return s[c]


@pytest.mark.parametrize("c, d, fresh", [(2, 0.5, 0.8), (7, 0.3, 1.5), (12, 0.8, 0.2)])
def test_gibbs_draws_from_the_posterior(c, d, fresh):
    """Many equal restaurants: the share with t tables is that of fresh**t * S(c, t)."""
    n, rng = 20_000, np.random.default_rng(3)
    seats = py.Seating(np.full(n, c), np.full(n, fresh), d, lambda turn, at: rng.random(len(at)))
    for _ in range(20 * c):
        seats.leave(np.ones(n, np.int64), rng.random(n))
        seats.enter(np.ones(n, np.int64), np.full(n, fresh), rng.random(n), rng.random(n))
        assert (np.bincount(seats.owner, seats.size) == c).all() and (seats.size > 0).all()
    want = fresh ** np.arange(c + 1) * stirling(c, d)
    got = np.bincount(seats.tables, minlength=c + 1) / n
    assert np.abs(got - want / want.sum()).max() < 0.015


def test_many_customers_sit_and_leave_whole():
    rng = np.random.default_rng(4)
    customers = np.array([1, 5, 10**9, 300, 16])
    seats = py.Seating(customers, np.array([0.5, 2.0, 40.0, 3.0, 0.1]), 0.6, lambda turn, at: rng.random(len(at)))
    assert (np.bincount(seats.owner, seats.size) == customers).all()
    k = np.array([0, 4, 1000, 299, 15])
    lost = seats.leave(k, rng.random(5))
    assert (seats.customers == customers - k).all() and (np.bincount(seats.owner, seats.size) == seats.customers).all() and (lost >= 0).all()
    seats.enter(k, np.ones(5), rng.random(5), rng.random(5))
    assert (np.bincount(seats.owner, seats.size) == customers).all()


def test_tokens_of_long_and_strange_texts():
    texts = ["", " a\tB\x0bc ", "ÄB x \U0001f600", "w" * 3_000_000, "wort " * 400_000]
    tok, n = py.tokens(texts)
    assert n.tolist() == [len(plain_tokens(t)) for t in texts]
    names = {}
    for t, w in zip([x for text in texts for x in plain_tokens(text)], tok.tolist(), strict=True):
        assert names.setdefault(t, w) == w
    assert len(set(names.values())) == len(names)


def test_every_word_is_a_context_of_its_own(spark):
    """Two words whose hashes begin with the same 16 bits are followed by different words: neither learns from the other."""
    words, seen = [f"context{i}" for i in range(3000)], {}
    for word, h in zip(words, py.tokens([" ".join(words)])[0].tolist(), strict=False):
        one, other = seen.setdefault(h >> 48, word), word
        if one != other:
            break
    learned = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, f"{one} apple" if n % 2 else f"{other} pear", "en", "s", 7) for n, i in enumerate(learned)]
    rows += [(i, f"{a} {b}", "en", "s", 7) for i, (a, b) in zip(held, [(one, "apple"), (one, "pear"), (other, "pear"), (other, "apple")], strict=True)]
    got = {r.doc_id: r.score for r in py.score(spark.createDataFrame(rows, DOCS)).collect()}
    for right, wrong in (held[:2], held[2:]):
        assert got[right] > got[wrong] + 1


@pytest.mark.parametrize("hot", [True, False])
def test_contexts_hold_their_followers_and_sum_to_one(spark, monkeypatch, hot):
    """Customers of each context against plain Python; tables between the distinct followers and one; probabilities after seen contexts."""
    monkeypatch.setattr(py, "BLOCK", 500)  # many blocks tell one part
    docs = documents(spark, SMALL).filter("doc_id < 60")
    deal = py.plan(docs)
    deal = deal if hot else py.Plan(7, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    model = py.fit(docs, deal)
    blocks = [py.unpack(r.block, py.MODEL) for r in model.blocks.collect()]
    told = tuple(py.unpack(r.block, "<u8 <f8") for r in model.told.collect())
    lookup = py.Lookup(blocks, deal, model.discount, model.hot_counts, model.hot_less, told)
    words = lookup.words
    n, _, tables = lookup.known(words)
    at = deal.among(words)
    n[at >= 0], tables[at >= 0] = model.hot_counts[at[at >= 0]].astype(np.uint64), model.hot_tables[at[at >= 0]]
    followers = {}
    for r in docs.collect():
        tok = [int(x) for x in py.tokens([r.text or ""])[0]]
        for a, b in zip([int(py.END), *tok], tok, strict=False):
            followers.setdefault(a, Counter())[b] += 1
    assert {int(w): int(k) for w, k in zip(words, n, strict=True)} == {w: sum(f.values()) for w, f in followers.items()}
    most = np.array([sum(followers[int(w)].values()) for w in words])
    least = np.array([len(followers[int(w)]) for w in words])
    assert (tables <= most[:, None]).all() and (tables >= least[:, None]).all() and (tables.mean(axis=1) > least).any()
    every = np.append(words, np.uint64(3))  # and one word that was not seen
    for c in np.flatnonzero(np.isin(words, sorted(followers, key=lambda w: -sum(followers[w].values()))[:20])).tolist() + list(range(0, len(words), 400)):
        _, less, direct = lookup.find(every, np.ones(len(every), np.int64), np.full(len(every), words[c]))
        assert (direct > 0).sum() == len(followers[int(words[c])])
        total = model.predictive(direct, np.full(len(every), c), model.root(less), n.astype(np.float64), tables).sum()
        assert total == pytest.approx(1, abs=1e-9)


def test_words_of_a_very_long_text_are_told_apart(monkeypatch):
    """Pairs and their documents, whether or not their numbers fit one key."""
    rng = np.random.default_rng(5)
    each = np.array([5, 1, 40, 30])
    tok = rng.integers(1, 9, each.sum()).astype(np.uint64)
    tok[np.cumsum(each) - 1] = py.END
    words, w, c, times, doc = py._entries(tok, each)
    got = sorted(zip(np.repeat(words[w], times).tolist(), np.repeat(words[c], times).tolist(), doc.tolist(), strict=True))
    want = sorted(zip(tok.tolist(), py.context(tok).tolist(), np.repeat(np.arange(4), each).tolist(), strict=True))
    assert got == want and (np.diff(w * 100 + c) > 0).all()
    monkeypatch.setattr(py, "WIDE", 8)
    assert all((a == b).all() for a, b in zip(py._entries(tok, each), (words, w, c, times, doc), strict=True))


def test_texts_in_several_goes(spark, monkeypatch):
    docs = documents(spark, SMALL).filter("doc_id % 4 = 0")
    docs = docs.unionByName(docs.filter("doc_id % 8 = 0"))
    one = sorted(map(tuple, py.score(docs).collect()))
    monkeypatch.setattr(py, "ONE_GO", 1)
    assert py.plan(docs).goes == py.GOES
    got = sorted(map(tuple, py.score(docs).collect()))
    assert len(got) == len(one)
    for a, b in zip(got, one, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)
