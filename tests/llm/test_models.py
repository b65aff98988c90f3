"""Language, personal data, duplicates, embeddings, toxicity and tokens against plain Python and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hirelake.llm import embedding_links, jaccard_join, language, pieces, pii, toxicity
from hirelake.llm.common import digest, shingles, word_hashes
from hirelake.llm.graph import components

from .helpers import DOCS, awkward, empty, read

SF = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


# --- hashing and graph -----------------------------------------------------------------------


def test_word_hashes_follow_the_words(monkeypatch):
    from hirelake.llm import common

    text = "Über den  wort\n\tÜBER x " * 9
    h = word_hashes(text)
    words = text.lower().split()
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    monkeypatch.setattr(common, "_CHUNK", 7)
    assert (common.word_hashes(text) == h).all()
    assert len(word_hashes(None)) == len(word_hashes(" \n")) == 0
    assert len(shingles(h[:3])) == 1 and digest(h) != digest(h[:-1])


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


# --- near duplicates -------------------------------------------------------------------------


def python_sets(rows):
    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    return [sh(t) for t in rows]


def python_links(rows, threshold=0.8):
    sets = python_sets(rows)
    holders, both = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        both.update((a, b) for k, a in enumerate(h) for b in h[k + 1 :])
    links = defaultdict(set)
    for (a, b), n in both.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    return links


def planted(n=60, seed=5):
    """Families of near copies at similarities on both sides of the threshold, beside exact copies and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(30, 120))]
        texts.append(" ".join(base))
        for k in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(k):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    return texts


@pytest.mark.parametrize("sizes", [{}, {"bucket": 3, "block": 2}])
def test_jaccard_links_against_python(spark, sizes):
    texts = planted() + [r.text for r in read(spark, "documents").collect()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs, **sizes).collect()}
    links = python_links(texts)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        same, queue = {i}, [i]
        while queue:
            for y in links[queue.pop()]:
                if y not in same:
                    same.add(y)
                    queue.append(y)
        assert (got[i].n_links, got[i].class_id, got[i].kept) == (len(links[i]), min(same), i == min(same)), i
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(docs).collect())
    assert kept == sorted(i for i in got if got[i].kept)


def test_pruning_bars_keep_true_pairs():
    bars = jaccard_join.least_matches(0.8, 1e-6, (16, 32, 48, 64))
    assert [n for n, _ in bars] == [16, 32, 48, 64] and all(0 < k < 0.8 * n for n, k in bars)
    rng = np.random.default_rng(0)
    hits = (rng.random((20_000, 64)) < 0.8).cumsum(axis=1)
    assert all((hits[:, n - 1] >= k).mean() > 0.9999 for n, k in bars)
    low = (rng.random((20_000, 64)) < 0.3).cumsum(axis=1)
    assert (low[:, 63] >= bars[-1][1]).mean() < 0.01


def test_jaccard_awkward(spark):
    docs = awkward(spark)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_links == 2 and by[1].class_id == 1
    assert {by[2].class_id, by[3].class_id, by[5].class_id} == {2}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6]
    assert jaccard_join.near_duplicates(empty(spark)).collect() == [] and jaccard_join.keep_one(empty(spark)).collect() == []


def test_jaccard_one_id_on_several_texts(spark):
    """Id 7 stands on eight texts, each with a near copy; in half the pairs the copy has the lesser id."""
    rng = random.Random(3)
    rows, want = [], []
    for i in range(8):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
        other = i if i < 4 else 20 + i
        rows += [(7, " ".join(words), "en", "s", 1), (other, " ".join(words[:-1] + ["changed"]), "en", "s", 1)]
        want.append((min(7, other), rows[-2 if other > 7 else -1][1]))
    docs = spark.createDataFrame(rows, DOCS)
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((d, c, 1) for i, (c, _) in enumerate(want) for d in (rows[2 * i][0], rows[2 * i + 1][0]))
    assert sorted((r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()) == sorted(want)


# --- embeddings ------------------------------------------------------------------------------


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 64))
    near = np.concatenate([v[:40] + rng.standard_normal((40, 64)) * s for s in (0.05, 0.3, 0.45, 0.5)])
    v = np.concatenate([v, near, v[:3], v[:2] * 7]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    bad = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] + [1.0] * 63, 1), (904, [], 1), (905, [1.0, 0.0], 1), (906, [float("inf")] * 64, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    d = v.astype(np.float64)
    unit = d / np.linalg.norm(d, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert embedding_links.plan_bands(len(rows), 0.9, 1e-5, 1)[0] == 9
    for sizes in ({}, {"block": 8}, {"bucket": 1}):
        got = {r.vec_id: r for r in embedding_links.linked(df, **sizes).collect()}
        assert len(got) == len(rows) + len(bad)
        assert [got[i].n_links for i in range(len(v))] == linked.sum(axis=1).tolist()
        for i in range(len(v)):
            same, queue = {i}, [i]
            while queue:
                for y in np.flatnonzero(linked[queue.pop()]).tolist():
                    if y not in same:
                        same.add(y)
                        queue.append(y)
            assert got[i].component_id == min(same) and got[i].kept == (min(same) == i)
        assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 907))


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((2000, 64))
    b = a + rng.standard_normal((2000, 64)) * 0.8
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    bits, corr = embedding_links.codes(a)
    turned = b @ embedding_links.rotation(64)
    near, step, lost = embedding_links.quantised(turned)
    true = a @ b.T
    for coordinates, short in ((turned, np.zeros(2000)), (near * step[:, None], lost)):
        guess, error = embedding_links.estimate(bits, corr, coordinates, short, 5.0)
        assert abs((guess - true).mean()) < 0.01 and (np.abs(guess - true) <= error).mean() > 0.9999
    assert (np.abs(near * step[:, None] - turned) <= step[:, None] * 0.5 + 1e-12).all() and lost.max() < 0.03


def test_links_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_links.linked(none).collect() == []


# --- language --------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = read(spark, "documents", SF)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == (fold(r.doc_id) == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_proportions(spark):
    docs = read(spark, "documents", SF)
    model = language.fit(docs)
    one = {r.lang: r.text for r in docs.collect() if fold(r.doc_id) == 1 and 1500 < len(r.text) < 4000}
    half = one["de"][:1200] + " " + one["fr"][:1200]
    (name, score, share), (single, sure, pure), nothing = language.infer([half, one["es"], " 12 !?"], model)
    found = dict(zip(model.langs, share, strict=True))
    assert abs(found["de"] - 0.5) < 0.15 and abs(found["fr"] - 0.5) < 0.15 and found["es"] == 0 and name in ("de", "fr") and score < 0.7
    assert single == "es" and sure > 0.99 and max(pure) == 1.0
    assert nothing[:2] == ("und", 0.0)


def test_mixture_sets_against_enumeration(spark):
    """Every set of languages tried with a plain EM; the greedy choice must find the set of best penalised likelihood."""
    import inspect
    from itertools import combinations

    docs = read(spark, "documents", SF)
    model = language.fit(docs)
    penalty = inspect.signature(language.infer).parameters["penalty"].default
    rng = random.Random(8)
    by = defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        if fold(r.doc_id) == 1 and len(r.text) > 400:
            by[r.lang].append(r.text)
    texts = []
    for _ in range(60):
        langs = rng.sample(model.langs, rng.randint(1, 3))
        texts.append(" ".join(" ".join(rng.choice(by[x]).split()[: rng.randint(20, 120)]) for x in langs))
    agree = 0
    for text, (_, _, share) in zip(texts, language.infer(texts, model), strict=True):
        logs = language.unit_likelihoods([text], model)[0].astype(float)
        n, best = len(logs), (-np.inf, None, None)
        for k in range(1, len(model.langs) + 1):
            for some in combinations(range(len(model.langs)), k):
                like, p = np.exp(logs[:, some] - logs.max(axis=1, keepdims=True)), np.full(k, 1 / k)
                for _ in range(200):
                    r = like * p
                    p = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
                total = np.log((like * p).sum(axis=1)).sum() - (k - 1) * (penalty + 0.5 * np.log(n))
                best = max(best, (total, some, p), key=lambda x: x[0])
        chosen = tuple(i for i, s in enumerate(share) if s > 0)
        if chosen == best[1]:
            agree += 1
            assert np.abs(np.array(share)[list(chosen)] - best[2]).max() < 0.03
    assert agree >= 57, agree


def test_pieces_of_a_text_do_not_matter(spark, monkeypatch):
    docs = read(spark, "documents", SF)
    model = language.fit(docs)
    texts = [r.text for r in docs.limit(20).collect()]
    whole = [x[:1] for x in language.infer(texts, model)]
    monkeypatch.setattr(language, "PIECE", 500)
    assert [x[:1] for x in language.infer(texts, model)] == whole


def test_language_awkward(spark):
    docs = awkward(spark)
    got = language.identify(docs).collect()
    assert len(got) == 9
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 5))
    assert language.identify(empty(spark)).collect() == []
    kept = language.accept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None, 4, 6}


# --- personal data ---------------------------------------------------------------------------

PII = [
    (1, "mail a.b@c-d.example.com, ip 10.0.0.255 not 10.0.0.256", 0),
    (2, "card 4111 1111 1111 1111 and 4111-1111-1111-1112", 0),
    (3, "\U0001f600 call +1 (743) 555-3824 now; or (743) 555-3824 later", 0),
    (4, "1.2.3.4.5.6.7.8 a@b a@b.c@d.e +12345", 0),
    (5, None, 0),
    (6, "plain words without any number", 0),
    (7, "v1.2.30 on 2024-01-12 at 10:30 cost 120.50, #1234", 0),
]


def python_pii(text):
    out = []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def test_pii_against_python(spark):
    docs = read(spark, "documents", SF).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-i, t) for i, t, _ in PII], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for r in docs.collect():
        base, g = python_pii(r.text or ""), got[r.doc_id]
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert g.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (r.text, line)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert set(line.split(",")) - {""} <= set(g.spans.split(","))
    assert "phone:33:47" in got[-3].spans and got[-3].n_added == 1
    assert got[-6].spans == "" and got[-7].spans == ""


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    text = "+1 (743) 555-3824 12"
    lat = pii.Lattice(text, 0, len(text))
    w = rng.standard_normal((len(pii.KINDS), len(pii.FEATURES)))
    s = lat.scores(w)

    def paths(i):
        if i == len(lat.tokens):
            yield [], 0.0
        for k in range(1, min(pii.LONGEST, len(lat.tokens) - i) + 1):
            for t in range(s.shape[1]):
                if np.isfinite(s[lat.rows[i, k], t]):
                    for rest, z in paths(i + k):
                        yield [(lat.rows[i, k], t), *rest], z + s[lat.rows[i, k], t]

    every = list(paths(0))
    z = np.logaddexp.reduce([x for _, x in every])
    p, total = lat.marginals(s)
    assert total == pytest.approx(z)
    want = np.zeros_like(s)
    for path, x in every:
        for r, t in path:
            want[r, t] += np.exp(x - z)
    assert np.allclose(p, want)
    best = max(every, key=lambda x: x[1])[0]
    assert [(r, t) for _, _, t, r in lat.best(s)] == [(r, t) for r, t in best if t < len(pii.KINDS)]


def test_spelled_addresses_without_digits(spark):
    texts = ["write jane.roe[at]sample.net soon", "write mary [at] sample [dot] org soon", "write bob(at)firm.example.com, please", "come home (at) once or ask [dot] there"]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "email:6:28", 1: "email:6:32", 2: "email:6:29", 3: ""}


def test_stretches_change_nothing():
    weights = pii.train(pii.made_examples(n=60), rounds=40)
    text = " ".join(["12"] * 399 + ["(555)", "555-1234"] + ["17"] * 420 + ["(743)", "555-3824", "5"])
    lat = pii.Lattice(text, 0, len(text))
    s = lat.scores(weights)
    p, _z = lat.marginals(s)
    want = [(*lat.bounds[i, k], t, p[r, t]) for i, k, t, r in lat.best(s)]
    for size in (7, 400, 10_000):
        got = pii.decode(text, 0, len(text), weights, size)
        assert [(a, b, t) for a, t, b, _ in got] == [x[:3] for x in want]
        assert np.allclose([x[3] for x in got], [x[3] for x in want])
    at = text.index("(555)")
    assert (at, at + 14) in [x[:2] for x in want]


def test_pii_added_spans_held_out(spark):
    """Precision and recall of the spans that the patterns miss, on made text of another seed and planted in the corpus."""
    docs = read(spark, "documents", SF)
    weights = pii.fit(docs)

    def measure(cases):
        hits = made = wanted = 0
        for text, spans in cases:
            base = pii.base_spans(text)
            want = {s for s in spans if not any(a < s[2] and b > s[0] for a, _, b in base)}
            got = set(pii.added_spans(text, base, weights))
            hits, made, wanted = hits + len(want & got), made + len(got), wanted + len(want)
        return hits / max(1, made), hits / max(1, wanted), wanted

    precision, recall, n = measure(pii.made_examples(seed=99, n=300))
    assert n > 150 and precision >= 0.9 and recall >= 0.9, (precision, recall, n)
    rng = random.Random(4)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    cases = []
    for r in docs.orderBy("doc_id").limit(300).collect():
        words = r.text.split(" ")
        if len(words) < 20 or pii.zones(" ".join(words[:300])):
            continue
        form, kind = rng.choice([(f"({digits(3)}) 555-{digits(4)}", 3), (f"{digits(3)}-555-{digits(4)}", 3), ("kim.lee[at]mail.example.org", 0), ("kim [at] example [dot] com", 0)])
        at = rng.randrange(5, min(len(words), 300))
        start = len(" ".join(words[:at])) + 1
        cases.append((" ".join([*words[:at], form, *words[at:300]]), [(start, kind, start + len(form))]))
    precision, recall, n = measure(cases)
    assert n > 50 and precision >= 0.9 and recall >= 0.9, (precision, recall, n)


def test_pii_anywhere_in_a_long_zone():
    weights = pii.train(pii.made_examples())
    phone = "(743) 555-3824"
    for at in [*range(0, 1000, 61), *range(394, 404), 999]:
        for token in ("x9x", "12"):
            text = " ".join([token] * at + [phone] + [token] * (999 - at))
            start = at * (len(token) + 1)
            assert (start, 3, start + len(phone)) in pii.added_spans(text, pii.base_spans(text), weights), (token, at)


def test_pii_awkward(spark):
    weights = pii.train(pii.made_examples(n=40), rounds=5)
    got = pii.find(awkward(spark), weights).collect()
    assert len(got) == 9 and pii.find(empty(spark)).collect() == []
    many = " ".join(str(i) for i in range(3000))
    one = pii.find(spark.createDataFrame([(1, many)], "doc_id long, text string"), weights).first()
    assert one.n_email == 0


# --- toxicity --------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(docs, labels).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in got)
    assert hit / max(1, sum(r.predicted for r in got)) > 0.85
    assert hit / sum(truth[r.doc_id] for r in got) > 0.6


def test_swapping_identities_moves_no_score():
    rng = np.random.default_rng(0)
    groups = ["women", "men"]
    texts, y = [], []
    for i in range(400):
        bad = i % 4 == 0
        who = groups[0] if bad or rng.random() < 0.2 else groups[1]
        texts.append(f"the {who} are {'awful' if bad and rng.random() < 0.8 else 'here'} today w{i % 17}")
        y.append(float(bad))
    own = [toxicity.words(t).tolist() for t in texts]
    other = [toxicity.words(toxicity.swapped(t)).tolist() for t in texts]
    vocab = np.unique(np.concatenate([np.array(w, np.int32) for w in own]))
    gap = lambda m: abs(m.score("the women are here today") - m.score("the men are here today"))
    pairs = list(zip(own, other, strict=True))
    plain = toxicity.learn(own, pairs, np.array(y), vocab, fairness=0.0)
    fair = toxicity.learn(own, pairs, np.array(y), vocab, fairness=10.0)
    assert gap(plain) > 0.1 > 0.02 > gap(fair)
    assert fair.score("the men are awful today") > 0.7


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 1, 1), (4, 0, 0), (6, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(awkward(spark), labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score(empty(spark), labels).collect() == []
    none = toxicity.score(awkward(spark), labels.filter("false")).collect()
    assert len(none) == 9 and all(r.predicted == 0 for r in none)


def test_toxicity_against_the_plain_objective():
    """The learned weights are at the bottom of the objective, written out row by row: its gradient there is nought."""
    rng = np.random.default_rng(12)
    n, k, fairness, decay, balance = 200, 12, 1.0, 1e-2, 0.5
    vocabulary = np.arange(100, 100 + k, dtype=np.int32)
    own = [sorted(rng.choice(vocabulary, rng.integers(1, 6), replace=False).tolist()) for _ in range(n)]
    other = [sorted({*(x for x in r if x != 100), 101}) if 100 in r else None for r in own]
    y = np.array([float(rng.random() < (0.7 if 103 in r or 100 in r else 0.1)) for r in own])
    pairs = [None if s is None else (r, s) for r, s in zip(own, other, strict=True)]
    m = toxicity.learn(own, pairs, y, vocabulary, fairness, decay, rounds=4000, balance=balance)
    assert m.pairs == m.active == sum(s is not None for s in other)
    heavy = np.where(y > 0, ((1 - y.mean()) / y.mean()) ** balance, 1.0)
    heavy = heavy / heavy.mean()

    def objective(w, bias):
        z = [bias + sum(w[x - 100] for x in r) for r in own]
        loss = np.mean([h * (np.log1p(np.exp(-a)) if t else np.log1p(np.exp(a))) for h, a, t in zip(heavy, z, y, strict=True)])
        moved = [sum(w[x - 100] for x in r) - sum(w[x - 100] for x in s) for r, s in zip(own, other, strict=True) if s is not None]
        return loss + fairness * np.mean(np.square(moved)) + decay * np.sum(np.square(w))

    at = objective(m.weights, m.bias)
    for j in range(k + 1):
        for h in (1e-3, -1e-3):
            w, bias = m.weights.copy(), m.bias
            if j < k:
                w[j] += h
            else:
                bias += h
            assert objective(w, bias) >= at - 1e-7, j
    free = toxicity.learn(own, pairs, y, vocabulary, 0.0, decay, rounds=4000, balance=balance)
    gap = lambda x: abs(x.weights[0] - x.weights[1])
    assert gap(m) < 0.5 * gap(free)


def test_counterfactual_penalty_on_real_rows(spark):
    """Swapping identity terms moves the scores of held-out rows less with the penalty than without."""
    docs, labels = read(spark, "documents", SF), read(spark, "labels", SF)
    terms = spark.createDataFrame([(10_000 + i, f"the {a} people at the market said that the {a} stall is fine and good number {i}") for i, a in enumerate(["muslim", "christian", "gay", "straight"] * 30)], "doc_id long, text string")
    marks = terms.selectExpr("doc_id", "cast(null as int) as quality", "cast(text like '%muslim%' or text like '%gay%' as int) as toxic")
    both = docs.select("doc_id", "text").unionByName(terms), labels.select("doc_id", "quality", "toxic").unionByName(marks)
    change = {}
    for fairness in (0.0, 1.0):
        model = toxicity.fit(*both, fairness=fairness)
        texts = ["my muslim friend", "my gay neighbour", "a straight line", "a christian school"]
        change[fairness] = sum(abs(model.score(t) - model.score(toxicity.swapped(t))) for t in texts)
    assert change[1.0] < 0.5 * change[0.0], change


def test_the_penalty_acts_on_the_given_table(spark):
    """No document names a group: pairs come from sentences with a slot, and the scores of neutral mentions are held together."""
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    model = {f: toxicity.fit(docs, labels, fairness=f) for f in (0.0, 1.0)}
    assert model[1.0].pairs > 1000 and model[1.0].active > 100
    assert (model[0.0].vocabulary == model[1.0].vocabulary).all() and not np.allclose(model[0.0].weights, model[1.0].weights)
    moved = {f: [] for f in model}
    for r in docs.filter("doc_id % 40 = 7").collect():
        pair = toxicity.named(r.text)
        if pair:
            for f, m in model.items():
                moved[f].append(abs(m.score(pair[0]) - m.score(pair[1])))
    assert sum(moved[1.0]) < 0.5 * sum(moved[0.0])


def test_named_sentences_differ_in_the_group_alone():
    a, b = toxicity.named("Ja, der Mann sah das Haus.")
    assert a.replace("frauen", "*").replace("muslime", "*").replace("juden", "*").replace("männer", "*").replace("christen", "*").startswith("Ja, der * Mann") and a != b
    assert toxicity.named("no slot in sight") is None and toxicity.named("") is None
    assert toxicity.counterfactual("12 34", toxicity.words("12 34")) is None
    first, second = toxicity.counterfactual("my muslim friend", toxicity.words("my muslim friend"))
    assert len(first) and len(second) and not set(first) & set(second)


# --- tokens ----------------------------------------------------------------------------------


def scan(m, text, chunk):
    parts = list(pieces.split(text, m.longest, chunk))
    chunks = [pieces.Chunk(m, s, a, b, i == 0, i == len(parts) - 1) for i, (s, a, b) in enumerate(parts)]
    matrices = [c.transfer() for c in chunks]
    total = pieces.compose(matrices)
    assert len(total) == 1
    k = len(matrices) // 2
    if k:
        assert pieces.compose([pieces.compose(matrices[:k]), pieces.compose(matrices[k:])]) == total
    return [x for c, (e, f) in zip(chunks, pieces.between(matrices, *total[0][:2]), strict=True) for x in c.trace(e, f)]


def test_scan_equals_the_library():
    m = pieces.model(pieces.model_bytes())
    rng = random.Random(7)
    parts = ["ab", "the ", "   ", "tion", "é", "ß", "\n", "\U0001f600", "▁", "x1", "000", "ing", "  ", "THE", "你", "\t", "e", "s", ".", "--", "==", "\x00"]
    for _ in range(80):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 90)))
        for chunk in (1, 7, 40):
            assert scan(m, text, chunk) == m.lib.encode(text) == m.encode(text), (text, chunk)
    run = "aaaa" * 500 + "abcabc" * 300
    assert scan(m, run, 256) == m.encode(run)


def unigram_model(scores, byte_pieces=True):
    """A model file of unigram type with the given pieces and log probabilities, written out field by field."""
    import struct

    def number(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    field = lambda n, raw: number(n << 3 | 2) + number(len(raw)) + raw
    whole = lambda n, v: number(n << 3) + number(v)
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + whole(3, kind))
    rows = [piece("<unk>", 0.0, 2), piece("<s>", 0.0, 3), piece("</s>", 0.0, 3)]
    if byte_pieces:
        rows += [piece(f"<0x{b:02X}>", -30.0, 6) for b in range(256)]
    rows += [piece(p, w, 1) for p, w in scores.items()]
    trainer = whole(3, 1) + (whole(35, 1) if byte_pieces else b"")
    plain = field(1, b"identity") + whole(3, 1) + whole(4, 0) + whole(5, 1)
    return b"".join(rows) + field(2, trainer) + field(3, plain)


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_scored_scan_equals_viterbi_and_the_library(spark, byte_pieces):
    rng = random.Random(17)
    bar = pieces.BAR
    scores = {c: -8 - rng.random() for c in "abcdet" + bar}
    for _ in range(150):
        scores["".join(rng.choice("abcdet" + bar) for _ in range(rng.randint(2, 6)))] = -4 - 9 * rng.random()
    proto = unigram_model(scores, byte_pieces)
    m = pieces.model(proto)
    assert m.unigram and not pieces.is_unigram(pieces.model_bytes())

    def viterbi(text):
        """The best path, its weight, and whether no other path weighs as much."""
        s = pieces.escaped(text)
        best = [(0.0, [], True)] + [(-np.inf, [], True)] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - m.longest), j):
                w = best[i][0] + m.score.get(s[i:j], m.unknown if j == i + 1 else -np.inf)
                if w > best[j][0] + 1e-5:
                    best[j] = (w, [*best[i][1], s[i:j]], best[i][2])
                elif w > best[j][0] - 1e-5:
                    best[j] = (*best[j][:2], False)
        return best[-1]

    texts, one = ["".join(rng.choice("abcdet  zé") for _ in range(rng.randint(1, 120))) for _ in range(80)], 0
    join = lambda ids: [x for k, x in enumerate(ids) if byte_pieces or x != m.lib.unk_id() or k == 0 or ids[k - 1] != x]
    for text in texts:
        weight, path, only = viterbi(text)
        one += only
        want = join([i for p in path for i in m.ids(p)])
        assert not only or m.lib.encode(text) == want
        for chunk in (1, 5, 33):
            parts = list(pieces.split(text, m.longest, chunk))
            chunks = [pieces.WeighedChunk(m, x, a, b, i == 0, i == len(parts) - 1) for i, (x, a, b) in enumerate(parts)]
            matrices = [c.transfer() for c in chunks]
            ((e, f, w),) = pieces.compose(matrices)
            half = len(matrices) // 2
            if half:
                ((_, _, again),) = pieces.compose([pieces.compose(matrices[:half]), pieces.compose(matrices[half:])])
                assert again == pytest.approx(w)
            assert w == pytest.approx(weight)
            got = [x for c, (p, q) in zip(chunks, pieces.between(matrices, e, f), strict=True) for x in c.trace(p, q)]
            assert join(got) == want if only else m.decode(join(got)) == m.decode(want)
    assert one > 30
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.ids for r in pieces.encode(docs.select("doc_id", "text"), proto=proto, giant=20, chunk=9, fan=3).collect()}
    assert all(got[i] == m.lib.encode(t) for i, t in enumerate(texts) if viterbi(t)[2]) and len(got) == len(texts)


def test_scan_in_spark(spark):
    docs = read(spark, "documents")
    m = pieces.model(pieces.model_bytes())
    got = {r.doc_id: r for r in pieces.round_trip(docs, giant=600, chunk=150, fan=3).collect()}
    for r in docs.collect():
        assert got[r.doc_id].ids == m.lib.encode(r.text) and got[r.doc_id].same
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text"), giant=600, chunk=150, fan=3)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded == texts[r.doc_id] for r in back) and len(back) == len(texts)


def test_tokens_awkward(spark):
    docs = awkward(spark)
    got = pieces.round_trip(docs, giant=1000, chunk=512).collect()
    assert len(got) == 9 and all(r.same for r in got)
    assert all(r.ids == [] and r.n_tokens == 0 for r in got if r.doc_id in (2, 3))
    assert pieces.round_trip(empty(spark)).collect() == []


# --- the pipeline ----------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    own = {r.doc_id: r for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, "/root/testdata/sf0.001")
        assert seen.columns == docs.columns, name
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in seen.collect())
    m = pieces.model(pieces.model_bytes())
    texts = {r.doc_id: r.text for r in seen.collect()}
    assert all(r.ids == m.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)
    changed = [i for i, t in texts.items() if t != own[i].text]
    assert all("[SECRET]" in texts[i] for i in changed)


def test_pipeline_awkward(spark):
    import corpus_pipeline

    for docs in (awkward(spark), empty(spark)):
        seen = docs
        for _, stage in corpus_pipeline.STAGES:
            seen = stage(spark, seen, None)
        assert seen.count() >= 0 and {"doc_id", "ids", "n_tokens"} <= set(seen.columns)
