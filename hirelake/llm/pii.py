"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans the patterns miss."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: The exact patterns, in forms that try each run of characters once: an address is sought from its at-sign outwards, an
#: octet from its first digit, without giving digits back.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Spelled-out addresses: tokens with [at], (at), [dot] or (dot) open a zone, with the tokens beside them.
SPELLED = r"[\[(](?:[aA][tT]|[dD][oO][tT])[\])]"
#: Tokens with a digit or an at-sign, one blank apart; a token is tried once, from its start.
ZONE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+")
_SPELLED, _SIGN, _WORD = re.compile(SPELLED), re.compile("[0-9@]"), re.compile(r"\S+")
TOKEN = re.compile(r"[^\s\x20 ]+")
EDGE = " \t\n\r()[]{}<>,;:!?\"'*#$%&|."
LONGEST, TRAIN_ZONES, SURE = 6, 500, 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    d = digits.lstrip("0")
    return len(d) < 3 or len(d) == 3 and d <= "255"


def addresses(text: str) -> list[tuple[int, int]]:
    """Mail addresses, leftmost and apart: what stands before an at-sign back to the last match, sign or other character."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact patterns' matches that pass their checks, by start, then kind."""
    out = [(a, 0, b) for a, b in addresses(text)]
    for m in IP.finditer(text):
        if all(is_octet(p) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the semi-Markov model -------------------------------------------------------------------

FEATURES = (
    "bias", "one", "two", "three", "more", "at", "obfuscated", "email", "dots3", "octets", "plus", "area", "dashes", "luhn", "cardlen", "phonelen", "shortnum", "letters",
    "plain", "fours", "tens", "odd", "longrun", "groups3", "lead", "trail",
)
INDEX = {f: i for i, f in enumerate(FEATURES)}
_EMAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]+\s?[\[(]at[\])]\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z]+)+", re.I)
_AREA = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}")
_DASHED = re.compile(r"(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}")
_FOURS = re.compile(r"[0-9]{4}(?:[ .-][0-9]{4}){3}")
#: A number of up to three digits at either end, parted by a blank from a whole of groups.
_LEAD, _TRAIL = re.compile(r"[0-9]{1,3}[\x20 ]"), re.compile(r"[\x20 ][0-9]{1,3}")
_OCTETS = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?")


def features(span: str, tokens: int) -> np.ndarray:
    """What a whole candidate segment looks like; a vector of zeros and ones."""
    f = np.zeros(len(FEATURES), np.float64)

    def on(name, yes=True):
        if yes:
            f[INDEX[name]] = 1.0

    digits = re.sub(r"[^0-9]", "", span)
    letters = sum(c.isalpha() for c in span)
    on("bias")
    on(("one", "two", "three", "more")[min(tokens, 4) - 1])
    on("at", "@" in span)
    on("obfuscated", bool(_OBFUSCATED.fullmatch(span)))
    on("email", bool(_EMAIL_LIKE.fullmatch(span)))
    octets = bool(_OCTETS.fullmatch(span))
    on("dots3", span.count(".") == 3 and not letters)
    on("octets", octets and all(int(p) <= 255 for p in re.split(r"[.:]", span)[:4]))
    on("plus", span.startswith("+"))
    on("area", bool(_AREA.fullmatch(span)))
    on("dashes", bool(_DASHED.fullmatch(span)))
    on("cardlen", 14 <= len(digits) <= 19)
    on("luhn", 14 <= len(digits) <= 19 and luhn(digits))
    on("phonelen", 10 <= len(digits) <= 13)
    on("shortnum", len(digits) < 7)
    on("letters", letters > 0)
    on("plain", span.isdigit())
    on("fours", bool(_FOURS.fullmatch(span)))
    on("tens", letters > 3 and len(digits) > 3)
    on("odd", bool(re.search(r"[^0-9A-Za-z@.+() :\[\]_%-]", span)))
    on("longrun", len(digits) > 19)
    on("lead", bool(_LEAD.match(span)))
    on("trail", bool(_TRAIL.fullmatch(span[max(span.rfind(" "), span.rfind(" ")) :])))
    on("groups3", len(re.findall(r"[0-9]+", span)) >= 3)
    return f


def log_sum(values: list[float]) -> float:
    """log of the sum of the values' exponentials."""
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class Lattice:
    """The candidate segments of one zone: for each (first token, tokens), its bounds and features."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
        self.bounds, self.rows, feats = {}, {}, []
        for i in range(len(self.tokens)):
            for n in range(1, min(LONGEST, len(self.tokens) - i) + 1):
                a, b = self.tokens[i][0], self.tokens[i + n - 1][1]
                raw = text[a:b]
                left = len(raw) - len(raw.lstrip(EDGE.replace("(", "") if "(" in raw and ")" in raw[raw.index("(") :] else EDGE))
                core = raw[left:].rstrip(EDGE)
                self.bounds[i, n] = (a + left, a + left + len(core))
                self.rows[i, n] = len(feats)
                feats.append(features(core, n))
        self.feats = np.array(feats)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Segments x (kinds and, last, outside); outside is one token long."""
        s = np.concatenate([self.feats @ weights.T, np.zeros((len(self.feats), 1))], axis=1)
        for (_i, n), r in self.rows.items():
            s[r, -1] = 0.0 if n == 1 else -np.inf
        return s

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of each labelled segment under the model, and the log partition, by forward and backward sums."""
        n = len(self.tokens)
        fore, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        fore[0] = back[n] = 0.0
        seg = np.logaddexp.reduce(s, axis=1).tolist()
        for j in range(1, n + 1):
            fore[j] = log_sum([fore[j - k] + seg[self.rows[j - k, k]] for k in range(1, min(LONGEST, j) + 1)])
        for i in range(n - 1, -1, -1):
            back[i] = log_sum([seg[self.rows[i, k]] + back[i + k] for k in range(1, min(LONGEST, n - i) + 1)])
        around = np.array([fore[i] + back[i + k] for i, k in self.rows])
        return np.exp(s + around[:, None] - fore[n]), fore[n]

    def best(self, s: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Viterbi over segments of at most LONGEST tokens: (first token, tokens, kind, row) of the labelled ones."""
        n = len(self.tokens)
        score, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        kind, top = s.argmax(axis=1), s.max(axis=1)
        for j in range(1, n + 1):
            for k in range(1, min(LONGEST, j) + 1):
                r = self.rows[j - k, k]
                if score[j - k] + top[r] > score[j]:
                    score[j], back[j] = score[j - k] + top[r], (j - k, k, int(kind[r]), r)
        out, j = [], n
        while j > 0:
            i, k, t, r = back[j]
            if t < len(KINDS):
                out.append((i, k, t, r))
            j = i
        return out[::-1]


def zones(text: str) -> list[tuple[int, int]]:
    """Runs of tokens, one blank apart, that each hold a digit or an at-sign, or a spelled-out sign, or stand beside one."""
    if not _SPELLED.search(text):
        return [m.span() for m in ZONE.finditer(text)]
    out: list[tuple[int, int]] = []

    def add(a, b):
        if out and out[-1][1] + 1 == a and text[a - 1] == " ":
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))

    before, drawn = (-2, -2), False
    for m in _WORD.finditer(text):
        a, b = m.span()
        beside = before[1] + 1 == a and text[a - 1] == " "
        sign = bool(_SPELLED.search(m[0]))
        if sign and beside and (not out or out[-1][1] < before[1]):
            add(*before)
        if sign or (drawn and beside) or _SIGN.search(m[0]):
            add(a, b)
        before, drawn = (a, b), sign
    return out


def _gold(lat: Lattice, spans) -> np.ndarray:
    """The labelled segmentation that the spans stand for, as segment-by-label indicators; unlabelled tokens are outside."""
    g = np.zeros((len(lat.feats), len(KINDS) + 1))
    used = set()
    for (i, n), (a, b) in sorted(lat.bounds.items(), key=lambda x: x[0][1]):
        for s, t, e in spans:
            if (a, b) == (s, e) and not used & set(range(i, i + n)):
                g[lat.rows[i, n], t] = 1
                used |= set(range(i, i + n))
    for i in range(len(lat.tokens)):
        if i not in used:
            g[lat.rows[i, 1], -1] = 1
    return g


def made_examples(seed: int = 11, n: int = 240) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Invented zones with their spans: the exact patterns' forms and near forms that the patterns miss, beside plain numbers."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for i in range(n):
        user, host = "user" + d(2), f"mail{d(1)}.example.com"
        card = d(15)
        card += next(c for c in "0123456789" if luhn(card + c))
        octets = ".".join(str(x) for x in rng.integers(1, 256, 4))
        form = [
            (f"{user}@{host}", 0), (f"{user}[at]{host}", 0), (octets, 1), (f"{octets}:{d(4)}", 1), (card, 2), (f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}", 2),
            (f"+1 ({d(3)}) 555-{d(4)}", 3), (f"({d(3)}) 555-{d(4)}", 3), (f"{d(3)}-555-{d(4)}", 3), (d(int(rng.integers(1, 13))), None), (f"v{d(1)}.{d(1)}.{d(2)}", None), (f"#{d(4)}", None),
            (f"{d(4)} {d(4)} {d(4)}", None), (f"20{d(2)}-0{1 + i % 9}-1{d(1)}", None), (f"{d(2)}:{d(2)}", None), (f"{d(3)}.{d(2)}", None), (f"{d(8)}abcdef{d(10)}", None), (f"{d(int(rng.integers(20, 30)))}", None),
        ]
        text, spans = "", []
        short = lambda: "".join(d(int(rng.integers(1, 4))) + " " for _ in range(int(rng.integers(0, 6)) * (i % 2)))
        for k in rng.integers(0, len(form), int(rng.integers(1, 4))):
            shape, kind = form[k]
            text += short()
            if kind is not None:
                spans.append((len(text), kind, len(text) + len(shape)))
            text += shape + " "
        text += short()
        out.append((text.rstrip(), spans))
    names, hosts, words = ("jane.doe", "max", "a_lee", "Info", "sales-team"), ("example", "mail.example", "uni-x", "Corp"), ("meet", "noon", "list", "see", "room")
    pick = lambda of: of[int(rng.integers(0, len(of)))]
    for i in range(n // 4):  # addresses and other uses of the same tokens, all without digits
        user, host, end, at, dot = pick(names), pick(hosts), pick(("com", "org", "de")), pick(("[at]", "(at)", "[AT]")), pick(("[dot]", "(dot)"))
        shape = (f"{user}{at}{host}.{end}", f"{user} {at} {host}.{end}", f"{user} {at} {host} {dot} {end}", f"{user}{at}{host}{dot}{end}")[i % 4]
        one, two = pick(words), pick(words)
        plain = (f"{one} {at} {two}", f"{one}{dot} {two}", f"{one} {at} the", f"{one} {dot} {two}")[i // 4 % 4]
        out += [(f"{one} {shape} {two}", [(len(one) + 1, 0, len(one) + 1 + len(shape))]), (plain, [])]
    return out


def train(examples, rounds: int = 100, rate: float = 1.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (kinds x features) by gradient ascent (AdaGrad) on the exact conditional log likelihood."""
    w = np.zeros((len(KINDS), len(FEATURES)))
    grown = np.full_like(w, 1e-6)
    data = []
    for text, spans in examples:
        for a, b in zones(text):
            lat = Lattice(text, a, b)
            if lat.tokens and len(lat.tokens) <= 40:
                data.append((lat, _gold(lat, spans)))
    for _ in range(rounds):
        grad = -decay * w * len(data)
        for lat, gold in data:
            p, _z = lat.marginals(lat.scores(w))
            grad += (gold - p)[:, :-1].T @ lat.feats
        grown += grad**2
        w += rate * grad / np.sqrt(grown)
    return w


def decode(text: str, a: int, b: int, weights: np.ndarray, stretch: int = 400) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, posterior) of the labelled segments of the zone's best labelling.

    Features of a longer zone are made a stretch at a time, each with the tokens that its last segments reach into; the
    sums run over the whole zone, so stretches change nothing. Kept for each token: its segments' best and summed scores.
    """
    edges = [m.span() for m in TOKEN.finditer(text, a, b)]
    n = len(edges)
    total, top = np.full((n, LONGEST), -np.inf), np.full((n, LONGEST), -np.inf)
    kind = np.zeros((n, LONGEST), np.int8)
    bounds = np.zeros((n, LONGEST, 2), np.int64)
    for at in range(0, n, stretch):
        lat = Lattice(text, edges[at][0], edges[min(n, at + stretch + LONGEST - 1) - 1][1])
        s = lat.scores(weights)
        sums, best, which = np.logaddexp.reduce(s, axis=1), s.max(axis=1), s.argmax(axis=1)
        for (i, k), r in lat.rows.items():
            if i < stretch:
                total[at + i, k - 1], top[at + i, k - 1], kind[at + i, k - 1], bounds[at + i, k - 1] = sums[r], best[r], which[r], lat.bounds[i, k]
    score, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int8)
    score[0] = 0.0
    for j in range(1, n + 1):
        for k in range(1, min(LONGEST, j) + 1):
            if score[j - k] + top[j - k, k - 1] > score[j]:
                score[j], back[j] = score[j - k] + top[j - k, k - 1], k
    path, j = [], n
    while j > 0:
        k = int(back[j])
        j -= k
        if kind[j, k - 1] < len(KINDS):
            path.append((j, k))
    if not path:
        return []
    fore, rest = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fore[0] = rest[n] = 0.0
    for j in range(1, n + 1):
        fore[j] = log_sum([fore[j - k] + total[j - k, k - 1] for k in range(1, min(LONGEST, j) + 1)])
    for i in range(n - 1, -1, -1):
        rest[i] = log_sum([total[i, k - 1] + rest[i + k] for k in range(1, min(LONGEST, n - i) + 1)])
    p = lambda i, k: float(np.exp(fore[i] + top[i, k - 1] + rest[i + k] - fore[n]))
    return [(int(bounds[i, k - 1, 0]), int(kind[i, k - 1]), int(bounds[i, k - 1, 1]), p(i, k)) for i, k in reversed(path)]


def added_spans(text: str, base, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Segments of the best labelling that no base span touches and whose posterior is at least SURE."""
    out = []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # how far the first so many spans go
    far = lambda n: reach[n - 1] if n else 0
    for a, b in zones(text):
        if b - a < 7 or far(bisect_right(starts, a)) >= b:
            continue
        for x, t, y, p in decode(text, a, b, weights):
            if p >= SURE and far(bisect_left(starts, y)) <= x:
                out.append((x, t, y))
    return out


def _sample(batches):
    for rb in slices(batches):
        texts, marks = [], []
        for text in rb.column("text").to_pylist():
            for a, b in zones(text):
                if 7 <= b - a <= 300 and not _SPELLED.search(text, a, b):  # the exact patterns cannot label spelled-out addresses
                    texts.append(text[a:b])
                    marks.append(hashlib.blake2b(text[a:b].encode("utf-8", "surrogatepass"), digest_size=8).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(marks, pa.string())], names=["zone", "mark"])


def marked(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the text null where it has neither a digit, an at-sign nor a spelled-out [at] or [dot] and so no candidate."""
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike("[0-9@]|" + SPELLED), text).alias("text"))


def fit(docs: DataFrame, most_zones: int = TRAIN_ZONES) -> np.ndarray:
    """Train on invented examples and on a bounded sample of the corpus's zones (at most `most_zones`, one for each cell of their hash), labelled by the exact patterns."""
    sample = marked(docs).filter("text is not null").mapInArrow(_sample, "zone string, mark string")
    sample = sample.groupBy(F.pmod(F.xxhash64("mark"), F.lit(most_zones)).alias("cell")).agg(F.min(F.struct("mark", "zone")).getField("zone").alias("zone"))
    real = [(r["zone"], base_spans(r["zone"])) for r in sample.orderBy("cell").collect()]
    return train(made_examples() + real)


def _find(weights: np.ndarray):
    def run(batches):
        name = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
        for rb in slices(batches):
            out = []
            for text in rb.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, weights) if text else []
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                out.append((*n, hashlib.sha256(name(base).encode()).hexdigest(), name(sorted(base + more)), len(more)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return run


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The exact patterns' spans always stay. A semi-Markov conditional random field scores whole candidate segments (up
    to LONGEST neighbouring tokens that hold a digit or an at-sign, or stand at a spelled-out [at] or [dot]) and its dynamic program chooses their bounds and
    kinds together; a segment is added where no exact span touches it and its posterior is at least SURE.

    A null text is empty and has no spans; whole texts are read, at any length; repeated rows each get a row; an empty
    table gives an empty result; a null doc_id stays null; further columns are ignored.
    """
    weights = fit(docs) if weights is None else weights
    return marked(docs).mapInArrow(_find(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
