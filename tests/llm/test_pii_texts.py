"""Exact patterns on awkward texts, against the patterns as they are written down, and the time that bad texts take."""

import random
import re
import time

import pytest

from hirelake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
PIECES = ["a", "b.", "@", "1", "22", ".", "-", " ", "  ", "\n", "[at]", "(dot)", "+", "é", "300", "x@y.z", "(555) 010-1234", "0007", "4111111111111111"]


def octet(p):
    p = p.lstrip("0")
    return len(p) < 4 and (p == "" or int(p) <= 255)


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(text) == plain(text), text


def test_long_octets():
    for at in range(4):
        parts = ["1"] * 4
        parts[at] = "0" * 5000 + "25"
        assert [(k, b - a) for a, k, b in pii.base_spans(".".join(parts))] == [(1, 5008)]
    assert pii.base_spans("1.1.1." + "9" * 5000) == []


@pytest.fixture(scope="module")
def weights():
    return pii.train(pii.made_examples(n=60), rounds=40)


BAD = {
    "one run": "a" * 1_000_000 + " x@y.com", "a run up to an at-sign": "a" * 1_000_000 + "@", "digits": "1" * 1_000_000, "octets": "1." * 500_000, "opened numbers": "+1" + "(" * 1_000_000,
    "addresses": " ".join(f"user{i}@mail{i}.example.com" for i in range(20_000)), "no blanks": "漢字" * 500_000 + "1", "base64": "Ab3/" * 250_000, "spelled out": "x" * 1_000_000 + " a [at] b",
}


@pytest.mark.parametrize("kind", BAD)
def test_bad_texts_take_seconds(kind, weights):
    began = time.process_time()
    base = pii.base_spans(BAD[kind])
    pii.added_spans(BAD[kind], base, weights)
    assert time.process_time() - began < 20
    assert len(base) == {"one run": 1, "addresses": 20_000, "octets": 125_000}.get(kind, 0)
