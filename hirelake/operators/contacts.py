"""Contacts in prose: the text is cut into tokens and digit groups, and rules and lookups say what they are."""

from __future__ import annotations

import re
import string
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands before a number or a handle, whose host is what, hosts known without a scheme, endings of
# hosts in prose, and technologies that are spelled like a host.
PHONE_LABELS = {"телефон", "тел", "моб", "мобильный", "сот", "сотовый", "phone", "mobile", "cell", "tel"}
HANDLE_LABELS = {"telegram", "telegramm", "телеграм", "телеграмм", "тг", "tg"}
HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "t.me": "telegram", "telegram.me": "telegram", "telegram.dog": "telegram", "linkedin.com": "linkedin"}
BARE_HOSTS = {"github.com", "gitlab.com", "t.me", "telegram.me", "linkedin.com", "behance.net", "dribbble.com", "medium.com", "habr.com", "stackoverflow.com"}
TLDS = "ru|kz|com|net|org|io|dev|me|co|app|xyz|site|online|info|biz|pro|tech|ai|uz|by|ua|de|uk|рф|рус|укр|қаз|срб|бел".split("|")
SPELLED = ("asp.net", "vb.net", "ado.net", "ml.net", "socket.io")
MOST_LINKS, LEAST_DIGITS, MOST_DIGITS = 10, 7, 15
_LOCAL, _TAIL, _JOINS = set(string.ascii_letters + string.digits + "._%+-"), ".,;:!?)]}»\"'–—-", set(" \t\xa0().-")
_QUOTES = str.maketrans(dict.fromkeys("<>\"'«»", " "))


def _label_before(text: str, at: int, labels: set[str]) -> bool:
    """Whether one of the words stands before a place, with no more than blanks and a mark between."""
    head = text[max(0, at - 40) : at].rstrip()
    word = (head[:-1] if head[-1:] in ":.–—-" else head).rstrip()
    start = len(word)
    while start and word[start - 1].isalpha():
        start -= 1
    return word[start:].lower() in labels


def numbers(text: str):
    """(start, text) of digit groups that hang together: at most two marks, and no new line, between one and the next."""
    start = end = None
    for m in re.finditer("[0-9]+", text):
        gap = text[end : m.start()] if end is not None else ""
        if end is None or len(gap) > 2 or not set(gap) <= _JOINS:
            if end is not None:
                yield start, text[start:end]
            start = m.start() - (text[m.start() - 1 : m.start()] == "+")
        end = m.end()
    if end is not None:
        yield start, text[start:end]


def _dated(number: str) -> bool:
    """Whether two neighbouring groups read as a month and a year."""
    groups = re.split("([^0-9]+)", number.lstrip("+"))
    return any(mark in (".", "/") and len(a) <= 2 and len(b) == 4 for a, mark, b in zip(groups[::2], groups[1::2], groups[2::2], strict=False))


def phone(text: str) -> str | None:
    """The first believable number of the strongest sign: behind a label, then with a plus, then with a bracket or dash inside."""
    best: dict[int, str] = {}
    for at, number in numbers(text):
        if LEAST_DIGITS <= sum(c.isdigit() for c in number) <= MOST_DIGITS and not _dated(number):
            sign = 0 if _label_before(text, at, PHONE_LABELS) else 1 if number[0] == "+" else 2 if set(number) & {"(", "-"} else 3
            best.setdefault(sign, " ".join(number.split()))
    return next((best[s] for s in range(3) if s in best), None)


def email(text: str) -> str | None:
    """The first address: what may stand before an at-sign, and labels of a host behind it, the last of letters alone."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        while end < len(text) and text[end].isascii() and (text[end].isalnum() or text[end] in ".-"):
            end += 1
        labels = text[at + 1 : end].split(".")
        whole = []
        for label in labels:
            if not label or label[0] == "-" or label.strip("-") != label:
                break
            whole.append(label)
        while whole and not (whole[-1].isalpha() and 2 <= len(whole[-1]) <= 24):
            whole.pop()
        if start < at and len(whole) > 1:
            return text[start : at + 1] + ".".join(whole)
        at = text.find("@", at + 1)
    return None


def kind(host: str) -> str:
    return next((k for h, k in HOSTS.items() if host == h or host.endswith("." + h)), "website")


def links(text: str) -> list[tuple[str, str]]:
    """Kind and URL of addresses with a scheme, then of known hosts without one, then of handles; each once, MOST_LINKS at most."""
    full, bare, handles = [], [], []
    last = ""
    for token in text.translate(_QUOTES).split():
        low = token.lower()
        at = min((i for i in (low.find("http://"), low.find("https://")) if i >= 0), default=-1)
        if at >= 0:
            full.append(token[at:].rstrip(_TAIL))
        else:
            plain = token.lstrip("([{,;:")
            host, slash, rest = plain.partition("/")
            if slash and rest.rstrip(_TAIL) and host.lower().removeprefix("www.") in BARE_HOSTS:
                bare.append("https://" + plain.rstrip(_TAIL))
            label, sign, name = token.partition("@")
            word = (label or last).rstrip(":.–—-").lstrip("([{").lower()
            end = next((i for i, c in enumerate(name) if not (c.isascii() and (c.isalnum() or c == "_"))), len(name))
            if sign and word in HANDLE_LABELS and 4 <= end <= 32:
                handles.append("https://t.me/" + name[:end])
        last = token
    out: dict[str, str] = {}
    for url in full + bare + handles:
        try:
            parts = urlsplit(url)
        except ValueError:
            continue
        if parts.hostname and parts.username is None:
            out.setdefault(url, kind(parts.hostname.lower()))
    return [(k, u) for u, k in out.items()][:MOST_LINKS]


LINKS = "array<struct<kind:string,url:string>>"


def contacts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, email, phone, links of each text; a null text has none."""
    slim = df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pair = pa.list_(pa.struct([("kind", pa.string()), ("url", pa.string())]))

    def run(batches):
        for rb in batches:
            texts = rb.column("text").to_pylist()
            found = [[{"kind": k, "url": u} for k, u in links(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([rb.column(key), pa.array(map(email, texts), pa.string()), pa.array(map(phone, texts), pa.string()), pa.array(found, pair)], names=[key, "email", "phone", "links"])

    return slim.mapInArrow(run, f"{key} long, email string, phone string, links {LINKS}")


def has_link(c: Column) -> Column:
    """Whether a text carries an address: a scheme, a www, or a host of known ending; a technology's name is none unless a path follows it."""
    low = F.lower(c)
    tokens = F.split(low, r"""[\s,;()<>"'«»\[\]{}|@]+""")

    def host(token):
        name, labels = F.rtrim(F.substring_index(token, "/", 1), F.lit(".:!?")), None
        labels = F.split(name, r"\.")
        ends = F.size(labels) > 1, F.substring_index(F.element_at(labels, -1), "-", 1).isin(*TLDS), ~F.exists(labels, lambda x: ~x.rlike(r"(?U)^[\w-]+$"))
        return token.startswith("www.") | (ends[0] & ends[1] & ends[2] & (~name.isin(*SPELLED) | token.contains("/")))

    return low.contains("http://") | low.contains("https://") | F.exists(tokens, host)
