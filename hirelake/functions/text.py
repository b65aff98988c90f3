"""Text functions: normalisation, fingerprints, contacts, markup, rules."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = "\u001f"
#: What parts two words: all but the letters and digits of every script.
TOKEN = r"[^\p{L}\p{N}]+"


@F.arrow_udf(StringType())
def _nfkc_casefold(s: pa.Array) -> pa.Array:
    fold = lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold()
    # a few texts at a time are Python's, whatever the batch holds
    return pa.concat_arrays([pa.array([fold(x.as_py()) for x in s.slice(n, 16)], pa.string()) for n in range(0, max(1, len(s)), 16)])


#: Characters that are their own compatibility form in any company of theirs and whose folded case is their lower case: ASCII,
#: Latin letters of western Europe without those that fold or decompose, Russian letters, common punctuation.
STABLE = "\\x00-\\x7f¡¢£¤¥¦§©«¬®°±¶·»¿À-ÖØ-Þà-öø-ÿŒœА-яЁё‐–—‘’‚“”„†‡•‰‹›€"


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).casefold())


def nfkc_casefold(c: Column) -> Column:
    """Unicode compatibility form and case folding, which Spark has no function for; texts of stable characters alone stay in the JVM."""
    plain = ~F.regexp_replace(c, r"[\x00-\x7f]+", "").rlike(f"[^{STABLE}]")  # runs of ASCII go first, as a wide class is slow
    return F.coalesce(_nfkc_casefold(F.when(~plain, c)), F.lower(c))


def normalize_part(c: Column) -> Column:
    """Compatibility form and folded case, anything but letters, digits, marks of `\\w` and blanks to a blank, squeezed and trimmed; null becomes empty."""
    folded = nfkc_casefold(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """sha1 of the normalised parts, with a separator that no part can hold."""
    return F.sha1(F.concat_ws(UNIT, *[normalize_part(p) for p in parts]))


def slug(c: Column) -> Column:
    """Decomposed and folded, runs of anything but ASCII letters and digits to a dash; `unknown` where nothing is left."""
    dashed = F.btrim(F.regexp_replace(_nfkd(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(dashed == "", "unknown").otherwise(dashed)


def skill_key(c: Column) -> Column:
    """A skill's spelling without blanks, dots, dashes and underscores, in lower case."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s._\-]+", "")


def readable(c: Column, most: int = 100) -> Column:
    """A name as written but for case and runs of blanks, cut at `most` characters."""
    return F.substring(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), 1, most)


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All named and numeric character references, up to three layers deep."""

    def one(x):
        for _ in range(3):
            y = html.unescape(x)
            if y == x:
                break
            x = y
        return x

    return s.map(lambda x: None if x is None else one(x))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TOKEN), lambda w: w != "")


def has_all_tokens(c: Column, query: str) -> Column:
    """Every token of the query occurs; a query without tokens matches nothing."""
    wanted = "".join(ch if ch.isalnum() else " " for ch in query.lower()).split()
    if not wanted:
        return F.lit(False)
    have = tokens(c)
    return F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(have, w))


#: A sentence ends at blanks after closing punctuation, or at a line end, semicolon or bullet; never at a bare dot.
SENTENCE = r"(?<=[.!?…])\s+|[\n;•·]+"


def sentences(c: Column) -> Column:
    """The sentences of a text in order, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, SENTENCE), lambda x: F.trim(x)), lambda x: x != "")


def plain_text(c: Column) -> Column:
    """Prose from a text in whatever markup: character references are peeled, at most three layers deep, then block tags
    become line breaks and other tags blanks, lines are squeezed and empty ones dropped. A text without a tag or a
    reference stays as it is.
    """
    marked = c.rlike(r"<[A-Za-z/!][^>]*>|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
    peeled = unescape(F.when(marked, c))
    lined = F.regexp_replace(peeled, r"(?i)<\s*/?\s*(?:br|p|div|li|ul|ol|h[1-6]|tr|td|th|table|section|article)\b[^>]*>", "\n")
    bare = F.translate(F.regexp_replace(lined, "<[^>]+>", " "), "\u00a0", " ")
    lines = F.transform(F.split(bare, r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.coalesce(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), c)


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, "^[a-z]+://([^/?#]+)", 1)


def url_path_tail(c: Column) -> Column:
    """The last segment of the path."""
    return F.regexp_extract(c, "^[a-z]+://[^/?#]+(?:/[^/?#]*)*/([^/?#]+)", 1)


def redact_params(c: Column) -> Column:
    """Values of tracking and secret parameters become ***."""
    return F.regexp_replace(c, "([?&](?:ref|utm_[a-z]+|token|key|sid)=)[^&#]*", "$1***")
