"""Bands and mixed lines of pages, sections of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import layout as L
from .folds import by_hand, pick

WIDTH = 600
_X = "CASE WHEN doc_id % 3 = 0 THEN (j - 1) % 4 * 10 + CASE WHEN (j - 1) % 8 >= 4 THEN 300 ELSE 0 END ELSE (j - 1) % 8 * 10 END"
_BOXES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS j FROM l),
box AS (SELECT doc_id, text, CAST({_X} AS DOUBLE) AS x0, (n - 1) * 12 + (j - 1) % 3 * 0.4 AS top, n * 100000 + j AS at_ FROM w WHERE text <> ''),
run AS (SELECT doc_id, x0, sum(new) OVER (PARTITION BY doc_id ORDER BY x0 RANGE UNBOUNDED PRECEDING) AS run FROM (SELECT doc_id, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0) <= {WIDTH} * 0.06 THEN 0 ELSE 1 END AS new FROM box)),
band AS (SELECT doc_id, run, min(x0) AS lo, max(x0) AS hi FROM run GROUP BY doc_id, run HAVING count(*) >= 0.08 * (SELECT count(*) FROM box b WHERE b.doc_id = run.doc_id)),
line AS (SELECT b.doc_id, CAST(round(b.top / 3) AS BIGINT) AS line, count(DISTINCT band.run) AS bands FROM box b LEFT JOIN band ON band.doc_id = b.doc_id AND b.x0 BETWEEN band.lo - 1 AND band.hi + 1 GROUP BY 1, 2)"""


def boxes(t):
    """A box for each word of the documents' own lines; every third document is set in two columns."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = lines.select("doc_id", "n", F.posexplode(F.split("line", " ")).alias("j", "text")).filter("text <> ''")
    two = (F.col("j") % 4) * 10 + F.when(F.col("j") % 8 >= 4, 300).otherwise(0)
    x0 = F.when(F.col("doc_id") % 3 == 0, two).otherwise((F.col("j") % 8) * 10).cast("double")
    return w.select("doc_id", "text", x0.alias("x0"), (F.col("n") * 12 + (F.col("j") % 3) * 0.4).alias("top"), (F.col("n") * 100_000 + F.col("j")).alias("at"))


@query("T14 T04", f"WITH {_BOXES} SELECT line.doc_id, count(*) AS lines, count(*) FILTER (WHERE bands >= 2) AS mixed, max(bands) AS most FROM line GROUP BY line.doc_id")
def page_columns(t):
    """Lines of each page and those that run over two of its bands."""
    found = L.lines(boxes(t), "doc_id", F.lit(WIDTH))
    return found.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("mixed").alias("mixed"), F.max("bands").alias("most"))


@query(
    "T14",
    f"""WITH {_BOXES} SELECT m.doc_id, m.line, sha256(string_agg(b.text, ' ' ORDER BY x0, at_)) AS text_hash FROM line m JOIN box b ON b.doc_id = m.doc_id AND CAST(round(b.top / 3) AS BIGINT) = m.line
    WHERE bands >= 2 GROUP BY m.doc_id, m.line""",
)
def mixed_lines(t):
    """Each line that holds words of two bands, as a reader of its boxes would run it together."""
    return L.lines(boxes(t), "doc_id", F.lit(WIDTH)).filter("mixed").select("doc_id", "line", F.sha2("text", 256).alias("text_hash"))


#: Documents, and by hand their sections as heading=item+item.
_SECTIONS = [
    ("Jane\n## Skills:\n- Go\n* Sql\n\n1. Rust\n**Работа**\nAcme, 2020\nBeta; 2021", "Skills=Go+Sql+Rust|Работа=Acme, 2020+Beta; 2021"),
    ("Навыки: Python, Go; SQL|C\nEDUCATION\nMit\nUCL", "Навыки=Python+Go+SQL+C|EDUCATION=Mit|UCL="),
    ("Key skills:\nPython, Go, SQL\nОПЫТ 2020:\n", "Key skills=Python+Go+SQL|ОПЫТ 2020="),
    ("I can say this. And that:\nx\nOne two three four five six seven:\ny", ""),
    ("Languages: English\nThe rest: of. it\nплюс", "Languages=English|The rest=of. it+плюс"),
    ("# \nA1\nB:c:d\n#tag: x\n• y", "A1=|B=c:d|tag: x=y"), ("", ""), ("no heading at all\nnone", ""),
    ("**Bold**\r\n**Half:**\r\nfirst\r\n· second\u2028third", "Bold=|**Half=**+first+second+third"),
    ("X" * 71 + "\nSKILLS\n–\n– a\n12) b\n123) c", "SKILLS=–+a+b+123) c"),
]


@query("F19", by_hand("sections", [(s,) for _, s in _SECTIONS]))
def document_sections(t):
    """Four spellings of a heading, lists in lines and in one line, and sentences that only look like headings."""
    docs = t("posting").select("id", pick([d for d, _ in _SECTIONS]).alias("text"))
    each = F.transform("sections", lambda s: F.concat(s["heading"], F.lit("="), F.array_join(s["items"], "+")))
    return L.with_sections(docs, "text").select("id", F.array_join(each, "|").alias("sections"))


_ASK = [(d, n, w) for (d, _), (n, w) in zip(_SECTIONS, [(" работа :", "Acme, 2020"), ("НАВЫКИ", "Python"), ("KEY  Skills", "Python"), ("x", None), ("languages", "English"), ("b", "c:d"), ("", None), ("none", None), ("half", "**"), ("- skills -", "–")], strict=True)]


@query("F19", by_hand("first", [(w,) for *_, w in _ASK]))
def section_by_name(t):
    docs = t("posting").select("id", pick([d for d, *_ in _ASK]).alias("text"), L.fold_heading(pick([n for _, n, _ in _ASK])).alias("name"))
    found = L.named_section(F.col("sections"), F.col("name"))
    return L.with_sections(docs, "text").select("id", F.get(found["items"], F.lit(0)).alias("first"))
