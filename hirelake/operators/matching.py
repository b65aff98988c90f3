"""The scoring of one vacancy against one profile, as columns: filters, components, both formulas, buckets, the words for it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .listing import bucket_of

# Weights, floors, penalties, levels and language codes.
WEIGHTS = {"skill_coverage_required": 0.35, "semantic_similarity": 0.20, "experience_fit": 0.15, "logistics_fit": 0.10}
EVIDENCE = ("skill_coverage_required", "semantic_similarity")
TITLE_WEIGHTS = {"title_similarity": 0.7, "semantic_similarity": 0.3}
FLOORS, TITLE_FLOORS = (85, 70, 55), (80, 78, 75)
LANGUAGE_GAP, SALARY_SHORT, SHORTFALL, MOST_YEARS_SHORT = 8, 15, 0.7, 4
CEFR = ("A1", "A2", "B1", "B2", "C1", "C2", "NATIVE")
CODES = {
    "русский": "ru", "английский": "en", "казахский": "kk", "немецкий": "de", "французский": "fr", "испанский": "es", "итальянский": "it", "китайский": "zh",
    "японский": "ja", "корейский": "ko", "турецкий": "tr", "арабский": "ar", "польский": "pl", "украинский": "uk", "кыргызский": "ky", "узбекский": "uz",
}
NAMES = {
    "title_similarity": "названию", "skill_coverage_required": "навыкам", "semantic_similarity": "семантике", "experience_fit": "опыту", "logistics_fit": "логистике",
}
REMOTE_RANK = {"no": 0, "hybrid": 1, "full": 2}


@dataclass(frozen=True)
class Profile:
    """What is compared with; None and empty mean that nothing is known."""

    total_years: float | None = None
    seniority: int | None = None
    locations: tuple[str, ...] = ()
    relocation: bool = False
    remote_pref: str | None = None
    salary_min: float | None = None
    languages: dict[str, str] = field(default_factory=dict)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language_gate(requirements: Column, spoken: dict[str, str]) -> Column:
    """refusal, flags and gaps of a list of (name, level), in its order; what follows the first refusal is not read."""
    rank = lambda level: F.array_position(F.array(*[F.lit(x) for x in CEFR]), F.upper(level))
    kind = "struct<refusal:string,flags:array<string>,gaps:int>"
    start = F.from_json(F.lit('{"flags":[],"gaps":0}'), kind)
    speaks = _map(spoken) if spoken else F.create_map().cast("map<string,string>")

    def step(acc, x):
        code = F.try_element_at(_map(CODES), F.lower(F.trim(x["name"])))
        held = F.try_element_at(speaks, code)
        weak = (rank(x["level"]) > 0) & (rank(held) > 0) & (rank(held) < rank(x["level"]))
        flag = F.when(code.isNull(), F.concat(F.lit("язык не распознан: "), x["name"])).when(
            weak, F.concat(x["name"], F.lit(": требуется "), F.upper(x["level"]), F.lit(", заявлен "), F.upper(held))
        )
        refused = F.when(code.isNotNull() & held.isNull(), F.concat(F.lit("требуется "), x["name"]))
        open_ = acc["refusal"].isNull()
        return F.struct(
            F.when(open_, refused).otherwise(acc["refusal"]).alias("refusal"), F.when(open_ & flag.isNotNull(), F.concat(acc["flags"], F.array(flag))).otherwise(acc["flags"]).alias("flags"),
            (acc["gaps"] + F.when(open_ & F.coalesce(weak, F.lit(False)), 1).otherwise(0)).alias("gaps"),
        )

    return F.aggregate(F.coalesce(requirements, F.array().cast("array<struct<name:string,level:string>>")), start, step)


def logistics(p: Profile, remote: Column, city: Column, salary: Column) -> Column:
    """Mean of the sub-points that are known on both sides: work format, city, pay."""
    points = []
    if p.remote_pref is not None:
        apart = F.abs(F.try_element_at(_map(REMOTE_RANK), remote) - REMOTE_RANK[p.remote_pref])
        points.append(F.when(apart == 0, 1.0).when(apart == 1, 0.5).otherwise(0.0))
    if p.locations:
        hit, low = F.lit(False), F.lower(F.trim(city))
        for place in p.locations:
            hit = hit | low.contains(place.strip().lower()) | F.contains(F.lit(place.strip().lower()), low)
        points.append(F.when(F.coalesce(city, F.lit("")) == "", None).when(hit, 1.0).otherwise(0.5 if p.relocation else 0.0))
    if p.salary_min is not None:
        points.append(F.when(salary >= p.salary_min, 1.0).when(salary >= p.salary_min * SHORTFALL, 0.5).when(salary.isNotNull(), 0.0))
    return S.mean_of_known(points) if points else F.lit(None).cast("double")


def _cents(x: Column) -> Column:
    kept = F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))  # of nulls alone greatest would make 0
    return F.round(kept.cast("decimal(20,6)"), 2).cast("decimal(5,2)")


def score(df: DataFrame, p: Profile, formula: str = "title") -> DataFrame:
    """df with components, score, bucket, filtered_reason, flags, gap_years and verdict.

    df holds coverage, similarity, title_similarity (0 to 1), min_years, seniority (a rank), city, remote, salary, closed
    and languages. Scores are DECIMAL(5,2), half up. `title` weighs the two similarities, each counted as nought where it
    is missing; `components` weighs what could be measured, with evidence that is missing kept in the divisor, and takes
    off its penalties. A filter decides the bucket before any score; the first that applies names the reason.
    """
    if formula not in ("title", "components"):
        raise ValueError(formula)
    df = df.withColumn("_lang", language_gate(F.col("languages"), p.languages))
    years = F.lit(p.total_years).cast("double")
    gap = F.col("min_years") - years
    fit = S.experience_fit(gap) * S.seniority_multiplier(F.col("seniority"), F.lit(p.seniority).cast("int"))
    df = df.withColumn("_fit", fit.cast("double")).withColumn("_log", logistics(p, F.col("remote"), F.col("city"), F.col("salary")))
    value = {"skill_coverage_required": "coverage", "semantic_similarity": "similarity", "experience_fit": "_fit", "logistics_fit": "_log", "title_similarity": "title_similarity"}
    short = F.coalesce(F.col("salary") < p.salary_min * SHORTFALL, F.lit(False)) if p.salary_min is not None else F.lit(False)
    if formula == "title":
        counted, floors = list(TITLE_WEIGHTS), TITLE_FLOORS
        raw, penalty = sum((F.coalesce(F.col(value[n]), F.lit(0.0)) * w for n, w in TITLE_WEIGHTS.items()), F.lit(0.0)) * 100, F.lit(0.0)
    else:
        counted, floors = list(WEIGHTS), FLOORS
        raw = F.coalesce(S.renormalised([(F.col(value[n]), w, n in EVIDENCE) for n, w in WEIGHTS.items()]) * 100, F.lit(0.0))
        penalty = F.col("_lang.gaps") * LANGUAGE_GAP + F.when(short, SALARY_SHORT).otherwise(0)
    reachable = F.lit(not p.locations or p.relocation) | (F.coalesce(F.col("city"), F.lit("")) == "") | (F.col("remote") == "full")
    near = F.lit(False)
    for place in p.locations:
        near = near | F.lower(F.trim("city")).contains(place.strip().lower()) | F.contains(F.lit(place.strip().lower()), F.lower(F.trim("city")))
    reason = S.first_reason(
        [
            (F.col("closed"), F.lit("вакансия закрыта для откликов")), (F.col("_lang.refusal").isNotNull(), F.col("_lang.refusal")),
            (gap > MOST_YEARS_SHORT, F.concat(F.lit("опыт: требуется "), F.format_string("%.0f", F.col("min_years").cast("double")), F.lit(f", есть {p.total_years or 0:g}"))),
            (~reachable & ~near, F.concat(F.lit("локация не совпадает: "), F.col("city"))),
        ]
    )
    shown = F.array(*[F.struct(F.lit(n).alias("key"), _cents(F.col(c) * 100).alias("value")) for n, c in value.items()])
    df = df.withColumn("components", F.map_from_entries(F.filter(shown, lambda x: x["value"].isNotNull())))
    df = df.withColumn("score", _cents(raw - penalty)).withColumn("filtered_reason", reason).withColumn("gap_years", gap)
    df = df.withColumn("bucket", F.when(F.col("filtered_reason").isNotNull(), "filtered").otherwise(bucket_of(F.col("score"), floors)))
    low = F.when(short & F.lit(formula == "title"), F.lit("зарплата ниже минимума более чем на 30%"))
    df = df.withColumn("flags", F.array_compact(F.concat(F.col("_lang.flags"), F.array(low))))
    by = F.concat_ws(", ", *[F.when(F.col(value[n]).isNotNull(), NAMES[n]) for n in counted])
    words = F.when(F.col("filtered_reason").isNotNull(), F.concat(F.lit("отфильтровано: "), "filtered_reason"))
    words = words.when(by == "", "нечего сравнивать: ни навыков, ни опыта, ни эмбеддинга").otherwise(F.concat(F.lit("считано по: "), by))
    return df.withColumn("verdict", words).drop("_lang", "_fit", "_log")
