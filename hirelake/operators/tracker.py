"""Tracker folds: letters on the oldest row, results folded into write-once and change-stamped columns, journals, confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def save_letters(applications: DataFrame, letters: DataFrame) -> DataFrame:
    """applications (id, vacancy_id, profile_id, created_at, cover_letter, rules_version) after `letters`, one for a vacancy.

    A letter goes on the vacancy's oldest row, with its rules version; a profile that the row names already stays. A
    vacancy without a row gets one: its id is minus the vacancy's. `created` tells these.
    """
    oldest = applications.groupBy("vacancy_id").agg(F.min(F.struct("created_at", "id")).getField("id").alias("id"))
    new = letters.select("vacancy_id", F.col("text").alias("_text"), F.col("profile_id").alias("_profile"), F.col("rules_version").alias("_rules"))
    placed = new.join(oldest, "vacancy_id", "left")
    hit = placed.filter("id is not null").select("id", "_text", "_profile", "_rules")
    kept = applications.join(hit, "id", "left").select(
        "id", "vacancy_id", F.coalesce("profile_id", "_profile").alias("profile_id"), "created_at", F.coalesce("_text", "cover_letter").alias("cover_letter"),
        F.coalesce("_rules", "rules_version").alias("rules_version"), F.lit(False).alias("created"),
    )
    at = applications.schema["created_at"].dataType
    made = placed.filter("id is null").select(
        (-F.col("vacancy_id")).alias("id"), "vacancy_id", F.col("_profile").alias("profile_id"), F.lit(None).cast(at).alias("created_at"),
        F.col("_text").alias("cover_letter"), F.col("_rules").alias("rules_version"), F.lit(True).alias("created"),
    )
    return kept.unionByName(made)


def _last(value: str, order: list[str], where: Column | None = None) -> Column:
    """The value of the last row in order among those where it is not null (and `where` holds)."""
    known = F.col(value).isNotNull() if where is None else F.col(value).isNotNull() & where
    return F.max(F.when(known, F.struct(*order, value))).getField(value)


def _first(value: str, order: list[str], where: Column) -> Column:
    return F.min(F.when(F.col(value).isNotNull() & where, F.struct(*order, value))).getField(value)


def fold_results(reports: DataFrame, key: str = "vacancy_id", order: tuple[str, ...] = ("at", "id")) -> DataFrame:
    """What the reports (status, reason, warning, state, letter) leave on each key's row.

    `sent` is never left again; reason and warning are the last that a report named; sent_at and sent_letter are written
    once, by the first report that has them; last_state is the last state named and last_state_at the time of the report
    that changed to it. Only aggregates with partial sums and one window over state changes.
    """
    order = list(order)
    sent = F.col("status") == "sent"
    w = W.Window.partitionBy(key).orderBy(*order)
    states = reports.filter(F.col("state").isNotNull()).withColumn("_was", F.lag("state").over(w)).filter("_was is null or _was <> state")
    changed = states.groupBy(key).agg(F.max(F.struct(*order, "state")).alias("s"))
    changed = changed.select(key, F.col("s.state").alias("last_state"), F.col(f"s.{order[0]}").alias("last_state_at"))
    folded = reports.groupBy(key).agg(
        F.when(F.bool_or(sent), "sent").otherwise(_last("status", order)).alias("agent_status"), _last("reason", order).alias("reason"), _last("warning", order).alias("warning"),
        F.min(F.when(sent, F.col(order[0]))).alias("sent_at"), _first("letter", order, sent).alias("sent_letter"),
    )
    return folded.join(changed, key, "left")


# Who may make which move, and where a journal may begin.
MOVES = {
    ("queued", "confirmed"): "human", ("queued", "skipped"): "agent", ("queued", "needs_manual"): "agent", ("queued", "failed"): "agent",
    ("confirmed", "sent"): "agent", ("confirmed", "failed"): "agent", ("confirmed", "needs_manual"): "agent", ("confirmed", "skipped"): "agent",
    ("failed", "queued"): "human", ("needs_manual", "queued"): "human", ("needs_manual", "skipped"): "human",
}
INITIAL = ("queued", "skipped", "needs_manual", "failed")


def journal(entries: DataFrame, key: str = "vacancy_id", order: tuple[str, ...] = ("at", "id")) -> DataFrame:
    """The journal's row of each key after its entries (status, actor, title, reason), with the number of refused ones.

    An entry is refused where its move is not the actor's or the first status is no beginning; a refused one changes
    nothing. Title keeps the last known value; status, reason and updated_at are the last accepted entry's. Moves depend
    on what was accepted before, so a key's entries, a handful for each vacancy, are folded in order.
    """
    items = F.sort_array(F.collect_list(F.struct(*order, "status", "actor", "title", "reason")))
    legal = F.array(*[F.lit(f"{a}>{b}>{who}") for (a, b), who in MOVES.items()])
    state = "struct<status:string,title:string,reason:string,updated_at:timestamp,first_seen_at:timestamp,refused:bigint>"
    start = F.from_json(F.lit('{"refused":0}'), state)

    def step(acc, x):
        first, same = acc["status"].isNull(), acc["status"] == x["status"]
        move = F.concat_ws(">", acc["status"], x["status"], x["actor"])
        ok = F.when(first, x["status"].isin(*INITIAL)).otherwise(same | F.array_contains(legal, move))
        pick = lambda new, old, name: F.when(ok, new).otherwise(old).alias(name)
        at = x[order[0]].cast("timestamp")
        return F.struct(
            pick(x["status"], acc["status"], "status"), pick(F.coalesce(x["title"], acc["title"]), acc["title"], "title"), pick(x["reason"], acc["reason"], "reason"),
            pick(at, acc["updated_at"], "updated_at"), pick(F.coalesce(acc["first_seen_at"], at), acc["first_seen_at"], "first_seen_at"),
            (acc["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"),
        )

    return entries.groupBy(key).agg(items.alias("_e")).select(key, F.aggregate("_e", start, step).alias("s")).select(key, "s.*")


def digest(text: Column) -> Column:
    """sha256 of a text; of none, that of the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def card_digest(**fields: Column) -> Column:
    """sha256 of the fields as JSON: keys in order, no blanks, nulls written out, letters of every script as they are."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def confirmed(at: Column, now: Column, hours: int, pairs: list[tuple[Column, Column]]) -> Column:
    """Whether a confirmation still stands: young enough, and every stored digest is that of what is there now."""
    ok = F.coalesce(at >= now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))
    for stored, actual in pairs:
        ok = ok & F.coalesce(stored == actual, F.lit(False))
    return ok


def decide_queued(archived: Column, closed: Column, external: Column) -> Column:
    """What the queue alone can rule out before a page is opened."""
    return F.when(archived | closed, "skip").when(external, "manual").otherwise("proceed")


def decide_page(applied: Column, archived: Column, closed: Column, external: Column, facts: Column, test: Column, impossible: Column, letter_due: Column, has_letter: Column, field_known: Column) -> Column:
    """What to do with a vacancy once its page is read; the first rung that holds decides. Unknown `applied` stops."""
    return (
        F.when(applied.isNull(), "manual").when(applied | archived | closed, "skip").when(external | ~facts | test | impossible, "manual")
        .when(letter_due & ~has_letter, "manual").when(letter_due & ~field_known, "manual").otherwise("proceed")
    )


def keep_spans(spans: DataFrame, key: str, low: str, high: str, most: int = 512) -> DataFrame:
    """The covered intervals of each key, merged where they touch; of more than `most`, the oldest (lowest) go."""
    from .intervals import islands

    merged = islands(spans, [key], low, high)
    return merged.withColumn("_n", F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc(low)))).filter(F.col("_n") <= most).drop("_n")


def next_steps(done: DataFrame, steps: list[str], key: str, now: Column, hours: int = 12) -> DataFrame:
    """The step at which each key's chain goes on: the first whose last success is missing or older than `hours`."""
    fresh = done.filter(F.col("ok") & (F.col("at") > now - F.expr(f"INTERVAL {hours} HOURS"))).groupBy(key).agg(F.collect_set("step").alias("_had"))
    left = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: ~F.array_contains(F.coalesce("_had", F.array().cast("array<string>")), s))
    return done.select(key).distinct().join(fresh, key, "left").select(key, F.coalesce(F.get(left, F.lit(0)), F.lit("done")).alias("step"))


def drain(backlog: DataFrame, key: str, order: list[Column], cost: str, rows: int, budget: float) -> DataFrame:
    """For each queue: rows taken in order while both the row and the cost budget last, and why it stopped."""
    w = W.Window.partitionBy(key).orderBy(*order)
    size = backlog.groupBy(key).agg(F.count("*").alias("backlog"), F.sum(F.col(cost).isNull().cast("long")).alias("unpriced"))
    ahead = backlog.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows)
    ahead = ahead.withColumn("_spent", F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    took = ahead.groupBy(key).agg(F.count_if(F.col("_spent") <= budget).alias("taken"), F.bool_or(F.col("_spent") > budget).alias("_dear"))
    stop = F.when(F.col("taken") == F.col("backlog"), "drained").when(F.col("_dear"), "time").otherwise("rows")
    return size.join(took, key).select(key, "backlog", "taken", stop.alias("stop"))
