"""Runs of days, coverage of spans of days, and quests judged by a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import calendar as cal


def islands(days: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """(key, first, last, n) of runs of consecutive days."""
    distinct = days.select(*key, day).distinct()
    anchor = F.date_sub(F.col(day), F.row_number().over(W.partitionBy(*key).orderBy(day)))
    return distinct.withColumn("anchor", anchor).groupBy(*key, "anchor").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").cast("int").alias("n")).drop("anchor")


def streak(days: DataFrame, key: list[str], today: Column, day: str = "day", guard: int = 400) -> DataFrame:
    """(key, streak): days in a row up to today, or to yesterday if today is missing; 0 else."""
    now = F.when((F.col("last") >= today) & (F.col("first") <= today), F.datediff(today, "first") + 1).when(F.col("last") == F.date_sub(today, 1), F.col("n")).otherwise(0)
    return islands(days, key, day).groupBy(*key).agg(F.least(F.lit(guard), F.max(now)).alias("streak"))


def covers(days: DataFrame, spans: DataFrame, key: list[str], today: Column, day: str = "day") -> DataFrame:
    """spans (key, start, end) with ``covered``: every day from start to end is there, and the end has come."""
    inside = spans.join(days.select(*key, day).distinct(), key, "left")
    hit = F.count_if((F.col(day) >= F.col("start")) & (F.col(day) <= F.col("end")))
    n = inside.groupBy(*key, "start", "end").agg(hit.alias("n_days"))
    return n.withColumn("covered", (F.col("n_days") >= F.datediff("end", "start") + 1) & (F.col("end") <= today))


def compare(a: Column, op: Column, b: Column) -> Column:
    return F.when(op == ">=", a >= b).when(op == ">", a > b).when(op == "==", a == b).when(op == "<=", a <= b).otherwise(a < b)


#: What a rule can ask of a quest's state; each takes the state's columns and the rule's op, value and text.
ATOMS = {
    "doneCount": lambda r: compare(F.size(F.filter("entries", lambda e: F.coalesce(e["done_key"], F.lit("")) != "")), r["op"], r["value"]),
    "doneTag": lambda r: F.exists("entries", lambda e: (F.coalesce(e["done_key"], F.lit("")) != "") & (e["tag"] == r["text"])),
    "lesson": lambda r: F.trim(F.coalesce("lesson", F.lit(""))) != "",
    "declared": lambda r: F.col("declared_start").isNotNull(),
    "reason": lambda r: F.col("declared_start").isNotNull() & (F.trim(F.coalesce("declared_reason", F.lit(""))) != ""),
    "streak": lambda r: compare(F.col("streak"), r["op"], r["value"]),
    "streakThrough": lambda r: F.coalesce(F.array_contains("through", r["text"]), F.lit(False)),
    "flagCount": lambda r: F.size(F.filter("entries", lambda e: F.array_contains(e["flags"], r["text"]))) >= r["value"],
    "listCount": lambda r: F.size(F.filter("entries", lambda e: e["kind"] == r["text"])) >= r["value"],
    "extra": lambda r: F.trim(F.coalesce(F.element_at("extras", r["text"]), F.lit(""))) != "",
    "extrasAll": lambda r: F.forall(F.split(r["text"], ","), lambda k: F.trim(F.coalesce(F.element_at(F.col("extras"), k), F.lit(""))) != ""),
    "timer": lambda r: F.coalesce("timer_done", F.lit(0)) >= r["value"],
    "newRecord": lambda r: F.coalesce(F.exists("attempts", lambda a: cal.number_in(a["text"]) > cal.number_in(F.element_at(F.col("extras"), "record"))), F.lit(False)),
}


def evaluate(states: DataFrame, rules: DataFrame) -> DataFrame:
    """(quest_id, label, ok) of every rule (quest_id, atom, op, value, text, label) on the quest's state; unknown atoms are false."""
    r = {c: F.col(f"rule.{c}") for c in ("op", "value", "text")}
    ok = F
    for name, atom in ATOMS.items():
        ok = ok.when(F.col("rule.atom") == name, atom(r))
    joined = states.join(rules.select("quest_id", F.struct("atom", "op", "value", "text", "label").alias("rule")), "quest_id")
    return joined.select("quest_id", F.col("rule.label").alias("label"), F.coalesce(ok.otherwise(False), F.lit(False)).alias("ok"))


def progress(evaluated: DataFrame) -> DataFrame:
    """(quest_id, satisfied, total, reportable)."""
    return evaluated.groupBy("quest_id").agg(F.count_if("ok").alias("satisfied"), F.count("*").alias("total"), F.bool_and("ok").alias("reportable"))


def best_attempt(attempts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return attempts.withColumn("value", cal.number_in(F.col(text))).groupBy(*key).agg(F.max("value").alias("best"))


def soonest(plans: DataFrame, key: list[str], day: str = "day", what: str = "what") -> DataFrame:
    return plans.groupBy(*key).agg(F.min(day).alias(day), F.min_by(what, F.struct(day, what)).alias(what))
