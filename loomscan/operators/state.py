"""Finding state: triage, suppression, ignore globs, overrides, audit trail, as keyed tables joined at query time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.schemas import DISMISSED, SEVERITIES
from loomscan.sources.stores import checked


def rank(severity: Column) -> Column:
    """0 for the worst; unknown severities have none and fail every threshold."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def at_least(severity: Column, threshold: str) -> Column:
    return F.coalesce(rank(severity) <= SEVERITIES.index(threshold), F.lit(False)) if threshold in SEVERITIES else F.lit(False)


def unexpired(rules: DataFrame, now: Column) -> DataFrame:
    return rules.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def with_triage(issues: DataFrame, triage: DataFrame) -> DataFrame:
    """Each finding's state, `open` where nobody triaged it."""
    return issues.join(triage.select("app_id", "fingerprint", "state"), ["app_id", "fingerprint"], "left").withColumn("state", F.coalesce("state", F.lit("open")))


def rule_condition(rules: DataFrame) -> Column:
    return (F.col("rule_category").isin("any") | (F.col("rule_category") == F.col("category"))) & F.expr("file rlike regex")


def suppressed(issues: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Findings that an unexpired rule hides; rules are few, so the theta join is a nested loop over a small side."""
    return issues.join(unexpired(rules, now), rule_condition(rules), "left_semi")


def active(issues: DataFrame, triage: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Findings that are neither dismissed nor suppressed: one view for counts, pages and gates alike."""
    dismissed = triage.where(F.col("state").isin(DISMISSED)).select("app_id", "fingerprint")
    return issues.join(dismissed, ["app_id", "fingerprint"], "left_anti").join(unexpired(rules, now), rule_condition(rules), "left_anti")


def upsert(log: DataFrame) -> DataFrame:
    """Triage table from an event log (app_id, fingerprint, state, assignee, updated_at): the last event of a key
    holds; `open` without an assignee removes it."""
    last = Window.partitionBy("app_id", "fingerprint").orderBy(F.desc("updated_at"), F.desc("state"))
    return log.withColumn("rn", F.row_number().over(last)).where("rn = 1 and not (state = 'open' and coalesce(assignee, '') = '')").drop("rn")


def gate(active_issues: DataFrame, threshold: str) -> DataFrame:
    """(app_id, failing): whether any active finding is at the threshold or worse."""
    return active_issues.groupBy("app_id").agg(F.bool_or(at_least(F.col("severity"), threshold)).alias("failing"))


def described(fields: DataFrame, overrides: DataFrame, enriched: DataFrame, keys: list[str], default: str = "") -> DataFrame:
    """Descriptions by precedence: a person's, then a generated one, then the placeholder."""
    out = fields.join(overrides.withColumnRenamed("text", "__own"), keys, "left").join(enriched.withColumnRenamed("text", "__made"), keys, "left")
    return out.withColumn("description", F.coalesce(F.nullif("__own", F.lit("")), F.nullif("__made", F.lit("")), F.lit(default))).drop("__own", "__made")


#: A suppression may last this long at most.
MOST_DAYS = 365


def rule_constraints(now: Column) -> list[tuple[str, Column]]:
    """What a suppression rule or ignore pattern (pattern, reason, expires_at) must meet to be written."""
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    at = F.col("expires_at")
    return [
        ("a pattern is required", filled("pattern")), ("a reason is required", filled("reason")), ("an expiry is required", at.isNotNull()),
        ("the expiry must lie in the future", at.isNull() | (at > now)), (f"the expiry must lie within {MOST_DAYS} days", at.isNull() | (at <= now + F.expr(f"interval {MOST_DAYS} days"))),
    ]


def checked_rules(rules: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rules that may be written, with a blank category as `any`; rejects with their reasons)."""
    category = F.coalesce(F.nullif(F.trim("rule_category"), F.lit("")), F.lit("any"))
    return checked(rules.withColumn("rule_category", category), rule_constraints(now))


def checklist(apps: DataFrame, manual: DataFrame, triage: DataFrame, rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """(app_id, item, done, auto) of an app's four first steps: a scan done, a finding fixed, a gate set, suppression understood.

    apps (app_id, status, scanned_at, fail_on), manual (app_id, gate_acknowledged, suppression_acknowledged): the last two steps
    count as done when a person says so. Signals are asked for app by app before they are joined, so no side multiplies.
    """
    some = lambda df, name: df.select("app_id").distinct().withColumn(name, F.lit(True))
    out = apps.join(manual.select("app_id", "gate_acknowledged", "suppression_acknowledged"), "app_id", "left")
    for side, name in ((triage.where("state = 'fixed'"), "fixed"), (rules.select("app_id").unionByName(patterns.select("app_id")), "suppressed")):
        out = out.join(some(side, name), "app_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    gate = yes((F.coalesce("fail_on", F.lit("")) != "") & (F.col("fail_on") != "Critical"))
    suppressed = yes(F.col("suppressed"))
    step = lambda name, done, auto: F.struct(F.lit(name).alias("item"), done.alias("done"), auto.alias("auto"))
    steps = F.array(
        step("firstScan", yes((F.col("status") == "Done") & F.col("scanned_at").isNotNull()), F.lit(True)), step("firstFix", yes(F.col("fixed")), F.lit(True)),
        step("ciGate", gate | yes(F.col("gate_acknowledged")), gate), step("suppression", suppressed | yes(F.col("suppression_acknowledged")), suppressed),
    )
    return out.select("app_id", F.explode(steps).alias("x")).select("app_id", "x.*")


def checked_rule(reason: str, expires: str | None, now: str) -> None:
    """A rule needs a reason, and an expiry within a year from now."""
    from datetime import datetime, timedelta

    if not reason.strip():
        raise ValueError("a reason is required")
    if expires is not None:
        at, start = datetime.fromisoformat(expires), datetime.fromisoformat(now)
        if not start < at <= start + timedelta(days=365):
            raise ValueError("the expiry must lie within the next 365 days")
