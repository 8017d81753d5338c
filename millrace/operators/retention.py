"""Retention as an ordered list of rules over named tables: each deletes rows or changes them, and the next sees what it has left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Rows of a table that `where` holds for and whose `column` is older than so many days (either may be left out) go, or are set to `values`.

    keys: column of this table and (table, column, condition) of another; such a row goes if its key is
    among the other's rows (inside) or not among them (not inside), null keys never.
    """

    table: str
    where: str = "true"
    column: str | None = None
    days: int = 0
    values: Mapping[str, str] = field(default_factory=dict)
    keys: tuple[str, str, str, str] | None = None
    inside: bool = True


#: The days that each kind of row is kept, in the order that the rules run in.
RULES = (
    Rule("applications", "status = 'active'", "applied_date", 60, {"status": "'closed'"}),
    Rule("application_recruiters", keys=("application_id", "applications", "id", "status = 'closed'")),
    Rule("ai_cache", "expires_at <= as_of"),
    Rule("jobs", column="created_at", days=21),
    Rule("model_usage", column="date", days=21),
    Rule("outreach", "status = 'sent'", "sent_at", 30),
    Rule("outreach", "status = 'pending'", "scheduled_for", 30),
    Rule("outreach", "status IN ('failed', 'bounced', 'cancelled')", "created_at", 30),
    Rule("job_postings", "status IN ('new', 'digested')", "first_seen", 7, {"status": "'expired'", "description": "NULL"}),
    Rule("job_postings", "status = 'dismissed'", "first_seen", 30),
    Rule("job_postings", "status = 'applied'"),
    Rule("job_postings", "status = 'filled'", "stale_since", 7),
    Rule("search_quota", column="date", days=30),
    Rule("quota_alerts", column="created_at", days=30),
    Rule("monitor_stats", column="date", days=60),
    Rule("verify_filled_stats", column="date", days=60),
    Rule("coverage_stats", column="date", days=60),
    Rule("api_health", column="date", days=60),
    Rule("worker_scaling_events", column="occurred_at", days=90),
    Rule("pipeline_alerts", "notified = 1", "notified_at", 30),
    Rule("custom_ats_diagnostics", "resolved = 0", "created_at", 60, {"resolved": "1", "resolved_at": "as_of"}),
    Rule("custom_ats_diagnostics", "resolved = 1", "coalesce(resolved_at, created_at)", 30),
    Rule("custom_ats_inspection", keys=("company", "prospective_companies", "company", "true"), inside=False),
    Rule("seen_job_ids", keys=("company", "prospective_companies", "company", "true"), inside=False),
    Rule("seen_job_ids", column="last_polled", days=90),
    Rule("unmatched_emails", column="created_at", days=30),
)


def retained(tables: Mapping[str, DataFrame], as_of: str, rules: Sequence[Rule] = RULES) -> dict[str, DataFrame]:
    """What is left of each table after the rules, in order; tables that no rule names stay, rules for tables that aren't there are passed over."""
    left = dict(tables)
    moment = F.lit(as_of).cast("timestamp")
    for rule in rules:
        if rule.table not in left:
            continue
        rows = left[rule.table]
        at = lambda text: F.expr(text.replace("as_of", f"TIMESTAMP '{as_of}'"))
        hit = at(rule.where)
        if rule.column:
            hit = hit & (at(rule.column).cast("timestamp") < moment - F.make_dt_interval(F.lit(rule.days)))
        hit = F.coalesce(hit, F.lit(False))
        if rule.values:
            left[rule.table] = rows.withColumns({c: F.when(hit, at(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in rule.values.items()})
        elif rule.keys:
            own, table, other, condition = rule.keys
            if table not in left:
                continue
            keys = left[table].where(condition).select(F.col(other).alias(own)).distinct()
            # a null key is neither among others nor not among them
            left[rule.table] = rows.join(keys, own, "left_anti") if rule.inside else rows.join(keys, own, "left_semi").unionByName(rows.where(F.col(own).isNull()))
        else:
            left[rule.table] = rows.where(~hit)
    return left
