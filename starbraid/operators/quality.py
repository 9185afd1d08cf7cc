"""A declarative quality gate. All row-level rules of a table are one aggregate over one scan; keys and parents add one each.

A rule is a dict: id, name, layer, type, table, column, severity ('FAIL' or 'WARN'), params. Types: row_count, null_rate,
range, domain, expression, unique, duplicates, referential_integrity. params may hold a row predicate (scope), under
`predicate` or `where`, for all types but expression and referential_integrity; a domain rule has its values under
`allowed` or names a set of them under `allowed_from`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E

ROW_LEVEL = ("row_count", "null_rate", "range", "domain", "expression")
SCHEMA = (
    "rule_id string, rule_name string, layer string, rule_type string, table_name string, column_name string, severity string, rows_checked long, rows_failed long, "
    "failure_pct double, unknown_member_rows long, unknown_member_pct double, status string, description string"
)


class QualityGateError(Exception):
    """The gate is blocked: at least one rule has status FAIL."""


def scope(rule: dict) -> str | None:
    """Q9: the rows that a rule looks at."""
    p = rule.get("params", {})
    return None if rule["type"] == "expression" else p.get("where", p.get("predicate"))


def failing(rule: dict) -> Column:
    """Q2, Q4, Q5, Q6: where a row fails. NULL never fails a range, a domain or an expression."""
    p, c = rule.get("params", {}), F.col(rule["column"]) if rule.get("column") else None
    if rule["type"] == "null_rate":
        return c.isNull()
    if rule["type"] == "range":
        low = c < F.lit(p["min"]) if "min" in p else F.lit(False)
        return low | (c > F.lit(p["max"]) if "max" in p else F.lit(False))
    if rule["type"] == "domain":
        return ~c.isin(p["allowed"])
    return ~F.expr(p["predicate"])


def row_rules(table: DataFrame, rules: list[dict]) -> dict[str, tuple[int, int, int | None]]:
    """Q1, Q2, Q4, Q5, Q6 with Q9's predicates, fused: one aggregate, one row to the driver."""
    aggs = []
    for i, r in enumerate(rules):
        p = r.get("params", {})
        inside = F.expr(scope(r)) if scope(r) else F.lit(True)
        aggs.append(F.count_if(inside).alias(f"n{i}"))
        aggs.append((F.lit(0) if r["type"] == "row_count" else F.count_if(inside & failing(r))).alias(f"f{i}"))
    got, out = table.agg(*aggs).first(), {}
    for i, r in enumerate(rules):
        n, f, p = got[f"n{i}"], got[f"f{i}"], r.get("params", {})
        if r["type"] == "row_count" and not p.get("min", 0) <= n <= p.get("max", float("inf")):
            f = max(n, 1)
        out[r["id"]] = (n, f, None)
    return out


def key_rule(table: DataFrame, rule: dict) -> tuple[int, int, int | None]:
    """Q7, Q8: surplus rows, the sum of (n - 1) over the keys."""
    p = rule["params"]
    rows = table.where(scope(rule)) if scope(rule) else table
    got = rows.groupBy(*p["columns"]).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("f")).first()
    return got["n"], got["f"], None


def parent_rule(table: DataFrame, parent: DataFrame, rule: dict) -> tuple[int, int, int | None]:
    """Q3: rows without a parent (a NULL key is one) and, apart from them, rows of the Unknown member."""
    key, pk = rule["column"], rule["params"]["parent_key"]
    known = parent.select(F.col(pk).alias("pk_")).where("pk_ IS NOT NULL").distinct()
    # Count by key first: the join then meets one row a key, however skewed the fact.
    counts = table.groupBy(F.col(key).alias("k_")).agg(F.count(F.lit(1)).alias("n")).join(known, F.col("k_") == F.col("pk_"), "left")
    got = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("pk_").isNull(), F.col("n"))), F.lit(0)).alias("f"), F.coalesce(F.sum(F.when(F.col("k_") == E.UNKNOWN, F.col("n"))), F.lit(0)).alias("u")
    ).first()
    return got["n"], got["f"], got["u"]


def status(rule: dict, checked: int, failed: int, unknown: int | None) -> str:
    """Q10: rates and Unknown members have tolerances; duplicates never block."""
    p, bad = rule.get("params", {}), rule["severity"]
    if rule["type"] == "null_rate":
        return "PASS" if not checked or 100.0 * failed / checked <= p.get("max_pct", 0) else bad
    if rule["type"] == "duplicates":
        return "WARN" if failed else "PASS"
    if failed:
        return bad
    if unknown and 100.0 * unknown / max(checked, 1) > p.get("max_unknown_pct", 0):
        return "WARN"
    return "PASS"


def run(spark: SparkSession, rules: list[dict], tables: dict[str, DataFrame], named: dict[str, list] | None = None) -> DataFrame:
    """Q1-Q12: one report row a rule. A rule whose table is absent is SKIP; one that cannot be analysed has its severity;
    a failure of the cluster is raised. named: sets of values for domain rules (Q5)."""
    sets = named or {}
    rules = [r | {"params": r["params"] | {"allowed": sets[r["params"]["allowed_from"]]}} if "allowed_from" in r.get("params", {}) else r for r in rules]
    found: dict[str, tuple[int, int, int | None] | str] = {}
    for name in dict.fromkeys(r["table"] for r in rules):
        own = [r for r in rules if r["table"] == name]
        if name not in tables:
            found |= {r["id"]: "SKIP" for r in own}
            continue
        fused = [r for r in own if r["type"] in ROW_LEVEL]
        try:
            found |= row_rules(tables[name], fused) if fused else {}
        except AnalysisException:  # one rule that cannot run must not hide the others
            for r in fused:
                try:
                    found |= row_rules(tables[name], [r])
                except AnalysisException as e:
                    found[r["id"]] = f"{r['severity']}: {type(e).__name__}"
        for r in own:
            if r["type"] in ROW_LEVEL:
                continue
            try:
                if r["type"] == "referential_integrity":
                    found[r["id"]] = parent_rule(tables[name], tables[r["params"]["parent"]], r) if r["params"]["parent"] in tables else "SKIP"
                else:
                    found[r["id"]] = key_rule(tables[name], r)
            except AnalysisException as e:
                found[r["id"]] = f"{r['severity']}: {type(e).__name__}"
    rows = []
    for r in rules:
        got = found[r["id"]]
        checked, failed, unknown = (0, 0, None) if isinstance(got, str) else got
        state = got.split(":")[0] if isinstance(got, str) else status(r, checked, failed, unknown)
        share = lambda x: None if x is None else round(100.0 * x / checked, 6) if checked else 0.0  # noqa: E731, B023
        rows.append((r["id"], r.get("name", r["id"]), r.get("layer", ""), r["type"], r["table"], r.get("column"), r["severity"], checked, failed, share(failed), unknown, share(unknown), state, r.get("description", "")))
    return spark.createDataFrame(rows, SCHEMA)


def summary(report: DataFrame) -> DataFrame:
    """Q11: counts by status and the gate."""
    blocked = F.count_if(F.col("status") == "FAIL") > 0
    return report.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL", "SKIP")], F.when(blocked, "BLOCKED").otherwise("CLEAR").alias("gate"))


def enforce(report: DataFrame) -> None:
    """Q11: raise once the report exists."""
    failed = [r["rule_id"] for r in report.where("status = 'FAIL'").select("rule_id").collect()]
    if failed:
        raise QualityGateError(f"quality gate blocked by {', '.join(sorted(failed))}")


