"""Health of a run: failure classes, reasons for empty sources, roll-ups, status ladders, votes, coverage, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import redact


def failure_class(message: Column) -> Column:
    """struct(failure_class, severity) of an error text."""
    text = redact(message)
    kind = (
        F.when(text.rlike(r"(?i)HTTP\s+(?:401|403|429)\b"), "access_blocked")
        .when(text.rlike(r"(?i)HTTP\s+5\d\d\b|abort|timeout|timed out|fetch failed|network"), "temporary_fetch_error")
        .otherwise("source_error")
    )
    return F.struct(kind.alias("failure_class"), F.when(kind == "source_error", "error").otherwise("warning").alias("severity"))


def empty_reason(ok: Column, discovers: Column, links: Column, returned: Column, fetched: Column, relevant: Column, items: Column) -> Column:
    """Why a source gave no items: the first step that lost everything."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(~ok, "source-fetch-failed")
        .when(~F.coalesce(discovers, F.lit(False)), "no-current-items")
        .when((n(returned) == 0) & (n(links) == 0), "page-contained-no-links-or-was-client-rendered")
        .when((n(returned) == 0) & (n(links) > 0), "links-found-but-none-matched-discovery-rules")
        .when((n(fetched) == 0) & (n(returned) > 0), "candidate-pages-could-not-be-fetched")
        .when((n(relevant) == 0) & (n(fetched) > 0), "candidate-pages-did-not-look-relevant")
        .when((n(items) == 0) & (n(relevant) > 0), "relevant-pages-were-not-parsed-into-items")
        .otherwise("no-current-items")
    )


def roll_up(results: DataFrame, group: list[str], ok: Column, items: str, severity: Column) -> DataFrame:
    """Checked, ok, failed, warning and error counts, items, and sources without items."""
    return results.groupBy(*group).agg(
        F.count("*").alias("checked"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.count_if(~ok & (severity == "warning")).alias("warnings"),
        F.count_if(~ok & (severity == "error")).alias("errors"),
        F.coalesce(F.sum(items), F.lit(0)).alias("items"),
        F.count_if(ok & (F.coalesce(F.col(items), F.lit(0)) == 0)).alias("empty"),
    )


def run_status(failed: Column, errors: Column, checked: Column) -> Column:
    """partial with an error (or nothing that worked), degraded with warnings only, else ok."""
    return F.when((errors > 0) | ((checked > 0) & (failed == checked)), "partial").when(failed > 0, "degraded").otherwise("ok")


def report_level(errors: Column, warnings: Column) -> Column:
    """struct(level, exit_code): errors over warnings over ok."""
    level = F.when(errors > 0, "error").when(warnings > 0, "warning").otherwise("ok")
    return F.struct(level.alias("level"), F.when(level == "error", 1).otherwise(0).alias("exit_code"))


#: What a search that found nothing means.
SEARCH_ERRORS, SEARCH_WARNINGS = ("search_failed", "candidate_fetch_failed", "parser_returned_zero"), ("no_candidates", "no_relevant_pages", "partial")


def health_report(results: DataFrame, searches: DataFrame | None = None, group: list[str] | None = None) -> DataFrame:
    """One row for each group (all, without one): level, exit_code, checked, ok, failed, annotations (array of level, title, message, by name) and table (Markdown, a line for each source).

    results: name, ok, severity (of failures: warning or error), error, items, pages. searches: the groups' columns, status: what the search for
    sources ended in. Failures that aren't warnings, no source that worked, and searches that failed are errors.
    """
    group = group or []
    failed, grave = ~F.coalesce(F.col("ok"), F.lit(False)), F.coalesce(F.col("severity"), F.lit("error")) != "warning"
    cell = lambda c: F.left(F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "[\r\n]+", " "), F.lit(180))
    level = F.when(grave, "error").otherwise("warning")
    note = F.when(failed, F.struct(F.col("name"), level.alias("level"), F.concat(F.when(grave, "取得元エラー: ").otherwise("取得元警告: "), F.coalesce("name", F.lit("不明"))).alias("title"), F.coalesce("error", F.lit("原因不明の取得エラー")).alias("message")))
    mark = F.when(~failed & (F.coalesce("items", F.lit(0)) > 0), "✅").when(failed & grave, "❌").otherwise("⚠️")
    line = F.concat(F.lit("| "), cell(F.col("name")), F.lit(" | "), mark, F.lit(" | "), cell(F.coalesce("pages", F.lit(0))), F.lit(" | "), cell(F.coalesce("items", F.lit(0))), F.lit(" |"))
    told = results.groupBy(*group).agg(
        F.count("*").alias("checked"), F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"), F.count_if(failed & grave).alias("_errors"), F.count_if(failed & ~grave).alias("_warnings"),
        F.array_sort(F.collect_list(note)).alias("_notes"), F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("_lines"),
    )
    if searches is None:
        told = told.withColumn("_search", F.lit(None).cast("string"))
    elif group:
        told = told.join(searches.select(*group, F.col("status").alias("_search")), group, "left")
    else:
        told = told.withColumn("_one", F.lit(1)).join(searches.agg(F.max("status").alias("_search")).withColumn("_one", F.lit(1)), "_one", "left")
    errors = (F.col("_errors") > 0) | ((F.col("checked") > 0) & (F.col("ok") == 0)) | F.coalesce(F.col("_search").isin(*SEARCH_ERRORS), F.lit(False))
    warnings = (F.col("_warnings") > 0) | F.coalesce(F.col("_search").isin(*SEARCH_WARNINGS), F.lit(False))
    worst = F.when(errors, "error").when(warnings, "warning").otherwise("ok")
    notes = F.transform("_notes", lambda n: F.struct(n["level"], n["title"], n["message"]))
    head = F.lit("| source | state | pages | items |\n|---|---|---|---|\n")
    return told.select(*group, worst.alias("level"), F.when(errors, 1).otherwise(0).alias("exit_code"), "checked", "ok", "failed", notes.alias("annotations"), F.concat(head, F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")).alias("table"))


def quality_summary(rows: DataFrame, status: str) -> DataFrame:
    """Candidates by status: published, duplicate, review, rejected."""
    return rows.agg(F.count("*").alias("candidates"), *[F.count_if(F.col(status) == s).alias(s) for s in ("published", "duplicate", "review", "rejected")])


def vote(replies: DataFrame, key: str, accepted: str, confidence: str, ok: str) -> DataFrame:
    """Majority of the replies that came: accepted when at least half (rounded up) accept; mean confidence of those; no replies accept."""
    good = F.coalesce(F.col(ok), F.lit(False))
    yes = good & F.coalesce(F.col(accepted), F.lit(False))
    return replies.groupBy(key).agg(
        F.count_if(good).alias("replies"),
        F.count_if(yes).alias("accepting"),
        (F.count_if(yes) >= F.ceil(F.count_if(good) / F.lit(2))).alias("accepted"),
        F.round(F.avg(F.when(yes, F.col(confidence))), 4).alias("confidence"),
    )


def coverage(rows: DataFrame, has: Column, group: list[str] | None = None) -> DataFrame:
    """Rows, rows that have it, and the share in percent, one decimal (100 for no rows)."""
    share = F.when(F.count("*") == 0, F.lit(100.0)).otherwise(F.round(F.lit(100.0) * F.count_if(has) / F.count("*"), 1))
    return rows.groupBy(*(group or [])).agg(F.count("*").alias("total"), F.count_if(has).alias("present"), share.alias("percent"))


def completeness(*cols: Column) -> Column:
    """How many of the fields are filled."""
    total = F.lit(0)
    for c in cols:
        total = total + F.when(F.coalesce(c.cast("string"), F.lit("")) != "", 1).otherwise(0)
    return total


def report_lines(rows: DataFrame, columns: list[str], order: str, most: int = 200) -> list[str]:
    """A Markdown table of the first `most` rows: a report's size, whatever the input."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\r", " ").replace("\n", " ")
    out = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return out + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows.select(*columns).orderBy(order).limit(most).collect()]
