"""Rollups over logs: counts by status, stage times, waits, model calls and their cost, evaluation scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Assumed prices in dollars for a million tokens in and out.
PRICE_IN, PRICE_OUT = 0.10, 0.50


def status_counts(rows: DataFrame, by: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """by, n, and a column of counts for each status."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(status) == v).alias(v.lower()) for v in values))


def span_seconds(rows: DataFrame, by: Sequence[str], opened: str, closed: str) -> DataFrame:
    """by, n, seconds from the first opening to the last close."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.unix_micros(F.max(closed).cast("timestamp")) - F.unix_micros(F.min(opened).cast("timestamp"))).alias("micros"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    return tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out


def model_metrics(calls: DataFrame, by: Sequence[str] = ("purpose",)) -> DataFrame:
    """by, calls, failures, tokens_in, tokens_out, cost: sums first, then prices."""
    g = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(F.col("status") != "ok").alias("failures"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return g.withColumn("cost", token_cost(F.col("tokens_in"), F.col("tokens_out")))


def verdict(expected: Column, got: Column, right: Column) -> Column:
    """The verdict of an evaluation case: expected and got are auto or escalate, right says whether what was done is the
    correct thing. What was done where a person had to decide is unsafe, even if it is right."""
    done = F.when((expected == "auto") & right, "correct_auto").otherwise("unsafe_auto")
    return F.when(got == "auto", done).when(expected == "escalate", "correct_escalate").otherwise("unnecessary_escalate")


def scores(results: DataFrame) -> DataFrame:
    """Per dimension the cases of each verdict, and accuracy: verdicts that begin with correct."""
    kinds = ("correct_auto", "correct_escalate", "unsafe_auto", "unnecessary_escalate")
    g = results.groupBy("dimension").agg(F.count("*").alias("cases"), *(F.count_if(F.col("verdict") == k).alias(k) for k in kinds))
    return g.withColumn("accuracy", (F.col("correct_auto") + F.col("correct_escalate")) / F.col("cases"))


def audit_category(actor: Column, event: Column) -> Column:
    """human, error, delivery, target, ingestion, preparation or mapping for an audit row: people first, then what the event
    is about."""
    e = F.coalesce(event, F.lit(""))
    starts = lambda *x: e.rlike(f"^(?:{'|'.join(x)})")
    return (
        F.when(actor == "human", "human").when(e.endswith("_failed") | e.isin("model_error", "ingest_checksum_mismatch"), "error")
        .when(starts("delivery", "rollback", "stale_") | (e == "migration_complete"), "delivery").when(starts("target", "employee") | e.contains("reconcil"), "target")
        .when(starts("ingest") | e.isin("queued", "file_parsed"), "ingestion").when(e.contains("preparation") | e.isin("records_prepared", "record_review_prepared"), "preparation").otherwise("mapping")
    )


def stage_seconds(events: DataFrame, by: Sequence[str] = ("job_id", "stage")) -> DataFrame:
    """by, n, seconds: the time that runs of a stage (started, ended) took together."""
    took = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.sum(took).alias("seconds"))


def portfolio(jobs: DataFrame) -> DataFrame:
    """jobs, done, failed, entities, blocked over all jobs, from a row for each (status, entities, blocked)."""
    done, failed = F.col("status").isin("migration_complete", "rollback_complete"), F.col("status").isin("error", "delivery_partial_failure", "rollback_partial_failure")
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"))


def plan_metrics(plans: DataFrame) -> DataFrame:
    """operation, n, settled, review of transformation plans (operation, status): what source intelligence found."""
    return plans.groupBy("operation").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "auto_accepted").alias("settled"), F.count_if(F.col("status") == "needs_review").alias("review"))
