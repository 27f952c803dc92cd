"""Fail-closed validation: every rule is a query for the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_sha256, iso_date


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def outside(c: str, *allowed: str) -> Column:
    return ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def sample_rules() -> dict[str, Column]:
    return {
        "reference_is_blank": blank("reference"), "speaker_is_blank": blank("speaker"), "domain_is_unknown": outside("domain", "mouth_roi", "full_face", "webcam"), "split_is_unknown": outside("split", "train", "dev", "test"),
        "duration_is_not_positive": ~F.coalesce(F.col("duration_seconds") > 0, F.lit(False)), "full_face_needs_short_clip": (F.col("domain") == "full_face") & (F.col("duration_seconds") > 30), "digest_is_not_sha256": ~is_sha256(F.col("sha256")),
    }


def violations(df: DataFrame, rules: dict[str, Column] | None, key: str) -> DataFrame:
    """(key, rule) of every broken rule, all rules in one pass over the rows. Without rules those of samples hold."""
    rules = rules or sample_rules()
    broken = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def raise_if_any(found: DataFrame, most: int = 5) -> None:
    few = found.limit(most).collect()
    if few:
        raise ValueError("invalid input: " + "; ".join(str(r.asDict()) for r in few))


def interval_rules(start: str, end: str) -> dict[str, Column]:
    """A start of 0 or more, and an end (null: open) behind it."""
    return {"start_is_negative": ~F.coalesce(F.col(start) >= 0, F.lit(False)), "end_is_not_behind_start": F.col(end).isNotNull() & ~F.coalesce(F.col(end) > F.col(start), F.lit(False))}


def changed(recorded: DataFrame, computed: DataFrame, key: str, columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Recorded values (null: not recorded) that differ from the computed ones, as (key, column)."""
    both = recorded.select(key, *(F.col(c).alias(f"r_{c}") for c in columns)).join(computed.select(key, *columns), key)
    wrong = [F.when(F.col(f"r_{c}").isNotNull() & ~F.coalesce(F.abs(F.col(f"r_{c}") - F.col(c)) <= tolerance, F.lit(False)), F.lit(c)) for c in columns]
    return both.select(key, F.explode(F.array_compact(F.array(*wrong))).alias("column"))


def not_increasing(df: DataFrame, by: str, ts: str) -> DataFrame:
    """Keys whose times, in frame order, don't strictly increase or aren't finite."""
    w = Window.partitionBy(by).orderBy("frame_no")
    bad = F.isnan(ts) | F.col(ts).isNull() | (F.abs(ts) == float("inf")) | (F.lag(ts).over(w) >= F.col(ts))
    return df.withColumn("_bad", bad).where("_bad").select(by).distinct()


def changed_files(plan: DataFrame, seen: DataFrame) -> DataFrame:
    """Frozen files whose digest is another one now, or that are gone."""
    return plan.join(seen.select("path", F.col("sha256").alias("now")), "path", "left").where("now is null or now <> sha256").select("path", F.coalesce("now", F.lit("missing")).alias("now"))


def entity_violations(df: DataFrame, norm) -> DataFrame:  # noqa: ANN001
    """Prompts with an entity of an unknown kind, or whose text isn't in the reference (both normalised)."""
    kind = F.exists("entities", lambda e: ~e["kind"].isin("number", "person_name"))
    gone = F.exists("entities", lambda e: ~F.contains(norm(F.col("reference")), norm(e["text"])))
    return violations(df, {"entity_kind_is_unknown": kind, "entity_is_not_in_reference": gone, "reference_is_blank": norm(F.col("reference")) == ""}, "id")


def date_violations(df: DataFrame, column: str, key: str) -> DataFrame:
    return violations(df, {"date_is_not_iso": ~iso_date(F.col(column))}, key)


def all_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a & b, flags)
