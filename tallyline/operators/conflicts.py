"""Violations in reports, protocols and manifests: (id, issue) rows, by joins and grouped counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import characters


def issues(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, issue): a row for each check that holds; a check that is null doesn't hold."""
    return rows.select(key, F.explode(held(checks)).alias("issue"))


def held(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def repeated(rows: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """``rows`` with a flag: whether another row has the same values; counted by partial sums before the join."""
    twice = rows.groupBy(*columns).count().where("count > 1").select(*columns, F.lit(True).alias(flag))
    return rows.join(twice, columns, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


#: Names of the development part.
DEVELOPMENT = ("dev", "val", "validation")


def protocol_issues(rows: DataFrame) -> DataFrame:
    """Configurations (id, split, label_verified, label_source, weight, beam, nbest, reverse_weight) of a decoder comparison: development
    rows only, whose labels are verified and have a source; ids and weights unique, weights finite and in (0, 1], beam >= nbest >= 1, the
    reverse weight finite and in [0, 1]. A null breaks its rule."""
    both = repeated(repeated(rows, ["id"], "same_id"), ["weight"], "same_weight")
    return issues(both, "id", {
        "split": ~F.coalesce(F.col("split").isin(*DEVELOPMENT), F.lit(False)),
        "label": ~F.coalesce(F.col("label_verified") & (F.col("label_source") != ""), F.lit(False)),
        "reverse weight": ~F.coalesce(F.col("reverse_weight").between(0, 1), F.lit(False)),
        "repeated id": F.col("same_id"),
        "repeated weight": F.col("same_weight"),
        "weight": ~F.coalesce((F.col("weight") > 0) & (F.col("weight") <= 1), F.lit(False)),
        "beam": ~F.coalesce((F.col("beam") >= F.col("nbest")) & (F.col("nbest") >= 1), F.lit(False)),
    }).distinct()


def search_fits(beam: Column, pool: Column, nbest: Column, ratio: Column) -> Column:
    return F.coalesce((beam >= pool) & (pool >= nbest) & (nbest >= 1) & (ratio >= 1) & (ratio <= 4), F.lit(False))


def visual_seed(key: Column, seed: int) -> Column:
    """The sum of ``seed`` and the first eight bytes of the key's SHA-256 (big-endian), modulo 2^32: their last four suffice."""
    low = F.conv(F.substring(F.sha2(key, 256), 9, 8), 16, 10).cast("long")
    return F.pmod(low + F.lit(seed), F.lit(1 << 32)).cast("long")


def first_hypothesis(reports: DataFrame, ranked: DataFrame) -> DataFrame:
    """Reports (sample_id, raw) whose first candidate isn't ``raw``, or that have a score which isn't finite."""
    bad = F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))
    lists = ranked.groupBy("sample_id").agg(F.min_by("text", "rank").alias("first"), F.bool_or(bad).alias("bad"))
    both = reports.join(lists, "sample_id", "left")
    return issues(both, "sample_id", {"text": ~F.col("first").eqNullSafe(F.col("raw")), "score": F.col("bad")})


def selection_leaks(selection: DataFrame, test: DataFrame) -> DataFrame:
    """Rows (id, split, content) of a selection that aren't development rows, or whose id or content the test rows have."""
    ids = test.select("id").distinct().withColumn("id_there", F.lit(True))
    contents = test.select("content").distinct().withColumn("content_there", F.lit(True))
    both = repeated(selection, ["id"], "same_id").join(ids, "id", "left").join(contents, "content", "left")
    return issues(both, "id", {
        "split": ~F.coalesce(F.col("split") == "dev", F.lit(False)),
        "repeated id": F.col("same_id"), "id in test": F.col("id_there"), "content in test": F.col("content_there"),
    }).distinct()


def changed_samples(before: DataFrame, after: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """(key, issue): samples of two reports that are missing, unexpected, or differ in an identity column."""
    a = before.select(key, F.struct(*identity).alias("before"))
    b = after.select(key, F.struct(*identity).alias("after"))
    issue = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "unexpected").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, key, "full").select(key, issue.alias("issue")).where("issue is not null")


def parity_failures(rows: DataFrame, flags: list[str], single: str, batched: str, least: float = 1e-3) -> DataFrame:
    """Proof rows (id and flags) of batched scoring that are no proof: a flag not true, scores too far apart, a repeated id."""
    proof = F.coalesce(F.abs(F.col(single) - F.col(batched)) < least, F.lit(False))
    checks = {name: ~F.coalesce(F.col(name), F.lit(False)) for name in flags}
    return issues(repeated(rows, ["id"], "same_id"), "id", checks | {"scores": ~proof, "repeated id": F.col("same_id")}).distinct()


def sibling_conflicts(new: DataFrame, siblings: DataFrame) -> DataFrame:
    """New manifest rows (id, speaker, session, date, reference, split) that contradict the siblings: the speaker or reference is
    in another split, or the speaker's session has another date. Siblings count as distinct values; two of each decide. References are
    compared by their ``characters``, a null one as an empty one; a null speaker or session is nobody's."""
    new, siblings = (df.withColumn("reference", characters(F.col("reference").cast("string"))) for df in (new, siblings))

    def other(columns: list[str], value: str, flag: str) -> DataFrame:
        span = siblings.where(F.col(value).isNotNull()).groupBy(*columns).agg(F.min(value).alias("low"), F.max(value).alias("high"))
        rows = new.select("id", value, *columns).join(span, columns)
        return rows.where((F.col("low") != F.col(value)) | (F.col("high") != F.col(value))).select("id", F.lit(flag).alias("issue"))

    found = other(["speaker"], "split", "speaker").unionByName(other(["speaker", "session"], "date", "date"))
    return found.unionByName(other(["reference"], "split", "reference")).distinct()


def paired_pixels(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, status) of two runs' evidence (id, original, shape, seed, preset, output, failed): originals must be equal, outputs
    only under one preset (other presets: preprocessing); a failed row is no contradiction. Evidence that is null is unknown."""
    a, b = (df.select("id", F.struct("original", "shape", "seed").alias(f"{s}_in"), *[F.col(c).alias(f"{s}_{c}") for c in ("preset", "output", "failed")]) for df, s in ((left, "a"), (right, "b")))
    known = reduce(and_, (F.col(f"{s}_{c}").isNotNull() for s in "ab" for c in ("preset", "output", "failed", "in.original", "in.shape", "in.seed")))
    status = (
        F.when(F.col("a_in").isNull() | F.col("b_in").isNull(), "missing")
        .when(F.col("a_failed") | F.col("b_failed"), "failed")
        .when(~known, "unknown")
        .when(F.col("a_in") != F.col("b_in"), "original")
        .when((F.col("a_preset") == F.col("b_preset")) & (F.col("a_output") != F.col("b_output")), "output")
        .when(F.col("a_preset") != F.col("b_preset"), "preprocessing")
        .otherwise("same")
    )
    return a.join(b, "id", "full").select("id", status.alias("status"))


def epoch_means(steps: DataFrame, epoch: str, losses: list[str]) -> DataFrame:
    return steps.groupBy(epoch).agg(*[F.avg(x).alias(x) for x in losses])
