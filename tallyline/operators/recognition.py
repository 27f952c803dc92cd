"""Recognised tokens: candidates out of a beam, error rates of token ids, summaries and gates of runs. Built-in functions; a vocabulary is one literal array."""

from __future__ import annotations

from collections.abc import Callable
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edit import distance, token_distance
from ..functions.text import characters, decoded
from .scoring import ratio

#: Entries of a vocabulary that a plan may hold (a few hundred KB).
MOST_TOKENS = 65_536


def spellings(vocabulary: list[str]) -> Column:
    """The vocabulary as one array that Spark folds into a literal; ids are places from 0."""
    if len(vocabulary) > MOST_TOKENS or any("\n" in t for t in vocabulary):
        raise ValueError(f"a vocabulary has at most {MOST_TOKENS} tokens, without line ends")
    return F.split(F.lit("\n".join(vocabulary)), "\n")


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))


def beam_candidates(beams: DataFrame, vocabulary: list[str], pool: int) -> DataFrame:
    """(utterance, rank, text, tokens, score, forced, trailing, skip, issue): the first ``pool`` different texts of each utterance's beam, in order.

    ``beams`` are (utterance, place, tokens, score, forward, ctc, frames), place unique in its utterance. The vocabulary's last token is start and end alike. Tokens
    lose the start and all ends behind (trailing: how many), and are spelled and cleaned. A hypothesis is forced if it has two tokens more than frames; one such in the
    whole beam, even beyond the pool or repeated, has all the utterance's candidates skip reverse scoring. Empty texts and texts that came before are left out. A beam
    with a hypothesis without its boundaries (or null), with a token that isn't over 0 and under the last, or, where the text is new, with a score that isn't finite (a
    null forward or ctc is 0) has one row: the first such issue, without a rank. An utterance's beam is bounded by the search, so one shuffle brings it together."""
    t, end = F.col("tokens"), F.lit(len(vocabulary) - 1)
    spelled = spellings(vocabulary)
    bounded = F.coalesce((F.size(t) >= 2) & (F.get(t, F.lit(0)) == end) & (F.element_at(t, -1) == end), F.lit(False))
    last = F.array_position(F.transform(F.reverse(t), lambda x: x != end), True)
    trailing = F.when(last == 0, F.size(t) - 1).otherwise(last - 1).cast("int")
    own = beams.withColumns({"bounded": bounded, "trailing": F.when(bounded, trailing)})
    own = own.withColumn("body", F.when(F.col("bounded"), F.slice(t, F.lit(2), F.size(t) - 1 - F.col("trailing"))))
    usable = F.forall("body", lambda x: F.coalesce((x > 0) & (x < end), F.lit(False)))
    own = own.withColumns({
        "usable": usable, "text": decoded(F.array_join(F.transform("body", lambda x: F.get(spelled, x.cast("int"))), "")),
        "forced": F.col("bounded") & F.coalesce(F.size(t) == F.col("frames") + 2, F.lit(False))})
    beam = Window.partitionBy("utterance")
    fresh = (F.col("text") != "") & (F.row_number().over(Window.partitionBy("utterance", "text").orderBy("place")) == 1)
    seen = own.repartition("utterance").withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    sound = _finite(F.col("score")) & _finite(F.coalesce("forward", F.lit(0.0))) & _finite(F.coalesce("ctc", F.lit(0.0)))
    issue = F.when(~F.col("bounded"), "boundary").when(~F.col("usable"), "token").when(F.col("fresh") & ~sound, "evidence")
    seen = seen.withColumn("own_issue", issue).withColumns({
        "first": F.min(F.when(F.col("own_issue").isNotNull(), F.struct("place", "own_issue"))).over(beam),
        "skip": F.bool_or("forced").over(beam), "rank": F.sum(F.col("fresh").cast("int")).over(beam.orderBy("place")).cast("int")})
    fine = F.col("first").isNull()
    kept = seen.where((fine & F.col("fresh") & (F.col("rank") <= pool)) | (F.col("first.place") == F.col("place")))
    good = lambda c: F.when(fine, F.col(c)).alias("tokens" if c == "body" else c)
    return kept.select("utterance", *map(good, ("rank", "text", "body", "score", "forced", "trailing", "skip")), F.col("first.own_issue").alias("issue"))


def token_rates(rows: DataFrame, vocabulary: list[str], space: str, blank: str, *by: str) -> DataFrame:
    """cer, wer and cer_ctc, pooled, of recognised and reference token ids (hyp, ref; -1 pads).

    cer and wer: the recognised ids are read up to the reference's first padding; the space symbol becomes a space, the blank goes from what was recognised. cer is of
    characters without spaces, wer of words. cer_ctc: runs of an id become one, padding, blanks and spaces go, and rows whose reference is then empty don't
    count; they do in the others. -1 in what was recognised is the last token, an id beyond the vocabulary nothing; null arrays are empty. A rate of nothing is null."""
    spelled, n = spellings(vocabulary), len(vocabulary)
    left_out = [vocabulary.index(blank)] + ([vocabulary.index(space)] if space in vocabulary else [])
    hyp, ref = (F.coalesce(F.col(c), F.array().cast("array<int>")) for c in ("hyp", "ref"))
    text = lambda ids: F.array_join(F.transform(ids, lambda i: F.get(spelled, F.when(i < 0, i + n).otherwise(i).cast("int"))), "")
    padding = F.array_position(ref, -1)
    read = F.slice(hyp, F.lit(1), F.when(padding > 0, padding - 1).otherwise(F.size(ref)).cast("int"))
    told = lambda ids: F.replace(text(ids), F.lit(space), F.lit(" "))
    joined = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    bare = lambda ids: text(F.filter(ids, lambda i: (i != -1) & ~i.isin(*left_out)))
    runs = F.filter(hyp, lambda x, i: (i == 0) | (x != F.get(hyp, i - 1)))
    each = rows.select(*by, F.replace(told(read), F.lit(blank), F.lit("")).alias("h"), told(F.filter(ref, lambda i: i != -1)).alias("r"), bare(runs).alias("ch"), bare(ref).alias("cr"))
    sums = each.groupBy(*by).agg(
        F.sum(distance(joined("h"), joined("r"))).alias("c"), F.sum(F.length(joined("r"))).alias("nc"), F.sum(token_distance(words("h"), words("r"))).alias("w"), F.sum(F.size(words("r"))).alias("nw"),
        F.sum(F.when(F.col("cr") != "", distance(F.col("ch"), F.col("cr")))).alias("b"), F.sum(F.length("cr")).alias("nb"))
    rate = lambda a, b: ratio(F.col(a), F.col(b))
    return sums.select(*by, rate("c", "nc").alias("cer"), rate("w", "nw").alias("wer"), rate("b", "nb").alias("cer_ctc"))


def run_summary(rows: DataFrame, *by: str, key: Callable[[Column], Column] = characters) -> DataFrame:
    """Figures of runs: rows (reference, raw, action, error) count with what was recognised, offered or not; failed and missing rows stay in every denominator."""
    keyed = rows.withColumns({"_r": key(F.coalesce("reference", F.lit(""))), "_h": key(F.coalesce("raw", F.lit("")))})
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    offered = (F.col("_h") != "") & ~F.coalesce(F.col("action") == "retry", F.lit(False)) & ~failed
    sums = keyed.groupBy(*by).agg(
        F.count("*").alias("samples"), F.sum(distance(F.col("_h"), F.col("_r"))).alias("errors"), F.sum(F.length("_r")).alias("characters"), F.count_if(F.col("_h") == F.col("_r")).alias("exact"),
        F.count_if(offered).alias("offered"), F.count_if(failed).alias("failures"))
    return sums.withColumns({"cer": ratio(F.col("errors"), F.col("characters")), "exact_rate": ratio(F.col("exact"), F.col("samples")), "coverage": ratio(F.col("offered"), F.col("samples"))})


def transform_summary(rows: DataFrame, by: str) -> DataFrame:
    """Pooled figures of each transform of a grid from its scored rows (errors, characters, exact, error); blank and failed rows count."""
    sums = rows.groupBy(by).agg(F.count("*").alias("samples"), F.sum("errors").alias("errors"), F.sum("characters").alias("characters"), F.count_if("exact").alias("exact"), F.count_if(F.col("error") != "").alias("failures"))
    return sums.withColumn("cer", ratio(F.col("errors"), F.col("characters")))


def improvements_over(summaries: DataFrame, run: str, baseline: str, by: str) -> DataFrame:
    """(by, run, check, passed): whether each other run (a row of ``run_summary``) improves on the baseline of its ``by``: fewer errors a character, as many
    exact sentences and offered candidates, no failure in either. What is null isn't passed; without a baseline nothing is."""
    names = ("cer", "exact_rate", "coverage", "failures")
    base = summaries.where(F.col(run) == baseline).select(by, *(F.col(c).alias(f"b_{c}") for c in names))
    both = summaries.where(F.col(run) != baseline).join(base, by, "left")
    checks = {"cer lower": F.col("cer") < F.col("b_cer"), "exact not lower": F.col("exact_rate") >= F.col("b_exact_rate"), "coverage not lower": F.col("coverage") >= F.col("b_coverage"), "no failures": (F.col("failures") == 0) & (F.col("b_failures") == 0)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items())))
    return both.select(by, run, each.alias("x")).select(by, run, "x.*")


def preset_checks(results: DataFrame, baseline: str, clean: str) -> DataFrame:
    """Each preset of an experiment against its baseline, and which one is selected (none: the baseline stays).

    ``results`` are (experiment, preset, ord, condition, errors, characters, exact, coverage, failures). Eligible: fewer errors over all conditions, no higher rate under
    ``clean``, no fewer exact sentences and no less coverage under any, no failure on either side, and the baseline's conditions, once each. Of those with the fewest errors
    the smallest ord is selected. A null fails its check."""
    names = ("errors", "characters", "exact", "coverage", "failures")
    base = results.where(F.col("preset") == baseline).select("experiment", "condition", *(F.col(c).alias(f"b_{c}") for c in names))
    whole = base.groupBy("experiment").agg(F.count("*").alias("conditions"), F.sum("b_failures").alias("b_failed"))
    both = results.where(F.col("preset") != baseline).join(base, ["experiment", "condition"], "left")
    # rates are compared as products: sums of characters may differ
    rate = F.col("errors") * F.col("b_characters") <= F.col("b_errors") * F.col("characters")
    all_of = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    each = both.groupBy("experiment", "preset", "ord").agg(
        F.sum("errors").alias("errors"), F.coalesce(F.sum("errors") < F.sum("b_errors"), F.lit(False)).alias("pooled_lower"), all_of((F.col("condition") != clean) | rate).alias("clean_not_worse"), all_of(F.col("exact") >= F.col("b_exact")).alias("exact_not_lower"),
        all_of(F.col("coverage") >= F.col("b_coverage")).alias("coverage_not_lower"), all_of(F.col("failures") == 0).alias("own_fine"), F.count("*").alias("n"), F.count_distinct("condition").alias("kinds"))
    each = each.join(whole, "experiment", "left").withColumn("no_failures", F.col("own_fine") & F.coalesce(F.col("b_failed") == 0, F.lit(False)))
    checks = ("pooled_lower", "clean_not_worse", "exact_not_lower", "coverage_not_lower", "no_failures")
    complete = F.coalesce((F.col("n") == F.col("conditions")) & (F.col("kinds") == F.col("conditions")), F.lit(False))
    each = each.withColumn("eligible", complete)
    for c in checks:
        each = each.withColumn("eligible", F.col("eligible") & F.col(c))
    order = Window.partitionBy("experiment").orderBy(F.desc("eligible"), "errors", "ord")
    return each.withColumn("selected", F.col("eligible") & (F.row_number().over(order) == 1)).select("experiment", "preset", "errors", *checks, "eligible", "selected")


def mean_probability(words: Column) -> Column:
    """The mean of a segment's word probabilities; 0 without words."""
    return F.when(F.size(words) > 0, F.aggregate(words, F.lit(0.0), lambda a, x: a + x) / F.size(words)).otherwise(0.0)
