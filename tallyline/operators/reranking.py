"""Statistics of a personal corpus, and reranking by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token), a row per word."""
    return df.select(key, F.posexplode(words(F.col(text))).alias("pos", "token"))


def unigrams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(token, n, documents). Words are counted by document first, which mostly happens before any shuffle."""
    own = tokens(df, key, text).where(F.col(key).isNotNull()).groupBy("token", key).agg(F.count("*").alias("n"))
    return own.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


def bigrams(df: DataFrame, text: str) -> DataFrame:
    """(a, b, n) of neighbouring words, with <s> before the first."""
    own = F.concat(F.array(F.lit("<s>")), words(F.col(text)))
    pairs = F.arrays_zip(own.alias("a"), F.slice(own, 2, F.size(own)).alias("b"))
    return df.select(F.explode(pairs).alias("p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


def bigram_scores(candidates: DataFrame, key: str, text: str, corpus: DataFrame, corpus_text: str) -> DataFrame:
    """(key, score): mean log of 0.6 * P(b | a) + 0.4 * (count(b) + 0.1) / (N + 0.1 V) over the candidate's bigrams."""
    two = bigrams(corpus, corpus_text)
    one = two.groupBy(F.col("b").alias("b1")).agg(F.sum("n").alias("nb"))
    before = two.groupBy(F.col("a").alias("a1")).agg(F.sum("n").alias("na"))
    total = one.agg(F.sum("nb").alias("all"), F.count("*").alias("kinds"))
    own = F.concat(F.array(F.lit("<s>")), words(F.col(text)))
    pairs = candidates.select(key, F.explode(F.arrays_zip(own.alias("a"), F.slice(own, 2, F.size(own)).alias("b"))).alias("p")).select(key, F.col("p.a").alias("a"), F.col("p.b").alias("b")).where("b is not null")
    joined = pairs.join(two, ["a", "b"], "left").join(before, F.col("a") == F.col("a1"), "left").join(one, F.col("b") == F.col("b1"), "left").crossJoin(F.broadcast(total))  # total is one row
    p = 0.6 * F.coalesce(F.col("n") / F.col("na"), F.lit(0.0)) + 0.4 * (F.coalesce("nb", F.lit(0)) + 0.1) / (F.col("all") + 0.1 * F.col("kinds"))
    return joined.groupBy(key).agg(F.avg(F.log(p)).alias("score"))


def similar(queries: DataFrame, phrases: DataFrame, most: int = 3, least: float = 2.0) -> DataFrame:
    """(q, i, score): phrases that share words with a query, by the sum of ln(n / df); ties go to the later phrase.

    Words that all phrases have weigh nothing and aren't joined on. Others are, also common ones: three of weight under ln 2 may pass
    ``least`` together, so the join's work grows with how often a word that queries share occurs; scores are summed before the shuffle by pair."""
    n = phrases.count()
    own = tokens(phrases, "i", "text").select("i", "token").distinct()
    df = own.groupBy("token").agg(F.count("*").alias("df"))
    idf = own.join(df.where(F.col("df") < n).select("token", F.log(F.lit(float(max(n, 1))) / F.col("df")).alias("idf")), "token")
    asked = tokens(queries, "q", "text").select("q", "token").distinct()
    scores = asked.join(idf, "token").groupBy("q", "i").agg(F.round(F.sum("idf"), 9).alias("score")).where(F.col("score") > least)
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("i")))).where(F.col("place") <= most)


def reranked(ranked: DataFrame, logprob: Column, penalty: float = 0.35) -> DataFrame:
    """The list by logprob - penalty * rank, ties by rank; a list of one stays."""
    return ranked.withColumn("new_score", logprob - penalty * F.col("rank")).withColumn("new_rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("new_score"), "rank")))


def by_own_words(ranked: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Stable order by the number of a user's own terms that a candidate holds."""
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.contains(F.concat(F.lit(" "), F.lower(F.col(text)), F.lit(" ")), F.lit(f" {t.lower()} ")).cast("int")
    return ranked.withColumn("hits", hits).withColumn("new_rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("hits"), "rank")))


def distinctive(df: DataFrame, key: str, text: str, n: int, stop: list[str]) -> DataFrame:
    """The n commonest words longer than 2 that are no stop words; only the n + 200 commonest of all are looked at."""
    top = unigrams(df, key, text).orderBy(F.desc("n"), "token").limit(n + 200)
    return top.where((F.length("token") > 2) & ~F.col("token").isin(*stop)).orderBy(F.desc("n"), "token").limit(n).select("token", "n")


def suggested_names(df: DataFrame, key: str, text: str, known: list[str], most: int = 200) -> DataFrame:
    """(word, caps, plain): of the ``most`` words that are most often capitalised behind a text's first word, those with 3 such places or more, more
    than in lower case, and not ``known`` (in lower case).

    Spellings count by themselves; words in capitals and forms of I don't. Equal counts go by the first place, by ``key``, then in the text."""
    found = df.select(F.col(key).alias("row"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z][A-Za-z0-9'\-]+)"), F.lit(1))).alias("at", "w"))
    small = F.lower("w")
    capital = F.col("w").rlike("^[A-Z]") & (F.col("at") > 0) & (F.col("w") != F.upper("w")) & ~small.isin("i", "i'm", "i'll", "i've", "i'd")
    counts = found.groupBy("w").agg(F.count_if(capital).alias("caps"), F.count_if(F.col("w") == small).alias("plain"), F.min(F.when(capital, F.struct("row", "at"))).alias("first"))
    top = counts.where("caps > 0").orderBy(F.desc("caps"), "first").limit(most).where("caps >= 3")
    lower = counts.where("plain > 0").select(F.col("w").alias("k"), F.col("plain").alias("n"))
    both = top.select(F.col("w").alias("word"), "caps", F.lower("w").alias("k")).join(lower, "k", "left").withColumn("plain", F.coalesce("n", F.lit(0)))
    return both.where((F.col("plain") < F.col("caps")) & ~F.col("k").isin(*known)).select("word", "caps", "plain")


def mapped_vocabulary(tokens_: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each token with its id, -1 for unknown ones."""
    return tokens_.join(vocabulary.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", F.lit(-1)))


def perplexity(losses: DataFrame, *by: str) -> DataFrame:
    """exp(sum of losses / number of tokens)."""
    return losses.groupBy(*by).agg(F.exp(F.sum("nll") / F.greatest(F.sum("tokens"), F.lit(1))).alias("perplexity"))
