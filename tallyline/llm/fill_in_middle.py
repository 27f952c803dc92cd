"""Fill-in-middle documents: texts cut at two places between lines, their parts put in another order behind markers.

An Arrow-batched pandas UDF does it: ``finditer`` of the regex library collects where each unit ends in a compact array of
64-bit offsets, two lookups in it give the parts as slices of the text, and hashlib gives the seeds. Each row stands by
itself: nothing is shuffled, and a lost task is run again with the same outcome, since all draws are hashes of doc_id.

Units are lines by default (``[^\\n]*\\n|[^\\n]+``); any pattern whose matches cover the text may be given. The draws h1 to h4 are
the first four 8-digit groups of the hex sha256 of ``seed:`` and the decimal doc_id. The prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger.

Defined cases: a null text is an empty one; an empty text, one that holds a marker, and those that h3 leaves out stay plain (no
cuts, prefix_chars and middle_chars null); parts may be empty; a null doc_id draws as ``seed:`` alone; rows that repeat a doc_id
are rows of their own with the same draws; other columns are ignored, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_only

#: Markers of prefix, suffix and middle. No marker overlaps another or itself, so parts without markers are found again.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
#: Bytes of an Arrow batch.
BATCH_BYTES = 16 << 20
SHAPE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The four draws of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def unit_ends(units: regex.Pattern, text: str) -> array:
    """0, and where each unit ends: the k-th entry is where the first k units end."""
    return array("q", (0, *(m.end() for m in units.finditer(text))))


def transformed_text(text: str, h: list[int], units: regex.Pattern, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and output of one text."""
    ends = unit_ends(units, text)
    n = len(ends) - 1
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ends[first], ends[second]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored_text(output: str, form: str) -> str:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    lead, inner = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at, last = output.index(inner), output.index(MIDDLE)
    first, second, middle = output[len(lead) : at], output[at + len(inner) : last], output[last + len(MIDDLE) :]
    prefix, suffix = (second, first) if form == "spm" else (first, second)
    return f"{prefix}{middle}{suffix}"


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, units: str = LINES) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    ``rate`` percent of the texts are cut, and ``spm`` percent of these have the suffix first."""
    small_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.pandas_udf(SHAPE)
    def fim(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(units)
        for ids, texts in batches:
            rows = [transformed_text(t, draws(seed, None if i is None else int(i)), pattern, rate, spm) for i, t in zip(ids, texts, strict=True)]
            found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # ids as text: pandas has no null among integers
    return text_only(docs).select("doc_id", fim(F.col("doc_id").cast("string"), "text").alias("made")).select("doc_id", "made.*")


def digests(made: DataFrame) -> DataFrame:
    """``made`` with output_sha256 and restored_sha256 (of the text rebuilt from output and form) in place of output."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def both(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        name = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return pd.DataFrame({"output_sha256": [name(o) for o in outputs], "restored_sha256": [name(restored_text(o, f)) for o, f in zip(outputs, forms, strict=True)]})

    return made.withColumn("digests", both("output", "form")).select(*(c for c in made.columns if c != "output"), "digests.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
  ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(list_slice(units, 1, a), '') AS p, array_to_string(list_slice(units, a + 1, b), '') AS m, array_to_string(list_slice(units, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""
