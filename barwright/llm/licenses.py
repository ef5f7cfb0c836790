"""Licence scan by digests of canonical texts.

A text is brought to a canonical form: copyright lines go, ASCII letters are folded, equivalent spellings become one, punctuation and
white space become single spaces. Its SHA-256 is then looked up, by a hash join, among the digests of known licences. A document
is looked up as a whole, and so is each of its lines (for short notices). Only DataFrame functions.

The known texts are a small fixed list, so their side of the join is bounded by that list; only matches of lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.llm import license_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a line that only says who holds the rights
HOLDER = r"(?m)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|<|\[|by |holder:)[^\n]*|\(c\)[ \t]*(?:copyright|[0-9])[^\n]*|©[^\n]*)$"
JUNK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”„«»–—•·… ]+"
#: fixed values: spellings that licence texts use for one another
SPELLINGS = (("licenc", "licens"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("judgement", "judgment"),
             ("organis", "organiz"), ("behaviour", "behavior"), ("whilst", "while"), ("per cent", "percent"), ("sub license", "sublicense"),
             ("non infringement", "noninfringement"), ("https", "http"), ("copyright owner", "copyright holder"))


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, "(?d)" + HOLDER, F.lit(""))
    t = F.trim(F.regexp_replace(t, JUNK, F.lit(" ")))
    for found, put in SPELLINGS:
        t = F.replace(t, F.lit(found), F.lit(put))
    return t


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license: one row per known text."""
    rows = spark.createDataFrame(texts if texts is not None else license_texts.TEXTS, "license string, body string")
    return rows.groupBy(digest(F.col("body")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, digest (of the whole canonical text), license (of the whole text, or null), notices.

    ``notices`` lists, sorted and joined by commas, the licences that single lines name in full; empty where there are none. Null and
    empty texts have the digest of the empty text and match nothing. Repeated rows get equal values. Extra columns are left out.
    """
    table = known(docs.sparkSession, texts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the longest known notice bounds the lines that can match; canonical forms are never longer than twice the text
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    named = (lines.select("doc_id", "text_key", digest(F.col("line")).alias("digest")).join(table, "digest")
             .groupBy("doc_id", "text_key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices")))
    whole = rows.select("doc_id", F.xxhash64("text").alias("text_key"), digest(F.col("text")).alias("digest"))
    joined = whole.join(table, "digest", "left").alias("w").join(named.alias("n"), F.expr("w.doc_id <=> n.doc_id AND w.text_key = n.text_key"), "left")
    return joined.select("w.doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The scan of ``documents`` as SQL."""
    def form(x: str) -> str:
        t = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {_quoted(HOLDER)}, '', 'g')"
        t = f"trim(regexp_replace({t}, {_quoted(JUNK.replace(chr(92) + 'u00A0', chr(0xA0)))}, ' ', 'g'))"
        for found, put in SPELLINGS:
            t = f"replace({t}, {_quoted(found)}, {_quoted(put)})"
        return f"sha256({t})"

    values = ", ".join(f"({_quoted(name)}, {_quoted(body)})" for name, body in license_texts.TEXTS)
    return f"""WITH known AS (SELECT {form('body')} AS digest, min(license) AS license FROM (VALUES {values}) v(license, body) GROUP BY 1),
      d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
      lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
      named AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known ON known.digest = {form('line')}
                WHERE trim(line) <> '' GROUP BY r)
    SELECT d.doc_id, {form('d.text')} AS digest, known.license, coalesce(notices, '') AS notices
    FROM d LEFT JOIN known ON known.digest = {form('d.text')} LEFT JOIN named ON named.r = d.r"""
