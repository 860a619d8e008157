"""Licence scan: canonical digests of whole texts, hash-joined to those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NOTICES, SPELLINGS, variants

#: A line that only says who holds the copyright: it opens with the word or a sign, perhaps after marks of a comment.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|by )|\(c\)[ \t]+|©|all rights reserved)[^\n]*$"
NO_WORD = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """Canonical form of a text, line by line: lower case, no copyright lines, no punctuation, equal spellings.

    Two spaces stand between words, so that neighbours do not share one while spellings are made equal.
    """
    # (?d): a line ends at a line feed only.
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?d)" + COPYRIGHT_LINE, "")
    c = F.concat(F.lit(" "), F.replace(F.regexp_replace(c, NO_WORD, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    return _respelt(c, [p for p in SPELLINGS if " " not in p[0]])


def _respelt(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for found, put in pairs:
        c = F.replace(c, F.lit(f" {found.replace(' ', '  ')} "), F.lit(f" {put.replace(' ', '  ')} "))
    return c


def _line(c: Column) -> Column:
    """A canonical line (or text without line ends) as words with single spaces; phrases are made equal here."""
    return F.trim(F.regexp_replace(_respelt(c, [p for p in SPELLINGS if " " in p[0]]), " +", " "))


def whole(c: Column) -> Column:
    """A canonical text as one line of words, wherever its lines were broken."""
    return _line(F.regexp_replace(c, r"[ \n]+", "  "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id and digest of the built-in licences in all their forms; some hundred rows."""
    return digests(spark.createDataFrame(variants(), "license_id string, text string"))


def digests(licenses: DataFrame) -> DataFrame:
    """license_id and digest of a table of license_id and text."""
    return licenses.select("license_id", F.sha2(whole(canonical(F.col("text"))), 256).alias("digest"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, *, notices: list[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, digest of its canonical text, license_id of the known licence it is as a whole, notice_ids.

    The digest is hash-joined to the known ones (license_id, digest), of which there may be any number: nothing is
    forced, so a table as small as the built-in one is broadcast, by Spark's measure of it, and a larger one is
    joined by shuffled digests. notice_ids are the licences, sorted, of which a line of the text is one of the
    `notices`, a list in the program; they come from the same digests by lookup in a literal map.

    Null and empty texts have the digest of "" and no licence. Null ids and repeated rows stay, one result row
    each. Of known licences with one digest the least identifier counts. Other columns are not read. An empty table
    gives no rows, a text may have any length.
    """
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    forms = digests(spark.createDataFrame(notices, "license_id string, text string")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    named = {r.digest: r.license_id for r in sorted(forms.collect())}
    lookup = F.create_map(*[F.lit(x) for pair in (named or {"": ""}).items() for x in pair])
    c = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col).cast("string")).alias("c"))
    lines = F.transform(F.split("c", "\n"), lambda x: F.element_at(lookup, F.sha2(_line(x), 256)))
    found = c.select("id", F.sha2(whole(F.col("c")), 256).alias("digest"), F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull()))).alias("notice_ids"))
    return found.join(known, "digest", "left").select(F.col("id").alias(id_col), "digest", "license_id", "notice_ids")
