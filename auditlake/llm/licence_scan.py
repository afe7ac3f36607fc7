"""Whole texts that are known licences, by the digest of a canonical form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import body
from auditlake.llm.licences import EQUIVALENT, KNOWN, whole_texts
from auditlake.skew import lookup_join

#: A line that only states who holds the copyright, in lower-cased text.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|:|<|\[|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: A heading that only names one of the short licences, at the start of lower-cased text.
TITLE = (
    r"""\A[\s#*/;=-]*(the )?(mit|expat|isc|zlib(/libpng)?|0bsd|unlicense|(bsd[ -]*)?(zero|0|2|3|two|three)[ -]clause( bsd)?|((new|modified|revised|simplified) )?bsd)"""
    r"""( ?"?(new|revised|modified|simplified|freebsd)"?( or "?(revised|modified|freebsd)"?)?)? ?(licen[cs]e)?( \([^()\n]{1,60}\))?[ \t.:=-]*"""
    r"""(?=[\s#*/;-]*(\n|(portions )?copyright|\(c\)|©|permission is|permission to|redistribution and|this software is|this is free))"""
)
#: Where the terms begin if they follow the holder on one line.
TERMS = (
    r"(permission is hereby|permission to use|redistribution and use|redistributions? of|this software is|this program is|this work is|licensed under|released under"
    r"|everyone is permitted|this is free|(the )?(mit|isc|bsd|zlib) licen[cs]e)"
)
#: A holder, in lower-cased text: any line that opens with (portions) copyright and has a sign, a year, "by" or "authors", or that opens
#: a paragraph; wrapped terms such as "copyright notice" are none. It ends with the line or where the terms begin.
HOLDER = (
    r"(?m)^[ \t#*/;-]*(?:(?:portions[ \t]+)?(?:©|\(c\)[ \t]*[0-9]{4}|copyright(?!\w)"
    r"(?![ \t]+(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|and|or|in|on|of|to|as|is|protection|treat\w*|infring\w*)\b)"
    r"(?:(?=[ \t]*(?:\(c\)|©|:|<|\[|[0-9]{4})|[ \t]+by\b|[^\n]{0,200}?\b(?:[0-9]{4}|authors|contributors)\b)"
    r"|(?<=\n[ \t]{0,9}\n[ \t#*/;-]{0,9}(?:portions[ \t]{1,9})?copyright|\A[ \t\n#*/;-]{0,9}(?:portions[ \t]{1,9})?copyright)))|all rights reserved)"
    r"[^\n]*?(?=$|\b" + TERMS + r"\b)"
)
#: The number or letter of a list item, after the end of a sentence, a blank line or the start.
ITEM = r"""([.:;,]\s+|\b(?:and|or)\s+|\n[ \t#*/;-]*\n\s*|\A\s*)\(?(?:[0-9]{1,2}|[a-z])[.)](?=\s+["'(]*\p{L})"""


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words only (two spaces between them), one of each pair of equivalent spellings."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, NOT_WORD, "  ")), F.lit(" "))
    for spelling, standard in EQUIVALENT:
        a, b = (f" {x.replace(' ', '  ')} " for x in (spelling, standard))
        words = F.replace(words, F.lit(a), F.lit(b))
    return F.trim(words)


def spaced(text: Column) -> Column:
    """Lower case with plain line feeds, single spaces and at most one blank line, so that no pattern meets a long run of white space."""
    low = F.translate(F.regexp_replace(F.lower(text), "\r\n?", "\n"), "\t\v\f", "   ")
    lines = F.transform(F.split(F.regexp_replace(low, " {2,}", " "), "\n"), lambda line: F.btrim(line))
    return F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")


def reduced(low: Column) -> Column:
    """A ``spaced`` text without what whole licences differ in beyond ``canonical``: headings, holders, numbers of list items."""
    for pattern in (TITLE, HOLDER, TITLE):
        low = F.regexp_replace(low, pattern, "")
    return F.regexp_replace(low, ITEM, "$1")


def known_licences(spark: SparkSession) -> DataFrame:
    """The built-in licences: license_id, text."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in KNOWN + whole_texts()])
    return spark.range(1).select(F.inline(rows))


#: Each built-in licence has one of these in its terms, however its words are spelled.
MARKS = ["licen", "permission", "redistribution", "software"]


def licensed(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words of the canonical text, digest, license_id (null: not a licence).

    The whole text must be that of a known licence (license_id, text) in one of two forms: the canonical one, where a copyright
    line, case, punctuation, line breaks or an equivalent spelling make no difference, or the canonical form of ``reduced``.
    Words and digest are of the first. A notice or licence within a longer text is not found. Null and empty texts have the
    digest of the empty text and match nothing; repeated rows repeat. If known texts share a digest the smallest license_id
    stands. The table of known digests may have any size: it is joined by digest without a hint. Other columns are not read.
    """
    text = body()
    # A text can only equal a built-in licence if it has a word that each of them has; the others need no second form.
    marked = F.lit(True) if known is not None else reduce(Column.__or__, [F.contains(F.lower(text), F.lit(m)) for m in MARKS])
    known = known_licences(docs.sparkSession) if known is None else known
    rows = docs.select("doc_id", canonical(text).alias("canon"), F.when(marked, spaced(text)).alias("low")).select(
        "doc_id",
        F.when(F.col("canon") == "", 0).otherwise(F.regexp_count("canon", F.lit("  ")) + 1).cast("long").alias("n_words"),
        F.sha2("canon", 256).alias("digest"),
        F.sha2(canonical(reduced(F.col("low"))), 256).alias("second"),
    )
    forms = known.select("license_id", F.explode(F.array(canonical(text), canonical(reduced(spaced(text))))).alias("canon")).where("canon <> ''")
    digests = forms.groupBy(F.sha2("canon", 256).alias("key")).agg(F.min("license_id").alias("license_id"))
    first = digests.withColumnsRenamed({"key": "digest", "license_id": "first_id"})
    second = digests.withColumnsRenamed({"key": "second", "license_id": "second_id"})
    # Equal digests may fill a third of the rows, and most have no second one: both joins spread them.
    joined = lookup_join(lookup_join(rows, first, ["digest"], ["doc_id"]), second, ["second"], ["doc_id"])
    return joined.select(
        "doc_id", "n_words", "digest", F.coalesce("first_id", "second_id").alias("license_id")
    )
