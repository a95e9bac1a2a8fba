"""Licence texts found by the digest of their canonical form, in native functions only.

A text is put into a canonical form (lower case, no copyright lines, one spelling of equivalent words, punctuation
and white space as single blanks) and hashed; whole texts and single lines whose digest is that of a known licence
or notice are hits. The known texts are a fixed list (``licence_texts`` and its files), so they are broadcast.

Defined cases: a null text, and one whose canonical form is empty, matches nothing; every row gives one result row,
also repeated ones. A line is what stands between \\n. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.licence_texts import KNOWN, TITLES, variants

#: Words that licence texts use in place of one another (canonical form last).
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("behaviour", "behavior"), ("whilst", "while"),
    ("noninfringement", "non infringement"), ("percent", "per cent"), ("https", "http"), ("merchantibility", "merchantability"),
]
#: A line that only tells whose work it is, with a year anywhere, a mark or a company's name, or reserves all rights.
#: A licence's own sentences can also begin with the word.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*((\(c\)|©) *[0-9]{4}[^\n]*|©[^\n]*|copyright *(\(c\)|©)[^\n]*|copyright[^\n]*[^0-9](19|20)[0-9]{2}[^\n]*"
    r"|(\(c\)|©) *copyright[^\n]*|(\(c\)|copyright) [^\n]*[^\p{L}\n](authors|inc|corporation|corp|ltd|llc|gmbh|foundation)[^\p{L}\p{N}\n]*"
    r"|all rights reserved[^\p{L}\p{N}\n]*)$"
)
MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, MARKS, " ")
    out = F.concat(F.lit(" "), F.btrim(out), F.lit(" "))
    for variant, word in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {word} "))
    return F.btrim(out)


def canonical_text(text: str) -> str:
    """The same form of one known text, for its digest."""
    line = COPYRIGHT_LINE.replace(r"[^\p{L}\p{N}\n]", r"(?:[^\w\n]|_)").replace(r"[^\p{L}\n]", r"(?:[^\w\n]|[\d_])")
    out = re.sub(line, " ", text.lower())
    out = f" {re.sub(r'[\W_]+', ' ', out).strip()} "
    for variant, word in SPELLINGS:
        out = out.replace(f" {variant} ", f" {word} ")
    return out.strip()


def known_digests() -> list[tuple[str, str]]:
    """(digest, licence) of each known text; texts of one canonical form keep the first name."""
    found: dict[str, str] = {}
    listed = [*KNOWN, *((name, title) for name, titles in TITLES.items() for title in titles)]
    for name, text in listed:
        for form in variants(name, text):
            found.setdefault(hashlib.sha256(canonical_text(form).encode()).hexdigest(), name)
    return sorted(found.items())


def find_licences(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_licence (of the entire text), line_licences (of its lines, sorted, by comma).

    Both are null without a hit.
    """
    known = docs.sparkSession.createDataFrame(known_digests(), "digest string, licence string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), canonical))
    units = rows.select(
        "row", "doc_id",
        F.inline(F.concat(
            F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("text")).alias("form"))),
            F.transform(F.coalesce(lines, F.array()), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("form"))),
        )),
    )
    hits = units.select("row", "doc_id", "whole", F.sha2("form", 256).alias("digest")).join(
        F.broadcast(known), "digest", "left"
    )
    named = hits.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("text_licence"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))).alias("names"),
    )
    return named.select(
        "doc_id", "text_licence",
        F.when(F.size("names") > 0, F.array_join("names", ",")).alias("line_licences"),
    )
