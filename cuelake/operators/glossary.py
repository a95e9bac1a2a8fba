"""Terms inside cue texts: glossary checks and sensitive-term flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.qa import decision

BROADCAST_TERMS = 5_000
GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct substrings of 1 to ``GRAM`` characters."""
    chars = F.split(text, "")
    n = F.length(text)

    def of(size: int) -> Column:
        parts = F.transform(
            F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))),
            lambda i: F.array_join(F.slice(chars, i, F.lit(size)), ""),
        )
        return F.when(n >= size, parts).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(s) for s in range(1, GRAM + 1)]))


def contains_join(
    cues: DataFrame, terms: DataFrame, text: str, by_language: bool, broadcast_terms: int = BROADCAST_TERMS
) -> DataFrame:
    """Pairs of cue and term where the cue's ``text`` column contains the term, each pair once.

    Blank terms match nothing. A term list is broadcast only when counted to be small. A larger one is joined on the term's
    first characters, which the cue must contain as well, and then checked in full.
    """
    hit = F.contains(F.col(text), F.col("term"))
    terms = terms.filter(F.length("term") > 0)
    if terms.limit(broadcast_terms + 1).count() <= broadcast_terms:
        t = F.broadcast(terms.withColumnRenamed("language", "_lang") if by_language else terms)
        return cues.join(t, hit & (F.col("language") == F.col("_lang")) if by_language else hit).drop("_lang")
    keyed = terms.withColumn("_gram", F.substring("term", 1, GRAM))
    spread = cues.withColumn("_gram", F.explode(_grams(F.col(text))))
    on = ["_gram", "language"] if by_language else ["_gram"]
    return spread.join(keyed, on).filter(hit).drop("_gram")


def glossary_occurrences(cues: DataFrame, terms: DataFrame, **how) -> DataFrame:
    """One row per cue and glossary term in its source, with ``hit`` when a rendering is in the target."""
    found = contains_join(cues, terms, "source_text", by_language=True, **how)
    hit = F.exists(F.col("renderings"), lambda r: (r != "") & F.contains(F.col("target_text"), r))
    return found.withColumn("hit", hit)


def glossary_metrics(occurrences: DataFrame, tracks: DataFrame) -> DataFrame:
    must, hit = F.col("must_appear"), F.col("hit")
    count = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    m = occurrences.groupBy("project_id", "language").agg(
        count(must, "required_occurrences"), count(must & hit, "required_hits"),
        count(~must & ~hit, "preferred_misses"),
    )
    names = ["required_occurrences", "required_hits", "preferred_misses"]
    m = tracks.join(m, ["project_id", "language"], "left").fillna(0, names)
    rate = F.round(F.col("required_hits") / F.col("required_occurrences"), 6)
    return m.withColumns({
        "required_hit_rate": F.when(F.col("required_occurrences") > 0, rate).otherwise(1.0),
        "decision": decision(F.col("required_occurrences") - F.col("required_hits"), F.lit(0)),
    })


def sensitive_flags(cues: DataFrame, lexicon: DataFrame, text: str = "source_text", **how) -> DataFrame:
    """At most one note per cue and category, naming the first matching term of the lexicon."""
    found = contains_join(cues, lexicon, text, by_language=False, **how)
    return found.groupBy("project_id", "language", "cue_id", "category").agg(
        F.min_by("term", "ord").alias("term"), F.lit("note").alias("severity")
    )
