"""Small tables with the cases that every operator has to take."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Names that operators use inside; tables carry them to show that they don't meet.
CLASHING = ["row", "doc", "key", "hi", "lo", "n", "word", "drop", "seed", "bin", "digest", "label", "score", "node"]

WORDS = (
    "amber basket candle dragon ember forest garden hammer island jungle kettle ladder marble needle orange pepper "
    "quiver rocket saddle temple umbra velvet willow yellow zephyr anchor bridge copper dollar engine feather ginger"
).split()


def prose(k: int, n: int = 60) -> str:
    """A text of ``n`` words that differ from those of other ``k``."""
    return " ".join(f"{WORDS[(i * 7 + k * 3) % len(WORDS)]}{(i * 31 + k * 17) % 97}" for i in range(n))


def documents(spark, rows, extra: bool = True):
    """(doc_id, text, lang) rows as a documents table; with ``extra`` columns of clashing names as well."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASHING if extra else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def cases(spark, extra: bool = True):
    """Nulls in every column, empty and blank texts, a long one, a repeated row, ties."""
    long = " ".join(f"q{k}{w}" for k in range(600) for w in prose(k, 200).split())
    rows = [
        (1, prose(1), "en"), (2, None, "en"), (3, "", None), (4, "  \n\t\n", "de"), (5, long, "de"), (6, prose(6), "fr"),
        (6, prose(6), "fr"), (None, prose(8), "en"), (9, "???", "en"), (10, "x", "fr"), (11, prose(1), "en"),
        (12, "z" * 300_000, "de"), (None, None, None),
    ]
    return documents(spark, rows, extra)


def empty(spark):
    return documents(spark, [])
