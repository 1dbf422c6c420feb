"""Expressions on names and paths of the code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.sources.tables import dotted


def simple_name(name: Column) -> Column:
    """What follows the last ``.`` or ``::``."""
    return F.element_at(F.split(dotted(name), r"\."), -1)


def spaced(name: Column) -> Column:
    """The dotted name with each character that is no part of a word set apart by spaces.

    ``contains(spaced(c), spaced(x))`` says that x stands in c at identifier boundaries.
    """
    return F.concat(F.lit(" "), F.regexp_replace(dotted(name), r"(\W)", " $1 "), F.lit(" "))


def callee_forms(callee: Column) -> list[Column]:
    """What ``refers`` needs to know of a raw callee text; computed once per callee, not once per pair."""
    return [callee.alias("callee_name"), spaced(callee).alias("spaced"), F.lower(callee).alias("callee_low"),
            F.contains(callee, F.lit("::")).alias("scoped")]


def name_forms(name: Column) -> list[Column]:
    """What ``refers`` needs to know of a function name."""
    return [
        spaced(name).alias("name_spaced"), F.lower(name).alias("name_low"), F.lower(simple_name(name)).alias("simple_low"),
        F.when(simple_name(name) != dotted(name), spaced(simple_name(name))).alias("simple_spaced"),
    ]


def form_refers() -> Column:
    """``refers`` over the columns of ``callee_forms`` and ``name_forms``."""
    simple = F.coalesce(~F.col("scoped") & F.contains("spaced", F.col("simple_spaced")), F.lit(False))
    edge = F.lit(False)
    for part in ("name_low", "simple_low"):
        edge = edge | F.startswith("callee_low", F.col(part)) | F.endswith("callee_low", F.col(part))
    return (F.contains("spaced", F.col("name_spaced")) | simple) & edge


def refers(callee: Column, callee_spaced: Column, name: Column) -> Column:
    """Whether a raw callee text refers to a function name, by identifier boundaries.

    The name or, for a callee without ``::``, its last segment must stand in
    the callee as whole identifiers, and the callee must begin or end (in any
    letter case) with the name or its last segment.
    """
    simple = simple_name(name)
    inside = F.contains(callee_spaced, spaced(name)) | (
        (simple != dotted(name)) & ~F.contains(callee, F.lit("::")) & F.contains(callee_spaced, spaced(simple))
    )
    low = F.lower(callee)
    edge = F.lit(False)
    for part in (F.lower(name), F.lower(simple)):
        edge = edge | F.startswith(low, part) | F.endswith(low, part)
    return inside & edge


#: Lengths of the character runs by which a text and the words in it meet.
GRAMS = (8, 3, 2, 1)
#: Bytes of words, at most, that are broadcast to the texts; a row counts ROW_BYTES besides its word.
MAX_BROADCAST_WORDS, ROW_BYTES = 8 << 20, 64


def handed_out(words: DataFrame, word: str) -> DataFrame:
    """``words``, marked to be broadcast if they are few. They are read for this once, so they should be cheap to make."""
    size = words.agg(F.sum(F.octet_length(word) + ROW_BYTES)).first()[0] or 0
    return F.broadcast(words) if size <= MAX_BROADCAST_WORDS else words


def texts_holding(texts: DataFrame, text: str, words: DataFrame, word: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``texts`` joined with the rows of ``words`` whose ``word`` stands in ``text``, as it is spelled.

    A word meets the texts by its last 8 characters (the last 3, 2 or 1 of a
    shorter one), whole words are compared after that, so no pair is compared
    without a run in common. Spark takes the runs of a text for one row of its
    size and would broadcast them, so a merge join is asked for; words that are
    marked to be broadcast are. ``on`` names columns of both sides that must be
    equal. Null and empty words are in no text. The words should be distinct.
    """
    size = F.length(word)
    gram = F.lit(None).cast("string")
    for n in sorted(GRAMS):
        gram = F.when(size >= n, F.right(F.col(word), F.lit(n))).otherwise(gram)
    asked = words.where(F.col(word).isNotNull() & (size > 0)).withColumn("_gram", gram)
    runs = F.flatten(F.array(*[
        F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(F.col(text), i, F.lit(n))))
        .otherwise(F.array().cast("array<string>")) for n in GRAMS]))
    met = texts.where(F.col(text).isNotNull()).withColumn("_gram", F.explode(F.array_distinct(runs))).hint("merge").join(asked, ["_gram", *on])
    return met.where(F.contains(F.col(text), F.col(word))).drop("_gram")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_file(path: Column) -> Column:
    """"test" in the file's name or in that of its directory, in any letter case."""
    parts = F.split(F.lower(path), "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    return F.contains(F.element_at(parts, -1), F.lit("test")) | F.contains(parent, F.lit("test"))


#: A path that contains one of these is left out of module analysis.
SKIPPED_PATH_PARTS = ("session_", "tmp", "temp", "venv")


def module_name(path: Column) -> Column:
    """The directory of a Python file, ``root`` for other languages, null for skipped paths."""
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.regexp_replace(path, r"\.py$", ""))
    skipped = F.lit(False)
    for part in SKIPPED_PATH_PARTS:
        skipped = skipped | F.contains(F.lower(path), F.lit(part))
    return F.when(skipped, F.lit(None)).when(F.endswith(path, F.lit(".py")), parent).otherwise("root")
