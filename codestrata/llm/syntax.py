"""Source files that do not parse, found by derivatives of grammars over token streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.files import source_files
from codestrata.llm.grammars import grammar
from codestrata.llm.lexers import grammar_tokens, plain_text
from codestrata.session import python_rows

VERDICT = "file_id long, path string, project string, language string, failure string, line int, token string"


def parse_verdict(content: str, language: str) -> tuple[str | None, int | None, str | None]:
    """(failure, line, token): failure is null for a text of the language, ``token``
    where a token has an empty derivative, ``truncated`` where the text may not end."""
    text = plain_text(content)
    read = grammar_tokens(text, language)
    at = grammar(language).failure([kind for kind, _ in read])
    if at is None:
        return None, None, None
    if at == len(read):
        return "truncated", text.count("\n") + 1, None
    kind, offset = read[at]
    return ("truncated" if kind in ("NEWLINE", "DEDENT") and not text[offset:].strip() else "token", text.count("\n", 0, offset) + 1, kind)


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [parse_verdict(c, l) for c, l in zip(pdf["content"], pdf["language"])]
        out = pdf[["file_id", "path", "project", "language"]].copy()
        out["failure"] = [g[0] for g in got]
        out["line"] = pd.array([g[1] for g in got], dtype="Int32")
        out["token"] = [g[2] for g in got]
        yield out


def syntax_verdicts(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per file with content in a known language; ``failure`` is null for valid files.

    Null contents and unknown extensions give no row. An empty text is valid
    where the language allows it (Go demands a package clause).
    """
    return python_rows(source_files(files, contents).select("file_id", "path", "project", "language", "content"), _verdicts, VERDICT)


def syntax_rates(verdicts: DataFrame) -> DataFrame:
    """Files and invalid files per project and language, with the rate."""
    return (
        verdicts.groupBy("project", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count("failure").alias("invalid"))
        .withColumn("invalid_rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
