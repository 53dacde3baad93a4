"""Source files that do not parse, per file and as rates per repository and language."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.syntax import lexers
from arbora.llm.syntax.engine import Recogniser
from arbora.llm.syntax.grammars import EXTENSIONS, grammar

LEXERS = {"javascript": lexers.javascript, "java": lexers.java, "c": lexers.c}


class Checker:
    """Checks texts of all languages; one a worker, so that what was derived is kept."""

    def __init__(self):
        self.recognisers: dict[str, Recogniser] = {}
        self.fields: dict[str, str | None] = {}

    def _recogniser(self, language: str, use: str = "") -> Recogniser:
        return self.recognisers.setdefault(language + use, Recogniser(grammar(language)))

    def _field(self, source: str) -> None:
        if source not in self.fields:
            if len(self.fields) > 50_000:
                self.fields.clear()
            kinds, _ = lexers.python(f"({source})", self._field)
            inner = [*kinds[1:-3], "NEWLINE", "END"]
            bare = inner and self._recogniser("python", " field").accepts(inner, rule="field")
            self.fields[source] = None if bare and source.strip() else source
        if self.fields[source] is not None:
            raise lexers.LexError(f"f-string field {source!r}")

    def problem(self, text: str, language: str) -> str | None:
        """What is wrong with the text as the language, None if some dialect accepts it, however deep it is nested. Empty texts are valid."""
        try:
            kinds, newline = lexers.python(text, self._field) if language == "python" else LEXERS[language](text)
            recogniser = self._recogniser(language)
            if recogniser.accepts(kinds, newline):
                return None
            at = min(recogniser.far, len(kinds) - 1)
            return f"unexpected {kinds[at]} as token {at + 1} of {len(kinds)}"
        except lexers.LexError as x:
            return str(x)


def language_of(path):
    """The language that a path's extension claims, null if it is none of those supported."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))
    found = F.lit(None).cast("string")
    for e, language in EXTENSIONS.items():
        found = F.when(extension == e, F.lit(language)).otherwise(found)
    return found


def latest(parses: DataFrame) -> DataFrame:
    """(repo, file_path, language, source_text): per path the row with the latest parsed_at, language by extension.

    Rows with a null path are left out; a null parsed_at comes before all others. Of several latest rows the greatest text counts.
    """
    rows = parses.where(F.col("file_path").isNotNull()).select("file_path", F.struct(F.coalesce(F.unix_micros("parsed_at"), F.lit(-(2**63))).alias("at"), "source_text", "repo").alias("v"))
    return rows.groupBy("file_path").agg(F.max("v").alias("v")).select("v.repo", "file_path", language_of(F.col("file_path")).alias("language"), "v.source_text")


def checked(parses: DataFrame) -> DataFrame:
    """(repo, file_path, language, problem), one row per path; problem is null for files that some dialect of their language accepts.

    Files of other extensions have a null language and no problem. A null or empty text is valid.
    """

    def check(frames):
        checker = Checker()
        for frame in frames:
            problem = [checker.problem(t, lang) if t and lang else None for t, lang in zip(frame["source_text"], frame["language"])]
            yield frame[["repo", "file_path", "language"]].assign(problem=problem)

    rows = latest(parses)
    return rows.mapInPandas(check, "repo string, file_path string, language string, problem string")


def rates(parses: DataFrame) -> DataFrame:
    """(repo, language, files, broken, rate) of files in supported languages."""
    files = checked(parses).where(F.col("language").isNotNull())
    counts = files.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("problem").alias("broken"))
    return counts.withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
