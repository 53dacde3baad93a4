"""Source files of a folder: ignore rules, exclusions and language by extension, as predicates over a distributed listing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are left out at any depth, and the languages' extensions.
EXCLUDED_DIRS = "venv .venv env .env virtualenv .direnv site-packages dist-packages node_modules bower_components vendor .git .hg .svn __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .nox build dist .eggs .next .nuxt".split()
EXCLUDED_SUFFIX = ".egg-info"
EXTENSIONS = {
    "python": ".py", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx .mts .cts", "php": ".php", "go": ".go", "rust": ".rs", "java": ".java", "csharp": ".cs", "c": ".c .h",
    "cpp": ".cpp .cc .cxx .c++ .hpp .hh .hxx .h++", "ruby": ".rb .rake", "kotlin": ".kt .kts", "swift": ".swift", "scala": ".scala .sc", "lua": ".lua", "bash": ".sh .bash",
}
ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "c#": "csharp", "c++": "cpp", "shell": "bash", "sh": "bash", "rb": "ruby", "kt": "kotlin", "rs": "rust", "golang": "go"}


def extension_map(languages: Sequence[str] | None = None) -> dict[str, str]:
    """Extension to language. A language is named by its name, an alias or one of its extensions, and brings all its extensions."""
    every = {e: lang for lang, exts in EXTENSIONS.items() for e in exts.split()}
    if languages is None:
        return every
    chosen = set()
    for name in languages:
        key = name.lower()
        found = key if key in EXTENSIONS else ALIASES.get(key) or every.get(key if key.startswith(".") else f".{key}")
        if found is None:
            raise ValueError(f"unknown language {name!r}")
        chosen.add(found)
    return {e: lang for e, lang in every.items() if lang in chosen}


def ignore_rules(text: str) -> list[tuple[str, bool, bool]]:
    """(pattern, negated, folders only) of an ignore file, patterns as regular expressions over paths relative to its folder."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        rules.append((("" if anchored and not line.startswith("**/") else "(?:.*/)?") + _glob(line.lstrip("/").removeprefix("**/")), negated, folders))
    return rules


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("/**/", i):
            out, i = out + "/(?:.*/)?", i + 4
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def ignored(path: Column, rules: Sequence[tuple[str, bool, bool]]) -> Column:
    """Whether the last rule that matches the path or a folder above it ignores it; path relative to the rules' folder."""
    verdict = F.lit(False)
    for pattern, negated, folders in rules:
        below = path.rlike(f"^{pattern}/")
        verdict = F.when(below if folders else below | path.rlike(f"^{pattern}$"), F.lit(not negated)).otherwise(verdict)
    return verdict


def in_excluded_dir(path: Column, names: Sequence[str] = tuple(EXCLUDED_DIRS)) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda p: p.isin(list(names)) | p.endswith(EXCLUDED_SUFFIX))


def under_prefix(path: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        clean = prefix.strip("/")
        hit = hit | (path == clean) | path.startswith(f"{clean}/")
    return hit


def language_column(path: Column, extensions: dict[str, str]) -> Column:
    """The language of a path by its extension, as written; null if it has none."""
    found = F.lit(None).cast("string")
    for e, lang in sorted(extensions.items(), key=lambda x: len(x[0])):
        found = F.when(path.endswith(e), F.lit(lang)).otherwise(found)
    return found


def keep(files: DataFrame, languages: Sequence[str] | None = None, exclude: Sequence[str] = (), rules: Sequence[tuple[str, bool, bool]] = (), excluded_dirs: Sequence[str] = tuple(EXCLUDED_DIRS)) -> DataFrame:
    """files, with ``language``, without excluded folders, prefixes, ignored paths and other languages; needs a relative file_path."""
    path = F.col("file_path")
    rows = files.withColumn("language", language_column(path, extension_map(languages))).where(F.col("language").isNotNull() & ~in_excluded_dir(path, excluded_dirs))
    if exclude:
        rows = rows.where(~under_prefix(path, exclude))
    return rows.where(~ignored(path, rules)) if rules else rows


def read_folder(spark: SparkSession, root: str, languages: Sequence[str] | None = None, exclude: Sequence[str] = (), respect_ignore: bool = True, text: bool = True) -> DataFrame:
    """(file_path, language, mtime_ns, size, source_text) of the source files below root, listed and read by the executors.

    Bytes that aren't UTF-8 become replacement characters. Only the ignore file of the root counts. With text=False contents stay unread.
    """
    base = root.rstrip("/")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    columns = [F.expr(f"substring(path, {len(base) + 2} + instr(path, '{base}') - 1)").alias("file_path"), F.unix_micros("modificationTime").alias("us"), F.col("length").alias("size")]
    rules: list = []
    if respect_ignore:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/.gitignore")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):
            rules = ignore_rules("\n".join(r[0] for r in spark.read.text(f"{base}/.gitignore").collect()))
    content = F.decode("content", "UTF-8") if text else F.lit(None).cast("string")
    rows = keep(listing.select(*columns, content.alias("source_text")), languages, exclude, rules)
    return rows.select("file_path", "language", (F.col("us") * 1000).alias("mtime_ns"), "size", "source_text")
