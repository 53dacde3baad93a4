"""Functions paired with their documentation.

Source files go through a state machine that knows strings, comments, templates and regular expressions; functions are delimited by
matching braces, in Python by indentation, and get the documentation comment that stands immediately before them, in Python their
docstring. Pairs whose documentation says nothing are dropped, each for a reason.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.syntax.files import latest

# Keywords before a parenthesis that start no function.
CONTROL = frozenset("if for while switch catch with synchronized try return sizeof do else await typeof super this".split())
# Words of placeholders; a text made of these and filler only, with at least one of STANDINS, documents nothing.
STANDINS = frozenset("todo tbd tba fixme xxx hack wip none null nil na n/a undocumented docstring docstrings placeholder inheritdoc inherited inherit inherits stub autogenerated documentation documented document docs doc description javadoc jsdoc comment comments override overrides overridden missing".split())
PLACE = frozenset("add later pending write goes here no not yet available auto generated method function class constructor see parent base super superclass interface to be done fill in me this the a an is please coming soon empty blank same as above from for of need needs needed should provide provided given it by ide someday eventually insert put your text more some summary missing".split())
# Words that add nothing to a repeated name.
FILLER = frozenset("the a an this that these it its is are be function functions method methods func fn def procedure routine helper constructor which to of for and does do will can used simply just performs perform executes execute implements implementation returns return given here we in on with by from async static public private protected int long void".split())
# Words that name types.
TYPES = frozenset("int integer str string number num boolean bool void none null object any float double long short byte char list dict map set array tuple function promise undefined unknown never bytes self size_t unsigned const optional iterable iterator callable date symbol bigint short_t uint".split())
# Directives to tools.
DIRECTIVE = re.compile(
    r"(?:pylint|flake8|ruff|mypy|pyright|pytype|noinspection|eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8|sonar|checkstyle|clang-format|clang-tidy|cppcheck|coverage|isort|yapf|black|fmt|nolint|nosonar|lint|globals?|exported|pragma|webpack|flow|language|nosec|biome|stylelint)\b\s*[-:=(@\w].*"
    r"|(?:noqa|nolint|nosonar|nosec|nolintnextline|@?ts-(?:ignore|nocheck|check|expect-error)|@?flow|fallthrough)\b.*"
    r"|type\s*:\s*ignore.*|@(?:suppresswarnings|override|deprecated|generated|nullable|nonnull|test|internal|private|public|protected|package|hidden|ignore|api|async|static|abstract|override|readonly|final|inheritdoc)\b(?:\s*\([^)]*\))?"
    r"|(?:fmt|yapf|clang-format|isort|pragma)\s*:\s*\S.*|istanbul ignore.*",
    re.I,
)
_TAG = re.compile(r"(?:[@\\](?P<at>[a-zA-Z]+)(?P<brace>\s*\{[^{}]*\})?|:(?P<colon>[a-z]+)(?P<args>(?:\s+[^:\n]*)?):)")
_NAMED = frozenset("param params parameter arg argument property prop tparam type vartype ivar cvar var keyword kwarg key raises raise throws throw exception template typeparam".split())
_WORDS = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\da-zA-Z_]+")


def bare(doc: str) -> str:
    """The text without comment delimiters, quotes and rulers, line by line."""
    text = doc.replace("\r\n", "\n").replace("​", "").replace("﻿", "").strip()
    text = re.sub(r"^[rRuUbBfF]{0,2}(?=[\"']{3}|[\"'])", "", text)
    text = re.sub(r"^(?:\"\"\"|'''|\"|'|/\*+!?|<!--)|(?:\"\"\"|'''|\"|'|\*+/|-->)$", "", text.strip())
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"^\s*(?:/\*+!?|//+!?|\*+(?!\w)/?|#+!?|--+|;+|%+|'{3}|\"{3})?\s*", "", line.strip())
        line = re.sub(r"\s*(?:\*+/|'{3}|\"{3})\s*$", "", line)
        if any(c.isalnum() for c in line):
            lines.append(line.strip())
    return "\n".join(lines)


def parts(name: str) -> list[str]:
    """A name's words, whatever its spelling."""
    return [p.lower() for p in _PARTS.findall(name)]


def stem(word: str) -> str:
    """A word without English inflection, good enough to compare words of one name."""
    for end, put in (("ies", "y"), ("ied", "y"), ("ying", "y"), ("ing", ""), ("ers", ""), ("er", ""), ("ed", ""), ("es", ""), ("s", ""), ("ation", "")):
        if word.endswith(end) and len(word) - len(end) >= 2:
            word = word[: -len(end)] + put
            break
    if len(word) > 3 and word[-1] == word[-2]:
        word = word[:-1]
    return word[:-1] if len(word) > 3 and word[-1] == "e" else word


def _explained(text: str) -> tuple[str, bool, bool]:
    """(text before and beside the tags, whether there are tags, whether one explains something in words)."""
    tags = list(_TAG.finditer(text))
    if not tags:
        return text, False, False
    free, explained = text[: tags[0].start()], False
    for tag, end in zip(tags, [*[t.start() for t in tags[1:]], len(text)]):
        name = (tag["at"] or tag["colon"]).lower()
        words = [w for w in re.findall(r"[^\s,;|<>\[\]{}()=]+", text[tag.end() : end]) if any(c.isalnum() for c in w)]
        if tag["at"] and name in _NAMED:
            words = words[1:]
        plain = [w.strip(".:*`'\"-") for w in words]
        said = [w for w in plain if w and w.lower() not in TYPES and not re.fullmatch(r"[A-Z]\w*(?:\.\w+)*", w)]
        if len(said) > 1 or len(said) == 1 and len(plain) > 1 and name in _NAMED and said[0].islower():
            explained = True
    return free, True, explained


def trivial(doc: str | None, name: str, params: str | None = None) -> str | None:
    """Why a documentation says nothing: missing, empty, directive, placeholder, tags or repeats; None if it says something.

    params: the text of the parameter list, if known. Words of other scripts than Latin always say something.
    """
    if doc is None:
        return "missing"
    text = bare(doc)
    if not text:
        return "empty"
    lines = text.split("\n")
    kept = [x for x in lines if not DIRECTIVE.fullmatch(x.strip("{} \t."))]
    if not kept:
        return "placeholder" if re.fullmatch(r"\W*inheritdoc\W*", text, re.I) else "directive"
    text = "\n".join(kept)
    text = re.sub(r"\{?@inheritDoc\}?", " inheritdoc ", text, flags=re.I)
    free, tagged, explained = _explained(text)
    if explained:
        return None
    words = [w.lower() for w in _WORDS.findall(re.sub(r"\bn\.?/?a\b\.?", " none ", free, flags=re.I))]
    if not words:
        return "tags" if tagged else "empty"
    elsewhere = {"base", "parent", "super", "superclass"} & {*words} and {"see", "same", "as", "from"} & {*words}
    if (elsewhere or any(w in STANDINS for w in words)) and all(w in STANDINS or w in PLACE for w in words):
        return "placeholder"
    own = [stem(p) for p in parts(name)]
    signature = re.fullmatch(r"(?:[\w<>\[\]*&]+\s+)*([\w$]+)\s*\([^()]*\)\s*(?:->\s*[\w\[\], .]+)?\s*[:;{.]*", free.strip())
    if own and signature and [stem(p) for p in parts(signature[1])] == own:
        return "repeats"
    known = set(own) | {stem(p) for w in _WORDS.findall(params or "") for p in parts(w)}
    said = [p for w in re.findall(r"\w+", free) for p in parts(w)]
    rest = [p for p in said if p not in FILLER and stem(p) not in own]
    joined = "".join(p for p in said if p not in FILLER)
    if not rest or joined == "".join(parts(name)):
        return "repeats" if any(stem(p) in own for p in said) or joined == "".join(parts(name)) else "placeholder" if all(p in FILLER or p in PLACE for p in said) else None
    if "(" in free and all(stem(p) in known or p in TYPES for p in rest) and any(stem(p) in own for p in said):
        return "repeats"
    return None


_BRACED = re.compile(
    r"(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<text>\"\"\".*?(?:\"\"\"|\Z))|(?P<str>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<tpl>`)|(?P<pre>^[ \t]*\#(?:[^\n\\]|\\.)*)"
    r"|(?P<id>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<arrow>=>)|(?P<nl>\n)|(?P<ws>[^\S\n]+)|(?P<sign>.)",
    re.S | re.M,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ return typeof case in of delete void throw new else do".split())


def _template_end(text: str, at: int) -> int:
    """The end of a template literal whose text starts at ``at``, with its substitutions skipped."""
    n, depth = len(text), 0
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if depth == 0 and c == "`":
            return at + 1
        if c == "$" and depth == 0 and text.startswith("${", at):
            depth, at = 1, at + 2
            continue
        if depth:
            if c == "`":
                at = _template_end(text, at + 1)
                continue
            if c in "\"'":
                m = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S).match(text, at)
                at = m.end()
                continue
            depth += {"{": 1, "}": -1}.get(c, 0)
        at += 1
    return n


def braced(text: str, language: str) -> list[tuple[str, int, int, str | None, str, int, int]]:
    """(name, first line, last line, comment, parameters, start, end) of the functions with a body in JavaScript, Java or C."""
    tokens: list[tuple[str, int, int]] = []  # text, offset, line
    notes: dict[int, str] = {}  # comment that stands immediately before a token, by token number
    note, note_end, line, at, n = "", -9, 1, 0, len(text)
    found, opened, parens, pair = [], [], [], {}
    while at < n:
        m = _BRACED.match(text, at)
        kind, word = m.lastgroup, m.group()
        end = m.end()
        if kind == "nl":
            line, at = line + 1, end
            continue
        if kind in ("ws",):
            at = end
            continue
        if kind == "comment":
            lines = word.startswith("//") and note.startswith("//") and note_end == line - 1
            note = f"{note}\n{word}" if lines else word
            line += word.count("\n")
            note_end, at = line, end
            continue
        if kind == "text" and language != "java":
            kind, end = "str", at + 2
            word = text[at:end]
        if kind == "tpl":
            if language == "javascript":
                end = _template_end(text, end)
                word = text[at:end]
        elif word == "/" and language == "javascript" and (not tokens or tokens[-1][0] in _BEFORE_REGEX):
            r = _REGEX.match(text, at)
            if r:
                end, word = r.end(), "regex"
        if kind == "pre" and language == "c":
            note, at = "", end
            line += word.count("\n")
            continue
        if note:
            if note_end >= line - 1:
                notes[len(tokens)] = note
            note = ""
        tokens.append((word if kind not in ("str", "text", "tpl") else "str", at, line))
        here = len(tokens) - 1
        if word == "(":
            parens.append(here)
        elif word == ")" and parens:
            pair[here] = parens.pop()
        elif word == "{":
            opened.append((_function(tokens, pair, here, language), here))
        elif word == "}" and opened:
            function, _ = opened.pop()
            if function:
                name, first, where, left, right = function
                params = text[tokens[left][1] + 1 : tokens[right][1]] if left >= 0 else ""
                comment = next((notes[i] for i in range(where, first - 1, -1) if i in notes), None)
                found.append((name, tokens[where][2], line, comment, params, tokens[first][1], end))
        line += text.count("\n", at, end) if kind in ("str", "text", "tpl") else 0
        at = end
    return found


def _function(tokens, pair, brace: int, language: str):
    """(name, first token, name's token, left and right parenthesis) if the brace opens a function's body."""
    last = brace - 1
    if language == "java":
        k = last
        while k > 0 and re.fullmatch(r"[\w.,$@]+", tokens[k][0]) and tokens[k][0] != "throws":
            k -= 1
        if k > 0 and tokens[k][0] == "throws":
            last = k - 1
    arrow = language == "javascript" and last >= 0 and tokens[last][0] == "=>"
    if arrow:
        last -= 1
    left, right = -1, -1
    if last in pair:
        left, right = pair[last], last
        at = left - 1
    elif arrow and last >= 0 and re.fullmatch(r"[\w$]+", tokens[last][0]):
        at = last - 1
    else:
        return None
    word = lambda k: tokens[k][0] if 0 <= k < len(tokens) else ""
    if not arrow and re.fullmatch(r"[\w$#]+", word(at)) and word(at) not in CONTROL and word(at) != "function":
        name = at
        if word(at - 1) in ("new", ".") or language != "javascript" and word(at - 1) in ("=", "(", ",", "return", "{") and language == "c":
            return None
    elif language == "javascript":
        if word(at) in ("function", "*"):
            at -= 1 + (word(at) == "*")
        if word(at) == "async":
            at -= 1
        if word(at) not in ("=", ":") or not re.fullmatch(r"[\w$#]+", word(at - 1)):
            return None
        name = at - 1
    else:
        return None
    first = name
    depth = 0
    while first > 0:
        before = word(first - 1)
        if before == ")" and first - 1 in pair:
            first = pair[first - 1]
            continue
        depth += {">": 1, "<": -1}.get(before, 0)
        if before in (";", "{", "}") or before in (",", "(", ":") and depth <= 0:
            break
        first -= 1
    if language == "java" and first == name and word(name)[:1].islower():
        return None  # a call before an initialiser block
    return tokens[name][0], first, name, left, right


_LOGICAL = re.compile(r"(?P<comment>\#[^\n]*)|(?P<str>(?P<prefix>[A-Za-z]{0,2})(?P<quote>\"\"\"|'''|\"|'))|(?P<nl>\n)|(?P<cont>\\\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[^\W\d]\w*)|(?P<ws>[ \t\f]+)|(?P<sign>.)", re.S)


def python(text: str) -> list[tuple[str, int, int, str | None, str, int, int]]:
    """The same of Python functions; the comment is the docstring with its quotes, or else the comment lines right above."""
    rows: list[dict] = []  # logical lines
    at, n, line, depth, row, above, above_end = 0, len(text), 1, 0, None, "", -9
    line_at = 0
    while at < n:
        m = _LOGICAL.match(text, at)
        kind, end = m.lastgroup, m.end()
        if m["str"] is not None:
            quote = m["quote"]
            kind = "str"
            stop = re.compile((r"(?:[^\\]|\\.)*?" if len(quote) == 3 else r"(?:[^\\\n]|\\.)*?") + quote, re.S).match(text, end)
            end = stop.end() if stop else (n if len(quote) == 3 else (text.find("\n", end) + n + 1) % (n + 1) or n)
        if kind == "nl":
            if row is not None and depth == 0:
                row["last"], row["end"] = line, at
                row = None
            line += 1
            line_at = end
        elif kind == "cont":
            line += 1
        elif kind == "comment":
            if row is None and depth == 0:
                above = f"{above}\n{m.group()}" if above and above_end == line - 1 else m.group()
                above_end = line
        elif kind != "ws":
            if row is None:
                row = {"indent": len(text[line_at:at].expandtabs(8)), "first": line, "start": line_at, "words": [], "above": above if above_end == line - 1 else "", "last": line, "end": n}
                above = ""
                rows.append(row)
            if len(row["words"]) < 4:
                row["words"].append((kind, m.group() if kind != "str" else text[at:end], at, end))
            if kind == "open":
                row.setdefault("left", end)
                depth += 1
            elif kind == "close":
                depth = max(0, depth - 1)
                if depth == 0:
                    row.setdefault("right", at)
            row["last"], row["end"], row["tail"] = line, end, m.group()
            line += text.count("\n", at, end) if kind == "str" else 0
        at = end
    found = []
    for k, row in enumerate(rows):
        words = [w for _, w, _, _ in row["words"]]
        skip = words[:2] == ["async", "def"]
        if words[skip : skip + 1] != ["def"] or len(words) < skip + 2:
            continue
        stop = k
        while stop + 1 < len(rows) and rows[stop + 1]["indent"] > row["indent"]:
            stop += 1
        doc = row["above"] or None
        if stop > k and rows[k + 1]["words"] and rows[k + 1]["words"][0][0] == "str" and (len(rows[k + 1]["words"]) == 1 or rows[k + 1]["words"][1][1] == ";"):
            doc = rows[k + 1]["words"][0][1]
        found.append((words[skip + 1], row["first"], rows[stop]["last"], doc, text[row.get("left", 0) : row.get("right", 0)], row["start"], rows[stop]["end"]))
    return found


def functions_of(text: str, language: str) -> list[tuple[str, int, int, str | None, str, int, int]]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return python(text) if language == "python" else braced(text, language)


FUNCTIONS = "repo string, file_path string, language string, name string, first int, last int, doc string, params string, code string"


def functions(parses: DataFrame, code: bool = True) -> DataFrame:
    """(repo, file_path, language, name, first, last, doc, params, code): every function with a body in the latest parse of a file.

    first is the line of the name, last that of the end. code is null if it isn't asked for. Files of other languages, null and empty
    texts give nothing; text that doesn't parse gives the functions that can be told.
    """

    def extract(frames):
        for frame in frames:
            out = []
            for repo, path, language, text in frame[["repo", "file_path", "language", "source_text"]].itertuples(index=False):
                source = text.replace("\r\n", "\n").replace("\r", "\n")
                for name, first, last, doc, params, start, end in functions_of(text, language):
                    out.append((repo, path, language, name, first, last, doc, params, source[start:end] if code else None))
            yield pd.DataFrame(out, columns=["repo", "file_path", "language", "name", "first", "last", "doc", "params", "code"])

    rows = latest(parses).where(F.col("language").isNotNull() & (F.col("source_text") != ""))
    return rows.mapInPandas(extract, FUNCTIONS)


def _same_words(a: str | None, b: str | None) -> bool:
    """Whether two texts agree in all letters and digits, so that delimiters, rulers and line breaks don't count."""
    return "".join(filter(str.isalnum, (a or "").casefold())) == "".join(filter(str.isalnum, (b or "").casefold()))


def _documented(nodes: DataFrame) -> DataFrame:
    """One row per qualified_name of kind Function or Method; should rows disagree, the least counts."""
    wanted = nodes.where(F.col("kind").isin("Function", "Method") & F.col("qualified_name").isNotNull())
    return wanted.groupBy("qualified_name").agg(F.min(F.struct("kind", "name", "file_path", "range_start", "docstring")).alias("v")).select("qualified_name", "v.*")


def _matched(parses: DataFrame, nodes: DataFrame, code: bool, how: str) -> DataFrame:
    """Nodes joined with the function of their name at their line in the latest parse of their file."""
    found = functions(parses, code).select(F.col("file_path").alias("f"), F.col("name").alias("n"), "first", "language", "code", F.col("doc").alias("source_doc"), "params").dropDuplicates(["f", "n", "first"])
    one = _documented(nodes)
    return one.join(found, (F.col("file_path") == F.col("f")) & (F.col("name") == F.col("n")) & (F.col("range_start") == F.col("first")), how)


def pairs(parses: DataFrame, nodes: DataFrame, code: bool = True) -> DataFrame:
    """(qualified_name, kind, language, file_path, code, docstring, source_doc, reason): functions of the source files with what they do.

    One row per qualified_name whose function the latest parse of its file holds; ``unpaired`` has the others. source_doc is the
    documentation attached to it there, docstring what the node says. If both agree in their words the attached one is judged, else
    the node's, since the file may have changed after the node was made. reason tells why it says nothing and is null for pairs worth
    keeping. Nodes with a null qualified_name are left out.
    """

    def judge(frames):
        for frame in frames:
            doc = [s if d is not None and s is not None and _same_words(s, d) else d for s, d in zip(frame["source_doc"], frame["docstring"])]
            reason = [trivial(d, n or "", p) for d, n, p in zip(doc, frame["name"], frame["params"])]
            yield frame.drop(columns=["name", "params"]).assign(reason=reason)

    rows = _matched(parses, nodes, code, "inner").select("qualified_name", "kind", "language", "file_path", "code", "docstring", "source_doc", "name", "params")
    return rows.mapInPandas(judge, "qualified_name string, kind string, language string, file_path string, code string, docstring string, source_doc string, reason string")


def unpaired(parses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qualified_name, kind, file_path, docstring) of the nodes whose function no latest parse holds where they say."""
    return _matched(parses, nodes, False, "left_anti").select("qualified_name", "kind", "file_path", "docstring")
