"""Definitions, calls, imports and bases of fifteen languages by a scanner driven by tables of patterns.

Comments and strings are blanked first. Types and functions are found by pattern and delimited by braces or by ``end``; a call belongs
to the innermost function around it, a function to the innermost type. It is a best effort, not a parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

N = r"[^\W\d]\w*"
TESTS = re.compile(r"(?:@|#\[|\[)(?:\w+::)?(?:test|Test|Fact|Theory|TestMethod|ParameterizedTest)\b")
KEYWORDS = frozenset("if for foreach while until switch match catch return sizeof typeof elseif elif unless when case do else throw delete await yield in not and or function fn func def class super synchronized using lock fixed guard defer select isset empty array list require require_once include include_once import with assert static_assert alignof decltype noexcept".split())

#: Words before a parenthesis that name no definition.
NO_NAMES = frozenset("if for foreach while until switch match catch return elseif elif unless when do else function super synchronized using lock with".split())


@dataclass(frozen=True)
class Rules:
    """types: (pattern, kind) with group name, kind None for scopes that add to a type. functions: patterns with group name and maybe owner.

    imports: patterns over the source itself. bases: pattern after a type's name. blocks: ``{`` or ``end``. comment: pattern of comments.
    """

    types: tuple[tuple[str, str | None], ...]
    functions: tuple[str, ...]
    imports: tuple[str, ...] = ()
    bases: str = ""
    blocks: str = "{"
    comment: str = r"//[^\n]*|/\*.*?\*/"
    strings: str = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|virtual|partial|export|default|declare|readonly|data|inner|companion|suspend|inline|extern|unsafe|pub(?:\([^)]*\))?|const|fileprivate|mutating|implicit|lazy|case|native|synchronized|new)\s+)*"
_TYPED = rf"(?P<name>{N})\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"
_JS_FUNCTIONS = (
    rf"\bfunction\s*\*?\s+{_TYPED}",
    rf"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=\n]+)?=>",
    rf"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s+)?function\b",
    rf"(?:(?<=[{{;}}])|(?<=\n))\s*{_MODS}(?:get\s+|set\s+)?(?:async\s+)?\*?\s*(?P<name>[#\w$]+)\s*(?:<[^<>()]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=\n]+)?(?=\{{)",
)
_JS_IMPORTS = (r"\bimport\s+(?:[\w$*\s{},]+\s+from\s+)?['\"]([^'\"]+)['\"]", r"\bexport\s+(?:\*|\{[^}]*\})(?:\s+as\s+\w+)?\s+from\s+['\"]([^'\"]+)['\"]", r"\b(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]")

LANGUAGES: dict[str, Rules] = {
    "javascript": Rules(((rf"\bclass\s+(?P<name>{N})", "Class"),), _JS_FUNCTIONS, _JS_IMPORTS, r"\s*extends\s+(?P<INHERITS>[\w$.]+)", strings=r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"),
    "typescript": Rules(
        ((rf"\bclass\s+(?P<name>{N})", "Class"), (rf"\binterface\s+(?P<name>{N})", "Interface"), (rf"\benum\s+(?P<name>{N})", "Enum"), (rf"(?:^|\n|;|\bexport\s)\s*type\s+(?P<name>{N})[^=\n]*=", "Type")),
        _JS_FUNCTIONS, _JS_IMPORTS, r"\s*(?:<[^{]*?>)?\s*(?:extends\s+(?P<INHERITS>[^{]+?))?\s*(?:implements\s+(?P<IMPLEMENTS>[^{]+?))?\s*(?=\{)", strings=r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`",
    ),
    "php": Rules(
        ((rf"\b(?:class)\s+(?P<name>{N})", "Class"), (rf"\btrait\s+(?P<name>{N})", "Class"), (rf"\binterface\s+(?P<name>{N})", "Interface"), (rf"\benum\s+(?P<name>{N})", "Enum")),
        (rf"\bfunction\s+&?\s*{_TYPED}",), (), r"\s*(?:extends\s+(?P<INHERITS>[\w\\, ]+?))?\s*(?:implements\s+(?P<IMPLEMENTS>[\w\\, ]+?))?\s*(?=\{)", comment=r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/",
    ),
    "go": Rules(
        ((rf"\btype\s+(?P<name>{N})\s+struct\b", "Struct"), (rf"\btype\s+(?P<name>{N})\s+interface\b", "Interface"), (rf"\btype\s+(?P<name>{N})\s+(?!struct\b|interface\b)[\w\[*]", "Type")),
        (rf"\bfunc\s*(?:\(\s*(?:{N}\s+)?\*?(?P<owner>{N})[^)]*\)\s*)?{_TYPED}",), (), comment=r"//[^\n]*|/\*.*?\*/", strings=r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*'",
    ),
    "rust": Rules(
        ((rf"\b(?:struct|union)\s+(?P<name>{N})", "Struct"), (rf"\benum\s+(?P<name>{N})", "Enum"), (rf"\btrait\s+(?P<name>{N})", "Interface"), (rf"\btype\s+(?P<name>{N})\s*=", "Type"), (rf"\bimpl\b(?:\s*<[^{{]*?>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<name>{N})", None)),
        (rf"\bfn\s+(?P<name>{N})\s*(?:<[^()]*>)?\(",), (r"\buse\s+([\w:]+?)(?:::\{[^}]*\}|::\*)?(?:\s+as\s+\w+)?\s*;",), strings=r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'",
    ),
    "java": Rules(
        ((rf"\b(?:class|record)\s+(?P<name>{N})", "Class"), (rf"@?\binterface\s+(?P<name>{N})", "Interface"), (rf"\benum\s+(?P<name>{N})", "Enum")),
        (rf"(?:(?<=[{{;}}])|(?<=\n)|(?<=\s))(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^<>]*>\s*)?(?:[\w.]+(?:<[^;(){{}}]*>)?(?:\[\])*\s+)?{_TYPED}\s*(?:throws\s+[\w.,\s]+)?(?=\{{)",),
        (r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",), r"\s*(?:<[^{]*?>)?\s*(?:\([^)]*\))?\s*(?:extends\s+(?P<INHERITS>[\w.,<>\s]+?))?\s*(?:implements\s+(?P<IMPLEMENTS>[\w.,<>\s]+?))?\s*(?=\{)",
    ),
    "csharp": Rules(
        ((rf"\b(?:class|record)\s+(?P<name>{N})", "Class"), (rf"\binterface\s+(?P<name>{N})", "Interface"), (rf"\bstruct\s+(?P<name>{N})", "Struct"), (rf"\benum\s+(?P<name>{N})", "Enum")),
        (rf"(?:(?<=[{{;}}\]])|(?<=\n)|(?<=\s)){_MODS}(?:[\w.]+(?:<[^;(){{}}]*>)?(?:\[\])*\??\s+){_TYPED}\s*(?=\{{|=>)",), (r"\busing\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",), r"\s*(?:<[^{]*?>)?\s*:\s*(?P<BOTH>[\w.,<>\s]+?)\s*(?=\{|where)",
    ),
    "c": Rules(((rf"\b(?:struct|union)\s+(?P<name>{N})(?=\s*\{{)", "Struct"), (rf"\benum\s+(?P<name>{N})(?=\s*\{{)", "Enum")), (rf"(?:^|(?<=[;}}\n]))\s*(?:[\w]+[\s*]+)+{_TYPED}\s*(?=\{{)",), (r"#\s*include\s*[<\"]([^>\"]+)[>\"]",)),
    "cpp": Rules(
        ((rf"\bclass\s+(?P<name>{N})(?=[^;(){{}}]*\{{)", "Class"), (rf"\b(?:struct|union)\s+(?P<name>{N})(?=[^;(){{}}]*\{{)", "Struct"), (rf"\benum\s+(?:class\s+)?(?P<name>{N})(?=[^;(){{}}]*\{{)", "Enum")),
        (rf"(?:^|(?<=[;}}{{\n]))\s*(?:[\w:<>,~]+[\s*&]+)*(?:(?P<owner>{N})::)?(?P<name>~?{N})\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{{;]*)?(?=\{{)",),
        (r"#\s*include\s*[<\"]([^>\"]+)[>\"]",), r"\s*(?:final\s*)?:\s*(?P<INHERITS>[\w:,<>\s]+?)\s*(?=\{)",
    ),
    "ruby": Rules(((rf"(?:^|\n|;)\s*class\s+(?P<name>{N}(?:::{N})*)", "Class"), (rf"(?:^|\n|;)\s*module\s+(?P<name>{N}(?:::{N})*)", "Module")), (rf"(?:^|\n|;)\s*def\s+(?:self\.|{N}\.)?(?P<name>{N}[?!=]?)",), (r"\b(?:require|require_relative|load)\s*\(?\s*['\"]([^'\"]+)['\"]",), r"\s*<\s*(?P<INHERITS>[\w:]+)", "end", r"#[^\n]*"),
    "kotlin": Rules(
        ((rf"\b(?:class|object)\s+(?P<name>{N})", "Class"), (rf"\binterface\s+(?P<name>{N})", "Interface")), (rf"\bfun\s+(?:<[^<>]*>\s*)?(?:[\w.]+\.)?(?P<name>{N})\s*\(",), (r"\bimport\s+([\w.]+(?:\.\*)?)",),
        r"\s*(?:<[^{:]*?>)?\s*(?:\([^)]*\))?\s*:\s*(?P<CALLED>[\w.,<>()\s]+?)\s*(?=\{|\n|$)",
    ),
    "swift": Rules(((rf"\b(?:class|actor)\s+(?!func\b|var\b)(?P<name>{N})", "Class"), (rf"\bstruct\s+(?P<name>{N})", "Struct"), (rf"\benum\s+(?P<name>{N})", "Enum"), (rf"\bprotocol\s+(?P<name>{N})", "Interface"), (rf"\bextension\s+(?P<name>{N})", None)), (rf"\bfunc\s+(?P<name>{N})\s*(?:<[^<>]*>)?\s*\(", r"\b(?P<name>init)\s*[?!]?\s*\((?=[^()]*\)\s*\{)"), (r"\bimport[ \t]+(?:(?:class|struct|enum|func|protocol|typealias|let|var)[ \t]+)?([\w.]+)",), r"\s*(?:<[^{:]*?>)?\s*:\s*(?P<INHERITS>[\w.,<>\s]+?)\s*(?=\{|where)"),
    "scala": Rules(((rf"\b(?:class|object)\s+(?P<name>{N})", "Class"), (rf"\btrait\s+(?P<name>{N})", "Interface"), (rf"\benum\s+(?P<name>{N})", "Enum")), (rf"\bdef\s+(?P<name>{N})",), (r"\bimport\s+([^\n;]+)",), r"\s*(?:\[[^\]]*\])?\s*(?:\([^)]*\))?\s*extends\s+(?P<INHERITS>[\w.]+(?:\s+with\s+[\w.]+)*)"),
    "lua": Rules((), (rf"\bfunction\s+(?:(?P<owner>{N})[.:])?(?P<name>{N})\s*\(", rf"\b(?:local\s+)?(?:(?P<owner>{N})\.)?(?P<name>{N})\s*=\s*function\b"), (r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]",), "", "end", r"--\[\[.*?\]\]|--[^\n]*"),
    "bash": Rules((), (rf"(?:^|\n|;)\s*(?:function\s+)?(?P<name>{N}[\w-]*)\s*\(\s*\)\s*(?=\{{)", rf"(?:^|\n|;)\s*function\s+(?P<name>{N}[\w-]*)\s*(?=\{{)"), (r"(?:^|\n|;)\s*(?:source|\.)\s+(\S+)",), "", "{", r"(?:^|(?<=\s))#[^\n]*"),
}
_CALL = re.compile(r"(?<![\w$])(?P<name>[^\W\d][\w$]*)[!?]?\s*(?:::<[^<>()]*>|<[\w\s,.\[\]]*>)?\s*\(")
_COMMAND = re.compile(r"(?:^|[;{|&\n]|\bthen\b|\bdo\b|\belse\b)\s*(?P<name>[A-Za-z_./][\w./-]*)(?=[\s;)])")
_SHELL = frozenset("if then else elif fi for while until do done case esac function return local export readonly declare in select time".split())


def blank(source: str, rules: Rules) -> str:
    """The source with comments and string contents replaced by blanks, of the same length and lines."""
    hide = lambda m: re.sub(r"[^\n]", " ", m.group()) if not m.group()[0] in "\"'`" else m.group()[0] + re.sub(r"[^\n]", " ", m.group()[1:-1]) + m.group()[-1]
    return re.sub(f"{rules.comment}|{rules.strings}", hide, source, flags=re.S)


def _close(text: str, at: int, blocks: str) -> int:
    """The end of the block that the definition whose head ends at ``at`` opens, or ``at`` if it has none."""
    if blocks == "end":
        depth = 1
        for m in re.compile(r"\b(?:class|module|def|do|begin|case|function|repeat|(?<![^\s;])(?:if|unless|while|until|for)|end|until)\b|\n").finditer(text, at):
            word = m.group()
            if word == "\n":
                continue
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            if word in ("if", "unless", "while", "until", "for") and (line.strip() and not line.rstrip().endswith((";", "=", "do", "then", "else"))):
                continue
            if word in ("while", "for", "until") and re.match(r"[^\n;]*\bdo\b", text[m.end() :]):
                continue
            depth += -1 if word == "end" else 1
            if depth == 0:
                return m.end()
        return len(text)
    m = re.compile(r"[{;]|\n\s*(?:\n|(?=(?:\w+\s+)*(?:class|object|trait|def|interface|enum|fun|func|struct|protocol|extension)\b))|=>|=").search(text, at)
    if m is None:
        return at
    if m.group() in ("=>", "="):
        brace = re.compile(r"\s*\{").match(text, m.end())
        if not brace:
            stop = re.compile(r";|\n").search(text, m.end())
            return stop.end() if stop else len(text)
        start = brace.end() - 1
    elif m.group() != "{":
        return at
    else:
        start = m.start()
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _names(text: str) -> list[str]:
    """The last name of each entry of a comma or ``with`` separated list, without type arguments."""
    while "<" in text and re.search(r"<[^<>]*>", text):
        text = re.sub(r"<[^<>]*>", "", text)
    out = []
    for part in re.split(r",|\bwith\b", text):
        words = re.findall(r"[\w$]+", re.sub(r"\(.*", "", part))
        words = [w for w in words if w not in ("public", "private", "protected", "virtual")]
        if words:
            out.append(words[-1])
    return out


def facts(source: str, path: str, language: str) -> list[dict]:
    """Facts in source order, as those of Python but with qualified names; an unknown language gives one ``error`` fact."""
    rules = LANGUAGES.get(language)
    if rules is None:
        return [{"fact": "error", "pos": 0, "name": f"no rules for {language}"}]
    text = blank(source, rules)
    line = lambda at: source.count("\n", 0, at) + 1
    spans: list[tuple[int, int, str, str | None, dict]] = []  # start, end, name, kind, fields
    edges: list[tuple[int, str, str, str]] = []
    for pattern, kind in rules.types:
        for m in re.finditer(pattern, text):
            name = m["name"].split("::")[-1]
            end = _close(text, m.end(), rules.blocks)
            extra = {"is_trait": True} if language == "php" and "trait" in m.group() else {}
            spans.append((m.start("name"), max(end, m.end()), name, kind, {"extra": extra}))
            if m.groupdict().get("trait"):
                edges.append((m.start(), "IMPLEMENTS", name, m["trait"].split("::")[-1]))
            base = re.compile(rules.bases).match(text, m.end()) if rules.bases and kind else None
            for role, listed in base.groupdict().items() if base else ():
                for i, b in enumerate(_names(listed or "") if role != "CALLED" else re.findall(r"[\w.]+\s*\(?", listed or "")):
                    called = role == "CALLED" and b.rstrip().endswith("(")
                    b = b.rstrip("( ").split(".")[-1]
                    edge = role if role in ("INHERITS", "IMPLEMENTS") else ("INHERITS" if called else "IMPLEMENTS") if role == "CALLED" else "IMPLEMENTS" if re.match(r"I[A-Z]", b) else "INHERITS"
                    edges.append((m.start("name"), edge, name, b))
    types = sorted(spans)
    outer = lambda at: [s for s in types if s[0] < at < s[1]]
    chain = lambda at: ".".join(s[2] for s in outer(at))
    found: dict[int, tuple[int, int, str, dict]] = {}
    for pattern in rules.functions:
        for m in re.finditer(pattern, text):
            name, at = m["name"].lstrip("#"), m.start("name")
            head = text[m.start() : m.start("name")]
            if name in NO_NAMES or at in found or re.search(r"\b(?:new|return|else|throw|await)\s+$", head):
                continue
            owner = m.groupdict().get("owner") or chain(at)
            end = _close(text, m.end(), rules.blocks)
            marked = bool(TESTS.search(text[max(0, m.start() - 60) : at].rpartition("}")[2]))
            test = marked or bool(re.match(r"test", name, re.I) and name[:4] in ("test", "Test")) and (language != "go" or path.endswith("_test.go"))
            params = [p.split()[-1].lstrip("$*&") for p in (m.groupdict().get("params") or "").split(",") if p.split()]
            found[at] = (m.start() if language != "bash" else at, max(end, m.end()), name, {"kind": "Test" if test else "Method" if owner else "Function", "parent": owner or None, "params": params, "is_test": test, "end": max(end, m.end())})
    rows: list[tuple[int, dict]] = []
    for at, end, name, kind, fields in types:
        if kind:
            parent = chain(at) or None
            rows.append((at, {"fact": "node", "kind": kind, "name": name, "qualified": f"{parent}.{name}" if parent else name, "parent": parent, "line": line(at), "end_line": line(max(at, end - 1)), "is_test": False, "extra": fields["extra"]}))
    qualified = {}
    for at, (_, end, name, fields) in found.items():
        qualified[at] = f"{fields['parent']}.{name}" if fields["parent"] else name
        rows.append((at, {"fact": "node", "kind": fields["kind"], "name": name, "qualified": qualified[at], "parent": fields["parent"], "line": line(at), "end_line": line(max(at, end - 1)), "is_test": fields["is_test"], "params": fields["params"], "extra": {}}))
    bodies = sorted((at, end) for at, (_, end, _, _) in found.items())
    inside = lambda at: max(((a, e) for a, e in bodies if a < at < e), default=None)
    pattern = _COMMAND if language == "bash" else _CALL
    for m in pattern.finditer(text):
        name, at = m["name"], m.start("name")
        body = inside(at)
        if body is None or name in KEYWORDS or at in found or language == "bash" and (name in _SHELL or text[m.end() : m.end() + 2] == "()"):
            continue
        rows.append((at, {"fact": "edge", "kind": "CALLS", "source": qualified[body[0]], "target": name, "line": line(at)}))
    for at, kind, name, target in edges:
        prefix = chain(at)
        rows.append((at, {"fact": "edge", "kind": kind, "source": f"{prefix}.{name}" if prefix else name, "target": target, "line": line(at)}))
    for at, target in _imports(source, text, language, rules, types):
        rows.append((at, {"fact": "edge", "kind": "IMPORTS_FROM", "source": path, "target": target, "line": line(at)}))
    if language == "php":
        for m in re.finditer(r"\buse\s+([\w\\, ]+);", text):
            if owner := chain(m.start()):
                rows += [(m.start(), {"fact": "edge", "kind": "EXTENDS", "source": owner, "target": t, "line": line(m.start())}) for t in _names(m[1])]
    rows += [(0, {"fact": "node", "kind": "Endpoint", "parent": None, "is_test": False, **e}) for e in endpoints(source, path, language, {f[2]: qualified[a] for a, f in found.items()})]
    return [{**r, "pos": i} for i, (_, r) in enumerate(sorted(rows, key=lambda x: x[0]), 1)]


def _imports(source: str, text: str, language: str, rules: Rules, types) -> list[tuple[int, str]]:
    visible = lambda m: text[m.start() : m.start() + 1] == source[m.start() : m.start() + 1] or not source[m.start()].strip()
    out = [(m.start(), m[1].strip()) for pattern in rules.imports for m in re.finditer(pattern, source) if visible(m)]
    if language == "go":
        for m in re.finditer(r"\bimport\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", source):
            out += [(m.start(), x) for x in (re.findall(r"\"([^\"]+)\"", m[1]) if m[1] is not None else [m[2]])]
    if language == "php":
        for m in re.finditer(r"\buse\s+(?:function\s+|const\s+)?([\w\\]+?)(?:\\\{([^}]*)\})?(?:\s+as\s+\w+)?\s*;", source):
            if not any(s[0] < m.start() < s[1] for s in types):
                out += [(m.start(), m[1] + "\\" + x.split()[0]) for x in m[2].split(",") if x.split()] if m[2] is not None else [(m.start(), m[1])]
        out += [(m.start(), m[1]) for m in re.finditer(r"\b(?:require|require_once|include|include_once)\b[^;\n]*?['\"]([^'\"]+)['\"]", source) if visible(m)]
    return out


# The methods that a route call is named after, and the handlers that a route file may define.
VERBS = frozenset("get post put patch delete".split())
HANDLERS = ("GET", "POST", "PUT", "PATCH", "DELETE", "default", "handler")


def _literal_calls(source: str, text: str) -> list[tuple[int, str, str, str]]:
    """(offset, receiver, name, literal) of the calls on a plain name whose first argument is a string literal."""
    found = []
    for m in _CALL.finditer(text):
        at = m.start("name")
        sign = next((s for s in ("::", "->", ".") if text.endswith(s, 0, at)), None)
        head = text[: at - len(sign)] if sign else ""
        receiver = head[len(head.rstrip("_$abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) :]
        rest = source[m.end() :].lstrip()
        if receiver and rest[:1] in ("'", '"', "`") and (end := rest.find(rest[0], 1)) > 1:
            found.append((at, receiver, m["name"], rest[1:end]))
    return found


def file_route(path: str) -> str | None:
    """The route that a file's place stands for: below ``pages/api``, or a ``route`` file below ``app``; None if it stands for none."""
    parts = path.replace("\\", "/").split("/")
    *folders, last = parts
    stem, _, extension = last.rpartition(".")
    at = next((i + 2 for i in range(len(folders) - 1) if folders[i : i + 2] == ["pages", "api"]), None)
    if at is None:
        at = next((i + 1 for i, f in enumerate(folders) if f == "app"), None)
        if at is None or stem != "route" or extension not in ("js", "jsx", "ts", "tsx") or at == len(folders):
            return None
        named = folders[at:]
    else:
        named = [*folders[at:], *([] if stem == "route" else [stem])]
    return "/" + "/".join(f"{{{p[1:-1]}}}" if p[:1] == "[" and p[-1:] == "]" else p for p in named)


def endpoints(source: str, path: str, language: str, functions: dict[str, str]) -> list[dict]:
    """Routes declared by call (Laravel, Express) or by file (Next.js handlers that the file defines)."""
    rules, found = LANGUAGES.get(language), []
    declared = {"php": ("laravel", {"Route"}, VERBS | {"any"}), "javascript": ("express", {"app", "router"}, VERBS), "typescript": ("express", {"app", "router"}, VERBS)}.get(language)
    if declared and rules:
        framework, receivers, verbs = declared
        for at, receiver, name, where in _literal_calls(source, blank(source, rules)):
            if receiver in receivers and name.lower() in verbs:
                line = source.count("\n", 0, at) + 1
                qualified = f"{framework}.route.{name.lower()}.{where.strip('/').replace('/', '_')}"
                found.append({"name": where, "qualified": qualified, "line": line, "end_line": line, "extra": {"http_method": name.upper(), "path": where, "framework": framework}})
    where = file_route(path) if language in ("javascript", "typescript") else None
    for handler in HANDLERS if where else ():
        if handler in functions:
            extra = {"http_method": handler if handler.isupper() else "ANY", "path": where, "framework": "nextjs", "handler": functions[handler]}
            found.append({"name": handler, "qualified": f"{functions[handler]}__endpoint", "extra": extra})
    return found
