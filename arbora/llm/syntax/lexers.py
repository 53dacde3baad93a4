"""Tokens of the languages: what a token is, not what it may follow."""

from __future__ import annotations

import re


class LexError(ValueError):
    """The text holds something that is no token of the language."""


# Reserved words and operators of the languages.
PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
PY_SIGNS = "**= //= >>= <<= ... != == <= >= -> := += -= *= /= %= &= |= ^= @= ** // << >> ( ) [ ] { } + - * / % & | ^ ~ @ < > = . , : ;".split()
JS_WORDS = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false let static yield await async of get set enum from as".split())
JS_SIGNS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split()
JAVA_WORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed permits var yield when non-sealed module".split())
JAVA_SIGNS = "... <<= -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << ( ) { } [ ] ; , . @ = > < ! ~ ? : + - * / & | ^ %".split()
C_WORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local alignas alignof bool constexpr nullptr static_assert thread_local typeof typeof_unqual true false __attribute__ __asm__ asm __asm __inline __inline__ __extension__ __typeof__ __restrict __restrict__ __volatile__ __const".split())
C_SIGNS = "... <<= >>= -> ++ -- << >> <= >= == != && || *= /= %= += -= &= ^= |= [ ] ( ) { } . & * + - ~ ! / % < > ^ | ? : ; = ,".split()
C_DIRECTIVES = frozenset("include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident embed".split())


def _signs(signs: list[str]) -> str:
    return "|".join(re.escape(s) for s in sorted(signs, key=len, reverse=True))


_PY = re.compile(
    r"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<nl>\n)"
    r"|(?P<str>(?P<prefix>(?i:rb|br|[rbuft]|fr|rf|tr|rt)?)(?P<quote>\"\"\"|'''|\"|'))"
    r"|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<id>[^\W\d]\w*)"
    rf"|(?P<op>!=|{_signs(PY_SIGNS)})"
)
_PY_END = {q: re.compile(r"(?:[^\\" + q[0] + r"]|\\.|" + (f"{q[0]}(?!{q[0]}{q[0]})" if len(q) == 3 else r"(?!)") + ")*" + q, re.S) for q in ('"""', "'''", '"', "'")}
_OPENERS, _CLOSERS = {"(": ")", "[": "]", "{": "}"}, ")]}"


def python(text: str, field=None) -> tuple[list[str], None]:
    """Tokens with NEWLINE, INDENT and DEDENT. field is called with the source of every expression inside an f-string."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        raise LexError("null character")
    kinds: list[str] = []
    stack, indents = [], [(0, 0)]
    at, n, line_start = 0, len(text), True
    while at < n:
        if line_start and not stack:
            m = re.compile(r"[ \t\f]*").match(text, at)
            end = m.end()
            if end >= n or text[end] in "\n#" or text.startswith("\\\n", end):
                if end < n and text[end] == "#":
                    end = text.find("\n", end)
                    end = n if end < 0 else end
                if end < n and text[end] == "\n":
                    at = end + 1
                    continue
                if end >= n:
                    break
            white = m.group().rpartition("\f")[2]
            width = len(white.expandtabs(8)), len(white.replace("\t", " "))
            if width[0] > indents[-1][0]:
                if width[1] <= indents[-1][1]:
                    raise LexError("inconsistent indentation")
                indents.append(width)
                kinds.append("INDENT")
            while width[0] < indents[-1][0]:
                indents.pop()
                kinds.append("DEDENT")
            if width != indents[-1]:
                raise LexError("indentation matches no outer level")
            at = m.end()
            line_start = False
        m = _PY.match(text, at)
        if m is None:
            raise LexError(f"character {text[at]!r}")
        group = m.lastgroup if m.lastgroup not in ("prefix", "quote") else "str"
        at = m.end()
        if m["str"] is not None:
            quote = m["quote"]
            end = _PY_END[quote].match(text, at)
            if end is None or len(quote) == 1 and re.search(r"(?<!\\)(?:\\\\)*\n", text[at : end.end()]):
                raise LexError("string without end")
            if field is not None and set(m["prefix"].lower()) & {"f", "t"}:
                _fields(text[at : end.end() - len(quote)], field)
            at = end.end()
            kinds.append("STR")
        elif group == "nl":
            if not stack:
                kinds.append("NEWLINE")
                line_start = True
        elif group == "num":
            if at < n and (text[at].isalnum() or text[at] == "_") and not re.match(r"(?:if|else|and|or|in|is|for|not)\b", text[at:]):
                raise LexError("malformed number")
            if re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", m.group()):
                raise LexError("leading zeros")
            kinds.append("NUM")
        elif group == "id":
            word = m.group()
            if not word.isidentifier():
                raise LexError(f"name {word!r}")
            kinds.append(word if word in PY_WORDS else "NAME")
        elif group == "op":
            sign = m.group()
            if sign in _OPENERS:
                stack.append(_OPENERS[sign])
            elif sign in _CLOSERS and (not stack or stack.pop() != sign):
                raise LexError(f"unmatched {sign}")
            kinds.append(sign)
    if stack:
        raise LexError(f"missing {stack[-1]}")
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        kinds.append("NEWLINE")
    kinds += ["DEDENT"] * (len(indents) - 1)
    return [*kinds, "END"], None


def _fields(body: str, field, level: int = 1) -> None:
    """Calls field with each replacement field's expression; format specifications are looked into as well, to the depth Python allows."""
    at, n = 0, len(body)
    while at < n:
        c = body[at]
        if c == "{" and body.startswith("{{", at) or c == "}" and body.startswith("}}", at):
            at += 2
        elif c == "}":
            raise LexError("single } in f-string")
        elif c == "{":
            if level > 3:
                raise LexError("f-string fields nested too deeply")
            start, depth, quote = at + 1, 0, ""
            at += 1
            stop = None
            while at < n:
                c = body[at]
                if quote:
                    if body.startswith(quote, at):
                        at += len(quote) - 1
                        quote = ""
                elif c in "\"'":
                    quote = c * 3 if body.startswith(c * 3, at) else c
                    at += len(quote) - 1
                elif c in "([{":
                    depth += 1
                elif c in ")]":
                    depth -= 1
                elif c == "}" and depth:
                    depth -= 1
                elif not depth and (c in ":}" or c == "!" and body[at + 1 : at + 2] != "="):
                    stop = at
                    break
                at += 1
            if stop is None:
                raise LexError("f-string field without end")
            source = re.sub(r"(?<![=!<>])=\s*$", "", body[start:stop])
            field(source)
            if body[stop] == "!":
                m = re.compile(r"!\s*[rsa]\s*").match(body, stop)
                if m is None or m.end() >= n or body[m.end()] not in ":}":
                    raise LexError("f-string conversion")
                stop = m.end()
            if body[stop] == ":":
                depth, at = 1, stop + 1
                while at < n and depth:
                    depth += {"{": 1, "}": -1}.get(body[at], 0)
                    at += 1
                if depth:
                    raise LexError("f-string field without end")
                _fields(body[stop + 1 : at - 1], field, level + 1)
            else:
                at = stop + 1
        else:
            at += 1


_NUMBER_TAIL = re.compile(r"[\w$]")
_JS = re.compile(
    r"(?P<ws>[ \t\v\f ﻿  -   　]+)|(?P<nl>[\n\r  ]+)|(?P<line>//[^\n\r  ]*)|(?P<block>/\*.*?\*/)"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"
    r"|(?P<num>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*(?:n|\.?(?:[eE][+-]?\d(?:_?\d)*)?))"
    r"|(?P<id>(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    rf"|(?P<tpl>`)|(?P<op>{_signs(JS_SIGNS)})",
    re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_JS_TPL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_JS_VALUE = frozenset(("NAME", "NUM", "STR", "REGEX", "TPL", "TPL_TAIL", ")", "]", "}", "this", "super", "null", "true", "false", "of", "get", "set", "static", "async", "let", "from", "as", "++", "--"))


def javascript(text: str) -> tuple[list[str], list[bool]]:
    """Tokens, and for each whether a line break stands before it. Template literals are TPL, or TPL_HEAD, TPL_MID and TPL_TAIL."""
    kinds, newline, depth, templates = [], [], 0, []
    at, n, broken = 0, len(text), False
    if text.startswith("#!"):
        at = (text.find("\n") + n + 1) % (n + 1)

    def put(kind: str) -> None:
        nonlocal broken
        kinds.append(kind)
        newline.append(broken)
        broken = False

    def template(at: int, whole: str, part: str) -> int:
        end = _JS_TPL.match(text, at).end()
        if end >= n:
            raise LexError("template without end")
        if text[end] == "`":
            put(whole)
            return end + 1
        put(part)
        templates.append(depth)
        return end + 2

    while at < n:
        m = _JS.match(text, at)
        if m is None:
            raise LexError(f"character {text[at]!r}")
        group = m.lastgroup
        if group == "op":
            sign = m.group()
            if sign in ("/", "/="):
                last = kinds[-1] if kinds else ""
                is_value = last in _JS_VALUE and not (last == "}" and "\n" in text[max(0, at - 200) : at].rpartition("}")[2])
                if not is_value:
                    m = _JS_REGEX.match(text, at)
                    if m is None:
                        raise LexError("regular expression without end")
                    put("REGEX")
                    at = m.end()
                    continue
            if sign == "{":
                depth += 1
            elif sign == "}":
                if templates and templates[-1] == depth:
                    templates.pop()
                    at = template(at + 1, "TPL_TAIL", "TPL_MID")
                    continue
                depth -= 1
            elif sign == "?." and m.end() < n and text[m.end()].isdigit():
                put("?")
                at += 1
                continue
            put(sign)
        elif group == "nl":
            broken = True
        elif group == "block":
            broken |= "\n" in m.group()
        elif group == "id":
            put(m.group() if m.group() in JS_WORDS else "NAME")
        elif group == "tpl":
            at = template(m.end(), "TPL", "TPL_HEAD")
            continue
        elif group == "num":
            if _NUMBER_TAIL.match(text, m.end()):
                raise LexError("malformed number")
            put("NUM")
        elif group == "str":
            put("STR")
        at = m.end()
    if templates:
        raise LexError("template without end")
    put("END")
    newline[-1] = True
    return kinds, newline


_JAVA = re.compile(
    r"(?P<ws>\s+)|(?P<line>//[^\n\r]*)|(?P<block>/\*.*?\*/)"
    r"|(?P<text>\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\")|(?P<str>\"(?:[^\"\\\n\r]|\\.)*\")|(?P<char>'(?:[^'\\\n\r]|[\ud800-\udbff][\udc00-\udfff]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n\r]))')"
    r"|(?P<num>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[\d_]+[fFdD]?|0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?|(?:\d(?:[\d_]*\d)?)?\.\d(?:[\d_]*\d)?(?:[eE][+-]?\d+)?[fFdD]?|\d(?:[\d_]*\d)?(?:\.?[eE][+-]?\d+[fFdD]?|\.[fFdD]?|[fFdDlL])?)"
    rf"|(?P<id>non-sealed\b|[^\W\d][\w$]*|\$[\w$]*)|(?P<op>{_signs(JAVA_SIGNS)})",
    re.S,
)


def java(text: str) -> tuple[list[str], None]:
    """Tokens; ``>`` is always one of its own, so shifts are two or three of them."""
    return _plain(text.removesuffix("\x1a"), _JAVA, JAVA_WORDS), None


_C = re.compile(
    r"(?P<ws>[\s\\]+)|(?P<line>//(?:\\\n|[^\n])*)|(?P<block>/\*.*?\*/)"
    r"|(?P<str>(?:u8|[LuU])?\"(?:[^\"\\\n]|\\(?:\n|.))*\")|(?P<char>(?:u8|[LuU])?'(?:[^'\\\n]|\\(?:\n|.))+')"
    r"|(?P<num>\.?\d(?:[eEpP][+-]|'?[\w.])*)"
    rf"|(?P<id>[^\W\d][\w$]*)|(?P<op>{_signs(C_SIGNS)})",
    re.S,
)
_C_NUMBER = re.compile(r"(?:0[xX](?:[\da-fA-F']+\.?[\da-fA-F']*|\.[\da-fA-F']+)(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:[uUlLfFdDqQzZiIwWjJbB]|df|dd|dl|bf16|[fF]\d+x?)*")


def c(text: str) -> tuple[list[str], None]:
    """Tokens after the directives are taken out; of conditional parts the first counts, unless its condition is 0."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    kinds, at, n = [], 0, len(text)
    line_start, live = True, []  # live: per open condition whether its current part counts, and whether one has counted
    text = re.sub(r"\\[ \t]*\n", lambda m: " " * len(m.group()), text) if "\\" in text else text
    while at < n:
        if line_start:
            m = re.compile(r"(?:[ \t\f\v]|/\*.*?\*/)*#", re.S).match(text, at)
            if m:
                end = _line_end(text, m.end())
                _directive(text[m.end() : end], live)
                at = end
                continue
        m = _C.match(text, at)
        if m is None:
            if live and not all(x[0] for x in live):
                at += 1
                line_start = text[at - 1] == "\n"
                continue
            raise LexError(f"character {text[at]!r}")
        word, group = m.group(), m.lastgroup
        line_start = "\n" in word if group in ("ws", "block") else group == "line" and line_start
        if group == "ws" and "\n" in word:
            at = at + word.rindex("\n") + 1
            continue
        at = m.end()
        if group in ("ws", "line", "block") or live and not all(x[0] for x in live):
            continue
        if group == "num" and not _C_NUMBER.fullmatch(word):
            raise LexError(f"malformed number {word!r}")
        kinds.append({"str": "STR", "char": "NUM", "num": "NUM"}.get(group) or (word if group == "op" or word in C_WORDS else "NAME"))
    if live:
        raise LexError("#if without #endif")
    return [*kinds, "END"], None


def _line_end(text: str, at: int) -> int:
    """The end of a directive: the line's, or that of a comment which runs over it."""
    mark = re.compile(r"\n|//|/\*|\"(?:[^\"\\\n]|\\.)*\"", re.S)
    while (m := mark.search(text, at)) is not None:
        at = m.end()
        if m.group() == "\n":
            return m.start()
        if m.group() == "/*":
            close = text.find("*/", m.end())
            if close < 0:
                raise LexError("comment without end")
            if "\n" in text[m.end() : close]:
                at = close + 2
        if m.group() == "//":
            end = text.find("\n", m.end())
            return len(text) if end < 0 else end
    return len(text)


def _directive(line: str, live: list[list[bool]]) -> None:
    line = re.sub(r"/\*.*?\*/", " ", line, flags=re.S).strip()
    m = re.match(r"(\w*)\s*(.*)", line, re.S)
    if m is None:
        raise LexError("malformed directive")
    name, rest = m.groups()
    on = all(x[0] for x in live)
    if name in ("if", "ifdef", "ifndef"):
        if on and not rest:
            raise LexError(f"#{name} without condition")
        counts = not (name == "if" and re.fullmatch(r"0\b.*", rest.split("//")[0].strip() or "1"))
        live.append([counts, counts])
    elif name in ("elif", "elifdef", "elifndef", "else"):
        if not live:
            raise LexError(f"#{name} without #if")
        live[-1] = [not live[-1][1], True]
    elif name == "endif":
        if not live:
            raise LexError("#endif without #if")
        live.pop()
    elif on:
        if name and not name.isdigit() and name not in C_DIRECTIVES:
            raise LexError(f"directive #{name}")
        if not name and line:
            raise LexError("malformed directive")
        if name == "include" and not re.match(r"<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]", rest):
            raise LexError("#include without a file")
        if name in ("define", "undef") and not re.match(r"[^\W\d]", rest):
            raise LexError(f"#{name} without a name")


def _plain(text: str, pattern: re.Pattern, words: frozenset[str]) -> list[str]:
    kinds, at, n = [], 0, len(text)
    if text.startswith("﻿"):
        at = 1
    while at < n:
        m = pattern.match(text, at)
        if m is None:
            raise LexError(f"character {text[at]!r}")
        group, word, at = m.lastgroup, m.group(), m.end()
        if group in ("ws", "line", "block"):
            continue
        if group == "id":
            kinds.append(word if word in words else "NAME")
        elif group == "op":
            kinds.append(word)
        elif group == "num":
            if at < n and (text[at].isalnum() or text[at] in "_$"):
                raise LexError("malformed number")
            kinds.append("NUM")
        else:
            kinds.append("NUM" if group == "char" else "STR")
    return [*kinds, "END"]
