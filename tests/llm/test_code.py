"""Syntax checks and function-documentation pairs."""

import ast
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import docpairs as P
from arbora.llm.syntax import files
from arbora.llm.syntax.engine import Recogniser, network

GOOD = {
    "python": ["", "\n", "# only\n", "x = 1", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    return a\n", "if (n := f()) > 1: pass\nelse:\n\tpass\n", "match x:\n    case {'a': [1, *r], **k} if r: pass\n    case P(a=1) | None: pass\n", "f'{a!r:>{w}} {{}} {d[\"k\"]} {x=}'", "async def f():\n    async with a as b, c: yield\n    return [i async for i in x if i]\n", "try:\n    pass\nexcept* E as e: ...\n", "type A[T: int] = list[T]\n", "class A[T](B, k=1): x: int = 0; y: str\n", "a = b = *c, d\na[1:2, ::3] += 1\n", "lambda *a, k=1, **b: (yield)", "with (open(a) as b, c as d,): pass\n", "x = '''a\n\"b'''; print(1) ; \n", "@a.b(c)\ndef f(): return\n", "match = case = type = 1\nprint(match, type)\n"],
    "javascript": ["", "// c", "const {a, b: [c = 1], ...d} = e, f = /[/]\\/x/g;\n", "a\nb\n++c\n", "for (const x of y) z(x)\nfor (let i = 0; i < 3; i++) {}\n", "class A extends B { #p = 1; static { x() } get v() { return this.#p } async *[k]() {} }", "x = async (a, {b} = {}) => ({...a, [b]: 1, c, d() {}})", "`a${b + `c${d}`}e`;`\n`", "import a, {b as c} from 'x'\nexport default function () {}\nexport * as q from 'y'", "with (a) b", "a?.b?.[c]?.(d) ?? e ? f : g", "label: while (1) { continue label }", "do x(); while (y) z()", "new A.B(c).d, new X", "if (a) b; else c\nreturn1 = 2 / 3 / 4", "try { a } catch { b } finally { c }", "[a, b] = [b, a]; ({a: x.y} = z)", "switch (a) { case 1: default: b }"],
    "java": ["", "package a.b;\nimport static x.Y.*;\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<T> implements G, H<? super I[]> { int a = 1, b[] = {2}; C() throws X { this(1); } static { } <U> U m(final int... x) { return null; } }", "enum E { A(1) { void f() {} }, B; E(int... x) {} }", "record R(int a, @N String... b) implements S { R { check(a); } }", "class A { void f() { List<Map<String, int[]>> x = new ArrayList<>(); int[][] y = new int[3][]; for (var a : b) c = (int) d >>> 2; Runnable r = () -> { }; g(A::new, int[]::new, (a, b) -> a + b); switch (k) { case 1: case 2: break; default: } String t = \"\"\"\n  a \"b\"\n  \"\"\"; int z = switch (k) { case A, B -> 1; default -> { yield 2; } }; if (o instanceof String s && s.isEmpty()) return; try (var q = w; e) { } catch (X | Y e) { } finally { } l: do { continue l; } while (a < b); a <<= b > c ? 1 : 2; synchronized (a) { } assert a : b; } }", "@interface A { int v() default 1; }", "sealed interface S permits A, B {} non-sealed class A implements S {}", "class A { char c = '\\u0041', d = '{'; }"],
    "c": ["", "#include <a.h>\n#define X(a) \\\n  a\nint x;\n", "#if 0\n}}}\n#else\nint y;\n#endif\n", "static inline const char *f(int a[], void (*g)(int), ...) { return g ? (char *) a : \"x\" \"y\"; }", "typedef struct { unsigned x : 3; union { int a; float b; }; } T; enum { A = 1, B, };", "foo_t *g(void) { foo_t x = { .a = 1, [2] = { 3 } }; for (int i = 0; i < 3; ++i) if (x.a) continue; else break; switch (x) { case 1 ... 3: default: ; } goto end; end: return &(foo_t){ 1 }; }", "int (*fp)(int) = 0, arr[2][3] = {{1}}; extern int z;", "_Static_assert(sizeof(int) == 4, \"x\");", "int f(a, b) int a; long b; { return a; }", "void f(void) { do { a->b.c++; } while (x && !y); a = b = c, d ? e : f; (void) 0; sizeof x; }", "char c = '\\'', *s = \"/* no */ // no\"; /* yes */ int z; // end"],
}
BAD = {
    "python": ["def f(:\n", "if x\n    pass\n", "x = (1,\n", "  x = 1\ny = 2\n", "def f():\nreturn\n", "f() = 1\n", "a = 'x\n", "f'{a'", "f'{}'", "<<<<<<< a\nx = 1\n=======\n", "{\n  \"a\": 1,\n}}", "import\n", "x = 1 2\n", "const x = require('y');\n", "class A {\n}\n", "print 'x'\n", "else:\n    pass\n", "x = 08\n", "not = 1\n", "'''a", "while True:\n# c\n", "a + not b\n", "return = 3"],
    "javascript": ["function f( {", "const x = ;", "if (a {", "a = 'x\n'", "/* a", "`a${b`", "{ \"a\": 1, \"b\": 2 }", "<<<<<<< x", "def f():\n    return 1\n", "class A { x( }", "for (const of) {}", "a b", "x = /a", "#include <a.h>", "foo(1, 2", "}", "const const = 1", "1 = 2", "return1 ) 2", "{\n  \"a\": 1,\n  \"b\": [2]\n}\n", "x => {a: 1, b: 2}"],
    "java": ["class A {", "class A { int f() { return 1 } }", "class A { void f() { a b c; } }", "int f() {}", "class A { void f() { x = 1; } }}", "<html></html>", "class A { String s = \"a\n\"; }", "class A { void f() { <<<<<<< a\n } }", "import a.b", "# x", "class A { void f() { a + b; } }", "class A { char c = ''; }"],
    "c": ["int f( {", "int x = ;", "int f(void) { return 1 }", "int x = 1", "const x = 1;", "function f(a) { return a; }", "/* a", "char *s = \"a\n\";", "# Heading\n", "#if 1\nint x;\n", "int f(void) { if (a { } }", "package a.b;", "<html>", "{ \"a\": 1 }", "foo bar baz;", "def f():\n  pass\n", "int f(void) { a = b c; }", "int a[3;", "long f(long a) {\n<<<<<<< x\n}"],
}


@pytest.mark.parametrize("language", GOOD)
def test_languages(language):
    checker = files.Checker()
    for text in GOOD[language]:
        assert checker.problem(text, language) is None, text
        if language == "python":
            ast.parse(text)
    for text in BAD[language]:
        assert checker.problem(text, language) is not None, text
        if language == "python":
            with pytest.raises(SyntaxError):
                ast.parse(text)


@given(st.lists(st.sampled_from(["x", "y", " ", "\n", "    ", "(", ")", "[", "]", ":", ",", "=", "if ", "else", "def ", "return ", "1", "'s'", "+", "*", ".", "not ", "lambda ", "for ", "in ", "pass"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_python_agrees_with_the_interpreter(parts):
    text = "".join(parts)
    try:
        ast.parse(text)
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    if valid:
        assert CHECKER.problem(text, "python") is None


CHECKER = files.Checker()


def test_engine_is_general():
    palindromes = Recogniser(network("file: s END\ns: 'a' s 'a' | 'b' s 'b' | 'a' | 'b'\n", ("d",), ()))
    assert palindromes.accepts([*"abababa", "END"]) and not palindromes.accepts([*"abab", "END"])
    left = Recogniser(network("file: e END\ne: e '+' e | 'x'\n", ("d",), ()))
    assert left.accepts([*"x+x+x", "END"]) and not left.accepts([*"x+", "END"])
    dialects = Recogniser(network("file: s END\ns: 'a' | @new 'b' | @=old 'c'\n", ("old", "new"), ("s",)))
    assert [dialects.accepts([k, "END"]) for k in "abc"] == [3, 2, 1]
    with pytest.raises(ValueError):
        network("file: a? \n", ("d",), ())


PARSES = "repo string, file_path string, language string, source_text string, errors array<string>, parsed_at timestamp, problem int, code int"
DAY = lambda n: datetime(2030, 1, n)


def test_files(spark):
    rows = [("r", "a.py", None, "x = (", None, DAY(1), 1, 1), ("r", "a.py", "python", "x = 1", ["e"], DAY(2), 1, 1), ("r", "b.js", "python", "x = (", [], DAY(1), 1, 1), ("r", "b.js", "python", "x = (", [], DAY(1), 1, 1), (None, "c.c", None, None, None, None, 1, 1), ("r", "d.java", None, "", None, DAY(1), 1, 1), ("r", "e.txt", None, "((", None, DAY(1), 1, 1), ("r", None, None, "((", None, DAY(1), 1, 1), ("other", "deep.js", None, "x = " + "[" * 20000 + "]" * 20000, None, DAY(1), 1, 1), ("r", "deep.py", None, "x = " + "(" * 20000 + ")" * 20000, None, DAY(1), 1, 1), ("r", "long.py", None, "x = 1\n" * 50000, None, DAY(1), 1, 1)]
    parses = spark.createDataFrame(rows, PARSES)
    got = {r["file_path"]: r["problem"] for r in files.checked(parses).collect()}
    assert got.pop("b.js") and "deep.py" in got and set(got) == {"a.py", "c.c", "d.java", "deep.js", "deep.py", "e.txt", "long.py"} and not any(got.values())
    rates = {(r["repo"], r["language"]): (r["files"], r["broken"]) for r in files.rates(parses).collect()}
    assert rates[("r", "javascript")] == (1, 1) and rates[(None, "c")] == (1, 0)
    assert files.checked(parses.limit(0)).count() == 0


def test_deep_files_are_decided(spark):
    """Nested beyond any stack: what is broken is flagged, what isn't is not."""
    n = 12000
    texts = {"a.py": ("x = " + "(" * n, "1", ")" * n), "b.js": ("x = " + "[" * n, "1", "]" * n), "c.java": ("class A { int x = " + "(" * n, "1", ")" * n + "; }"), "d.c": ("int x = " + "(" * n, "1", ")" * n + ";"), "e.c": ("#define X " + "/* \n */" * n + "\nint x", "", ";")}
    rows = [("r", f"{kind}/{path}", None, a + (m if kind == "good" else m + " 1 1") + b, None, DAY(1), 1, 1) for path, (a, m, b) in texts.items() for kind in ("good", "bad")]
    got = {r["file_path"]: r["problem"] for r in files.checked(spark.createDataFrame(rows, PARSES)).collect()}
    assert {p for p, x in got.items() if x} == {f"bad/{p}" for p in texts} and len(got) == 2 * len(texts)
    spec = lambda k: "f'" + "{a:" * k + "}" * k + "'"
    assert [bool(CHECKER.problem(spec(k), "python")) for k in (3, 4, 12000)] == [False, True, True]


SAYS_NOTHING = [
    ("", "empty"), ("/** */", "empty"), ("'''\n   '''", "empty"), ("-----", "empty"), (" ​ ", "empty"), ("//", "empty"), ("/**\n * @param a\n * @return\n */", "tags"), (":param int a:\n:rtype: str", "tags"), ("@param {string} a\n@returns {Promise<void>}", "tags"),
    ("TODO", "placeholder"), ("{@inheritDoc}", "placeholder"), ("N/A.", "placeholder"), ("See base class.", "placeholder"), ("Auto-generated method stub", "placeholder"), ("noqa: E501", "directive"), ("type: ignore[x]", "directive"), ("eslint-disable-next-line no-x", "directive"),
    ("Loads the cached user.", "repeats"), ("load_cached_user", "repeats"), ("loadCachedUser()", "repeats"), ("This function is used to load cached users.", "repeats"), ("load_cached_user(a, b)", "repeats"), ("def load_cached_user(a: int) -> str:", "repeats"), ("int loadCachedUser(int a)", "repeats"), ("Loading cached user", "repeats"),
]
SAYS_SOMETHING = ["Not thread safe.", "Loads the cached user, or nothing if it expired.", "@param a the key of the user", ":param a: key to look up", "Amortised O(1).", "返回尚未提交的条目。", "@return true if it was loaded", "None of the users are loaded twice.", "# Loads a user\n# lazily.", "See the notes on caching."]


@pytest.mark.parametrize("doc,reason", SAYS_NOTHING)
def test_trivial(doc, reason):
    name = "loadCachedUser" if "loadCached" in doc else "load_cached_user"
    assert P.trivial(doc, name, "a, b") == reason


@pytest.mark.parametrize("doc", SAYS_SOMETHING)
def test_not_trivial(doc):
    assert P.trivial(doc, "load_cached_user") is None


def test_extraction():
    js = "/** Adds. */\nfunction add(a, b) { return `}${a}`; /* } */ }\n// One.\n// Two.\nconst mul = (a) => { return /[}]/.test(a); };\nclass C {\n  // Says.\n  say() { if (x) { y(); } }\n}\n"
    got = {r[0]: r for r in P.functions_of(js, "javascript")}
    assert set(got) == {"add", "mul", "say"} and got["add"][3] == "/** Adds. */" and got["mul"][3] == "// One.\n// Two." and got["say"][1:3] == (8, 8)
    py = '@d\ndef f(a, b="):"):\n    """Doc."""\n    if a:\n        x = """\ndef no():\n"""\n    # c\n\n    return a\n\nclass C:\n    async def g(self): pass\n'
    got = {r[0]: r for r in P.functions_of(py, "python")}
    assert set(got) == {"f", "g"} and got["f"][1:4] == (2, 10, '"""Doc."""') and got["g"][1:3] == (13, 13)
    java = "class A {\n  /** Runs. */\n  @Override\n  public <T> void run(int a) throws X, Y { new Z() { void in() {} }; }\n  int x = f();\n}\n"
    got = {r[0]: r for r in P.functions_of(java, "java")}
    assert set(got) == {"run", "in"} and got["run"][3] == "/** Runs. */"
    c = "#define F(a) {\n/* Adds. */\nstatic long add(long a)\n{\n  if (a) { char c = '{'; }\n  return a;\n}\n"
    assert [(r[0], r[1], r[2], r[3]) for r in P.functions_of(c, "c")] == [("add", 3, 7, "/* Adds. */")]


def test_pairs(spark):
    parses = spark.createDataFrame([("r", "a.py", "python", "def f(a):\n    '''Says it.'''\n    return a\n\ndef i():\n    'Says it.'\n\ndef j():\n    'Says it.'\n", None, DAY(1), 1, 1)], PARSES)
    nodes = spark.createDataFrame([("m.f", "Function", "f", "a.py", 1, "Says it.", 0), ("m.f", "Function", "f", "a.py", 1, "Says it.", 0), ("m.g", "Method", "g", "gone.py", 3, "f", 0), ("m.h", "Function", None, None, None, None, 0), ("m.i", "Function", "i", "a.py", 5, "noqa: D100", 0), ("m.j", "Method", "j", "a.py", 8, None, 0), ("m.C", "Class", "C", "a.py", 1, "Says.", 0), (None, "Function", "f", "a.py", 1, "Says.", 0)], "qualified_name string, kind string, name string, file_path string, range_start int, docstring string, code int")
    got = {r["qualified_name"]: r for r in P.pairs(parses, nodes).collect()}
    assert set(got) == {"m.f", "m.i", "m.j"}
    assert got["m.i"]["reason"] == "directive" and got["m.j"]["reason"] == "missing"  # the node's words count where they differ
    assert got["m.f"]["reason"] is None and got["m.f"]["code"].startswith("def f") and got["m.f"]["source_doc"] == "'''Says it.'''"
    assert {r["qualified_name"] for r in P.unpaired(parses, nodes).collect()} == {"m.g", "m.h"}
    assert P.pairs(parses.limit(0), nodes).count() == 0 and P.pairs(parses, nodes.limit(0)).count() == 0
    assert P.unpaired(parses.limit(0), nodes).count() == 5 and P.unpaired(parses, nodes.limit(0)).count() == 0
