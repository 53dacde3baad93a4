"""Extractors and listing rules on small fixtures."""

import ast
import json

import pytest

from arbora.operators.graph import current_edges
from arbora.sources import config, generic_facts, python_facts, scip, walk
from arbora.sources.ingest import build, register_languages
from arbora.streaming.refresh import LiveGraph

CASES = {
    ("go", "srv_test.go"): ('package a\nimport (\n "fmt"\n x "ex.com/api"\n)\ntype Srv struct{}\ntype H interface{ Go() }\nfunc (s *Srv) Go() { fmt.Println("x"); help() }\nfunc help() {}\nfunc TestGo(t *testing.T) {}\n',
        {("Struct", "Srv"), ("Interface", "H"), ("Method", "Srv.Go"), ("Function", "help"), ("Test", "TestGo")}, {("Srv.Go", "Println"), ("Srv.Go", "help")}, {"fmt", "ex.com/api"}, set()),
    ("rust", "a.rs"): ("use std::fmt::{Debug, Display};\nstruct P {}\nenum S { A }\ntrait T { fn area(&self) -> f64; }\nimpl T for P { fn area(&self) -> f64 { help(); self.norm(); P::new() } }\nfn help() {}\n#[test]\nfn checks() {}\n",
        {("Struct", "P"), ("Enum", "S"), ("Interface", "T"), ("Method", "P.area"), ("Function", "help"), ("Test", "checks")}, {("P.area", "help"), ("P.area", "norm"), ("P.area", "new")}, {"std::fmt"}, {("IMPLEMENTS", "P", "T")}),
    ("java", "S.java"): ("import java.util.Map;\npublic class S extends B implements R {\n public S() {}\n public void run() { help(); this.log(); new W(); }\n @Test void ok() {}\n}\ninterface R {}\nenum M { ON }\n",
        {("Class", "S"), ("Method", "S.S"), ("Method", "S.run"), ("Test", "S.ok"), ("Interface", "R"), ("Enum", "M")}, {("S.run", "help"), ("S.run", "log"), ("S.run", "W")}, {"java.util.Map"}, {("INHERITS", "S", "B"), ("IMPLEMENTS", "S", "R")}),
    ("csharp", "S.cs"): ("using System.Text;\nnamespace A {\n public class S : B, IRun {\n  public void Run() { Help(); log.Write(); }\n  [Fact] public void Ok() {}\n }\n interface IRun {}\n struct P {}\n}\n",
        {("Class", "S"), ("Method", "S.Run"), ("Test", "S.Ok"), ("Interface", "IRun"), ("Struct", "P")}, {("S.Run", "Help"), ("S.Run", "Write")}, {"System.Text"}, {("INHERITS", "S", "B"), ("IMPLEMENTS", "S", "IRun")}),
    ("c", "u.c"): ('#include <stdio.h>\n#include "u.h"\nstruct pt { int x; };\nstatic int *scale(int a) { printf("f(x)"); return help(a); }\n', {("Struct", "pt"), ("Function", "scale")}, {("scale", "printf"), ("scale", "help")}, {"stdio.h", "u.h"}, set()),
    ("cpp", "w.cpp"): ("#include <vector>\nclass W : public B { void draw(); };\nvoid W::draw() { paint(); c.flush(); std::sort(); }\n", {("Class", "W"), ("Method", "W.draw")}, {("W.draw", "paint"), ("W.draw", "flush"), ("W.draw", "sort")}, {"vector"}, {("INHERITS", "W", "B")}),
    ("ruby", "c.rb"): ('require "json"\nmodule A\n  class C < B\n    def get(p); ask(p); http.read(p); end\n    def self.build; end\n  end\nend\n', {("Module", "A"), ("Class", "A.C"), ("Method", "A.C.get"), ("Method", "A.C.build")}, {("A.C.get", "ask"), ("A.C.get", "read")}, {"json"}, {("INHERITS", "A.C", "B")}),
    ("kotlin", "C.kt"): ("import k.x.delay\nclass C : B(), D { fun get() { ask(); h.read() } }\ninterface D {}\nfun build() {}\n", {("Class", "C"), ("Method", "C.get"), ("Interface", "D"), ("Function", "build")}, {("C.get", "ask"), ("C.get", "read")}, {"k.x.delay"}, {("INHERITS", "C", "B"), ("IMPLEMENTS", "C", "D")}),
    ("swift", "C.swift"): ("import Foundation\nclass C: B { func get() { ask(); h.read() } }\nstruct F {}\nprotocol D {}\nenum M { case on }\nextension C { func close() {} }\n", {("Class", "C"), ("Method", "C.get"), ("Method", "C.close"), ("Struct", "F"), ("Interface", "D"), ("Enum", "M")}, {("C.get", "ask"), ("C.get", "read")}, {"Foundation"}, {("INHERITS", "C", "B")}),
    ("scala", "C.scala"): ("import s.u.Try\nclass C extends B { def get(): Unit = { ask(); h.read() } }\ntrait D\nobject C { def apply() = new C() }\n", {("Class", "C"), ("Method", "C.get"), ("Interface", "D"), ("Method", "C.apply")}, {("C.get", "ask"), ("C.get", "read")}, {"s.u.Try"}, {("INHERITS", "C", "B")}),
    ("lua", "c.lua"): ('local j = require("json")\nlocal M = {}\nfunction M.get(p) ask(p); h:read(p) end\nlocal function help() end\n', {("Method", "M.get"), ("Function", "help")}, {("M.get", "ask"), ("M.get", "read")}, {"json"}, set()),
    ("bash", "d.sh"): ("source ./lib.sh\nbuild() { compile; echo done; }\nfunction deploy { build; }\n", {("Function", "build"), ("Function", "deploy")}, {("build", "compile"), ("build", "echo"), ("deploy", "build")}, {"./lib.sh"}, set()),
    ("javascript", "s.mjs"): ('import { db } from "./db.js";\nconst fs = require("fs");\nexport const go = async (r) => { check(r); return db.save(r); };\nclass U extends B {\n  login(u) { return this.a.ask(u); }\n}\nfunction main() { go(1); new U(); [1].map((x) => help(x)); }\nconst lazy = () => import("./lazy.js");\n',
        {("Function", "go"), ("Class", "U"), ("Method", "U.login"), ("Function", "main"), ("Function", "lazy")}, {("go", "check"), ("go", "save"), ("U.login", "ask"), ("main", "go"), ("main", "U"), ("main", "help")}, {"./db.js", "fs", "./lazy.js"}, {("INHERITS", "U", "B")}),
    ("php", "C.php"): ('<?php\nnamespace A\\B;\nuse A\\M\\User;\nuse I\\S\\{Str, Arr as X};\nrequire_once __DIR__ . "/h.php";\ntrait T {}\nclass C extends P implements R {\n use T;\n public function show($id) { stop(!$id); $this->may(); User::find($id); new Res(); }\n public function testShow() {}\n}\n',
        {("Class", "T"), ("Class", "C"), ("Method", "C.show"), ("Test", "C.testShow")}, {("C.show", "stop"), ("C.show", "may"), ("C.show", "find"), ("C.show", "Res")}, {"A\\M\\User", "I\\S\\Str", "I\\S\\Arr", "/h.php"}, {("INHERITS", "C", "P"), ("IMPLEMENTS", "C", "R"), ("EXTENDS", "C", "T")}),
    ("typescript", "r.ts"): ('import { B } from "./b";\nexport * from "./t";\nexport abstract class R<T> extends B<T> implements S, D {\n  find(id: string): T { return ask(id); }\n}\ninterface S extends N {}\nenum C { Red }\ntype Id = string;\n',
        {("Class", "R"), ("Method", "R.find"), ("Interface", "S"), ("Enum", "C"), ("Type", "Id")}, {("R.find", "ask")}, {"./b", "./t"}, {("INHERITS", "R", "B"), ("IMPLEMENTS", "R", "S"), ("IMPLEMENTS", "R", "D"), ("INHERITS", "S", "N")}),
}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_languages(case):
    source, nodes, calls, imports, bases = CASES[case]
    rows = generic_facts.facts(source, case[1], case[0])
    edges = [r for r in rows if r["fact"] == "edge"]
    assert nodes <= {(r["kind"], r["qualified"]) for r in rows if r["fact"] == "node"}
    assert calls <= {(r["source"], r["target"]) for r in edges if r["kind"] == "CALLS"}
    assert imports == {r["target"] for r in edges if r["kind"] == "IMPORTS_FROM"}
    assert bases <= {(r["kind"], r["source"], r["target"]) for r in edges}


def test_python_facts_and_ingest(spark):
    source = 'import app\nclass UserService(Base):\n    def get(self, uid):\n        user = find(uid)\n        if user:\n            check(user)\n        return user\n@app.get("/users")\nasync def users():\n    return find(1)\ndef find(uid):\n    """Finds."""\n    return uid\ndef test_find():\n    find(2)\n'
    files = spark.createDataFrame([("a.py", "python", source), ("bad.py", "python", "def ("), ("none.py", "python", None), ("empty.py", "python", "")], "file_path string, language string, source_text string")
    nodes, edges, errors = build(files)
    kinds = {r["qualified_name"]: r["kind"] for r in nodes.collect()}
    assert kinds["UserService"] == "Class" and kinds["UserService.get"] == "Method" and kinds["users__endpoint"] == "Endpoint" and kinds["test_find"] == "Test" and kinds["UserService.get.user"] == "Variable" and kinds["a.py"] == "File"
    found = {(r["kind"], r["source"], r["target"]) for r in edges.collect()}
    assert {("CALLS", "get", "find"), ("INHERITS", "UserService", "Base"), ("IMPORTS_FROM", "__main__", "app"), ("CONTROLS", "UserService.get", "check"), ("WRITES", "UserService.get", "UserService.get.user"), ("READS", "UserService.get", "UserService.get.user"), ("TESTS", "test_find", "find"), ("CONTAINS", "a.py", "UserService"), ("CONTAINS", "users", "users__endpoint")} <= found
    assert [r["file_path"] for r in errors.collect()] == ["bad.py"]
    assert edges.select("edge_id").distinct().count() == edges.count()


def test_routes():
    declared = lambda text: python_facts.route(ast.parse(text, mode="eval").body)
    assert declared('app.route("/x", methods=["GET", "POST"])') == {"http_method": "GET", "path": "/x", "framework": "flask"}
    assert declared("app.route('/x')")["http_method"] == "ANY" and declared("api_view(['PUT'])") == {"http_method": "PUT", "path": "/", "framework": "fastapi"}
    assert declared('router.delete(path="/a/{i}")') == {"http_method": "DELETE", "path": "/a/{i}", "framework": "fastapi"}
    assert declared("cached") is None and declared("cached('get')") is None and declared("a.b.get('/x')") is None
    found = generic_facts.facts("// Route::get('/no')\nRoute::get('/a/b', 'C@m'); $x->get('/no'); Route::get($y);", "routes.php", "php")
    assert [f["qualified"] for f in found if f.get("kind") == "Endpoint"] == ["laravel.route.get.a_b"] and found[0]["line"] == 2
    found = generic_facts.facts('router.post("/p", f); other.post("/no");', "a.js", "javascript")
    assert [f["extra"]["path"] for f in found if f.get("kind") == "Endpoint"] == ["/p"]
    found = generic_facts.facts("export async function GET(r) { return ok(r); }", "app/users/[id]/route.ts", "typescript")
    assert any(f.get("qualified") == "GET__endpoint" and f["extra"]["path"] == "/users/{id}" for f in found)
    assert generic_facts.file_route("src/pages/api/users/[id].ts") == "/users/{id}" and generic_facts.file_route("app/page.ts") is None


def test_live_graph_restarts(spark, tmp_path):
    """A new object goes on where the folder is; a batch that comes again replaces what it left."""
    file = lambda path, text: spark.createDataFrame([(path, "python", text)], "file_path string, language string, source_text string")
    LiveGraph(spark, str(tmp_path)).take(file("a.py", "def f(): pass\n"), 0)
    for _ in range(2):
        LiveGraph(spark, str(tmp_path)).take(file("b.py", "def g(): f()\n"), 1)
    graph = LiveGraph(spark, str(tmp_path))
    nodes, edges = graph.tables()
    assert graph.version == 1 and {r["qualified_name"] for r in nodes.collect()} == {"a.py", "f", "b.py", "g"} and edges.count() == 3


def test_edge_ids_of_two_files_may_clash(spark):
    edges = spark.createDataFrame([(1, "CALLS", "a", "b", "x.py", 1.0), (1, "CALLS", "c", "d", "y.py", 1.0), (1, "CALLS", "c", "d", "y.py", 1.0)], "edge_id long, kind string, source string, target string, file_path string, confidence double")
    assert current_edges(edges).count() == 2


def test_ignore_rules(spark):
    rules = walk.ignore_rules("# c\n*.log\n/top.py\nsub/dir/\n!keep.log\n**/deep/*.py\n")
    paths = ["a.log", "x/keep.log", "top.py", "x/top.py", "sub/dir/a.py", "q/deep/a.py", "ok.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "file_path string")
    from pyspark.sql import functions as F

    hit = {r[0] for r in rows.where(walk.ignored(F.col("file_path"), rules)).collect()}
    assert hit == {"a.log", "top.py", "sub/dir/a.py", "q/deep/a.py"}
    kept = {r[0] for r in walk.keep(spark.createDataFrame([("a.py",), ("venv/a.py",), ("x.egg-info/a.py",), ("a.txt",), ("lib/v/a.py",), ("b.PY",)], "file_path string"), exclude=["lib/v"]).select("file_path").collect()}
    assert kept == {"a.py"}
    with pytest.raises(ValueError):
        walk.extension_map(["nope"])
    assert walk.extension_map(["ts"]) == walk.extension_map([".tsx"])


def test_settings_languages_and_indexes(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "codegraph.yaml").write_text("min_semantic: 0.35\nenable_cfg: false\nnope: 1\n")
    assert config.load(config.find(str(tmp_path / "a" / "b"))) == config.Config(min_semantic=0.35, enable_cfg=False)
    (tmp_path / "lang.json").write_text(json.dumps({"toy": {"types": [["\\\\bthing\\\\s+(?P<name>\\\\w+)", "Class"]], "functions": []}}).replace("\\\\\\\\", "\\\\"))
    assert register_languages(str(tmp_path / "lang.json")) == ["toy"]
    try:
        assert [f["name"] for f in generic_facts.facts("thing Box { }", "a.toy", "toy") if f["fact"] == "node"] == ["Box"]
    finally:
        del generic_facts.LANGUAGES["toy"]
    assert scip.discover(spark, str(tmp_path)) is None
    (tmp_path / "index.json").write_text("{}")
    assert scip.discover(spark, str(tmp_path)).endswith("/index.json")
    places = spark.createDataFrame([("s", "a.py", 3, 0, "reference"), ("s", "a.py", 1, 0, "definition"), ("s", "b.py", 9, 0, "reference")], "symbol string, file_path string, line int, col int, role string")
    assert {tuple(r) for r in scip.occurrences_of(places).collect()} == {("s", "a.py", 2, 1), ("s", "b.py", 1, 9)}
    assert scip.replace_files(places, places.limit(0), places.where("file_path = 'a.py'")).count() == 1
