"""Definitions, calls, imports, bases, control and data flow, and routes of Python source."""

from __future__ import annotations

import ast

# The HTTP methods.
METHODS = frozenset("get post put patch delete head options".split())
CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.TryStar)


def _texts(node: ast.expr | None) -> list[str]:
    """The string constants of an expression, in source order."""
    return [n.value for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str)] if node is not None else []


def route(decorator: ast.expr) -> dict | None:
    """Method, path and framework that a decorator declares; None if it declares no route.

    Told by the call: ``x.get(path)`` and the other methods, ``x.route(path, methods=[...])``, ``api_view([...])``. A route with
    several methods has the first, one with none has ANY; a route without a path is at the root.
    """
    if not isinstance(decorator, ast.Call):
        return None
    owner, verb = (decorator.func.value, decorator.func.attr) if isinstance(decorator.func, ast.Attribute) else (None, getattr(decorator.func, "id", None))
    named = {k.arg: k.value for k in decorator.keywords}
    first = decorator.args[0] if decorator.args else None
    if owner is not None and isinstance(owner, ast.Name) and verb.lower() in METHODS:
        method, where = verb.upper(), _texts(first) or _texts(named.get("path"))
    elif owner is not None and isinstance(owner, ast.Name) and verb == "route":
        method, where = next(iter(_texts(named.get("methods"))), "ANY").upper(), _texts(first) or _texts(named.get("rule"))
    elif owner is None and verb == "api_view":
        method, where = next(iter(_texts(first) or _texts(named.get("http_method_names"))), "ANY").upper(), []
    else:
        return None
    flask = owner is not None and ("flask" in owner.id.lower() or (owner.id, verb) == ("app", "route"))
    return {"http_method": method, "path": where[0] if where else "/", "framework": "flask" if flask else "fastapi"}


class _Facts(ast.NodeVisitor):
    def __init__(self, source: str, path: str):
        self.source, self.path, self.rows, self.pos = source, path, [], 0
        self.scopes: list[str] = []
        self.functions: list[str] = []
        self.control = False

    def put(self, fact: str, **fields) -> None:
        self.pos += 1
        self.rows.append({"fact": fact, "pos": self.pos, **fields})

    def _define(self, node, kind: str) -> None:
        parent = self.scopes[-1] if self.scopes else None
        extra = {}
        if kind != "Class":
            if node.name.startswith("test_") or parent and "Test" in parent:
                kind = "Test"
            elif parent is not None and self.in_class:
                kind = "Method"
        qualified = f"{parent}.{node.name}" if parent else node.name
        params = [] if kind == "Class" else [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        returns = ast.unparse(node.returns) if getattr(node, "returns", None) else None
        self.put("node", kind=kind, name=node.name, qualified=qualified, parent=parent, line=node.lineno, end_line=node.end_lineno, is_test=kind == "Test", params=params, return_type=returns, docstring=ast.get_docstring(node), extra=extra)
        for d in node.decorator_list:
            found = None if kind == "Class" else route(d)
            if found:
                self.put("node", kind="Endpoint", name=node.name, qualified=f"{qualified}__endpoint", parent=None, line=node.lineno, end_line=node.end_lineno, is_test=False, extra=found | {"handler": qualified})
                break

    @property
    def in_class(self) -> bool:
        return bool(self.kinds) and self.kinds[-1] == "Class"

    kinds: list[str]

    def visit_ClassDef(self, node) -> None:
        self._define(node, "Class")
        for base in node.bases:
            if isinstance(base, ast.Name):
                self.put("edge", kind="INHERITS", source=node.name, target=base.id, line=node.lineno)
        self.scopes.append(node.name)
        self.kinds.append("Class")
        self.generic_visit(node)
        self.scopes.pop()
        self.kinds.pop()

    def visit_FunctionDef(self, node) -> None:
        self._define(node, "Function")
        self.scopes.append(node.name)
        self.kinds.append("Function")
        self.functions.append(node.name)
        held, self.control = self.control, self.control
        self.generic_visit(node)
        self.control = held
        self.scopes.pop()
        self.kinds.pop()
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node) -> None:
        if self.functions:
            if isinstance(node.func, ast.Name):
                self.put("edge", kind="CALLS", source=self.functions[-1], target=node.func.id, line=node.lineno)
            if self.control:
                head, method = node.func, node.func.attr if isinstance(node.func, ast.Attribute) else None
                while isinstance(head, ast.Attribute):
                    head = head.value
                if isinstance(head, ast.Name):
                    self.put("control", source=self.functions[-1], target=head.id, name=method, line=node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.put("edge", kind="IMPORTS_FROM", source="__main__", target=a.name, line=node.lineno)

    def visit_ImportFrom(self, node) -> None:
        self.put("edge", kind="IMPORTS_FROM", source="__main__", target="." * node.level + (node.module or ""), line=node.lineno)

    def _write(self, target) -> None:
        if isinstance(target, ast.Name) and self.functions and len(target.id) > 1 and not target.id.startswith("_"):
            self.put("write", source=self.functions[-1], name=target.id, line=target.lineno)

    def visit_Assign(self, node) -> None:
        for target in node.targets:
            self._write(target)
        for target in node.targets:
            self.visit(target)
        self.visit(node.value)

    def visit_AugAssign(self, node) -> None:
        self._write(node.target)
        self.generic_visit(node)

    visit_NamedExpr = visit_AugAssign

    def visit_AnnAssign(self, node) -> None:
        if node.value is not None:
            self._write(node.target)
        self.generic_visit(node)

    def visit_Name(self, node) -> None:
        if self.functions and not node.id[0].isupper():
            self.put("read", source=self.functions[-1], name=node.id, line=node.lineno)

    def generic_visit(self, node) -> None:
        if isinstance(node, CONTROL):
            held, self.control = self.control, True
            super().generic_visit(node)
            self.control = held
        else:
            super().generic_visit(node)


def facts(source: str, path: str) -> list[dict]:
    """Facts in source order; a source that doesn't parse gives one ``error`` fact."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as x:
        return [{"fact": "error", "pos": 0, "name": str(x)}]
    visitor = _Facts(source, path)
    visitor.kinds = []
    visitor.visit(tree)
    return visitor.rows
