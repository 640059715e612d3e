"""Python source to rows. `compat` keeps known oddities of the original analysis; by default they are put right.

Only top-level statements count. Sources that do not parse are read line by line, so no file is rejected.
"""

from __future__ import annotations

import ast
import re

from . import model as M



def _caps(name: str) -> bool:
    return all(c.isupper() or c == "_" or c.isnumeric() for c in name)


class Reader:
    def __init__(self, source: str, compat: bool):
        self.source, self.compat = source, compat

    def text(self, node) -> str | None:
        return ast.get_source_segment(self.source, node) if node is not None else None

    def doc(self, body) -> str | None:
        """First statement if it is a string; with compat a module's later one counts as long as only expressions come before."""
        for s in body:
            if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
                return s.value.value.strip()
            if not (self.compat and isinstance(s, ast.Expr)):
                return None
        return None

    def start(self, node) -> int:
        return min([node.lineno, *(d.lineno for d in node.decorator_list)])

    def decorators(self, node) -> list[str]:
        return [(self.text(d.func if isinstance(d, ast.Call) else d) or "") for d in node.decorator_list]

    def parameters(self, a: ast.arguments) -> list[dict]:
        out = []
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)

        def one(arg, default, kind):
            odd = self.compat and kind != "KeywordOnly" and arg.annotation is None and default is None
            if self.compat and kind == "PositionalOnly" and not odd:
                kind = "Regular"
            elif odd:  # a bare name counts as positional-only until the slash is seen
                kind = "PositionalOnly" if arg in a.posonlyargs or not a.posonlyargs else "Regular"
            out.append(M.parameter(arg.arg, self.text(arg.annotation), self.text(default), kind))

        for arg, d in zip(plain, defaults, strict=True):
            one(arg, d, "PositionalOnly" if arg in a.posonlyargs else "Regular")
        if a.vararg:
            out.append(M.parameter(a.vararg.arg, self.text(a.vararg.annotation), None, "Args"))
        for arg, d in zip(a.kwonlyargs, a.kw_defaults, strict=True):
            one(arg, d, "KeywordOnly")
        if a.kwarg:
            out.append(M.parameter(a.kwarg.arg, self.text(a.kwarg.annotation), None, "Kwargs"))
        return out

    def generator(self, node) -> bool:
        if self.compat:
            return False
        todo = list(node.body)
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.Yield, ast.YieldFrom)):
                return True
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)):
                todo.extend(ast.iter_child_nodes(n))
        return False

    def function(self, n) -> dict:
        return M.function(
            n.name, self.start(n), n.end_lineno, self.parameters(n.args), self.doc(n.body[:1]), self.text(n.returns), self.decorators(n), isinstance(n, ast.AsyncFunctionDef), self.generator(n))

    def klass(self, n: ast.ClassDef) -> dict:
        bases = [self.text(b) for b in n.bases if isinstance(b, (ast.Name, ast.Attribute, ast.Call))]
        if not self.compat:
            bases = [self.text(b) for b in n.bases]
        methods, attrs = [], []
        for s in n.body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                methods.append(self.function(s))
            elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                target = s.targets[0] if isinstance(s, ast.Assign) else s.target
                if not isinstance(target, ast.Name):
                    continue
                if not target.id.startswith("_"):
                    full = not self.compat
                    attrs.append(M.attribute(target.id, s.lineno, self.text(getattr(s, "annotation", None)) if full else None, self.text(s.value) if full else None))
                elif self.compat and isinstance(s.value, ast.Name) and not s.value.id.startswith("_"):
                    attrs.append(M.attribute(s.value.id, s.lineno))
        return M.klass(n.name, self.start(n), n.end_lineno, bases, methods, attrs, self.doc(n.body[:1]), self.decorators(n))

    def imports(self, n) -> list[dict]:
        names = [(a.name, a.asname) for a in n.names]
        if isinstance(n, ast.Import):
            if not self.compat:
                return [M.import_(a.name, n.lineno, [(a.name, a.asname)]) for a in n.names]
            plain = [a.name for a in n.names if not a.asname]
            return [M.import_(plain[-1] if plain else n.names[0].name, n.lineno, names)]
        return [M.import_(n.module or "", n.lineno, names, "Relative" if n.level else "From", n.level or None)]

    def read(self, tree: ast.Module) -> dict:
        out = M.parsed(self.doc(tree.body))
        for s in tree.body:
            if isinstance(s, (ast.Import, ast.ImportFrom)):
                out["imports"] += self.imports(s)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out["functions"].append(self.function(s))
            elif isinstance(s, ast.ClassDef):
                if not (self.compat and s.decorator_list):
                    out["classes"].append(self.klass(s))
            elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                target = s.targets[0] if isinstance(s, ast.Assign) else s.target
                if isinstance(target, ast.Name) and _caps(target.id):
                    name = target.id
                    if self.compat and isinstance(s.value, ast.Name) and _caps(s.value.id):
                        name = s.value.id
                    out["constants"].append(M.constant(name, s.lineno, self.text(getattr(s, "annotation", None)), self.text(s.value)))
        return out


_DEF = re.compile(r"^(async\s+)?(def|class)\s+(\w+)")
_IMPORT = re.compile(r"^import\s+([\w.]+)(?:\s+as\s+(\w+))?")
_FROM = re.compile(r"^from\s+(\.*)([\w.]*)\s+import\s+(.+)")


def _by_line(source: str) -> dict:
    """What can be told from lines that start at the margin."""
    lines = source.split("\n")
    out, open_ = M.parsed(), None
    for i, line in enumerate(lines, 1):
        if line[:1].strip() and open_ is not None:
            open_["line_end"] = max(open_["line_start"], i - 1)
            open_ = None
        if m := _DEF.match(line):
            if m[2] == "class":
                open_ = M.klass(m[3], i, len(lines))
                out["classes"].append(open_)
            else:
                open_ = M.function(m[3], i, len(lines), is_async=bool(m[1]))
                out["functions"].append(open_)
        elif m := _IMPORT.match(line):
            out["imports"].append(M.import_(m[1], i, [(m[1], m[2])]))
        elif m := _FROM.match(line):
            names = [tuple((p.split(" as ") + [None])[:2]) for p in re.sub(r"[()\\#].*", "", m[3]).split(",")]
            names = [(a.strip(), b.strip() if b else None) for a, b in names if a.strip()]
            out["imports"].append(M.import_(m[2], i, names, "Relative" if m[1] else "From", len(m[1]) or None))
    return out


def parse(source: str, compat: bool = False) -> dict:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _by_line(source)
    return Reader(source, compat).read(tree)
