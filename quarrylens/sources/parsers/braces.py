"""JavaScript/TypeScript, Rust, Go, Java, C and C++ to rows.

The text is masked first (comments and the inside of strings become blanks of the same length), so that patterns see
declarations only; brace depth tells which of them stand at the level looked at. No file is rejected.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from . import model as M

_TOKENS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUST_TOKENS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\])'", re.S)

_NEWLINE = re.compile(r"\n")
_PAIRS = {"{}": re.compile(r"[{}]"), "()": re.compile(r"[()]")}


class Source:
    def __init__(self, text: str, rust: bool = False):
        self.text = text
        self.comments: list[tuple[int, int]] = []
        out, at = [], 0
        for m in (_RUST_TOKENS if rust else _TOKENS).finditer(text):
            out.append(text[at : m.start()])
            t = m[0]
            if t[:2] in ("//", "/*"):
                self.comments.append(m.span())
                out.append(re.sub(r"[^\n]", " ", t))
            else:
                out.append(t[0] + re.sub(r"[^\n]", " ", t[1:-1]) + t[-1])
            at = m.end()
        out.append(text[at:])
        self.masked = "".join(out)
        self.ends = [m.start() for m in _NEWLINE.finditer(text)]
        self.depth, d, at = [], 0, 0
        for m in _PAIRS["{}"].finditer(self.masked):
            self.depth += [d] * (m.start() - at)
            at, opens = m.start(), m[0] == "{"
            d = d if opens else max(0, d - 1)
            self.depth.append(d)
            at, d = at + 1, d + opens
        self.depth += [d] * (len(self.masked) - at)

    def line(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1

    def find(self, pattern: re.Pattern, lo: int = 0, hi: int | None = None, depth: int = 0):
        for m in pattern.finditer(self.masked, lo, len(self.masked) if hi is None else hi):
            if self.depth[min(m.start(1) if m.lastindex and m.start(1) >= 0 else m.start(), len(self.depth) - 1)] == depth:
                yield m

    def close(self, opening: int, pair: str = "{}") -> int:
        """Position of the bracket that closes the one at `opening`."""
        d = 0
        for m in _PAIRS[pair].finditer(self.masked, opening):
            if m[0] == pair[0]:
                d += 1
            else:
                d -= 1
                if not d:
                    return m.start()
        return len(self.masked) - 1

    def block(self, after: int) -> tuple[int, int] | None:
        """The braces that follow, if no semicolon comes first."""
        m = re.compile(r"[{;]").search(self.masked, after)
        return (m.start(), self.close(m.start())) if m and m[0] == "{" else None

    def doc(self, at: int, block_only: bool = False) -> str | None:
        """Comment that ends right before the declaration's line, without markers; block_only: `/** */`."""
        begin = self.text.rfind("\n", 0, at) + 1
        i = bisect_right(self.comments, (begin, 0)) - 1
        if i < 0:
            return None
        a, z = self.comments[i]
        if self.text[z:begin].strip() or (block_only and not self.text.startswith("/**", a)):
            return None
        return clean_comment(self.text[a:z])


def clean_comment(text: str) -> str | None:
    lines = [re.sub(r"^\s*(/\*\*?|//[/!]?|\*(?!/))?\s?|\s*\*/\s*$", "", x).strip() for x in text.split("\n")]
    return " ".join(x for x in lines if x and not x.startswith("@")) or None


def split_args(text: str) -> list[str]:
    parts, d, last = [], 0, 0
    for i, c in enumerate(text):
        d += (c in "([{<") - (c in ")]}>" and text[i - 1 : i] not in ("-", "="))
        if c == "," and d <= 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


# JavaScript and TypeScript

_JS_IMPORT = re.compile(r"^[ \t]*import\b([^'\"`;]*?)(?:\bfrom\s*)?(['\"])[^'\"\n]*\2", re.M)
_JS_REQUIRE = re.compile(r"^[ \t]*(?:(?:const|let|var)\s+(\w+|\{[^}]*\})\s*=\s*)?require\(\s*(['\"])[^'\"\n]*\2\s*\)", re.M)
_JS_CLASS = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)([^{]*)\{", re.M)
_JS_FUNC = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\(", re.M)
_JS_ARROW = re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(async\s+)?(?:function\s*\*?\s*\w*\s*)?(\(|\w+\s*=>)", re.M)
_JS_METHOD = re.compile(r"(?:^|(?<=[{};]))[ \t]*((?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*)(#?\w+)\s*(?:<[^>]*>)?\(", re.M)
_JS_FIELD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|readonly|declare)\s+)*(#?\w+)[?!]?\s*(?::\s*([^=;\n]+))?(?:=\s*([^;\n]+))?;", re.M)
_JSX = re.compile(r"<\s*(?:[A-Za-z][\w.]*[\s/>]|>)")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function"}


def _js_params(s: Source, opening: int) -> tuple[list[dict], int]:
    end = s.close(opening, "()")
    out = []
    for p in split_args(s.text[opening + 1 : end]):
        rest = p.startswith("...")
        m = re.match(r"(?:\.\.\.)?([\w$]+)\??\s*(?::\s*([^=]+))?(?:=\s*(.*))?$", p, re.S)
        if m:
            out.append(M.parameter(m[1], m[2].strip() if m[2] else None, m[3].strip() if m[3] else None, "Args" if rest else "Regular"))
    return out, end


def _js_kind(module: str, names) -> tuple[str, int | None]:
    if module.startswith("."):
        return "Relative", len(module) - len(module.lstrip("."))
    return ("From" if names else "Direct"), None


def _js_body(s: Source, after: int) -> tuple[int, int]:
    m = re.compile(r"[{;\n]").search(s.masked, after)
    if m and m[0] == "{":
        return m.start(), s.close(m.start())
    return after, m.start() if m else len(s.masked)


def javascript(text: str) -> dict:
    s = Source(text)
    out = M.parsed()
    for m in s.find(_JS_IMPORT):
        module = s.text[m.start(2) + 1 : m.end() - 1]
        names, head = [], re.sub(r"^\s*type\b", "", m[1])
        if b := re.search(r"\{([^}]*)\}", head):
            names += [tuple(([x.strip() for x in re.split(r"\bas\b", p)] + [None])[:2]) for p in b[1].split(",") if p.strip()]
        if star := re.search(r"\*\s*as\s+(\w+)", head):
            names.append(("*", star[1]))
        if d := re.match(r"\s*(\w+)\s*(?:,|$)", head):
            names.insert(0, (d[1], None))
        kind, level = _js_kind(module, names)
        out["imports"].append(M.import_(module, s.line(m.start()), names, kind, level))
    for m in s.find(_JS_REQUIRE):
        module = s.text[m.start(2) + 1 : s.text.index(s.masked[m.start(2)], m.start(2) + 1)]
        target = m[1] or ""
        names = [tuple(([x.strip() for x in p.split(":")] + [None])[:2]) for p in target.strip("{} ").split(",") if p.strip()]
        kind, level = _js_kind(module, names)
        out["imports"].append(M.import_(module, s.line(m.start()), names, kind, level))
    for m in s.find(_JS_CLASS):
        end = s.close(m.end() - 1)
        bases = [b.strip() for part in re.findall(r"(?:extends|implements)\s+([^{]*?)(?=implements|$)", m[2]) for b in split_args(part)]
        methods = []
        for k in s.find(_JS_METHOD, m.end(), end, s.depth[m.end() - 1] + 1):
            if k[2] in _WORDS:
                continue
            params, close = _js_params(s, k.end() - 1)
            body = s.block(close)
            if body:
                methods.append(M.function(k[2], s.line(k.start(2)), s.line(body[1]), params, s.doc(k.start(), True), is_async="async" in k[1]))
        attrs = [M.attribute(k[1], s.line(k.start(1)), k[2] and k[2].strip(), k[3] and k[3].strip()) for k in s.find(_JS_FIELD, m.end(), end, s.depth[m.end() - 1] + 1) if k[1] not in ("return",)]
        out["classes"].append(M.klass(m[1], s.line(m.start(1)), s.line(end), bases, methods, attrs, s.doc(m.start(), True)))
    for pattern, arrow in ((_JS_FUNC, False), (_JS_ARROW, True)):
        for m in pattern.finditer(s.masked):
            if s.depth[m.end() - 1]:
                continue
            name, is_async = (m[1], bool(m[2])) if arrow else (m[2], bool(m[1]))
            if arrow and m[3] != "(":
                params, close = [M.parameter(m[3].split("=")[0].strip())], m.end()
            else:
                params, close = _js_params(s, m.end() - 1)
                if arrow and "function" not in m[0] and not re.compile(r"\s*(?::[^=]+)?=>").match(s.masked, close + 1):
                    continue
            a, z = _js_body(s, close + 1)
            component = name[0].isupper() and bool(_JSX.search(s.masked, a, z))
            at = m.start(1) if arrow else m.start(2)
            out["functions"].append(M.function(name, s.line(at), s.line(z), params, s.doc(m.start(), True), is_async=is_async, is_component=component))
    out["functions"].sort(key=lambda f: f["line_start"])
    return out


# Rust

_RS_USE = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", re.M)
_RS_TYPE = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(struct|enum|trait|union)\s+(\w+)", re.M)
_RS_FN = re.compile(r"(?:^|(?<=[{};]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)\s*(?:<[^({]*>)?\s*\(", re.M)
_RS_IMPL = re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*(?=\w))?([^{;]*)\{", re.M)
_RS_CONST = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:\s*([^=;]+)(?:=\s*([^;]+))?;", re.M)
_RS_MOD = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", re.M)


def _rs_attrs(s: Source, at: int) -> list[str]:
    out, i = [], s.line(at) - 2
    lines = s.text.split("\n")
    while i >= 0 and (lines[i].strip().startswith(("#[", "///", "//!")) or not lines[i].strip() and out):
        if lines[i].strip().startswith("#["):
            out.append(lines[i].strip())
        i -= 1
    return out[::-1]


def _rs_fn(s: Source, m: re.Match, name: str) -> dict:
    opening = m.end() - 1
    close = s.close(opening, "()")
    params = []
    for p in split_args(s.text[opening + 1 : close]):
        n, _, t = p.partition(":")
        params.append(M.parameter(re.sub(r"^(?:mut|ref)\s+", "", n.strip()), t.strip() or None))
    body = s.block(close)
    end = body[1] if body else s.masked.find(";", close)
    ret = re.compile(r"\s*->\s*([^{;]+?)\s*(?:where\b|[{;])").match(s.masked, close + 1)
    return M.function(name, s.line(m.start(2)), s.line(max(end, close)), params, s.doc(m.start()), ret[1].strip() if ret else None, _rs_attrs(s, m.start(2)), bool(m[1]))


def rust(text: str) -> dict:
    s = Source(text, rust=True)
    inner = re.match(r"\s*(?:/\*!(.*?)\*/|((?:\s*//![^\n]*\n?)+))", text, re.S)
    out = M.parsed(clean_comment(inner[0]) if inner else None)
    for m in s.find(_RS_USE):
        path = re.sub(r"\s+", " ", m[1].strip())
        module, _, tail = path.partition("::{") if "::{" in path else path.rpartition("::")
        module = module or path
        names = [tuple(([x.strip() for x in p.split(" as ")] + [None])[:2]) for p in split_args(tail.rstrip("} "))]
        out["imports"].append(M.import_(module, s.line(m.start(1)), names, "From" if names else "Direct"))
    for m in s.find(_RS_MOD):
        out["imports"].append(M.import_(m[1], s.line(m.start(1)), [], "Relative", 1))
    for m in s.find(_RS_TYPE):
        body = s.block(m.end())
        end = body[1] if body else s.masked.find(";", m.end())
        bases = {"enum": ["Enum"], "trait": ["Trait"]}.get(m[1], [])
        methods = [_rs_fn(s, k, k[2]) for k in _RS_FN.finditer(s.masked, body[0], body[1]) if s.depth[k.start(2)] == 1] if m[1] == "trait" and body else []
        out["classes"].append(M.klass(m[2], s.line(m.start(2)), s.line(end), bases, methods, [], s.doc(m.start()), _rs_attrs(s, m.start(2))))
    for m in s.find(_RS_IMPL):
        head = re.sub(r"\bwhere\b.*", "", m[1], flags=re.S).strip()
        trait, _, kind = head.rpartition(" for ")
        strip = lambda x: re.sub(r"<.*", "", x, flags=re.S).strip()
        prefix = f"{strip(kind)}::{strip(trait)}::" if trait else f"{strip(kind)}::"
        z = s.close(m.end() - 1)
        out["functions"] += [_rs_fn(s, k, prefix + k[2]) for k in _RS_FN.finditer(s.masked, m.end(), z) if s.depth[k.start(2)] == 1]
    out["functions"] += [_rs_fn(s, m, m[2]) for m in _RS_FN.finditer(s.masked) if s.depth[m.start(2)] == 0]
    out["functions"].sort(key=lambda f: f["line_start"])
    out["constants"] = [M.constant(m[1], s.line(m.start(1)), m[2].strip(), s.text[m.start(3) : m.end(3)].strip() if m[3] else None) for m in s.find(_RS_CONST)]
    return out


# Go

_GO_IMPORT = re.compile(r"^import\s+(?:(\w+|\.|_)\s+)?(\")|^import\s*(\()", re.M)
_GO_TYPE = re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface|[^\n{]+)", re.M)
_GO_FUNC = re.compile(r"^func\s+(?:\(\s*(?:\w+\s+)?(\*?\s*\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", re.M)
_GO_VALUE = re.compile(r"^(?:const|var)\s+(\w+(?:[ \t]*,[ \t]*\w+)*)(?:[ \t]+([\w.*\[\]]+))?\s*(?:=\s*([^\n]+))?$", re.M)
_GO_GROUP = re.compile(r"^(const|var)\s*(\()", re.M)


def _go_params(text: str) -> list[dict]:
    out = []
    for p in split_args(text):
        n, _, t = p.partition(" ")
        t = t.strip()
        out.append(M.parameter(n, t or None, None, "Args" if t.startswith("...") else "Regular"))
    return out


def go(text: str) -> dict:
    s = Source(text)
    pkg = re.search(r"^package\s+(\w+)", s.masked, re.M)
    out = M.parsed(f"package {pkg[1]}" if pkg else None)

    def add(alias, at):
        z = s.text.index('"', at + 1)
        path = s.text[at + 1 : z]
        out["imports"].append(M.import_(path, s.line(at), [(path.rsplit("/", 1)[-1], alias)] if alias else [], "Direct"))

    for m in _GO_IMPORT.finditer(s.masked):
        if m[2]:
            add(m[1], m.start(2))
        else:
            end = s.close(m.start(3), "()")
            for k in re.compile(r"(?:(\w+|\.)[ \t]+)?(\")[^\"\n]*\"").finditer(s.masked, m.end(), end):
                add(k[1], k.start(2))
    for m in s.find(_GO_TYPE):
        kind = m[2].strip()
        body = s.block(m.end(1)) if kind in ("struct", "interface") else None
        end = body[1] if body else m.end()
        methods, attrs = [], []
        if kind == "interface" and body:
            for k in re.compile(r"^[ \t]+(\w+)\(", re.M).finditer(s.masked, body[0], body[1]):
                z = s.close(k.end() - 1, "()")
                methods.append(M.function(k[1], s.line(k.start(1)), s.line(z), _go_params(s.text[k.end() : z])))
        elif kind == "struct" and body:
            attrs = [M.attribute(k[1], s.line(k.start(1)), k[2].strip()) for k in re.compile(r"^[ \t]+(\w+)[ \t]+([^\n`]+)", re.M).finditer(s.masked, body[0], body[1])]
        bases = {"struct": [], "interface": ["Interface"]}.get(kind, ["TypeAlias"])
        out["classes"].append(M.klass(m[1], s.line(m.start(1)), s.line(end), bases, methods, attrs, s.doc(m.start())))
    for m in s.find(_GO_FUNC):
        close = s.close(m.end() - 1, "()")
        body = s.block(close)
        recv = m[1].replace("*", "").strip() if m[1] else None
        ret = s.text[close + 1 : body[0]].strip() if body else ""
        out["functions"].append(M.function(f"{recv}.{m[2]}" if recv else m[2], s.line(m.start(2)), s.line(body[1] if body else close), _go_params(s.text[m.end() : close]), s.doc(m.start()), ret or None))
    for m in s.find(_GO_VALUE):
        for name in re.split(r"[\s,]+", m[1].strip()):
            out["constants"].append(M.constant(name, s.line(m.start(1)), m[2], s.text[m.start(3) : m.end(3)].strip() if m[3] else None))
    for m in s.find(_GO_GROUP):
        end = s.close(m.start(2), "()")
        for k in re.compile(r"^[ \t]+(\w+(?:[ \t]*,[ \t]*\w+)*)(?:[ \t]+([\w.*\[\]]+))?[ \t]*(?:=[ \t]*([^\n]+))?$", re.M).finditer(s.masked, m.end(), end):
            for name in re.split(r"[\s,]+", k[1].strip()):
                out["constants"].append(M.constant(name, s.line(k.start(1)), k[2], s.text[k.start(3) : k.end(3)].strip() if k[3] else None))
    return out


# Java

_JAVA_TYPE = re.compile(r"^[ \t]*((?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*)(class|interface|enum|record)\s+(\w+)([^{;]*)\{", re.M)
_JAVA_METHOD = re.compile(r"(?:^|(?<=[{};]))[ \t]*((?:@\w+(?:\([^)]*\))?\s+)*)((?:(?:public|protected|private|abstract|final|static|synchronized|native|default)\s+)*)(?:<[^>]+>\s+)?(?:([\w.]+(?:<[^;(){}]*>)?(?:\[\])*)\s+)?(\w+)\s*\(", re.M)
_JAVA_FIELD = re.compile(r"^[ \t]*(?:(?:public|protected|private|final|static|transient|volatile)\s+)+([\w.]+(?:<[^;(){}]*>)?(?:\[\])*)\s+(\w+)\s*(?:=\s*([^;]+))?;", re.M)


def _java_params(text: str) -> list[dict]:
    out = []
    for p in split_args(text):
        p = re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", p).strip()
        t, _, n = p.rpartition(" ")
        out.append(M.parameter(n or p, t.strip().removesuffix("...") or None, None, "Args" if "..." in p else "Regular"))
    return out


def java(text: str) -> dict:
    s = Source(text)
    pkg = re.search(r"^\s*package\s+([\w.]+)\s*;", s.masked, re.M)
    out = M.parsed(f"package {pkg[1]}" if pkg else None)
    for m in re.compile(r"^\s*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M).finditer(s.masked):
        out["imports"].append(M.import_((m[1] and "static " or "") + m[2], s.line(m.start(2)), [], "Direct"))
    for m in s.find(_JAVA_TYPE):
        z = s.close(m.end() - 1)
        head, bases, attrs = m[4], [], []
        clause = lambda word: [b.strip() for x in re.findall(rf"\b{word}\s+([^{{]*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", head, re.S) for b in split_args(x)]  # noqa: B023, E731
        if m[2] == "interface":
            bases = ["Interface", *clause("extends")]
        elif m[2] == "enum":
            bases = ["Enum", *clause("implements")]
            body = s.masked[m.end() : z]
            for k in re.finditer(r"(?:^|,)\s*(\w+)\s*(?:\([^)]*\))?\s*(?=,|;|$)", body.split(";")[0]):
                attrs.append(M.attribute(k[1], s.line(m.end() + k.start(1)), m[3]))
        elif m[2] == "record":
            bases = ["Record", *clause("implements")]
            if comp := re.search(r"\(([^)]*)\)", head):
                attrs = [M.attribute(p["name"], s.line(m.start(3)), p["type_hint"]) for p in _java_params(comp[1])]
        else:
            bases = clause("extends") + clause("implements")
        methods = []
        for k in s.find(_JAVA_METHOD, m.end(), z, 1):
            if k[4] in ("if", "for", "while", "switch", "catch", "synchronized", "new", "return") or (k[3] in ("new", "return", "throw")) or (not k[3] and k[4] != m[3]):
                continue
            close = s.close(k.end() - 1, "()")
            nxt = re.compile(r"\s*(?:throws[\w\s.,]+)?([{;])").match(s.masked, close + 1)
            if not nxt:
                continue
            end = s.close(nxt.start(1)) if nxt[1] == "{" else nxt.start(1)
            deco = [*re.findall(r"@\w+", k[1] or ""), *k[2].split()]
            methods.append(M.function(k[4], s.line(k.start(4)), s.line(end), _java_params(s.text[k.end() : close]), s.doc(k.start(), True), k[3], deco))
        attrs += [M.attribute(k[2], s.line(k.start(2)), k[1], k[3] and s.text[k.start(3) : k.end(3)].strip()) for k in s.find(_JAVA_FIELD, m.end(), z, 1)]
        out["classes"].append(M.klass(m[3], s.line(m.start(3)), s.line(z), bases, methods, attrs, s.doc(m.start(), True), m[1].split()))
    return out


# C and C++

_C_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*([<\"])([^>\"\n]+)[>\"]", re.M)
_C_FUNC = re.compile(r"(?:^|(?<=[{};]))[ \t]*((?:[\w:<>,*&~\[\] \t]|\boperator\b[^\s\w(]+)+?[\s*&])?((?:\w+::)*~?\w+|(?:\w+::)*operator\s*[^\s\w(]+)[ \t]*\(", re.M)
#: The same where nothing is named operator; only starts that a bracket can follow are tried.
_C_PLAIN_FUNC = re.compile(r"(?:^|(?<=[{};]))(?=[\w:<>,*&~\[\] \t]*(?:\s[\w:<>,*&~\[\] \t]*)?\()[ \t]*([\w:<>,*&~\[\] \t]+?[\s*&])?((?:\w+::)*~?\w+)[ \t]*\(", re.M)
_C_TYPE = re.compile(r"(?:^|(?<=[{};]))[ \t]*(typedef\s+)?(struct|enum class|enum struct|enum|union|class)\s+(\w+)?\s*(?:final\s*)?(?::\s*([^{;]+))?\{", re.M)
_C_TYPEDEF = re.compile(r"^[ \t]*typedef\s+([^;{}]+?)\s*\b(\w+)\s*;", re.M)
_C_GLOBAL = re.compile(r"(?:^|(?<=[{};]))[ \t]*((?:(?:static|const|extern|volatile|unsigned|signed|long|short|constexpr|inline)\s+)*[A-Za-z_][\w:<>]*(?:\s*\*+)?)\s+\**(\w+)(?:\[[^\]]*\])*\s*(?:=\s*([^;{]+|\{[^;]*\}))?;", re.M)
_NAMESPACE = re.compile(r"(?:^|(?<=[{};]))[ \t]*(?:inline\s+)?namespace\s+([\w:]+)\s*\{", re.M)
_NOT_NAMES = {"if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do", "new", "delete", "throw", "defined", "alignas", "decltype", "static_assert"}


def _c_params(text: str) -> list[dict]:
    out = []
    for p in split_args(text):
        if p == "void":
            continue
        if p == "...":
            out.append(M.parameter("...", None, None, "Args"))
            continue
        head, _, default = p.partition("=")
        m = re.match(r"(.*?[\s*&])?(\w+)\s*(?:\[[^\]]*\])*\s*$", head.strip(), re.S)
        out.append(M.parameter(m[2] if m else head.strip(), (m[1] or "").strip() or None if m else None, default.strip() or None))
    return out


def _c_functions(s: Source, lo: int, hi: int, depth: int, prefix: str = "", prototypes: bool = True, owner: str | None = None) -> list[dict]:
    out = []
    for m in (_C_FUNC if "operator" in s.masked else _C_PLAIN_FUNC).finditer(s.masked, lo, hi):
        name = re.sub(r"\s+", "", m[2])
        if s.depth[m.start(2)] != depth or name in _NOT_NAMES or s.masked[m.start() : m.start(2)].lstrip().startswith(("#", "return", "else", "using", "typedef")):
            continue
        ret = (m[1] or "").strip()
        if not ret and "::" not in name and name.lstrip("~") != owner:
            continue
        close = s.close(m.end() - 1, "()")
        nxt = re.compile(r"\s*(?:const|noexcept|override|final|->\s*[\w:<>*& ]+|\s|=\s*(?:0|default|delete)|:\s*[^{;]+)*([{;])").match(s.masked, close + 1)
        if not nxt or nxt.start(1) >= hi:
            continue
        proto = nxt[1] == ";"
        if proto and not prototypes:
            continue
        end = s.line(m.start(2)) if proto else s.line(s.close(nxt.start(1)))
        words = ret.split()
        deco = ["prototype"] * proto + [w for w in ("virtual", "static") if w in words]
        before = s.masked[max(lo, m.start() - 200) : m.start()]
        if "template" in before and re.search(r"template\s*<[^;{}]*>\s*$", before):
            deco.append("template")
        kind = " ".join(w for w in words if w not in ("virtual", "static", "inline", "extern", "constexpr", "explicit", "friend")) or None
        out.append(M.function(prefix + name, s.line(m.start(2)), end, _c_params(s.text[m.end() : close]), s.doc(m.start()), kind, deco))
    return out


def _c_types(s: Source, lo: int, hi: int, depth: int, prefix: str, cpp: bool) -> list[dict]:
    out = []
    for m in _C_TYPE.finditer(s.masked, lo, hi):
        if s.depth[m.start(2)] != depth:
            continue
        z = s.close(m.end() - 1)
        tail = re.compile(r"\s*(\w+)\s*;").match(s.masked, z + 1)
        name = m[3] or (tail[1] if tail else None)
        if not name:
            continue
        kind = m[2]
        bases = [] if kind == "class" else [kind]
        if m[4]:
            bases += [re.sub(r"\b(public|private|protected|virtual)\b\s*", "", b).strip() for b in split_args(m[4])]
        if m[1]:
            bases.append("typedef")
        methods = _c_functions(s, m.end(), z, depth + 1, owner=name) if cpp and not kind.startswith("enum") else []
        attrs = []
        if kind.startswith("enum"):
            attrs = [M.attribute(k[1], s.line(m.end() + k.start(1)), None, k[2] and k[2].strip()) for k in re.finditer(r"(?:^|,)\s*(\w+)\s*(?:=\s*([^,]+))?", s.masked[m.end() : z])]
        else:
            attrs = [M.attribute(k[2], s.line(k.start(2)), k[1].strip()) for k in _C_GLOBAL.finditer(s.masked, m.end(), z) if s.depth[k.start(2)] == depth + 1 and k[1] not in ("return", "using", "typedef")]
        deco = ["template"] if re.search(r"template\s*<[^;{}]*>\s*$", s.masked[max(lo, m.start() - 200) : m.start()]) else []
        out.append(M.klass(prefix + name, s.line(m.start(2)), s.line(z), bases, methods, attrs, s.doc(m.start()), deco))
    return out


def _c_level(s: Source, out: dict, lo: int, hi: int, depth: int, prefix: str, cpp: bool) -> None:
    out["classes"] += _c_types(s, lo, hi, depth, prefix, cpp)
    out["functions"] += _c_functions(s, lo, hi, depth, prefix)
    for m in _C_TYPEDEF.finditer(s.masked, lo, hi):
        if s.depth[m.start(1)] == depth and not re.match(r"(struct|enum|union)\s*\{", m[1]):
            out["classes"].append(M.klass(prefix + m[2], s.line(m.start()), s.line(m.end()), ["typedef"]))
    for m in _C_GLOBAL.finditer(s.masked, lo, hi):
        if s.depth[m.start(2)] == depth and m[1].split()[0] not in ("return", "using", "typedef", "namespace", "struct", "class", "enum", "goto", "else", "extern"):
            out["constants"].append(M.constant(prefix + m[2], s.line(m.start(2)), m[1].strip(), s.text[m.start(3) : m.end(3)].strip() if m[3] else None))
    for m in _NAMESPACE.finditer(s.masked, lo, hi) if cpp else ():
        if s.depth[m.start(1)] == depth:
            _c_level(s, out, m.end(), s.close(m.end() - 1), depth + 1, f"{prefix}{m[1]}::", cpp)


def c(text: str, cpp: bool = False) -> dict:
    s = Source(text)
    out = M.parsed()
    for m in _C_INCLUDE.finditer(text):
        if s.masked[m.start() : m.start(1)].strip():
            out["imports"].append(M.import_(m[2], s.line(m.start(1)), [], "Direct"))
    if cpp:
        for m in s.find(re.compile(r"^[ \t]*using\s+(?:namespace\s+)?([\w:]+)\s*;", re.M)):
            module, _, name = m[1].rpartition("::")
            out["imports"].append(M.import_(module or m[1], s.line(m.start(1)), [(name, None)] if module else [], "From"))
    _c_level(s, out, 0, len(s.masked), 0, "", cpp)
    out["functions"].sort(key=lambda f: f["line_start"])
    out["classes"].sort(key=lambda k: k["line_start"])
    return out


def cpp(text: str) -> dict:
    return c(text, True)
