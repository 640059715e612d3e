"""Fixed values of the analysis: language, module and style vocabularies, thresholds and weights."""

from __future__ import annotations

import sys

# Which extension means which language, in any letter case.
LANGUAGE_OF = {
    "py": "Python",
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript",
    "rs": "Rust", "go": "Go", "java": "Java", "c": "C", "h": "C",
    "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "hpp": "Cpp", "hh": "Cpp", "hxx": "Cpp",
}
# Extensions are tried in this order when a file name becomes a module name.
EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts", ".rs", ".go", ".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx")
JS_VARIANTS = {"js": "Js", "mjs": "Js", "cjs": "Js", "jsx": "Jsx", "ts": "Ts", "mts": "Ts", "cts": "Ts", "tsx": "Tsx"}
INDEX_NAMES = {"Python": ("__init__",), "JavaScript": ("index",), "TypeScript": ("index",), "Rust": ("mod", "lib")}
SEPARATORS = {"Rust": "::", "Cpp": "::", "JavaScript": "/", "TypeScript": "/", "Go": "/", "C": "/"}
# Parts of paths that are never analysed, and the configured default patterns.
ALWAYS_EXCLUDED = ("__pycache__", ".git", "venv", ".venv", "node_modules", ".tox", ".eggs")
DEFAULT_EXCLUDE = ("tests/**", "test/**", "venv/**", ".venv/**", "__pycache__/**", "*.egg-info/**", ".git/**")
# Directory names that give a module its type.
MODULE_TYPES = {
    "Models": ("models", "schemas", "entities", "domain"),
    "Views": ("views", "templates", "pages", "ui"),
    "Services": ("services", "handlers", "controllers", "actions"),
    "Utils": ("utils", "helpers", "lib", "common", "shared"),
    "Api": ("api", "routes", "endpoints", "resources"),
    "Tests": ("tests", "test", "testing", "specs"),
    "Config": ("config", "settings", "conf", "configuration"),
    "Core": ("core", "main", "app", "application"),
}
# The first of these substrings found gives a node its style or colour.
STYLES = (("test", ":::test"), ("model", ":::model"), ("util", ":::util"), ("helper", ":::util"), ("api", ":::api"), ("route", ":::api"), ("config", ":::config"), ("setting", ":::config"))
COLOURS = (("model", "#e1f5fe"), ("view", "#f3e5f5"), ("service", "#e8f5e9"), ("util", "#fff3e0"), ("api", "#fce4ec"), ("test", "#f5f5f5"))
PLAIN_COLOUR = "#ffffff"
# Calls that make code dynamic, by category, and what each finding adds to the risk score.
REFLECTION = ("getattr", "setattr", "hasattr", "delattr", "type", "isinstance", "issubclass", "callable", "dir", "inspect.getmembers", "inspect.getattr_static")
EVAL_EXEC = ("eval", "exec", "compile")
DYNAMIC_ATTR = ("vars", "globals", "locals", "__dict__", "__getattr__", "__setattr__")
RISK_WEIGHTS = {"eval_exec": 25, "dynamic_import": 15, "reflection": 10, "dynamic_attr": 5}
# Thresholds of diagnostics, content types by extension, kinds of symbols by name.
HIGH_COMPLEXITY, MANY_FUNCTIONS = 20, 15
MIME = {
    "html": "text/html; charset=utf-8", "htm": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "application/javascript; charset=utf-8",
    "json": "application/json; charset=utf-8", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "ico": "image/x-icon", "txt": "text/plain; charset=utf-8", "md": "text/markdown; charset=utf-8", "mmd": "text/plain; charset=utf-8",
}
OTHER_MIME = "application/octet-stream"
SYMBOL_KINDS = {
    "Class": ("class", "struct"), "Function": ("function", "func", "fn"), "Method": ("method",), "Module": ("module", "namespace"), "Enum": ("enum",),
    "Interface": ("interface", "trait"), "Constant": ("constant", "const"), "Variable": ("variable", "var", "let"), "Property": ("property", "field"),
    "Constructor": ("constructor",), "Event": ("event",), "Operator": ("operator",), "TypeParameter": ("type", "typedef", "type_alias"), "Package": ("package",),
}

#: Standard library: this interpreter's public top-level modules and those that left it since 3.10.
LEFT_STDLIB = frozenset(
    "aifc asynchat asyncore audioop binhex cgi cgitb chunk crypt distutils imghdr imp lib2to3 mailcap nis nntplib ossaudiodev pipes smtpd sndhdr spwd sunau telnetlib uu xdrlib".split()
)
STDLIB = frozenset(m for m in sys.stdlib_module_names if not m.startswith("_")) - {"this", "antigravity"} | LEFT_STDLIB | {"typing_extensions", "_thread", "__future__", "test"}
