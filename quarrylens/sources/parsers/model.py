"""Plain rows that parsers return."""

from __future__ import annotations


def function(name, line_start, line_end, parameters=(), docstring=None, return_type=None, decorators=(), is_async=False, is_generator=False, is_component=False) -> dict:
    return {
        "name": name, "docstring": docstring, "parameters": list(parameters), "return_type": return_type, "decorators": list(decorators), "is_async": is_async,
        "is_generator": is_generator, "is_component": is_component, "line_start": line_start, "line_end": line_end,
    }


def parameter(name, type_hint=None, default=None, kind="Regular") -> dict:
    return {"name": name, "type_hint": type_hint, "default": default, "kind": kind}


def klass(name, line_start, line_end, bases=(), methods=(), attributes=(), docstring=None, decorators=()) -> dict:
    return {
        "name": name, "docstring": docstring, "bases": list(bases), "decorators": list(decorators), "methods": list(methods),
        "attributes": list(attributes), "line_start": line_start, "line_end": line_end,
    }


def attribute(name, line, type_hint=None, default=None) -> dict:
    return {"name": name, "type_hint": type_hint, "default": default, "line": line}


def import_(module, line, names=(), kind="Direct", level=None) -> dict:
    return {"module": module, "names": [{"name": n, "alias": a} for n, a in names], "kind": kind, "level": level, "line": line}


def constant(name, line, type_hint=None, value=None) -> dict:
    return {"name": name, "type_hint": type_hint, "value": value, "line": line}


def parsed(docstring=None, imports=(), classes=(), functions=(), constants=()) -> dict:
    return {"docstring": docstring, "imports": list(imports), "classes": list(classes), "functions": list(functions), "constants": list(constants)}
