"""Schemas of parsed files and of the relations made from them."""

from __future__ import annotations

_PARAM = "struct<name:string,type_hint:string,default:string,kind:string>"
_FN = (
    f"struct<name:string,docstring:string,parameters:array<{_PARAM}>,return_type:string,decorators:array<string>,"
    "is_async:boolean,is_generator:boolean,is_component:boolean,line_start:bigint,line_end:bigint>"
)
_IMPORT = "struct<module:string,names:array<struct<name:string,alias:string>>,kind:string,level:int,line:bigint>"
_ATTR = "struct<name:string,type_hint:string,default:string,line:bigint>"
_CLASS = (
    f"struct<name:string,docstring:string,bases:array<string>,decorators:array<string>,methods:array<{_FN}>,"
    f"attributes:array<{_ATTR}>,line_start:bigint,line_end:bigint>"
)
_CONST = "struct<name:string,type_hint:string,value:string,line:bigint>"
#: One row for each file: what a parser finds in it; `error` is set where it could not be read.
PARSED = (
    f"path string, rel_path string, language string, docstring string, imports array<{_IMPORT}>, classes array<{_CLASS}>, "
    f"functions array<{_FN}>, constants array<{_CONST}>, error string"
)
