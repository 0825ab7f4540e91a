"""Python sources to symbols, imports and routes.

The syntax tree is read with the standard library's ast in Arrow batches on executors; code is parsed, never run. Each
row carries its place in the order of extraction (seq), on which "the first" of later joins rests.
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylight import schemas

# Which decorators declare routes.
ROUTE_OBJECTS, ROUTE_VERBS = ("app", "router"), ("get", "post", "put", "delete", "patch")

#: Files whose trees are turned into one Arrow batch.
ROWS = 64

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Names of arguments with stars, and what is returned; no positional-only ones, defaults or annotations."""
    a = node.args
    starred = [("", x) for x in a.args] + [("*", a.vararg)] + [("", x) for x in a.kwonlyargs] + [("**", a.kwarg)]
    names = [stars + x.arg for stars, x in starred if x is not None]
    return f"({', '.join(names)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def call_name(node: ast.AST) -> str | None:
    """f for f(), a.b for a.b(), nothing for deeper ones."""
    match node:
        case ast.Call(func=ast.Name(id=name)):
            return name
        case ast.Call(func=ast.Attribute(value=ast.Name(id=owner), attr=name)):
            return f"{owner}.{name}"
    return None


_SYMBOL = ("seq", "symbol_type", "name", "qualified_name", "signature", "docstring", "start_line", "end_line", "parent", "symbol_id", "confidence", "calls", "bases")
_BLOCKS = ("body", "orelse", "handlers", "finalbody", "cases")
#: Nodes below which nothing is called or defined.
_LEAVES = frozenset({ast.Constant, ast.Name, ast.Load, ast.Store, ast.Del, ast.Pass, ast.arg})


_BLOCKS_OF: dict[type, tuple[str, ...]] = {}


def inner(node: ast.AST) -> list[ast.AST]:
    """The statements (and parts of statements) that a node holds, in order; expressions hold none."""
    kind = type(node)
    if (blocks := _BLOCKS_OF.get(kind)) is None:
        blocks = _BLOCKS_OF[kind] = tuple(f for f in kind._fields if f in _BLOCKS)
    return [x for f in blocks if type(held := getattr(node, f)) is list for x in held]


def statements(tree: ast.AST) -> list[ast.AST]:
    """All statements in the order of ast.walk."""
    out, level = [], [tree]
    while level:
        out += level
        level = [x for node in level for x in inner(node)]
    return out


def calls_in(node: ast.AST) -> list[str]:
    """Names that are called anywhere below a node, the first of each, in the order of ast.walk."""
    names: dict[str, None] = {}
    level = [node]
    while level:
        below = []
        for n in level:
            if type(n) is ast.Call and (name := call_name(n)):
                names[name] = None
            for f in n._fields:
                held = getattr(n, f, None)
                for x in held if type(held) is list else (held,):
                    if isinstance(x, ast.AST) and (type(x) not in _LEAVES or type(x) is ast.arg and x.annotation is not None):
                        below.append(x)
        level = below
    return list(names)


def _docstring(node: ast.AST) -> str | None:
    return ast.get_docstring(node) if node.body and type(node.body[0]) is ast.Expr else None


def symbols_of(tree: ast.AST, path: str) -> list[list]:
    """Classes, functions, methods and module-like variables, parents before what they hold; fields as _SYMBOL."""
    out: list[list] = []
    work: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    while work:
        node, classes = work.pop()
        inside, kind = classes, type(node)
        if kind is ast.ClassDef:
            bases = [b.id for b in node.bases if isinstance(b, ast.Name)]
            name, found = node.name, ("class", None, _docstring(node), None, bases or None)
            inside = (*classes, name)
        elif kind in _FUNCTIONS:
            name, found = node.name, ("method" if classes else "function", signature(node), _docstring(node), calls_in(node) or None, None)
        elif kind is ast.Assign:
            if not classes:
                line, end = node.lineno, node.end_lineno or node.lineno
                out += [[len(out) + i, "variable", n, n, None, None, line, end, None, f"variable:{path}:{n}:{line}", "INFERRED", None, None] for i, n in enumerate(t.id for t in node.targets if isinstance(t, ast.Name))]
            continue
        else:
            work += [(x, classes) for x in reversed(inner(node))]
            continue
        line = node.lineno
        out.append([len(out), found[0], name, ".".join((*classes, name)), found[1], found[2], line, node.end_lineno or line, classes[-1] if classes else None, f"{found[0]}:{path}:{name}:{line}", "EXTRACTED", found[3], found[4]])
        work += [(x, inside) for x in reversed(node.body)]
    return out


def imports_of(nodes: list[ast.AST]) -> list[dict]:
    """One row for each imported name; the module is empty for `from . import x`."""
    out: list[dict] = []
    for node in nodes:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            relative = isinstance(node, ast.ImportFrom) and node.level > 0
            out += [{"module_name": a.name if isinstance(node, ast.Import) else node.module or "", "imported_name": a.asname or a.name, "alias": a.asname, "line_number": node.lineno, "is_relative": relative} for a in node.names]
    return [{"seq": i} | row for i, row in enumerate(out)]


def routes_of(nodes: list[ast.AST], path: str) -> list[dict]:
    """One row for each decorator like app.get("/literal")."""
    out: list[dict] = []
    for node in nodes:
        if not isinstance(node, _FUNCTIONS):
            continue
        for deco in node.decorator_list:
            match deco:
                case ast.Call(func=ast.Attribute(value=ast.Name(id=owner), attr=verb), args=[ast.Constant(value=str(route)), *_]) if owner in ROUTE_OBJECTS and verb in ROUTE_VERBS:
                    method = verb.upper()
                    out.append({"seq": len(out), "route_id": f"route:{method}:{route}:{path}:{deco.lineno}", "method": method, "route_path": route, "handler_function": node.name, "decorator": ast.unparse(deco), "start_line": deco.lineno, "end_line": node.end_lineno or node.lineno, "signature": signature(node), "docstring": ast.get_docstring(node)})
    return out


def _read(path: str, source: str | None, is_binary: bool) -> tuple[str, str, str | None, list[list], list[dict], list[dict]]:
    """The fields of schemas.PARSED, symbols as lists. Syntax errors give a status and a message of 500 characters at most."""
    if is_binary or not (source or "").strip():
        return path, "not_applicable", None, [], [], []
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return path, "error", str(e.msg)[:500], [], [], []
    except (ValueError, RecursionError, MemoryError) as e:  # null bytes, or nesting too deep
        return path, "error", str(e)[:500] or type(e).__name__, [], [], []
    nodes = statements(tree)
    symbols, routes = symbols_of(tree, path), routes_of(nodes, path)
    for r in routes:
        symbols.append([len(symbols), "route", f"{r['method']} {r['route_path']}", r["handler_function"], r.pop("signature"), r.pop("docstring"), r["start_line"], r["end_line"], None, r["route_id"], "EXTRACTED", None, None])
    seen: dict[str, int] = {}
    for s in symbols:  # two definitions on one line get different ids
        n = seen[s[9]] = seen.get(s[9], 0) + 1
        if n > 1:
            s[9] += f"#{n}"
    return path, "parsed", None, symbols, imports_of(nodes), routes


def parse_text(path: str, source: str | None, is_binary: bool) -> dict:
    """A row as schemas.PARSED."""
    row = dict(zip(("path", "status", "error", "symbols", "imports", "routes"), _read(path, source, is_binary), strict=True))
    return row | {"symbols": [dict(zip(_SYMBOL, s, strict=True)) for s in row["symbols"]]}


def _column(files: list[list], kind: pa.ListType, rows: Callable) -> pa.ListArray:
    """Lists of structs, built field by field."""
    fields = list(zip(*(rows(r) for file in files for r in file), strict=True)) or [()] * kind.value_type.num_fields
    held = pa.StructArray.from_arrays([pa.array(values, f.type) for values, f in zip(fields, kind.value_type, strict=True)], fields=list(kind.value_type))
    starts = pa.array([0, *accumulate(map(len, files))], pa.int32())
    return pa.ListArray.from_arrays(starts, held).cast(kind)


def _parse(batches):
    """Columns after path, text and is_binary stay as they are."""
    kind = to_arrow_schema(schemas.PARSED)
    names = {c: [f.name for f in kind.field(c).type.value_type] for c in ("imports", "routes")}
    gc.disable()  # syntax trees hold no cycles, and there are very many nodes
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                columns = list(zip(*(_read(*x) for x in zip(*(c.to_pylist() for c in some.columns[:3]), strict=True)), strict=True))
                plain = [pa.array(c, kind.field(i).type) for i, c in enumerate(columns[:3])]
                lists = [_column(c, kind.field(name).type, list if name == "symbols" else itemgetter(*names[name])) for name, c in zip(("symbols", "imports", "routes"), columns[3:], strict=True)]
                yield pa.RecordBatch.from_arrays([*plain, *lists, *some.columns[3:]], schema=pa.schema([*kind, *list(some.schema)[3:]]))
    finally:
        gc.enable()


def _parse_symbols(batches):
    kind = to_arrow_schema(_FLAT)
    gc.disable()
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                paths, found = some.column(0), [_read(*x)[3] for x in zip(*(c.to_pylist() for c in some.columns), strict=True)]
                fields = list(zip(*chain.from_iterable(found), strict=True))
                if fields:
                    path = paths.take(pa.array([i for i, file in enumerate(found) for _ in file]))
                    yield pa.RecordBatch.from_arrays([path, *(pa.array(values, f.type) for values, f in zip(fields, list(kind)[1:], strict=True))], schema=kind)
    finally:
        gc.enable()


def _dealt(scanned: DataFrame, *more: str, dealt: bool = False) -> DataFrame:
    """Files that wait, dealt out: parsing costs far more than reading, and few large inputs would leave it to few tasks. `dealt`: they are."""
    waiting = scanned.where("parse_status = 'pending'").select("path", "text", "is_binary", *more)
    return waiting if dealt else waiting.repartition(int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parse(scanned: DataFrame, *more: str, dealt: bool = False) -> DataFrame:
    """schemas.PARSED for each scanned file that waits for it, and `more` columns of the scan."""
    files = _dealt(scanned, *more, dealt=dealt)
    return files.mapInArrow(_parse, T.StructType([*schemas.PARSED.fields, *(files.schema[c] for c in more)]))


#: What a file's lists hold.
_LISTS = ("symbols", "imports", "routes")


def items(parsed: DataFrame) -> DataFrame:
    """A row for each symbol, import and route: a struct in the column of its list, null in the others; other columns of `parsed` stay.

    Stored in this form, a reader never holds more than the rows of a batch, where lists of many files can be of any size.
    """
    kinds = {c: schemas.PARSED[c].dataType.elementType for c in _LISTS}
    own = lambda c: F.transform(c, lambda x: F.struct(*((x if k == c else F.lit(None).cast(t)).alias(k) for k, t in kinds.items())))
    return parsed.select(*(c for c in parsed.columns if c not in _LISTS), F.inline(F.concat(*map(own, _LISTS))))


_FLAT = T.StructType([T.StructField("path", T.StringType()), *schemas.PARSED["symbols"].dataType.elementType.fields])


def parse_symbols(scanned: DataFrame, *, dealt: bool = False) -> DataFrame:
    """The rows of symbols(parse(scanned)) for those who need nothing else: they leave the parser flat, which costs less than lists."""
    return _dealt(scanned, dealt=dealt).mapInArrow(_parse_symbols, _FLAT)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("symbols"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("imports"))


def routes(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("routes"))
