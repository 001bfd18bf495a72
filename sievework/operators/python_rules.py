"""Rules over Python syntax trees. A tree is no column, so files are parsed in Arrow batches; what comes out are rows of
findings. A file that doesn't parse gives none and is told in rule_errors()."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.comments import python_noncode_lines

SECRETS = ("password", "passwd", "secret", "token", "api_key")
LOGS = ("debug", "info", "warning", "error", "exception", "critical", "log", "print")
MUTATORS = ("append", "extend", "add", "update", "insert", "pop", "remove", "clear", "setdefault")


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id if isinstance(node, ast.Name) else "?", *parts[::-1]])


def mutated(tree: ast.AST, name: str) -> bool:
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in MUTATORS and dotted(n.func.value) == name:
            return True
        if isinstance(n, (ast.Assign, ast.AugAssign, ast.Delete)):
            targets = n.targets if isinstance(n, (ast.Assign, ast.Delete)) else [n.target]
            if any(isinstance(t, ast.Subscript) and dotted(t.value) == name for t in targets):
                return True
    return False


def mutable(node: ast.AST | None) -> bool:
    return isinstance(node, (ast.List, ast.Dict, ast.Set)) or isinstance(node, ast.Call) and dotted(node.func) in ("list", "dict", "set")


def check(tree: ast.Module) -> list[tuple[str, str, int, str]]:
    """(rule, level, line, message) of one module."""
    found = []
    hit = lambda r, lv, n, m: found.append((r, lv, getattr(n, "lineno", 1), m))
    imported = {a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {(n.module or "").split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)}
    withs = {id(i.context_expr) for n in ast.walk(tree) if isinstance(n, (ast.With, ast.AsyncWith)) for i in n.items}
    guarded = any(isinstance(n, ast.Attribute) and n.attr in ("Lock", "RLock", "Queue", "Event", "Semaphore", "gather") for n in ast.walk(tree))
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = [*n.args.posonlyargs, *n.args.args]
            for a, d in [*zip(args[len(args) - len(n.args.defaults) :], n.args.defaults), *zip(n.args.kwonlyargs, n.args.kw_defaults)]:
                if mutable(d) and mutated(n, a.arg):
                    hit("PY-01", "P0", n, f"default of {a.arg} is changed")
            if n.name == "__del__" and any(isinstance(x, (ast.Call, ast.Raise)) for x in ast.walk(n)):
                hit("PY-07", "P1", n, "work in __del__")
            if any(isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str) for x in n.body[1:]):
                hit("PY-18", "P2", n, "text after the first statement")
        if isinstance(n, ast.ExceptHandler):
            reports = any(isinstance(x, ast.Raise) or isinstance(x, ast.Call) and dotted(x.func).split(".")[-1] in LOGS for x in ast.walk(n))
            if n.type is None:
                hit("PY-11", "P0", n, "bare except")
            elif dotted(n.type) in ("Exception", "BaseException") and not reports:
                hit("PY-02", "P0", n, "broad except hides errors")
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and dotted(n.value.func) in ("open", "socket.socket", "sqlite3.connect") and id(n.value) not in withs:
            hit("PY-03", "P1", n, "resource without with")
        if isinstance(n, ast.Call):
            name = dotted(n.func)
            last = name.split(".")[-1]
            if name in ("threading.Thread", "asyncio.create_task", "multiprocessing.Process") and not guarded:
                hit("PY-04", "P0", n, "concurrent work without a primitive")
            if name in ("pickle.load", "pickle.loads", "marshal.loads", "yaml.load", "shelve.open") and not any(k.arg == "Loader" and "Safe" in dotted(k.value) for k in n.keywords):
                hit("PY-05", "P0", n, f"{name} on data from outside")
            if last in LOGS and any(isinstance(x, (ast.Name, ast.Attribute)) and any(s in dotted(x).lower() for s in SECRETS) for a in n.args for x in ast.walk(a)):
                hit("PY-06", "P0", n, "secret in a log")
            if name in ("os.system", "os.popen") or any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords):
                hit("PY-10", "P0", n, "runs through a shell")
            if name in ("datetime.now", "datetime.datetime.now") and not n.args and not n.keywords:
                hit("PY-12", "P2", n, "time without a zone")
        if isinstance(n, ast.Assert) and not imported & {"pytest", "unittest"}:
            hit("PY-09", "P1", n, "assert as a check at run time")
    for n in tree.body:
        if isinstance(n, ast.Assign) and mutable(n.value):
            for t in n.targets:
                if isinstance(t, ast.Name) and any(mutated(f, t.id) for f in tree.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))):
                    hit("PY-08", "P1", n, f"module state {t.id} is changed")
    exits = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and dotted(n.func) in ("sys.exit", "exit")]
    if len(exits) >= 3 and len({x.args[0].value for x in exits if x.args and isinstance(x.args[0], ast.Constant) and isinstance(x.args[0].value, int)}) <= 1:
        hit("AR-04", "P2", exits[0], "several exits, one code")
    return found


def scan_python(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """rule_id, level, path, line_no, snippet for all Python files; null texts give nothing."""

    def run(parts):
        for pdf in parts:
            rows = []
            for p, src in zip(pdf["path"], pdf["text"]):
                try:
                    tree = ast.parse(src or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                skip = set(python_noncode_lines(src))
                rows += [(r, lv, p, line, m) for r, lv, line, m in check(tree) if line not in skip]
            yield pd.DataFrame(rows, columns=["rule_id", "level", "path", "line_no", "snippet"])

    return files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInPandas(run, "rule_id string, level string, path string, line_no int, snippet string")


def rule_errors(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, error of the Python files that don't parse."""

    def run(parts):
        for pdf in parts:
            rows = []
            for p, src in zip(pdf["path"], pdf["text"]):
                try:
                    ast.parse(src or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((p, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInPandas(run, "path string, error string")
