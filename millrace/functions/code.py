"""Structure of Python code by its syntax tree; code is parsed, never run."""

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Calls and statements that answers may not use, and their limits.
BANNED_CALLS = frozenset({"eval", "exec", "open", "input", "compile", "__import__"})
BANNED_NODES = frozenset({"Import", "ImportFrom", "ClassDef", "AsyncFunctionDef", "With", "AsyncWith", "Try", "Raise", "Global", "Nonlocal", "Lambda", "Yield", "YieldFrom", "Await"})
LIMITS = {"too_many_lines": 25, "too_many_ast_nodes": 140, "too_deep_ast": 12}


class _Walk:
    """What one pass over a tree finds: node kinds, called names, size and depth."""

    def __init__(self, tree: ast.AST):
        self.kinds: set[str] = set()
        self.called: set[str] = set()
        self.attributes: set[str] = set()
        self.size, self.depth = 0, 0
        todo = [(tree, 0)]
        while todo:
            node, level = todo.pop()
            self.size, self.depth = self.size + 1, max(self.depth, level)
            self.kinds.add(type(node).__name__)
            if isinstance(node, ast.Call):
                if isinstance(node.func, ast.Name):
                    self.called.add(node.func.id)
                elif isinstance(node.func, ast.Attribute):
                    self.attributes.add(node.func.attr)
            todo.extend((child, level + 1) for child in ast.iter_child_nodes(node))


def structure(code: str | None, entry_point: str | None) -> tuple[list[str], int, int]:
    """(all reasons against the code, nodes, depth); null code is a syntax error."""
    try:
        tree = ast.parse(code if code is not None else "(")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ["syntax_error"], 0, 0
    seen = _Walk(tree)
    functions = [n.name for n in tree.body if isinstance(n, ast.FunctionDef)]
    measured = {"too_many_lines": sum(1 for line in code.splitlines() if line.strip()), "too_many_ast_nodes": seen.size, "too_deep_ast": seen.depth}
    holds = {
        "top_level_function_count": len(functions) != 1,
        "extra_top_level_code": len(tree.body) != 1 or not functions,
        "wrong_function_name": bool(functions) and functions[0] != entry_point,
        "banned_node": bool(seen.kinds & BANNED_NODES),
        "banned_call": bool((seen.called | seen.attributes) & BANNED_CALLS),
        "recursion": entry_point in seen.called,
        **{name: measured[name] > most for name, most in LIMITS.items()},
    }
    return [name for name, held in holds.items() if held], seen.size, seen.depth


def code_structure(code: Column, entry_point: Column) -> Column:
    """struct<reasons, nodes, depth> of each text, in an Arrow UDF."""

    def go(x: pd.Series, name: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([structure(v, n) for v, n in zip(x, name)], columns=["reasons", "nodes", "depth"])

    return F.pandas_udf(go, "reasons array<string>, nodes int, depth int")(code, entry_point)


def _only_function(code: str | None) -> str | None:
    """The name of the one function that a module defines at its top; null for none, several, or no valid code."""
    try:
        names = [node.name for node in ast.parse(code or "").body if isinstance(node, ast.FunctionDef)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return names[0] if len(names) == 1 else None


def entry_from_code(code: Column) -> Column:
    """`_only_function` of each text, in an Arrow UDF."""

    def go(x: pd.Series) -> pd.Series:
        return pd.Series([_only_function(v) for v in x], dtype=object)

    return F.pandas_udf(go, "string")(code)


def entry_from_tests(tests: Column) -> Column:
    """The name that the first test which asserts a call calls; null if none does."""
    called = F.transform(tests, lambda t: F.regexp_extract(t, r"assert\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1))
    return F.get(F.filter(called, lambda x: x != ""), F.lit(0))


def entry_point(code: Column, tests: Column) -> Column:
    return F.coalesce(entry_from_code(code), entry_from_tests(tests))


def _asserts(pairs: str | None, name: str | None, most: int) -> list[str]:
    try:
        io = json.loads(pairs) if pairs else {}
    except ValueError:
        return []
    if not isinstance(io, dict) or not name:
        return []
    ins, outs = (io.get(k) if isinstance(io.get(k), list) else [] for k in ("inputs", "outputs"))
    return [f"assert {name}({', '.join(map(repr, x if isinstance(x, list) else [x]))}) == {y!r}" for x, y in zip(ins[:most], outs)]


def asserts_from_pairs(pairs: Column, name: Column, most: int = 8) -> Column:
    """Tests of a function from JSON with `inputs` and `outputs`, the first `most` pairs; an input that isn't a list is one argument.

    Values are written as Python writes them. Malformed JSON, or lists that are missing, give no tests; a null name neither.
    """

    def go(io: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_asserts(x, n, most) for x, n in zip(io, names)], dtype=object)

    return F.pandas_udf(go, "array<string>")(pairs, name)
