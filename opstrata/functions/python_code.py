"""Facts of one Python source: counts for coverage ratios, smells, complexity, comments, imports. Pure functions, used inside Arrow kernels."""

from __future__ import annotations

import ast
import io
import math
import re
import tokenize
from collections import Counter

#: Columns of a file's record, all counts but the three last, which are doubles.
COUNTS = (
    "functions", "classes", "docstrings", "args", "annotated_args", "returns", "annotated_returns", "type_refs", "any_refs", "str_refs", "deprecations", "inline_import", "dict_get_with_default",
    "hasattr_getattr", "test_skip", "swallowed_exception", "dynamic_execution", "single_method_class", "deep_inheritance", "passthrough_wrapper", "sys_path_manipulation", "nonempty_init",
    "orphan_comment", "untracked_todo", "type_ignore", "complexity", "loc", "code_loc", "tokens",
)
MEASURES = ("volume", "difficulty", "effort", "mi")
# The patterns that comments are sorted by.
TODO = re.compile(r"\b(TODO|FIXME|XXX|HACK)\b", re.I)
URL = re.compile(r"https?://")
TICKET = re.compile(r"[A-Z]+-\d+|#\d+")
TYPE_IGNORE = re.compile(r"#\s*type:\s*ignore")
JUSTIFIED = re.compile(r"#\s*(NOTE|REASON|WARNING|WORKAROUND|IMPORTANT|CAVEAT|HACK|NB|PERF|SAFETY|COMPAT):", re.I)
SKIP_DECORATORS = ("pytest.mark.skip", "pytest.mark.skipif", "unittest.skip", "unittest.skipIf")
SKIP_CALLS = ("pytest.skip", "pytest.skipif")
DEPRECATED = ("deprecated", "warnings.deprecated", "typing.deprecated", "typing_extensions.deprecated")
_WORD = re.compile(r"\w+|[^\w\s]")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST) -> str:
    """``a.b.c`` of a name or attribute, else an empty text."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def line_counts(text: str) -> tuple[int, int]:
    """All lines, and those that are neither blank nor a comment alone."""
    lines = text.splitlines()
    return len(lines), sum(bool(x) and not x.startswith("#") for x in map(str.strip, lines))


def comments(text: str) -> list[tuple[int, str]]:
    """(line, comment) of every comment token; what can't be tokenised ends the list."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.append((t.start[0], t.string))
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return out


def comment_kind(comment: str, in_test: bool = False) -> str | None:
    """type_ignore, todo, untracked_todo, orphan_comment or None: the first that fits."""
    if TYPE_IGNORE.search(comment):
        return "type_ignore"
    if TODO.search(comment):
        return "todo" if URL.search(comment) or TICKET.search(comment) else "untracked_todo"
    return None if in_test or URL.search(comment) or JUSTIFIED.search(comment) else "orphan_comment"


def is_test_path(path: str) -> bool:
    return path.rsplit("/", 1)[-1].startswith("test_") or "/tests/" in path


def type_names(node: ast.AST | None) -> list[str]:
    """The names an annotation refers to, a text being one name."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Name):
            out.append(n.id)
        elif isinstance(n, ast.Attribute):
            out.append(n.attr)
        elif isinstance(n, ast.Subscript):
            todo += [n.value, n.slice]
        elif isinstance(n, ast.BinOp):
            todo += [n.left, n.right]
        elif isinstance(n, ast.Tuple):
            todo += n.elts
        elif isinstance(n, ast.Constant) and isinstance(n.value, str):
            out.append(n.value)
    return out


def _idle(body: list[ast.stmt]) -> bool:
    return all(isinstance(s, ast.Pass | ast.Continue | ast.Break | ast.Assign | ast.AugAssign | ast.AnnAssign) for s in body)


def _wraps(f: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    """The body, a docstring aside, only returns a call whose names are the function's own parameters in their order."""
    body = f.body[1:] if ast.get_docstring(f) else f.body
    if len(body) != 1 or not isinstance(body[0], ast.Return) or not isinstance(body[0].value, ast.Call):
        return False
    own = [a.arg for a in f.args.args if a.arg not in ("self", "cls")]
    return bool(own) and [a.id for a in body[0].value.args if isinstance(a, ast.Name)] == own


def _deprecated(n: ast.Call) -> bool:
    """A warning of a deprecation, as second argument or by keyword."""
    if dotted(n.func) != "warnings.warn":
        return False
    categories = [*n.args[1:2], *(k.value for k in n.keywords if k.arg == "category")]
    return any("DeprecationWarning" in dotted(c).split(".")[-1] for c in categories)


def _scopes(tree: ast.Module):
    """(node, whether within a function or class, whether under a type-checking condition) of every node."""
    todo = [(c, False, False) for c in ast.iter_child_nodes(tree)]
    while todo:
        n, deep, typing = todo.pop()
        yield n, deep, typing
        inner = deep or isinstance(n, (*_FUNCTIONS, ast.ClassDef))
        checks = typing or (isinstance(n, ast.If) and dotted(n.test).split(".")[-1] == "TYPE_CHECKING")
        todo += [(c, inner, checks) for c in ast.iter_child_nodes(n)]


def features(tree: ast.Module, path: str = "") -> Counter:
    """Counts over the syntax tree."""
    c: Counter = Counter()
    for n, deep, typing in _scopes(tree):
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            c["docstrings"] += bool(ast.get_docstring(n))
            for d in n.decorator_list:
                name = dotted(d.func if isinstance(d, ast.Call) else d)
                c["deprecations"] += name in DEPRECATED
                c["test_skip"] += name in SKIP_DECORATORS
        if isinstance(n, _FUNCTIONS):
            c["functions"] += 1
            args = [a for a in n.args.args if a.arg not in ("self", "cls")]
            c["args"] += len(args)
            c["annotated_args"] += sum(a.annotation is not None for a in args)
            c["returns"] += 1
            c["annotated_returns"] += n.returns is not None
            c["passthrough_wrapper"] += _wraps(n)
            for t in (*(a.annotation for a in args), n.returns):
                names = type_names(t)
                c["type_refs"] += len(names)
                c["any_refs"] += names.count("Any")
                c["str_refs"] += names.count("str")
        elif isinstance(n, ast.ClassDef):
            c["classes"] += 1
            c["deep_inheritance"] += len(n.bases) > 2
            c["single_method_class"] += sum(isinstance(m, _FUNCTIONS) and m.name != "__init__" for m in n.body) == 1
        elif isinstance(n, ast.Import | ast.ImportFrom):
            c["inline_import"] += deep and not typing
        elif isinstance(n, ast.Try):
            c["swallowed_exception"] += sum(_idle(h.body) for h in n.handlers)
        elif isinstance(n, ast.Assign | ast.AugAssign):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            c["sys_path_manipulation"] += any(dotted(t) == "sys.path" for t in targets)
        elif isinstance(n, ast.Call):
            name = dotted(n.func)
            c["deprecations"] += _deprecated(n)
            c["dict_get_with_default"] += isinstance(n.func, ast.Attribute) and n.func.attr == "get" and (len(n.args) >= 2 or any(k.arg == "default" for k in n.keywords))
            c["hasattr_getattr"] += name in ("hasattr", "getattr")
            c["test_skip"] += name in SKIP_CALLS
            c["dynamic_execution"] += name in ("eval", "exec", "compile")
            c["sys_path_manipulation"] += name in ("sys.path.append", "sys.path.insert", "sys.path.extend", "sys.path.remove")
    if path.rsplit("/", 1)[-1] == "__init__.py":
        rest = [s for s in tree.body if not isinstance(s, ast.Import | ast.ImportFrom | ast.Pass) and not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)) and not (isinstance(s, ast.Assign) and any(dotted(t) == "__all__" for t in s.targets))]
        c["nonempty_init"] += bool(rest)
    return c


def measures(tree: ast.Module, code_loc: int) -> tuple[int, float, float, float, float]:
    """(complexity, volume, difficulty, effort, mi) by the published definitions of McCabe, Halstead (1977) and the maintainability index.

    Complexity is summed over functions, 1 each and 1 for every decision within. Operators are the kinds of nodes that act, operands names and constants.
    """
    complexity = 0
    operators: Counter = Counter()
    operands: Counter = Counter()
    for n in ast.walk(tree):
        if isinstance(n, (*_FUNCTIONS, ast.Lambda)):
            complexity += not isinstance(n, ast.Lambda)
        if isinstance(n, ast.If | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.IfExp | ast.comprehension | ast.Assert | ast.match_case):
            complexity += 1
        if isinstance(n, ast.BoolOp):
            complexity += len(n.values) - 1
        if isinstance(n, ast.operator | ast.unaryop | ast.cmpop | ast.boolop | ast.Call | ast.Attribute | ast.Subscript) or (isinstance(n, ast.stmt) and not isinstance(n, ast.Expr)):
            operators[type(n).__name__] += 1
        if isinstance(n, ast.Name):
            operands[n.id] += 1
        elif isinstance(n, ast.arg):
            operands[n.arg] += 1
        elif isinstance(n, ast.Constant):
            operands[repr(n.value)] += 1
    n1, n2, all1, all2 = len(operators), len(operands), sum(operators.values()), sum(operands.values())
    volume = (all1 + all2) * math.log2(n1 + n2) if n1 + n2 > 1 else 0.0
    difficulty = n1 / 2 * all2 / n2 if n2 else 0.0
    mi = 171 - 5.2 * math.log(max(volume, 1)) - 0.23 * complexity - 16.2 * math.log(max(code_loc, 1))
    return complexity, volume, difficulty, volume * difficulty, mi


def record(path: str, text: str | None) -> dict | None:
    """All columns of a file; None for a null or unparseable text (which then counts in no aggregate)."""
    if text is None:
        return None
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    c = features(tree, path)
    loc, code = line_counts(text)
    kinds = Counter(comment_kind(x, is_test_path(path)) for _, x in comments(text))
    complexity, *doubles = measures(tree, code)
    c |= {"orphan_comment": kinds["orphan_comment"], "untracked_todo": kinds["untracked_todo"], "type_ignore": kinds["type_ignore"], "complexity": complexity, "loc": loc, "code_loc": code, "tokens": len(_WORD.findall(text))}
    return {k: int(c[k]) for k in COUNTS} | dict(zip(MEASURES, map(float, doubles), strict=True))


def imported_modules(text: str | None) -> list[str]:
    """Modules that a source imports, dotted; of ``from m import n`` both m.n and m; relative ones without a module are left out."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            out += [f"{n.module}.{a.name}" for a in n.names if a.name != "*"] or [n.module]
    return sorted(set(out))
