"""Symbols, facts, calls, imports and references out of source files.

Python is parsed with its own grammar; for the other languages declarations are read
line by line, bodies by braces. Files are the unit of work: an Arrow batch of texts in,
rows out.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = (
    "path string, module string, language string, name string, qualified_name string, kind string, visibility string, start int, end int, "
    "signature string, doc string, constants array<string>, predicates array<string>, return_shape string, calls array<string>, members array<string>, idx int"
)
_FIELDS = [f.strip().split(" ", 1)[0] for f in SYMBOLS.split(", ")]
REFERENCES = "from_symbol string, name string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}

_RUST = re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+(?=fn)|extern\s+\"[^\"]*\"\s+)*(fn|struct|enum|trait|mod|const|static|type|macro_rules!)\s+(?:mut\s+)?([^\W\d]\w*)")
_JS = re.compile(r"^\s*(export\s+(?:default\s+)?)?(?:declare\s+|abstract\s+|async\s+)*(function\*?|class|interface|enum|type|const|let|var)\s+([A-Za-z_$][\w$]*)")
_HOLDS_FUNCTION = re.compile(r"=\s*(?:async\s+)?(?:function\b|\([^=]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")
_JAVA = re.compile(r"^\s*((?:public|protected|private|static|final|abstract|default|synchronized|native)\s+)*(class|interface|enum|record|@interface)\s+([^\W\d]\w*)")
_JAVA_METHOD = re.compile(r"^\s*((?:(?:public|protected|private|static|final|abstract|default|synchronized|native)\s+)*)(?:<[^>]+>\s+)?([\w<>\[\],.? ]+?)\s+([^\W\d]\w*)\s*\([^;{]*\)\s*(?:throws [\w, .]+)?[{;]")
_KINDS = {"fn": "function", "function": "function", "function*": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "const": "const", "static": "const", "type": "type", "class": "class", "interface": "interface", "record": "class", "@interface": "interface", "let": "const", "var": "const", "macro_rules!": "macro"}
_CALL = re.compile(r"\b([^\W\d]\w*)\s*\(")
_NO_CALL = {"if", "for", "while", "switch", "match", "return", "catch", "fn", "function", "new", "super", "sizeof", "loop", "await", "typeof", "def", "class"}
_LITERAL = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\b[0-9][_0-9]*(?:[.][0-9]+)?\w*\b|\btrue\b|\bfalse\b|\bTrue\b|\bFalse\b")
_KEYWORD = re.compile(r"\b(?:if|while|switch|match)\b")
_TERNARY = re.compile(r"(?:=|\breturn\b|[(,])\s*([^=(){},;?\n]+?)\s*\?(?![?.])[^:;\n]+:")
#: The opening of an element of a component, whose name begins with a capital.
_ELEMENT = re.compile(r"(?<![\w$)\]])<([A-Z]\w*)(?=[\s/>])")


def _balanced(code: str, start: int) -> int:
    """Where the bracket that opens at ``start`` is closed."""
    depth = 0
    for i in range(start, len(code)):
        depth += {"(": 1, ")": -1}.get(code[i], 0)
        if not depth:
            return i
    return len(code)


def conditions(code: str, language: str) -> list[str]:
    """What the branches, loops, switches and matches of the code test; of ternaries too where a language has them."""
    out = []
    for m in _KEYWORD.finditer(code):
        rest = code[m.end() :]
        if language == "rust":
            said = rest[: rest.find("{")] if "{" in rest else ""
        elif rest.lstrip().startswith("("):
            start = m.end() + rest.index("(")
            said = code[start + 1 : _balanced(code, start)]
        else:
            continue
        out.append(said)
    if language != "rust":
        out += _TERNARY.findall(code)
    return sorted({" ".join(x.split()) for x in out if x.strip()})


def _python(text: str, module: str) -> tuple[list[dict], list[tuple[str, str]]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    out, refs = [], []

    def literals(node: ast.AST, owner: str) -> tuple[list[str], list[str], list[str]]:
        constants, predicates, calls = set(), set(), []
        stack = list(ast.iter_child_nodes(node))
        while stack:
            n = stack.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue  # nested definitions own their facts
            if isinstance(n, ast.Constant) and n.value is not None and n.value is not Ellipsis:
                constants.add(f'"{n.value}"' if isinstance(n.value, str) else repr(n.value))
            if isinstance(n, (ast.If, ast.While)):
                predicates.add(" ".join(ast.unparse(n.test).split()))
            if isinstance(n, ast.Call):
                name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
                if name:
                    calls.append((n.func.end_lineno, n.func.end_col_offset, name))
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                refs.append((owner, n.id))
            if isinstance(n, ast.Attribute):
                refs.append((owner, n.attr))
            stack += ast.iter_child_nodes(n)
        return sorted(constants), sorted(predicates), [c for *_, c in sorted(calls)]

    def visit(body: list[ast.stmt], in_class: bool, local: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                q = f"{module}::{n.name}"
                constants, predicates, calls = literals(n, q)
                bases = {b.id if isinstance(b, ast.Name) else getattr(b, "attr", "") for b in n.bases} if is_class else set()
                enum = bool(bases & {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"})
                members = [t.id for s in n.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name) and not t.id.startswith("_")] if enum else []
                signature = None if is_class else f"{n.name}({ast.unparse(n.args)})"
                out.append({"name": n.name, "kind": "enum" if enum else "class" if is_class else "method" if in_class else "function", "visibility": "private" if n.name.startswith("_") else "public", "start": n.lineno, "end": n.end_lineno, "signature": signature, "doc": ast.get_docstring(n), "constants": constants, "predicates": predicates, "return_shape": ast.unparse(n.returns) if not is_class and n.returns else None, "calls": calls, "members": members})
                visit(n.body, is_class, local or not is_class)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and not in_class and not local:
                targets = n.targets if isinstance(n, ast.Assign) else [n.target]
                for t in targets:
                    if isinstance(t, ast.Name):
                        value = [f'"{c.value}"' if isinstance(c.value, str) else repr(c.value) for c in ast.walk(n.value) if isinstance(c, ast.Constant)] if n.value else []
                        out.append({"name": t.id, "kind": "const", "visibility": "private" if t.id.startswith("_") else "public", "start": n.lineno, "end": n.end_lineno, "signature": None, "doc": None, "constants": sorted(set(value)), "predicates": [], "return_shape": None, "calls": [], "members": []})

    visit(tree.body, False, False)
    literals(tree, module)
    return out, refs


def _braced(text: str, module: str, language: str) -> tuple[list[dict], list[tuple[str, str]]]:
    lines = text.split("\n")
    bare = [re.sub(r'"(?:[^"\\]|\\.)*"', '""', re.sub(r"//.*", "", x)) for x in lines]
    found = []
    for i, line in enumerate(bare):
        if language == "rust":
            m = _RUST.match(line)
            hit = m and (m[2], m[3], "public" if m[1] else "private")
        elif language == "java":
            m = _JAVA.match(line)
            hit = m and (m[2], m[3], "public" if "public" in line else "private" if "private" in line else "internal")
            if not hit and (m := _JAVA_METHOD.match(line)) and m[3] not in _NO_CALL and m[2].split()[-1] not in ("return", "new", "else", "throw"):
                hit = ("method", m[3], "public" if "public" in m[1] else "private" if "private" in m[1] else "internal")
        else:
            m = _JS.match(line)
            # A variable inside a body is no definition unless it holds a function.
            local = m and m[2] in ("const", "let", "var") and line[:1].isspace() and not _HOLDS_FUNCTION.search(line)
            hit = m and not local and (m[2], m[3], "public" if m[1] else "internal")
        if not hit:
            continue
        depth, end, opened = 0, i, False
        for j in range(i, len(bare)):
            depth += bare[j].count("{") - bare[j].count("}")
            opened = opened or "{" in bare[j]
            if (opened and depth <= 0) or (not opened and bare[j].rstrip().endswith(";")):
                end = j
                break
        found.append((i, end, hit))
    out, refs = [], []
    # Each line belongs to the innermost definition around it: that which begins last.
    owner = [-1] * len(lines)
    for at, (i, end, _) in enumerate(found):
        owner[i : end + 1] = [at] * (end + 1 - i)
    owned: list[list[int]] = [[] for _ in found]
    for k, at in enumerate(owner):
        if at >= 0:
            owned[at].append(k)
    elements = language in ("javascript", "tsx")
    for own, (i, end, (word, name, visibility)) in zip(owned, found):
        code = [lines[k] for k in own]
        head = lines[i].strip().rstrip("{").strip()
        calls = []
        for k, t in enumerate(code):
            sites = [(m.start(1), m[1]) for m in _CALL.finditer(t)] + ([(m.start(1), m[1]) for m in _ELEMENT.finditer(t)] if elements else [])
            calls += [c for _, c in sorted(sites) if c not in _NO_CALL and not (k == 0 and c == name)]
        literals = sorted({x for t in code for x in _LITERAL.findall(re.sub(r"//.*", "", t))})
        predicates = conditions("\n".join(code), language)
        kind = _KINDS.get(word, word)
        members = [m[1] for k in own[1:] if (m := re.match(r"^\s*([A-Z]\w*)\s*(?:[,({=;]|$)", lines[k]))] if kind == "enum" else []
        above = []
        k = i - 1
        while k >= 0 and re.match(r"^\s*(///|//!|/\*\*|\*|#\[|@)", lines[k]):
            above.append(re.sub(r"^\s*(///?!?|/\*\*|\*/|\*)\s?", "", lines[k]))
            k -= 1
        returns = re.search(r"->\s*([^{;]+)", head) if language == "rust" else None
        q = f"{module}::{name}"
        out.append({"name": name, "kind": kind, "visibility": visibility, "start": i + 1, "end": end + 1, "signature": head if kind in ("function", "method") else None, "doc": "\n".join(above[::-1]) or None, "constants": literals, "predicates": predicates, "return_shape": returns[1].strip() if returns else None, "calls": calls, "members": members})
        refs += [(q, x) for t in code for x in set(re.findall(r"\b[^\W\d]\w*\b", t)) if x != name]
    return out, refs


def _rows(texts: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [f.strip().split(" ", 1)[0] for f in schema.split(", ")]
    types = [_TYPES[f.strip().split(" ", 1)[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for x in batch.to_pylist() for r in rows_of(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return texts.select("path", "module", "language", "text").where("language IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)


def _extract(x: dict) -> tuple[list[dict], list[tuple[str, str]]]:
    return _python(x["text"], x["module"]) if x["language"] == "python" else _braced(x["text"], x["module"], x["language"])


def symbols(texts: DataFrame) -> DataFrame:
    """One row for each definition in the code files (path, module, language, text)."""

    def rows_of(x: dict) -> list[tuple]:
        return [tuple({**x, **s, "qualified_name": f"{x['module']}::{s['name']}", "idx": i}[f] for f in _FIELDS) for i, s in enumerate(_extract(x)[0])]

    return _rows(texts, SYMBOLS, rows_of)


def references(texts: DataFrame) -> DataFrame:
    """Distinct (from_symbol, name): what each definition's own lines name."""
    return _rows(texts, REFERENCES, lambda x: sorted(set(_extract(x)[1]))).distinct()


_IMPORTED = r"[\w.]+(?:\s+as\s+\w+)?"


def imports(texts: DataFrame) -> DataFrame:
    """Distinct (from_module, language, raw) of the import statements, over as many lines as they take.

    Of a Rust group the whole is the path, whose last part names several things.
    """

    def every(pattern: str) -> Column:
        return F.regexp_extract_all("text", F.lit("(?m)" + pattern), 1)

    listed = F.flatten(F.transform(every(rf"^[ \t]*import[ \t]+({_IMPORTED}(?:[ \t]*,[ \t]*{_IMPORTED})*)"), lambda m: F.split(m, r"\s*,\s*")))
    plain = F.transform(listed, lambda m: F.regexp_extract(m, r"^([\w.]+)", 1))
    found = (
        F.when(F.col("language") == "rust", every(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"))
        .when(F.col("language") == "python", F.concat(every(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b"), plain))
        .when(F.col("language") == "java", every(r"^[ \t]*import\s+(?:static\s+)?([\w.]+)"))
        .when(F.col("language").isin("javascript", "typescript", "tsx"), every(r"""(?:\bfrom\s+|\bimport\s+|\brequire\(\s*|\bimport\(\s*)["']([^"']+)["']"""))
    )
    out = texts.select(F.col("module").alias("from_module"), "language", F.explode(found).alias("raw"))
    return out.withColumn("raw", F.regexp_replace("raw", r"\s+", " ")).where("raw <> ''").distinct()


def _join(segments: Column) -> Column:
    return F.array_join(F.filter(segments, lambda s: s != ""), "/")


def _whole_and_trimmed(segments: Column) -> Column:
    return F.array(_join(segments), F.when(F.size(segments) > 1, _join(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(1))))))


def import_candidates(edges: DataFrame) -> DataFrame:
    """(from_module, raw, pos, candidate): the modules that an import may mean, in the order they are tried."""
    from_ = F.split("from_module", "/")
    parent = F.slice(from_, 1, F.greatest(F.size(from_) - 1, F.lit(1)))
    folder = F.when(F.size(from_) > 1, F.slice(from_, 1, F.greatest(F.size(from_) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    segs = F.split("raw", "::")
    rest = F.slice(segs, 2, F.greatest(F.size(segs), F.lit(1)))
    bare = F.concat(
        F.when(F.size(from_) > 1, _whole_and_trimmed(F.concat(parent, segs))).otherwise(none),
        _whole_and_trimmed(F.concat(F.slice(from_, 1, 1), segs)),
        _whole_and_trimmed(segs),
    )
    rust = (
        F.when(segs[0] == "crate", _whole_and_trimmed(F.concat(F.slice(from_, 1, 1), rest)))
        .when(segs[0] == "self", _whole_and_trimmed(F.concat(from_, rest)))
        .when(segs[0] == "super", _whole_and_trimmed(F.concat(parent, rest)))
        .otherwise(bare)
    )
    dots = F.filter(F.split("raw", r"\."), lambda s: s != "")
    dotted = F.concat(_whole_and_trimmed(dots), F.when(F.size(from_) > 1, _whole_and_trimmed(F.concat(folder, dots))).otherwise(none))

    def step(stack: Column, seg: Column) -> Column:
        up = F.when(F.size(stack) > 1, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1)))).otherwise(none)
        return F.when(seg.isin("", "."), stack).when(seg == "..", up).otherwise(F.array_append(stack, F.split(seg, r"\.")[0]))

    relative = F.when(F.col("raw").startswith("."), F.array(F.array_join(F.aggregate(F.split("raw", "/"), folder, step), "/"))).otherwise(none)
    tried = F.when(F.col("language") == "rust", rust).when(F.col("language").isin("python", "java"), dotted).otherwise(relative)
    return edges.select("from_module", "raw", F.posexplode(tried).alias("pos", "candidate")).where("candidate IS NOT NULL AND candidate <> ''")


def module_edges(raw_imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct (src, dst): each import resolved to the first of its candidates that is a module; not to itself."""
    # Modules may be many in a small file; the planner would take them for few and send them all to the driver.
    known = import_candidates(raw_imports).join(modules.select(F.col("module").alias("candidate")).distinct().hint("merge"), "candidate")
    first = known.groupBy("from_module", "raw").agg(F.min_by("candidate", "pos").alias("dst"))
    return first.select(F.col("from_module").alias("src"), "dst").where("src <> dst").distinct()
