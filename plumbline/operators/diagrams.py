"""Diagrams in documents: their parsing, and how they stand to the modules, types, tables and calls of the code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.lineage import cut
from plumbline.operators.match import best_overlap, modules_of

_ARROW = re.compile(r"[.=-]{2,}>?|[.=-]*>")
_LABELLED = re.compile(r"([^\W\d][-\w]*)\s*[\[({]+\s*([^\])}]+?)\s*[\])}]+")
_BRACKETS = re.compile(r"[\[({]+[^\])}]*[\])}]+")
_NODE = re.compile(r"\s*([\w-]+)")
_ID = r"([^\W\d]\w*)"
_SENT = r"(?:\.\.>|-{1,2}(?:>{1,2}|x|\)))"
_MESSAGE = re.compile(rf"^{_ID}\s*{_SENT}\s*{_ID}\s*:\s*(.+)$")
_CALLED = re.compile(r"\s*([^\W\d]\w*)")
_PARTY = re.compile(r'^(?:participant|actor)\s+("?[^"\n]+?"?)(?:\s+as\s+([^\W\d]\w*))?$')
#: Words that begin a line of control flow or style, which is no message.
_CONTROL = "activate alt and autonumber box deactivate else end loop note opt par rect skinparam title".split()
_NOISE = re.compile(rf"^(?:'|%%|(?:{'|'.join(_CONTROL)}|@start|@end)(?![^\W_]))", re.I)
_SUFFIX = re.compile(r"\.(cjs|java|js|jsx|mjs|py|pyi|rs|ts|tsx)$")
TAGS = {"mermaid": "mermaid", "plantuml": "plantuml", "puml": "plantuml", "uml": "plantuml", "dot": "dot", "graphviz": "dot"}


SOURCES = "doc_path string, start_line int, format string, body string"


def sources_of(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, format, body) of the diagrams in a document: back-quoted fences whose whole tag names a format, and
    bare PlantUML outside fences. What has no end is no diagram."""
    fence: tuple[str | None, int, list[str]] | None = None
    uml: tuple[int, list[str]] | None = None
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        bare = line.lstrip()
        if fence is not None:
            if not bare.startswith("```"):
                fence[2].append(line)
                continue
            if fence[0]:
                yield fence[1], fence[0], "\n".join(fence[2])
            fence = None
        elif bare.startswith("```"):
            fence = TAGS.get(bare[3:].strip().lower()), number, []
        elif uml is not None:
            uml[1].append(line)
            if bare.startswith("@enduml"):
                yield uml[0], "plantuml", "\n".join(uml[1])
                uml = None
        elif bare.startswith("@startuml"):
            uml = number, [line]


def sources(docs: DataFrame) -> DataFrame:
    """(doc_path, start_line, format, body) of the diagrams in documents (doc_path, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *found) for path, text in zip(*(c.to_pylist() for c in batch.columns)) for found in sources_of(text)]
            types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_path", "start_line", "format", "body"])

    marked = F.col("text").contains("```") | F.col("text").contains("@startuml")
    return docs.where(marked).select("doc_path", "text").mapInArrow(run, SOURCES)


def _chain(statement: str, labels: dict[str, str], arrow: re.Pattern = _ARROW) -> list[tuple[str, str, bool]]:
    bare = _BRACKETS.sub(" ", re.sub(r"\|[^|]*\|", " ", statement))
    found = list(arrow.finditer(bare))
    cuts = [0, *[x for a in found for x in a.span()], len(bare)]
    ids = [(m := _NODE.match(bare[a:b])) and m[1] for a, b in zip(cuts[::2], cuts[1::2])]
    for i in ids if found else []:
        if i:
            labels.setdefault(i, i)
    return [(a, b, ">" in arr[0]) for a, arr, b in zip(ids, found, ids[1:]) if a and b]


def parse_mermaid(body: str) -> tuple[dict[str, str], list[tuple[str, str, bool]]] | None:
    """Labels by node and edges (from, to, directed) of a graph or flowchart; None for another kind."""
    rows = [x.strip() for x in re.split(r"[\n;]", body)]
    rows = [x for x in rows if x and not x.startswith("%%")]
    if not rows or not re.match(r"(graph|flowchart)\b", rows[0]):
        return None
    labels: dict[str, str] = {}
    edges: list[tuple[str, str, bool]] = []
    for x in rows[1:]:
        if x == "end" or x.startswith("subgraph"):
            continue
        for name, label in _LABELLED.findall(x):
            labels[name] = label.strip("\"'")
        edges += _chain(x, labels)
    return labels, edges


def parse_dot(body: str) -> tuple[dict[str, str], list[tuple[str, str, bool]]] | None:
    """Labels and edges of a DOT graph; of a chain only the first edge counts."""
    body = re.sub(r"/\*.*?\*/", " ", body, flags=re.S)
    body = re.sub(r"(//|#).*", "", body)
    head = re.search(r"\b(di)?graph\b", body)
    if not head:
        return None
    labels: dict[str, str] = {}
    edges: list[tuple[str, str, bool]] = []
    name = r'"?([^"\s;\[\]{}]+)"?'
    for x in re.split(r"[;\n{}]", body[head.end() :]):
        if e := re.match(rf"\s*{name}\s*(->|--)\s*{name}", x):
            labels.setdefault(e[1], e[1])
            labels.setdefault(e[3], e[3])
            edges.append((e[1], e[3], bool(head[1])))
        elif d := re.match(rf'\s*{name}\s*\[[^\]]*\blabel\s*=\s*"?([^"\],]+)"?', x):
            labels[d[1]] = d[2].strip()
    return labels, edges


def _looks_like_sequence(rows: list[str]) -> bool:
    return any(x.startswith(("participant", "actor")) or ("->" in x and ":" in x) for x in rows)


def parse_plantuml(body: str) -> tuple[dict[str, str], list[tuple[str, str, bool]]] | None:
    """Labels and edges of a component diagram, one edge a line; None for a sequence, or where nothing is drawn."""
    rows = [x.strip() for x in body.split("\n")]
    if _looks_like_sequence(rows):
        return None
    labels: dict[str, str] = {}
    edges: list[tuple[str, str, bool]] = []
    ref = r"(\[[^\]]+\]|[^\W\d]\w*)"
    name = lambda x: x.strip().strip('[]"').strip()
    for x in rows:
        if not x or x.startswith(("'", "@", "skinparam", "title")):
            continue
        if d := re.search(r'(?:component|interface|node|\[)\s*("?[^"\]]+"?)\]?\s+as\s+([^\W\d]\w*)', x):
            labels[d[2]] = name(d[1])
        elif d := re.match(r'(?:component|interface|node)\s+("?[^"\n]+?"?)$|\[([^\]]+)\]$', x):
            label = name(d[1] or d[2])
            labels[label] = label
        elif e := re.search(rf"{ref}\s*([-.]{{2,}}>?|[-.]+>)\s*{ref}", x):
            a, b = name(e[1]), name(e[3])
            labels.setdefault(a, a)
            labels.setdefault(b, b)
            edges.append((a, b, ">" in e[2]))
    return (labels, edges) if edges or labels else None


def parse_sequence(format_: str, body: str) -> tuple[list[str], list[tuple[str, str, str]]] | None:
    """Participants in order of appearance and messages (from, to, call); None where no message is drawn.

    The call is the first name of a label, or the whole label where it begins with none.
    """
    rows = [x.strip() for x in body.split("\n")]
    if format_ == "dot" or (format_ == "mermaid" and _header(rows) != "sequenceDiagram") or (format_ == "plantuml" and not _looks_like_sequence(rows)):
        return None
    parties: dict[str, None] = {}
    messages = []
    for x in rows:
        if not x or _NOISE.match(x):
            continue
        if p := _PARTY.match(x):
            parties[(p[2] or p[1]).strip('"').strip()] = None
        elif m := _MESSAGE.match(x):
            parties |= {m[1]: None, m[2]: None}
            called = _CALLED.match(m[3])
            messages.append((m[1], m[2], called[1] if called else m[3].strip()))
    return (list(parties), messages) if messages else None


PARSERS = {"mermaid": parse_mermaid, "dot": parse_dot, "plantuml": parse_plantuml}
EDGES = "doc_path string, start_line int, pos int, src string, dst string, directed boolean"
NODES = "doc_path string, start_line int, pos int, node string, label string"


def _parsed(found: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                graph = PARSERS[r["format"]](r["body"])
                if graph:
                    rows += [(r["doc_path"], r["start_line"], i, *x) for i, x in enumerate(rows_of(graph))]
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()][: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return found.select("doc_path", F.col("start_line").cast("int"), "format", "body").mapInArrow(run, schema)


def edges(found: DataFrame) -> DataFrame:
    """The edges of all graphs, ends by label."""
    return _parsed(found, EDGES, lambda g: [(g[0].get(a, a), g[0].get(b, b), d) for a, b, d in g[1]])


def nodes(found: DataFrame) -> DataFrame:
    return _parsed(found, NODES, lambda g: list(g[0].items()))


def kind_of(format_: str, body: str) -> str:
    """What a diagram is read as: a graph, else a sequence, else declarations of classes, states or entities."""
    if PARSERS[format_](body):
        return "graph"
    return "sequence" if parse_sequence(format_, body) else "declarations"


def sequences(found: DataFrame) -> DataFrame:
    """(doc_path, start_line, step, src, dst, call) of the messages of the diagrams that are sequences."""
    schema = "doc_path string, start_line int, step int, src string, dst string, call string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if kind_of(r["format"], r["body"]) == "sequence":
                    rows += [(r["doc_path"], r["start_line"], i, *m) for i, m in enumerate(parse_sequence(r["format"], r["body"])[1], 1)]
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return found.select("doc_path", F.col("start_line").cast("int"), "format", "body").mapInArrow(run, schema)


def grounded_label(label) -> F.Column:
    return F.regexp_replace(label, _SUFFIX.pattern, "")


def module_intent(label) -> F.Column:
    """Whether a label can only mean a module: a path or namespace, no white space, markup or URL."""
    return ~label.rlike(r"""\s|^/|://|[=<>{}()\\?#&"']""") & (label.contains("/") | label.contains("::"))


_FILLER = "a an and bridge client component layer module of server service system the to".split()


def label_tokens(label) -> F.Column:
    """Distinct lower-case singular words of a label, without filler."""
    cut = F.regexp_replace(F.regexp_replace(grounded_label(label), "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    parts = F.transform(F.split(F.lower(cut), r"[\s\-_/.:]+"), lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, 1, F.length(t) - 1)).otherwise(t))
    return F.array_distinct(F.filter(parts, lambda t: (t != "") & ~t.isin(*_FILLER)))


def resolve_labels(labels: DataFrame, modules: DataFrame) -> DataFrame:
    """(label, how, module) for each distinct label: exact, ambiguous, fuzzy or none.

    Exact: the label is a module, or means just one. Fuzzy: all its words of 3 letters
    or more are among those of one module, or of several under one that is among them.
    """
    distinct = labels.select("label").distinct().withColumn("ground", grounded_label(F.col("label")))
    known = modules.select("module").distinct()
    whole = distinct.join(known, F.col("ground") == F.col("module")).select("label", "module", F.lit(True).alias("whole"))
    some = modules_of(distinct, known, "ground").groupBy("label").agg(F.countDistinct("module").alias("n"), F.min("module").alias("one"))
    words = distinct.withColumn("w", F.filter(label_tokens(F.col("label")), lambda t: F.length(t) >= 3)).where("size(w) > 0")
    held = known.select("module", F.explode(label_tokens(F.col("module"))).alias("word")).distinct()
    hits = words.select("label", F.size("w").alias("need"), F.explode("w").alias("word")).join(held, "word").groupBy("label", "need", "module").count().where("count = need").select("label", "module")
    root = hits.groupBy("label").agg(F.min("module").alias("root"), F.collect_set("module").alias("all"))
    root = root.where(F.forall("all", lambda m: (m == F.col("root")) | m.startswith(F.concat("root", F.lit("/"))))).select("label", "root")
    out = distinct.join(whole, "label", "left").join(some, "label", "left").join(root, "label", "left")
    how = F.when(F.col("whole"), "exact").when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(F.col("root").isNotNull(), "fuzzy").otherwise("none")
    module = F.when(F.col("whole"), F.col("module")).when(F.col("n") == 1, F.col("one")).when(how == "fuzzy", F.col("root"))
    return out.select("label", how.alias("how"), module.alias("module"))


def check_graph(drawn: DataFrame, real: DataFrame, modules: DataFrame) -> DataFrame:
    """(origin, src, dst, verdict) of drawn edges (origin, src, dst, directed) against real ones (src, dst).

    Both ends exact: supported if the edge is there, either way round if undirected,
    else contradicted. A label that must be a module but is none is stale (dst null).
    A real edge between two drawn modules that isn't drawn is undocumented.
    """
    # Used several times over below: written once instead of planned and parsed again each time.
    drawn, edge = cut(drawn.select("origin", "src", "dst", "directed").distinct()), cut(real.select("src", "dst").distinct())
    boxes = drawn.select("origin", F.col("src").alias("label")).union(drawn.select("origin", "dst")).distinct()
    told = cut(resolve_labels(boxes, modules))
    exact = told.where("how = 'exact'").select("label", "module")
    ends = drawn.join(exact.select(F.col("label").alias("src"), F.col("module").alias("a")), "src").join(exact.select(F.col("label").alias("dst"), F.col("module").alias("b")), "dst")
    fwd = edge.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("fwd"))
    rev = edge.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("rev"))
    seen = ends.join(fwd, ["a", "b"], "left").join(rev, ["a", "b"], "left")
    ok = F.coalesce("fwd", F.lit(False)) | (~F.col("directed") & F.coalesce("rev", F.lit(False)))
    verdicts = seen.select("origin", "src", "dst", F.when(ok, "supported").otherwise("contradicted").alias("verdict")).distinct()
    stale = boxes.join(told.where("how = 'none'"), "label").where(module_intent(F.col("label")))
    stale = stale.select("origin", F.col("label").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("stale").alias("verdict"))
    inside = boxes.join(exact, "label").select("origin", "module").distinct()
    both = inside.select("origin", F.col("module").alias("src")).join(edge, "src").join(inside.select("origin", F.col("module").alias("dst")), ["origin", "dst"])
    shown = ends.select("origin", F.col("a").alias("src"), F.col("b").alias("dst")).union(ends.select("origin", "b", "a")).distinct()
    missing = both.join(shown, ["origin", "src", "dst"], "left_anti").select("origin", "src", "dst", F.lit("undocumented").alias("verdict"))
    return verdicts.union(stale).union(missing)


MATCH, MISMATCH, GAP = 2, -1, -2


def _pair(step: str, call: str) -> int:
    return MATCH if step == call else MISMATCH


def align_ops(steps: list[str], calls: list[str]) -> list[tuple[str, str | None, str | None]]:
    """Global alignment as (kind, step, call); on ties a pair is preferred, then a step alone."""
    grid = [[GAP * k for k in range(len(calls) + 1)]]
    for at, step in enumerate(steps, 1):
        above, row = grid[-1], [GAP * at]
        for left, call in enumerate(calls):
            row.append(max(above[left] + _pair(step, call), GAP + above[left + 1], GAP + row[left]))
        grid.append(row)
    out: list[tuple[str, str | None, str | None]] = []
    a, b = len(steps), len(calls)
    while a or b:
        best = grid[a][b]
        if a and b and best - _pair(steps[a - 1], calls[b - 1]) == grid[a - 1][b - 1]:
            a, b = a - 1, b - 1
            out.append(("supported" if steps[a] == calls[b] else "contradicted", steps[a], calls[b]))
        elif a and best - GAP == grid[a - 1][b]:
            a -= 1
            out.append(("contradicted", steps[a], None))
        else:
            b -= 1
            out.append(("undocumented", None, calls[b]))
    return out[::-1]


def align(pairs: DataFrame) -> DataFrame:
    """(id, pos, verdict, step, call) for pairs (id, steps, calls) of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *op) for i, s, c in zip(*(batch.column(x).to_pylist() for x in range(3))) for k, op in enumerate(align_ops(s or [], c or []))]
            types = [batch.column(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id", "pos", "verdict", "step", "call"])

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", "steps", "calls").mapInArrow(run, f"id {kind}, pos int, verdict string, step string, call string")


def ground_states(states: DataFrame, members: DataFrame) -> DataFrame:
    """(owner, name, item, verdict) of drawn states (owner, item) against the enum that holds most of them (name, item):
    supported, stale where the enum has no such member, undocumented for members that aren't drawn."""
    picked = best_overlap(states, members).select("owner", "name")
    drawn = states.join(picked, "owner").select("owner", "name", "item", F.lit(True).alias("drawn"))
    real = members.join(picked, "name").select("owner", "name", "item", F.lit(True).alias("real")).distinct()
    both = drawn.join(real, ["owner", "name", "item"], "full")
    return both.select("owner", "name", "item", F.when(F.col("drawn") & F.col("real"), "supported").when(F.col("drawn"), "stale").otherwise("undocumented").alias("verdict"))


# -- class, state and entity diagrams: each a list of (owner, item) declarations ----------

_CLASS = re.compile(r'^(?:abstract\s+)?(?:class|interface|enum)\s+("[^"]+"|[^\W\d]\w*)')
_METHOD = re.compile(r"([^\W\d]\w*)\s*\(")
_INLINE = re.compile(rf"^{_ID}\s*:\s*(.+)$")
_POINT = r"([^\W\d]\w*|\[[*]\])"
_TRANSITION = re.compile(rf"^{_POINT}\s*-->\s*{_POINT}")
_STATE = re.compile(r'^state\s+(?:"[^"]*"\s+as\s+)?([^\W\d]\w*)')
_RELATION = re.compile(r"^([^\W\d][-\w]*)\s+[|}o]{1,2}(?:--|\.\.)[|{o]{1,2}\s+([^\W\d][-\w]*)")


def _header(rows: list[str]) -> str:
    return next((x.split()[0] for x in rows if x and not x.startswith("%%")), "")


def parse_classes(format_: str, body: str) -> list[tuple[str, str | None]]:
    """(class, method) declarations; a class without a method once with None."""
    rows = [x.strip() for x in body.split("\n")]
    if format_ == "dot" or (format_ == "mermaid" and _header(rows) != "classDiagram") or (format_ == "plantuml" and not any(map(_CLASS.match, rows))):
        return []
    out: dict[str, list[str]] = {}
    current = None
    for x in rows:
        if not x or x.startswith(("%%", "'")):
            continue
        if x.startswith("}"):
            current = None
        elif m := _CLASS.match(x):
            name = m[1].strip('"')
            out.setdefault(name, [])
            current = name if x.endswith("{") else None
        elif current is not None:
            out[current] += [m[1]] if (m := _METHOD.search(x)) else []
        elif m := _INLINE.match(x):
            out.setdefault(m[1], [])
            out[m[1]] += [k[1]] if (k := _METHOD.search(m[2])) else []
    return [(c, i) for c, items in out.items() for i in (items or [None])]


def parse_states(format_: str, body: str) -> list[tuple[str, str | None]]:
    rows = [x.strip() for x in body.split("\n")]
    if format_ != "mermaid" or _header(rows) not in ("stateDiagram", "stateDiagram-v2"):
        return []
    found: dict[str, None] = {}
    for x in rows:
        if m := _TRANSITION.match(x):
            found |= {s: None for s in m.groups() if s != "[*]"}
        elif m := _STATE.match(x):
            found[m[1]] = None
    return [("states", s) for s in found]


def parse_entities(format_: str, body: str) -> list[tuple[str, str | None]]:
    rows = [x.strip() for x in body.split("\n")]
    if format_ != "mermaid" or _header(rows) != "erDiagram":
        return []
    out: dict[str, list[str]] = {}
    current = None
    for x in rows[1:]:
        if not x or x.startswith("%%") or x == "erDiagram":
            continue
        if x.startswith("}"):
            current = None
        elif m := re.match(r"^([^\W\d][-\w]*)\s*\{", x):
            current = m[1]
            out.setdefault(current, [])
        elif m := _RELATION.match(x):
            for e in m.groups():
                out.setdefault(e, [])
        elif current and len(x.split()) > 1:
            out[current].append(x.split()[1])
    return [(e, i) for e, items in out.items() for i in (items or [None])]


DECLARATIONS = {"class": parse_classes, "state": parse_states, "entity": parse_entities}


def declarations(found: DataFrame, kind: str) -> DataFrame:
    """(origin, pos, owner, item) of the diagrams of ``kind``: class, state or entity, and no graph or sequence."""
    parse = DECLARATIONS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if kind_of(r["format"], r["body"]) == "declarations":
                    rows += [(f"{r['doc_path']}:{r['start_line']}", i, *x) for i, x in enumerate(parse(r["format"], r["body"]))]
            types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["origin", "pos", "owner", "item"])

    return found.select("doc_path", F.col("start_line").cast("int"), "format", "body").mapInArrow(run, "origin string, pos int, owner string, item string")


def check_classes(drawn: DataFrame, symbols: DataFrame) -> DataFrame:
    """(origin, owner, item, verdict): a class that is a type is supported (item null); a method of it that its module
    lacks is stale, else supported; classes that are no type are silent. Of equal names the last type wins."""
    types = symbols.where(F.col("kind").isin("class", "enum", "interface", "struct", "trait"))
    last = types.groupBy(F.col("name").alias("owner")).agg(F.max_by("module", F.struct("path", "idx")).alias("module"))
    methods = symbols.where(F.col("kind").isin("function", "method")).select("module", F.col("name").alias("item"), F.lit(True).alias("real")).distinct()
    known = drawn.join(last, "owner")
    whole = known.select("origin", "owner", F.lit(None).cast("string").alias("item"), F.lit("supported").alias("verdict")).distinct()
    each = known.where("item IS NOT NULL").join(methods, ["module", "item"], "left").select("origin", "owner", "item", F.when(F.col("real"), "supported").otherwise("stale").alias("verdict")).distinct()
    return whole.unionByName(each)


def check_entities(drawn: DataFrame, tables: DataFrame) -> DataFrame:
    """(origin, owner, item, verdict): columns drawn for an entity against the table (name, column) of its name, plural or not."""
    key = lambda c: F.regexp_replace(F.lower(c), "s+$", "")
    t = tables.select("name").distinct().withColumn("__key", key(F.col("name")))
    best = drawn.select("owner").distinct().withColumn("__key", key(F.col("owner"))).join(t, "__key")
    best = best.groupBy("owner").agg(F.min_by("name", F.struct(F.lower("owner") != F.col("name"), "name")).alias("name"))
    columns = tables.select("name", F.lower("column").alias("__item"), F.lit(True).alias("real")).distinct()
    known = drawn.join(best, "owner").where("item IS NOT NULL").withColumn("__item", F.lower("item"))
    return known.join(columns, ["name", "__item"], "left").select("origin", "owner", "item", F.when(F.col("real"), "supported").otherwise("stale").alias("verdict")).distinct()


def check_sequences(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, pos, verdict, step, call): each drawn sequence (id, steps) aligned with the definition whose calls hold most of its steps."""
    items = steps.select(F.col("id").alias("owner"), F.explode("steps").alias("item"))
    calls = symbols.where("size(calls) > 0").select(F.col("qualified_name").alias("name"), F.explode("calls").alias("item"))
    picked = best_overlap(items, calls).select(F.col("owner").alias("id"), "name")
    real = symbols.select(F.col("qualified_name").alias("name"), "calls").dropDuplicates(["name"])
    return align(steps.join(picked, "id").join(real, "name").select("id", "steps", "calls"))
