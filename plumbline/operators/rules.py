"""Architecture rules: told in prose, held against the graph of module imports."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import TICK
from plumbline.operators.lineage import cut
from plumbline.operators.match import modules_of, subpaths

_GAP = r"\s+"


def _one(*choices: str) -> str:
    return f"(?:{'|'.join(choices)})"


def _maybe(*parts: str) -> str:
    return f"(?:{''.join(parts)})?"


def _phrase(*parts: str) -> str:
    return _GAP.join(parts)


_NOUN = _maybe(_GAP, _one("component", "crate", "layer", "module", "package"))
_SUBJECT = TICK + _NOUN
_OBJECT = _maybe("the", _GAP) + TICK
_MODAL = _one("can", "may", "must", "should")
_DEPEND, _IMPORT, _REFER, _USE = _phrase("depends?", "on"), "imports?", "references?", "uses?"
_DIRECT = _one("access(?:es)?", _phrase("calls?", "into"), _DEPEND, _IMPORT + _maybe(_GAP, _maybe("anything", _GAP), "from"), _REFER, "touch(?:es)?", _USE)
_FAR = _one(_phrase(_maybe("even", _GAP) + _one("indirectly", "transitively"), _one(_DEPEND, _IMPORT, "reach(?:es)?", _REFER, _USE)), "reach(?:es)?")
_CALLED = _one("calls?", "usage", "use")
PATTERNS = {
    "forbid_edge": _phrase(_SUBJECT, _one(_phrase(_one("can", "do", "does", "may", "must", "should"), "not"), "can'?t", "cannot"), _DIRECT, _OBJECT),
    "never_edge": _phrase(_SUBJECT, _maybe(_MODAL, _GAP) + "never", _one(_DEPEND, _IMPORT, _REFER, _USE), _OBJECT),
    "forbid_reach": _phrase(_SUBJECT, _one("cannot", _MODAL), "not", _FAR, _OBJECT),
    "forbidden_by": _phrase(_SUBJECT, _MODAL, "not", "be", _one("accessed", _phrase("depended", "on"), "imported", "referenced", "used"), _one("by", "from", "in"), _OBJECT),
    "independent": _phrase(_SUBJECT, _one("are", "is", "remains?", "stays?"), "independent", _one("from", "of"), _OBJECT),
    "depends_on_nothing": _phrase(_SUBJECT, _one(_DEPEND, "has", _IMPORT), _one("nothing", _phrase("no", _one("dependencies", "deps", "imports")))),
    "only_depends": _phrase(_SUBJECT, _maybe(_MODAL, _GAP) + "only", _one(_DEPEND, _IMPORT), "(.*)"),
    "forbid_symbol": "(?i)" + _phrase(
        _one(
            _phrase(_one("may", "must", "should"), "not", _one("call", "invoke", "reference", "use")),
            _phrase(_one("don'?t", "never"), _one("call", "use")),
            _phrase("no", _one("direct", "raw")) + _maybe(_GAP, _phrase(_one(_CALLED, "reference"), _one("of", "to"))),
            _phrase("no", _CALLED, _one("of", "to")),
        ),
        TICK,
    ),
}


#: What each pattern says: kind, the groups that are ``a`` and ``b``, and what the rule's items are.
_SAYS = {
    "forbid_edge": [("forbid_edge", 1, 2, None)],
    "never_edge": [("forbid_edge", 1, 2, None)],
    "forbid_reach": [("forbid_reach", 1, 2, None)],
    "forbidden_by": [("forbid_edge", 2, 1, None)],
    "independent": [("forbid_edge", 1, 2, None), ("forbid_edge", 2, 1, None)],
    "depends_on_nothing": [("layer", 1, None, None)],
    "only_depends": [("layer", 1, None, "allowed")],
    "forbid_symbol": [("forbid_symbol", 1, None, "excepted")],
}
#: Words without one of which a pattern can't match.
_NEEDS = {
    "forbid_edge": ("not", "can't", "cant"), "never_edge": ("never",), "forbid_reach": ("reach", "directly", "transitively"), "forbidden_by": ("be ",),
    "independent": ("independent",), "depends_on_nothing": ("nothing", "no"), "only_depends": ("only",), "forbid_symbol": ("",),
}
#: A line without any of these states no rule.
_CUE = "(?i)not|never|can'?t|don'?t|independent|nothing|only|no "


def extract_rules(doc_lines: DataFrame) -> DataFrame:
    """(doc_path, line_no, kind, a, b, items) of the rules outside fences and double quotes; takes marked lines.

    kind: forbid_edge a b, forbid_reach a b, layer a (items: what it may import),
    forbid_symbol a (items: modules it is allowed in). All patterns are looked for in one
    pass over the lines; only lines with a back quote and a cue get that far.
    """
    prose = doc_lines.where(~F.col("fenced") & F.col("line").contains("`") & F.col("line").rlike(_CUE))
    prose = prose.select("doc_path", "line_no", F.regexp_replace("line", '"[^"]*"', "").alias("line"))
    none = F.array().cast("array<string>")
    rest = F.regexp_extract("line", r"(?i)(?:outside)(.*)$", 1)
    rest = F.when(F.lower("line").contains("outside"), rest).otherwise(F.regexp_extract("line", r"(?i)(?:except)(.*)$", 1))
    excepted = F.regexp_extract_all(rest, F.lit(TICK), 1)

    def said(name: str, kind: str, a: int, b: int | None, items: str | None) -> Column:
        def rule(m: Column) -> Column:
            group = lambda g: F.regexp_extract(m, PATTERNS[name], g)
            listed = F.regexp_extract_all(group(2), F.lit(TICK), 1) if items == "allowed" else excepted if items else none
            second = group(b) if b else F.lit(None).cast("string")
            return F.struct(F.lit(kind).alias("kind"), group(a).alias("a"), second.alias("b"), listed.alias("items"))

        may = functools.reduce(operator.or_, [F.col("line").contains(word) for word in _NEEDS[name]])
        matches = F.when(may, F.regexp_extract_all("line", F.lit(PATTERNS[name]), F.lit(0))).otherwise(none)
        found = F.transform(matches, rule)
        return F.filter(found, lambda r: F.size(r["items"]) > 0) if items == "allowed" else found

    each = F.concat(*[said(name, *says) for name, all_ in _SAYS.items() for says in all_])
    return prose.select("doc_path", "line_no", F.explode(each).alias("r")).select("doc_path", "line_no", "r.*")


def described(kind: Column, a: Column, b: Column, items: Column) -> Column:
    """A rule in one line."""
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    listed = F.array_join(F.transform(items, code), ", ")
    return (
        F.when(kind == "forbid_edge", F.concat(code(a), F.lit(" ✗→ "), code(b)))
        .when(kind == "forbid_reach", F.concat(code(a), F.lit(" ✗⇢ "), code(b), F.lit(" (transitive)")))
        .when((kind == "layer") & (F.size(items) == 0), F.concat(code(a), F.lit(" depends on nothing")))
        .when(kind == "layer", F.concat(code(a), F.lit(" → only "), listed))
        .when(F.size(items) == 0, F.concat(F.lit("forbid symbol "), code(a)))
        .otherwise(F.concat(F.lit("forbid symbol "), code(a), F.lit(" (except "), listed, F.lit(")")))
    )


def modules(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("module")).union(edges.select("dst")).distinct()


def forbidden_edges(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, src, dst) for each edge from a module that ``a`` means to one that ``b`` means."""
    known = modules(edges)
    pairs = rules.where("kind = 'forbid_edge'").select("a", "b").distinct()
    src = modules_of(pairs, known, "a").withColumnRenamed("module", "src")
    both = modules_of(src, known, "b").withColumnRenamed("module", "dst")
    return both.join(edges.select("src", "dst").distinct(), ["src", "dst"]).select("a", "b", "src", "dst")


def layer_breaches(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, items, src, dst) for each edge that leaves the layer ``a`` for a module that this rule doesn't allow."""
    known = modules(edges)
    layers = rules.where("kind = 'layer'").select("a", "items").distinct()
    inside = modules_of(layers, known, "a")
    allowed = modules_of(layers.select("a", "items", F.explode("items").alias("item")), known, "item").select("a", "items", F.col("module").alias("dst"))
    out = inside.withColumnRenamed("module", "src").join(edges.select("src", "dst").distinct(), "src")
    own = inside.select("a", "items", F.col("module").alias("dst"))
    return out.join(own.union(allowed).distinct(), ["a", "items", "dst"], "left_anti").select("a", "items", "src", "dst")


def forbidden_reach(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, src, hit, depth, chain): the nearest module that ``b`` means, and ``a`` doesn't, on a path from each source.

    chain: the modules of the path, the least of equally short ones. A breadth-first
    search of all sources at once; a source that has hit is not followed further. Each
    round is one join and one anti-join, and writes one table; it ends with the longest
    path.
    """
    step = cut(edges.select("src", "dst").distinct())
    known = modules(step)
    pairs = rules.where("kind = 'forbid_reach'").select("a", "b").distinct()
    means = cut(
        modules_of(pairs, known, "a").select("a", "b", F.col("module").alias("node"), F.lit(True).alias("of_a"))
        .unionByName(modules_of(pairs, known, "b").select("a", "b", F.col("module").alias("node"), F.lit(False).alias("of_a")))
        .groupBy("a", "b", "node").agg(F.max("of_a").alias("of_a"), (~F.min("of_a")).alias("of_b"))
    )
    targets = means.where("of_b AND NOT of_a").select("a", "b", "node", F.lit(True).alias("hit"))
    # A rule is followed only if both its operands mean some module.
    start = means.where("of_a AND NOT of_b").join(targets.select("a", "b").distinct(), ["a", "b"], "left_semi")
    seen = start.select("a", "b", F.col("node").alias("src"), "node")
    frontier = seen.withColumn("chain", F.array("node"))
    depth, hits = 0, None
    while not frontier.isEmpty():
        depth += 1
        ahead = frontier.join(step.select(F.col("src").alias("node"), "dst"), "node").select("a", "b", "src", F.col("dst").alias("node"), F.array_append("chain", F.col("dst")).alias("chain"))
        ahead = ahead.groupBy("a", "b", "src", "node").agg(F.min("chain").alias("chain"))
        ahead = cut(ahead.join(seen, ["a", "b", "src", "node"], "left_anti").join(targets, ["a", "b", "node"], "left"))
        found = ahead.where("hit").groupBy("a", "b", "src").agg(F.min(F.struct("node", "chain")).alias("h"))
        found = found.select("a", "b", "src", F.col("h.node").alias("hit"), F.lit(depth).alias("depth"), "h.chain")
        hits = found if hits is None else hits.unionByName(found)
        seen = seen.unionByName(ahead.select("a", "b", "src", "node"))
        frontier = ahead.select("a", "b", "src", "node", "chain").join(found.select("a", "b", "src"), ["a", "b", "src"], "left_anti")
    if hits is None:
        return frontier.select("a", "b", "src", F.col("node").alias("hit"), F.lit(0).alias("depth"), "chain").where("false")
    return hits


TOKEN = r"([\p{L}\p{N}_]+)"


def banned_symbols(rules: DataFrame) -> DataFrame:
    """(symbol, items) of the rules on symbols; each list of exceptions is a rule of its own."""
    return rules.where("kind = 'forbid_symbol'").select(F.col("a").alias("symbol"), "items").distinct()


def excepted_modules(rules: DataFrame, known: DataFrame) -> DataFrame:
    """(symbol, items, module) of the modules (module) that a rule on a symbol leaves out."""
    each = banned_symbols(rules).select("symbol", "items", F.explode("items").alias("item"))
    return modules_of(each, known.select("module").distinct(), "item").select("symbol", "items", "module").distinct()


def forbidden_symbols(rules: DataFrame, code_lines: DataFrame) -> DataFrame:
    """(symbol, items, module, line_no) of source lines (module, line_no, line) that name a forbidden symbol outside its
    exceptions. Identifiers join on the line's words; other operands are few and searched as literals."""
    banned = banned_symbols(rules)
    word = F.col("symbol").rlike(r"^[\p{L}\p{N}_]+$")
    words = code_lines.select("module", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(TOKEN), 1))).alias("symbol"))
    direct = words.join(banned.where(word), "symbol").select("symbol", "items", "module", "line_no")
    literal = code_lines.join(banned.where(~word), F.expr("contains(line, symbol)")).select("symbol", "items", "module", "line_no")
    return direct.union(literal).distinct().join(excepted_modules(rules, code_lines), ["symbol", "items", "module"], "left_anti")


def identified(rules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, qualified_name) of the operands that name just one of the definitions (qualified_name, name, path, idx).

    A definition is named by its qualified name, by the end of it from a ``::`` on, or by
    its name as what stands after the operand's last colon or point.
    """
    operands = rules.where("kind = 'forbid_symbol'").select(F.col("a").alias("symbol")).distinct()
    keys = symbols.select("qualified_name", "path", "idx", F.explode(ends(F.col("qualified_name"))).alias("symbol"))
    by_end = operands.join(keys, "symbol").select("symbol", "qualified_name", "path", "idx")
    leaf = operands.withColumn("name", F.element_at(F.split("symbol", "[:.]", -1), -1))
    by_name = leaf.join(symbols.select("qualified_name", "name", "path", "idx"), "name").select("symbol", "qualified_name", "path", "idx")
    one = by_end.union(by_name).distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("qualified_name"))
    return one.where("n = 1").select("symbol", "qualified_name")


def ends(qualified: Column) -> Column:
    """A qualified name and what is left of it after each ``::``."""
    parts = F.split(qualified, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))


def indirect_symbols(rules: DataFrame, direct: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(symbol, items, module, caller): definitions that refer (from_symbol, to_symbol) to a forbidden symbol though their
    module's text doesn't name it.

    Only symbols that name one definition count. ``direct`` is what ``forbidden_symbols``
    found; modules it has for a rule are left out, and so are the rule's exceptions.
    """
    module = F.regexp_replace("from_symbol", "::((?!::).)*$", "")
    callers = references.select("from_symbol", F.col("to_symbol").alias("qualified_name"), module.alias("module")).join(identified(rules, symbols), "qualified_name")
    found = callers.join(banned_symbols(rules), "symbol").select("symbol", "items", "module", F.col("from_symbol").alias("caller")).distinct()
    found = found.join(direct.select("symbol", "items", "module").distinct(), ["symbol", "items", "module"], "left_anti")
    return found.join(excepted_modules(rules, found), ["symbol", "items", "module"], "left_anti")


def scanned_modules(rules: DataFrame, code_lines: DataFrame) -> DataFrame:
    """(symbol, items, scanned): the modules that a rule on a symbol is held against, which a clean rule is anchored to."""
    known = code_lines.select("module").distinct()
    all_ = known.agg(F.array_sort(F.collect_set("module")).alias("all"))  # one row
    left_out = excepted_modules(rules, known).groupBy("symbol", "items").agg(F.collect_set("module").alias("out"))
    each = banned_symbols(rules).join(left_out, ["symbol", "items"], "left").crossJoin(F.broadcast(all_))
    return each.select("symbol", "items", F.array_except("all", F.coalesce("out", F.array().cast("array<string>"))).alias("scanned"))


def audit(rules: DataFrame, edges: DataFrame, code_lines: DataFrame | None = None, symbols: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """(kind, a, b, items, rule, status, n, operand) for each rule: Holds, Violated with the number, or Ungrounded with the operand.

    Rules on symbols are held against ``code_lines``, and through ``references`` against
    callers of the one definition they name; they are never ungrounded, and left out
    without ``code_lines``.
    """
    rules, edges = cut(rules.select("kind", "a", "b", "items").distinct()), cut(edges.select("src", "dst").distinct())
    known = modules(edges)
    base = rules if code_lines is not None else rules.where("kind <> 'forbid_symbol'")
    named = rules.where("kind <> 'forbid_symbol'").select(F.explode(F.array("a", "b")).alias("operand")).where("operand IS NOT NULL").distinct()
    grounded = cut(modules_of(named, known).select("operand").distinct())
    none, nothing = F.lit(None).cast("string").alias("b"), F.array().cast("array<string>").alias("items")
    breaches = (
        forbidden_edges(rules, edges).select(F.lit("forbid_edge").alias("kind"), "a", "b", nothing)
        .unionByName(forbidden_reach(rules, edges).select(F.lit("forbid_reach").alias("kind"), "a", "b", nothing))
        .unionByName(layer_breaches(rules, edges).select(F.lit("layer").alias("kind"), "a", none, "items"))
    )
    if code_lines is not None:
        direct = forbidden_symbols(rules, code_lines)
        if symbols is not None and references is not None:
            direct = cut(direct)
            breaches = breaches.unionByName(indirect_symbols(rules, direct, symbols, references).select(F.lit("forbid_symbol").alias("kind"), F.col("symbol").alias("a"), none, "items"))
        breaches = breaches.unionByName(direct.select(F.lit("forbid_symbol").alias("kind"), F.col("symbol").alias("a"), none, "items"))
    key = ["kind", "a", "__b", "items"]
    blank = F.coalesce("b", F.lit("")).alias("__b")
    n = breaches.groupBy("kind", "a", blank, "items").agg(F.count(F.lit(1)).alias("n"))
    out = base.select("*", blank).join(n, key, "left")
    out = out.join(grounded.select(F.col("operand").alias("a"), F.lit(True).alias("a_known")), "a", "left")
    out = out.join(grounded.select(F.col("operand").alias("b"), F.lit(True).alias("b_known")), "b", "left")
    missing = F.when(F.col("kind") == "forbid_symbol", None).when(F.col("a_known").isNull(), F.col("a")).when((F.col("kind") != "layer") & F.col("b_known").isNull(), F.col("b"))
    status = F.when(missing.isNotNull(), "Ungrounded").when(F.col("n") > 0, "Violated").otherwise("Holds")
    text = described(F.col("kind"), F.col("a"), F.col("b"), F.col("items"))
    return out.select("kind", "a", "b", "items", text.alias("rule"), status.alias("status"), F.when(status == "Violated", F.col("n")).alias("n"), missing.alias("operand"))


#: Words that a sentence about design uses without meaning a module.
GENERAL_WORDS = tuple(
    """abstraction abstractions all any anything both class classes client clients code component components concretion
    concretions crate crates data dependencies dependency detail details each entities entity everything file files framework
    frameworks function functions high-level implementation implementations interface interfaces it layer layers libraries
    library low-level method methods module modules nothing one other others package packages run-time runtime scope server
    something state system systems that them these thing things this those type types user users""".split()
)
_STARS = "[*]{0,2}"
_PART = r"[-.\w]"
_BARE = _maybe("the", _GAP) + f"{_STARS}([a-z]{_PART}*(?:/{_PART}+)*){_STARS}"
_BARE_NOUN = _maybe(_GAP, _one("classes", "code", "component", "crate", "implementations?", "internals?", "layer", "library", "module", "package"))
_BARE_SUBJECT = _phrase(_BARE + _BARE_NOUN, _one(_phrase(_MODAL, "not"), "can'?t", "cannot"))
BARE_PATTERNS = {
    "forbid_reach": "(?i)" + _phrase(_BARE_SUBJECT, _FAR, _BARE),
    "forbid_edge": "(?i)" + _phrase(_BARE_SUBJECT, _one("access(?:es)?", _DEPEND, _IMPORT, _REFER, _USE), _BARE),
}


def extract_bare_rules(doc_lines: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_path, line_no, kind, a, b) of rules whose operands aren't quoted, for the audit alone.

    An operand counts only if it is a segment of a module, or a run of segments, in
    any case, and no general word; of equal segments the least spelling is taken.
    """
    prose = doc_lines.withColumn("line", F.regexp_replace("line", '"[^"]*"', ""))
    out = None
    for kind, pattern in BARE_PATTERNS.items():
        each = F.arrays_zip(*[F.regexp_extract_all("line", F.lit(pattern), g + 1).alias(f"g{g}") for g in range(2)])
        part = prose.withColumn("g", F.explode(each)).select("doc_path", "line_no", F.lit(kind).alias("kind"), F.col("g.g0").alias("a"), F.col("g.g1").alias("b"))
        out = part if out is None else out.unionByName(part)
    runs = known.select(F.explode(subpaths(F.col("module"))).alias("said")).select(F.lower("said").alias("key"), F.when(F.col("said").contains("/"), F.lower("said")).otherwise(F.col("said")).alias("said"))
    runs = runs.groupBy("key").agg(F.min("said").alias("said"))
    for side in ("a", "b"):
        bare = F.lower(F.regexp_replace(side, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        meant = out.withColumn("key", bare).where(~F.col("key").isin(*GENERAL_WORDS))
        out = meant.join(runs, "key").withColumn(side, F.col("said")).select("doc_path", "line_no", "kind", "a", "b")
    return out.where("a <> b")
