"""The check of a repository: every document's claims against its code, scored and carried forward."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars, text
from plumbline.operators import checks, code, diagrams, drift, evidence, history, match, retrieval, rules
from plumbline.operators.lineage import cut
from plumbline.sources import repo

ARTIFACTS = ".plumbline"
FINDINGS = ["verdict", "claim", "doc_path", "detail", "anchors", "check"]


@dataclass
class Context:
    """The tables of one repository, each made once and written where several checks read it."""

    spark: SparkSession
    root: str
    only: str | None = None
    exclude: tuple[str, ...] = ()

    @cached_property
    def files(self) -> DataFrame:
        return repo.files(self.spark, self.root)

    @cached_property
    def docs(self) -> DataFrame:
        found = repo.documents(self.files, self.only)
        return cut(found.where(~scalars.excluded(F.col("doc_path"), list(self.exclude))))

    @cached_property
    def lines(self) -> DataFrame:
        return cut(text.doc_lines(self.docs))

    @cached_property
    def code(self) -> DataFrame:
        return cut(repo.code(self.files))

    @cached_property
    def symbols(self) -> DataFrame:
        return cut(code.symbols(self.code))

    @cached_property
    def references(self) -> DataFrame:
        return cut(match.resolve_references(code.references(self.code), self.symbols))

    @cached_property
    def modules(self) -> DataFrame:
        """Modules that define something or import something."""
        return cut(self.symbols.select("module").union(self.imports.select("from_module")).distinct())

    @cached_property
    def imports(self) -> DataFrame:
        return cut(code.imports(self.code))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(code.module_edges(self.imports, self.modules))

    @cached_property
    def code_lines(self) -> DataFrame:
        """(module, line_no, line) of all code files, those in languages that aren't parsed too."""
        each = self.code.select("module", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
        return each.select("module", (F.col("pos") + 1).alias("line_no"), "line")

    @cached_property
    def tokens(self) -> DataFrame:
        return cut(text.words(self.code))

    @cached_property
    def commands(self) -> DataFrame:
        return cut(text.commands(self.lines))

    @cached_property
    def commits(self) -> DataFrame:
        return repo.commit_files(self.spark, self.root)

    @cached_property
    def diagrams(self) -> DataFrame:
        return cut(diagrams.sources(self.docs))

    @cached_property
    def manifest_texts(self) -> DataFrame:
        return cut(repo.manifest_files(self.files))

    @cached_property
    def bins(self) -> DataFrame:
        return repo.cargo_bins(self.manifest_texts, self.files.where("NOT folder").select("path"))

    @cached_property
    def manifests(self) -> DataFrame:
        return cut(repo.npm_manifests(self.manifest_texts)[0].union(repo.make_targets(self.manifest_texts)).union(self.bins))

    @cached_property
    def binaries(self) -> DataFrame:
        return repo.npm_manifests(self.manifest_texts)[1].select("name").union(self.bins.select("name")).distinct()


def findings(df: DataFrame, check: str, claim, detail=None, anchors=None, doc=None) -> DataFrame:
    """The rows of a check in the shape that all share."""
    where = F.concat_ws(":", "doc_path", F.col("line_no").cast("string")) if doc is None else doc
    empty = F.array().cast("array<string>")
    return df.select(
        "verdict", claim.alias("claim"), where.alias("doc_path"), (F.lit("") if detail is None else detail).alias("detail"),
        (empty if anchors is None else anchors).alias("anchors"), F.lit(check).alias("check"),
    )


def _code(column: str):
    return F.concat(F.lit("`"), column, F.lit("`"))


def paths(c: Context) -> DataFrame:
    claims = cut(text.path_claims(c.lines))
    known = repo.paths(c.files).select("path").unionByName(repo.on_disk(claims, c.root))
    found = checks.check_paths(claims, known)
    return findings(found, "paths", F.concat(F.lit("names path "), _code("raw")), F.when(F.col("verdict") == "stale", "no such path").otherwise(""), F.array("raw"))


def commands(c: Context) -> DataFrame:
    where = repo.nearest(c.docs, c.manifests)
    told = text.classify_commands(c.commands).join(where, ["doc_path", "kind"])
    own = c.manifests.select("dir", "kind", F.col("name").alias("target"), F.lit(True).alias("found")).distinct()
    found = told.join(own, ["dir", "kind", "target"], "left").withColumn("verdict", F.when(F.col("found"), "supported").otherwise("stale"))
    manifest = F.create_map(F.lit("npm"), F.lit("package.json"), F.lit("make"), F.lit("Makefile"), F.lit("cargo"), F.lit("Cargo.toml"))
    return findings(found, "commands", F.concat(F.lit("runs "), _code("cmd")), F.concat(F.col("kind"), F.lit(" target "), _code("target")), F.array(manifest[F.col("kind")]))


def environment(c: Context) -> DataFrame:
    found = checks.check_env(text.env_variables(c.lines), c.tokens)
    return findings(found, "environment", F.concat(F.lit("names variable "), _code("name")))


def flags(c: Context) -> DataFrame:
    found = checks.check_flags(text.flags(c.commands, c.binaries), c.tokens)
    return findings(found, "flags", F.concat(F.lit("names flag `--"), "flag", F.lit("`")))


def references(c: Context) -> DataFrame:
    found = checks.check_references(text.qualified_references(c.lines), *checks.grounding(c.symbols))
    return findings(found, "references", F.concat(F.lit("refers to "), _code("reference")), anchors=F.array(F.element_at(F.split("reference", "::"), -1)))


def constants(c: Context) -> DataFrame:
    found = checks.check_constants(text.constant_claims(c.lines), checks.literals(c.symbols))
    return findings(found, "constants", F.concat_ws(" ", _code("symbol"), F.lit("is"), "vkey"), anchors=F.array("symbol"))


def graph(c: Context) -> DataFrame:
    from_docs = diagrams.edges(c.diagrams).select(F.concat_ws(":", "doc_path", F.col("start_line").cast("string")).alias("origin"), "src", "dst", "directed")
    parts = [from_docs]
    if c.only is None:
        dots = repo.dot_files(c.files).select("doc_path", F.lit(1).alias("start_line"), F.lit("dot").alias("format"), F.col("text").alias("body"))
        parts.append(diagrams.edges(dots).select(F.col("doc_path").alias("origin"), "src", "dst", "directed"))
    drawn = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    found = diagrams.check_graph(drawn, c.edges, c.modules)
    claim = F.when(F.col("dst").isNull(), F.concat(F.lit("draws "), _code("src"))).otherwise(F.concat(F.lit("draws "), _code("src"), F.lit(" -> "), _code("dst")))
    return findings(found, "diagrams", claim, anchors=F.filter(F.array("src", "dst"), lambda x: x.isNotNull()), doc=F.col("origin"))


def shapes(c: Context) -> DataFrame:
    """Class, entity and state diagrams, and sequences."""
    classes = diagrams.check_classes(diagrams.declarations(c.diagrams, "class"), c.symbols)
    entities = diagrams.check_entities(diagrams.declarations(c.diagrams, "entity"), repo.sql_schema(c.files))
    states = diagrams.declarations(c.diagrams, "state").select(F.col("origin").alias("owner"), "item").distinct()
    members = c.symbols.where("kind = 'enum'").select(F.col("qualified_name").alias("name"), F.explode("members").alias("item"))
    grounded = diagrams.ground_states(states, members).select(F.col("owner").alias("origin"), F.col("name").alias("owner"), "item", "verdict")
    declared = classes.unionByName(entities).unionByName(grounded)
    one = findings(declared, "shapes", F.concat_ws(".", "owner", "item"), anchors=F.array("owner"), doc=F.col("origin"))
    told = diagrams.sequences(c.diagrams).withColumn("id", F.concat_ws(":", "doc_path", F.col("start_line").cast("string")))
    told = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "call"))).alias("s"))
    ops = diagrams.check_sequences(told.select("id", F.col("s.call").alias("steps")), c.symbols)
    two = findings(ops, "sequences", F.concat_ws(" ", F.lit("step"), (F.col("pos") + 1).cast("string"), F.coalesce("step", "call")), doc=F.col("id"))
    return one.unionByName(two)


def _listed(column: str):
    return F.array_join(column, ",")


def architecture(c: Context) -> DataFrame:
    """A finding for each breach of a rule, or one for a rule that holds and whose operands the code has."""
    told = cut(rules.extract_rules(c.lines))
    none, nothing = F.lit(None).cast("string").alias("b"), F.array().cast("array<string>").alias("items")
    edges_ = rules.forbidden_edges(told, c.edges).select(F.lit("forbid_edge").alias("kind"), "a", "b", nothing, F.concat_ws(" -> ", "src", "dst").alias("what"), F.array("src", "dst").alias("at"))
    reach = rules.forbidden_reach(told, c.edges).select(F.lit("forbid_reach").alias("kind"), "a", "b", nothing, F.array_join("chain", " -> ").alias("what"), F.array("src", "hit").alias("at"))
    layer = rules.layer_breaches(told, c.edges).select(F.lit("layer").alias("kind"), "a", none, "items", F.concat_ws(" -> ", "src", "dst").alias("what"), F.array("src", "dst").alias("at"))
    direct = cut(rules.forbidden_symbols(told, c.code_lines))
    kind, a = F.lit("forbid_symbol").alias("kind"), F.col("symbol").alias("a")
    symbol = direct.select(kind, a, none, "items", F.concat_ws(":", "module", F.col("line_no").cast("string")).alias("what"), F.array("module").alias("at"))
    indirect = rules.indirect_symbols(told, direct, c.symbols, c.references).select(kind, a, none, "items", F.col("caller").alias("what"), F.array("caller").alias("at"))
    broken = cut(edges_.unionByName(reach).unionByName(layer).unionByName(symbol).unionByName(indirect))
    key = lambda df: (df.kind == told.kind) & (df.a == told.a) & df.b.eqNullSafe(told.b) & (df["items"] == told["items"])
    place = [told.doc_path, told.line_no, told.kind, told.a, told.b, told["items"]]
    bad = told.join(broken, key(broken)).select(*place, broken.what, broken.at, F.lit("contradicted").alias("verdict"))
    held = rules.audit(told.where("kind <> 'forbid_symbol'"), c.edges).where("status = 'Holds'")
    own = F.filter(F.array("a", "b"), lambda x: x.isNotNull())
    held = held.select("kind", "a", "b", "items", own.alias("at"))
    clean = rules.scanned_modules(told, c.code_lines).where("size(scanned) > 0").select(kind, a, none, "items", F.col("scanned").alias("at"))
    clean = clean.join(broken.select("kind", "a", "items"), ["kind", "a", "items"], "left_anti").select("kind", "a", "b", "items", "at")
    fine = held.unionByName(clean)
    kept = told.join(fine, key(fine)).select(*place, F.lit("").alias("what"), fine.at, F.lit("supported").alias("verdict"))
    said = F.concat_ws(" ", "kind", "a", "b", F.when(F.size("items") > 0, F.concat(F.lit("except "), _listed("items"))))
    return findings(bad.union(kept).distinct(), "rules", F.when(F.col("kind") == "layer", F.concat_ws(" ", "kind", "a", F.nullif(_listed("items"), F.lit("")))).otherwise(said), F.col("what"), F.col("at"))


def coverage(c: Context) -> DataFrame:
    """(rank, name, ...) of public symbols that no document names, the most reached first."""
    terms = text.words(repo.documents(c.files))
    public = c.symbols.where("visibility = 'public' AND kind <> 'module'")
    fan = match.fan_in(c.references).withColumnRenamed("to_symbol", "qualified_name")
    churned = history.churn(c.commits)
    new = history.never_documented(c.commits).withColumn("new", F.lit(1))
    gaps = history.coverage_gaps(public, terms).join(fan, "qualified_name", "left").join(churned, "path", "left").join(new, "path", "left")
    return history.ranked_gaps(gaps.withColumn("net_new", F.coalesce("new", F.lit(0))).withColumn("n_predicates", F.size("predicates")).withColumn("line_no", F.col("start")))


def gap_text(kind, name, fan_in, predicates, commits, net_new):
    """What is said of an undocumented symbol: what it is, how far it reaches, and whether its file is newer than the documents."""
    count = lambda n, one, many: F.when(n == 1, F.lit(f"1 {one}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))
    reach = F.concat_ws(", ", count(fan_in, "caller", "callers"), count(predicates, "branch", "branches"), count(commits, "commit", "commits"))
    lead = F.when(net_new == 1, "new and undocumented: ").otherwise("undocumented: ")
    return F.concat(lead, F.lit("public "), kind, F.lit(" `"), name, F.lit("`"), F.when(reach != "", F.concat(F.lit(" ("), reach, F.lit(")"))).otherwise(""))


def undocumented(c: Context) -> DataFrame:
    out = coverage(c).withColumn("verdict", F.lit("undocumented")).withColumn("doc_path", F.col("path"))
    zero = F.lit(0)
    detail = gap_text(F.col("kind"), F.col("name"), F.coalesce("fan_in", zero), F.col("n_predicates"), F.coalesce("commits", zero), F.col("net_new"))
    return findings(out, "coverage", F.concat_ws(" ", "kind", _code("name")), detail, anchors=F.array("qualified_name", "module"))


def coupling(c: Context) -> DataFrame:
    out = history.stale_documents(c.commits).withColumn("verdict", F.lit("stale"))
    return findings(out, "coupling", F.concat(F.lit("changes with "), _code("code")), F.concat(F.col("churn_after").cast("string"), F.lit(" later commits")), F.array("code"), F.col("doc"))


def prose(c: Context) -> DataFrame:
    """(claim_id, path, line_no, doc_path, text): what a judge may rule on."""
    found = text.claim_flags(text.logical_lines(c.docs)).where("candidate")
    ref = F.concat_ws(":", "doc_path", F.col("start_line").cast("string"))
    return cut(found.select(scalars.claim_id(ref, F.col("claim")).alias("claim_id"), F.col("doc_path").alias("path"), F.col("start_line").alias("line_no"), ref.alias("doc_path"), F.col("claim").alias("text")).dropDuplicates(["claim_id"]))


def proof(c: Context, claims: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """What the tokens of prose claims mean, and up to ``k`` bodies of code for each."""
    grounded = cut(evidence.ground(claims, c.symbols, c.modules))
    return grounded, cut(evidence.gather(claims, grounded, c.symbols, c.code.select("path", "text"), k))


def judged(c: Context, scorer: Callable[[DataFrame], DataFrame], cap: int = 300) -> DataFrame:
    """Findings of a caller's model over the first ``cap`` prose claims, anchored to what they name or else to the evidence's files."""
    claims = prose(c)
    grounded, code_ = proof(c, claims)
    told = retrieval.judge(claims, code_, scorer, cap)
    named = evidence.anchors(grounded).select("claim_id", F.concat("symbols", "modules").alias("named"))
    seen = code_.groupBy("claim_id").agg(F.array_sort(F.collect_set("path")).alias("seen"))
    out = told.join(claims.select("claim_id", "doc_path"), "claim_id").join(named, "claim_id", "left").join(seen, "claim_id", "left")
    surest = F.format_number(F.greatest("best_entail", "best_contra"), 2)
    detail = F.when(F.col("verdict") == "supported", "").otherwise(F.concat(F.lit("by model, confidence "), surest))
    return findings(out, "judge", F.col("text"), detail, F.coalesce("named", "seen", F.array().cast("array<string>")), F.col("doc_path"))


#: The checks of a run; each takes a Context and returns rows of FINDINGS. Others may be added.
CHECKS: dict[str, Callable[[Context], DataFrame]] = {f.__name__: f for f in (paths, commands, environment, flags, references, constants, graph, shapes, architecture)}
WHOLE: dict[str, Callable[[Context], DataFrame]] = {f.__name__: f for f in (undocumented, coupling)}


@dataclass
class Outcome:
    findings: DataFrame
    score: float
    modules: DataFrame
    total: int
    carried_forward: int
    regressed: bool

    @property
    def exit_code(self) -> int:
        return int(self.regressed or not self.findings.where("verdict <> 'supported'").isEmpty())


def check(
    spark: SparkSession,
    root: str,
    only: str | None = None,
    min_severity: str | None = None,
    base: str | None = None,
    save: bool = True,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    cap: int = 300,
) -> Outcome:
    """Runs the checks, scores what is left after suppression and severity, and carries the ledger forward.

    With a ``scorer``, which turns (claim_id, text, evidence) into (claim_id, contra,
    entail, neutral), prose claims are judged too.
    """
    own = os.path.join(root, ARTIFACTS)
    conf = repo.settings(os.path.join(root, "plumbline.toml"))
    c = Context(spark, root, only, tuple(conf.exclude))
    parts = [f(c) for f in (list(CHECKS.values()) + ([] if only else list(WHOLE.values())))]
    if scorer is not None:
        parts.append(judged(c, scorer, cap))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = drift.reportable(found, min_severity or conf.min_severity or "warning", tuple(conf.suppress))
    found = cut(found.withColumn("id", scalars.claim_id(F.col("doc_path"), F.col("claim"))))
    before = repo.ledger(spark, os.path.join(own, "ledger"))
    commit = repo.head(root)
    since = base or (before.agg(F.min_by("commit", "id")).first()[0])
    if since and commit:
        renamed, hunks = repo.changes(spark, root, since)
        body = c.symbols.select(F.col("qualified_name").alias("symbol"), "path", "start", "end")
        touched = match.touched_symbols(hunks, renamed.where("renamed_from IS NOT NULL"), body)
        names = c.symbols.join(touched.withColumnRenamed("symbol", "qualified_name"), "qualified_name", "left_semi").select(F.explode(F.array("qualified_name", "name", "module")).alias("name"))
        changed = names.union(renamed.select("path")).union(renamed.where("renamed_from IS NOT NULL").select("renamed_from"))
    else:
        changed = found.select(F.explode("anchors").alias("name"))  # without a base everything is looked at again
    facts = c.symbols.select(F.explode(F.array_distinct(F.array("qualified_name", "name"))).alias("anchor"), "constants", "signature", "predicates", "return_shape", F.struct("path", "idx").alias("pos"))
    merged = drift.merged_facts(found.select("id", F.explode("anchors").alias("anchor")).distinct().join(facts, "anchor"))
    hashes = merged.select("id", scalars.fact_fingerprint(F.col("constants"), F.col("signature"), F.col("predicates"), F.col("return_shape")).alias("facts_hash"))
    claims = drift.dirty(found.join(hashes, "id", "left"), before, changed)
    claims = cut(claims)
    moved = claims.where("dirty").join(before.select("id", F.col("facts_hash").alias("old")), "id").where("facts_hash <> old")
    flagged = moved.select(F.lit("unverifiable").alias("verdict"), "claim", "doc_path", F.lit("the code it tells of behaves otherwise now").alias("detail"), "anchors", F.lit("drift").alias("check"))
    score = drift.score(claims).first()["score"]
    placed = drift.claim_modules(claims, c.symbols)
    modules = drift.module_scores(placed)
    old_score = os.path.join(own, "score.json")
    regressed = False
    if os.path.exists(old_score):
        with open(old_score) as f:
            regressed = score + drift.TOLERANCE < json.load(f)["score"]
    if save and only is None:
        rows = drift.upsert(claims.withColumn("pos", F.monotonically_increasing_id())).select("id", F.col("doc_path").alias("doc_ref"), "anchors", "facts_hash", "verdict", F.lit(commit).alias("commit"))
        cut(rows).write.mode("overwrite").parquet(os.path.join(own, "ledger"))
        with open(old_score, "w") as f:
            json.dump({"score": score, "commit": commit}, f)
    counts = claims.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("dirty")).alias("kept")).first()
    return Outcome(claims.select(*FINDINGS).unionByName(flagged), score, modules, counts["n"], counts["kept"], regressed)


SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"


def _place(uri: str, line: int) -> dict:
    region, file = {"startLine": line}, {"uri": uri}
    return {"physicalLocation": {"region": region, "artifactLocation": file}}


def report(outcome: Outcome, kind: str = "text") -> str:
    """The outcome as text, json or sarif; findings are what a person reads, so they come to the driver."""
    if kind == "sarif":
        results = [
            {"level": r["level"], "ruleId": r["rule_id"], "locations": [_place(r["uri"], r["start_line"])], "message": {"text": r["message"]}}
            for r in drift.sarif_results(outcome.findings).orderBy("uri", "start_line", "message").collect()
        ]
        descriptors = [{"id": v} for v in drift.VERDICTS if v != "supported"]
        tool = {"driver": {"rules": descriptors, "name": "plumbline"}}
        return json.dumps(dict(zip(("$schema", "version", "runs"), (SARIF_SCHEMA, "2.1.0", [{"results": results, "tool": tool}]))), indent=2)
    rows = [r.asDict() for r in outcome.findings.where("verdict <> 'supported'").orderBy("doc_path", "claim").collect()]
    if kind == "json":
        return json.dumps({"findings": rows, "score": outcome.score, "modules": {r["module"]: r["score"] for r in outcome.modules.collect()}, "total_claims": outcome.total, "carried_forward": outcome.carried_forward, "regressed": outcome.regressed}, indent=2)
    body = [f"[{r['verdict']}] {r['doc_path']}: {r['claim']}" + (f" ({r['detail']})" if r["detail"] else "") for r in rows]
    return "\n".join([*body, f"{len(rows)} findings", f"alignment {outcome.score:.3f} over {outcome.total} claims"])


def audit(spark: SparkSession, root: str) -> DataFrame:
    """The status of each rule that the documents state; ``bare`` marks those without back quotes, told apart from the quoted ones."""
    c = Context(spark, root)
    told = cut(rules.extract_rules(c.lines))
    bare = rules.extract_bare_rules(c.lines, c.modules).select("kind", "a", "b").distinct()
    new = bare.join(told.select("kind", "a", "b").distinct(), ["kind", "a", "b"], "left_anti").withColumn("items", F.array().cast("array<string>"))
    quoted = rules.audit(told, c.edges, c.code_lines, c.symbols, c.references).withColumn("bare", F.lit(False))
    return quoted.unionByName(rules.audit(new, c.edges).withColumn("bare", F.lit(True)))


def rules_report(audited: DataFrame, kind: str = "text") -> str:
    """The audit as text, or as JSON, which stands for SARIF here too; with how many rules hold, are violated and are ungrounded."""
    rows = audited.orderBy("bare", "kind", "a", "b", "rule").collect()
    counts = {name: sum(r["status"] == name for r in rows) for name in ("Holds", "Violated", "Ungrounded")}
    if kind != "text":
        told = []
        for r in rows:
            detail = {"violations": r["n"]} if r["status"] == "Violated" else {"operand": r["operand"]} if r["status"] == "Ungrounded" else None
            told.append({"rule": r["rule"], "status": r["status"].lower(), "detail": detail, "experimental": r["bare"]})
        return json.dumps(told, indent=2, ensure_ascii=False)
    if not rows:
        return "no rules found; both operands of a rule stand in back quotes"
    body = [f"[{r['status']}] {r['rule']}" + (f" ({r['n']})" if r["n"] else "") + (f" no module: {r['operand']}" if r["operand"] else "") + " [bare]" * r["bare"] for r in rows]
    return "\n".join([*body, f"{counts['Holds']} hold, {counts['Violated']} violated, {counts['Ungrounded']} ungrounded"])
