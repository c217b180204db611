"""A small repository from files to findings, score, ledger and reports."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.operators import code
from plumbline.plans import repository
from plumbline.sources import repo

FILES = {
    "README.md": """# Demo

See `src/app.py` and `src/gone.py`.
The old `src/dead.py` was removed.
| `lib/a.py` | `src/app.py` |

Run `npm run build` or `npm run missing` or `make all -j 2`.

```sh
demo --dry-run --no-color --unknown
```

Set `APP_MODE` and $APP_GONE.
`timeout` defaults to 30 and `retries` = 9.
See `crate::app::start` and `crate::app::nowhere` now.
The `src/app` must not depend on `src/store`.
`src/store` must not depend on `src/app`.
Don't call `eval` outside `src/store`.

```mermaid
graph TD
  A[src/app] --> B[src/store]
  B --> A
  A --> C[src/ghost]
```

```mermaid
classDiagram
  class Store {
    +load()
    +fly()
  }
```

```mermaid
stateDiagram-v2
  [*] --> OPEN
  OPEN --> CLOSED
  CLOSED --> LOST
```

```mermaid
erDiagram
  USERS {
    int id
    string nick
  }
```

```mermaid
sequenceDiagram
  A->>B: load()
  B->>C: save()
  A->>C: close()
```
""",
    "CHANGELOG.md": "Removed `src/never.py`.\n",
    "docs/guide.md": "Read `app.py` in `src/app.py`; also `tool/run.sh`.\n",
    "node_modules/x/README.md": "`src/ignored.py`\n",
    "package.json": json.dumps({"name": "demo", "scripts": {"build": "x"}}),
    "Makefile": ".PHONY: all test\nall: build\n\techo hi\nX := 1\n",
    "src/app.py": '''"""The app."""
from src.store import Store
import os

timeout = 30
retries = 3


def start(dry_run, color):
    """Starts it."""
    s = Store()
    s.load()
    if dry_run:
        eval("1")
    s.save()
    s.close()
    return os.environ["APP_MODE"]


def _hidden():
    pass
''',
    "src/store.py": '''from enum import Enum


class Store:
    def load(self): return 1
    def save(self): return 2
    def close(self): return 3


class State(Enum):
    OPEN = 1
    CLOSED = 2
    HALF = 3
''',
    "db.sql": "CREATE TABLE IF NOT EXISTS public.users (\n  id INT PRIMARY KEY, price DECIMAL(10,2), CONSTRAINT c CHECK (id > 0));\n",
    "src/lib.rs": "use crate::util::go;\npub fn run(n: u32) -> u32 {\n    if n > 3 {\n        go(7)\n    }\n    n\n}\npub enum Kind {\n    Red,\n    Blue(u8),\n}\n",
    "src/util.rs": "pub fn go(x: u32) -> u32 { x }\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("demo")
    for name, body in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(body)
    git = lambda *a: subprocess.run(["git", "-C", str(base), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    return str(base)


@pytest.fixture(scope="module")
def outcome(spark, root):
    return repository.check(spark, root, min_severity="note")


@pytest.fixture(scope="module")
def told(outcome):
    return {(r["check"], r["claim"]): r["verdict"] for r in outcome.findings.collect()}


def test_paths(told):
    assert told["paths", "names path `src/app.py`"] == "supported"
    assert told["paths", "names path `src/gone.py`"] == "stale"
    assert told["paths", "names path `tool/run.sh`"] == "stale"
    assert not any("dead" in c or "never" in c or "lib/a" in c or "ignored" in c for _, c in told)


def test_hidden_and_underscored_files_exist(spark, tmp_path):
    named = ["src/pkg/__init__.py", "src/pkg/_util.py", ".github/workflows/ci.yml", "src/pkg/main.py"]
    for name in named:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("from ._util import x\n\n\ndef start(): pass\n")
    for folder in ("empty/inner", "node_modules/x", "target"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "target/app.js").write_text("x")
    (tmp_path / "bin.py").write_bytes(b"\xff\xfe")
    (tmp_path / "README.md").write_text("See " + ", ".join(f"`{n}`" for n in [*named, "target/app.js", "./bin.py", "x/bin.py"]) + ".\n")
    files = repo.files(spark, str(tmp_path))
    assert {r["path"] for r in repo.paths(files).collect()} >= {*named, "empty", "empty/inner", ".github"}
    assert not any(r["path"].startswith(("node_modules", "target")) for r in files.collect())
    c = repository.Context(spark, str(tmp_path))
    got = {r["claim"].split("`")[1]: r["verdict"] for r in repository.paths(c).collect()}
    assert got == {n: "supported" for n in [*named, "target/app.js", "./bin.py"]} | {"x/bin.py": "stale"}
    assert {r["path"] for r in c.symbols.collect()} == {"src/pkg/__init__.py", "src/pkg/_util.py", "src/pkg/main.py"}
    assert "src/pkg/__init__" in {r["module"] for r in c.symbols.collect()}
    assert repository.check(spark, str(tmp_path), "README.md", min_severity="error", save=False).findings.where("verdict <> 'supported'").count() == 1


def test_labelled_state_diagrams_are_no_sequences(spark, tmp_path):
    (tmp_path / "app.py").write_text("def run():\n    boot()\n    start()\n    stop()\n\n\ndef boot(): pass\n\n\ndef start(): pass\n\n\ndef stop(): pass\n")
    (tmp_path / "README.md").write_text("`run`\n```mermaid\nstateDiagram-v2\n  Idle --> Ready : boot\n  Ready --> Running : start\n  Running --> Idle : stop\n```\n")
    c = repository.Context(spark, str(tmp_path))
    assert repository.shapes(c).count() == 0
    (tmp_path / "README.md").write_text("```mermaid\nsequenceDiagram\n  A->>B: boot()\n  A->>B: start()\n  A->>B: stop()\n```\n")
    assert [r["verdict"] for r in repository.shapes(repository.Context(spark, str(tmp_path))).collect()] == ["supported"] * 3


def test_judge_in_a_check(spark, tmp_path):
    (tmp_path / "app.py").write_text("def run_jobs(jobs):\n    return sorted(jobs)\n")
    (tmp_path / "README.md").write_text("The `run_jobs` function sorts all of its jobs.\n\nThe `run_jobs` function deletes all of its jobs.\n\nThe `nowhere` thing is not found in any code.\n")
    scorer = lambda p: p.select("claim_id", F.when(F.col("text").contains("deletes"), 0.9).otherwise(0.0).alias("contra"), F.when(F.col("text").contains("sorts"), 0.9).otherwise(0.0).alias("entail"), F.lit(0.1).alias("neutral"))
    out = repository.check(spark, str(tmp_path), min_severity="note", save=False, scorer=scorer)
    got = {r["claim"].split()[3]: (r["verdict"], r["anchors"]) for r in out.findings.where("check = 'judge'").collect()}
    assert got == {"sorts": ("supported", ["app::run_jobs"]), "deletes": ("contradicted", ["app::run_jobs"]), "is": ("unverifiable", [])}


def test_commands_flags_and_variables(told):
    assert told["commands", "runs `npm run build`"] == "supported"
    assert told["commands", "runs `npm run missing`"] == "stale"
    assert told["commands", "runs `make all -j 2`"] == "supported"
    assert told["flags", "names flag `--dry-run`"] == "supported"
    assert told["flags", "names flag `--no-color`"] == "supported"
    assert told["flags", "names flag `--unknown`"] == "stale"
    assert told["environment", "names variable `APP_MODE`"] == "supported"
    assert told["environment", "names variable `APP_GONE`"] == "stale"


def test_constants_and_references(told):
    assert told["constants", "`timeout` is 30"] == "supported"
    assert told["constants", "`retries` is 9"] == "contradicted"
    assert told["references", "refers to `crate::app::start`"] == "supported"
    assert told["references", "refers to `crate::app::nowhere`"] == "stale"


def test_rules(told):
    assert told["rules", "forbid_edge src/app src/store"] == "contradicted"
    assert told["rules", "forbid_edge src/store src/app"] == "supported"
    assert told["rules", "forbid_symbol eval except src/store"] == "contradicted"


def test_clean_rules_and_reports(spark, tmp_path):
    (tmp_path / "app.py").write_text("import lib\n\n\ndef start():\n    return lib.go()\n")
    (tmp_path / "lib.py").write_text("def go():\n    return eval('1')\n")
    (tmp_path / "README.md").write_text("Never use `eval` outside `lib`.\n\nNever call `exec`.\n\n`lib` must not transitively reach `app`.\n\nThe app module must not import the lib module.\n")
    c = repository.Context(spark, str(tmp_path))
    got = {r["claim"]: (r["verdict"], r["anchors"]) for r in repository.architecture(c).collect()}
    assert got == {"forbid_symbol eval except lib": ("supported", ["app"]), "forbid_symbol exec": ("supported", ["app", "lib"]), "forbid_reach lib app": ("supported", ["lib", "app"])}
    audited = repository.audit(spark, str(tmp_path))
    rows = json.loads(repository.rules_report(audited, "sarif"))
    assert {(r["rule"], r["status"], r["experimental"]) for r in rows} == {
        ("forbid symbol `eval` (except `lib`)", "holds", False), ("forbid symbol `exec`", "holds", False), ("`lib` ✗⇢ `app` (transitive)", "holds", False), ("`app` ✗→ `lib`", "violated", True),
    }
    assert repository.rules_report(audited).endswith("3 hold, 1 violated, 0 ungrounded")


def test_diagrams(told):
    assert told["diagrams", "draws `src/app` -> `src/store`"] == "supported"
    assert told["diagrams", "draws `src/store` -> `src/app`"] == "contradicted"
    assert told["diagrams", "draws `src/ghost`"] == "stale"
    assert told["shapes", "Store"] == "supported" and told["shapes", "Store.load"] == "supported" and told["shapes", "Store.fly"] == "stale"
    assert told["shapes", "USERS.id"] == "supported" and told["shapes", "USERS.nick"] == "stale"
    assert told["shapes", "src/store::State.OPEN"] == "supported" and told["shapes", "src/store::State.LOST"] == "stale" and told["shapes", "src/store::State.HALF"] == "undocumented"
    steps = {c: v for (k, c), v in told.items() if k == "sequences"}
    assert steps["step 1 Store"] == "undocumented" and steps["step 2 load"] == "supported"


def test_coverage(told, outcome, spark, root):
    missing = {c for (k, c), v in told.items() if k == "coverage"}
    assert {r["detail"] for r in outcome.findings.where("check = 'coverage' AND claim = 'function `go`'").collect()} == {"undocumented: public function `go` (1 caller, 1 commit)"}
    assert "function `go`" in missing and "function `start`" not in missing and not any("_hidden" in c for c in missing)
    rows = repository.coverage(repository.Context(spark, root)).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_reports(outcome):
    sarif = json.loads(repository.report(outcome, "sarif"))
    assert sarif["version"] == "2.1.0"
    assert {r["ruleId"] for r in sarif["runs"][0]["results"]} >= {"stale", "contradicted", "undocumented"}
    data = json.loads(repository.report(outcome, "json"))
    assert 0 < data["score"] < 1 and data["total_claims"] == outcome.total
    assert "alignment" in repository.report(outcome) and outcome.exit_code == 1


def test_second_run_carries_claims_forward(spark, root, outcome):
    again = repository.check(spark, root, min_severity="note", save=False)
    assert again.score == outcome.score and not again.regressed
    assert again.carried_forward > 0


def test_settings(tmp_path):
    assert repo.settings(str(tmp_path / "none.toml")) == repo.Settings()
    (tmp_path / "a.toml").write_text('exclude = ["docs/**"]\n')
    assert repo.settings(str(tmp_path / "a.toml")).exclude == ["docs/**"]
    (tmp_path / "b.toml").write_text("other = 1\n")
    with pytest.raises(TypeError):
        repo.settings(str(tmp_path / "b.toml"))


def test_sources(spark, root):
    files = repo.files(spark, root)
    assert {r["doc_path"] for r in repo.documents(files).collect()} == {"README.md", "docs/guide.md"}
    assert {(r["name"]) for r in repo.make_targets(repo.manifest_files(files)).collect()} == {".PHONY", "all", "test"}
    assert [tuple(r)[:2] for r in repo.sql_schema(files).orderBy("pos").collect()] == [("users", "id"), ("users", "price")]
    assert {r["path"] for r in repo.commit_files(spark, root).collect()} >= {"README.md", "src/app.py"}


def test_nearest_manifest(spark):
    docs = spark.createDataFrame([("a/b/x.md",), ("y.md",)], "doc_path string")
    dirs = spark.createDataFrame([("a", "npm"), ("", "npm"), ("a/b", "make")], "dir string, kind string")
    got = {(r["doc_path"], r["kind"]): r["dir"] for r in repo.nearest(docs, dirs).collect()}
    assert got == {("a/b/x.md", "npm"): "a", ("a/b/x.md", "make"): "a/b", ("y.md", "npm"): ""}


def test_symbols_of_braced_languages(spark):
    texts = spark.createDataFrame([("src/lib.rs", "src/lib", "rust", FILES["src/lib.rs"]), ("A.java", "A", "java", "public class A {\n  private int go(int x) {\n    return help(x, 4);\n  }\n}\n"), ("m.ts", "m", "typescript", "export function f(a) {\n  g(1);\n}\nconst h = 2;\n")], "path string, module string, language string, text string")
    got = {r["qualified_name"]: r for r in code.symbols(texts).collect()}
    run = got["src/lib::run"]
    assert (run["kind"], run["visibility"], run["start"], run["end"], run["return_shape"], run["calls"]) == ("function", "public", 2, 7, "u32", ["go"])
    assert run["constants"] == ["3", "7"] and run["predicates"] == ["n > 3"]
    assert got["src/lib::Kind"]["members"] == ["Red", "Blue"]
    assert got["A::go"]["kind"] == "method" and got["A::go"]["visibility"] == "private" and got["A::go"]["calls"] == ["help"]
    assert got["m::f"]["visibility"] == "public" and got["m::h"]["visibility"] == "internal"


def test_components_conditions_and_long_imports(spark):
    tsx = "import {\n  A,\n} from './a';\nexport function Page(p) {\n  const x = p.ok ? load(p) : null;\n  switch (x.kind) {\n    case 1: return <div><Login id={go()}/></div>;\n  }\n  while (more(x)) { step(x); }\n  if (x > 1) return <Route.Item/>;\n}\n"
    rust = "use crate::util::{\n    go,\n    stop,\n};\npub fn run(n: u32) {\n    match n {\n        1 => go(),\n        _ => stop(),\n    }\n    while n > 2 {\n        go();\n    }\n}\n"
    texts = spark.createDataFrame([("p.tsx", "src/p", "tsx", tsx), ("src/r.rs", "src/r", "rust", rust), ("q.py", "pkg/q", "python", "import os, pkg.n as m\nfrom pkg.k import (\n    a,\n)\nif a: pass\n")], "path string, module string, language string, text string")
    got = {r["qualified_name"]: r for r in code.symbols(texts).collect()}
    assert got["src/p::Page"]["calls"] == ["load", "Login", "go", "more", "step"]
    assert got["src/p::Page"]["predicates"] == ["more(x)", "p.ok", "x > 1", "x.kind"]
    assert got["src/r::run"]["predicates"] == ["n", "n > 2"]
    found = {(r["from_module"], r["raw"]) for r in code.imports(texts).collect()}
    assert found == {("src/p", "./a"), ("src/r", "crate::util::{ go, stop, }"), ("pkg/q", "os"), ("pkg/q", "pkg.n"), ("pkg/q", "pkg.k")}
    edges = code.module_edges(code.imports(texts), spark.createDataFrame([(m,) for m in ("src/a", "src/util", "pkg/n", "pkg/k")], "module string")).collect()
    assert {tuple(r) for r in edges} == {("src/p", "src/a"), ("src/r", "src/util"), ("pkg/q", "pkg/n"), ("pkg/q", "pkg/k")}


@pytest.mark.parametrize(
    ("language", "module", "raw", "modules", "want"),
    [
        ("rust", "src/a/b", "crate::x::Y", ["src/x"], "src/x"),
        ("rust", "src/a/b", "super::c::Z", ["src/a/c", "src/c"], "src/a/c"),
        ("rust", "src/a/b", "c::Z", ["src/a/c", "src/c"], "src/a/c"),
        ("python", "pkg/m", "pkg.n.f", ["pkg/n"], "pkg/n"),
        ("python", "pkg/m", ".n", ["pkg/n"], "pkg/n"),
        ("typescript", "web/ui/a", "../lib/b.js", ["web/lib/b"], "web/lib/b"),
        ("typescript", "web/ui/a", "react", ["react"], None),
        ("java", "com/a/B", "com.c.D", ["com/c/D"], "com/c/D"),
    ],
)
def test_import_resolution(spark, language, module, raw, modules, want):
    edges = spark.createDataFrame([(module, language, raw)], "from_module string, language string, raw string")
    got = code.module_edges(edges, spark.createDataFrame([(m,) for m in modules], "module string")).collect()
    assert [r["dst"] for r in got] == ([want] if want else [])


def test_diff(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +2,3 @@ f\n@@ -9,2 +12,0 @@\n@@ -20 +30 @@\ndiff --git a/old b/new\nrename from old\nrename to new"
    files, ranges = repo.parse_diff(spark.createDataFrame([(7, *x) for x in enumerate(text.split("\n"))], "diff int, pos int, line string"))
    assert {tuple(r) for r in files.collect()} == {(7, "x.py", None), (7, "new", "old")}
    assert {tuple(r) for r in ranges.collect()} == {(7, "x.py", 2, 4), (7, "x.py", 30, 30)}


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('// note\n\n{"a": 1}\n{"a": 2}\n')
    assert repo.json_lines(spark, str(tmp_path / "c.jsonl"), "a int").agg(F.sum("a")).first()[0] == 3
