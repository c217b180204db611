"""Repositories as tables: files, documents, code, manifests, schemas, history, diffs, settings and the ledger."""

from __future__ import annotations

import os
import re
import subprocess
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.storage import filesystem, is_folder

SKIPPED = tuple(".cache .git .gradle .mypy_cache .next .plumbline .pytest_cache .venv __pycache__ build dist node_modules out target vendor venv".split())
LARGEST = 2 * 1024 * 1024
CODE = tuple("c cc cjs cpp cs go h hpp java js jsx kt mjs php py rb rs scala sh swift toml ts tsx yaml yml".split())
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "java": "java"}
_LOGS = tuple("changelog.markdown changelog.md changes.md history.md news.md release-notes.md release_notes.md releases.md whatsnew.md".split())
_LOG_DIRS = ("changelog", "changelog.d", "changes", "news.d", "newsfragments")
HISTORY = 1000
#: Characters of files that are handed on at once.
HELD = 1 << 23


def _extension(path: Column) -> Column:
    return F.when(F.element_at(F.split(path, "/"), -1).contains("."), F.lower(F.element_at(F.split(path, r"\."), -1))).otherwise("")


LISTING = "path string, size long, folder boolean, uri string"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size, folder, uri) of all files and folders outside skipped folders, hidden ones too.

    ``root`` is a local folder or a URI of any file system that Arrow reads. The driver
    lists the folders; contents are read by the executors, and only of files that a
    table needs.
    """
    at, top = filesystem(root)
    top, rows, todo = top.rstrip("/"), [], [top.rstrip("/")]
    while todo:
        for f in at.get_file_info(fs.FileSelector(todo.pop())):
            if f.base_name in SKIPPED:
                continue
            if f.type in (fs.FileType.File, fs.FileType.Directory):
                is_folder = f.type == fs.FileType.Directory
                rows.append((f.path[len(top) + 1 :], 0 if is_folder else f.size, is_folder, f.path))
                if is_folder:
                    todo.append(f.path)
    return spark.createDataFrame(sorted(rows), LISTING).withColumn("root", F.lit(root))


def paths(all_files: DataFrame) -> DataFrame:
    """(path) of every file and every folder, empty ones too."""
    return all_files.select("path")


def on_disk(claimed: DataFrame, root: str) -> DataFrame:
    """(path) of those of the claimed paths (raw) that lie under the root as they are written, in skipped folders too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top = filesystem(root)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            found = at.get_file_info([f"{top.rstrip('/')}/{r.removeprefix('./').rstrip('/')}" for r in raw]) if raw else []
            yield pa.RecordBatch.from_arrays([pa.array([r.removeprefix("./").rstrip("/") for r, f in zip(raw, found) if f.type != fs.FileType.NotFound], pa.string())], ["path"])

    return claimed.select("raw").distinct().mapInArrow(run, "path string")


def _read(wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, uri, root, ...) with ``text`` in place of the last two; files that are no UTF-8 or can't be read are left out."""
    names = [c for c in wanted.columns if c not in ("uri", "root", "size", "folder")]
    schema = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in names) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            texts: list[str] = []
            held = 0

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int32())) for c in names), pa.array(texts, pa.string())], [*names, "text"])

            for i, (uri, root) in enumerate(zip(batch.column("uri").to_pylist(), batch.column("root").to_pylist())):
                try:
                    with filesystem(root)[0].open_input_stream(uri) as f:
                        text = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    continue
                at.append(i)
                texts.append(text)
                held += len(text)
                if held > HELD:
                    yield rows()
                    at, texts, held = [], [], 0
            yield rows()

    return wanted.where("NOT folder").select(*names, "uri", "root").mapInArrow(run, schema)


def is_changelog(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.element_at(parts, -1).isin(*_LOGS) | F.arrays_overlap(parts, F.array(*map(F.lit, _LOG_DIRS)))


def documents(all_files: DataFrame, only: str | None = None) -> DataFrame:
    """(doc_path, text) of Markdown files up to 2 MiB that aren't change logs; ``only`` keeps paths that end with it."""
    out = all_files.where(_extension(F.col("path")).isin("md", "markdown") & (F.col("size") <= LARGEST) & ~is_changelog(F.col("path")))
    if only:
        out = out.where(F.col("path").endswith(only))
    return _read(out).withColumnRenamed("path", "doc_path")


def language_of(path: Column) -> Column:
    """The language of a code file by its extension; null where it isn't parsed."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), _extension(path))


def module_of(path: Column) -> Column:
    """A file's path without its extension."""
    return F.regexp_replace(path, r"\.[^./]+$", "")


def is_code(path: Column, size: Column) -> Column:
    return _extension(path).isin(*CODE) & (size <= LARGEST)


def code(all_files: DataFrame) -> DataFrame:
    """(path, module, language, text) of code files; the language is null where it isn't parsed."""
    path = F.col("path")
    return _read(all_files.where(is_code(path, F.col("size"))).withColumns({"module": module_of(path), "language": language_of(path)}))


def dot_files(all_files: DataFrame) -> DataFrame:
    return _read(all_files.where(_extension(F.col("path")).isin("dot", "gv") & (F.col("size") <= LARGEST))).withColumnRenamed("path", "doc_path")


MANIFESTS = ("Cargo.toml", "GNUmakefile", "Makefile", "makefile", "package.json")


def manifest_files(all_files: DataFrame) -> DataFrame:
    """(path, text) of the files that declare commands."""
    return _read(all_files.where(F.element_at(F.split("path", "/"), -1).isin(*MANIFESTS)))


def _named(texts: DataFrame, *names: str) -> DataFrame:
    base = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace(F.regexp_replace("path", "[^/]+$", ""), "/$", "")
    return texts.select("path", "text", folder.alias("dir"), base.alias("base")).where(F.col("base").isin(*names))


def npm_manifests(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dir, kind, name) of scripts, and (dir, name) of binaries, in the package.json files (path, text) that parse."""
    found = _named(texts, "package.json").withColumn("j", F.try_parse_json("text")).where("j IS NOT NULL")
    scripts = found.select("dir", F.lit("npm").alias("kind"), F.explode(F.json_object_keys(F.get_json_object("text", "$.scripts"))).alias("name"))
    bin_, name = F.get_json_object("text", "$.bin"), F.get_json_object("text", "$.name")
    keys = F.json_object_keys(bin_)
    bins = found.select("dir", F.explode(F.when(keys.isNotNull(), keys).when(name.isNotNull(), F.array(name))).alias("name"))
    return scripts, bins


def make_targets(texts: DataFrame) -> DataFrame:
    """(dir, kind, name) of the targets of each folder's Makefile (path, text), and of what .PHONY lists."""
    rank = F.array_position(F.array(F.lit("Makefile"), F.lit("makefile"), F.lit("GNUmakefile")), F.col("base"))
    first = _named(texts, "Makefile", "makefile", "GNUmakefile").groupBy("dir").agg(F.min_by("text", rank).alias("text"))
    rule = r"^([-_./% 0-9A-Za-z]+):(?:$|[^=])(.*)$"
    rows = first.select("dir", F.explode(F.split("text", "\r?\n")).alias("line")).where(F.col("line").rlike(rule))
    names = F.split(F.trim(F.regexp_extract("line", rule, 1)), r"\s+")
    more = F.when(names[0] == ".PHONY", F.split(F.trim(F.regexp_extract("line", rule, 2)), r"\s+")).otherwise(F.array().cast("array<string>"))
    return rows.select("dir", F.lit("make").alias("kind"), F.explode(F.concat(names, more)).alias("name")).where("name <> ''").distinct()


def cargo_bins(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """(dir, kind, name): the [[bin]] names of Cargo.toml files (path, text), the package where there is src/main.rs, and the stems of src/bin."""
    line = F.trim("line")
    # The section of a line is that of the last heading up to it, counted inside the file's own row.
    parts = F.split("text", r"(?m)^(?=[ \t]*\[)")
    each = _named(texts, "Cargo.toml").select("dir", F.explode(parts).alias("part")).select("dir", F.ltrim("part").alias("part"))
    section = F.when(F.col("part").startswith("[[bin]]"), "bin").when(F.col("part").startswith("[package]"), "package")
    named = each.select("dir", section.alias("section"), F.explode(F.split("part", "\r?\n")).alias("line")).where("section IS NOT NULL")
    named = named.withColumn("name", F.regexp_extract(line, r'^name\s*=\s*"([^"]*)"', 1)).where("name <> ''")
    main, stem = F.col("path").rlike("(^|/)src/main[.]rs$"), F.col("path").rlike("(^|/)src/bin/[^/]+[.]rs$")
    mains = paths.where(main).select(F.regexp_replace(F.regexp_replace("path", "(^|/)src/main[.]rs$", ""), "/$", "").alias("dir")).distinct()
    stems = paths.where(stem).select(F.regexp_replace("path", "/?src/bin/[^/]+$", "").alias("dir"), F.regexp_extract("path", "([^/]+)[.]rs$", 1).alias("name"))
    found = named.where("section = 'bin'").select("dir", "name").union(named.where("section = 'package'").join(mains, "dir", "left_semi").select("dir", "name")).union(stems)
    return found.select("dir", F.lit("cargo").alias("kind"), "name").distinct()


def nearest(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """(doc_path, kind, dir): for each kind of manifest (dir, kind) the closest folder above the document that has one."""
    parts = F.split("doc_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    up = docs.select("doc_path", F.explode(above).alias("u")).select("doc_path", "u.depth", "u.dir")
    return up.join(manifests.select("dir", "kind").distinct(), "dir").groupBy("doc_path", "kind").agg(F.max_by("dir", "depth").alias("dir"))


_CONSTRAINTS = {"check", "constraint", "foreign", "index", "key", "primary", "unique"}


def _identifier(raw: str) -> str:
    return raw.strip().strip("`\"'[]").rsplit(".", 1)[-1].strip("`\"'[]").lower()


def parse_ddl(text: str) -> list[tuple[str, list[str]]]:
    """(table, columns) of each CREATE TABLE; parentheses nest, so this is no regular language."""
    out = []
    for m in re.finditer(r"create\s+table", text, re.I):
        start = text.find("(", m.end())
        if start < 0:
            break
        words = [w for w in text[m.end() : start].split() if w.lower() not in ("if", "not", "exists")]
        depth, parts, last = 0, [], start + 1
        for i in range(start, len(text)):
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            if (text[i] == "," and depth == 1) or depth == 0:
                parts.append(text[last:i])
                last = i + 1
            if depth == 0:
                break
        columns = [c for p in parts if p.split() and (c := _identifier(p.split()[0])) and c not in _CONSTRAINTS]
        if words and _identifier(words[-1]):
            out.append((_identifier(words[-1]), columns))
    return out


def ddl_tables(texts: DataFrame) -> DataFrame:
    """(name, column, pos) of the tables that the texts (text) create."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, c, i) for t in batch.column(0).to_pylist() if t for n, cs in parse_ddl(t) for i, c in enumerate(cs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["name", "column", "pos"])

    return texts.select("text").mapInArrow(run, "name string, column string, pos int")


def sql_schema(all_files: DataFrame) -> DataFrame:
    return ddl_tables(_read(all_files.where(_extension(F.col("path")) == "sql")).select("text"))


def _git(root: str, *args: str) -> str | None:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout if run.returncode == 0 else None


def head(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def commit_files(spark: SparkSession, root: str, depth: int = HISTORY) -> DataFrame:
    """(commit_idx, path), the newest commit 0; empty without a repository. git itself runs once, on the driver."""
    log = _git(root, "log", f"-{depth}", "--name-only", "--no-renames", "--pretty=format:%x1e") or ""
    rows = [(i, p) for i, c in enumerate(log.split("\x1e")[1:]) for p in dict.fromkeys(c.split("\n")) if p.strip()]
    return spark.createDataFrame(rows, "commit_idx int, path string")


def parse_diff(diff_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(diff, path, renamed_from) and (diff, path, lo, hi) of diffs without context, given as (diff, pos, line)."""
    line = F.col("line")
    w = Window.partitionBy("diff").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = diff_lines.withColumn("file", F.sum(line.startswith("diff --git ").cast("int")).over(w)).where("file > 0")
    new = F.when(line.startswith("rename to "), F.substring(line, 11, 1 << 20)).when(line.startswith("+++ b/"), F.substring(line, 7, 1 << 20))
    first = F.when(line.startswith("diff --git "), F.regexp_extract(line, r" b/(.*)$", 1))
    named = n.groupBy("diff", "file").agg(F.coalesce(F.max_by(new, F.when(new.isNotNull(), F.col("pos"))), F.max(first)).alias("path"), F.max(F.when(line.startswith("rename from "), F.substring(line, 13, 1 << 20))).alias("renamed_from")).where("path <> ''")
    hunk = r"^@@[^+]*\+(\d+)(?:,(\d+))?"
    cut = n.where(line.rlike(hunk)).select("diff", "file", F.regexp_extract(line, hunk, 1).cast("int").alias("lo"), F.regexp_extract(line, hunk, 2).alias("len"))
    size = F.when(F.col("len") == "", 1).otherwise(F.expr("try_cast(len AS INT)"))
    ranges = cut.withColumn("size", size).where("size > 0").join(named.select("diff", "file", "path"), ["diff", "file"]).select("diff", "path", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))
    return named.select("diff", "path", "renamed_from"), ranges


def changes(spark: SparkSession, root: str, base: str) -> tuple[DataFrame, DataFrame]:
    text = _git(root, "diff", "--no-color", "--find-renames", "--unified=0", base, "--") or ""
    return parse_diff(spark.createDataFrame([(0, *x) for x in enumerate(text.split("\n"))], "diff int, pos int, line string"))


@dataclass
class Settings:
    exclude: list[str] = field(default_factory=list)
    suppress: list[str] = field(default_factory=list)
    min_severity: str | None = None


def settings(path: str) -> Settings:
    """Settings from TOML; the defaults where the file is missing; an error for an unknown key or what doesn't parse."""
    if not os.path.exists(path):
        return Settings()
    with open(path, "rb") as f:
        return Settings(**tomllib.load(f))


LEDGER = "id string, doc_ref string, anchors array<string>, facts_hash string, verdict string, commit string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table at ``path``, a folder or URI; empty where there is none."""
    if is_folder(path):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A labelled corpus: one JSON object a line, blank lines and // comments left out."""
    rows = spark.read.text(path).where("trim(value) <> '' AND NOT trim(value) LIKE '//%'")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")
