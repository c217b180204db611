"""Command line: ``python -m plumbline check|index|rules|coverage|retrieve|setup ROOT``."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evidence, retrieval
from plumbline.plans import repository


def load(name: str) -> Callable[[DataFrame], DataFrame]:
    """The function ``module:function``; a ValueError if there is none."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no scorer {name}: {e}") from e


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("plumbline")
    p.add_argument("command", choices=["check", "index", "rules", "coverage", "retrieve", "setup"])
    p.add_argument("root")
    p.add_argument("--format", choices=["text", "json", "sarif"], default="text")
    p.add_argument("--doc")
    p.add_argument("--diff", metavar="BASE")
    p.add_argument("--min-severity", choices=["note", "warning", "error"])
    p.add_argument("--layer", type=int, choices=[1, 2, 3], default=1, help="3 has prose judged by --scorer")
    p.add_argument("--scorer", metavar="MODULE:FUNCTION")
    p.add_argument("--cap", type=int, default=300, help="prose claims that are judged; 0 for all")
    p.add_argument("--query", default="")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    try:
        if a.layer == 3 and not a.scorer:
            raise ValueError("--layer 3 takes a --scorer")
        scorer = load(a.scorer) if a.scorer else None
        if a.command == "setup":
            # Models are the caller's: what can be made ready is that their function loads.
            print(f"scorer {a.scorer} is ready" if scorer else "no model is needed without --scorer")
            return 0
        if a.command == "check":
            out = repository.check(spark, a.root, a.doc, a.min_severity, a.diff, scorer=scorer if a.layer == 3 else None, cap=a.cap)
            print(repository.report(out, a.format))
            return out.exit_code
        c = repository.Context(spark, a.root)
        if a.command == "index":
            for table in (c.symbols.orderBy("path", "idx"), c.edges.orderBy("src", "dst"), c.references.orderBy("from_symbol", "to_symbol")):
                print(*table.toJSON().toLocalIterator(), sep="\n")
            return 0
        if a.command == "rules":
            audited = repository.audit(spark, a.root)
            print(repository.rules_report(audited, a.format))
            return int(not audited.where("status = 'Violated'").isEmpty())
        if a.command == "coverage":
            rows = repository.coverage(c).orderBy("rank").collect()
            print(*(f"{r['rank']} {r['kind']} {r['qualified_name']} reach {r['reach']}" for r in rows), sep="\n")
            return int(bool(rows))
        entries = evidence.lexicon(c.symbols.withColumn("visibility", F.lit("public")))
        asked = spark.createDataFrame([(0, a.query)], "query_id int, q string").select("query_id", retrieval.subwords(F.col("q")).alias("tokens"))
        found = retrieval.lexical(asked, entries, 10).select("rank", "score", "id.*").join(c.symbols.select("path", "idx", "start"), ["path", "idx"])
        print(*(f"{r['score']:.3f} {r['path']}:{r['start']}" for r in found.orderBy("rank").collect()), sep="\n")
        return 0
    except (TypeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
