"""Evidence for prose claims: the code that their tokens name, the code of the modules they name, or the nearest by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import TICK
from plumbline.operators.lineage import cut
from plumbline.operators.match import modules_of, top_level
from plumbline.operators.retrieval import CHUNK_LINES, CHUNK_STEP, LEAST_LEXICAL, SIGN, lexical, subwords
from plumbline.operators.rules import ends

#: Lines that are read of a symbol's body.
BODY_LINES = 50
#: Symbols with more lines are cut into windows.
LONGEST_SYMBOL = 80
#: Scores of symbols that a claim names, and of those in modules it names.
NAMED, IN_MODULE = 3.0, 2.0

_NO_LIBRARY = "__tests__ bench benchmark benchmarks e2e example examples fixtures test testing tests".split()
_TEST_FILE = r"(?:^|/)(?:test_[^/]*|conftest[^/]*|[^/]*(?:_test\.(?:py|go|rs)|\.(?:test|spec)\.(?:ts|js)))$"


def is_library(path: Column) -> Column:
    """Whether a file is neither test, benchmark nor example, by its folders and its name."""
    low = F.lower(path)
    return ~(low.rlike(rf"(?:^|/)(?:{'|'.join(_NO_LIBRARY)})/") | low.rlike(_TEST_FILE))


def quoted_tokens(claims: DataFrame) -> DataFrame:
    """(claim_id, pos, token) of the back-quoted parts of claims (claim_id, text)."""
    return claims.select("claim_id", F.posexplode(F.regexp_extract_all("text", F.lit(TICK), 1)).alias("pos", "token"))


def resolve_tokens(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(token, qualified_name) of distinct tokens: the first symbol, by path and place in it, of that name.

    A token means a symbol by its name, its qualified name, or the end of that from a
    ``::`` on. Each of these is a join key, so there is one hash join.
    """
    keys = F.array_union(ends(F.col("qualified_name")), F.array("name"))
    held = symbols.select(F.explode(keys).alias("token"), F.struct("path", "idx", "qualified_name").alias("s"))
    return tokens.select("token").distinct().join(held, "token").groupBy("token").agg(F.min("s").alias("s")).select("token", "s.qualified_name")


def fallback_modules(tokens: DataFrame, modules: DataFrame) -> DataFrame:
    """(token, module) of distinct tokens: the least module that the token means."""
    return modules_of(tokens.select("token").distinct(), modules, "token").groupBy("token").agg(F.min("module").alias("module"))


def ground(claims: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(claim_id, pos, token, qualified_name, module): what each back-quoted token of a claim (claim_id, text) means.

    A symbol (qualified_name, name, path, idx) is preferred, else a module; a token that
    means neither gives no row.
    """
    tokens = quoted_tokens(claims)
    once = cut(tokens.select("token").distinct())
    by_symbol = cut(resolve_tokens(once, symbols))
    by_module = fallback_modules(once.join(by_symbol, "token", "left_anti"), modules)
    none = F.lit(None).cast("string")
    means = by_symbol.withColumn("module", none).unionByName(by_module.withColumn("qualified_name", none))
    # A token has one meaning, but may be in any number of claims: these are not sorted.
    return tokens.join(means.hint("shuffle_hash"), "token").select("claim_id", "pos", "token", "qualified_name", "module")


def anchors(grounded: DataFrame) -> DataFrame:
    """(claim_id, symbols, modules): the distinct anchors of each grounded claim."""
    return grounded.groupBy("claim_id").agg(F.array_sort(F.collect_set("qualified_name")).alias("symbols"), F.array_sort(F.collect_set("module")).alias("modules"))


def bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols (path, start, end, ...) with ``body``: up to BODY_LINES of the file's (path, text) lines; blank ones are left out."""
    # A file's text is split once, not for each of its symbols.
    of_file = symbols.groupBy("path").agg(F.collect_list(F.struct(*[c for c in symbols.columns if c != "path"])).alias("s"))
    each = of_file.join(files.where("text IS NOT NULL").select("path", F.split("text", "\r?\n", -1).alias("lines")), "path")

    def body(s: Column) -> Column:
        first = F.greatest(s["start"], F.lit(1))
        last = F.least(s["end"], F.size("lines"), first + BODY_LINES - 1)
        return F.when((s["start"] > 0) & (last >= first), F.array_join(F.slice("lines", first, F.greatest(last - first + 1, F.lit(0))), "\n"))

    out = each.select("path", F.explode(F.transform("s", lambda s: F.struct(s.alias("s"), body(s).alias("body")))).alias("e"))
    return out.select("path", "e.s.*", "e.body").where(r"body RLIKE '\\S'")


def lexicon(symbols: DataFrame) -> DataFrame:
    """(id, tokens, names) of the public symbols: all words they are known by, and those of their names."""
    said = [F.coalesce(c, F.lit("")) for c in ("name", "qualified_name", "module", "signature", "doc")]
    public = symbols.where("visibility = 'public'")
    return public.select(F.struct("path", "idx").alias("id"), subwords(F.concat_ws(" ", *said)).alias("tokens"), subwords(F.col("name")).alias("names"))


def gather(claims: DataFrame, grounded: DataFrame, symbols: DataFrame, files: DataFrame, k: int = 5, least: float = LEAST_LEXICAL) -> DataFrame:
    """(claim_id, rank, path, start_line, score, text): up to ``k`` bodies of code for each claim (claim_id, text), the best first.

    First the symbols that the claim's tokens mean, then up to ``k`` public symbols of
    each module they mean; the nearest by words only for claims that have neither.
    A body counts once for each claim, under its best score; of equal scores the token's
    place decides, then path and place of the symbol.
    """
    with_body = cut(bodies(symbols.select("qualified_name", "module", "visibility", "path", "idx", "start", "end"), files))
    columns = ["claim_id", "score", "pos", "path", "idx", "start", F.col("body").alias("text")]
    named = grounded.where("qualified_name IS NOT NULL").groupBy("claim_id", "qualified_name").agg(F.min("pos").alias("pos"))
    one = named.join(with_body, "qualified_name").withColumn("score", F.lit(NAMED)).select(*columns)
    # The first ``k`` public symbols of a module, with or without a body.
    order = Window.partitionBy("module").orderBy("path", "idx")
    public = symbols.where("visibility = 'public'").select("module", "path", "idx").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    inside = grounded.where("module IS NOT NULL").groupBy("claim_id", "module").agg(F.min("pos").alias("pos")).join(public, "module").select("claim_id", "pos", "path", "idx")
    two = inside.join(with_body.drop("module"), ["path", "idx"]).withColumn("score", F.lit(IN_MODULE)).select(*columns)
    direct = cut(one.unionByName(two))
    rest = claims.join(direct.select("claim_id").distinct(), "claim_id", "left_anti")
    # Claims of equal words have the same nearest symbols: bodies are looked up for these, not for each claim.
    asked = cut(rest.select("claim_id", F.array_sort(subwords(F.col("text"))).alias("tokens")).withColumn("set", F.md5(F.array_join("tokens", "\0"))))
    near = lexical(asked.select(F.col("set").alias("query_id"), "tokens").dropDuplicates(["query_id"]), lexicon(symbols), k, least)
    near = near.select(F.col("query_id").alias("set"), F.round("score", 9).alias("score"), F.col("rank").alias("pos"), "id.path", "id.idx")
    three = asked.select("claim_id", "set").join(near.join(with_body, ["path", "idx"]).hint("shuffle_hash"), "set").select(*columns)
    every = direct.unionByName(three)
    best = Window.partitionBy("claim_id", "path", "start").orderBy(F.desc("score"), "pos", "idx")
    once = every.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    by = Window.partitionBy("claim_id").orderBy(F.desc("score"), "pos", "path", "idx")
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("claim_id", "rank", "path", F.col("start").alias("start_line"), "score", "text")


def recall(evidence: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(recall_at_k, recall_at_1) of evidence (claim_id, rank, path) against the right file of each claim (claim_id, path)."""
    hit = evidence.where(F.col("rank") <= k).join(gold.select("claim_id", "path"), ["claim_id", "path"], "left_semi").groupBy("claim_id").agg(F.min("rank").alias("first"))
    both = gold.select("claim_id").join(hit, "claim_id", "left")
    share = lambda c: F.coalesce(F.count_if(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0))
    return both.agg(share(F.col("first").isNotNull()).alias("recall_at_k"), share(F.col("first") == 1).alias("recall_at_1"))


def symbol_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, start_line, n_lines, chunk) of the library files (path, text): a chunk for each outermost symbol (path, start, end).

    A symbol of more than LONGEST_SYMBOL lines is cut into windows, as is the whole of a
    file without symbols. Blank chunks are left out.
    """
    held = files.where(is_library(F.col("path")) & F.col("text").isNotNull()).select("path", F.split("text", "\r?\n", -1).alias("lines"))
    ended = F.element_at("lines", -1) == ""
    held = held.withColumn("lines", F.when(ended, F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines"))).withColumn("n", F.size("lines"))
    spans = symbols.where("start > 0 AND end >= start").select("path", "start", "end").distinct()
    spans = top_level(spans.withColumn("id", F.lit(0))).select("path", "start", "end")
    both = held.join(spans, "path", "left")
    first = F.coalesce("start", F.lit(1))
    last = F.coalesce(F.least("end", "n"), F.col("n"))
    both = both.select("path", "lines", first.alias("first"), last.alias("last"), F.col("start").isNull().alias("whole")).where("last >= first")
    size = F.col("last") - F.col("first") + 1
    steps = F.greatest(F.ceil((size - CHUNK_LINES) / F.lit(CHUNK_STEP)), F.lit(0)).cast("int")
    windows = F.when(F.col("whole") | (size > LONGEST_SYMBOL), F.transform(F.sequence(F.lit(0), steps), lambda w: F.struct((F.col("first") + w * CHUNK_STEP).alias("a"), F.least(F.col("last"), F.col("first") + w * CHUNK_STEP + CHUNK_LINES - 1).alias("b"))))
    windows = windows.otherwise(F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b"))))
    each = both.withColumn("w", F.explode(windows))
    part = F.slice("lines", F.col("w.a"), F.col("w.b") - F.col("w.a") + 1)
    return each.select("path", F.col("w.a").alias("start_line"), F.size(part).alias("n_lines"), F.array_join(part, "\n").alias("chunk")).where(F.col("chunk").rlike(SIGN))
