"""Evidence retrieval: tokens, inverse document frequency, ranked matches, chunks, and the verdict over model scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.lineage import cut
from plumbline.sources.storage import is_folder

STOPWORDS = tuple(
    """all and any are but can code doc docs does for from has have into its may must not only per should that the then this
    use used uses via was when will with would you""".split()
)
CHUNK_LINES, CHUNK_STEP = 40, 30
#: White space and what is none, as SQL's patterns have it: a vertical tab is a sign.
SPACE, SIGN = r"[ \t\n\f\r]+", r"[^ \t\n\f\r]"
LEAST_LEXICAL = 0.5


def subwords(text: Column) -> Column:
    """Distinct lower-case parts of identifiers and the whole runs, of at least 3 bytes, without stop words."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)
    cut = F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    parts = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(cut, r"(\p{L})(\p{N})", "$1 $2"), r"(\p{N})(\p{L})", "$1 $2"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    both = F.transform(F.concat(parts, runs), F.lower)
    return F.array_distinct(F.filter(both, lambda t: (F.octet_length(t) >= 3) & ~t.isin(*STOPWORDS)))


def inverse_frequency(entries: DataFrame) -> DataFrame:
    """(token, df, idf) of entries (id, tokens): idf = ln(1 + n / (1 + df))."""
    n = entries.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    df = entries.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))  # n: one row


#: Tokens in more than this share of the entries, and in more than so many, are hot.
HOT_SHARE, HOT_LEAST = 0.01, 10_000


def lexical(queries: DataFrame, entries: DataFrame, k: int, least: float = LEAST_LEXICAL, hot_least: int = HOT_LEAST) -> DataFrame:
    """(query_id, rank, id, score): the k entries (id, tokens, names) that share the rarest tokens with a query (query_id, tokens).

    A token that is also in the entry's ``names`` counts twice. Queries of equal tokens are
    scored once. Pairs are made of queries and entries that share a token which is not hot;
    the hot tokens of both only add to their scores. Entries that share hot tokens alone
    differ by which hot tokens they have: of those that have the same, only the k least ids
    can be among the k best, so these stand for all others. The result is that of scoring
    every pair.
    """
    n = entries.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))  # one row
    # Tables that several steps below read are written, so that texts are cut into tokens once.
    asked = queries.select("query_id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).withColumn("set", F.md5(F.array_join("tokens", "\0")))
    said = cut(asked.select("set", "tokens").dropDuplicates(["set"]).select("set", F.explode("tokens").alias("token")))
    weight = F.when(F.array_contains("names", F.col("token")), 2.0).otherwise(1.0).alias("w")
    held = entries.select("id", F.explode(F.array_distinct("tokens")).alias("token"), "names").select("id", "token", weight)
    # Tokens that no query has add to no score, so how many entries have them is not asked.
    held = cut(held.join(cut(said.select("token").distinct()), "token"))
    df = held.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    idf = cut(df.select("token", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"), ((F.col("df") > F.col("n") * HOT_SHARE) & (F.col("df") > hot_least)).alias("hot")))
    said, held = said.join(idf, "token"), held.join(idf.select("token", "hot"), "token")

    def split(rows: DataFrame, key: str, value: str, kind: str) -> DataFrame:
        """(key, rare, hot, kind): the tokens of a query or an entry with their values, and a number for what is hot in it, null without."""
        pair = F.struct("token", value)
        out = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~F.col("hot"), pair))).alias("rare"), F.array_sort(F.collect_list(F.when(F.col("hot"), pair))).alias("hot"))
        return out.withColumn(kind, F.when(F.size("hot") > 0, F.xxhash64("hot")))

    sets, own = split(said, "set", "idf", "kind"), cut(split(held, "id", "w", "own"))
    # What hot tokens add, for each kind of query and of entry.
    kinds = sets.where("kind IS NOT NULL").select("set", "kind", "hot")
    a = kinds.dropDuplicates(["kind"]).select("kind", F.explode("hot").alias("h")).select("kind", "h.token", "h.idf")
    b = own.where("own IS NOT NULL").select("own", "hot").dropDuplicates(["own"]).select("own", F.explode("hot").alias("h")).select("own", "h.token", "h.w")
    alike = cut(a.join(b, "token").groupBy("kind", "own").agg(F.sum(F.col("idf") * F.col("w")).alias("more")))
    # Candidates that share a token that is not hot.
    one = sets.select("set", "kind", F.explode("rare").alias("r")).select("set", "kind", "r.token", "r.idf")
    two = own.select("id", "own", F.explode("rare").alias("r")).select("id", "own", "r.token", "r.w")
    both = one.join(two, "token").groupBy("set", "id").agg(F.sum(F.col("idf") * F.col("w")).alias("rare"), F.any_value("kind").alias("kind"), F.any_value("own").alias("own"))
    near = both.join(alike, ["kind", "own"], "left").select("set", "id", (F.col("rare") + F.coalesce("more", F.lit(0.0))).alias("score"))
    # Of entries of a kind the k least; of queries of a kind one.
    fewest = own.where("own IS NOT NULL").select("id", "own").withColumn("__n", F.row_number().over(Window.partitionBy("own").orderBy("id"))).where(F.col("__n") <= k)
    of_kind = top(alike.where(F.col("more") >= least).join(fewest.select("own", "id"), "own").select(F.col("kind").alias("query_id"), "id", F.col("more").alias("score")), k).withColumnRenamed("query_id", "kind")
    hot = kinds.select("set", "kind").join(of_kind, "kind").select("set", "id", "score")
    scores = near.unionByName(hot).groupBy("set", "id").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    best = top(scores.withColumnRenamed("set", "query_id"), k).withColumnRenamed("query_id", "set")
    return asked.select("query_id", "set").join(best, "set").select("query_id", "rank", "id", "score")


def top(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query, by score to 9 places and id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


#: Vectors that are multiplied at once, blocks that one task holds of the entries, and numbers of pairs that are rescored at once.
BLOCK, HELD_BLOCKS, RESCORED = 4096, 64, 1 << 21


def _blocks(vectors: DataFrame, name: str) -> DataFrame:
    """(ids, vecs): up to BLOCK rows (name, vec) packed into one, the vectors as bytes of their own type; nulls are left out."""
    number = np.dtype(np.float32 if vectors.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64)

    def packed(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column(0).combine_chunks()
        vecs = np.array([x.values.to_numpy(zero_copy_only=False) for x in rows.column(1)], number)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([vecs.tobytes()], pa.binary())], ["ids", "vecs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            while n >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield packed(rows.slice(0, BLOCK))
                held, n = rows.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield packed(pa.Table.from_batches(held))

    kind = vectors.schema[name].dataType.simpleString()
    return vectors.where("vec IS NOT NULL").select(name, "vec").mapInArrow(run, f"ids array<{kind}>, vecs binary")


def _units(vecs: bytes, n: int, number: np.dtype) -> np.ndarray:
    """Packed vectors at length 1."""
    x = np.frombuffer(vecs, number).reshape(n, -1).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class _Best:
    """The scores that the k best of some queries (unit vectors) have so far; entries come in blocks."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k, self.single = queries, k, queries.astype(np.float32)
        self.least = np.full((len(queries), k), -np.inf)

    def add(self, entries: np.ndarray, single: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, entry, score) by number: what may be among the k best, of this block at most the k best of each query.

        In single precision, whose error is below ``off`` for unit vectors, pairs that
        can't be among the best so far are told; only the others are scored exactly.
        """
        off = (self.q.shape[1] + 8) * 2.0**-23 + 1e-9
        finite = np.isfinite(self.q).all() and np.isfinite(entries).all()
        for at in range(0, len(self.q), 256):
            score = self.single[at : at + 256] @ single.T
            least = self.least[at : at + 256]
            bar = least.min(axis=1) - off
            if len(entries) >= self.k and np.isinf(bar).any():
                bar = np.fmax(bar, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1] - 2 * off)
            open_ = score >= bar[:, None].astype(np.float32) - np.float32(2.0**-23)
            if not finite:
                open_ |= np.isnan(score)
            row, col = np.divmod(np.flatnonzero(open_.ravel()), len(entries))
            step = max(len(entries), RESCORED // self.q.shape[1])
            done = 0
            while done < len(row):
                # Whole queries at a time.
                end = len(row) if done + step >= len(row) else int(np.searchsorted(row, row[done + step]))
                end = end if end > done else int(np.searchsorted(row, row[done], side="right"))
                r, c = row[done:end], col[done:end]
                done = end
                exact = np.einsum("ij,ij->i", self.q[at + r], entries[c])
                order = np.lexsort((c, -np.round(exact, 9), r))
                r, c, exact = r[order], c[order], exact[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < self.k
                r, c, exact, place = r[keep], c[keep], exact[keep], place[keep]
                new = np.full(least.shape, -np.inf)
                new[r, place] = np.where(np.isnan(exact), -np.inf, np.round(exact, 9))
                told = new[r, place] >= least.min(axis=1)[r]
                least[:] = -np.sort(-np.concatenate([least, new], axis=1), axis=1)[:, : self.k]
                yield at + r[told], c[told], exact[told]


def cosine(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k entries (id, vec) nearest to each query (query_id, vec), exactly.

    All entries are scored, a block of queries against a block of entries by one matrix
    product in single precision. What that leaves open is scored exactly, and a block hands
    on those that are among the k best so far, by score to 9 places and id. A vector of
    zeros has score 0 with all, a null one is left out. A task holds one block of queries
    and HELD_BLOCKS of entries at most.
    """
    number = [np.dtype(np.float32 if df.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64) for df in (queries, entries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                q, e = batch.column(1)[i].values, batch.column(3)[i].values
                if asked != batch.column(0)[i].as_py():
                    asked, best = batch.column(0)[i].as_py(), _Best(_units(batch.column(2)[i].as_buffer(), len(q), number[0]), k)
                by_id = pc.sort_indices(e).to_numpy()
                e, b = e.take(pa.array(by_id)), _units(batch.column(4)[i].as_buffer(), len(e), number[1])[by_id]
                for row, col, score in best.add(b, b.astype(np.float32)):
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(row)), e.take(pa.array(col)), pa.array(score)], ["query_id", "id", "score"])

    asked, held = cut(_blocks(queries, "query_id")), cut(_blocks(entries, "id"))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    asked = asked.select(F.monotonically_increasing_id().alias("q"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    asked = asked.repartition(max(1, min(asked.count(), 4 * cores)))
    held = held.toDF("e_ids", "e_vecs").repartition(max(1, -(-held.count() // HELD_BLOCKS)))
    both = asked.hint("shuffle_replicate_nl").crossJoin(held)  # of blocks
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (entries, "id"))]
    return top(both.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double"), k)


def nearest(queries: DataFrame, entries: DataFrame, k: int, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``cosine``, or with a reranker the k best of four times as many by what it gives: pairs (query_id, id, score) to such pairs."""
    if rerank is None:
        return cosine(queries, entries, k)
    return top(rerank(cosine(queries, entries, 4 * k).select("query_id", "id", "score")).select("query_id", "id", "score"), k)


def embedded(texts: DataFrame, embed: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, model: str = "") -> DataFrame:
    """(model, key, vec) of each distinct text (text): from the cache of this model where it is known, else by ``embed``.

    The key is a hash of the text. ``embed`` turns (key, text) into (key, vec); it is the
    caller's, such as an Arrow function over a session. A cache (model, key, vec) of other
    models is of no use and no harm.
    """
    asked = texts.where("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    if cache is None:
        return embed(asked).select(F.lit(model).alias("model"), "key", "vec")
    known = cache.where(F.col("model") == model).select("model", "key", "vec").join(asked.select("key"), "key", "left_semi").select("model", "key", "vec")
    new = embed(asked.join(known.select("key"), "key", "left_anti")).select(F.lit(model).alias("model"), "key", "vec")
    return known.unionByName(new)


def embedded_at(texts: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, model: str) -> DataFrame:
    """``embedded`` with the cache table at ``path``, to which the vectors that it lacks are added; nothing is written if it lacks none."""
    spark = texts.sparkSession
    schema = "model string, key string, vec array<float>"
    cache = spark.read.schema(schema).parquet(path) if is_folder(path) else spark.createDataFrame([], schema)
    own = cache.where(F.col("model") == model)
    asked = texts.where("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    missing = asked.join(own.select("key"), "key", "left_anti")
    if not missing.isEmpty():
        embed(missing).select(F.lit(model).alias("model"), "key", F.col("vec").cast("array<float>").alias("vec")).write.mode("append").parquet(path)
        own = spark.read.schema(schema).parquet(path).where(F.col("model") == model)
    return own.join(asked.select("key"), "key", "left_semi").select("model", "key", "vec")


def chunks(files: DataFrame, size: int = CHUNK_LINES, step: int = CHUNK_STEP, blank: bool = False) -> DataFrame:
    """(path, start_line, n_lines, chunk) of files (path, lines array): windows of ``size`` lines every ``step``, up to the first that reaches the end.

    Windows without a sign other than white space are left out, unless ``blank``.
    """
    n = F.size("lines")
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    at = files.where("size(lines) > 0").withColumn("w", F.explode(F.sequence(F.lit(0), last)))
    part = F.slice("lines", F.col("w") * step + 1, F.lit(size))
    out = at.select("path", (F.col("w") * step + 1).alias("start_line"), F.size(part).alias("n_lines"), F.array_join(part, "\n").alias("chunk"))
    return out if blank else out.where(F.col("chunk").rlike(SIGN))


def decide(scores: DataFrame, threshold: float = 0.5, margin: float = 0.15) -> DataFrame:
    """(claim_id, best_entail, best_contra, verdict) from a model's scores (claim_id, contra, entail, neutral) of each piece of evidence.

    Contradiction counts where it beats entailment by the margin and is not below
    neutral. In single precision, bounds included, as scores come from a model.
    """
    c, e, n = (F.col(x).cast("float") for x in ("contra", "entail", "neutral"))
    strong = F.when((c >= (e + F.lit(margin).cast("float")).cast("float")) & (c >= n), c)
    best = scores.groupBy("claim_id").agg(F.coalesce(F.max(e), F.lit(0).cast("float")).alias("best_entail"), F.coalesce(F.max(strong), F.lit(0).cast("float")).alias("best_contra"))
    be, bc, t = F.col("best_entail"), F.col("best_contra"), F.lit(threshold).cast("float")
    verdict = F.when((bc >= t) & (bc >= be), "contradicted").when(be >= t, "supported").otherwise("unverifiable")
    return best.withColumn("verdict", verdict)


def judge(claims: DataFrame, evidence: DataFrame, scorer: Callable[[DataFrame], DataFrame], cap: int = 300) -> DataFrame:
    """(claim_id, text, best_entail, best_contra, verdict) of the first ``cap`` claims (claim_id, path, line_no, text) in
    order of document and line; scorer turns (claim_id, text, evidence) into scores.

    ``cap`` of 0 means all. The model is the caller's: any DataFrame function, such as an Arrow UDF over a session.
    """
    some = claims.orderBy("path", "line_no", "claim_id").limit(cap) if cap else claims
    pairs = some.join(evidence.select("claim_id", F.col("text").alias("evidence")), "claim_id").select("claim_id", "text", "evidence")
    judged = decide(scorer(pairs))
    none = F.lit(0).cast("float")
    return some.join(judged, "claim_id", "left").select(
        "claim_id", "text", F.coalesce("best_entail", none).alias("best_entail"), F.coalesce("best_contra", none).alias("best_contra"), F.coalesce("verdict", F.lit("unverifiable")).alias("verdict")
    )
