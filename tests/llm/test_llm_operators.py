"""Each operator against brute force, an exact round trip or held-out accuracy, and over awkward rows."""

import base64
import hashlib
import math
import os
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (
    brown_lm,
    corpus_words,
    language_id,
    multiset_fingerprint,
    packing,
    quality_classifier,
    repetition_rules,
    sentencepiece_stream,
    sharding,
    simhash_dedup,
    token_counts,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, word long, `count` int"
TABLES = "/root/testdata/sf0.01"
LONG = "gamma delta " * 30_000 + "end"
AWKWARD = [
    (1, "alpha beta gamma", "en", "s", 16, "x", 1, 1),
    (1, "alpha beta gamma", "en", "s", 16, "x", 1, 1),  # the whole row again
    (2, None, "en", None, None, None, None, None),
    (3, "", "de", "s", 0, "x", 1, 1),
    (4, " \n\t ", None, "s", 4, None, 1, 1),
    (None, "no id here, but words", "en", "s", 20, "x", None, 1),
    (None, None, None, None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG), "x", 1, 1),
    (6, "été 漢字 \U0001f600 İ", "fr", "s", 9, "x", 1, 1),
    (7, "### $$$ |", "en", "s", 9, "x", 1, 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (99, 1, 1), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def corpus(seed: int, n: int, words: int = 60) -> list[str]:
    """Texts over two disjoint sets of words, in turn."""
    rng = random.Random(seed)
    sets = [["red", "green", "blue", "tint", "hue"], ["dog", "cat", "cow", "hen", "ant"]]
    links = [["is", "was"], ["eats", "sees"]]
    out = []
    for i in range(n):
        k = i % 2
        out.append(" ".join(rng.choice(sets[k]) + " " + rng.choice(links[k]) for _ in range(rng.randint(2, words))) + (f" rare{seed}x{i}" if i % 3 == 0 else ""))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# tokens of a corpus


def plain_tokens(text: str, lower: bool = True) -> list[bytes]:
    return re.findall(rb"[0-9a-zA-Z\x80-\xff]+|[^\x00-\x20\x7f0-9a-zA-Z\x80-\xff]+", (text.lower() if lower else text).encode())


def test_corpus_tokens_are_those_of_a_regular_expression():
    texts = ["Ab, cd!! été", None, "", "x", "...  \n a1 b2"]
    t = corpus_words.tokens(texts)
    raw = t.raw.tobytes()
    assert [(int(d), raw[a:b]) for d, a, b in zip(t.doc, t.start, t.end)] == [(i, w) for i, x in enumerate(texts) if x for w in plain_tokens(x)]
    by_hash = {}
    for h, a, b in zip(t.hashes.tolist(), t.start, t.end):
        assert by_hash.setdefault(h, raw[a:b]) == raw[a:b]


def test_vocabulary_counts_everything(spark):
    texts = corpus(1, 80)
    v = corpus_words.vocabulary(frame(spark, texts), 0.01)
    all_counts = Counter(w for t in texts for w in plain_tokens(t))
    assert v.total == sum(all_counts.values())
    assert sorted(v.counts.tolist()) == sorted(c for c in all_counts.values() if c >= max(2, math.ceil(0.01 * v.total)))


# 1 language model


def brute_bits(model, text, vocab_words, classes, m, spelled):
    """Cost of a text from unpacked counts, in bits."""
    transition, spelling = brown_lm.probabilities(m, spelled)
    edge = len(m) - 1
    total = Counter()
    for h, c in vocab_words.items():
        total[classes[h]] += model.vocab.counts[model.vocab.ids(np.array([h], np.uint64))[0]]
    bits, before = 0.0, edge
    for w in plain_tokens(text):
        h = corpus_words.tokens([w.decode()]).hashes[0]
        at = int(model.vocab.ids(np.array([h]))[0])
        node = int(brown_lm.nodes(model.vocab, corpus_words.tokens([w.decode()]))[0])
        c = int(model.class_of[node])
        bits -= math.log2(transition[before, c])
        if at >= 0:
            bits -= math.log2(model.vocab.counts[at] / total[c])
        else:
            for a, b in zip(b"\n" + w, w + b"\n"):
                bits -= math.log2(spelling[a, b])
        before = c
    return bits - math.log2(transition[before, edge])


def test_language_model_equals_brute_force(spark):
    texts = corpus(2, 60)
    docs = frame(spark, texts)
    v = corpus_words.vocabulary(docs, 0.005)
    pairs, spelled = brown_lm.pair_counts(docs, v)
    expected = Counter()
    for t in texts:
        ids = [len(v) + brown_lm.OPEN, *brown_lm.nodes(v, corpus_words.tokens([t])).tolist(), len(v) + brown_lm.OPEN]
        expected.update(a * brown_lm._SPAN + b for a, b in zip(ids, ids[1:]))
    assert {r["key"]: r["n"] for r in pairs.collect()} == dict(expected)
    class_of, m, course = brown_lm.exchange(brown_lm.contexts(pairs), v, 4)
    assert max(course) > course[0] and max(course[-2:]) - max(course[:-2]) <= brown_lm.GAIN * (max(course) - course[0])
    by_pair = np.zeros_like(m)
    for k, n in expected.items():
        by_pair[class_of[k // brown_lm._SPAN], class_of[k % brown_lm._SPAN]] += n
    assert (m == by_pair).all()
    model = brown_lm.model_of(v, class_of, m, spelled)
    words = {int(h): 0 for h in v.hashes}
    classes = {int(h): int(class_of[i]) for i, h in enumerate(v.hashes)}
    got = brown_lm.score(docs, model).collect()
    for r in got:
        t = texts[r["doc_id"]]
        n = len(plain_tokens(t))
        assert r["n_tokens"] == n
        assert r["bits"] == pytest.approx(brute_bits(model, t, words, classes, m, spelled), abs=1e-3 * (n + 5))
        assert r["perplexity"] == pytest.approx(2 ** (r["bits"] / (n + 1)))


def test_every_word_may_move_in_one_of_two_rounds():
    hashes = corpus_words.mixed(np.arange(1000, dtype=np.uint64))
    for turn in range(0, 20, 2):
        first, second = brown_lm.movable(hashes, turn), brown_lm.movable(hashes, turn + 1)
        assert (first != second).all() and 400 < first.sum() < 600
    assert (brown_lm.movable(hashes, 0) != brown_lm.movable(hashes, 2)).any()


def test_smoothed_chances_sum_to_one():
    m = np.array([[3.0, 0, 1], [0, 0, 0], [2, 2, 2]])
    transition, spelling = brown_lm.probabilities(m, np.arange(65536) % 3)
    assert np.allclose(transition.sum(1), 1) and np.allclose(spelling.sum(1), 1) and (transition > 0).all()


def test_exchange_finds_the_best_single_move():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, (9, 9)).astype(float)
    class_of = np.array([0, 1, 2, 0, 1, 2, 0, 1, 3])  # the last node is fixed

    def matrix(c):
        m = np.zeros((4, 4))
        np.add.at(m, (c[:, None].repeat(9, 1), c[None, :].repeat(9, 0)), counts)
        return m

    for w in range(8):
        right = np.bincount(class_of, weights=np.where(np.arange(9) == w, 0, counts[w]), minlength=4)
        left = np.bincount(class_of, weights=np.where(np.arange(9) == w, 0, counts[:, w]), minlength=4)
        found = brown_lm.best_class(matrix(class_of), 3, class_of[w], right, left, counts[w, w])
        scores = []
        for k in range(3):
            moved = class_of.copy()
            moved[w] = k
            scores.append(brown_lm.likelihood(matrix(moved)))
        assert scores[found] == pytest.approx(max(scores))


def test_every_word_that_occurs_twice_has_a_class(spark):
    texts = corpus(6, 60) + ["rareone", "is rareone raretwo", "was raretwo oncealone"]
    docs = frame(spark, texts)
    model = brown_lm.train(docs, share=0.02, classes=8)
    hashed = {w.decode(): int(corpus_words.tokens([w.decode()]).hashes[0]) for t in texts for w in plain_tokens(t)}
    counts = Counter(w.decode() for t in texts for w in plain_tokens(t))
    in_vocab = dict(zip(model.vocab.hashes.tolist(), model.class_of.tolist()))
    rarer = {r["word"] % 2**64: r for r in model.rarer.collect()}
    assert set(rarer) == {hashed[w] for w, n in counts.items() if n >= 2} - set(in_vocab) and {hashed["rareone"], hashed["raretwo"]} <= set(rarer)
    class_of = {w: in_vocab[h] if h in in_vocab else rarer[h]["class"] if h in rarer else None for w, h in hashed.items()}
    total = Counter()
    for w, n in counts.items():
        total[class_of[w]] += n
    edge = len(model.transition) - 1
    spelling_of = model.spelling.reshape(256, 256)
    unit = brown_lm.UNIT
    pairs = np.zeros((edge + 1, edge + 1))
    expected, before_after = [], []
    for t in texts:
        own, seq = 0.0, [edge]
        for w in plain_tokens(t):
            c = class_of[w.decode()]
            if c is None:
                c = int(model.class_of[brown_lm.nodes(model.vocab, corpus_words.tokens([w.decode()]))[0]])
                own += sum(int(spelling_of[a, b]) for a, b in zip(b"\n" + w, w + b"\n")) / unit
            else:
                own -= math.log2(counts[w.decode()] / total[c])
            seq.append(c)
        seq.append(edge)
        np.add.at(pairs, (seq[:-1], seq[1:]), 1)
        expected.append(own)
        before_after.append(seq)
    transition, _ = brown_lm.probabilities(pairs, np.zeros(65536))
    for r in brown_lm.score(docs, model).collect():
        seq = before_after[r["doc_id"]]
        bits = expected[r["doc_id"]] - sum(math.log2(transition[a, b]) for a, b in zip(seq, seq[1:]))
        assert r["bits"] == pytest.approx(bits, abs=1e-3 * (len(seq) + 5))


def test_perplexity_prefers_text_like_the_corpus(spark):
    docs = frame(spark, corpus(5, 200))
    model = brown_lm.train(docs, share=0.002, classes=8)
    new = frame(spark, ["red is green was blue is", "is is was red red green", "zxqv kjwq vvxx"])
    p = {r["doc_id"]: r["perplexity"] for r in brown_lm.score(new, model).collect()}
    assert p[0] < p[1] < p[2]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_language_model_of_documents_it_has_not_seen(spark):
    """Bits a token of unseen documents: as they are, with their words shuffled, and under a model of one class."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    later = F.pmod(F.xxhash64(F.lit("later"), "doc_id"), F.lit(4)) == 0
    seen, unseen = docs.where(~later), docs.where(later)
    model = brown_lm.train(seen)
    shuffled = unseen.withColumn("text", F.array_join(F.transform(F.array_sort(F.transform(F.split("text", r"\s+"), lambda w, i: F.struct(F.xxhash64(w, i).alias("h"), w.alias("w")))), lambda x: x["w"]), " "))

    def bits(df, of) -> float:
        r = brown_lm.score(df, of).agg(F.sum("bits"), F.sum("n_tokens")).first()
        return r[0] / r[1]

    one = brown_lm.train(seen, classes=1)  # of all words one class, so that words tell nothing of their neighbours
    real, mixed, single = bits(unseen, model), bits(shuffled, model), bits(unseen, one)
    print(f"bits a token: as they are {real:.3f}, shuffled {mixed:.3f}, with one class {single:.3f}")
    assert real < mixed and real < single


def test_language_model_over_awkward_rows(spark, awkward, empty):
    rows = brown_lm.score(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert (r["perplexity"] is None) == (r["n_tokens"] in (None, 0))
    assert {r["doc_id"] for r in rows if r["n_tokens"] is None} == {2, None}
    assert brown_lm.score(empty).count() == 0


# 2 token counts


@pytest.fixture(scope="module")
def ranks():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts.read_ranks(f.read())


@pytest.fixture(scope="module")
def tiktoken_encoding(ranks):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_every_prefix_count_is_that_of_encoding_the_prefix(ranks, tiktoken_encoding):
    counter, rng = token_counts.PrefixCounter(ranks), random.Random(4)
    alphabet = " \n\t'stredvml..,1234 aéßñ漢\U0001f600　 #$'s'll"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["Don't stop;  we'll  see\n\n 12 times"]
    for t in texts:
        counts = token_counts.prefix_counts(counter.steps(t).astype(np.int32).tobytes(), 4)
        assert counts.tolist() == [len(tiktoken_encoding.encode_ordinary(t[:i])) for i in range(len(t) + 1)]


def test_token_counts_over_awkward_rows(spark, awkward, empty, tiktoken_encoding):
    rows = token_counts.count_tokens(awkward, budgets=(3, 50)).collect()
    assert len(rows) == len(AWKWARD)
    text = {a[0]: a[1] for a in AWKWARD if a[0] is not None}
    for r in rows:
        if r["doc_id"] is None:
            continue
        t = text[r["doc_id"]]
        if t is None:
            assert r["n_tokens"] is None and r["deltas"] is None and r["chars_3"] is None
            continue
        counts = token_counts.prefix_counts(r["deltas"], r["delta_width"])
        assert r["n_chars"] == len(t) and r["n_tokens"] == counts[-1] == len(tiktoken_encoding.encode_ordinary(t))
        for b in (3, 50):
            n = r[f"chars_{b}"]
            assert counts[n] <= b and (counts[n + 1 :] > b).all()
    assert token_counts.count_tokens(empty).count() == 0


# 3 quality


def test_word_vectors_are_sums_over_neighbours(spark):
    texts = ["a b c a b", "c c b", ""] * 3
    docs = frame(spark, texts)
    v = corpus_words.vocabulary(docs, 0.01, lower=False)
    place, sign = quality_classifier.index_vectors(v)
    dense = np.zeros((len(place), quality_classifier.DIMENSIONS))
    for j in range(quality_classifier.NONZERO):
        np.add.at(dense, (np.arange(len(place)), place[:, j]), sign[:, j])
    total = np.zeros((len(place) - 1, quality_classifier.DIMENSIONS))
    for t in texts:
        ids = quality_classifier.nodes(v, corpus_words.tokens([t], lower=False)).tolist()
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= quality_classifier.WINDOW:
                    total[a] += dense[b]
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    total -= total.mean(axis=0)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality_classifier.word_vectors(docs, v), total, atol=1e-5)


def test_quality_on_held_out_documents(spark):
    texts = corpus(6, 600, 30)
    docs = frame(spark, texts)
    known = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)], "doc_id long, quality int")
    rows = quality_classifier.classify(docs, known).collect()
    later = [r for r in rows if r["doc_id"] >= 400]
    assert np.mean([r["keep"] == (r["doc_id"] % 2 == 0) for r in later]) > 0.97


def test_rare_words_of_one_shape_are_told_apart(spark):
    said = {0: "vexil", 1: "plomb"}
    known = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    texts = [f"red blue is green was {said[i % 2]}" for i in range(400)]
    model = quality_classifier.train(frame(spark, texts), known, share=0.2)
    assert len(model.vocab) == 0
    p = {r["doc_id"]: r["p_quality"] for r in quality_classifier.classify(frame(spark, texts[:2]), known, model).collect()}
    assert p[0] < 0.1 and p[1] > 0.9


def test_chances_equal_a_plain_network(spark):
    """Features and network from their definitions, token by token and weight by weight."""
    texts = corpus(31, 40, 12) + ["One odd-One ... x1 x1", "...", ""]
    docs = frame(spark, texts)
    known = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(30)], "doc_id long, quality int")
    model = quality_classifier.train(docs, known, share=0.01)
    net, d = model.network, quality_classifier.DIMENSIONS
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, known, model).collect()}
    for i, text in enumerate(texts):
        t = corpus_words.tokens([text], lower=False)
        if not len(t.start):
            assert got[i]["p_quality"] is None
            continue
        node = quality_classifier.nodes(model.vocab, t).tolist()
        n, kinds = len(node), sorted(set(node))
        x = [sum(float(model.vectors[k][j]) for k in node) / n for j in range(d)]
        x += [sum(float(model.vectors[k][j]) for k in kinds) / len(kinds) for j in range(d)]
        rare = [0.0] * quality_classifier.RARE
        for k, h in zip(node, t.hashes.tolist()):
            if k >= len(model.vocab):
                for j in range(quality_classifier.NONZERO):
                    drawn = int(corpus_words.mixed(np.array([(h + 0x632BE59BD9B4E019 * (j + 1)) % 2**64], np.uint64))[0])
                    rare[drawn % quality_classifier.RARE] += (1 if (drawn >> 40) % 2 else -1) / n
        x += [*rare, math.log(n), math.log(n / len(kinds)), math.log(n / len(set(t.hashes.tolist())))]
        z = net.b2
        for h in range(len(net.w2)):
            z += net.w2[h] * max(0.0, net.b1[h] + sum((x[j] - net.mean[j]) / net.scale[j] * net.w1[j][h] for j in range(len(x))))
        assert got[i]["p_quality"] == pytest.approx(1 / (1 + math.exp(-z / net.temperature)), abs=2e-4)
        assert got[i]["keep"] == (got[i]["p_quality"] >= 0.5)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_quality_of_labelled_documents_that_were_not_fitted_on(spark):
    docs, known = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    later = F.pmod(F.xxhash64(F.lit("later"), "doc_id"), F.lit(3)) == 0
    told = quality_classifier.classify(docs, known.where(~later)).join(known.where(later).select("doc_id", "quality"), "doc_id").collect()
    share = max(np.mean([r["quality"] == k for r in told]) for k in (0, 1))
    right = np.mean([r["keep"] == (r["quality"] == 1) for r in told if r["p_quality"] is not None])
    print(f"held-out accuracy {right:.3f}, greater share {share:.3f}, {len(told)} documents")
    assert right > max(share, 0.8)


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality_classifier.temperature(4 * z, y) == pytest.approx(4, rel=0.2)
    assert quality_classifier.temperature(z, np.ones(4000)) == 1.0


def test_quality_over_awkward_rows(spark, awkward, empty, labels):
    rows = quality_classifier.classify(awkward, labels).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if r["doc_id"] in (2, 3, 4):
            assert r["p_quality"] is None and r["keep"] is False
    assert quality_classifier.classify(empty, labels).count() == 0
    none = quality_classifier.classify(awkward, labels.where("false")).collect()
    assert all(r["p_quality"] is None for r in none) and {r["doc_id"] for r in none if r["keep"]} == {1, 5, 6, 7, None}


# 4 near-dedup


def near_copies(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(80)]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(80)] = "changed"
            out.append(" ".join(copy))
    return out


def test_groups_hold_near_copies_and_nothing_else(spark):
    texts = near_copies(7, 150)
    fps = [np.frombuffer(f, np.uint64) for f in simhash_dedup.fingerprints_of(texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= simhash_dedup.THRESHOLD]
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in simhash_dedup.groups(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert np.mean([got[i]["group_id"] == got[j]["group_id"] for i, j in pairs]) >= 0.95
    for i, r in got.items():
        assert find(r["group_id"]) == find(i)  # never together without a path of near copies
        assert r["keep"] == (r["group_id"] == i)
    sizes = Counter(r["group_id"] for r in got.values())
    assert all(r["group_size"] == sizes[r["group_id"]] == r["n_links"] + 1 for r in got.values())


def bit_counts(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps, axis=1, bitorder="little").reshape(len(fps), simhash_dedup.SEGMENTS, simhash_dedup.SEGMENT).sum(2).astype(int)


def test_codes_tell_the_manhattan_distance_of_the_bit_counts():
    fps = np.random.default_rng(5).integers(0, 256, (300, 32), dtype=np.uint8)
    points, counts = simhash_dedup._embed(fps), bit_counts(fps)
    for i in range(0, 300, 7):
        apart = np.bitwise_count(points ^ points[i]).sum(1)
        assert (apart == np.abs(counts - counts[i]).sum(1)).all()
        assert (apart <= np.bitwise_count(fps ^ fps[i]).sum(1)).all()


def test_grids_reach_the_recall_at_the_threshold():
    for n in (1, 1_000, 100_000, 10**8, 10**11):
        m, grids = simhash_dedup.plan(n)
        for d in range(simhash_dedup.THRESHOLD + 1):
            assert 1 - (1 - simhash_dedup.match_chance(d) ** m) ** grids >= simhash_dedup.RECALL


@pytest.mark.parametrize("corpus_size", [5_000, 10_000_000])
def test_pairs_at_the_threshold_are_found(spark, corpus_size):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (1500, 256), dtype=np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.choice(256, simhash_dedup.THRESHOLD, replace=False)] ^= 1
    fps = [r.tobytes() for r in np.packbits(np.concatenate([bits, other]), axis=1)]
    found = simhash_dedup.edges(simhash_dedup.cells(spark.createDataFrame(list(enumerate(fps)), "node long, fp binary"), *simhash_dedup.plan(corpus_size)))
    pairs = {(r["a"], r["b"]) for r in found.collect()}
    assert pairs <= {(i + 1500, i) for i in range(1500)}  # unrelated fingerprints are never this near
    assert len(pairs) >= 0.95 * 1500


def test_all_ways_of_searching_a_cell_find_the_same_components():
    fps = np.frombuffer(b"".join(simhash_dedup.fingerprints_of(near_copies(9, 120))), np.uint8).reshape(-1, 32)
    rng = np.random.default_rng(3)
    bits = np.repeat(rng.integers(0, 2, (1, 256), dtype=np.uint8), 150, axis=0)
    for i in range(1, 150):  # a chain: each is near the one before, and far from most
        bits[i] = bits[i - 1]
        bits[i][rng.choice(256, 20, replace=False)] ^= 1
    fps = np.concatenate([fps, np.packbits(bits, axis=1)])[rng.permutation(len(fps) + 150)]
    n = len(fps)
    words, points = simhash_dedup._columns(fps), simhash_dedup._columns(simhash_dedup._embed(fps))

    def grouped(pairs) -> list[int]:
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(n)]

    near = [(i, j) for i in range(n) for j in range(i) if np.bitwise_count(words[:, i] ^ words[:, j]).sum() <= 44]
    want = grouped(near)
    assert len(set(want)) < n - 200
    for search in (simhash_dedup._tiles, simhash_dedup._dense):
        pairs = [(i, j) for a, b in search(points, words, 44) for i, j in zip(a.tolist(), b.tolist())]
        assert len(pairs) == n - len(set(want)) and grouped(pairs) == want


def test_hot_cells_are_searched_in_blocks_without_a_loss(spark, monkeypatch):
    rng = np.random.default_rng(23)
    base = rng.integers(0, 2, (6, 256), dtype=np.uint8)
    bits = []
    for k, n in ((0, 900), (1, 300), (2, 40), (3, 6), (4, 2)):  # clusters of near copies, the first of them hot
        for _ in range(n):
            row = base[k].copy()
            row[rng.choice(256, rng.integers(0, 16), replace=False)] ^= 1
            bits.append(row)
    at = base[5]
    for _ in range(60):  # a chain
        at = at.copy()
        at[rng.choice(256, 22, replace=False)] ^= 1
        bits.append(at)
    bits += list(rng.integers(0, 2, (300, 256), dtype=np.uint8))
    fps = np.packbits(np.array(bits), axis=1)[rng.permutation(len(bits))]
    n, words = len(fps), simhash_dedup._columns(fps)
    apart = sum(np.bitwise_count(w[:, None] ^ w[None, :]).astype(int) for w in words)

    def grouped(pairs) -> list[int]:
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(n)]

    nodes = spark.createDataFrame([(i, f.tobytes()) for i, f in enumerate(fps)], "node long, fp binary").repartition(3)
    # All in one cell: the components are those of all pairs.
    for pivots in (64, 1):
        monkeypatch.setattr(simhash_dedup, "PIVOTS", pivots)
        monkeypatch.setattr(simhash_dedup, "LEFT", 100)
        monkeypatch.setattr(simhash_dedup, "RIGHT", 300)
        found = {(r["a"], r["b"]) for r in simhash_dedup.hot_edges(nodes.select(F.lit(5).cast("long").alias("cell"), "node", "fp")).collect()}
        assert all(apart[a, b] <= 44 for a, b in found)
        assert grouped(found) == grouped(np.argwhere((apart <= 44) & ~np.eye(n, dtype=bool)).tolist())
    # Several cells, some of them hot: the components are those of searching each cell in one task.
    m, grids = simhash_dedup.plan(n)
    hot = simhash_dedup.hot_cells(nodes, n, m, grids, 250)
    assert len(hot) >= grids
    whole = {(r["a"], r["b"]) for r in simhash_dedup.edges(simhash_dedup.cells(nodes, m, grids)).collect()}
    split = {(r["a"], r["b"]) for r in simhash_dedup.near_pairs(nodes, n, hot=250).collect()}
    assert grouped(split) == grouped(whole)
    assert len(simhash_dedup.hot_cells(nodes, n, m, grids)) == 0


def copies_at_the_threshold(seed: int, n: int) -> list[str]:
    """``n`` texts and after each a copy whose fingerprint is just within the threshold."""
    rng = random.Random(seed)
    out = []
    while len(out) < 2 * n:
        base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(80)]
        copies = []
        for _ in range(8):
            copy = list(base)
            for at in rng.sample(range(80), rng.randint(9, 13)):
                copy[at] = "".join(rng.choice("klmnopqrst") for _ in range(6))
            copies.append(" ".join(copy))
        one, *others = (np.frombuffer(f, np.uint64) for f in simhash_dedup.fingerprints_of([" ".join(base), *copies]))
        apart = [int(np.bitwise_count(one ^ f).sum()) for f in others]
        good = [c for c, d in zip(copies, apart) if simhash_dedup.THRESHOLD - 2 <= d <= simhash_dedup.THRESHOLD]
        if good:
            out += [" ".join(base), good[0]]
    return out


def test_groups_lose_no_copy_at_the_threshold(spark):
    texts = copies_at_the_threshold(31, 500)
    got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.groups(frame(spark, texts)).collect()}
    fps = np.frombuffer(b"".join(simhash_dedup.fingerprints_of(texts)), np.uint64).reshape(-1, 4)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(2, dtype=int) <= simhash_dedup.THRESHOLD).tolist()
    assert len(near) >= 3 * 500
    assert [(i, j) for i, j in near if got[i] != got[j]] == []
    assert len(set(got.values())) >= 490  # and unrelated texts stay apart
    kept = {r["doc_id"] for r in simhash_dedup.deduplicate(frame(spark, texts)).collect()}
    assert kept == set(got.values())


@pytest.mark.parametrize("threshold", [5, 44, 100])
def test_blocks_are_compared_in_whole(spark, monkeypatch, threshold):
    rng = np.random.default_rng(threshold)
    bits = rng.integers(0, 2, (900, 256), dtype=np.uint8)
    other = bits[rng.integers(0, 900, 900)]
    for row in other:
        row[rng.choice(256, rng.integers(max(0, threshold - 4), threshold + 5), replace=False)] ^= 1
    fps = np.packbits(np.concatenate([bits, other, np.repeat(bits[:1], 700, axis=0)]), axis=1)[rng.permutation(2500)]
    root = np.sort(rng.integers(0, 2000, 2500))
    root[600:1400] = root[600]
    apart = sum(np.bitwise_count(w[:, None] ^ w[None, :]).astype(int) for w in simhash_dedup._columns(fps))
    want = {(min(a, b), max(a, b)) for a, b in root[np.argwhere(apart <= threshold)].tolist() if a != b}
    assert len(want) > 500
    nodes = spark.createDataFrame([(i, f.tobytes(), int(r)) for i, (f, r) in enumerate(zip(fps, root))], "node long, fp binary, root long")
    for least, block in ((2500, 10**6), (100, 10**6), (2500, 250)):  # one block, several, more because a block would be too large
        monkeypatch.setattr(simhash_dedup, "LEAST", least)
        monkeypatch.setattr(simhash_dedup, "BLOCK", block)
        assert {(r["a"], r["b"]) for r in simhash_dedup.missed(nodes.repartition(3), 2500, threshold).collect()} == want
    # Small tiles: those of one root are passed over, and a block is compared with itself or another.
    monkeypatch.setattr(simhash_dedup, "ROW_TILE", 97)
    monkeypatch.setattr(simhash_dedup, "COLUMN_TILE", 31)
    one = simhash_dedup._between(fps, root, fps, root, threshold, True)
    two = simhash_dedup._between(fps, root, fps, root, threshold)
    for found in (one, two):
        assert {tuple(p) for part in found for p in part.tolist()} == want


def test_many_exact_copies_are_one_group(spark):
    docs = frame(spark, near_copies(8, 40) + ["one two three four five six"] * 700)
    big = [r for r in simhash_dedup.groups(docs).collect() if r["group_size"] >= 700]
    assert len(big) == 700 and sum(r["keep"] for r in big) == 1


def test_a_document_of_several_texts_links_their_groups(spark):
    a, b, c = (" ".join(f"{x}{i}word" for i in range(60)) for x in "abc")
    rows = [("d1", a), ("d2", a), ("d3", b), ("d3", a), ("d4", b), ("d5", c), (None, c), (None, "only here"), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"], r["group_size"]): (r["group_id"], r["keep"]) for r in simhash_dedup.groups(docs).collect()}
    assert got == {("d1", 4): ("d1", True), ("d2", 4): ("d1", False), ("d3", 4): ("d1", False), ("d4", 4): ("d1", False), ("d5", 2): ("d5", True), (None, 2): ("d5", False), (None, 1): (None, True)}
    left = sorted(((r["doc_id"] or "", r["text"]) for r in simhash_dedup.deduplicate(docs).collect()))
    assert left == [("", "only here"), ("d1", a), ("d5", c)]


def test_texts_without_a_word_are_grouped_by_their_signs(spark):
    texts = ["### $$$ |", "-- !!", "### $$$ |", "-- !! --", "one two", "", "", " \n", " \n", None, None, "*** ???"]
    got = [r["group_id"] for r in sorted(simhash_dedup.groups(frame(spark, texts)).collect(), key=lambda r: r["doc_id"])]
    assert got == [0, 1, 0, 1, *range(4, 12)]  # a null or blank text is near to none
    assert sorted(r["doc_id"] for r in simhash_dedup.deduplicate(frame(spark, texts)).collect()) == [0, 1, *range(4, 12)]


def test_dedup_over_awkward_rows(spark, awkward, empty):
    rows = simhash_dedup.groups(awkward).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 7]
    kept = simhash_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect())[1] == 1
    assert simhash_dedup.groups(empty).count() == 0 and simhash_dedup.deduplicate(empty).count() == 0


# 5 packing


def test_differencing_gives_near_equal_windows():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 5_000, 400))[::-1]
    for k in (1, 2, 7, 40):
        sums = np.bincount(packing.differencing(lengths, k), weights=lengths, minlength=k)
        assert sums.sum() == lengths.sum()
        assert sums.max() - sums.min() <= max(5, lengths.sum() / k * 0.01)
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2).tolist() in ([0, 1, 1, 0, 0], [0, 1, 1, 0, 1], [1, 0, 0, 1, 1], [1, 0, 0, 1, 0], [0, 1, 0, 1, 0], [0, 1, 0, 1, 1], [1, 0, 1, 0, 1], [1, 0, 1, 0, 0])


def naive_differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Windows of the items, from the definition: lists of whole partitions, the two of greatest imbalance merged."""
    parts = [(i, [[] for _ in range(k - 1)] + [[i]]) for i in range(len(lengths))]
    load = lambda w: sum(lengths[j] for j in w)
    number = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (min(map(load, p[1])) - max(map(load, p[1])), p[0]))
        (_, x), (_, y) = parts[:2]
        up, down = sorted(x, key=load), sorted(y, key=load, reverse=True)
        parts = [*parts[2:], (number, [a + b for a, b in zip(up, down)])]
        number += 1
    return parts[0][1]


def test_differencing_equals_the_definition():
    rng = np.random.default_rng(12)
    for _ in range(200):
        n, k = int(rng.integers(1, 14)), int(rng.integers(1, 6))
        lengths = rng.choice(100_000, n, replace=False) + 1  # no ties, so the definition leaves no choice
        at = packing.differencing(lengths, k)
        got = sorted(sorted(np.flatnonzero(at == w).tolist()) for w in range(k))
        loads = sorted(int(lengths[w].sum()) for w in map(list, naive_differencing(lengths.tolist(), k)))
        assert sorted(int(lengths[w].sum()) for w in got) == loads
    for _ in range(60):  # the rising number of windows, against the same over the definition
        lengths = rng.choice(90, 9, replace=False) + 10
        k = -(-int(lengths.sum()) // 100)
        while max(sum(int(lengths[i]) for i in w) for w in naive_differencing(lengths.tolist(), k)) > 100:
            k += 1
        assert packing.windows(lengths, 100).max() + 1 <= k and len(set(packing.windows(lengths, 100).tolist())) <= k


def test_repeated_rows_are_dealt_to_several_blocks(spark):
    docs = spark.createDataFrame([(None, "x" * 7)] * 300 + [(1, "y" * 250)] * 150, "doc_id long, text string")
    rows = packing.pack(docs, capacity=100, block_items=32).collect()
    assert sum(r["length"] for r in rows) == 300 * 7 + 150 * 250
    assert len({r["window_id"] for r in rows if r["length"] == 100}) == 300
    blocks = Counter(r["window_id"].split(".")[0] for r in rows if r["length"] < 100)
    assert len(blocks) > 5 and max(blocks.values()) < 160


def test_window_count_rises_when_capacity_is_exceeded():
    at = packing.windows(np.array([6, 6, 6]), 10)
    assert len(set(at.tolist())) == 3


def test_every_character_is_packed_once(spark):
    rng = random.Random(9)
    texts = ["x" * rng.choice([1, 5, 90, 100, 101, 250, 399]) for _ in range(500)]
    rows = packing.pack(frame(spark, texts), capacity=100, block_items=64).collect()
    covered = Counter()
    windows = Counter()
    for r in rows:
        windows[r["window_id"]] += r["length"]
        for i in range(r["start"], r["start"] + r["length"]):
            covered[r["doc_id"], i] += 1
    assert covered == Counter((i, j) for i, t in enumerate(texts) for j in range(len(t)))
    assert max(windows.values()) <= 100
    assert all(windows[r["window_id"]] == r["window_length"] for r in rows)
    assert len(windows) <= 1.2 * sum(map(len, texts)) / 100


def test_packing_over_awkward_rows(awkward, empty):
    rows = packing.pack(awkward).collect()
    n = Counter()
    for r in rows:
        n[r["doc_id"]] += r["length"]
    assert n[1] == 32 and n[5] == len(LONG) and 2 not in n and 3 not in n and n[None] == len("no id here, but words")
    assert packing.pack(empty).count() == 0


# 6 multiset fingerprints


def test_fingerprint_is_an_order_independent_sum():
    parts = ["a", "b", "b", "é"]
    want = np.zeros(128, np.int64)
    for p in parts:
        raw = b"".join(hashlib.sha256(f"{j}:{p}".encode()).digest() for j in range(8))
        want += np.frombuffer(raw, ">u2")
    f = multiset_fingerprint
    state = f.insert(f.empty(), *parts)
    assert (state == want % 65536).all()
    assert (f.insert(f.empty(), *parts[::-1]) == state).all()
    assert (f.delete(f.insert(state, "z"), "z") == state).all()
    assert (f.merge(f.insert(f.empty(), "a", "b"), f.insert(f.empty(), "b", "é")) == state).all()
    assert (f.insert(f.empty(), "a", "b") != state).any()
    assert (f.from_hex(f.to_hex(state)) == state).all()


def test_fingerprints_over_awkward_rows(spark, awkward, empty):
    rows = multiset_fingerprint.equal_documents(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] is None and by[2]["same_as"] is None
    assert by[3]["n_paragraphs"] == 0 and set(by[3]["fingerprint"]) == {"0"}
    assert by[1]["n_equal"] == 2 and by[1]["same_as"] == 1
    assert multiset_fingerprint.equal_documents(empty).count() == 0
    two = frame(spark, ["x\ny\nz", "z\nx\n\ny", "x\ny"])
    same = {r["doc_id"]: r["same_as"] for r in multiset_fingerprint.equal_documents(two).collect()}
    assert same == {0: 0, 1: 0, 2: 2}


# 7 repetition rules


def brute_repetition(text: str, least: int) -> tuple[float, int]:
    w, size = repetition_rules.units(text)
    least *= size
    n, longest, covered = len(w), 0, [False] * len(w)
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                for x in (i, j):
                    covered[x : x + k] = [True] * k
    total = sum(map(len, w))
    return (sum(len(x) for x, c in zip(w, covered) if c) / total if total else 0.0), longest // size


def test_repetition_equals_brute_force():
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["x" * 80 + " y", "漢字仮名" * 30, "", "a b c d a b c d a b c d"]
    for got, t in zip(repetition_rules.measure(texts, 3), texts):
        assert got[:2] == (pytest.approx(brute_repetition(t, 3)[0]), brute_repetition(t, 3)[1])


def test_short_repeats_make_a_text_repetitive(spark):
    texts = [" ".join([w] * 5 + [x] * 5) for w, x in (("ment", "oueau"), ("it", "hast"))] + ["one line of six words here\nbetween\none line of six words here", "a text in which no words come again"]
    rows = {r["doc_id"]: r for r in repetition_rules.repetition(frame(spark, texts)).collect()}
    assert [rows[i]["keep"] for i in range(4)] == [False, False, False, True]
    assert rows[0]["covered_fraction"] == 1.0


def test_a_long_run_is_one_word():
    url = "https://example.org/" + "segment/" * 12
    for text in (f"one two {url} three four five {url} six", f"{'a' * 33} b c {'a' * 33} d e f g", f"{'a' * 32} b c {'a' * 32} d e f g"):
        assert repetition_rules.measure([text]) == [(0.0, 0, 0)]
    said = f"see {url} for more on this"
    assert repetition_rules.measure([f"{said} and {said}"])[0][1] == 6


def test_texts_without_white_space_are_taken_by_characters():
    plain = "".join(map(chr, range(0x4E00, 0x4E00 + 400)))
    assert repetition_rules.measure([plain]) == [(0.0, 0, 0)]
    assert repetition_rules.measure([plain[:23] + "、" + plain[:23] + plain[50:150]])[0][1] == 0
    covered, longest, n = repetition_rules.measure([plain[:24] + "、" + plain[:24]])[0]
    assert (covered, longest, n) == (48 / 49, 4, 1)
    assert repetition_rules.units("a" * 32)[1] == 1 and repetition_rules.units("a" * 33)[1] == repetition_rules.WORD_CHARS


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(12)
    for _ in range(40):
        w = [rng.choice("ab") for _ in range(rng.randint(1, 24))]
        n, least = len(w), 2
        subs = {}
        for i in range(n):
            for j in range(i + least, n + 1):
                subs.setdefault(tuple(w[i:j]), []).append(i)
        maximal = 0
        for s, at in subs.items():
            if len(at) > 1:
                left = {w[i - 1] if i else f"start{i}" for i in at}
                right = {w[i + len(s)] if i + len(s) < n else f"end{i}" for i in at}
                maximal += len(left) > 1 and len(right) > 1
        assert repetition_rules.measure([" ".join(w)], least)[0][2] == maximal


def test_repetition_over_awkward_rows(awkward, empty):
    rows = {r["doc_id"]: r for r in repetition_rules.repetition(awkward).collect()}
    assert rows[5]["keep"] is False and rows[5]["longest_repeat"] == 59_998
    assert all(rows[i]["keep"] and rows[i]["longest_repeat"] == 0 for i in (1, 2, 3, 4))
    kept = repetition_rules.unrepetitive(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 1
    assert repetition_rules.repetition(empty).count() == 0 and repetition_rules.unrepetitive(empty).count() == 0


# 8 SentencePiece


@pytest.fixture(scope="module")
def pieces():
    with open(sentencepiece_stream.MODEL, "rb") as f:
        return f.read()


def test_ids_equal_the_library_and_decode_to_the_text(pieces):
    import sentencepiece

    m = sentencepiece_stream.Model(pieces)
    encoder, library = sentencepiece_stream.Encoder(m), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_stream.MODEL)
    rng = random.Random(13)
    texts = ["".join(rng.choice(" \n\tabcdeth.,12é漢\U0001f600▁") for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["x" * 3000, "the cat " * 400]
    for t in texts:
        ids = encoder.encode(t)
        assert ids.tolist() == library.encode(t)
        assert m.decode_text(ids.astype(np.int64)) == t.replace("▁", " ")


def test_stream_holds_a_bounded_window(pieces):
    m = sentencepiece_stream.Model(pieces)
    s = sentencepiece_stream.StreamingViterbi(m)
    text = m.normalized("the cat sat on the mat and " * 2000)
    out = []
    for i in range(0, len(text), 1000):
        out += s.feed(text[i : i + 1000])
    out += s.finish()
    assert s.most_held < 20 * m.longest
    whole = sentencepiece_stream.StreamingViterbi(m)
    assert out == whole.feed(text) + whole.finish()


def field(number: int, value) -> bytes:
    """A field of a protocol-buffer message; lengths here are below 128."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return bytes([number << 3, value])
    return bytes([number << 3 | 2, len(value)]) + value


def unigram_model(scores: dict[str, float]) -> sentencepiece_stream.Model:
    pieces = [("<unk>", 0.0, 2), *((p, s, 1) for p, s in scores.items())]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    return sentencepiece_stream.Model(raw + field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 0) + field(4, 0)))


def best_path(m, text: str) -> tuple[float, list[int]]:
    """The greatest sum of scores over all ways to cut the text, and its ids, by trying each."""
    if not text:
        return 0.0, []
    found = []
    for n in range(1, min(len(text), m.longest) + 1):
        known = text[:n] in m.scores
        if known or n == 1:
            rest, ids = best_path(m, text[n:])
            found.append(((m.scores[text[:n]] if known else m.unknown_score) + rest, [m.ids[text[:n]] if known else m.unknown, *ids]))
    return max(found)


def test_unigram_ids_are_those_of_the_best_path():
    rng = random.Random(17)
    pieces = {"a": -2.0, "b": -2.5, "c": -3.1, "ab": -3.3, "bc": -3.7, "abc": -4.9, "ca": -4.4, "bca": -5.35, "aab": -5.65}
    m = unigram_model({p: s - rng.random() / 7 for p, s in pieces.items()})
    assert m.kind == sentencepiece_stream.UNIGRAM
    encoder = sentencepiece_stream.Encoder(m)
    for _ in range(150):
        t = "".join(rng.choice("abcx") for _ in range(rng.randint(0, 11)))
        assert encoder.encode(t).tolist() == best_path(m, t)[1]
    parts = [best_path(m, t) for t in ("abcab", "caabx", "bcabc")]
    # "x" is in no piece, so paths meet before and after it: long texts are their parts, one after the other.
    text = "xx".join(["abcab", "bcabc", "caab"] * 60)
    stream = sentencepiece_stream.StreamingViterbi(m)
    out, early = [], 0
    for i in range(0, len(text), 7):
        out += stream.feed(text[i : i + 7])
        early = max(early, len(out))
    want = [k for i, t in enumerate(text.split("xx")) for k in (([m.unknown] * 2 if i else []) + best_path(m, t)[1])]
    assert parts and out + stream.finish() == want
    assert early > 0.8 * len(want) and stream.most_held <= 8 * m.longest


def test_long_units_are_committed_as_they_are_read(pieces):
    import sentencepiece

    encoder = sentencepiece_stream.Encoder(sentencepiece_stream.Model(pieces))
    text = "abracadabra" * 2_000  # one unit, as there is no space
    committed = []
    commit = encoder.search._commit
    encoder.search._commit = lambda: committed.append(commit()) or committed[-1]
    assert encoder.encode(text).tolist() == sentencepiece.SentencePieceProcessor(model_file=sentencepiece_stream.MODEL).encode(text)
    assert sum(map(len, committed)) > 1_000 and encoder.search.most_held < 20 * encoder.model.longest


def test_sentencepiece_over_awkward_rows(awkward, empty):
    rows = sentencepiece_stream.encode_documents(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert (r["ids"] is None) == (r["n_ids"] is None) == (r["round_trip"] is None)
        assert r["ids"] is None or (r["round_trip"] and len(r["ids"]) == r["n_ids"])
    assert sentencepiece_stream.encode_documents(empty).count() == 0


# 9 sharding


def test_moves_stay_where_weights_changed(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = sharding.shard_documents(docs).collect()
    for r in rows:
        if r["moved"]:
            assert r["shard"].startswith("east/r1/") and r["next_shard"].startswith("east/r1/")
            assert r["shard"].endswith("s3") or r["next_shard"].endswith("s0")
        assert not r["next_shard"].endswith("east/r1/s3")
    share = Counter(r["region"] for r in rows)
    for name, w in (("east", 3), ("west", 2), ("north", 1)):
        assert share[name] / len(rows) == pytest.approx(w / 6, abs=0.015)


def test_sharding_over_awkward_rows(awkward, empty):
    rows = sharding.shard_documents(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.shard_documents(empty).count() == 0


# 10 language ID


def brute_code_length(samples: list[str], used: set[int], text: str) -> float:
    """Bits by escape method C with exclusion, from the definition."""
    counts = [{} for _ in range(4)]
    for s in samples:
        data = b"\n\n\n" + s.encode()
        for i in range(3, len(data)):
            for k in range(4):
                c = counts[k].setdefault(data[i - k : i], Counter())
                c[data[i]] += 1
    bits, data = 0.0, b"\n\n\n" + text.encode()
    for i in range(3, len(data)):
        context = data[i - 3 : i]
        # bytes of no sample stand for one symbol in contexts, so such a context is in no tree
        def chance(k: int) -> dict[int, float]:
            if k < 0:
                return {b: 1 / 256 for b in range(256)}
            shorter = chance(k - 1)
            c = counts[k].get(context[3 - k :])
            if not c:
                return shorter
            n, d = sum(c.values()), len(c)
            left = 1 - sum(shorter[b] for b in c)
            return {b: c[b] / (n + d) if b in c else d / (n + d) * shorter[b] / left for b in range(256)}

        bits -= math.log2(chance(3)[data[i]])
    return bits


def test_code_lengths_equal_the_definition():
    samples = {"a": ["the cat sat", "the hat\nthe"], "b": ["le chat était", "la"]}
    model = language_id.fit(samples)
    used = {b for ts in samples.values() for t in ts for b in t.encode()}
    for text in ("the cat", "le chat", "é", "zz%the", "a"):
        sizes, cost = language_id.code_lengths(model, [text])
        assert sizes[0] == len(text.encode())
        for k, name in enumerate(["a", "b"]):
            assert cost[0, k] / language_id.UNIT == pytest.approx(brute_code_length(samples[name], used, text), abs=0.01 * sizes[0] + 0.01)


def test_languages_of_held_out_texts(spark):
    rng = random.Random(14)
    words = {"aa": "bela dona mira sola tero luna".split(), "bb": "strk vlnt prst zgrm brnk smrt".split(), "cc": "ooh uueea iiaou eaoui aeiuo ueiao".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(language_id.sample(docs, 20))
    got = language_id.identify(docs.union(spark.createDataFrame([(999, "0123 4567 8910 %&/( 5555 1234", "aa")], docs.schema)), model).collect()
    assert all(r["predicted"] == r["lang"] for r in got if r["doc_id"] != 999)
    assert next(r for r in got if r["doc_id"] == 999)["keep"] is False


def test_language_over_awkward_rows(awkward, empty):
    rows = language_id.identify(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(not r["keep"] for r in rows if r["doc_id"] in (2, 3, 4))
    kept = language_id.known_languages(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r["keep"] for r in rows)
    assert language_id.identify(empty).count() == 0 and language_id.known_languages(empty).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert not any(r["keep"] for r in language_id.identify(unlabelled).collect())


# all of them


@pytest.mark.parametrize("name", ["brown_lm", "token_counts", "quality", "simhash", "packing", "fingerprint", "repetition", "sentencepiece", "sharding", "language"])
def test_ids_of_text_and_columns_of_other_case(spark, labels, name):
    docs = spark.createDataFrame([("a-1", "some words here", "en"), ("b-2", "some words here", "en"), ("c-3", None, None), (None, "", "de"), ("a-1", "some words here", "en")], "doc_id string, Text string, lang string")
    told = {
        "brown_lm": lambda: brown_lm.score(docs),
        "token_counts": lambda: token_counts.count_tokens(docs),
        "quality": lambda: quality_classifier.classify(docs, labels.withColumn("doc_id", F.lit("a-1"))),
        "simhash": lambda: simhash_dedup.groups(docs),
        "packing": lambda: packing.pack(docs),
        "fingerprint": lambda: multiset_fingerprint.equal_documents(docs),
        "repetition": lambda: repetition_rules.repetition(docs),
        "sentencepiece": lambda: sentencepiece_stream.encode_documents(docs),
        "sharding": lambda: sharding.shard_documents(docs),
        "language": lambda: language_id.identify(docs),
    }[name]()
    want = Counter({"a-1": 2, "b-2": 1, "c-3": 1, None: 1})
    if name == "simhash":
        want["a-1"] = 1
    if name == "packing":
        want -= Counter({"c-3": 1, None: 1})
    assert Counter(r["doc_id"] for r in told.collect()) == want
    if name in ("repetition", "language", "simhash"):
        kept = {"repetition": repetition_rules.unrepetitive, "language": language_id.known_languages, "simhash": simhash_dedup.deduplicate}[name](docs)
        assert kept.columns == docs.columns and kept.count() == {"repetition": 5, "language": 3, "simhash": 3}[name]
