"""The pipeline and the registered queries over a small folder of tables, against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import language_id, packing, queries, repetition_rules, simhash_dedup

LANGUAGES = {"aa": "bela dona mira sola tero luna vero pano", "bb": "strk vlnt prst zgrm brnk smrt hrdn krvt", "cc": "ooh uueea iiaou eaoui aeiuo ueiao oaeu iuea"}


def rows() -> list[tuple]:
    rng = random.Random(21)
    out, texts = [], []
    for i in range(240):
        lang = list(LANGUAGES)[i % 3]
        stems = LANGUAGES[lang].split()
        text = " ".join("".join(rng.choices(stems, k=4)) for _ in range(rng.randint(30, 90)))
        texts.append((text, lang))
    for i in range(0, 40, 2):  # near copies
        w = texts[i][0].split()
        w[rng.randrange(len(w))] = "otherword"
        texts.append((" ".join(w), texts[i][1]))
    texts += [texts[5]] * 3  # exact ones
    texts += [("la " * 300, "aa"), (" ".join(["mira sola tero luna vero pano bela dona mira tero"] * 20), "aa")]  # repetitive
    texts += [("%&$ 0912 #* {} 8837 \\\\ ~^ 5521 <> 7713 || 4402 @@ 9981", None), ("", "aa"), (None, "bb")]
    for i, (t, k) in enumerate(texts):
        out.append((i, t, k, f"s{i % 4}", len(t) if t is not None else 0))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def components(ids, fps, threshold):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [i for i in ids if fps[i] is not None]
    for x in known:
        for y in known:
            if y < x and np.bitwise_count(np.frombuffer(fps[x], np.uint64) ^ np.frombuffer(fps[y], np.uint64)).sum() <= threshold:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_stages_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = language_id.fit(language_id.sample(docs))
    told = {r[0]: r[1] for r in rows()}
    first = [i for i, t in told.items() if language_id.predict(model, [t])[0][0] is not None]
    second = [i for i in first if (lambda m: m[0] <= repetition_rules.MAX_COVERED and m[1] <= repetition_rules.MAX_LONGEST)(repetition_rules.measure([told[i]])[0])]
    fps = dict(zip(second, simhash_dedup.fingerprints_of([told[i] for i in second])))
    root = components(second, fps, simhash_dedup.THRESHOLD)
    third = [i for i in second if root[i] == i]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "SimHash near-dedup", "packing"]
    got = docs
    for name, want in (("language ID", first), ("quality rules", second)):
        got = stages[name](spark, got, tables)
        assert got.columns == docs.columns
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    left = stages["SimHash near-dedup"](spark, got, tables)
    assert left.columns == docs.columns
    kept = sorted(r["doc_id"] for r in left.collect())
    # The search is approximate: no document goes without a near copy that stays, and at least 0.95 of the copies go.
    assert set(third) <= set(kept)
    assert len(second) - len(kept) >= 0.95 * (len(second) - len(third))
    assert all(root[i] == i or not any(fps[i] == fps[j] for j in kept if j < i) for i in kept)
    third = kept
    assert docs.count() > len(first) > len(second) > len(third)
    final = corpus_pipeline.run(spark, tables).collect()
    chars = {}
    for r in final:
        chars[r["doc_id"]] = chars.get(r["doc_id"], 0) + r["length"]
    assert chars == {i: len(told[i]) for i in third}
    assert max(r["window_length"] for r in final) <= packing.CAPACITY


def copies_at_the_threshold(n: int) -> list[tuple]:
    """Rows of ``n`` texts in the languages, and after each a copy whose fingerprint is just within the threshold."""
    rng, texts = random.Random(41), []
    while len(texts) < 2 * n:
        lang = list(LANGUAGES)[len(texts) // 2 % 3]
        stems = LANGUAGES[lang].split()
        base = ["".join(rng.choices(stems, k=4)) for _ in range(80)]
        copies = []
        for _ in range(8):
            copy = list(base)
            for at in rng.sample(range(80), rng.randint(9, 13)):
                copy[at] = "".join(rng.choices(stems, k=4))
            copies.append(" ".join(copy))
        one, *others = (np.frombuffer(f, np.uint64) for f in simhash_dedup.fingerprints_of([" ".join(base), *copies]))
        good = [c for c, f in zip(copies, others) if 0 <= simhash_dedup.THRESHOLD - int(np.bitwise_count(one ^ f).sum()) <= 2]
        if good:
            texts += [(" ".join(base), lang), (good[0], lang)]
    return [(i, t, k, "s", len(t)) for i, (t, k) in enumerate(texts)]


def test_no_copy_at_the_threshold_stays(spark, tmp_path):
    told = copies_at_the_threshold(400)
    spark.createDataFrame(told, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, str(tmp_path))
    second = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert len(second) > 700
    fps = dict(zip(second, simhash_dedup.fingerprints_of([told[i][1] for i in second])))
    root = components(second, fps, simhash_dedup.THRESHOLD)
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert packed == {i for i in second if root[i] == i}
    assert 350 < len(packed) <= 450


def test_copies_without_a_word_go(spark, tmp_path):
    rng = random.Random(43)
    texts = [" ".join("".join(rng.choices("-.!?#*", k=rng.randint(4, 7))) for _ in range(60)) for _ in range(40)] + ["### $$$ |", "--!?"]
    near = [" ".join([*t.split()[:-1], "#?!"]) for t in texts[:10]]
    told = [(i, t, "aa", "s", len(t)) for i, t in enumerate([*texts, *near, *texts, *texts[-2:]])]
    spark.createDataFrame(told, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == len(told)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(len(texts)))


def test_stages_over_no_rows_and_columns_of_clashing_names(spark, tmp_path):
    columns = "doc_id string, text string, lang string, keep string, size long, fp string, word int, `count` int, n long, least string"
    some = [(f"d{i}", t, k, "x", 1, "y", 2, 3, 4, "z") for i, t, k, *_ in rows()[:60]] + [(None, None, None, None, None, None, None, None, None, None)] * 2
    for name, told in (("none", []), ("some", some)):
        spark.createDataFrame(told, columns).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, str(tmp_path / name))
            assert docs.columns == spark.read.parquet(str(tmp_path / name / "documents.parquet")).columns
        packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()}
        assert packed == {r["doc_id"] for r in docs.collect()} and (len(packed) > 20) == bool(told)


def test_every_query_runs_over_the_whole_table(spark, tables):
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}) == list(range(1, 11))
    ids = sorted(r[0] for r in rows())
    for name, f in queries.QUERIES.items():
        found = f(spark, tables)
        got = sorted(r["doc_id"] for r in found.select("doc_id").collect())
        if name == "op5_packing":
            assert set(got) == {r[0] for r in rows() if r[1]}
        else:
            assert got == ids, name


def test_sql_agrees(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet/*.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        df = queries.QUERIES[name](spark, tables)
        assert sorted(df.columns) == sorted(columns)
        assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, found.fetchall()))
