"""Operators against brute force, exact round trips and held-out accuracy, on small fixtures and edge cases."""

import json
import math
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from timberline.llm import chat, html_text, mixing, nearest, packing, simhash, token_counts, top_k, toxicity, url_filter
from timberline.llm.encoding import encoder
from timberline.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


ODD = ["", None, " ", "a", "A b", "\x00\x1c \t", "日本語 テキスト", "<|endoftext|> x", "it's 1.2  don't\n\n", "word " * 3000]


# ---- encoding, token counts


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_those_of_tokenizers(spark):
    ref, own = reference_tokenizer(), encoder(tokenizer_path())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t or "" for t in ODD]
    for t in texts:
        assert own.ids(t).tolist() == ref.encode(t, add_special_tokens=False).ids


def test_token_counts(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(3, "A b", "s")]
    got = token_counts.count_tokens(docs_of(spark, rows), tokenizer_path())
    ref = reference_tokenizer()
    n = sorted(len(ref.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    table = {r.length: r for r in got.collect()}
    assert sorted(table) == sorted(set(n))
    for length, r in table.items():
        assert (r.docs, r.tokens) == (n.count(length), length * n.count(length))
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= length for x in n), sum(x for x in n if x >= length))
        assert (r.docs_at_most, r.truncated) == (sum(x <= length for x in n), sum(min(x, length) for x in n))
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n)) and math.isclose(r.quantile, r.docs_at_most / len(n))
    asked = {r.context: r for r in token_counts.at_limits(got, [0, 2, 5, 10_000]).collect()}
    assert all(r.truncated == sum(min(x, c) for x in n) and r.docs_over == sum(x > c for x in n) for c, r in asked.items())
    assert token_counts.quantiles(got, [0.5, 1.0]).first().asDict() == {"q0.5": n[math.ceil(len(n) / 2) - 1], "q1": n[-1]}
    assert token_counts.count_tokens(docs_of(spark, []), tokenizer_path()).count() == 0


# ---- mixing


def water(sizes, weights, limit=3.0):
    total, full = float(sum(sizes)), set()
    while True:
        left = total - sum(limit * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        t = [limit * s if i in full else left * w / share for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        over = {i for i in range(len(sizes)) if i not in full and t[i] > limit * sizes[i]}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("sizes", [[10], [100, 1, 1], [1, 1, 1000], [5, 0, 7, 900, 3], [50, 50, 50, 50]])
def test_targets(spark, sizes):
    s = spark.createDataFrame([(chr(97 + i) if i else None, v) for i, v in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    names = sorted(k for k in got if k is not None) + [None]
    order = [0 if n is None else ord(n) - 97 for n in names]
    want = water([sizes[i] for i in order], [i % 3 + 1 for i in range(len(sizes))])
    assert all(math.isclose(got[n], w, abs_tol=1e-9) for n, w in zip(names, want, strict=True))


def test_mix_comes_near_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    rows += [(7, "same text here", "dup")] * 301 + [(None, "x y", "b")] * 50
    df = docs_of(spark, rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    one, two = (sorted(map(str, mixing.mix(x).collect())) for x in (df, df.repartition(5)))
    assert one == two
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        taken, biggest = sum(r.size * r.times for r in mine), max(r.size for r in mine)
        assert abs(taken - mine[0].target) <= biggest / 2 + 1e-6, s
        assert all(r.times <= 3 for r in mine)


def test_larger_budgets_hold_smaller_ones(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(300)]
    df = docs_of(spark, rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    small, large = ({r.doc_id: r.times for r in mixing.mix(df, share=s).collect()} for s in (0.3, 0.9))
    assert all(small[i] <= large[i] for i in small)


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(docs_of(spark, []).withColumn("size", F.lit(1))).count() == 0
    out = mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")]).withColumn("size", mixing.word_count(F.col("text")))).collect()
    assert [(r.size, r.target) for r in out] == [(0, 0.0), (0, 0.0)]


def test_repeated_rows_follow_the_mix_and_keep_columns(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 7 == 0]) for i in range(120)]
    df = docs_of(spark, rows).withColumn("_source", F.lit("clash")).withColumn("hash", F.lit(1))
    out = mixing.repeated(df)
    assert out.columns == df.columns
    times = {r.doc_id: r.times for r in mixing.mix(df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: t for i, t in times.items() if t}


def test_repeated_tells_rows_of_equal_id_and_size_apart_by_their_content(spark):
    rng = random.Random(3)
    rows = [(7, f"{rng.choice('abcdef')} {rng.choice('uvwxyz')} t", "dup") for _ in range(200)] + [(i, "w " * (1 + i % 5), "other") for i in range(100, 140)]
    df = docs_of(spark, rows).withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    runs = [sorted((r.doc_id, r.text) for r in mixing.repeated(x).collect()) for x in (df, df.repartition(7, "text"))]
    assert runs[0] == runs[1]
    by_id = mixing.targets(df.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size")))
    for r in by_id.collect():
        words = sum(len(t.split()) for i, t in runs[0] if (i == 7) == (r.source == "dup"))
        assert abs(words - r.target) <= 2.5


@pytest.mark.parametrize("n", [1, 9000])
def test_some_of_many_equal_rows_are_taken(spark, n):
    df = docs_of(spark, [(1, "a b c", "s")] * n + [(2, "x " * (2 * n), "t")])
    out = mixing.repeated(df).groupBy("doc_id").count().collect()
    want = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("s", 3 * n), ("t", 2 * n)], "source string, source_size long")).collect()}
    got = {r.doc_id: r["count"] for r in out}
    assert abs(3 * got[1] - want["s"]) <= 1.5 and abs(2 * n * got.get(2, 0) - want["t"]) <= n


# ---- nearest neighbours and exact top-k


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


BAD = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] * 8), (1004, [float("inf")] + [0.0] * 7), (1005, []), (None, [1.0] * 8)]


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    got: dict = {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        s = m @ m[np.searchsorted(ids, q)]
        assert all(math.isclose(v, s[np.searchsorted(ids, i)], abs_tol=1e-12) and i != q for _, i, v in rows)
        s[np.searchsorted(ids, q)] = -9
        hits += len({i for _, i, _ in rows} & set(ids[np.argsort(-s, kind="stable")[:5]]))
    assert hits / (5 * len(got)) >= 0.9


def test_nearest_edges(spark):
    rows = [(i, [1.0, 0.0] + [0.0] * 6) for i in range(10)] + [(50, [0.0, 1.0] + [0.0] * 6)] + BAD
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest.search(vectors_of(spark, rows)).collect())
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 3, 4, 5]  # ties to the smaller id
    assert len([g for g in got if g[0] == 50]) == 5 and {g[0] for g in got} == {0, 50}
    assert nearest.search(vectors_of(spark, BAD[:2])).count() == 0
    alone = nearest.search(vectors_of(spark, [(0, [1.0] * 8), (1, [1.0] * 8)]).withColumn("row", F.lit("x")).withColumn("list", F.lit(1))).collect()
    assert [(r.query_id, r.vec_id) for r in alone] == [(0, 1)]
    again = nearest.search(vectors_of(spark, [(0, [1.0] * 8), (1, [1.0] * 8), (1, [1.0] * 8), (0, [3.0] * 8)])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in again) == sorted([(0, 1, 0), (0, 2, 1), (0, 3, 1)] * 2)
    big = nearest.search(vectors_of(spark, [(0, [1e30] * 8), (1, [1e-30] * 8), (2, [1e30] * 7 + [-1e30])])).collect()
    assert [(r.query_id, r.vec_id, round(r.score, 9)) for r in sorted(big, key=lambda r: r.rank)] == [(0, 1, 1.0), (0, 2, 0.75)]


def test_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(700, 64)), rng.normal(size=64)
    whole = nearest.cosines(q, x)
    for _ in range(100):
        some = rng.choice(700, rng.integers(1, 40), replace=False)
        assert (nearest.cosines(q, x[some]) == whole[some]).all()


def test_copies_in_many_pieces_give_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PIECE", 50)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    monkeypatch.setattr(nearest, "LIST", 40)
    rng = np.random.default_rng(9)
    copy = rng.normal(size=32).tolist()
    rows = [(i, copy if i % 3 else rng.normal(size=32).tolist()) for i in range(1500)]
    got: dict = {}
    for r in nearest.search(vectors_of(spark, rows).repartition(13)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in got:
        if q % 3:
            assert [v for _, v in sorted(got[q])] == [1, 2, 4, 5, 7]


def test_recall_of_the_operator_on_clusters_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 64)
    rng = np.random.default_rng(10)
    centers = rng.normal(size=(150, 32))
    x = (centers[rng.integers(0, 150, 9000)] + 0.35 * rng.normal(size=(9000, 32))).astype(np.float32)
    df = vectors_of(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    made = nearest.plan(df, 50, 5, 0.7, 1.35)
    lists, share = made.postings.select("list").distinct().count(), made.share()
    assert lists >= 100 and share < 0.2
    got: dict = {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    m = nearest.unit(x.astype(float))
    hits = 0
    for q, ids in got.items():
        s = m @ m[q]
        s[q] = -9
        hits += len(ids & set(np.argsort(-s, kind="stable")[:5].tolist()))
    print(f"lists {lists}, share {share:.3f}, recall {hits / (5 * len(got)):.3f}")
    assert len(got) == 180 and hits / (5 * len(got)) >= 0.95


def test_recall_of_the_operator_without_clusters_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 20)  # 100 lists, so seven tenths of them are not all
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    share = nearest.plan(df, 50, 5, 0.7, 1.35).share()
    m = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect()}
    ids = np.array(sorted(m))
    x = nearest.unit(np.stack([m[i] for i in ids]))
    got: dict = {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = x @ x[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        hits += len(found & set(ids[np.argsort(-s, kind="stable")[:5]].tolist()))
    print(f"share {share:.3f}, recall {hits / (5 * len(got)):.3f}")
    assert hits / (5 * len(got)) >= 0.9


def test_lists_that_outgrow_a_task_are_divided(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 16)
    monkeypatch.setattr(nearest, "PIECE", 40)
    monkeypatch.setattr(nearest, "CENTROIDS", 30)  # of the first level, and of each list
    monkeypatch.setattr(nearest, "PAIRS", 64)
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(150, 32))
    x = (centers[rng.integers(0, 150, 6000)] + 0.35 * rng.normal(size=(6000, 32))).astype(np.float32)
    x[1::3] = x[1]  # a third of all rows are copies
    df = vectors_of(spark, [(i, v.tolist()) for i, v in enumerate(x)]).repartition(9)
    made = nearest.plan(df, 50, 5, 0.7, 1.35)
    sizes = made.postings.where("own").groupBy("list").count().toPandas()
    assert sizes["count"].sum() == 6000  # every row is filed, once as its own
    assert len(sizes) >= 200 and made.postings.select("row").distinct().count() == 6000
    assert sorted(sizes["count"])[-2] < 120  # only the copies' list stays large
    distinct = [i for i in range(0, 6000, 50) if i % 3 != 1]
    share, got = made.share(), {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    m = nearest.unit(x.astype(float))
    hits = 0
    for q in distinct:
        s = nearest.cosines(m[q], m)
        s[q] = -9
        hits += len({v for _, v in got[q]} & set(np.lexsort((np.arange(6000), -s))[:5].tolist()))
    print(f"lists {len(sizes)}, share {share:.3f}, recall {hits / (5 * len(distinct)):.3f}")
    assert set(got) == set(range(0, 6000, 50)) and all(len(v) == 5 for v in got.values())
    assert hits / (5 * len(distinct)) >= 0.95 and share < 0.2
    assert [v for _, v in sorted(got[100])] == [1, 4, 7, 10, 13]  # 100 is a copy: ties to the smaller id


def test_isolated_groups_get_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 3)  # many lists: a third of all vectors are centroids at first
    rng = np.random.default_rng(2)
    rows = [(i, [*(2 + rng.normal(size=8)).tolist(), *[0.0] * 30]) for i in range(400)]
    groups = {}
    for g in range(30):
        groups[g] = list(range(1000 + 10 * g, 1001 + 10 * g + g % 5))
        rows += [(i, [0.0] * (8 + g) + [1.0] + [0.0] * (29 - g)) for i in groups[g]]
    got: dict = {}
    for r in nearest.search(vectors_of(spark, rows), every=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == {i for i, _ in rows}
    for ids in groups.values():
        for i in ids:
            near = sorted(got[i])
            assert [r for r, _ in near] == [1, 2, 3, 4, 5]
            assert [v for _, v in near[: len(ids) - 1]] == [v for v in ids if v != i]


def test_balanced_lists_and_walk():
    x = nearest.unit(np.random.default_rng(0).normal(size=(3000, 16)))
    ix = nearest.fit(x, 24)
    size = np.bincount(ix.nearest(x, 1)[0][:, 0], minlength=24)
    assert size.max() < 3 * size.mean()
    for v in x[:40]:
        assert set(ix.walk(v, 6)[0][:3]) <= set(ix.nearest(v[None], 8)[0][0])


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "CANDIDATES", 150)
    monkeypatch.setattr(top_k, "QUERIES", 7)
    monkeypatch.setattr(top_k, "FIRST", 24)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rng.normal(size=8)]) for i in range(500)]
    rows += [(500 + i, rows[0][1]) for i in range(30)] + BAD  # many copies of one vector
    got: dict = {}
    for r in top_k.search(vectors_of(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([i for i, v in rows if i is not None and i < 1000])
    z = np.floor(64 * np.array([v for i, v in rows if i is not None and i < 1000], dtype=np.float32).astype(float)).astype(int)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, have in got.items():
        s = z @ z[list(ids).index(q)]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert sorted(have) == [(n + 1, int(ids[k]), int(s[k])) for n, k in enumerate(order)]


def test_top_k_leaves_candidates_out_by_their_bounds():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 8)) * 200
    x = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) for c in centers]))
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    ids = np.arange(len(x))
    out = list(top_k.block_top(ids[:5], x[:5], ids, x.view(Counted), x[::250], 20))
    assert len(out) == 5 and sum(seen) < 0.7 * 5 * len(x)
    s = np.asarray(x) @ x[0]
    assert out[0][1].tolist() == [int(k) for k in np.lexsort((ids, -s)) if k != 0][:20]


@pytest.mark.parametrize("far", [1e5, 1e9, 1e17])
def test_top_k_with_an_extreme_pivot(far):
    rng = np.random.default_rng(7)
    x = np.floor(64 * nearest.unit(rng.normal(size=(3000, 16))))
    ids = np.arange(3000, dtype=np.int64)
    pivots = np.floor(far * nearest.unit(rng.normal(size=(16, 16))))
    for i, got, score in top_k.block_top(ids[:40], x[:40], ids, x, pivots, 20):
        s = x @ x[i]
        s[i] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        assert got.tolist() == want.tolist() and score.tolist() == s[want].tolist()


def test_top_k_repeated_ids_overflow_and_no_rows(spark):
    rng = np.random.default_rng(12)
    rows = [(i % 90, [float(v) for v in rng.normal(size=6)]) for i in range(180)] + [(20, [0.5] * 6)] * 3 + [(None, [1.0] * 6)]
    got: dict = {}
    for r in top_k.search(vectors_of(spark, rows).withColumn("row", F.lit("x")).withColumn("cell", F.lit(1)), k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([i for i, _ in rows[:-1]])
    z = np.floor(64 * np.array([v for _, v in rows[:-1]], dtype=np.float32).astype(float)).astype(int)
    want: dict = {}
    for at in np.flatnonzero(ids % 20 == 0):
        s = z @ z[at]
        order = [k for k in np.lexsort((ids, -s)) if k != at][:7]
        want.setdefault(int(ids[at]), []).extend((n + 1, int(ids[k]), int(s[k])) for n, k in enumerate(order))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}
    assert top_k.search(vectors_of(spark, [])).count() == 0 and top_k.search(vectors_of(spark, BAD)).count() == 0
    with pytest.raises(Exception, match="exceed 2\\^53"):
        top_k.search(vectors_of(spark, [(0, [1e18] * 6), (1, [1.0] * 6)])).count()


def test_whole_cells_are_left_out_by_their_bounds():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8)) * 100
    rows = [(i, (centers[i % 12] + rng.normal(size=8)).tolist()) for i in range(1200)]
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(float))
    pivots = x[:12]
    near = top_k.distances(x, pivots)
    cell = near.argmin(1)
    cells = top_k.Cells(np.bincount(cell, minlength=12), np.array([(x[cell == c] ** 2).sum(1).max() for c in range(12)]), np.array([near[cell == c].min(0) for c in range(12)]), np.array([near[cell == c].max(0) for c in range(12)]))
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    kth = np.array([np.sort(score[i, cell == cell[i]])[-20] for i in range(len(x))])
    passes = cells.open((x * x).sum(1), near, kth)
    assert passes.mean() < 0.6
    for i in range(0, len(x), 7):  # no cell that is left out holds a row of the result
        best = np.argsort(-score[i], kind="stable")[:20]
        assert passes[i, cell[best]].all()


# ---- toxicity


def test_held_out_accuracy_and_misspellings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    scorer = toxicity.Scorer(model)
    got = np.array([scorer.score(r.text) >= 0.5 for r in rows])
    want = np.array([r.toxic == 1 for r in rows])
    assert (got & want).sum() >= 0.85 * want.sum()  # some rows are labelled toxic without any toxic word
    assert (got & ~want).sum() <= 0.03 * (~want).sum()
    assert scorer.score("the clownn and idiots of") > scorer.score("the anthing and others of")
    assert scorer.score("") == scorer.score(None) and 0 <= scorer.score("") < 0.5


def test_rows_of_words():
    some = ["a", "ab", "abc", "toxic", "toxci", "日本語", "x" * 3000, "abc", "\U0001f600b"]
    rows, sizes = toxicity.rows_of(some)
    at = 0
    for w, n in zip(some, sizes, strict=True):
        bound = f"<{w}>"
        grams = [bound, *(bound[i : i + k] for k in toxicity.GRAMS for i in range(len(bound) - k + 1) if k < len(bound))]
        assert n == len(grams) and rows[at : at + n].tolist() == toxicity.word_rows(w)  # whatever words stand beside it
        of = dict(zip(grams, rows[at : at + n].tolist(), strict=True))
        assert all(of[g] == r for g, r in zip(grams, rows[at : at + n].tolist(), strict=True))  # equal n-grams, equal rows
        at += n
    assert len(set(toxicity.word_rows("toxic")) & set(toxicity.word_rows("toxci"))) >= 3
    assert rows.min() >= 0 and rows.max() < toxicity.BUCKETS and at == len(rows)
    spread = np.unique(toxicity.rows_of([f"w{i}" for i in range(20000)])[0])
    assert len(spread) > 10000


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), -1.0)
    texts = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(rng.integers(0, 90))) for _ in range(60)] + ["", None, "!?", "y" * 5000]
    want = [toxicity.Scorer(model).score(t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 50)
    monkeypatch.setattr(toxicity, "CHARS", 64)
    few = toxicity.Scorer(model)
    assert few.scores(texts) == want and [few.score(t) for t in texts] == want


def test_toxicity_edges(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "you fool", None)]
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, rows).withColumn("score", F.lit("clash"))
    got = toxicity.judge(df, labels)
    assert got.count() == len(rows) and set(df.columns) <= set(got.columns)
    assert all(0 <= r.toxicity <= 1 for r in got.collect())
    none = toxicity.judge(df, labels.limit(0))
    assert {r.toxic for r in none.collect()} == {False}
    assert toxicity.judge(df.limit(0), labels).count() == 0
    assert toxicity.keep_clean(df, labels.limit(0)).columns == df.columns
    clash = df.withColumn("_id", F.lit(1)).withColumn("_toxic", F.lit("x")).withColumn("_text", F.lit(2.0)).withColumn("_toxicity", F.lit(9))
    assert toxicity.keep_clean(clash, labels).columns == clash.columns and toxicity.keep_clean(clash, labels).count() <= len(rows)
    again = toxicity.judge(df.union(df), labels).groupBy("doc_id", "text").agg(F.countDistinct("toxicity").alias("n"))
    assert {r.n for r in again.collect()} == {1}


def brute_score(model, text):
    w = toxicity.words(text)
    if not w:
        return 1 / (1 + math.exp(-model.bias))
    logits = []
    for at in range(len(w)):
        rows = [r for x in w[at : at + toxicity.WINDOW] for r in toxicity.word_rows(x)]
        logits.append(model.bias + sum(float(model.rows[r]) for r in rows) / len(rows))
    return 1 / (1 + math.exp(-max(-60, min(60, max(logits)))))


def test_scores_equal_a_plain_average_of_rows_in_every_window(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in list(texts.items())[:60]:
        assert math.isclose(got[i], brute_score(model, t), rel_tol=1e-3, abs_tol=1e-6)


def test_no_row_is_left_out_of_the_fit_for_its_length():
    rows = [("calm words of no harm at all here", 0)] * 30 + [("word " * 40_000 + "vile moron", 1), ("x " * 3, 1), ("", 1), (None, 0)]
    tokens, doc, label, vocabulary = toxicity.sample_windows(rows, 500, 1)
    assert len(label) == 32 and set(doc.tolist()) == set(range(32)) and len(tokens) <= 500 and tokens.shape[1] == toxicity.WINDOW
    for sizes, total in ([[1, 5, 9], 9], [[3, 3], 100], [[10, 10], 4], [[], 5]):
        c = toxicity.allowance(np.array(sizes, dtype=int), total)
        assert c >= 1 and sum(min(x, c) for x in sizes) <= max(total, len(sizes)) and (not sizes or c >= max(sizes) or sum(min(x, c + 1) for x in sizes) > total)


def test_a_word_far_down_a_long_text_counts():
    rows = [("good words here and there", 0), ("plain talk of things", 0), ("you vile moron there", 1), ("a moron again", 1)] * 20
    scorer = toxicity.Scorer(toxicity.fit(rows))
    assert scorer.score("plain talk of things " * 2000 + "moron") > 0.5 > scorer.score("plain talk of things " * 2000)


# ---- chats


def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def call(i, name="search", args=None, after=()):
    return {"id": i, "name": name, "arguments": {"query": "q"} if args is None else args, "after": list(after)}


def test_links_order_validation_and_canonical_json(spark):
    turn = json.dumps({"content": "wait", "tool_calls": [call("b", args={"limit": 2, "query": "x\n\"é"}, after=["a"]), call("a"), call("c", "nope"), call("d", args={"limit": "2", "z": 1})]})
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "early"})), (1, 2, "assistant", turn), (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": None})),
        (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "again"})), (1, 5, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (2, 0, "assistant", json.dumps({"tool_calls": [call("a")]})), (2, 1, None, None), (2, 2, "assistant", "{no json"),
    ]
    got = chat.format_chats(chat_rows(spark, rows)).orderBy("conv_id", "at_turn", "at_kind", "at_level", "at_place", "turn").collect()
    assert [(r.conv_id, r.turn) for r in got] == [(1, 0), (1, 2), (1, 1), (1, 4), (1, 3), (1, 5), (2, 0), (2, 1), (2, 2)]
    for r in got:
        m = json.loads(r.message)
        assert r.message == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    calls = json.loads(got[1].message)["tool_calls"]
    assert [c["id"] for c in calls] == ["a", "c", "d", "b"] and calls[3]["arguments"] == {"limit": 2, "query": 'x\n"é'}
    assert got[1].errors.split() == ["c=no_result", "c=unknown_tool", "d=missing:query", "d=no_result", "d=type:limit", "d=unexpected:z"]
    assert [r.errors for r in got[2:6]] == ["", "repeated_result", "", "orphan_result"]
    assert got[6].errors == "a=no_result" and json.loads(got[7].message) == {"content": None, "role": None}


def test_cycles_duplicates_and_bad_arguments(spark):
    turn = {"tool_calls": [call("a", after=["b"]), call("b", after=["a"]), call("c", after=["a", "gone"]), call("e", after=["gone"]), call("e"), {"id": None, "name": "search", "arguments": "[1]"}]}
    got = chat.format_chats(chat_rows(spark, [(1, 0, "assistant", json.dumps(turn))])).first()
    errors = got.errors.split()
    assert {"a=cycle", "b=cycle", "c=cycle", "e=duplicate_id", "=invalid_json", "=no_id"} <= set(errors) and "e=cycle" not in errors
    assert chat.format_chats(chat_rows(spark, [])).count() == 0


def test_most_derived_messages_are_linked(spark):
    rows = QUERIES["chat_tool_calls"](spark, SF).collect()
    kinds = [r.at_kind for r in rows]
    assert sum('"tool_calls"' in r.message for r in rows) + kinds.count(1) > len(rows) / 2 and max(r.at_level for r in rows) >= 2
    assert any("type:expression" in r.errors for r in rows) and any("no_result" in r.errors for r in rows)


def test_chats_with_repeated_rows_and_clashing_columns(spark):
    turn = json.dumps({"tool_calls": [call("a")]})
    rows = [(1, 0, "assistant", turn)] * 2 + [(1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "x"}))] * 2 + [(None, None, "user", "y" * 200_000)]
    df = chat_rows(spark, rows).withColumn("c", F.lit(1)).withColumn("row", F.lit("z")).withColumn("_conv", F.lit(2))
    got = chat.format_chats(df).collect()
    assert sorted(r.errors for r in got) == ["", "", "", "a=duplicate_id", "repeated_result"]
    assert max(len(r.message) for r in got) > 200_000


# ---- packing


def check_packing(got, texts, length, end):
    ref = reference_tokenizer()
    ids = {i: ref.encode(t or "", add_special_tokens=False).ids + [end] for i, t in texts.items()}
    spans, seqs = {}, {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids)))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(spans) == set(ids)
    for i, parts in spans.items():
        assert b"".join(p[2] for p in sorted(parts)) == np.array(ids[i], dtype="<u4").tobytes()
        at = 0
        for start, n, _ in sorted(parts):
            assert start == at
            at += n
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return seqs


def test_every_id_lies_in_one_piece(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = packing.pack(df, tokenizer_path()).collect()
    seqs = check_packing(got, texts, 2048, 1)
    short = [s for s in seqs.values() if sum(n for _, n in s) < 2048]
    assert len(short) <= 8


def test_packing_edges(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)]
    got = packing.pack(docs_of(spark, rows), tokenizer_path(), length=16).collect()
    check_packing(got, {i: t for i, t, _ in rows}, 16, 1)
    twice = packing.pack(docs_of(spark, [(1, "a b c", "s")] * 3 + [(None, "x", "s")]), tokenizer_path()).collect()
    assert len([r for r in twice if r.doc_id == 1 and r.start == 0]) == 3 and any(r.doc_id is None for r in twice)
    assert packing.pack(docs_of(spark, []), tokenizer_path()).count() == 0
    digest = packing.digests(packing.pack(docs_of(spark, [(1, "a b", "s")]), tokenizer_path())).first()
    want = np.array(reference_tokenizer().encode("a b", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
    assert digest.ids_crc32 == zlib.crc32(want)


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_neighbours_are_one_step_apart(dims):
    bits = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# ---- HTML


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
      <nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Title &amp;&nbsp;more</h1><p>First   one<br>goes on.<p><b>Second</b> &lt;x&gt;
      <div class="ad">Buy this now</div><p>Hi.</p></article><aside>Related</aside><form><label>Mail</label></form><section id="comments"><p>Nice post!</p></section><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst one goes on.\n\nSecond <x>\n\nHi."


def test_pages_equal_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<b>", "").replace("<br>", " ")
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("inside", ["<math><mi>E</mi>=<mi>m</mi></math>", "<object data='x'>E=m</object>", "<noscript>E=m</noscript>", "<svg><path d='M0'/><text>E=m</text></svg>", "<canvas>E=m</canvas>", "<video><source src='v'>E=m</video>", "<audio>E=m", "<template>E=m</template>"])
def test_formulas_and_fallbacks_are_judged(inside):
    page = f"<body><article><p>The well known law, found long ago, says that {inside} holds, in a sentence that is long enough.</p><p>More text, after it, is kept as well, as it should be.</p></article></body>"
    got = html_text.main_text(page)
    assert "E=m" in got and "More text, after it" in got


def test_odd_pages(spark):
    odd = [None, "", "<", "plain", "<p>a<p>b", "</div></p>x", "<script>never closed <p>x", "<!-- open", "<a b='>'>t</a>", "<nav>m</nav>", "<p>" * 3000 + "x"]
    df = spark.createDataFrame([(i, h, "c") for i, h in enumerate(odd)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[0] == got[1] == got[6] == got[7] == got[9] == "" and got[4] == "a\n\nb" and got[3] == "plain" and got[10] == "x"


PROSE = "<p>The well known law, found long ago, says that this holds, in a sentence that is long enough to count.</p><p>More text, after it, is kept as well, as it should be.</p>"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar"><article>%s</article><div class="sidebar"><p>Other things to read that are long enough to look like prose.</p></div></div>', '<main class="no-sidebar">%s</main>', '<article class="post comments-open category-ads">%s</article>',
        '<article><div class="tags">%s</div></article>', '<article>%s<div class="tags"><a href=x>one</a> <a href=y>two</a></div></article>', '<div class="sidebar-right"><main>%s</main></div>', '<div>%s</div><div id="comments"><article class="comment"><p>Nice post!</p></article></div>',
        '<article>%s<div class="ad">Buy this long advert text now, it is really great and you would never want to miss the chance to get it, we are sure of it.</div></article>', '<main><article>%s<div class="cookie-notice"><p>We use cookies.</p></div></article></main>',
        '<div>%s</div><section class="comments"><article><p>' + "Nice post, a very long comment on all of it, and more. " * 9 + "</p></article></section>",
    ],
)
def test_layout_words_flags_and_weak_signs(page):
    text = "\n\n".join(x for x in PROSE.replace("</p>", "").split("<p>") if x)
    assert html_text.main_text(page % PROSE) == text


@pytest.mark.parametrize("unit", ["<a ", '<a ="> "', "<a x='", "<h1>", "<", "<!--", "</p>", "<script>", "<p><button>", "<i>", '<a b="', "&", "<p>x</p><div class=ad>y</div>"])
def test_a_megabyte_of_broken_markup_takes_linear_time(unit):
    def took(n):
        start = time.process_time()
        html_text.main_text(unit * (n // len(unit)))
        return time.process_time() - start

    assert took(1_000_000) < 20 * took(100_000) + 0.5


def test_long_pages_repeated_rows_and_no_rows(spark):
    long = "<article>" + "<p>A paragraph of a long page, as it may be, which goes on.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, long), (1, long), (None, "<p>x</p>"), (2, "<p>" + "w" * 300_000)], "page_id long, html string")
    got = html_text.extract(df).collect()
    assert sorted(len(r.text) for r in got) == [1, 300_000, 20_000 * 58 - 2, 20_000 * 58 - 2]
    assert html_text.extract(df.limit(0)).count() == 0


def test_minimum_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(keep, costs=costs, edges=edges):
            return sum(c for c, k in zip(costs, keep, strict=True) if c > 0 and not k) + sum(-c for c, k in zip(costs, keep, strict=True) if c < 0 and k) + sum(w for i, j, w in edges if keep[i] != keep[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html_text.minimum_cut(costs, edges)), best, abs_tol=1e-6)


# ---- URLs


def url_rows(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q", "https://example.org/en/12#t", "http://example.org/en/2", "http://myexample.org/es/1", "ftp://x.com/fr/", "http://com/de/", "http://x.net", None, "no url", "http://org?x", "a://b://c/d"]
    got = {r.page_id: r for r in url_filter.judge(url_rows(spark, urls)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("myexample.org", "/es/1", "org/"), ("x.com", "/fr/", "com/fr/"), ("com", "/de/", "com/de/"),
        ("x.net", "", None), ("", "", None), ("", "", None), ("org", "", None), ("b:", "//c/d", None),
    ]
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", "allow", "block"]
    assert url_filter.judge(url_rows(spark, [])).count() == 0


def verdicts(spark, urls, rules):
    return {r.page_id: r for r in url_filter.judge(url_rows(spark, urls), rules).collect()}


def test_templates_generalise_and_reject_by_purity(spark):
    rules = (("block", "s.net", "/bad/1"), ("allow", "s.net", "/good/1"))
    urls = [f"http://s.net/bad/{100 + i}" for i in range(30)] + [f"http://s.net/good/{100 + i}" for i in range(30)] + [f"http://s.net/u{chr(97 + i)}x/{i}" for i in range(20)]
    got = verdicts(spark, [*urls, "http://s.net/bad/7", "http://s.net/good/7"], rules)
    assert got[80].template == "/bad" and got[80].rule is None and got[80].verdict == "block"
    assert got[81].template == "/good" and got[81].verdict == "allow" and got[61].template == "/?"


@pytest.mark.parametrize("above", ["/a/b/c", "/a/b/c/d/e", "/" + "/".join("abcdefghijkl")])
def test_a_segment_at_any_depth_tells_verdicts_apart(spark, above):
    rules = (("block", "s.net", above + "/bad/1"), ("allow", "s.net", above + "/good/1"))
    urls = [f"http://s.net{above}/{k}/{100 + i}" for k in ("bad", "good") for i in range(30)] + [f"http://s.net{above}/{k}/{i}" for k in ("bad", "good") for i in range(20, 40)]
    got = verdicts(spark, urls, rules)
    assert all(got[i].verdict == ("block" if "/bad/" in u else "allow") for i, u in enumerate(urls))


def test_a_small_part_of_a_hot_host_keeps_its_template(spark):
    rules = (("block", "hot.net", "/spam/1"), ("allow", "hot.net", "/s"))
    urls = [f"http://hot.net/s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/{i}" for i in range(3000)] + [f"http://hot.net/spam/1{i}" for i in range(20)] + ["http://hot.net/zz/1"]
    got = verdicts(spark, urls, rules)  # 20 of 3020 labels: below 1% of the host
    assert got[3000].template == "/spam" and got[3000].purity > 0.5 and got[3020].verdict == "allow" and got[3020].template == "/?"


def test_each_label_counts_once(spark):
    rules = (("block", "m.net", "/de/"), ("allow", "m.net", "/fr/"))
    urls = [f"http://m.net/de/{i}" for i in range(15)] + [f"http://m.net/fr/{i}" for i in range(7)] + [f"http://m.net/{x}/{i}" for x in ("en", "es") for i in range(20)]
    got = verdicts(spark, urls, rules)
    prior = url_filter.EVEN  # no other host has labels
    host = (15 + 4 * prior) / (22 + 4)
    assert got[0].template == "/de" and got[15].template == "/fr"
    assert math.isclose(got[0].purity, (15 + 4 * (0 + 4 * prior) / (7 + 4)) / (15 + 4)) and math.isclose(got[15].purity, (0 + 4 * (15 + 4 * prior) / (15 + 4)) / (7 + 4))
    assert {got[i].template for i in range(22, 62)} == {"/?"} and all(math.isclose(got[i].purity, host) for i in range(22, 62))


def test_shapes_long_urls_repeats_and_odd_columns(spark):
    urls = ["http://x.net/e5/123abc/deadbeef01/0123-4567-89ab/12345678", "http://x.net/" + "a" * 10_000, "http://x.net/" + "a1" * 5_000, "http://x.net" + "/s" * 3000, "http://x.net/" + "0" * 10_000 + "g"] + ["http://x.net/a"] * 2
    start = time.time()
    df = spark.createDataFrame([(i if i < 6 else None, u, i, "x") for i, u in enumerate(urls)], "page_id long, url string, n int, template string")
    got = url_filter.judge(df).collect()
    assert len(got) == 7 and time.time() - start < 60
    shape = spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.shape_of(url_filter.path_of(F.col("u"))).alias("s")).collect()
    assert [r.s for r in shape[:3]] == ["/e{n}/{n}abc/{h}/{h}/{n}", "/" + "a" * 10_000, "/{h}"] and shape[4].s == "/{n}g"


# ---- SimHash


def brute(texts, distance=3):
    fp = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return fp, {i: find(i) for i in texts}


def test_fingerprint_by_hand():
    words = "A b  c\td é".encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 1.5)
    assert simhash.fingerprint("A b  c\td é") == want
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint("") == simhash.fingerprint(None) == 0


def test_fingerprint_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("the same é")).alias("h")).first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest("the same é".encode(), 42)


def test_golay_tables():
    table = simhash.golay_table()
    assert (table >= 0).all() and np.bincount(table).tolist() == [2048] * 4096  # perfect: every word within 3 of one codeword


def test_three_errors_share_a_key():
    rng = random.Random(6)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        _, kx = simhash.keys(np.array([x], dtype=np.uint64))
        _, ky = simhash.keys(np.array([y], dtype=np.uint64))
        assert set(kx.tolist()) & set(ky.tolist())


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)  # large groups are cut
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(500)]
    texts = {}
    for i in range(120):
        texts[i] = " ".join(rng.choices(vocab, k=rng.randint(0, 60)))
    base = " ".join(rng.choices(vocab, k=400)).split()
    for i in range(120, 420):  # a cloud of near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts[i] = " ".join(w)
    texts |= {500: None, 501: "", 502: " \t", 503: texts[3]}
    fp, comp = brute(texts)
    got = simhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in texts.items()])).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == fp
    assert {r.doc_id: r.component_id for r in got} == comp
    assert len(set(comp.values())) < 250


def test_one_of_each_and_edges(spark):
    rows = [(5, "a b c d", "s"), (3, "a b c d", "s"), (3, "a b c d", "t"), (None, "a b c d", "s"), (None, "z y x", "s"), (None, "z y x", "s"), (9, None, "s")]
    df = docs_of(spark, rows).withColumn("_id", F.lit(1)).withColumn("root", F.lit(2))
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r.source) for r in out.collect()) == [("3", "a b c d", "s"), ("9", None, "s"), ("None", "z y x", "s")]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0
    maps = df.withColumn("_hash1", F.create_map(F.lit("k"), F.col("source"))).withColumn("_row", F.array(F.lit(None).cast("int")))
    assert simhash.one_of_each(maps).columns == maps.columns and simhash.one_of_each(maps).count() == 3
    assert sorted(map(str, simhash.one_of_each(df.union(df)).collect())) == sorted(map(str, out.collect()))
