"""Near-duplicates against all pairs, mixing against sorting, the pipeline's stages."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from voxelry.llm import components, mixing, near_dedup
from voxelry.llm.queries import QUERIES, SQL

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def by_hand(rows):
    """Smallest reachable id over all pairs."""
    s = {i: sets_of(t) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s[i]), find(i)) for i in ids}


def family(n, seed, words=60):
    """A text and copies with more and more words changed, so that similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, words)] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w) if k % 3 else " ".join(w).upper())
    return out


def test_against_all_pairs(spark):
    texts = family(40, 1) + family(30, 2, 25) + ["", None, " \n\t", "a b", "A  b", "b a", "one two three four five", "one two three four five six", "x " * 500, "x " * 700] + ["same text here for all of us to see"] * 20
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int").repartition(5)
    want = by_hand(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 40
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == want
    left = near_dedup.deduplicated(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()})


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.deduplicated(df).count() == 3


def test_one_id_with_different_texts(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, a), (1, b), (2, b), (3, a), (5, a + " more"), (6, b + " more"), (7, "x y z u v w"), (7, "nothing in common with it at all")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _dup string")
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 7), (7, 7)]
    left = near_dedup.deduplicated(df)
    assert left.columns == df.columns and sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, a), (1, b), *rows[-2:]])
    again = df.unionByName(df.filter("doc_id = 7")).unionByName(spark.createDataFrame([(9, "", "x"), (9, "", "x")], df.schema))
    assert sorted(r.doc_id for r in near_dedup.deduplicated(again).collect()) == [1, 1, 7, 7, 9, 9]


def templated(n, words, own, seed):
    """Texts of one template, each with ``own`` words of its own at the end: all pairs are as similar as one another."""
    rng = np.random.default_rng(seed)
    base = " ".join(f"t{x}" for x in rng.integers(0, 10**6, words - own))
    return [f"{base} " + " ".join(f"u{k}x{j}" for j in range(own)) for k in range(n)]


def test_templates_below_the_threshold_do_not_meet(spark):
    texts = templated(2000, 120, 24, 3)  # (96 - 4) / (116 + 24): 0.66, no link
    assert 0.6 < len(sets_of(texts[0]) & sets_of(texts[1])) / len(sets_of(texts[0]) | sets_of(texts[1])) < 0.7
    linked = templated(40, 120, 10, 3)  # linked with each other, not with those above
    rows = list(enumerate(texts + linked))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: min(i, 2000) for i in range(2040)}


def test_rare_pairs_lose_nothing(spark):
    texts = family(60, 11, 40) + family(60, 12, 30) + templated(30, 60, 8, 5) + templated(30, 60, 5, 5) + ["x " * k + "y z" for k in range(20)] + ["a b", "a c", "a b c"]
    s = [sets_of(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    met = {(r.a, r.b) for r in near_dedup.rare_pairs(df.select("id", near_dedup.F.col("id").alias("c")), df).collect()}
    true = {(a, b) for a in range(len(s)) for b in range(a + 1, len(s)) if 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])}
    assert true <= met and len(true) > 300 and len(met) < len(s) * (len(s) - 1) / 4


def test_hot_keys_are_looked_up(spark):
    from voxelry.llm.shared import looked_up

    rows = spark.createDataFrame([(k, i) for k, m in (("a", 40), ("b", 3), ("c", 1)) for i in range(m)] + [("d", 0)], "k string, i int")
    found = spark.createDataFrame([("a", 40, "A"), ("b", 3, "B"), ("c", 1, None)], "k string, n long, v string")
    for most in (0, 1, 10):
        got = looked_up(rows, found, ["k"], "n", most).collect()
        assert len(got) == 45 and all(r.v == {"a": "A", "b": "B"}.get(r.k) for r in got)


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    for share in (0.6, 0.75, 0.9):
        gaps = []
        for _ in range(30):
            n = 400
            common = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share))).astype(np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common)).astype(np.uint64)])) for _ in range(2))
            x, y = (near_dedup.odd_sketch(near_dedup.samples(s)) for s in (a, b))
            gaps.append(sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y))
        assert abs(np.mean(gaps) - near_dedup.most_ones(share)) < 12
        if share >= 0.75:
            assert max(gaps) <= near_dedup.most_ones(near_dedup.SIEVE)


def test_bitmap_bound_loses_nothing(spark):
    texts = family(25, 7) + family(25, 8, 30)
    s = [sets_of(t) for t in texts]
    hashed = list(near_dedup.shingle_sets(near_dedup.split_words(pa.array(texts, pa.large_string()), lower=True)))
    df = spark.createDataFrame([(i, len(h), near_dedup.bitmap(h).tolist()) for i, h in enumerate(hashed)], "i int, n long, bits array<long>")
    both = df.toDF("a", "n_a", "bits_a").crossJoin(df.toDF("b", "n_b", "bits_b")).filter("a < b")
    passed = {(r.a, r.b) for r in both.filter(near_dedup.may_link("n_a", "n_b", "bits_a", "bits_b")).collect()}
    true = {(a, b) for a in range(50) for b in range(a + 1, 50) if 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])}
    assert true <= passed and len(true) > 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (150, 200), (150, 120), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 120, 150, 200)}


# --- mixing


def targets(sizes, weights, share, most):
    """Reshare the excess until none is above."""
    total, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        t = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if t[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else t[i] for i in range(len(sizes))]
        capped |= over


def test_targets(spark):
    for sizes in ([100, 100, 100], [10, 500, 3, 900], [0, 5, 0], [7], [1000, 1, 1, 1, 1]):
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "_mix_source string, _mix_size long")
        got = {r[0]: r[2] for r in mixing.targets_of(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
        assert np.allclose([got[f"s{i}"] for i in range(len(sizes))], want)


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(n), ["a", "b", None, "É"][int(s)], 3) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 800), rng.choice(4, 800, p=[0.5, 0.3, 0.1, 0.1]), strict=True))] + [(9000, None, "a", 3), (9000, None, "a", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mixture(df).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    for (_, target), g in out.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= 60 and g["size"].sum() == g.source_size.iloc[0]
    again = mixing.mixture(df.repartition(7)).toPandas()
    assert out.sort_values(["doc_id", "size"]).taken.tolist() == again.sort_values(["doc_id", "size"]).taken.tolist()
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    assert sum(len((r.text or "").split()) for r in mix.collect()) == out.taken.sum()
    assert mixing.mixture(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall())


def test_pipeline(spark):
    import corpus_pipeline
    from voxelry.llm.shared import materialize

    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == start.columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3]
    ids = {r.doc_id for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == ids
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in last)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated ids and rows, an empty table and columns named like the operators' own."""
    import corpus_pipeline
    from voxelry.llm.shared import materialize

    names = ["_lost", "_dup", "of", "row", "kept", "_mix_n2", "component", "best"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.orderBy(-near_dedup.F.length("text")).first()
    odd = [(None, None, None, None, None), (None, one.text, "en", None, 1), (one.doc_id, "", "en", one.source, 0), (one.doc_id, one.text, one.lang, one.source, 1), (one.doc_id, one.text, one.lang, one.source, 1), (10**9, "word " * 200_000, "en", None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({n: near_dedup.F.lit(n) for n in names})
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, materialize(stage(spark, kept, f"file://{tmp_path}"), name)
        assert kept.columns == before.columns and kept.exceptAll(before.unionByName(before)).count() == 0
        if name == "near_dedup":
            assert kept.filter(near_dedup.F.col("doc_id") == one.doc_id).count() <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, kept, f"file://{tmp_path}").count() > 0
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = materialize(stage(spark, none, SF), name)
        assert none.count() == 0 and none.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0
