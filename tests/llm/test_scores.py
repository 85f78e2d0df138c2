"""Language-model scores, quality rules and language identification."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from voxelry.llm import language_id, lm_scoring, quality_forest
from voxelry.llm.queries import op2_lm_scoring, op10_quality_forest, page_language
from voxelry.llm import text as text_module
from voxelry.llm.text import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trie(text, depth=2):
    grams, n = lm_scoring.run_counts(pa.array(text, pa.large_string()), depth)
    return lm_scoring.Trie(grams, n, depth)


def ppm_by_hand(training, text, depth):
    """Method D with exclusion, symbol by symbol."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    for t in training:
        s = b"\xff" * depth + t.encode() + b"\xff"
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    total, s = 0.0, b"\xff" * depth + text.encode() + b"\xff"
    for i in range(depth, len(s)):
        gone = set()
        for k in range(depth, -1, -1):
            seen = {b: n for b, n in counts[k].get(s[i - k : i], {}).items() if b not in gone}
            if not seen:
                continue
            if s[i] in seen:
                total += math.log10((seen[s[i]] - 0.5) / sum(seen.values()))
                break
            total += math.log10(len(seen) / 2 / sum(seen.values()))
            gone |= set(seen)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_ppm_against_brute_force():
    training, texts = ["abracadabra", "abc abc", "", "aé"], ["abra", "", "zzz abd", "aéab"]
    for depth in (1, 2, 3):
        t = trie(training, depth)
        grams, sizes = lm_scoring.runs(pa.array(texts, pa.large_string()), depth)
        cost = np.split(t.cost(grams), np.cumsum(sizes)[:-1])
        for text, c in zip(texts, cost, strict=True):
            assert math.isclose(c.sum(), ppm_by_hand(training, text, depth), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    t = trie(["the cat sat on the mat", "then"], 3)
    for context in (b"the", b"\xff\xff\xff", b"zzz", b" th"):
        x = int.from_bytes(context, "big") << 8
        assert math.isclose((10 ** t.cost(np.arange(256, dtype=np.uint64) + np.uint64(x))).sum(), 1, rel_tol=1e-9)


def test_lookup():
    keys = np.random.default_rng(0).integers(0, 1 << 48, 5000).astype(np.uint64)
    keys = np.unique(keys)
    find = lm_scoring.Lookup(keys)
    at, there = find(np.concatenate([keys, keys + np.uint64(1)]))
    assert there[: len(keys)].all() and (at[: len(keys)] == np.arange(len(keys))).all()
    assert (there[len(keys) :] == np.isin(keys + np.uint64(1), keys)).all()


DOCS = [(i, t) for i, t in enumerate(["The cat. the CAT", "", None, " \n", "dog É é", "the the the", "unseen word here", "a b c d e", "x"] * 3)] + [(None, "null id"), (3, "twice"), (3, "twice")]


def base_by_hand(rows):
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    words = [(i, WORD.findall((t or "").translate(A_Z)) + [None]) for i, t in rows]
    count = collections.Counter(w for i, ws in words if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(((i if i is not None else -1), held[i], len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)


@pytest.mark.parametrize("frequent", [3, 1000])
def test_base_scores(spark, frequent):
    df = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, score int")
    rows = lm_scoring.scores(df, depth=2, frequent=frequent).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == base_by_hand(DOCS) and all(r.score < 0 for r in rows)
    assert lm_scoring.scores(df.limit(0)).count() == 0


def test_long_texts_in_windows():
    texts = pa.array(["ab", "", "The quick brown É fox " * 50, "x" * 700, "z"], pa.large_string())
    whole, sizes = lm_scoring.runs(texts, 4)
    for limit in (16, 100, 10_000):
        parts = list(lm_scoring.run_windows(texts, 4, limit))
        assert (np.concatenate([p for p, _ in parts]) == whole).all() and (np.concatenate([r for _, r in parts]) == np.repeat(np.arange(5), sizes)).all()


@pytest.mark.parametrize("costs", [0, 300, 1_000_000])
def test_depth_is_the_same_at_every_size(spark, costs):
    texts = [r.text[:300] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(28).collect()] + ["", "é x é y"]
    ids = list(range(len(texts)))
    training = [t.translate(A_Z) for t, h in zip(texts, lm_scoring.is_held_out(ids)) if not h]
    rows = lm_scoring.scores(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), costs=costs).collect()
    assert sorted(r.doc_id for r in rows) == ids and {r.held_out for r in rows} == {True, False}
    for r in rows:
        assert math.isclose(r.score, ppm_by_hand(training, texts[r.doc_id].translate(A_Z), lm_scoring.DEPTH), rel_tol=1e-5)


def test_all_documents_are_scored(spark):
    rows = op2_lm_scoring(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {x[0]: x for x in base_by_hand(docs.items())}
    assert len(rows) == len(docs) and all(math.isclose(r.base_score, want[r.doc_id][-1], rel_tol=1e-6) and r.n_known == want[r.doc_id][3] for r in rows)


# --- quality


def base_counts(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


ODD = ["", " \t", "a", "a b", "a a a a", "x y z x y z q", "l1\nl1\n\n \nl1\nl 2\nl 2 ", "é ü | # <>", "a\x0bb\x0cc\rd", "a\x1cb\x85c　d", "one two three " * 40, "ná \U0001f600 % %"]


def test_base_counts_against_brute_force(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got, ratios = quality_forest.measure(pa.array(texts, pa.large_string()))
    assert got.tolist() == [list(base_counts(t)) for t in texts] and np.isfinite(ratios).all()


def test_repeats_do_not_cross_texts():
    words = split_words(pa.array(["a b", "c a b c", "a b c"], pa.large_string()))
    assert quality_forest.repeats(words).tolist() == [0, 0, 0]


def test_forest_separates():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0, 0.1, (600, 4)), rng.normal(0, 0.1, (100, 4)) + [0, 0, 5, 0]
    f = quality_forest.Forest(good[:300], bad[:50])
    limit = quality_forest.calibrated(f.scores(good[:300]), f.scores(bad[:50]))
    assert (f.scores(good[300:]) > limit).mean() < 0.02 and (f.scores(bad[50:]) > limit).mean() > 0.98
    assert quality_forest.calibrated(np.zeros(0), np.ones(3)) == float("inf")


def test_rules(spark):
    rows = {r.doc_id: r for r in op10_quality_forest(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, r in rows.items():
        n, *_, repeat = base_counts(docs[i])
        assert r.n_words == n and r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[i], r.kept) for i, r in rows.items() if i in labels and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.98 and np.mean([k for q, k in judged if q == 0]) < 0.3


def test_verdict_on_rows_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_forest.rules(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 100 and np.mean(good) > 0.97
    assert len(bad) > 10 and np.mean(bad) < 0.5


def test_kept_rows_judges_row_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("_lost", quality_forest.F.lit("x"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ruled = quality_forest.rules(docs, labels).collect()
    want = sorted(r.doc_id for r in ruled if r.kept)
    poor = spark.createDataFrame([(want[0], "too short", "x"), (None, None, "x"), (10**9, "word " * 300_000, "x")], docs.schema)
    got = quality_forest.kept_rows(docs.unionByName(poor).unionByName(docs.filter(f"doc_id = {want[0]}")), labels)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted([*want, want[0]])


def test_threshold_covers_all_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality_forest.rules(docs, labels, train_rows=5).collect() if not r.base_failed]
    good, bad = ([r for r in rows if quality.get(r.doc_id) == q] for q in (1, 0))
    # of fewer than 500 good rows none may be lost; of the bad ones all above them are
    assert 5 < len(good) < 500 and all(r.kept for r in good)
    top = max(r.score for r in good) + 1 / quality_forest.BINS
    assert not any(r.kept for r in bad if r.score > top) and any(r.score > top for r in bad)


def test_rules_on_odd_tables(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (0, "", "x")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_forest.rules(df, labels).collect()
    assert len(rows) == len(ODD) + 2 and not any(r.kept for r in rows)
    assert quality_forest.rules(df.limit(0), labels).count() == 0
    assert quality_forest.kept_rows(df, labels).columns == df.columns


# --- languages


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    said = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(said) and np.mean([rows[i].language == said[i] for i in said]) > 0.99
    assert np.mean([r.kept for r in rows.values()]) > 0.99


def test_text_beats_a_wrong_declaration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    one = docs.filter("lang = 'de'").orderBy(-language_id.F.length("text")).first()
    more = spark.createDataFrame([(-1, one.text, "en", "elsewhere"), (-2, one.text, None, None), (-3, None, "en", "src0"), (-4, "12 %% 34", "en", "src0")], docs.schema)
    rows = {r.doc_id: r for r in language_id.language_id(docs.unionByName(more)).collect()}
    assert rows[-1].language == "de" and rows[-2].language == "de"
    assert [rows[i].language for i in (-3, -4)] == ["und", "und"] and not rows[-3].kept
    kept = language_id.kept_rows(docs.unionByName(more))
    assert kept.columns == docs.columns and kept.filter("doc_id = -4").count() == 0


def fused_by_hand(rows, k=language_id.K):
    """Language and posterior of each (text, declaration, host), every sum written out; the model is of all declared rows."""
    said = sorted({d for _, d, _ in rows if d})
    grams = [collections.Counter(language_id.trigrams(pa.array([t or ""], pa.large_string()))[0].tolist()) for t, _, _ in rows]
    share = {}
    for c in said:
        n = sum((g for g, (_, d, _) in zip(grams, rows, strict=True) if d == c), collections.Counter())
        total = sum(n.values()) + 0.5 * language_id.BUCKETS
        share[c] = lambda b, n=n, total=total: math.log((n[b] + 0.5) / total)
    share["und"] = lambda b: -math.log(language_id.BUCKETS)
    names = [*said, "und"]
    text = [[min(1, language_id.EVIDENCE / max(sum(g.values()), 1)) * sum(m * share[c](b) for b, m in g.items()) for c in names] for g in grams]
    best = [names[max(range(len(names)), key=lambda i: x[i])] if g else "und" for x, g in zip(text, grams, strict=True)]
    every = [best.count(c) + 1 for c in names]
    root = [x / sum(every) for x in every]
    domain_of = lambda h: h if h.count(".") < 2 else ".".join(h.split(".")[-2:])
    suffix_of = lambda h: h.rsplit(".", 1)[1] if h and "." in h else None

    def smoothed(where, parent):
        own = [sum(where(h) and b == c for (_, _, h), b in zip(rows, best, strict=True)) for c in names]
        return [(x + k * p) / (sum(own) + k) for x, p in zip(own, parent, strict=True)]

    def evidence(value, of):
        have = [(of(r), b) for r, b in zip(rows, best, strict=True) if of(r)]
        part = sum(v == value for v, _ in have) / max(len(have), 1)
        return [(sum(v == value and b == c for v, b in have) + k * part) / (sum(b == c for _, b in have) + k) for c in names]

    out = []
    for x, (_, d, h), g in zip(text, rows, grams, strict=True):
        prior = smoothed(lambda y: y == h, smoothed(lambda y: bool(y) and domain_of(y) == domain_of(h), root)) if h else root
        logs = [a + math.log(p) for a, p in zip(x, prior, strict=True)]
        for value, of in ((d, lambda r: r[1]), (suffix_of(h), lambda r: suffix_of(r[2]))):
            if value:
                logs = [a + math.log(e) for a, e in zip(logs, evidence(value, of), strict=True)]
        top = max(logs)
        out.append((names[logs.index(top)], 1 / sum(math.exp(v - top) for v in logs)) if g else ("und", 1.0))
    return out


def test_fusion_against_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    hosts = ["a.x.de", "b.x.de", "www.y.com", "y.com", None, "plain", "z.fr"]
    rows = [(r.text[:200], r.lang if i % 4 else None, hosts[i % 7]) for i, r in enumerate(docs)] + [("", "en", "y.com"), (None, None, None), ("12 34", "fr", "z.fr"), (docs[0].text[:200], "xx", "a.x.de")] * 2
    df = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, posterior int")
    got = {r.doc_id: r for r in language_id.language_id(df).collect()}
    for i, (language, posterior) in enumerate(fused_by_hand(rows)):
        assert got[i].language == language and math.isclose(got[i].posterior, posterior, rel_tol=1e-5), i


def test_text_alone_tells_languages_it_was_not_told(spark):
    """Held out: half of the rows declare nothing and have no host; their language comes from the text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    half = docs.withColumn("told", language_id.F.when(language_id.F.col("doc_id") % 2 == 0, language_id.F.col("lang")))
    rows = {r.doc_id: r for r in language_id.language_id(half, declared="told", host=None).collect()}
    apart = [(rows[r.doc_id].text_language, r.lang) for r in docs.collect() if r.doc_id % 2 and len(r.text) > 100]
    assert len(apart) > 50 and np.mean([a == b for a, b in apart]) > 0.97


def test_every_declared_language_takes_part(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [a + b + "q" for a in letters for b in letters][:300]
    rows = [(i, f"{c[:2] * 3}ab {c[:2]}{c[1]}zo {c[1]}{c[0] * 2}ek " * 10, c, None) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows + [(i + 1000, t, None, h) for i, t, _, h in rows] + [(5000, "abc", "english", None)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text_language for r in language_id.language_id(df).collect()}
    assert np.mean([got[i] == c and got[i + 1000] == c for i, c in enumerate(codes)]) > 0.95 and "english" not in got.values()


def test_hot_values_are_joined(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [("c",), (None,), ("d",)], "host string")
    found = spark.createDataFrame([("a", "A", 50), ("b", "B", 3), ("c", "C", 1)], "host string, v string, n long")
    for most in (0, 1, 10):
        got = language_id.joined(rows, found, "host", "v", most)
        assert got.columns == ["host", "v"] and sorted((r.host or "", r.v or "") for r in got.collect()) == sorted([("a", "A")] * 50 + [("b", "B")] * 3 + [("c", "C"), ("", ""), ("d", "")])


def test_long_texts_are_cut_at_white_space():
    texts = ["abc def " * 400, "x" * 3000, "short", "", "é" * 2000]
    parts, of = text_module.cut_long(pa.array(texts, pa.large_string()), 800)
    parts = parts.to_pylist()
    assert ["".join(p for p, k in zip(parts, of, strict=True) if k == i) for i in range(5)] == texts
    assert max(len(p.encode()) for p in parts) <= 800 and not any(p.rstrip().endswith("ab") for p in parts)


def test_rows_of_one_id_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "text", "lang", "source").withColumn("_lost", language_id.F.lit(1)).withColumn("of", language_id.F.lit(2))
    more = spark.createDataFrame([(docs.first().doc_id, "12 34 !!", "en", "src0", 1, 2), (None, "12", None, None, 1, 2), (None, None, None, None, 1, 2)], docs.schema)
    kept = language_id.kept_rows(docs.unionByName(more).unionByName(docs.limit(1)))
    assert kept.columns == docs.columns and kept.count() == language_id.kept_rows(docs).count() + 1
    assert language_id.kept_rows(docs.limit(0)).count() == 0


def test_language_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "abc def", None, None)], "doc_id long, text string, lang string, source string")
    assert language_id.language_id(df).first().language == "und"
    assert language_id.language_id(df.limit(0)).count() == 0


def test_page_language(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r.language for r in page_language(spark, SF).collect()}
    said = {r.page_id: re.search(r'lang="(\w+)"', r.html)[1] for r in pages.collect()}
    assert np.mean([rows[i] == said[i] for i in said]) > 0.97
    assert spark.range(1).select(language_id.host_of(language_id.F.lit("https://u@A.Example.com:80/x?y#z")).alias("h")).first().h == "a.example.com"
