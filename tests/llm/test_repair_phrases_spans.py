"""Role repair, collocations and substring dedup: each against a plain search over everything."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelry.llm import chunks, collocations, role_repair, substring_dedup

FULL = {"u": "user", "a": "assistant"}
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit) over all edits by a search from the cheapest on, and the faults."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        for r in "ua":
            if (state, r) in NEXT:
                heapq.heappush(queue, (cost + 2, audit + "I", i, r, (*out, (FULL[r], ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                if (state, role[:1]) in NEXT:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for r in "ua":
                    if (state, r) in NEXT:
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, r, (*out, (FULL[r], text))))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def with_damage(rows):
    out = []
    said = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", said(text)) if kind == 2 else said(text)
            out += [(turn, "user" if kind == 4 else said(role), text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda v: (v[0] is not None, v[0] or 0, *v[1:]))


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(3), []
    for conv in [None, *range(40)]:
        for _ in range(400 if conv == 3 else rng.randint(1, 9)):
            turn = rng.choice([None, *range(12 if conv != 3 else 500)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(["hi.", "hello", "", " \t", "ok!", None, f"t{turn}.", "x" * 50 + "."])))
    return rows + [(90, 1, "user", "dropped.")] + rows[:5]


@pytest.mark.parametrize("chunk_bytes", [chunks.CHUNK_BYTES, 300])
def test_role_repair(spark, talks, chunk_bytes, monkeypatch):
    whole = role_repair.repair
    monkeypatch.setattr(role_repair, "repair", lambda rows: whole(rows, chunk_bytes))
    df = spark.createDataFrame([(*t, 1, "clash") for t in talks], "conv_id long, turn long, role string, text string, chunk int, audit string")
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in role_repair.report(df).collect()}
    groups = defaultdict(list)
    for t in talks:
        groups[t[0]].append(t)
    assert got == {c: cheapest(with_damage(rows)) for c, rows in groups.items()}


def test_role_repair_rows(spark):
    said = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Yes"), (2, 0, "system", "Be kind."), (3, 0, "user", " ")]
    reports, rows = role_repair.repair(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    got = defaultdict(list)
    for r in rows.orderBy("conv_id", "step").collect():
        got[r.conv_id].append((r.edit, r.role, r.text))
    assert got == {1: [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi."), ("K", "assistant", "Yes")]}
    assert {r.conv_id: (r.cost, r.audit) for r in reports.collect()} == {1: (6, "IKKDK"), 2: (3, "D"), 3: (3, "D")}


def test_role_repair_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert role_repair.report(none).count() == 0


def phrase_rows(docs, least, top):
    counts, total, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        lang = lang or "und" if lang != "" else ""
        plain = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3, 4):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, c in counts.items():
        found, longer, rows = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, Counter(), []
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        for p, a in found.items():
            if 100 * longer[p] < 80 * a:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, b.decode(), -a, x, y, total[lang], -s) for i, (s, a, b, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes,shards", [(chunks.CHUNK_BYTES, 1 << 20), (400, 40)])
def test_collocations(spark, chunk_bytes, shards, monkeypatch):
    rng = random.Random(5)
    words = ["New", "york", "éa", "b\x00c", "in\x1cside", "the", "OF", "漢字"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!", "\x0b"]) for _ in range(n))
    docs = [(rng.choice(["en", None, "und", "fr", ""]), text(rng.randint(0, 60))) for _ in range(80)] + [("en", None), ("en", ""), (None, " .. "), ("xx", "one two"), ("en", "New york " * 3000)]
    docs += docs[:4]
    monkeypatch.setattr(chunks.chunked, "__defaults__", ("text", chunk_bytes))
    monkeypatch.setattr(collocations, "SHARD_WORDS", shards), monkeypatch.setattr(collocations, "SHARD_GRAMS", shards * 4)
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "lang string, text string, n int, phrase string")
    got = sorted(tuple(r) for r in collocations.collocations(df, 5, 20).collect())
    assert got == phrase_rows(docs, 5, 20)
    assert any(row[1] == 20 for row in got)
    assert collocations.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4])
def test_quotient_filters_lose_nothing(n):
    rng = np.random.default_rng(n)
    for bits in (1, 2, 7, 15, 16, 17, 21, 22, 31):
        shape, ids = collocations.Shape(n, bits), [rng.integers(0, 1 << bits, 3000) for _ in range(n)]
        want = Counter(zip(*(x.tolist() for x in ids), strict=True))
        high, low, counts = collocations.added(*shape.permute(*shape.pack(ids)))
        one = collocations.QuotientFilter(shape, high, low, counts * 200)
        for prefix in (0, 3):
            back = collocations.QuotientFilter.from_bytes(shape, one.to_bytes(min(prefix, shape.high)))
            grams, sums = collocations.QuotientFilter.merge([back, collocations.QuotientFilter(shape, high, low, counts)]).grams()
            assert {g: c for *g, c in zip(*(x.tolist() for x in grams), sums.tolist(), strict=True) for g in [tuple(g)]} == {g: 201 * c for g, c in want.items()}


def plain_dedup(docs, span):
    """Rows in order of id (nulls first) and text's hash: words of each that stay."""
    seen, out = set(), []
    for doc_id, _, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            if key in seen:
                gone[i : i + span] = [True] * span
            seen.add(key)
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), [i for i, g in enumerate(gone) if g]))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes,cells", [(chunks.CHUNK_BYTES, 1 << 22), (500, 256)])
def test_substring_dedup(spark, chunk_bytes, cells, monkeypatch):
    rng = random.Random(7)
    passages = [[f"p{k}-{i}" for i in range(rng.choice([19, 20, 21, 60]))] for k in range(8)]

    def text():
        parts = [rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(0, 6))]
        return rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)

    docs = [(rng.choice([None, i, i, i, 5]), text()) for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (103, "z " * 50), (104, "é " * 19), (3, "w " * 5000)]
    docs += docs[:6]
    monkeypatch.setattr(chunks.chunked, "__defaults__", ("text", chunk_bytes))
    monkeypatch.setattr(substring_dedup, "SHARD_CELLS", cells)  # far too few: the sketch then lets nearly all through
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, chunk int, n_words string")
    hashes = [r.h for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()]
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.text, [i for s in r.removed for i in range(s.start, s.end)]) for r in substring_dedup.without_repeats(df).collect()], key=str)
    assert got == plain_dedup([(d, h, t) for (d, t), h in zip(docs, hashes, strict=True)], 20)
    assert sum(r[2] for r in got) > 500
    assert substring_dedup.without_repeats(df.limit(0)).count() == 0


def test_sketch_counts_too_much_at_most():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3, 40)) for _ in range(60)]
    group = lambda k: pa.table({"chunk": pa.array([k] * 30), "doc_id": pa.array(range(30 * k, 30 * k + 30)), "text_hash": pa.array([0] * 30), "text": texts[30 * k : 30 * k + 30]})
    parts = pa.concat_tables([substring_dedup.sketched(group(k), 2, 5) for k in (0, 1)])
    answers = pa.concat_tables([substring_dedup.merged(parts.filter((pa.compute.field("shard") == s) & (pa.compute.field("row") == r))) for s in (0, 1) for r in (0, 1)])
    every = Counter(tuple(t.split()[i : i + 5]) for t in texts for i in range(36))
    for k in (0, 1):
        rows = substring_dedup.in_order(group(k))
        words = substring_dedup.split_words(substring_dedup.texts_of(rows))
        at, a, b = substring_dedup.windows(words, 5)
        twice = substring_dedup.suspected(a, b, 2, answers.filter(pa.compute.field("chunk") == k))
        w = words.unique.take(pa.array(words.codes)).to_pylist()
        assert all(s or every[tuple(w[i : i + 5])] == 1 for i, s in zip(at.tolist(), twice.tolist(), strict=True))
        assert [bool(s) for s in twice] == [every[tuple(w[i : i + 5])] > 1 for i in at.tolist()]  # few windows: no cell is shared
