"""Token output and packing: exact against the library, and whole."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxelry.llm import packing, token_output
from voxelry.llm.text import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(5, "Hello, world's end!! été ŒUVRE naïve 12½"), (2, None), (9, ""), (2, " \t\n "), (None, "no id"), (7, "<|endoftext|> <|ENDOFTEXT|> x<|endoftext|>y"), (1, "ΟΔΟΣ İstanbul é ́a a.́ \x1c\x85　漢字 \U0001f600 #$%&*"), (3, "long " * 3000), (3, "long " * 3000), (4, "ab." * 2047)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in TEXTS], "doc_id long, text string, start string, length int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    tok = Tokenizer.from_file(PATH)
    letters = [f"a{chr(c)}b. {chr(c)}{chr(c)}" for c in range(0x21, 0x2FF)]
    texts = [t or "" for _, t in TEXTS] + letters
    for keep in (10, 10_000):
        encoder = WordEncoder(PATH, keep)
        for _ in range(2):
            ids, starts = encoder.ids(pa.array(texts, pa.large_string()), 2)
            for k, t in enumerate(texts):
                assert ids[starts[k] : starts[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids + [2]


def test_token_output(spark, docs):
    tok = Tokenizer.from_file(PATH)
    rows = sorted(token_output.token_output(docs, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    want = sorted((crc(ids := tok.encode(t or "", add_special_tokens=False).ids + [2]), len(ids)) for _, t in TEXTS)
    assert sorted((r.ids_crc32, r.n_tokens) for r in rows) == want
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()


def test_shards_are_flat_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    manifest = token_output.write_shards(docs, path, PATH, 2, 1 << 20)
    for m in manifest:
        shard = token_output.Shard(path, m["shard"], m["dtype"])
        assert isinstance(shard.ids, np.memmap) and shard.ids.dtype == np.uint32 and len(shard.ids) == m["n_tokens"]
    assert spark.read.parquet(f"{path}/manifest").count() == len(manifest)


def test_ranges_hold_every_document(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    for m in token_output.write_shards(docs, path, PATH, 2, 1 << 20):
        shard = token_output.Shard(path, m["shard"], m["dtype"])
        for most in (1, 100, 5000, 1 << 21):
            found = list(shard.ranges(most))
            assert [i for a, b in found for i in range(a, b)] == list(range(len(shard.doc_ids)))
            assert all(shard.offsets[b] - shard.offsets[a] <= most or b == a + 1 for a, b in found)
            mapped, shard.ids = shard.ids, None  # as where the store is not local
            assert all((shard.span(a, b) == mapped[shard.offsets[a] : shard.offsets[b]]).all() for a, b in found)
            shard.ids = mapped


def test_empty(spark, docs):
    assert token_output.token_output(docs.limit(0), PATH).count() == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_packing_is_whole(spark, docs):
    tok = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH, window=64, buckets=4).collect()
    check_packed(rows, [tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in TEXTS], 64)


def check_packed(rows, ids, window):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids))
    want = sorted(crc(x[a : a + window]) for x in ids for a in range(0, len(x), window))
    assert sorted(r.ids_crc32 for r in rows) == want
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(seqs) == list(range(len(seqs)))


def test_plan_uses_every_rest_once():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(0, 50, 129), np.eye(1, 129, 100, dtype=int)[0] * 100_000, np.zeros(129, int)):
        counts = counts.copy()
        counts[[0, 128]] = 0
        used = np.zeros(129, int)
        for p, n in packing.plan(counts, 128):
            assert n > 0 and sum(p) <= 128
            for a in p:
                used[a] += n
        assert (used == counts).all()


def test_least_squares():
    counts = np.zeros(17)
    counts[[4, 6, 10, 12]] = (30, 20, 20, 30)
    patterns = packing.combinations(counts.astype(int), 16)
    x = packing.nnls(patterns, counts)
    got = np.zeros(17)
    for p, k in zip(patterns, x, strict=True):
        for a in p:
            got[a] += k
    assert (x >= 0).all() and np.abs(got - counts).max() < 1


def test_padding_is_small(spark):
    from voxelry.llm.queries import op9_packing

    from tests.conftest import SF

    pdf = op9_packing(spark, SF).toPandas()
    fill = pdf.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and (2048 - fill)[fill.isin([1 << k for k in range(12)]) == False].sum() < 0.02 * fill.sum()  # noqa: E712


def test_ids_of_a_wide_tokenizer(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    wide = Tokenizer(models.WordLevel({"[UNK]": 0, "near": 65_535, "far": 70_000}, unk_token="[UNK]"))
    wide.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "wide.json")
    wide.save(path)
    assert token_output.id_width(path, 2) == "<u4" and token_output.id_width(PATH, 2) == "<u2" and token_output.id_width(PATH, 1 << 16) == "<u4"


def test_ids_beyond_the_given_vocabulary(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    narrow = token_output.write_shards(docs, f"file://{tmp_path}/narrow", PATH, 2, 1 << 16)
    assert [m["dtype"] for m in narrow] == ["<u2"]
    with pytest.raises(Exception, match="does not fit <u2"):
        token_output.write_shards(docs, f"file://{tmp_path}/wide", PATH, 1 << 16, 1 << 16)
