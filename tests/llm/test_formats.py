"""Chat formatting, GIF columns and main text of pages."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tests.conftest import SF
from voxelry.llm import chat_format, html_extract, media_gif
from voxelry.llm.queries import op6_chat_format, op7_media_gif, op8_html_extract

NASTY = ["", "\\", "<", "[", "|", "<|end|>\n", "<\\|end|>\n", "</s>[INST] ok [/INST]", "<|user|>\nhi<|end|>\n", "a\\<\\[\\|", "é\U0001f600\n\n", "|>\n", "\\\\<"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_round_trip(text):
    e = chat_format.escape(text)
    assert chat_format.unescape(e) == text
    for mark in ("<|", "</s>", "[INST]", "[/INST]", "|>"):
        assert mark not in e


def test_conversations_round_trip(spark):
    rows = [(k % 4 if k % 5 else None, k, ["user", "assistant", "system", None, "a|>\nb"][k % 5], NASTY[k % len(NASTY)] if k % 11 else None, "x") for k in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.conversations(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.conversations(df.limit(0))).count() == 0


def test_typed_parts():
    parts = [{"type": "text", "text": "see <"}, {"type": "image", "reference": "i.png", "width": 56, "height": 29}, "and", {"type": "audio", "url": "a.wav", "seconds": 2}, {"type": "document", "reference": "d.pdf", "pages": 3}, {"type": "tool", "x": 1}, None]
    f = chat_format.format_turns([("user", parts), ("assistant", "ok")])
    assert f.text.startswith("<|user|>\nsee <\\<|image:0|>and<|audio:1|><|document:2|>{")
    assert [(a.kind, a.reference, a.position, a.tokens) for a in f.attachments] == [("image", "i.png", 0, 4), ("audio", "a.wav", 1, 50), ("document", "d.pdf", 2, 1536)]
    assert [f.text[a:b] for a, b in f.mask] == ["ok"]


def test_conversation_query(spark):
    rows = {r.conv_id: r for r in op6_chat_format(spark, SF).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == 21


# --- GIF


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_lzw_round_trip(bits):
    rng = np.random.default_rng(bits)
    top = 1 << bits
    for data in (b"", b"\1", bytes(5000), bytes(rng.integers(0, top, 20_000, np.uint8).astype(np.uint8)), bytes([1, 2, 1, 2, 1, 2, 1] * 900), bytes(np.arange(9000) % top % 256)):
        data = bytes(x % top for x in data)
        assert media_gif.lzw_decode(media_gif.lzw_encode(data, bits), bits) == data


def test_lzw_known_stream():
    # the sample of the format's common description: 10x10 with four colours
    stream = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01")
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert media_gif.lzw_decode(stream, 2) == bytes(int(c) for r in rows for c in r)


def test_lzw_deferred_clear():
    """A stream that never clears after its table is full decodes on with twelve-bit codes."""
    data = np.random.default_rng(1).integers(0, 256, 12_000).astype(np.uint8).tobytes()
    codes, table, entry, cur = [256], {}, 258, data[0]
    for b in data[1:]:
        if (cur, b) in table:
            cur = table[cur, b]
            continue
        codes.append(cur)
        if entry < 4096:
            table[cur, b] = entry
            entry += 1
        cur = b
    codes += [cur, 257]
    widths = media_gif.code_widths(8)
    acc = at = 0
    for i, c in enumerate(codes):
        acc |= c << at
        at += int(widths[min(max(i - 1, 0), 4096)]) if i else 9
    assert media_gif.lzw_decode(acc.to_bytes((at + 7) // 8, "little")) == data


def test_disposal_and_transparency():
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    palette = np.array([red, green, blue, [9, 9, 9]], np.uint8)
    full = lambda c, h=2, w=2: np.full((h, w), c, np.uint8)
    g = media_gif.Gif(2, 2, palette, 0, [
        media_gif.Frame(full(0), delay=5, disposal=1), media_gif.Frame(full(1, 1, 1), x=1, y=1, disposal=3), media_gif.Frame(np.array([[2, 3]], np.uint8), transparent=3, disposal=2),
        media_gif.Frame(full(1, 1, 1), x=1, palette=palette[::-1].copy(), disposal=0)])
    back = media_gif.decode(media_gif.encode(g))
    assert [f.delay for f in back.frames] == [5, 0, 0, 0] and back.frames[2].transparent == 3
    seen = [c for _, c in media_gif.rendered(back)]
    assert seen[0][1, 1, :3].tolist() == red and seen[1][1, 1, :3].tolist() == green
    assert seen[2][1, 1, :3].tolist() == red and seen[2][0, 0, :3].tolist() == blue and seen[2][0, 1, :3].tolist() == red
    assert seen[3][0, 0].tolist() == [0, 0, 0, 0] and seen[3][0, 1, :3].tolist() == blue
    assert media_gif.histogram(seen[3]).sum() == 3 * 3


def test_interlaced():
    g = media_gif.Gif(4, 11, media_gif.GREYS, 0, [media_gif.Frame(np.arange(44, dtype=np.uint8).reshape(11, 4))])
    order = np.concatenate([np.arange(s, 11, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
    g.frames[0].samples = g.frames[0].samples[order]
    raw = bytearray(media_gif.encode(g))
    raw[raw.index(b"\x2c\0\0\0\0\4\0\x0b\0") + 9] |= 0x40
    assert (media_gif.decode(bytes(raw)).frames[0].samples.ravel() == np.arange(44)).all()
    for broken in (b"", b"GIF89a", bytes(raw[:-60]), b"PNG" + bytes(raw)):
        with pytest.raises(ValueError):
            media_gif.decode(broken)


def test_media_column(spark):
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é" * 32), (4, "é" * 32), (None, "x" * 64), (5, "long text " * 20_000), (6, "\0\1")]
    df = spark.createDataFrame([(i, t, b"") for i, t in texts], "doc_id long, text string, media binary")
    media = media_gif.media_column(df)
    rows = media_gif.digests(media).collect()
    assert len(rows) == len(texts)
    for (i, t), r in zip(sorted(texts, key=str), sorted(rows, key=lambda r: str((r.doc_id, {x[0]: x[1] for x in texts}[r.doc_id]))), strict=True):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert sum(map(int, r.feature.split(","))) == len(payload)
    assert media_gif.digests(df.limit(0).select("doc_id", media_gif.F.lit(0).cast("long").alias("n_bytes"), "media")).count() == 0
    frames = media_gif.frames(media.filter("doc_id = 5")).collect()
    assert len(frames) == 4 and b"".join(bytes(f.samples) for f in sorted(frames, key=lambda f: f.frame)).rstrip(b"\0") == b"long text " * 19_999 + b"long text "


def test_feature_without_rendering_is_the_rendered_one():
    rng = np.random.default_rng(2)
    for disposal in (0, 1, 2, 3):
        frames = [media_gif.Frame(rng.integers(0, 200, (h, 4)).astype(np.uint8), y=y, disposal=disposal, transparent=t) for h, y, t in ((6, 0, None), (3, 2, 7), (5, 4, None))]
        gif = media_gif.decode(media_gif.encode(media_gif.Gif(4, 6, rng.integers(0, 256, (256, 3)).astype(np.uint8), 0, frames)))
        want = [media_gif.histogram(canvas) for _, canvas in media_gif.rendered(gif)]
        assert all((a == b).all() for a, b in zip(media_gif.histograms(gif), want, strict=True))


def test_streams_decode_together():
    rng = np.random.default_rng(4)
    data = [rng.integers(0, 4, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 9000, 40_000)]
    for bits in (2, 8):
        streams = media_gif.packed([media_gif.lzw_codes(d, bits) for d in data], [bits] * len(data))
        assert streams == [media_gif.lzw_encode(d, bits) for d in data]
        assert media_gif.lzw_decode_all(streams, [bits] * len(data)) == data
    with pytest.raises(ValueError):
        media_gif.lzw_decode((256 | 300 << 9 | 257 << 18).to_bytes(4, "little"))


def test_media_query(spark):
    rows = op7_media_gif(spark, SF).collect()
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


# --- pages


def test_given_pages(spark):
    import re
    from html import unescape

    for r, p in zip(op8_html_extract(spark, SF).orderBy("page_id").collect(), spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect(), strict=True):
        article = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<(?:p|h1|/p|/h1)>", article.replace("<br>", " "))]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == p.url


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a></header><nav>menu</nav>
<div class="cookie-notice">We use cookies. Accept, please.</div>%s<aside>More, more.</aside><div id="comments"><p>First! A long comment, by a reader, with marks; and more of them.</p></div>
<form><p>Write here.</p></form><script>if (a < b) { "<p>no</p>" }</script><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='post-content'>%s</div>", "<div><div>%s</div></div>"])
def test_other_templates(wrap):
    body = "<h1>A title</h1><p>The first paragraph, which says &amp; means a lot; it goes\n on   and on, over lines.</p><p>Short.</p><ul><li>One, of some things.<li>Two, of the others.</ul><p>And <b>the <a href='#x'>last</a></b> one, &lt;at last&gt;, ends here.<br>Now.</p>"
    want = ["A title", "The first paragraph, which says & means a lot; it goes on and on, over lines.", "Short.", "One, of some things.", "Two, of the others.", "And the last one, <at last>, ends here. Now."]
    assert html_extract.extract(PAGE % (wrap % body)).split("\n\n") == want


def test_ratios_decide_alone(spark):
    """Pages that declare nothing: no class, id or role, and plain divisions for the sectioning elements."""
    import re
    from collections import Counter
    from html import unescape

    right = found = wanted = 0
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        want = Counter(x for b in re.split(r"<(?:p|h1|/p|/h1)>", article.replace("<br>", " ")) if (x := " ".join(unescape(re.sub("<[^>]*>", "", b)).split())))
        plain = re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer|header|main|aside|section)\b[^>]*>", r"<\1div>", p.html))
        got = Counter(x for x in html_extract.extract(plain).split("\n\n") if x)
        right, found, wanted = right + (got & want).total(), found + got.total(), wanted + want.total()
    assert right / found > 0.9 and right / wanted > 0.99


@pytest.mark.parametrize("page", ["<b>x" * 250_000, "<a " * 300_000, "<div>x." * 100_000, "<ul><li>y, " * 60_000, "<b>" * 90_000 + "</i>" * 90_000, "<p>Some words, of a text. " * 20 + "<div>x" * 100_000])
def test_open_elements_in_time(page):
    import time

    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 15


PARAGRAPH = "<p>" + "Some words of the text, in order, that say what it is about; and more. " * 4 + "</p>"


@pytest.mark.parametrize("page, parts", [
    ("<main><h1>Short title</h1><article>%s</article></main>", ["Short title"]),
    ("<main><div><h2>Short title</h2></div><article>%s</article></main>", ["Short title"]),
    ("<div class='post'><h1>Short title</h1><div class='text'>%s</div></div>", ["Short title"]),
    ("<div class='post'><div class='top'><h2>Short title</h2></div>%s</div>", ["Short title"]),
    ("<div class='post'>%s<section><b>A caption</b></section></div>", ["A caption"]),
    ("<div class='post'>%s<table><tr><th>Name<td>one<tr><th>Size<td>two</table></div>", ["Name", "one", "Size", "two"]),
    ("%s<table><tr><td>one<td>two</table>", ["one", "two"]),
    ("<div class='post'>%s<blockquote>To be</blockquote></div>", ["To be"]),
])
def test_parts_in_containers_of_their_own(page, parts):
    got = html_extract.extract(PAGE % (page % (PARAGRAPH * 20))).split("\n\n")
    assert [x for x in got if not x.startswith("Some words")] == parts and len(got) == len(parts) + 20


def test_links_do_not_rise():
    links = "<div><a href=/1>One more</a> <a href=/2>Another</a></div>"
    for page in (f"<main><article>%s</article>{links}</main>", f"%s{links}"):
        assert "Another" not in html_extract.extract(PAGE % (page % (PARAGRAPH * 20)))


def test_odd_pages(spark):
    odd = [None, "", "no tags at all", "<p>open <b>and cut", "<article><p>a<", "<article><p>x &amp", "<<<>>>", "<script>never closed <p>x", '<p title="a > b">ok</p>', "<!-- <p>no</p>", "<div><p>a</div>b</p>"]
    got = [html_extract.extract(x) for x in odd]
    assert got[:4] == ["", "", "no tags at all", "open and cut"] and got[7] == "" and got[8] == "ok" and got[9] == ""
    df = spark.createDataFrame([(i, None, x, "t") for i, x in enumerate(odd)] + [(0, "u", None, "t")], "page_id long, url string, html string, text string")
    assert html_extract.main_text(df).count() == len(odd) + 1
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_long_page_in_time():
    text = html_extract.extract("<article>" + "<p>word, word.</p>" * 20_000 + '<p a="' + "x" * 100_000)
    assert text.count("word, word.") == 20_000


def test_parts_of_any_shape():
    parts = [3, True, ["x", 1], {"type": None}, {"type": "text", "text": {"a": 1}}, {"type": "text"}, {"type": "image", "width": "100%", "height": -4}, {"type": "image", "width": 57.0, "height": "28"}, {"type": "audio", "seconds": float("inf")}, {"type": "audio", "seconds": "no"}, {"type": "document", "pages": "two"}, {"type": "document", "pages": 2.5}, {"type": "visit", "x": float("nan")}]
    visitor = chat_format.Visitor()
    text = visitor.flatten(parts)
    assert [(a.kind, a.tokens) for a in visitor.attachments] == [("image", 1), ("image", 3), ("audio", 1), ("audio", 1), ("document", 512), ("document", 1536)]
    assert chat_format.unescape(text).startswith('3true["x", 1]{"type": null}{"a": 1}')


def test_seen_is_rendered_from_the_stored_frames(spark):
    texts = [(1, "ab\0\0c"), (2, "x" * 70_000), (3, "y" * 140_000 + "\0" * 300 + "z"), (4, None)]
    media = media_gif.media_column(spark.createDataFrame(texts, "doc_id long, text string"))
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    for r in media_gif.digests(media).collect():
        gif = media_gif.decode(files[r.doc_id])
        assert {f.transparent for f in gif.frames} == {0} and [f.disposal for f in gif.frames] == [1 + i % 3 for i in range(len(gif.frames))]
        want = sum(media_gif.histogram(canvas) for _, canvas in media_gif.rendered(gif))[: media_gif.BINS]
        assert r.seen == ",".join(map(str, want.tolist()))
    seen = {r.doc_id: sum(map(int, r.seen.split(","))) for r in media_gif.digests(media).collect()}
    # kept: the first frame stays below the second, short one; cleared, then an almost empty third frame
    assert seen == {1: 3, 2: 65_536 + 65_536, 3: 65_536 * 2 + 8_929, 4: 0}


def blocks_right(pages, extract):
    """Precision and recall of blocks against the pages' article elements read by themselves."""
    from collections import Counter

    hit = found = wanted = 0
    for html in pages:
        article = re.search(r"<article\b.*?</article>", html, re.S | re.I)
        want, got = (Counter(x.split("\n\n")) for x in (html_extract.extract(f"<html><body>{article[0]}</body></html>"), extract(html)))
        hit, found, wanted = hit + (want & got).total(), found + got.total(), wanted + want.total()
    return hit / found, hit / wanted


def test_ratios_decide_where_nothing_is_declared(monkeypatch):
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if h and "<article" in h]
    as_it_is = html_extract.extract

    def bare(html):
        html = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)
        return as_it_is(re.sub(r"</?(article|main|nav|footer|aside|header|section)\b", lambda m: m[0].replace(m[1], "div"), html))

    assert min(blocks_right(pages, bare)) >= 0.99  # no class, role or sectioning element is left
    with monkeypatch.context() as m:
        m.setattr(html_extract, "left_out", lambda *a: False)
        assert min(blocks_right(pages, as_it_is)) >= 0.99  # declarations are there, but not looked at
    with monkeypatch.context() as m:  # every path alike: what is short, linked or loose comes in too
        m.setattr(html_extract, "content", lambda page: page.nodes)
        assert blocks_right(pages, bare)[0] < 0.8


def test_ratio_by_hand():
    """Two paths: three nodes of 60 letters with three marks in all, and one of 30 letters, two thirds of them linked."""
    assert html_extract.ratio([180.0, 3.0, 0.0, 3.0]) == 60 * 2
    assert html_extract.ratio([30.0, 0.0, 20.0, 1.0]) == pytest.approx(10)
    assert html_extract.ratio([0.0, 0.0, 0.0, 0.0]) == 0
