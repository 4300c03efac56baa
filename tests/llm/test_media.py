import hashlib
import zlib

import pytest

from urbanloom.llm import media as md


def brute(text):
    body = (text or "").encode()
    payload = body + b" " * ((-len(body)) % 192 if body else 192)
    stored = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
    return len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()


def test_sequence_order_and_captions():
    a, b, c = ("a" * 64, "b" * 64, "c" * 64)
    html = f'<title>no</title><p>One &amp; two<img src="m/{a}.ppm" alt="x">three</p><figure><figcaption>Both <b>of</b>\n them</figcaption><img src="{b}"><img src="{c}"></figure><img src="plain.png"><script>x<y</script><div>four<p>five'
    got = [(i["pos"], i["kind"], i["text"] or i["digest"], i["alt"], i["caption"]) for i in md.SequenceParser().sequence(html)]
    assert got == [
        (0, "text", "One & two", None, None),
        (1, "media", a, "x", None),
        (2, "text", "three", None, None),
        (3, "media", b, None, "Both of them"),
        (4, "media", c, None, "Both of them"),
        (5, "media", None, None, None),
        (6, "text", "four", None, None),
        (7, "text", "five", None, None),
    ]


def test_captions_without_figures_and_plain_sources():
    items = lambda html: [(i["kind"], i["text"] or i["src"], i["caption"]) for i in md.SequenceParser().sequence(html)]
    assert items("<figcaption>alone</figcaption><p>x<img src='photo.jpg'>") == [("text", "alone", None), ("text", "x", None), ("media", "photo.jpg", None)]
    assert items("<figure><figcaption>no <p>media</p></figcaption></figure>y") == [("text", "no media", None), ("text", "y", None)]
    assert items("<figure><img src='a.png'><figcaption>never closed") == [("media", "a.png", "never closed")]
    assert items("<figure><img src='a.png'><figure><img src='b.png'><figcaption>in</figcaption></figure></figure>") == [("media", "a.png", None), ("media", "b.png", "in")]
    assert items("<figcaption>open") == [("text", "open", None)]


@pytest.mark.parametrize("h", [1, 3, 8, 50])
def test_feature_is_from_all_samples(h):
    a, b = bytes(range(192)) * h, bytes(range(192)) * (h - 1) + bytes(range(1, 193))
    assert md.feature(64, h, a) == md.feature(64, h, a) != md.feature(64, h, b)
    assert md.from_pixmap(b"P6\n64 %d\n255\n" % h + a) == (64, h, a)


def test_interleave(spark):
    stored = md.store_media(spark.createDataFrame([(b"x" * 192,), (b"x" * 192,), (b"y" * 384,)], "payload binary"))
    digests = sorted({r.digest: len(r.media) for r in stored.collect()}.items(), key=lambda x: x[1])
    one, two = digests[0][0], digests[1][0]
    pages = spark.createDataFrame([(1, f"<p>t<img src='{one}'>u<img src='{two}'>", 0), (1, f"<img src='{'0' * 64}'>", 0), (2, None, 0), (3, "", 0)], "page_id long, html string, items int")
    got = sorted([(r.page_id, [(i.pos, i.kind, i.media and i.media.payload_bytes) for i in r["items"]]) for r in md.interleave(pages, stored).collect()], key=str)
    assert got == [(1, [(0, "media", None)]), (1, [(0, "text", None), (1, "media", 192), (2, "text", None), (3, "media", 384)]), (2, []), (3, [])]
    assert md.interleave(pages.limit(0), stored).count() == 0


def test_documents(spark, tmp_path):
    texts = [None, "", "a", "a" * 192, "é" * 97, "<b>&amp; \r\n\x00 > end", "z" * 150_000, "a", "</p><img src='" + "f" * 64 + "'>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in md.op1_media(spark, str(tmp_path)).collect()}
    assert {k: v[:6] for k, v in got.items()} == {i: brute(t) for i, t in enumerate(texts)}
    assert got[2][:7] == got[7][:7]
    # Position, caption, and number of items: one text before the media, unless it is blank.
    assert {k: (v[7], v[9], v[10]) for k, v in got.items()} == {i: (n := int(bool((t or "").strip())), str(i), n + 1) for i, t in enumerate(texts)}


def plain_feature(h, samples):
    """The feature by counting every sample."""
    light = [[sum(samples[192 * y + 3 * x : 192 * y + 3 * x + 3]) for x in range(64)] for y in range(h)]
    total, bits = sum(map(sum, light)), ""
    for i in range(8):
        for j in range(8):
            cells = [light[y][x] for y in range(i * h // 8, (i + 1) * h // 8) for x in range(8 * j, 8 * j + 8)]
            bits += "1" if sum(cells) * h * 64 > total * len(cells) else "0"
    return f"64x{h} rgb={','.join(str(sum(samples[c::3])) for c in range(3))} areas={int(bits, 2):016x}"


@pytest.mark.parametrize("h", [1, 7, 8, 21])
def test_feature_like_the_plain_version(h):
    samples = bytes((i * i * 7 + i // 50) % 251 for i in range(192 * h))
    assert md.feature(64, h, samples) == plain_feature(h, samples)


def test_corpus(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:7] for r in md.op1_media(spark, folder).collect()}
    assert got == {k: brute(t) for k, t in texts.items()}
