"""Media columns: HTML pages become ordered sequences of texts and media references, resolved by digest joins.

A payload is stored as a pixmap (binary, 8-bit samples, WIDTH pixels of three samples in a row), under the SHA-256
of the stored form. A page refers to it as `media/<digest>.ppm`. Payloads never leave the place where they are
stored: what is joined to the references is read from the stored bytes and is a few hundred bytes per digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import common

WIDTH = 64
ROW = 3 * WIDTH
ITEM = {"pos": "int", "kind": "string", "text": "string", "src": "string", "digest": "string", "alt": "string", "caption": "string"}
DIGEST = re.compile(r"\b([0-9a-f]{64})\b")
#: Elements whose text is no content, and elements that end a run of text.
SILENT = {"script", "style", "noscript", "template", "title"}
BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "section", "article", "header", "footer", "main", "nav", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "br", "hr", "body", "dl", "dt", "dd", "figure"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class SequenceParser(HTMLParser):
    """Collects the items of a page in document order.

    A figure's caption goes to all media of that figure; a caption outside of figures, or of one without media, is
    text. Media keep their src; without a digest in it they stay unresolved.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent = 0
        self.figures: list[dict[str, list]] = []
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = "".join(self.run)
        self.run = []
        if text.strip():
            self._add("text", text=text)

    def _add(self, kind: str, **values: str | None) -> None:
        self.items.append({"pos": len(self.items), "kind": kind, "text": None, "src": None, "digest": None, "alt": None, "caption": None} | values)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self._end_caption()
            self._flush()
            self.caption = []
        elif tag in MEDIA:
            values = dict(attrs)
            src = values.get("src") or values.get("data-src")
            if src:
                self._flush()
                if self.figures:
                    self.figures[-1]["media"].append(len(self.items))
                found = DIGEST.search(src)
                self._add("media", src=src, digest=found[1] if found else None, alt=values.get("alt"))
        elif tag in BLOCKS:
            if self.caption is None:
                self._flush()
            if tag == "figure":
                self._end_caption()
                self.figures.append({"media": [], "captions": []})

    def _end_caption(self) -> None:
        """What was read since <figcaption> goes to the figure, or stands as text where there is none."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        if self.figures:
            self.figures[-1]["captions"].append(text)
        elif text:
            self._add("text", text=text)

    def _end_figure(self) -> None:
        self._end_caption()
        figure = self.figures.pop()
        text = " ".join(filter(None, figure["captions"]))
        for at in figure["media"]:
            self.items[at]["caption"] = text if figure["captions"] else None
        if text and not figure["media"]:
            self._add("text", text=text)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self._end_caption()
        elif tag in BLOCKS and (self.caption is None or tag == "figure"):
            self._flush()
            if tag == "figure" and self.figures:
                self._end_figure()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.run.append(data)

    def sequence(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        while self.figures:
            self._flush()
            self._end_figure()
        self._end_caption()
        self._flush()
        return self.items


def parse(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns `keep` and `items`, the page's texts and media references in order (null html: none).

    Text keeps its blanks; media without a digest are items too; markup that is not closed ends with the page. The
    columns that are kept may have any names.
    """
    rows, (page, *kept) = common.by_place(pages, html, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in ITEM.items()]))
        for batch in common.small_batches(batches, "html"):
            found = [SequenceParser().sequence(h.decode("utf-8", "replace")) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(found, kind)], names=[*kept, "items"])

    items = StructType([StructField(n, IntegerType() if t == "int" else StringType()) for n, t in ITEM.items()])
    schema = common.fields(rows, kept).add("items", ArrayType(items))
    return common.bound_batches(rows.select(*kept, common.text_bytes(page).alias("html"))).mapInArrow(run, schema).toDF(*keep, "items")


def to_pixmap(payload: Column) -> Column:
    """A payload whose length is a positive multiple of ROW as a binary pixmap."""
    head = F.concat(F.lit(f"P6\n{WIDTH} "), (F.length(payload) / ROW).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), payload)


def from_pixmap(media: bytes) -> tuple[int, int, bytes]:
    """(width, height, samples) of a binary pixmap with 8-bit samples."""
    head = re.match(rb"P6\s(\d+)\s(\d+)\s255\s", media)
    if not head:
        raise ValueError("not a pixmap of 8-bit samples")
    return int(head[1]), int(head[2]), media[head.end() :]


def feature(width: int, height: int, samples: bytes) -> str:
    """Size, sums of the three channels, and which of 8 x 8 areas are brighter than the whole, in hexadecimal."""
    pixels = np.frombuffer(samples, "u1").reshape(height, width, 3)
    sums = pixels.sum(axis=(0, 1), dtype="i8").tolist()
    light = pixels.sum(axis=2, dtype="i8")
    rows = np.arange(9) * height // 8
    total = np.zeros((height + 1, 8), "i8")
    np.cumsum(light.reshape(height, 8, width // 8).sum(axis=2), axis=0, out=total[1:])
    areas, count = total[rows[1:]] - total[rows[:-1]], (rows[1:] - rows[:-1])[:, None] * (width // 8)
    bright = areas * (height * width) > light.sum() * count
    return f"{width}x{height} rgb={','.join(map(str, sums))} areas={np.packbits(bright).tobytes().hex()}"


def store_media(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Writes each payload's stored form (digest, media) to the shared folder, and returns what is stored."""
    media = to_pixmap(F.col(payload))
    return common.store(payloads.select(F.sha2(media, 256).alias("digest"), media.alias("media")))


def describe(media: DataFrame) -> DataFrame:
    """One row for each digest, from the bytes as stored: digest, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature. Copies of a payload are folded before they are shuffled."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "media"):
            rows = []
            for digest, held in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                width, height, samples = from_pixmap(held)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(held), hashlib.sha256(held).hexdigest(), feature(width, height, samples)))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    # Stored, so that the join to references can split a digest that many pages share.
    return common.store(common.bound_batches(media).mapInArrow(run, schema).dropDuplicates(["digest"]))


def references(parsed: DataFrame, described: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each media reference: `keep`, pos, alt, caption and what its digest resolves to (else nulls)."""
    media = F.filter("items", lambda i: i["kind"] == "media")
    each = parsed.select(*keep, F.explode(F.transform(media, lambda i: F.struct(i["pos"].alias("pos"), i["digest"].alias("digest"), i["alt"].alias("alt"), i["caption"].alias("caption")))).alias("_i"))
    each = each.select(*keep, "_i.*")
    return each.join(described, "digest", "left")


def interleave(pages: DataFrame, media: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Pages as interleaved sequences: `key` and items; each media item also has the resolved columns of describe().

    Rows with equal keys stay apart; pages without items have an empty array; other columns are not read.
    """
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{html}`").alias("html"), F.monotonically_increasing_id().alias("rid"))
    parsed = common.store(parse(rows, ["rid", "key"]))
    held = describe(media)
    found = references(parsed, held, ["rid"])
    values = F.struct(*[c for c in held.columns if c != "digest"])
    grouped = found.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", values.alias("v")))).alias("found"))
    joined = parsed.join(grouped, "rid", "left")
    items = F.transform("items", lambda i: F.struct(*[i[n].alias(n) for n in ITEM], F.try_element_at("found", i["pos"]).alias("media")))
    return joined.select(F.col("key").alias(key), items.alias("items"))


def payload_of(text: str = "text") -> Column:
    """The text's UTF-8 bytes (null: none), with blanks up to a positive multiple of ROW bytes."""
    body = common.text_bytes(text)
    length = F.greatest(F.ceil(F.length(body) / ROW), F.lit(1)) * ROW
    return F.rpad(body, length.cast("int"), F.lit(b" "))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page with its text and one picture made of it; the row is what the reference resolves to.

    media_pos, alt and caption are those of the page's sequence; items counts its texts and media.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    payload = payload_of()
    described = describe(store_media(docs.select(payload.alias("payload"))))
    text = F.coalesce("text", F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    digest = F.sha2(to_pixmap(payload), 256)
    figure = F.concat(F.lit('<figure><img src="media/'), digest, F.lit('.ppm" alt="the text\'s bytes"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    pages = docs.select("doc_id", F.length(common.text_bytes()).cast("long").alias("n_bytes"), F.concat(F.lit("<article><p>"), text, F.lit("</p>"), figure, F.lit("</article>")).alias("html"))
    keep = ["doc_id", "n_bytes", "n_items"]
    parsed = parse(pages, keep[:2]).withColumn("n_items", F.size("items"))
    found = references(parsed, described, keep)
    return found.select(*keep[:2], "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("pos").alias("media_pos"), "alt", "caption", "n_items")
