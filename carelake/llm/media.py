"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest.

HTML is parsed into an ordered array of structs, each a run of text or a media reference with its caption, at its position. References name
payloads by digest; a join on the digest gives each its payload's facts, and positions and captions stay with their reference. Payloads are
kept as 8-bit grey images (PGM, 64 samples wide), which any bytes fit without loss.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, staged

WIDTH = 64
ITEM = "struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>"
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "source": "media", "embed": "media"}
BLOCKS = frozenset("p div li ul ol table tr td th section article header footer h1 h2 h3 h4 h5 h6 br hr blockquote pre figure figcaption main nav body".split())
HIDDEN = frozenset(["script", "style", "template", "noscript", "head"])
DIGEST = re.compile(r"^sha256:([0-9a-f]{64})$")


class Interleaver(HTMLParser):
    """Collects the items of one page; a caption that follows or precedes its media within a figure goes to the figure's media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden, self.figure, self.caption = 0, None, None

    def close_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text and self.caption is not None:
            self.caption.append(text)
        elif text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag in BLOCKS or tag in MEDIA_TAGS:
            self.close_text()
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.figure, self.captions = len(self.items), []
        elif tag == "figcaption" and self.figure is not None:
            self.caption = self.captions
        elif tag in MEDIA_TAGS and own.get("src"):
            self.items.append({"kind": MEDIA_TAGS[tag], "src": own["src"], "caption": own.get("alt") or own.get("title") or None})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.close_text()
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.caption = None
        elif tag == "figure" and self.figure is not None:
            for item in self.items[self.figure :]:
                if item["kind"] != "text" and self.captions:
                    item["caption"] = " ".join(self.captions)
            self.figure = self.caption = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.append(data)


def items(html: str) -> list[tuple]:
    """(position, kind, text, src, digest, caption) in the order of the page; an unclosed figure ends with the page."""
    parser = Interleaver()
    parser.feed(html)
    parser.close()
    parser.close_text()
    if parser.figure is not None:
        parser.handle_endtag("figure")
    out = []
    for k, x in enumerate(parser.items):
        found = DIGEST.match(x.get("src") or "")
        out.append((k, x["kind"], x.get("text"), x.get("src"), found[1] if found else None, x.get("caption")))
    return out


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items) of each row: null and empty pages have an empty array; other columns are ignored."""
    return map_texts(pages.select(key, html), [key], html, lambda: lambda texts: [(items(x),) for x in texts], f"items array<{ITEM}>")


def resolve(found: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each media reference with n_items of its page and the store's columns for its digest; references that the store lacks, and
    those without a digest, keep nulls there.

    A digest that very many references share is a skewed key of a plain join of two shuffled sides, which the engine splits. Texts aren't shuffled.
    """
    media = F.filter("items", lambda x: x["kind"] != "text")
    refs = found.select(key, F.size("items").alias("n_items"), F.explode(media).alias("item")).select(key, "n_items", *[f"item.{c}" for c in ("position", "kind", "src", "digest", "caption")])
    return refs.join(store, "digest", "left")


def to_media(data: bytes) -> bytes:
    """The payload (data and zero bytes up to a positive multiple of 64) as a PGM image; a comment keeps the length of the data."""
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(data), WIDTH, rows) + data + bytes(rows * WIDTH - len(data))


def from_media(media: bytes) -> tuple[int, bytes]:
    """Length of the data and the payload of a stored image."""
    kind, note, size, depth, payload = media.split(b"\n", 4)
    width, rows = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(payload) != width * rows:
        raise ValueError("not a stored payload")
    return int(note.rsplit(b" ", 1)[1]), payload


def feature(payload: bytes) -> str:
    """Size, mean and entropy of the samples, and an average hash over an 8 by 8 grid of means."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    share = np.bincount(grey.ravel(), minlength=256) / grey.size
    entropy = -sum(p * math.log2(p) for p in share[share > 0].tolist())
    columns = grey.reshape(len(grey), 8, WIDTH // 8).sum(2, dtype=np.int64)
    edges = np.linspace(0, len(grey), 9).astype(int)
    grid = np.array([columns[a : max(b, a + 1)].mean(0) if a < len(grey) else np.zeros(8) for a, b in zip(edges, edges[1:], strict=False)])
    bits = np.packbits((grid > grid.mean()).ravel()).tobytes().hex()
    return f"{WIDTH}x{len(grey)};mean={float(grey.mean()):.4f};entropy={entropy:.4f};hash={bits}"


FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(media: bytes) -> tuple:
    n, payload = from_media(media)
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)


def page_of(text: str) -> str:
    """An article of the text's lines as paragraphs, with its stored payload as a figure amid them, referred to by digest."""
    name = hashlib.sha256(to_media(data := text.encode("utf-8", "surrogatepass"))).hexdigest()
    lines = [f"<p>{escape(x)}</p>" for x in text.split("\n") if x]
    figure = f'<figure><img src="sha256:{name}"><figcaption>{len(data)} bytes</figcaption></figure>'
    return "<article>" + "".join(lines[: len(lines) // 2]) + figure + "".join(lines[len(lines) // 2 :]) + "</article>"


def store_texts(docs: DataFrame) -> DataFrame:
    """(digest, media): each text as a stored payload; a task stores equal payloads once, as long as it remembers them (REMEMBERED digests)."""

    def make():
        seen: set[str] = set()

        def put(texts: list[str]) -> list[tuple]:
            out = []
            for x in texts:
                media = to_media(x.encode("utf-8", "surrogatepass"))
                name = hashlib.sha256(media).hexdigest()
                out.append((None, None) if name in seen else (name, media))
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
            return out

        return put

    return staged(map_texts(docs.select("text"), [], "text", make, "digest string, media binary").where("media IS NOT NULL"), "media")


REMEMBERED = 100_000


def read_facts(stored: DataFrame) -> DataFrame:
    """(digest, facts) of each different stored payload, from the bytes read back; equal digests are put together before the shuffle."""
    import pyarrow as pa

    fields = [f.split() for f in FACTS.split(", ")]

    def get(batches):
        for batch in batches:
            rows = [facts(x) for x in batch.column(1).to_pylist()]
            made = [pa.array([r[k] for r in rows], pa.int64() if t == "long" else pa.string()) for k, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["digest", *[n for n, _ in fields]])

    each = stored.select("digest", "media").mapInArrow(get, f"digest string, {FACTS}")
    return staged(each.groupBy("digest").agg(*[F.min(n).alias(n) for n, _ in fields]), "facts")


def store_and_read(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_items, position, caption) of each row of docs.

    Each text's page (page_of) is parsed into an interleaved sequence of its paragraphs and the reference to its payload, and the digest join puts
    what was read back beside the reference, with its position and caption. Null and empty texts are 64 zero bytes and a page of the figure alone.
    Equal texts have equal values, as the values come from the stored bytes alone. Repeated rows and null ids are kept.
    """
    store = read_facts(store_texts(docs))
    found = map_texts(docs.select("doc_id", "text"), ["doc_id"], "text", lambda: lambda texts: [(items(page_of(x)),) for x in texts], f"items array<{ITEM}>")
    names = [f.split()[0] for f in FACTS.split(", ")]
    return resolve(found, store, "doc_id").select("doc_id", *names, "n_items", "position", "caption")
