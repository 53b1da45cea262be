"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of segments, each a text run or a reference to a medium named by the digest of its payload,
with its position and its caption (figcaption, else alt). References resolve by a join on the digest against a media table that
holds each digest once; the segments' order, positions and captions are untouched by it. Payloads are stored as the
8-bit samples of a WAV file and read back by parsing that file.

Null or empty HTML is an empty sequence; a reference whose digest is in no row of the media table keeps null payload columns.
The store holds a payload for each document that refers to one; equal ones are folded by an aggregate over digests before the join,
combined map-side, so a payload that most documents share does not gather in one task. A head that is never closed ends where
content begins, a figcaption with its figure or page. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PAD, RATE = 64, 8000
SCHEME = "media:sha256/"
#: Elements that end a text run, and those whose content is no text.
BREAKS = frozenset("p div section article header footer main aside ul ol li table tr td th h1 h2 h3 h4 h5 h6 br hr blockquote pre figure".split())
SILENT = frozenset("script style template noscript head".split())
MEDIA = frozenset("img audio video source".split())
SEGMENT = "struct<position:int,kind:string,text:string,digest:string,caption:string>"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []
        self.hidden: list[str] = []

    @property
    def silent(self) -> bool:
        return bool(self.hidden)

    def caption_ends(self) -> None:
        """At its end tag, at its figure's, or at the page's."""
        if self.caption is None:
            return
        said, self.caption = " ".join("".join(self.caption).split()), None
        if not self.figure and said:  # of no medium: plain text
            self.out.append({"kind": "text", "text": said, "digest": None, "caption": None})
        for i in self.figure:
            self.out[i]["caption"] = said or self.out[i]["caption"]

    def flush(self) -> None:
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.out.append({"kind": "text", "text": run, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if self.silent and "head" in self.hidden and (tag == "body" or tag in BREAKS or tag in MEDIA):
            self.hidden.remove("head")  # a head ends where content begins, closed or not
        if tag in SILENT:
            self.hidden.append(tag)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = []
        elif tag in MEDIA:
            a = dict(attrs)
            src = a.get("src") or ""
            if src:
                self.flush()
                self.figure.append(len(self.out))
                self.out.append({"kind": "media", "text": src, "digest": src[len(SCHEME) :].lower() if src.startswith(SCHEME) else None, "caption": a.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in SILENT:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif tag == "figcaption":
            self.caption_ends()
        elif tag in BREAKS:
            if tag == "figure":
                self.caption_ends()
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.text.append(data)


def parse(html: str | None) -> list[dict]:
    """The ordered segments of one page."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.caption_ends()
    p.flush()
    return [{"position": i, **x} for i, x in enumerate(p.out)]


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, segments: the interleaved sequence of each page."""

    def run(batches):
        for batch in batches:
            got = [parse(x) for x in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=[key, "segments"])

    d = pages.select(key, html)
    return d.mapInArrow(common.task(run), f"`{key}` {d.schema[key].dataType.simpleString()}, segments array<{SEGMENT}>")


def resolved(seqs: DataFrame, media: DataFrame, key: str = "page_id", *more: str, counted: DataFrame | None = None) -> DataFrame:
    """A row for each segment, media segments with the columns of their row of `media` (digest, ...), by one join on the digest.

    more: further columns of seqs that rows keep. counted: digest and n, how often it is referred to; given that, references to
    one payload that very many pages share are dealt to several tasks.
    """
    flat = seqs.select(key, *more, F.explode("segments").alias("s")).select(key, *more, "s.*")
    named = flat.filter("digest is not null")
    named = named.join(media, "digest", "left") if counted is None else common.spread_join(named, media, ["digest"], counted, [key, "position"], "left")
    rest = flat.filter("digest is null").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in media.schema if f.name != "digest"))
    return named.unionByName(rest)  # text runs do not travel to the join


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of PAD."""
    return text + b"\0" * (max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def stored(payload: bytes) -> bytes:
    """The payload as the samples of a mono 8-bit WAV file."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def read_back(medium: bytes) -> bytes:
    with wave.open(io.BytesIO(medium)) as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit medium")
        return f.readframes(f.getnframes())


def feature(payload: bytes) -> str:
    """Level, spread, zero crossings around the middle, and the share of samples by quarter of their range."""
    x = np.frombuffer(payload, np.uint8)
    mid = x >= 128
    quarters = np.bincount(x >> 6, minlength=4) / len(x)
    return f"mean={x.mean():.6f};rms={np.sqrt(np.mean(np.square(x, dtype=np.float64))):.6f};crossings={int(np.count_nonzero(mid[1:] != mid[:-1]))};peak={int(x.max())};quarters=" + "/".join(f"{q:.6f}" for q in quarters)


def media_table(docs: DataFrame) -> DataFrame:
    """digest, medium, doc_id: the stored form of every padded text."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                pay = [padded(t.encode()) for t in common.texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in pay], pa.string()), pa.array([stored(p) for p in pay], pa.binary()), part.column(0)], names=["digest", "medium", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), "digest string, medium binary, doc_id long")


def pages_of(docs: DataFrame) -> DataFrame:
    """A page for each document: its text, a paragraph a line, then a figure that refers to its payload; the caption is its byte count."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                raw = [t.encode() for t in common.texts(part.column(1))]
                said = ["".join(f"<p>{escape(line)}</p>" for line in x.decode().split("\n")) for x in raw]
                html = [f'<article>{s}<figure><img src="{SCHEME}{hashlib.sha256(padded(x)).hexdigest()}" alt="bytes"><figcaption>{len(x)}</figcaption></figure></article>' for s, x in zip(said, raw, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(html, pa.string())], names=["doc_id", "html"])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), "doc_id long, html string")


def document_media(docs: DataFrame) -> DataFrame:
    """One row per document: sizes and digests of its stored payload, read back through the join, and its feature.

    Then the place of its reference among the segments of its page, and how many these are.
    """
    pages = sequences(pages_of(docs), "doc_id")
    media = F.filter("segments", lambda x: x["kind"] == "media").alias("segments")
    pages = common.written(pages.select("doc_id", media, F.size("segments").alias("n_segments")))  # parsed once, read by both parts of resolved()
    every = common.written(media_table(docs))  # the store; what follows reads its bytes back

    def measure(batches):
        for batch in batches:
            rows = []
            for medium in batch.column(1).to_pylist():
                p = read_back(medium)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(p)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    measured = every.select("digest", "medium").mapInArrow(common.task(measure), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    kept = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    once = measured.groupBy("digest").agg(*(F.min(c).alias(c) for c in kept))
    counted = common.written(every.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"))
    return resolved(pages, once, "doc_id", "n_segments", counted=counted).select("doc_id", F.col("caption").cast("long").alias("n_bytes"), *kept, "position", "n_segments")
