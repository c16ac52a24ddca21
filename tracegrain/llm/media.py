"""Operator 4: media columns as interleaved document sequences.

parse_sequence() reads HTML into an ordered array of structs: runs of text, and
media references with their digest, alternative text and caption.  resolve()
joins the references with a media table by digest; positions and captions come
from the sequence and so stay aligned whatever the join does.

Media are stored losslessly: encode_image() lays bytes out as an 8-bit greyscale
image, 64 samples a row (PGM, a documented raw format), which is why a payload
is padded with zeros to a positive multiple of 64 bytes; decode_image() reads
the header and returns the samples.  The feature is the 64-bit average hash of
the image's 64 columns followed by the entropy of its samples.

Scale: payloads are never shuffled.  Each is stored in a table in the shared
folder; a second job reads the stored bytes back and reduces them to digests and
features.  Media rows are made distinct by digest before the join, which leaves
one row of a hot digest on that side, and the other side is an ordinary sort-merge
join that Spark can split.

Edge cases: null and empty texts are a payload of 64 zeros with n_bytes 0; equal
texts share one media row; repeated rows are all returned; references without
payload keep their place with null values; malformed HTML is text as far as it
can be read; an empty table gives no rows.  Extra columns of resolve() stay; those named
like the place or a media column get _in appended.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, out_of_the_way, small_batches

ROW = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_MEDIA = {"img", "video", "audio", "source", "embed"}


def encode_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def decode_image(stored: bytes) -> bytes:
    kind, size, top, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit greyscale image")
    return samples


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % ROW or (0 if raw else ROW))


def feature_of(samples: bytes) -> str:
    image = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    columns = image.sum(axis=0, dtype=np.int64)
    bits = int("".join("1" if c * ROW > columns.sum() else "0" for c in columns), 2)
    share = np.bincount(image.ravel(), minlength=256) / image.size
    share = share[share > 0]
    return f"{bits:016x}:{-(share * np.log2(share)).sum() + 0.0:.6f}"


def _encode(batches):
    """(digest, text) to (digest, media)."""
    for pdf in batches:
        yield pd.DataFrame({"digest": pdf["digest"], "media": pd.Series([encode_image(payload_of(text)) for text in pdf["text"]], dtype=object)})


def _describe(batches):
    """(digest, media) to the media row of each payload, from its stored bytes."""
    for pdf in batches:
        rows = []
        for digest, stored in zip(pdf["digest"], pdf["media"], strict=True):
            back = decode_image(stored)
            rows.append((
                digest, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]),
                len(stored), hashlib.sha256(stored).hexdigest(), feature_of(back),
            ))
        yield pd.DataFrame(rows, columns=MEDIA.replace(" string", "").replace(" long", "").split(", "))


MEDIA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_of(text: Column) -> Column:
    """Names a payload without padding: the sha256 of the text's bytes."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def stored_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, media): every row's payload as an image, written as a table."""
    light = small_batches(docs).select(digest_of(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return cut(light.mapInPandas(_encode, "digest string, media binary"))


def media_table(stored: DataFrame) -> DataFrame:
    """A row for each distinct payload of stored_media()."""
    return stored.mapInPandas(_describe, MEDIA).dropDuplicates(["digest"])


def sequence_of(page: str | None) -> list[tuple]:
    """The ordered parts of a page: (position, kind, text, digest, caption)."""
    out, text, at, captions, inside = [], [], 0, [], False
    page = page or ""

    def flush():
        run = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if run:
            if inside and out and out[-1][1] == "media":
                captions.append((len(out) - 1, run))
            else:
                out.append([len(out), "text", run, None, None])

    for m in _TAG.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "figcaption":
            flush()
            inside = not m[2]
        elif name in _MEDIA and not m[2]:
            flush()
            given = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(m[4])}
            if src := given.get("src"):
                out.append([len(out), "media", given.get("alt"), src.removeprefix("sha256:"), None])
        elif name not in ("a", "b", "i", "em", "strong", "span", "u", "small", "sub", "sup"):
            flush()
    text.append(page[at:])
    flush()
    for i, caption in captions:
        out[i][4] = caption if out[i][4] is None else f"{out[i][4]} {caption}"
    return [tuple(x) for x in out]


def parse_sequence(page: Column) -> Column:
    @F.pandas_udf(SEQUENCE)
    def f(pages: pd.Series) -> pd.Series:
        names = ("position", "kind", "text", "digest", "caption")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in sequence_of(p)] for p in pages])

    return f(page)


def resolve(pages: DataFrame, sequence: str, media: DataFrame) -> DataFrame:
    """A row for each media reference of ``sequence``, with its place, its caption and the payload's media row."""
    part, own = fresh("part"), fresh("sequence")
    pages = out_of_the_way(pages.withColumnRenamed(sequence, own), "position", "caption", sequence, *media.columns)
    refs = pages.withColumnRenamed(own, sequence).withColumn(part, F.explode(sequence)).where(F.col(f"{part}.kind") == "media")
    refs = refs.withColumns({"position": F.col(f"{part}.position"), "digest": F.col(f"{part}.digest"), "caption": F.col(f"{part}.caption")})
    return refs.drop(part).join(media.hint("merge"), "digest", "left")


def text_media(docs: DataFrame) -> DataFrame:
    """Every document as a page that refers to its text's payload, resolved."""
    pages = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest_of(F.col("text")).alias("d"))
    page = F.concat(
        F.lit('<figure><img src="sha256:'), "d", F.lit('" alt="text"><figcaption>'),
        F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"),
    )
    pages = pages.select("doc_id", "n_bytes", parse_sequence(page).alias("sequence"))
    return resolve(pages, "sequence", media_table(stored_media(docs)))
