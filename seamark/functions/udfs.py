"""What columns cannot say: international domains, relative urls, HTML, image headers and hashes. All Arrow batches."""

from __future__ import annotations

import struct
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.functions.exprs import SUFFIXES, canonical_ascii, registrable


def idna_host(host: str | None) -> str | None:
    if not host:
        return None
    import idna

    name, _, port = host.partition(":")
    try:
        return idna.encode(name, uts46=True).decode() + (f":{port}" if port else "")
    except idna.IDNAError:
        return host


def canonical_host(url: str) -> str | None:
    """canonical_domain() of one text."""
    host = url.strip().lower().partition("://")[2] or url.strip().lower()
    for mark in "/?#":
        host = host.partition(mark)[0]
    name, colon, port = host.rpartition(":")
    if colon and port in ("80", "443") and not host.startswith("["):
        host = name
    return idna_host(host.rstrip(".").removeprefix("www.")) or None


@F.pandas_udf(T.StringType())
def to_idna(hosts: pd.Series) -> pd.Series:
    return hosts.map(idna_host, na_action="ignore")


def canonical_domain(url: Column, strip_subdomains: bool = False, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """ASCII hosts stay in the JVM; only others go through the UDF. With strip_subdomains, the registrable domain."""
    host = canonical_ascii(url)
    whole = F.when(host.rlike(r"^[\x00-\x7F]*$"), host).otherwise(to_idna(host))
    return registrable(whole, suffixes) if strip_subdomains else whole


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, ref: pd.Series) -> pd.Series:
    def one(b, r):
        try:
            return urljoin(b, r) if b is not None and r is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


class References(HTMLParser):
    """img src and srcset, srcset of sources in a picture, the first og:image, a href, and signs of a login page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.pictures, self.in_title, self.title, self.password, self.og = 0, False, "", False, False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "img":
            if a.get("src"):
                self.found.append(("img", a["src"]))
            if a.get("srcset"):
                self.found.append(("srcset", a["srcset"]))
        elif tag == "picture":
            self.pictures += 1
        elif tag == "source" and self.pictures and a.get("srcset"):
            self.found.append(("srcset", a["srcset"]))
        elif tag == "meta" and a.get("property") == "og:image" and not self.og:
            self.og = True
            if a.get("content"):
                self.found.append(("og", a["content"]))
        elif tag == "a" and "href" in a:
            self.found.append(("link", a["href"]))
        elif tag == "input" and a.get("type", "").lower() == "password":
            self.password = True
        elif tag == "title":
            self.in_title = True

    def handle_endtag(self, tag):
        if tag == "picture":
            self.pictures = max(0, self.pictures - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data


def references(html: str | None) -> dict:
    p = References()
    p.feed(html or "")
    p.close()
    title = p.title.lower()
    return {"refs": [{"ordinal": i, "kind": k, "value": v} for i, (k, v) in enumerate(p.found)], "login": p.password or "login" in title or "sign in" in title}


REFERENCE = T.StructType().add("ordinal", T.IntegerType()).add("kind", T.StringType()).add("value", T.StringType())


@F.pandas_udf(T.StructType().add("refs", T.ArrayType(REFERENCE)).add("login", T.BooleanType()))
def parsed_html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([references(h) for h in html], columns=["refs", "login"])


#: Colour types of PNG, and numbers of components of JPEG, by mode.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}


def image_info(data: bytes | None) -> tuple[int | None, int | None, str | None, str | None]:
    """Width, height, format and mode from the headers of PNG, JPEG, MPO (a JPEG with an index of several pictures) and WEBP."""
    none = (None, None, None, None)
    if not data:
        return none
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 26:
        return (*struct.unpack(">II", data[16:24]), "PNG", "1" if data[24] == 1 and data[25] == 0 else PNG_MODES.get(data[25]))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, "WEBP", "RGBA" if data[20] & 16 else "RGB"
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "WEBP", "RGBA" if bits >> 28 & 1 else "RGB"
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF, "WEBP", "RGB"
    if data[:2] == b"\xff\xd8":
        at, kind = 2, "JPEG"
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if mark == 0xE2 and data[at + 4 : at + 8] == b"MPF\0":
                kind = "MPO"
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h, kind, JPEG_MODES.get(data[at + 9])
            at += 2 + size
    return none


@F.pandas_udf(T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("format", T.StringType()).add("mode", T.StringType()))
def image_header(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_info(x) for x in data], columns=["width", "height", "format", "mode"]).astype({"width": "Int32", "height": "Int32"})


def png_luma(data: bytes) -> np.ndarray | None:
    """Brightness of an 8-bit PNG without interlacing; None for anything else."""
    try:
        w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
        channels = {0: 1, 2: 3, 6: 4}.get(color)
        if data[:8] != b"\x89PNG\r\n\x1a\n" or depth != 8 or interlaced or not channels:
            return None
        at, body = 8, b""
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IDAT":
                body += data[at + 8 : at + 8 + size]
            at += 12 + size
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
        out = np.zeros((h, w * channels), np.uint8)
        for y in range(h):
            line, up = rows[y, 1:].astype(np.int64), out[y - 1].astype(np.int64) if y else np.zeros(w * channels, np.int64)
            how = rows[y, 0]
            if how == 2:
                line = line + up
            elif how:
                for x in range(len(line)):
                    a, b, c = (line[x - channels] if x >= channels else 0), up[x], (up[x - channels] if x >= channels else 0)
                    guess = a if how == 1 else (a + b) // 2 if how == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                    line[x] = (line[x] + guess) & 255
            out[y] = line & 255
        pixels = out.reshape(h, w, channels).astype(float)
        return pixels[..., 0] if channels == 1 else pixels[..., :3] @ np.array([0.299, 0.587, 0.114])
    except (struct.error, zlib.error, ValueError):
        return None


def shrunk(luma: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over a grid of h x w cells."""
    rows, columns = np.linspace(0, luma.shape[0], h + 1), np.linspace(0, luma.shape[1], w + 1)
    cell = lambda e, i: slice(int(e[i]), max(int(e[i]) + 1, int(e[i + 1])))
    return np.array([[luma[cell(rows, y), cell(columns, x)].mean() for x in range(w)] for y in range(h)])


def perceptual(luma: np.ndarray) -> tuple[str, str]:
    """pHash (low frequencies against their median) and dHash (rising from left to right), 16 hex digits each."""
    small = shrunk(luma, 32, 32)
    k, x = np.arange(8)[:, None], np.arange(32)
    basis = np.cos(np.pi * k * (2 * x + 1) / 64)
    low = basis @ small @ basis.T
    rise = shrunk(luma, 8, 9)
    hexed = lambda bits: f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"
    return hexed(low > np.median(low)), hexed(rise[:, 1:] > rise[:, :-1])


@F.pandas_udf(T.StructType().add("phash", T.StringType()).add("dhash", T.StringType()))
def perceptual_hashes(data: pd.Series) -> pd.DataFrame:
    lumas = [png_luma(x) if x else None for x in data]
    return pd.DataFrame([perceptual(x) if x is not None and x.size else (None, None) for x in lumas], columns=["phash", "dhash"])
