"""Media columns from ISO base media containers (ISO/IEC 14496-12).

``media_columns`` walks the nested boxes of each file, decodes the sample tables of its tracks
and stores codec, time scale, duration, sample count and the byte ranges of keyframes; payloads
aren't decoded. ``pack`` makes such a container from any bytes, as raw 8-bit samples of ``UNIT``
bytes, and ``unpack`` reads the stored samples back by the tables.

Each row stands alone: no shuffle; a task holds one Arrow batch of rows and their containers. Null
media give null columns; bytes that aren't a container give an ``error`` and no tracks; of
fragmented files, only what their ``moov`` tells is read. Equal bytes give equal values, so repeated
rows do. An empty table gives an empty result; other columns pass through, but for any named
``error`` or ``tracks``, which ours replace.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import shipped, table

UNIT = 64
TIMESCALE = 8000
KEYFRAME_EVERY = 16
SAMPLES_A_CHUNK = 1024
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf")
#: Containers within each other, of which a track has five.
DEPTH = 32
TRACK = "struct<track_id:int,kind:string,codec:string,timescale:long,duration:long,n_samples:long,media_bytes:long,keyframes:array<struct<offset:long,length:long>>>"


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and end of the contents of each box in a range."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} has a wrong size")
        yield kind, start + head, start + size
        start += size


def _tables(data: memoryview, start: int, end: int, found: dict, depth: int = 0) -> dict:
    if depth > DEPTH:
        raise ValueError("boxes are nested too deep")
    for kind, a, b in boxes(data, start, end):
        if kind in CONTAINERS:
            _tables(data, a, b, found, depth + 1)
        else:
            found.setdefault(kind, (a, b))
    return found


def _column(data: memoryview, at: tuple[int, int], fmt: str, skip: int = 4) -> list[tuple]:
    n = struct.unpack_from(">I", data, at[0] + skip)[0]
    width = struct.calcsize(fmt)
    if at[0] + skip + 4 + n * width > at[1]:
        raise ValueError("a sample table is cut off")
    return list(struct.iter_unpack(fmt, data[at[0] + skip + 4 : at[0] + skip + 4 + n * width]))


def samples(data: memoryview, t: dict) -> list[tuple[int, int]]:
    """Offset and length of each sample: sizes from stsz, chunks from stsc and stco or co64."""
    fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
    if fixed * n > len(data):
        raise ValueError("more samples than the file has bytes for")
    sizes = [fixed] * n if fixed else [x for (x,) in _column(data, t[b"stsz"], ">I", 8)]
    chunks = [x for (x,) in (_column(data, t[b"co64"], ">Q") if b"co64" in t else _column(data, t[b"stco"], ">I"))]
    runs, out, k = _column(data, t[b"stsc"], ">III"), [], 0
    for i, (first, each, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        if first < 1:
            raise ValueError("chunks are counted from 1")
        for c in range(first - 1, last - 1):
            at = chunks[c]
            for _ in range(each):
                if k == len(sizes):
                    return out
                out.append((at, sizes[k]))
                at += sizes[k]
                k += 1
    if k < len(sizes):
        raise ValueError("the chunks hold fewer samples than the table of sizes")
    return out


def tracks(media: bytes) -> list[dict]:
    """What ``media_columns`` holds for each track."""
    data, out = memoryview(media), []
    for kind, a, b in boxes(data, 0, len(data)):
        if kind != b"moov":
            continue
        for inner, c, d in boxes(data, a, b):
            if inner != b"trak":
                continue
            t = _tables(data, c, d, {})
            wide = data[t[b"mdhd"][0]] == 1
            timescale, duration = struct.unpack_from(">IQ" if wide else ">II", data, t[b"mdhd"][0] + (20 if wide else 12))
            codec = bytes(data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin-1").strip()
            every = samples(data, t)
            keys = [x - 1 for (x,) in _column(data, t[b"stss"], ">I")] if b"stss" in t else range(len(every))
            if any(not 0 <= k < len(every) for k in keys):
                raise ValueError("a keyframe that is none of the samples")
            track_id = struct.unpack_from(">I", data, t[b"tkhd"][0] + (20 if data[t[b"tkhd"][0]] == 1 else 12))[0]
            out.append(
                {
                    "track_id": track_id, "kind": bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin-1"), "codec": codec,
                    "timescale": timescale, "duration": duration, "n_samples": len(every), "media_bytes": sum(n for _, n in every),
                    "keyframes": [{"offset": every[k][0], "length": every[k][1]} for k in keys],
                }
            )
    return out


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) < 1 << 31 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def pack_bytes(payload: bytes) -> bytes:
    """A container whose only track holds the payload as raw 8-bit samples of ``UNIT`` bytes."""
    n = len(payload) // UNIT
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    body = _box(b"mdat", payload)
    start = len(head) + len(body) - len(payload)
    chunks = range(0, n, SAMPLES_A_CHUNK)
    full, rest = divmod(n, SAMPLES_A_CHUNK)
    runs = [(1, SAMPLES_A_CHUNK, 1)] * (full > 0) + [(full + 1, rest, 1)] * (rest > 0)
    keys = range(1, n + 1, KEYFRAME_EVERY)
    full_box = lambda kind, *parts: _box(kind, b"\0\0\0\0", *parts)
    counted = lambda kind, fmt, rows: full_box(kind, struct.pack(">I", len(rows)), *(struct.pack(fmt, *r) for r in rows))
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    table_ = _box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        counted(b"stts", ">II", [(n, UNIT)]),
        counted(b"stsc", ">III", runs),
        full_box(b"stsz", struct.pack(">II", UNIT, n)),
        counted(b"co64", ">Q", [(start + c * UNIT,) for c in chunks]),
        counted(b"stss", ">I", [(k,) for k in keys]),
    )
    minf = _box(b"minf", full_box(b"smhd", bytes(4)), _box(b"dinf", counted(b"dref", ">I4sI", [(12, b"url ", 1)])), table_)
    mdia = _box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * UNIT, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
    tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * UNIT), bytes(8), bytes(8), matrix, bytes(8))
    mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n * UNIT, 1 << 16, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return head + body + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of ``UNIT``."""
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def unpack_bytes(media: bytes) -> bytes:
    """The samples of the first track in their order."""
    data = memoryview(media)
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"moov":
            for inner, c, d in boxes(data, a, b):
                if inner == b"trak":
                    return b"".join(data[o : o + n] for o, n in samples(data, _tables(data, c, d, {})))
    raise ValueError("no track")


def pack(text: Column | str) -> Column:
    """The container of a text's UTF-8 bytes, padded; null counts as empty."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: pack_bytes(padded((x or "").encode())))

    return F.pandas_udf(run, "binary")(text)


def read_tracks(media: Column | str) -> Column:
    def one(x):
        if x is None:
            return None, None
        try:
            return None, tracks(x)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return f"{type(e).__name__}: {e}", []

    def run(media: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in media], columns=["error", "tracks"])

    return F.pandas_udf(run, f"struct<error:string,tracks:array<{TRACK}>>")(media)


def unpack(media: Column | str) -> Column:
    """The bytes of the first track's samples and the CRC-32 of the last ``UNIT`` of them."""

    def run(media: pd.Series) -> pd.DataFrame:
        read = [unpack_bytes(x) for x in media]
        return pd.DataFrame({"payload": read, "tail_crc32": [zlib.crc32(x[-UNIT:]) for x in read]})

    return F.pandas_udf(run, "struct<payload:binary,tail_crc32:long>")(media)


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns of ``df``, with ``error`` and ``tracks``."""
    shipped(df.sparkSession)
    kept = [f"`{c}`" for c in df.columns if c not in ("error", "tracks")]
    return df.withColumn("__media", read_tracks(media)).select(*kept, "__media.error", "__media.tracks")


def op5_iso_media(spark, sf_dir):
    shipped(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), pack("text").alias("media"))
    read = media_columns(docs).withColumn("__read", unpack("media"))
    first = F.col("tracks")[0]
    keys = first["keyframes"]
    feature = F.concat_ws(
        "|", first["kind"], first["codec"], first["timescale"].cast("string"), first["duration"].cast("string"), first["n_samples"].cast("string"),
        F.size(keys).cast("string"), keys[0]["offset"].cast("string"), F.sha2(F.to_json(keys), 256),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("__read.payload").cast("long").alias("payload_bytes"),
        F.sha2("__read.payload", 256).alias("payload_sha256"),
        F.col("__read.tail_crc32").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
