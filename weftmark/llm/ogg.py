"""Ogg media columns: write and take apart Ogg bitstreams (operator 4)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
BEGIN, END, CONTINUED = 2, 4, 1
#: Granule positions of the two codecs that mux_text writes count units of this many to the second.
RATES = {"weftline": 1000, "weftmeta": 1}


def checksum(page: bytes) -> int:
    """The CRC of a page whose checksum field is zero: polynomial 0x04c11db7, high bit first, from zero.

    It equals the mirrored form of the CRC that zlib computes over mirrored bytes.
    """
    low = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def mux(serial: int, packets: Iterable[tuple[bytes, int]]) -> Iterator[bytes]:
    """The pages of one logical stream of (packet, granule position after it); a page is closed at 255 segments."""
    segments: list[tuple[bytes, int, bool]] = []  # (bytes, granule where a packet ends here or -1, starts a packet)
    for data, granule in packets:
        n = len(data) // 255
        segments += [(data[i * 255 : i * 255 + 255], -1, i == 0) for i in range(n)]
        segments.append((data[n * 255 :], granule, n == 0))
    pages = [segments[i : i + 255] for i in range(0, len(segments), 255)] or [[]]
    for i, part in enumerate(pages):
        flags = (BEGIN if i == 0 else 0) | (END if i == len(pages) - 1 else 0) | (CONTINUED if part and not part[0][2] else 0)
        granule = next((g for _, g, _ in reversed(part) if g >= 0), -1)
        yield page(serial, i, flags, granule, bytes(len(s) for s, _, _ in part), b"".join(s for s, _, _ in part))


def mux_text(text: str | None, serial: int, about: str = "") -> bytes | None:
    """A file of two logical streams with their pages in turn: the lines of a text, and one packet about it.

    Each stream opens with a header packet that names its codec. A line's
    granule position is the number of characters up to its end. Null gives null.
    """
    if text is None:
        return None
    lines: list[tuple[bytes, int]] = [(b"weftline", 0)]
    at = 0
    for line in text.split("\n"):
        at += len(line)
        lines.append((line.encode("utf-8", "surrogatepass"), at))
    a = list(mux(serial & 0x7FFFFFFF, lines))
    b = list(mux(serial & 0x7FFFFFFF | 0x80000000, [(b"weftmeta", 0), (about.encode(), 1)]))
    out = [a[0], b[0]]
    for i in range(1, max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


def demux(data: bytes) -> list[dict]:
    """The logical streams of a file, in the order of their first good page.

    A page counts if its capture pattern, version and checksum are right;
    otherwise the search goes on at the next capture pattern, and the bytes
    passed over are counted in ``skipped`` of every stream of the file. A packet
    that misses a page (a gap in the sequence numbers, or a continuation flag
    that doesn't fit) or that has no end is dropped and counted in ``broken``.
    A serial number that begins again after its end is a new stream (chaining).
    """
    streams: list[dict] = []
    live: dict[int, dict] = {}
    at, skipped, n = 0, 0, len(data)
    while at < n:
        if data[at : at + 4] != b"OggS" or at + 27 > n or data[at + 4] != 0:
            ahead = data.find(b"OggS", at + 1)
            ahead = n if ahead < 0 else ahead
            skipped += ahead - at
            at = ahead
            continue
        _, _, flags, granule, serial, sequence, crc, count = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        whole = data[at : at + size]
        if len(lacing) < count or len(whole) < size or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            ahead = data.find(b"OggS", at + 1)
            ahead = n if ahead < 0 else ahead
            skipped += ahead - at
            at = ahead
            continue
        at += size
        s = live.get(serial)
        if s is None or (flags & BEGIN and s["ended"]):
            s = {"serial": serial, "pages": 0, "broken": 0, "lost_pages": 0, "packets": [], "granules": [], "held": None, "next": sequence, "ended": False}
            live[serial] = s
            streams.append(s)
        s["pages"] += 1
        gap = sequence != s["next"]
        if gap:
            s["lost_pages"] += max(sequence - s["next"], 1)
        s["next"] = sequence + 1
        drop = False
        if s["held"] is not None and (gap or not flags & CONTINUED):
            s["broken"] += 1
            s["held"] = None
        if flags & CONTINUED and s["held"] is None:
            drop = True
        position = 27 + count
        last = len(s["packets"])
        begin = position
        for length in lacing:
            position += length
            if length < 255:
                body = whole[begin:position]
                if drop:
                    s["broken"] += 1
                    drop = False
                else:
                    s["packets"].append(body if s["held"] is None else s["held"] + body)
                    s["granules"].append(-1)
                s["held"] = None
                begin = position
        if begin < position and not drop:
            s["held"] = (s["held"] or b"") + whole[begin:position]
        elif count and lacing[-1] == 255 and drop:
            s["held"] = None
        if granule >= 0 and len(s["packets"]) > last:
            s["granules"][-1] = granule
        if flags & END:
            s["ended"] = True
    for s in streams:
        s["broken"] += s.pop("held") is not None
        s["skipped"] = skipped
    return streams


_STREAM = "array<struct<serial:bigint,codec:string,pages:int,lost_pages:int,skipped_bytes:bigint,packets:int,broken_packets:int,payload_bytes:bigint,payload_md5:string,first_granule:bigint,last_granule:bigint,start_s:double,end_s:double>>"


def identify(head: bytes, rates: dict[str, int] = RATES) -> tuple[str | None, int, Callable[[int], float] | None]:
    """(codec, header packets, seconds of a granule position) of a stream by its first packet.

    Vorbis, Opus, FLAC, Speex and Theora say their rates in that packet; others
    are called by its text, and ``rates`` may have one for it.
    """
    if head[:7] == b"\x01vorbis" and len(head) >= 16:
        rate = int.from_bytes(head[12:16], "little")
        return "vorbis", 3, (lambda g: g / rate) if rate else None
    if head[:8] == b"OpusHead" and len(head) >= 12:
        skip = int.from_bytes(head[10:12], "little")  # samples to drop at the start; positions always count 48 kHz
        return "opus", 2, lambda g: max(g - skip, 0) / 48000
    if head[:5] == b"\x7fFLAC" and len(head) >= 30:
        rate = int.from_bytes(head[27:30], "big") >> 4
        return "flac", 1 + int.from_bytes(head[7:9], "big"), (lambda g: g / rate) if rate else None
    if head[:8] == b"Speex   " and len(head) >= 40:
        rate = int.from_bytes(head[36:40], "little")
        return "speex", 2 + (int.from_bytes(head[68:72], "little") if len(head) >= 72 else 0), (lambda g: g / rate) if rate else None
    if head[:7] == b"\x80theora" and len(head) >= 42:
        top, bottom, shift = int.from_bytes(head[22:26], "big"), int.from_bytes(head[26:30], "big"), (int.from_bytes(head[40:42], "big") >> 5) & 31
        # a position is the last key frame and the frames since
        return "theora", 3, (lambda g: ((g >> shift) + (g & ((1 << shift) - 1))) * bottom / top) if top else None
    codec = head.decode("latin-1") or None
    rate = rates.get(codec or "")
    return codec, 1, (lambda g: g / rate) if rate else None


def _summary(s: dict, rates: dict[str, int]) -> dict:
    codec, headers, seconds = identify(s["packets"][0] if s["packets"] else b"", rates)
    body = s["packets"][headers:]
    marks = [g for g in s["granules"][headers:] if g >= 0]
    payload = b"\n".join(body)
    return {
        "serial": s["serial"], "codec": codec, "pages": s["pages"], "lost_pages": s["lost_pages"], "skipped_bytes": s["skipped"], "packets": len(body),
        "broken_packets": s["broken"], "payload_bytes": sum(map(len, body)), "payload_md5": hashlib.md5(payload).hexdigest(),
        "first_granule": marks[0] if marks else None, "last_granule": marks[-1] if marks else None,
        "start_s": seconds(marks[0]) if marks and seconds else None, "end_s": seconds(marks[-1]) if marks and seconds else None,
    }


def streams(media: DataFrame, key: str = "doc_id", column: str = "media", rates: dict[str, int] = RATES) -> DataFrame:
    """One row for each logical stream of each Ogg file in a binary column.

    Columns: the key, serial, codec (see ``identify``), pages, lost_pages,
    skipped_bytes (of the file, outside good pages), packets (without the
    codec's headers), broken_packets, payload_bytes, payload_md5 (of the packets
    joined by line feeds), the granule positions of the first and last packet
    that have one, and these in seconds as the codec counts them.

    Null, empty and non-Ogg values have no streams and give no rows. Repeated
    rows give repeated results; null keys are kept; other columns are left out.
    Granules are known only for the last packet that ends on a page, as the
    format has it; times are null for a codec without a rate. Files and packets of
    any length are read whole; streams of equal serial in one file are told apart
    by their beginnings; an empty table gives no rows. Keys may be of any type.
    """

    @F.pandas_udf(_STREAM)
    def parse(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [_summary(s, rates) for s in demux(bytes(v))] if v is not None else [])

    return media.select(F.col(key).alias("_key"), F.explode(parse(F.col(column))).alias("_s")).select(F.col("_key").alias(key), "_s.*")


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text", about: str = "lang") -> DataFrame:
    """(key, media): each text as an Ogg file by mux_text; the serial number is derived from the key, of any type, and is 0 for null.

    Null texts give null, empty ones a file of one empty line; repeated rows give repeated files.
    """

    @F.pandas_udf("binary")
    def write(texts: pd.Series, serials: pd.Series, abouts: pd.Series) -> pd.Series:
        return pd.Series([mux_text(t, int(s), a or "") for t, s, a in zip(texts, serials, abouts, strict=True)], dtype=object)

    number = F.col(key) if isinstance(docs.schema[key].dataType, IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    serial = F.coalesce(F.pmod(number.cast("bigint"), F.lit(1 << 31)), F.lit(0)).cast("bigint")
    return docs.select(F.col(key).alias(key), write(F.col(text), serial, F.col(about)).alias("media"))


def streams_sql(documents: str = "documents") -> str:
    """What the streams of text_media must be, from the texts alone, in DuckDB. A packet of n bytes has n // 255 + 1 segments."""
    return f"""
with ogg_lines as (
  select doc_id, lang, text, string_split(text, chr(10)) as lines from {documents} where text is not null),
ogg_sizes as (
  select *, list_transform(lines, lambda x: strlen(x)) as sizes from ogg_lines),
ogg_marks as (
  select *, list_concat([8], sizes) as packet_sizes, len(replace(text, chr(10), '')) as n_chars_in from ogg_sizes),
ogg_segments as (
  select *, list_transform(packet_sizes, lambda x: x // 255 + 1) as segs from ogg_marks),
ogg_ends as (
  select doc_id, p, sum(seg) over (partition by doc_id order by p) as upto, sum(chars) over (partition by doc_id order by p) as granule
  from (select doc_id, unnest(range(1, len(segs) + 1)) as p, unnest(segs) as seg, unnest(list_concat([0], list_transform(lines, lambda x: len(x)))) as chars from ogg_segments)),
ogg_page_last as (
  select doc_id, (upto - 1) // 255 as page, max(p) as p, max(granule) as granule from ogg_ends group by 1, 2),
ogg_first as (
  select doc_id, min(granule) filter (p > 1) as first_granule, max(granule) filter (p > 1) as last_granule from ogg_page_last group by 1)
select s.doc_id, (s.doc_id % 2147483648)::bigint as serial, 'weftline' as codec, ((list_sum(segs) + 254) // 255)::int as pages, 0::int as lost_pages, 0::bigint as skipped_bytes,
       len(lines)::int as packets, 0::int as broken_packets, list_sum(sizes)::bigint as payload_bytes, md5(text) as payload_md5,
       first_granule::bigint as first_granule, last_granule::bigint as last_granule, first_granule / 1000.0::double as start_s, last_granule / 1000.0::double as end_s
from ogg_segments s join ogg_first f on s.doc_id = f.doc_id
union all
select doc_id, (doc_id % 2147483648 + 2147483648)::bigint, 'weftmeta', 1, 0, 0, 1, 0, strlen(coalesce(lang, ''))::bigint, md5(coalesce(lang, '')), 1, 1, 1.0::double, 1.0::double
from {documents} where text is not null"""
