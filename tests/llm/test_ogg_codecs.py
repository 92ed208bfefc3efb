import struct

import pytest

from weftmark.llm import ogg

VORBIS = b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 2, 44100, 0, 128000, 0, 0xB8, 1)
OPUS = b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 44100, 0, 0)
FLAC = b"\x7fFLAC\x01\x00\x00\x01fLaC" + b"\x00\x00\x00\x22" + struct.pack(">HH", 4096, 4096) + b"\0" * 6 + ((96000 << 44) | (1 << 41) | (15 << 36)).to_bytes(8, "big") + b"\0" * 16
SPEEX = b"Speex   " + b"1.2".ljust(20, b"\0") + struct.pack("<13I", 1, 80, 16000, 1, 4, 1, 0xFFFFFFFF, 320, 0, 1, 0, 0, 0)
THEORA = b"\x80theora" + bytes([3, 2, 1]) + struct.pack(">HH", 20, 15) + b"\0" * 8 + struct.pack(">II", 30000, 1001) + b"\0" * 10 + ((6 << 5) << 0).to_bytes(2, "big")


@pytest.mark.parametrize(
    ("codec", "head", "headers", "granules", "seconds"),
    [
        ("vorbis", VORBIS, 3, [22050, 44100], (0.5, 1.0)), ("opus", OPUS, 2, [312, 48312], (0.0, 1.0)), ("flac", FLAC, 2, [96000, 192000], (1.0, 2.0)), ("speex", SPEEX, 2, [8000, 16000], (0.5, 1.0)),
        ("theora", THEORA, 3, [(30 << 6) | 0, (30 << 6) | 30], (1.001, 2.002)),
    ],
)
def test_times_of_real_codecs(spark, codec, head, headers, granules, seconds):
    pages = [p for k in range(headers) for p in [ogg.page(7, k, 2 if k == 0 else 0, 0, b"".join(bytes([x]) for x in ([len(head)] if k == 0 else [3])), head if k == 0 else b"hdr")]]
    pages += [ogg.page(7, headers + k, 4 if k else 0, g, b"\x05", b"audio") for k, g in enumerate(granules)]
    media = spark.createDataFrame([("x", b"".join(pages)), ("y", b"".join(pages)[:-3]), (None, None), ("z", b"")], "name string, media binary")
    got = {r.name: r for r in ogg.streams(media, "name").collect()}
    assert set(got) == {"x", "y"}
    r = got["x"]
    assert (r.codec, r.packets, r.last_granule, r.skipped_bytes) == (codec, 2, granules[1], 0) and (r.start_s, r.end_s) == pytest.approx(seconds)
    assert got["y"].packets == 1 and got["y"].skipped_bytes == len(pages[-1]) - 3


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x", "en"), (None, "y", None), ("a", "x", "en"), ("b", None, None)], "doc_id string, text string, lang string")
    rows = ogg.streams(ogg.text_media(docs)).collect()
    assert len(rows) == 6 and len({(r.serial, r.codec) for r in rows if r.doc_id == "a"}) == 2
