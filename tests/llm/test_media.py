from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from helpers import documents, text

from quillmark.llm import media


@pytest.mark.parametrize("raw", [b"", b"a", bytes(range(256)) * 3, b"\xff" * 400, text(1, 500).encode(), b"x" * 192])
def test_payload_comes_back(raw):
    payload = media.pad(raw)
    assert len(payload) % 192 == 0 and payload.rstrip(b" ") == raw.rstrip(b" ") and payload
    stored = media.encode(payload)
    assert stored.startswith(b"\xff\xd8") and stored.endswith(b"\xff\xd9")
    images = media.decode(stored)
    assert media.payload_of(images) == payload
    for image, parsed in zip(images, media._images(stored), strict=True):
        assert (media._general(parsed, parsed["scans"][0]) == image["coefficients"]).all()


def test_long_payload_is_several_images():
    payload = media.pad(bytes(np.random.default_rng(1).integers(0, 256, 1_700_000, dtype=np.uint8)))
    images = media.decode(media.encode(payload))
    assert len(images) == 2 and media.payload_of(images) == payload


def test_other_baseline_files():
    """Grey 16 x 8 pixels, DC only, usual code lengths, no restarts: DC differences 3 and -5, step 16."""
    bits = "10" + "11" + "0" + "110" + "010" + "0"  # category 2: 11; end of block; category 3: 010; end of block
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big")
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([16] * 64)) + media._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    dc = bytes([0x00, 1, 1, 1, *[0] * 13, 0, 2, 3])
    ac = bytes([0x10, 1, *[0] * 15, 0])
    data = head + media._segment(0xC4, dc) + media._segment(0xC4, ac) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    image = media.decode(data)[0]
    assert (image["width"], image["height"]) == (16, 8)
    assert image["thumbnail"].tolist() == [[134, 124]]


def test_damage():
    stored = media.encode(media.pad(b"abc"))
    for bad in (stored[:-2], b"xx" + stored, stored[:2] + b"\xff\xc2" + stored[4:]):
        with pytest.raises((media.JpegError, IndexError, ValueError)):
            media.decode(bad)


def test_column(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, text(3, 300_000)), (4, "same"), (5, "same"), (5, "same"), (6, "é€😀")]
    out = media.media_column(documents(spark, rows).withColumnRenamed("lang", "media").withColumnRenamed("source", "key"), with_media=True).collect()
    assert len(out) == 8
    for r in out:
        raw = next(t or "" for i, t in rows if i == r["doc_id"]).encode()
        payload = media.pad(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
    assert len({r["feature"] for r in out if r["doc_id"] in (4, 5)}) == 1
    assert media.media_column(documents(spark, [])).collect() == []


def test_codes_are_optimal_and_complete():
    g = np.random.default_rng(3)
    for counts in (np.array([5]), np.array([1, 1]), g.integers(1, 1000, 40), np.array([1 << k for k in range(30)]), g.integers(1, 9, 200)):
        wide = np.zeros(256, dtype=np.int64)
        wide[: len(counts)] = counts
        book = media.huffman(wide)
        codes = media._codes(*book)
        assert sorted(codes.values()) == list(range(len(counts))) and len(set(codes)) == len(counts)
        assert all(c != (1 << n) - 1 for n, c in codes) and max(n for n, _ in codes) <= 16  # the code of ones is left out
        texts = [f"{c:0{n}b}" for n, c in codes]
        assert not any(a != b and b.startswith(a) for a in texts for b in texts)
    p = np.array([8, 4, 2, 1, 1])
    lengths = {x: n for (n, _), x in media._codes(*media.huffman(np.concatenate([p, np.zeros(251, dtype=np.int64)]))).items()}
    assert lengths[0] == 1 and lengths[1] == 2 and lengths[2] == 3


def test_runs_of_zeros_and_whole_batches():
    g = np.random.default_rng(4)
    sparse = np.full(192 * 30, 128, dtype=np.uint8)
    sparse[g.integers(0, len(sparse), 60)] = g.integers(0, 256, 60)
    payloads = [sparse.tobytes(), bytes([128]) * 192, bytes(g.integers(0, 256, 192 * 7, dtype=np.uint8)), media.pad("Ünïcödé € ".encode() * 40), bytes([255]) * 384, bytes([0]) * 192]
    files = media.encode_all(payloads)
    assert files == [media.encode(p) for p in payloads]  # a file depends on its own payload alone
    for p, f, images in zip(payloads, files, media.decode_all(files), strict=True):
        assert media.payload_of(images) == p
        for image, parsed in zip(images, media._images(f), strict=True):
            assert (media._general(parsed, parsed["scans"][0]) == image["coefficients"]).all()


def _bits(parts: str) -> bytes:
    parts += "1" * (-len(parts) % 8)
    return int(parts, 2).to_bytes(len(parts) // 8, "big")


def test_scans_of_their_own_and_longer_intervals():
    """Three components, a scan for each; the first with two blocks an interval, so that DC differences add up."""
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([8] * 64)) + media._segment(0xC0, bytes([8, 0, 8, 0, 32, 2, 1, 0x11, 0, 2, 0x11, 0]))
    tables = media._segment(0xC4, bytes([0x00, 1, 1, 1, *[0] * 13, 0, 2, 3])) + media._segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    one = _bits("10" + "11" + "0" + "10" + "11" + "0")  # DC 3, then 3 more
    other = _bits("0" + "0" + "110" + "100" + "0")  # DC 0, then 4
    first = media._segment(0xDD, b"\0\2") + media._segment(0xDA, bytes([1, 2, 0, 0, 63, 0])) + one + b"\xff\xd0" + other
    second = media._segment(0xDD, b"\0\0") + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + _bits("10110" + "00" + "00" + "00")  # DC 3, then the same
    image = media.decode(head + tables + first + second + b"\xff\xd9")[0]
    assert image["coefficients"][:4, 0].tolist() == [3, 6, 0, 4]
    assert image["thumbnail"].tolist() == [[131] * 4] and image["coefficients"].shape == (8, 64)
