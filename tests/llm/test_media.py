import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import media, webp


def test_fixed_values():
    assert len(webp.NEAR) == 120 == len(set(webp.NEAR)) and sorted(webp.ORDER_OF_CODE_LENGTHS) == list(range(19))


@pytest.mark.parametrize("seed", range(40))
def test_every_transform_round_trips(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 30, 2)
    few = seed % 2 == 0
    p = rng.integers(0, 4, (h, w)).astype(np.uint32) * 0x01402010 if few else rng.integers(0, 2**32, (h, w), dtype=np.uint32)
    th, tw = webp.tiles(h, 2), webp.tiles(w, 2)
    how = {}
    if seed % 3 == 0:
        how["modes"] = rng.integers(0, 14, (th, tw))
    if seed % 4 == 0:
        how["multipliers"] = rng.integers(-128, 128, (th, tw, 3))
    how["subtract_green"] = seed % 5 == 0
    how["cache_bits"] = int(rng.integers(1, 11)) if seed % 7 == 0 else 0
    how["groups"] = 2 if seed % 6 == 0 else 0
    if few and seed % 4:
        how |= {"palette": True, "modes": None}
    assert (webp.decode(webp.encode(p, **how)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 5, 16, 17, 64, 65, 256])
def test_samples(colours):
    rng = np.random.default_rng(colours)
    for rows in (1, 10, 300):
        s = rng.integers(0, colours, rows * 64).astype(np.uint8) * (255 // max(1, colours - 1))
        s[-30:] = 0
        s[20:34] = s[20]
        s = s.reshape(-1, 64)
        assert (((webp.decode(webp.encode_samples(s)) >> 8) & 255) == s).all()


def test_a_hand_made_file():
    # one pixel, each code simple with one symbol: header, no transform, no cache, no meta codes, then the pixel by no bits
    out = webp.Writer()
    for value, n in ((0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        out.put(value, n)
    for symbol in (0x22, 0x11, 0x33, 0xFF, 0):
        out.put(1 | 0 << 1 | 1 << 2 | symbol << 3, 11)
    assert webp.decode(webp._file(out.bytes())).tolist() == [[0xFF112233]]


def test_bad_files_have_errors(spark):
    good = media.pack(b"x" * 64)
    rows = [(1, good), (2, b"no"), (3, good[:-3]), (4, None), (5, good[:20] + bytes(30))]
    got = {r["k"]: r for r in media.pixels(spark.createDataFrame(rows, "k long, media binary")).collect()}
    assert (got[1]["width"], got[1]["height"], len(got[1]["argb"])) == (64, 1, 256) and got[1]["error"] is None
    assert got[2]["error"] and got[2]["argb"] is None and got[5]["error"] and got[4]["error"] is None is got[4]["argb"]


def test_payloads():
    assert [len(media.payload_of(b"x" * n)) for n in (0, 1, 63, 64, 65)] == [64, 64, 64, 64, 128]
    big = random.Random(1).randbytes(64) * 20_000
    back, image = media.unpack(media.pack(big), len(big))
    assert back == big and image.shape[0] <= webp.MOST


def test_digest(edge, none, clash):
    rows = media.digest(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        data = (r["text"] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert len({(r["text"], r["media_sha256"], r["feature"]) for r in rows}) == len({r["text"] for r in rows})
    assert media.digest(none).collect() == []
    stored = media.store(clash)
    assert {bytes(r["media"][:4]) for r in stored.collect()} == {b"RIFF"} and stored.count() == 6
    assert media.pixels(stored.drop("size")).filter("error IS NOT NULL").count() == 0
