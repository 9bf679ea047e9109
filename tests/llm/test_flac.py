import hashlib
import zlib

import numpy as np
import pytest

from docloom.llm import flac


def payloads():
    rng = np.random.default_rng(5)
    wave = (np.sin(np.arange(192 * 300) / 9) * 90 + 128).astype(np.uint8).tobytes()
    spikes = np.full(1920, 128, np.uint8)
    spikes[::97] = 255
    return [b"", flac.pad(b""), flac.pad(b"x" * 400), rng.integers(0, 256, 3840, dtype=np.uint8).tobytes(), bytes([0, 255] * 96), wave, spikes.tobytes(), flac.pad("Grüße, 世界. ".encode() * 999)]


def test_round_trip():
    media = flac.encode(payloads())
    assert flac.decode(media) == payloads()
    assert len(media[5]) < len(payloads()[5]) * 0.6  # the linear predictor is at work
    assert flac.decode([media[2]]) == [payloads()[2]]


@pytest.mark.parametrize("at", [-1, -40, 20, -900])
def test_damage_is_noticed(at):
    bad = bytearray(flac.encode([payloads()[-1]])[0])
    bad[at] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(bad)])


class Bits:
    def __init__(self, data):
        self.v, self.n, self.at = int.from_bytes(data), len(data) * 8, 0

    def take(self, k):
        self.at += k
        return self.v >> (self.n - self.at) & (1 << k) - 1

    def signed(self, k):
        x = self.take(k)
        return x - (1 << k) if k and x >> (k - 1) else x


def plain_decode(data):
    """A reader of one bit after another, by the format's description."""
    at = 4
    while True:
        last, size = data[at] >> 7, int.from_bytes(data[at + 1 : at + 4])
        at += 4 + size
        if last:
            break
    b, out = Bits(data[at:]), []
    while b.at < b.n:
        assert b.take(16) == 0xFFF8 and b.take(16) == 0x1402
        lead = b.take(8)
        while lead & 64 and lead & 128:
            b.take(8)
            lead = (lead << 1 & 127) | 128
        b.take(8)
        kind = b.take(8) >> 1
        s = []
        if kind == 0:
            s = [b.signed(8)] * 192
        elif kind == 1:
            s = [b.signed(8) for _ in range(192)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            s = [b.signed(8) for _ in range(order)]
            coef, shift = [(), (1,), (2, -1)][order] if kind < 32 else (), 0
            if kind >= 32:
                width = b.take(4) + 1
                shift = b.take(5)
                coef = [b.signed(width) for _ in range(order)]
            assert b.take(6) == 0
            k = b.take(4)
            while len(s) < 192:
                q = 0
                while not b.take(1):
                    q += 1
                u = q << k | b.take(k)
                s.append((u >> 1 ^ -(u & 1)) + (sum(c * s[-1 - j] for j, c in enumerate(coef)) >> shift))
        b.at += -b.at % 8
        b.take(16)
        out += s
    return bytes(x + 128 for x in out)


def test_streams_by_a_plain_reader():
    for p, m in list(zip(payloads(), flac.encode(payloads())))[1:5]:
        assert plain_decode(m) == p
    text = flac.pad(b"The quick brown fox jumps over the lazy dog. " * 30)
    assert plain_decode(flac.encode([text])[0]) == text


def test_partitions_and_escape():
    """A hand-made frame: fixed order 1, two partitions, the second one escaped with 5-bit residuals."""
    s = np.cumsum(np.resize([1, -2, 3, 0, -1], 192))
    bits = "0" + f"{9:06b}" + "0" + f"{int(s[0]) & 255:08b}" + "00" + "0001"
    r = np.diff(s)
    bits += f"{2:04b}" + "".join("0" * (u >> 2) + "1" + f"{u & 3:02b}" for u in ((int(x) << 1) ^ (int(x) >> 63) for x in r[:95]))
    bits += "1111" + f"{5:05b}" + "".join(f"{int(x) & 31:05b}" for x in r[95:])
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    assert (flac.decode_frames(data, np.array([0]), 192)[0] == s).all()


def test_query_and_blocks(spark):
    rows = [(1, "hello", 0), (1, "hello", 1), (2, None, 2), (3, "", 3), (None, "ü" * 5000, 4), (5, "long " * 40000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = flac.media_digests(docs).collect()
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").encode())))):
        p = flac.pad((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len((t or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:])
        assert (r.n_blocks, r.last_offset) == (-(-len(p) // 4096), (len(p) - 1) // 4096 * 4096)
    blocks = flac.pcm_blocks(flac.write_media(docs.where("doc_id = 5"))).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.pad(b"long " * 40000)
    assert [b.sample_offset for b in blocks] == list(range(0, 200064, 4096))
    assert flac.media_digests(docs.limit(0)).count() == 0
