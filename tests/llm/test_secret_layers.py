"""Secrets of encoded blocks: repeats, wrapped ends, surroundings, odd bytes, layers beyond the limit."""

import bz2
import gzip
import lzma
import random
import zlib

import pytest
import zstandard
from test_scans_and_models import KEY, WRAPS, b64

from murmurlake.llm import secret_scan


def places(text, kind="aws_access_key"):
    return [f[1:3] for f in secret_scan.scan(text) if f[0] == kind]


def test_every_copy_of_a_block_is_reported():
    for name in ("base64", "gzip"):
        block = WRAPS[name](f"the key {KEY} is here")
        text = f"a {block} b {block} c"
        assert places(text) == [(2, 2 + len(block)), (5 + len(block), 5 + 2 * len(block))]
    nested = WRAPS["base64"]("x " + WRAPS["base64"](f"key {KEY} twice") + " y")
    assert len(places(f"{nested} and {nested}")) == 2


def wrapped(raw, width=76):
    block = b64(raw)
    return "\n".join(block[k : k + width] for k in range(0, len(block), width))


@pytest.mark.parametrize("size", range(50, 130, 3))
@pytest.mark.parametrize("after", ["", "\nand more", "\nend"])
def test_wrapped_blocks_keep_their_last_line(size, after):
    secret = "password=hunter2hunter9xyz"
    raw = ("words " * 40)[: size - len(secret) - 1] + " " + secret
    marks = {f[5] for f in secret_scan.scan(wrapped(raw) + after)}
    assert secret_scan.scan(secret)[0][5] in marks
    rng = random.Random(size)
    noise = " ".join(str(rng.random()) for _ in range(size // 10))
    assert places(wrapped(bz2.compress(f"{noise} {KEY}".encode())) + after)
    assert places(wrapped(gzip.compress(f"{noise} {KEY}".encode())) + after)


@pytest.mark.parametrize("name", ["base64", "urlsafe", "gzip", "zlib", "bz2", "xz", "zstd"])
@pytest.mark.parametrize("before", ["https://x.com/cb/", "https://x.com/c/", "a/bc/def/", "some-", "some_name_", "x-y-"])
def test_blocks_behind_paths_and_hyphens(before, name):
    for inner in (f"the key {KEY} is here", f"a key {KEY} here", f"key: {KEY}"):
        assert places(before + WRAPS[name](inner)), inner


def test_odd_bytes_hide_nothing():
    for odd in (b"\x00", b"\x07", b"\xff", b"\x80\xfe"):
        for raw in (odd + f" the key {KEY} x".encode(), f"the key {KEY} x ".encode() + odd):
            assert len(places(b64(raw))) == 1
            assert len(places(b64(gzip.compress(raw)))) == 1
    assert secret_scan.scan(b64(random.Random(3).randbytes(300_000))) == []


@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress, bz2.compress, lzma.compress, zstandard.compress, lambda x: gzip.compress(zlib.compress(x))])
def test_layers_beyond_the_limit_are_scanned(monkeypatch, pack):
    monkeypatch.setattr(secret_scan, "LAYER_BYTES", 10_000)
    monkeypatch.setattr(secret_scan, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(secret_scan, "OVERLAP_BYTES", 500)
    rng = random.Random(1)
    for at in (0, 3_990, 4_495, 20_000, 39_000):
        filler = " ".join(str(rng.random()) for _ in range(2_200))
        found = secret_scan.scan(b64(pack(f"{filler[:at]} {KEY} {filler[at:]}".encode())))
        assert [f[0] for f in found] == ["aws_access_key", "oversize_layer"], at
