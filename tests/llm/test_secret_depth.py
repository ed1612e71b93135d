"""Secret scans against a slow decoder, and where nothing may be lost: depth, members, alignment, capitals."""

import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from urllib.parse import unquote

import pytest
import zstandard
from test_scans_and_models import KEY, WRAPS, b64

from murmurlake.llm import secret_scan


def slow_layers(text):
    """Every text that plain library calls reach: one way to decode at a time, over all of it or one token of it."""
    seen, work = set(), [text]
    while work:
        now = work.pop()
        if now in seen:
            continue
        seen.add(now)
        work.append(unquote(now, errors="surrogateescape"))
        work.append(re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), now))
        for token in re.findall(r"[A-Za-z0-9+/_=-]{16,}", now):
            try:
                raw = base64.b64decode(token.replace("-", "+").replace("_", "/").rstrip("=") + "=" * (-len(token.rstrip("=")) % 4))
            except ValueError:
                continue
            todo = [raw]
            while todo:
                data = todo.pop()
                for unpack in (gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x)):
                    try:
                        todo.append(unpack(data))
                    except Exception:  # noqa: BLE001
                        continue
                try:
                    work.append(data.decode())
                except UnicodeDecodeError:
                    continue
    return seen


def keys_of(texts):
    return {m for t in texts for m in re.findall(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", t)}


def marks(text):
    return {f[5] for f in secret_scan.scan(text) if f[0] == "aws_access_key"}


@pytest.mark.parametrize("seed", range(30))
def test_equals_a_slow_decoder(seed):
    rng = random.Random(seed)
    text = "prose"
    for k in range(3):
        inner = f"key {KEY[:-2]}{rng.randrange(10)}{k} ."
        for name in [rng.choice(list(WRAPS)) for _ in range(rng.randrange(5))]:
            inner = WRAPS[name](inner)
        inner = inner.replace("%", "%" + "25" * rng.randrange(6))
        text += f" then {inner} and"
    found = keys_of(slow_layers(text))
    assert marks(text) == {m for k in found for m in marks(k)} and len(found) == 3


@pytest.mark.parametrize("depth", [600, 1200, 2000])
def test_deep_nests_end(depth):
    text = "%" + "25" * depth + "41KIAABCDEFGHIJKLMNOP password%3Dhunter2hunter"
    found = secret_scan.scan(text)
    assert {f[0] for f in found} == {"aws_access_key", "assigned"}
    (key,) = [f for f in found if f[0] == "aws_access_key"]
    assert key[1:4] == (0, 2 * depth + 22, depth + 1)


def test_deep_nests_in_a_table(spark):
    df = spark.createDataFrame([(1, "%" + "25" * 1200 + "41 password=hunter2hunter")], "doc_id bigint, text string")
    assert [(r.kind, r.depth) for r in secret_scan.secrets(df).collect()] == [("assigned", 0)]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress, zlib.compress])
def test_every_member_is_read(pack):
    raw = pack(b"nothing here") + pack(b"nor here") + pack(f"the key {KEY} x".encode())
    assert len([f for f in secret_scan.scan(b64(raw)) if f[0] == "aws_access_key"]) == 1


@pytest.mark.parametrize("before", ["x", "ab", "abc", "abcd", "Zz9Zz", "word-word", "0123456789abcdef"])
@pytest.mark.parametrize("name", ["base64", "gzip", "bz2", "zstd", "zlib", "xz"])
def test_characters_before_a_block_hide_nothing(before, name):
    assert marks(before + WRAPS[name](f"the key {KEY} is here")) == marks(KEY)


def test_short_and_lower_case_blocks():
    assert [f[0] for f in secret_scan.scan(b64("pwd=12345678"))] == ["assigned"]
    # three bytes whose code has neither capital nor digit, found by trying, make a block of small letters
    small = [t for t in ("".join(p) for p in __import__("itertools").product("abcdefghijklmnopqrstuvwxyz:=.", repeat=3)) if b64(t).islower()]
    text = "".join(small[k] for k in range(0, len(small), max(1, len(small) // 6)))
    assert b64(text).islower() and len(b64(text)) >= 16
    layer = secret_scan.Layer(b64(text), ())
    assert text in [child.text for child, _ in secret_scan.blocks(layer)]


def test_control_characters_hide_nothing():
    assert marks(b64(f"\x07 the key {KEY} x")) == marks(KEY) == marks("\x01" + KEY + "\x02")
