"""Secrets over the edges of tokens, lines, runs and gzip members."""

from __future__ import annotations

import base64
import gzip
import random
import zlib

import pytest

from trajspark.llm import secrets

SECRET = "password = hunter2hunter2"
NOISE = "".join(random.Random(3).choices("abcdefghij klmnop,.;", k=400))
LONG = NOISE[:50] + SECRET + NOISE[50:]
PACKED = NOISE + SECRET + random.Random(4).randbytes(150).hex(" ", 3)


def b64(text: str | bytes) -> str:
    return base64.b64encode(text.encode() if isinstance(text, str) else text).decode()


def wrapped(data: bytes, end: str = "\n", width: int = 76) -> str:
    t = b64(data)
    return end.join(t[i : i + width] for i in range(0, len(t), width))


@pytest.mark.parametrize(
    "text",
    [
        "x password = hun%74er2hunter2 y",
        '{"token": "ab%63defghij"}',
        "token: api_key:%61bcdefgh",
        "Body\n\n" + wrapped(LONG.encode()) + "\n\nend",
        "Body follows here:\n" + wrapped(LONG.encode(), "\r\n", 64) + "\r\nend of it",
        "data: " + wrapped(zlib.compress(PACKED.encode())) + "\nrest",
        "an-earlier-line-without-blanks\n" + wrapped(gzip.compress(PACKED.encode())) + "\nrest",
        "key_" + b64(SECRET),
        "ab-" + b64(SECRET) + " x",
        "https://example.org/get/" + b64(SECRET).rstrip("=") + "/file",
        "https://example.org/v1/blob_" + b64(zlib.compress(SECRET.encode())),
        "/v1/" + b64(b64(SECRET)),
        b64(gzip.compress(b"first member ") + gzip.compress(SECRET.encode())),
    ],
)
def test_secret_is_found(text):
    base, every, _, _ = secrets.scan(text)
    assert not base
    spans = [(a, b) for a, b, kind in every if kind == "assign"]
    assert spans and all(0 <= a < b <= len(text) for a, b in spans)


def test_spans_are_of_the_encoded_part():
    text = "see key_" + b64(SECRET) + " there"
    assert text[slice(*secrets.scan(text)[1][0][:2])] == b64(SECRET)
    text = "x password = hun%74er2hunter2 y"
    assert text[slice(*secrets.scan(text)[1][0][:2])] == "password = hun%74er2hunter2"


def test_bytes_without_secrets_give_none():
    for n in range(20):
        assert not secrets.scan("a/" + wrapped(random.Random(n).randbytes(3000)))[1]
