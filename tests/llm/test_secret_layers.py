"""Secrets within further kinds of layers, and streams too large to be held."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib

import pytest
import zstandard

from trajspark.llm import secrets

SECRET = "password = hunter2hunter2"
BODY = "some words before it, " + SECRET + ", and some after"


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def raw_deflate(data: bytes) -> bytes:
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    return d.compress(data) + d.flush()


@pytest.mark.parametrize(
    "data",
    [
        raw_deflate(BODY.encode()),
        bz2.compress(BODY.encode()),
        lzma.compress(BODY.encode()),
        zstandard.compress(BODY.encode()),
        BODY.encode("utf-16-le"),
        BODY.encode("utf-16"),
        BODY.encode("utf-16-be"),
        gzip.compress(BODY.encode("utf-16-le")),
        bz2.compress(b"first ") + bz2.compress(BODY.encode()),
        zstandard.compress(b"first ") + zstandard.compress(BODY.encode()),
        lzma.compress(bz2.compress(zlib.compress(gzip.compress(zstandard.compress(BODY.encode()))))),
        gzip.compress(bytes(range(256)) + BODY.encode() + bytes(range(256))),
        gzip.compress(BODY.encode())[:-6],
    ],
)
def test_secret_is_found_in_bytes(data):
    text = "see " + b64(data) + " there"
    base, every, _, _ = secrets.scan(text)
    assert not base and {text[a:b].rstrip("=") for a, b, k in every if k == "assign"} & {b64(data).rstrip("="), b64(data)}


def test_short_runs_of_letters_are_opened():
    plain = next(t for i in range(10**6) if (t := f"token:{i:08d}") and b64(t.encode()).rstrip("=").isalnum())
    assert secrets.scan("x " + b64(plain.encode()) + " y")[1]


def test_streams_beyond_a_window_are_scanned_whole(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 16)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    monkeypatch.setattr(secrets, "_STEP", 1 << 12)
    rng = random.Random(1)
    filler = lambda n: "".join(rng.choices("abcdefghij klm\n", k=n))
    parts, marks = [], []
    for i in range(12):
        parts += [filler(rng.randint(40_000, 70_000)), f" token = secretnumber{i:02d}x ", filler(300), " " + b64(f"api_key: innernumber{i:02d}y".encode()) + " "]
        marks.append(i)
    big = "".join(parts).encode()
    opened = []
    plain = secrets.base_spans
    monkeypatch.setattr(secrets, "base_spans", lambda t: opened.extend(re.findall(r"(?:secret|inner)number\d\d[xy]", t)) or plain(t))
    for data in (gzip.compress(big), bz2.compress(big), lzma.compress(big), zstandard.compress(big), gzip.compress(bz2.compress(big))):
        opened.clear()
        _, every, _, refused = secrets.scan("a " + b64(data) + " b")
        assert every and refused == 0
        assert set(opened) == {f"{k}{i:02d}{e}" for i in marks for k, e in (("secretnumber", "x"), ("innernumber", "y"))}


def test_a_bomb_needs_bounded_memory():
    import resource

    bomb = gzip.compress(b"a" * (1 << 20)) * 400  # 400 MB from some 400 kB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert secrets.scan(b64(bomb))[3] == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_broken_streams_are_counted():
    assert secrets.scan("a " + b64(gzip.compress(BODY.encode())[:-6]) + " b")[3] == 1


def brute_base(text: str) -> str:
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_columns_of_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (-3, SECRET + " " + "0af" * 20 + " AKIA" + "Z" * 12 + " x" * 200_000 + SECRET)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    want = sorted((r["doc_id"], hashlib.sha256(brute_base(r["text"] or "").encode()).hexdigest(), brute_base(r["text"] or "").count("assign")) for r in docs.collect())
    got = sorted((r["doc_id"], r["base_sha256"], r["n_assign"]) for r in secrets.find_secrets(docs).collect())
    assert got == want
