"""Line dedup with exact edges of passages, against plain Python over real documents."""

from __future__ import annotations

import hashlib
from collections import Counter

from trajspark.llm import line_dedup


def pieces(texts):
    """Chunks of every text with exact edges, in plain Python."""
    split = {i: t.split("\n") for i, t in texts.items()}
    pairs = Counter(p for x in split.values() for p in zip(x, x[1:], strict=False))
    long = Counter(z for x in split.values() for z in x if len(z.split()) >= 50)
    hashed = lambda z: int(hashlib.md5(z.encode()).hexdigest()[:7], 16)
    for i, x in split.items():
        n = [*(pairs[p] for p in zip(x, x[1:], strict=False)), 1]
        alone = [long[z] > 1 for z in x]
        if max(n) == 1 and not any(alone):
            n = None
        out, now = [], []
        for k, z in enumerate(x):
            now.append(z)
            roll = (hashed(z) + 31 * (hashed(x[k - 1]) if k else 0)) % 1_000_003 % 4 == 0
            if n is not None:
                rarer = k > 0 and n[k] < n[k - 1] or k + 1 < len(n) and n[k] < n[k + 1]
                roll = roll and n[k] == 1 or rarer or alone[k] or k + 1 < len(x) and alone[k + 1]
            if roll or k == len(x) - 1:
                out.append("\n".join(now))
                now = []
        yield i, out


def test_repeated_passages_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen: set[str] = set()
    want = {i: None for i, t in texts.items() if t is None}
    for i, chunks in sorted(pieces({i: t for i, t in texts.items() if t is not None})):
        kept = []
        for c in chunks:
            if sum(1 for x in c.split("\n") if x.strip(" \t\n\x0b\x0c\r")) >= line_dedup.LEAST_LINES or len(c.split()) >= line_dedup.LEAST_WORDS:
                if c in seen:
                    continue
                seen.add(c)
            kept.append(c)
        want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, passages=True).collect()}
    assert got == want
    assert sum(got[i] != t for i, t in texts.items()) > 0
