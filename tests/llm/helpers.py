"""Fixtures and brute-force versions that share no code with the operators."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_docs(seed=5):
    """Nulls in every column, empty, long, repeated and near-equal texts, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(12)]
    passage = prose(rng, 120, 5000)
    texts = [None, "", " ", "\n \t\n", "one", "one two", "a b c", *base, base[0], base[1] + " tail", "head " + base[2], passage, base[3] + "\n" + passage + "\n" + base[4], passage + passage, "é" * 900, "日本語 テキスト ☃ 🎉", "x" * 1500, "ab" * 700, prose(rng, 20000, 30), "Line\nLine\nLine\nother\n" * 20, "<|endoftext|> a<|startoftext|>b <|endoftext|>", "don't  stop\r\n\u00a0now\u3000ok\x0b\x0c.", "ΑΣ ΟΔΟΣ İstanbul ẞ e\u0301"]
    rows = [(i, t, ["en", "de", None][i % 3], ["web", "books", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, base[5], "en", "web", 1), (None, None, None, None, None), (3, "another text for an id in use " * 20, "en", "web", None)]


def words(t):
    return WORD.findall(low(t or ""))


def removed_bytes(texts, size):
    """Per text: which bytes are covered by a string of `size` bytes that starts at two places or more."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def components(n, linked):
    """Least member of each member's component, by a flood over all pairs."""
    root = [None] * n
    for i in range(n):
        if root[i] is None:
            todo, root[i] = [i], i
            while todo:
                a = todo.pop()
                for b in range(n):
                    if root[b] is None and linked(a, b):
                        root[b] = i
                        todo.append(b)
    return root


def table_at(spark, path, **tables):
    """Writes tables as <path>/<name>.parquet; the directory."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def clashing(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    for c in ("h", "_id", "_h", "_kept", "row", "kind", "fp", "key", "m", "doc", "rep", "u", "v", "kept", "base_failed", "ids", "lo", "hi", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df
