"""Small tables with the awkward cases, and plain-Python rules to hold the operators against."""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, sid string"


def documents(spark, rows):
    """(doc_id, text, lang, source) as documents with extra columns whose names the operators use themselves."""
    made = [(i, t, lang, source, len(t) if t is not None else None, "x", "y") for i, t, lang, source in rows]
    return spark.createDataFrame(made, DOCUMENTS)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, width=5):
    w = blank_words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(texts):
    """Component of each position by brute force: the smallest position reachable."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def rises(values):
    return all(a <= b for a, b in pairwise(values))


AWKWARD = [
    None, "", " \t\n", "a", "one two three", "One  TWO three", "\x00 nul \x00", "é ü ñ ça été", "中文 文本", "1 2 3", "$$$ ### !!!",
    "x" * 50_000, "long " * 20_000, "same text here for the fifth time", "same text here for the fifth time", "😀 emoji 😀 text",
]
