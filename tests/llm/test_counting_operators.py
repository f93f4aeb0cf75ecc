"""Perfect hashes and the operators that count behind them, and document fingerprints."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import digests, divergence, perfect_hash, prefixes, queries
from tests.llm import tools


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_perfect_hash_is_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    keys[: n // 2, 1] = 7  # a lane alone does not tell them apart
    table = perfect_hash.SlotTable(np.concatenate((keys, keys[: n // 3])))
    assert table.n == n
    assert sorted(table.slots(keys).tolist()) == list(range(n))
    assert (table.keys[table.slots(keys)] == keys).all()
    others = rng.integers(0, 1 << 63, (500, 2)).astype(np.uint64)
    assert (table.slots(others) == -1).all()


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError, match="twice"):
        perfect_hash.PerfectHash.of(np.ones((2, 2), dtype=np.uint64))


@pytest.mark.parametrize("name", ["op11_divergence", "op13_prefixes"])
def test_queries_agree_with_sql(spark, name):
    out = queries.QUERIES[name](spark, tools.SF)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tools.SF}/{t}.parquet'")
    wanted = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert tools.rows_of(out, *columns) == sorted(wanted.fetchall(), key=lambda r: tuple((v is None, str(v)) for v in r))


def brute_audit(rows, least, top):
    counts, frequency, groups = Counter(), defaultdict(set), set()
    for n, (_, text, lang, source) in enumerate(rows):
        key = (lang or "", source or "")
        groups.add(key)
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(tools.LOWER)):
            counts[*key, term] += 1
            frequency[key[0], term].add(n)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (of, t), docs in frequency.items() if of == lang and len(docs) >= least)
        sources = sorted(s for of, s in groups if of == lang)

        def share(of):
            n = [sum(counts[lang, s, t] for s in of) for t in kept]
            return [1 + 10**9 * (c + 5) // (sum(n) + 5 * len(kept)) for c in n]

        shares, q = {s: share([s]) for s in sources}, share(sources)
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(shares[s], shares[o])), o) for o in sources if o != s]
            terms = [(b - a, t) for t, a, b in zip(kept, shares[s], q) if counts[lang, s, t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                best = sorted(found, key=lambda r: (r[0], r[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, -f, i + 1) for i, (f, item) in enumerate(best)]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}é{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwxyzäö"]
    rows = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(tools.AWKWARD)]
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(40)}"
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40))).title(), rng.choice(["en", "en", "xx", ""]), source))
    return rows + rows[:5] + [(None, None, "lonely", None), (7, "", "empty", "a"), (7, "", "empty", "b")]


@pytest.mark.parametrize("bound", [divergence.ROUND_BYTES, 3000])
def test_audit_agrees_with_brute_force(spark, monkeypatch, bound):
    """More terms than a page and more sources than a tile; with the small bound, several shards and rounds."""
    monkeypatch.setattr(divergence, "ROUND_BYTES", bound)
    monkeypatch.setattr(divergence, "SHARD_BYTES", bound)
    rows = audit_rows()
    out = divergence.audit(tools.documents(spark, rows).repartition(3), least=3, top=50)
    assert sorted(tuple(r) for r in out.collect()) == brute_audit(rows, 3, 50)


def test_frequencies_are_combined_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 60)
    monkeypatch.setattr(divergence, "TEXT_BYTES", 200)
    rows = audit_rows()
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] for r in rows], "text": [r[1] for r in rows]})
    got = Counter()
    for out in divergence._document_frequencies(iter([batch, batch.slice(3), batch.slice(0, 0)])):
        assert out.num_rows <= 600
        got.update({(r["lang"], r["term"]): r["n"] for r in out.to_pylist()})
    wanted = Counter()
    for _, text, lang, _ in rows + rows[3:]:
        terms = set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(tools.LOWER)))
        wanted.update((lang or "", t) for t in terms)
    assert got == wanted


def test_audit_of_nothing(spark):
    docs = tools.documents(spark, audit_rows())
    assert divergence.audit(docs.limit(0)).count() == 0
    none = divergence.audit(docs, least=10**6).collect()
    assert none and {(r["part"], r["value"]) for r in none} == {("pair", 0)}


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**15], dtype=np.int64)
    total, terms = 3 * 10**15, 12_345
    assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]


def brute_trie(rows, within=100, most=5):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            said[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in said.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        path = (*own.get(c - int(math.fmod(c, within)), [])[:h], *turns[h:])
        ends[path].add(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = (len(members[node]) - 1) * len(node[-1][1] if node else "") + sum(saved[b] for b in below)
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def trie_rows(out):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, out.collect()))


def talks(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(130, 260), -5, -107, 10**12]:
        first = "hello" if rng.random() < 0.4 else f"q{rng.randrange(30)}"
        for turn in range(rng.randrange(1, 9)):
            text = first if turn == 0 else rng.choice(["yes", "né😀", None, "", "a" * 500, f"t{rng.randrange(4)}"])
            rows.append((c, turn if rng.random() > 0.05 else None, rng.choice(["user", None]), text))
    return rows + rows[:9] + [(None, 1, "user", "x"), (77, None, None, None), (77, None, None, None)]


def conversations(spark, rows):
    made = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(made, "conv_id long, turn long, role string, text string, d1 string, depth int")


def test_trie_agrees_with_brute_force(spark):
    rows = talks()
    assert trie_rows(prefixes.shared_openings(conversations(spark, rows).repartition(3))) == brute_trie(rows)
    assert prefixes.shared_openings(conversations(spark, rows[:0])).count() == 0


def test_trie_of_conversations_of_many_segments(spark):
    """Conversations that part after more than two segments; one that ends where another goes on."""
    long = [(i, "u", f"turn {i % 7}") for i in range(2 * prefixes.SEGMENT + 300)]
    rows = [(c, *t) for c, n, own in ((1, 2400, 2300), (2, 2400, 2200), (3, 1100, 9999), (4, 2348, 9999), (5, 1024, 900)) for t in long[:n] if t[0] < own]
    rows += [(c, 5000 + i, "u", f"own {c % 2} {i}") for c in (1, 2, 5) for i in range(1200)]
    assert trie_rows(prefixes.shared_openings(conversations(spark, rows))) == brute_trie(rows)


def brute_fingerprint(text):
    data, reach = text.encode(), digests.REACHES
    counted = [0] * digests.BUCKETS
    for k, (j, m) in enumerate(reach):
        for i in range(len(data)):
            a, b, c = (data[(i + o) % len(data)] for o in (0, j, m))
            x = (a | b << 8 | c << 16) + (k << 24)
            x = x * 0x9E3779B1 % 2**32
            x = (x ^ x >> 15) * 0x85EBCA77 % 2**32
            counted[x >> 24] += 1
    ranked = sorted(counted)
    quartiles = [ranked[63], ranked[127], ranked[191]]
    code = [sum(c > q for q in quartiles) for c in counted]
    packed = bytes(sum(code[i + j] << 6 - 2 * j for j in range(4)) for i in range(0, len(code), 4))
    return f"{round(16 * math.log2(len(data) + 1)):03x}{packed.hex()}", code, round(16 * math.log2(len(data) + 1))


def brute_likeness(a, b):
    difference = sum(abs(x - y) for x, y in zip(a[1], b[1])) + 5 * abs(a[2] - b[2]) / 16
    return 1 - min(1, difference / max(1, sum(max(x, y) for x, y in zip(a[1], b[1]))))


def test_fingerprints_agree_with_brute_force(spark):
    rng = random.Random(8)
    texts = [*tools.AWKWARD[:11], *tools.AWKWARD[13:], *(" ".join(rng.choices(["ça", "va", "bien", "x" * 9], k=k)) for k in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3]), (3, texts[3])]
    docs = tools.documents(spark, [(i, t, None, None) for i, t in rows]).repartition(5)
    key = {(i, t): (i is not None, i or 0) for i, t in rows}
    ordered = sorted(rows, key=lambda r: key[r])
    wanted = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        own, new = brute_fingerprint(t), brute_fingerprint(edited)
        near = round(brute_likeness(own, new), 9), round(brute_likeness(own, brute_fingerprint(after)), 9)
        wanted.append((-1 if i is None else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own[0], new[0], *near))
    out = digests.fingerprinted(docs).collect()
    got = [(-1 if r[0] is None else r[0], *r[1:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, out)]
    assert sorted(got) == sorted(wanted)


def test_one_id_of_many_rows_is_cut_apart(spark):
    docs = tools.documents(spark, [(4, "the same text", None, None)] * 400 + [(5, "another text", None, None)])
    out = digests.fingerprinted(docs.repartition(4))
    assert out.count() == 401
    assert sum(r.near_next == 1 for r in out.where("doc_id = 4").collect()) == 399
    assert digests.fingerprinted(docs.limit(0)).count() == 0
    alone = digests.fingerprinted(docs.where("doc_id = 5")).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"another tano").hexdigest()


def test_fingerprints_tell_edited_from_next(spark):
    out = digests.fingerprinted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r.near_edited > r.near_next for r in out) >= 0.99 * len(out)
    edited, following = (np.array([r[c] for r in out]) for c in ("near_edited", "near_next"))
    assert (edited[:, None] > following[None, :]).mean() > 0.97
