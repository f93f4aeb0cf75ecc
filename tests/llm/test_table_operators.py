"""Operators over whole tables: similarity join, top-k search, WARC, URL filter, mixing, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import components, jaccard, mixing, pii, queries, quality, text, topk, urls, warc
from tests.llm import tools


def sql(name, sf=tools.SF):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(queries.ORACLES[name])


@pytest.mark.parametrize("name", ["op1_topk", "op2_jaccard", "op6_decontamination", "op7_warc"])
def test_queries_agree_with_sql(spark, name):
    out = queries.QUERIES[name](spark, tools.SF)
    wanted = sql(name)
    columns = [c[0] for c in wanted.description]
    assert tools.rows_of(out, *columns) == sorted(wanted.fetchall(), key=lambda r: tuple((v is None, str(v)) for v in r))


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


def copies(seed=1):
    """Texts with chains of near copies, copies of all sizes, a passage that many share, and the awkward cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    out = list(tools.AWKWARD)
    for size in (4, 5, 6, 9, 12, 30, 80, 200, 600):
        base = rng.choices(vocabulary, k=size)
        chain = base
        for share in (0, 0.002, 0.01, 0.03, 0.05):
            out.append(" ".join(edited(rng, base, share)))
            chain = edited(rng, chain, 0.015)
            out.append(" ".join(chain))
        out.append(" ".join(base[: max(1, int(size * 0.85))]))
    for _ in range(80):
        own = rng.choices(vocabulary, k=rng.randrange(5, 60))
        out.append(" ".join([*own, *passage]))
    return out


@pytest.mark.parametrize("shared", [jaccard.SHARED, 4])
def test_components_are_exact(spark, monkeypatch, shared):
    texts = copies()
    monkeypatch.setattr(jaccard, "SHARED", shared)
    docs = tools.documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    out = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    wanted = tools.components(texts)
    assert [out[i].component_id for i in range(len(texts))] == wanted
    assert [out[i].n_shingles for i in range(len(texts))] == [len(tools.shingles(t)) for t in texts]
    assert len(set(wanted)) < len(texts) - 20


def test_sketches_meet_within_their_first_words():
    """The pigeonhole over random pairs: similar sets share one of the first T + 1 words in any common order."""
    rng = np.random.default_rng(2)
    bands = jaccard.Bands.of()
    met = 0
    for _ in range(600):
        n = int(rng.integers(3, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        edits = int(rng.integers(0, max(2, n // 8)))
        b[rng.integers(0, n, edits)] = rng.integers(0, 2**63, edits).astype(np.uint64)
        b = np.concatenate((b, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 10)))).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common) or len(a) == len(b) == common:
            continue
        met += 1
        small = min(len(a), len(b))
        band = np.array([int(np.searchsorted(bands.low, small, side="right")) - 1])
        first = []
        for s in (a, b):
            _, words, _ = jaccard.sketch_words([s], band, bands)
            words = sorted(words.tolist(), key=lambda w: (w & 1, w))
            first.append(set(words[: int(bands.most(np.array([len(s)]), band)[0]) + 1]))
        assert first[0] & first[1]
        x, y = jaccard._bits(a), jaccard._bits(b)
        assert jaccard._difference(x, y) <= len(a) + len(b) - 2 * common
    assert met > 100


def test_similarity_join_edges(spark):
    docs = tools.documents(spark, [(None, "a b c d e f", "en", "s"), (5, "a b c d e f", "en", "s"), (5, "a b c d e f", "en", "s"), (3, None, "en", "s")])
    out = tools.rows_of(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert out == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (3, 0, 3)], key=lambda r: tuple((v is None, str(v)) for v in r))
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102)], "a long, b long")
    out = {r.node: r.root for r in components.components(links).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components.components(links.limit(0)).count() == 0


def brute_top(vectors, is_query, k=5):
    width = max((len(v) for _, v in vectors), default=0)
    full = [(i, np.array(list(v) + [0] * (width - len(v)), dtype=object)) for i, v in vectors]
    out = []
    for q in sorted({i for i, _ in full if is_query(i)}):
        scores = {}
        for i, x in full:
            if i != q:
                s = max(int((x * y).sum()) for j, y in full if j == q)
                scores[i] = max(s, scores.get(i, s))
        ranked = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("scale", [1.0, 2.0**20])
def test_top_k_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "FIRST_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.2, 8)).tolist()) for i in range(200)]
    rows += [(i, rows[7][1]) for i in range(200, 260)]  # one vector very many times
    rows += [(300, [1.0, 2.0]), (10, rows[3][1]), (20, rows[20][1]), (301, [])]
    rows = [(i, [scale * c for c in v]) for i, v in rows]
    bad = [(400, None), (500, [1.0, None]), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in rows + bad], "vec_id long, embedding array<double>, label int, query_id string")
    out = topk.search(topk.quantised(df), F.col("vec_id") % 10 == 0, sample_rows=40)
    wanted = brute_top([(i, [math.floor(256 * c) for c in v]) for i, v in rows], lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in out.collect()) == sorted(wanted)


def test_top_k_small(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert topk.search(topk.quantised(none), F.col("vec_id") == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], schema)
    assert [tuple(r) for r in topk.search(topk.quantised(two), F.col("vec_id") == 0).collect()] == [(0, 1, 1, -65536)]
    empty = spark.createDataFrame([(0, []), (1, [])], schema)
    assert [tuple(r) for r in topk.search(topk.quantised(empty), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0)]


PAGES = "page_id long, url string, html string, payload string, record_type string"


def test_warc_round_trip(spark):
    long = "ü" * 700
    rows = [
        (1, "http://a/\r\nWARC/1.1", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (2, None, None), (3, "", ""),
        (4, "http://b", long), (9, "http://c", long), (9, "http://c", long), (7, "http://d", long), (None, "http://e", long),
        (5, "u", "small"), (6, "u", "small"), (8, "big", "z" * 300_000), (10, "big", "z" * 300_000), (None, "n", "q" * 2_000), (None, "n", "q" * 2_000),
    ]
    pages = spark.createDataFrame([(*r, "p", "t") for r in rows], PAGES).repartition(3)
    out = warc.page_records(pages).collect()
    heads = {long: 9, "z" * 300_000: 10}
    wanted = []
    for i, _, html in rows:
        payload = (html or "").encode()
        head = heads.get(html)
        revisit = head is not None and i != head
        wanted.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in out), key=key) == sorted(wanted, key=key)
    assert warc.page_records(pages.limit(0)).count() == 0


def test_warc_payloads_and_pushdown(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "é" * (i * 400), "p", "t") for i in (1, 2, 2, 3, 3)], PAGES)
    path = str(tmp_path / "w")
    warc.records(pages.withColumn("page_id", F.monotonically_increasing_id())).write.format("warc").option("path", path).mode("append").save()
    read = spark.read.format("warc").option("path", path).load()
    assert read.count() == 5 and {r.payload.decode() for r in read.where("payload IS NOT NULL").collect()} == {"é" * 400, "é" * 800, "é" * 1200}
    revisits = read.where("record_type = 'revisit'")
    assert revisits.where("payload IS NULL AND refers_to IS NOT NULL").count() == revisits.count() == 2
    plan = revisits._jdf.queryExecution().toString()
    assert "Filter" not in plan.split("Physical Plan")[1] or "record_type" not in plan.split("Physical Plan")[1].split("Filter")[1][:200]
    assert read.where(F.col("record_type").isin("response", "metadata")).count() == 3
    assert spark.read.format("warc").option("path", path).option("payloads", "false").load().where("payload IS NOT NULL").count() == 0


def test_warc_files_that_no_list_names_are_passed_over(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}", "p", "t") for i in range(4)], PAGES)
    path = tmp_path / "w"
    for part in (pages.where("page_id < 2"), pages.where("page_id >= 2")):  # two writes, two lists
        warc.records(part).write.format("warc").option("path", str(path)).mode("append").save()
    files = sorted(path.glob("*.warc"))
    (path / ("0" * 32 + ".warc")).write_bytes(files[0].read_bytes())  # what a task that failed leaves behind
    read = spark.read.format("warc").option("path", str(path))
    assert sorted(r.record_id for r in read.load().collect()) == [f"urn:page:{i}" for i in range(4)]
    assert len(list(path.glob("*" + warc.LIST))) == 2 and not list(path.glob("*.open"))
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    (foreign / "a.warc").write_bytes(files[0].read_bytes())
    assert spark.read.format("warc").option("path", str(foreign)).load().count() > 0
    (path / files[0].name).rename(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="missing"):
        read.load().count()


class Counting:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        self.read_bytes += len(out)
        return out

    def seek(self, to):
        self.at = to


def test_warc_reader_passes_payloads_by():
    from pyspark.sql import Row

    def one(i, kind):
        payload = b"x" * 2_000_000
        return warc.record(Row(record_id=f"urn:page:{i}", record_type=kind, target_uri="u", refers_to=None, payload_digest="00" * 20,
                               payload_bytes=len(payload), payload=payload))

    data = b"".join(one(i, "response" if i % 2 else "resource") for i in range(6))
    reader = warc.WarcReader("", True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "metadata"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1
    raw = Counting(data)
    assert list(reader._records(raw)) == [] and raw.read_bytes < len(data) / 4
    with pytest.raises(ValueError):
        list(warc.WarcReader("", True)._records(Counting(data[:-100])))


def test_urls(spark):
    model = urls.train(urls.labelled(spark))
    given = [
        None, "", "no scheme", "://", "http://A.Org", "http://a.org/", "https://Example.ORG/es/x", "http://www.example.org/en/12",
        "http://badexample.org/es/", "x://s.com/fr/?a", "x://com/de/#f", "x://com/de", "http://h?q=://b.org/es/", "http://casino-win.example.com/x",
        "http://u\n.org/\n", "http://" + "a" * 50_000 + ".com/de/" + "b" * 50_000, "x://é.com/fr/é",
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(given)], "page_id long, url string, host string, verdict string")
    out = {r.page_id: r for r in urls.judge(pages, model).collect()}
    assert len(out) == len(given)
    for i, u in enumerate(given):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = rest[:end].translate(tools.LOWER), rest[end:].split("?")[0].split("#")[0]
        fits = [
            (rule, verdict) for verdict, rule in urls.RULES
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])
        ]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        grams = [(f"{m}{n}", s[k : k + n]) for m, s in (("h", f".{host}."), ("p", path.translate(tools.LOWER))) for n in urls.LENGTHS for k in range(len(s) - n + 1)]
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= urls.BLOCK_FROM else "allow"))
        if len(grams) < 200:
            made = spark.createDataFrame(grams or [("", "")], "m string, g string").select("m", F.expr(f"pmod(xxhash64(m, g), {urls.BUCKETS}L)").alias("b"))
            z = model.weights[-1]
            for part in ("h", "p") if grams else ():
                held = [model.weights[x.b] for x in made.collect() if x.m.startswith(part)]
                z += sum(held) / math.sqrt(max(1, len(held)))
            assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
    assert out[13].score > out[4].score
    empty = urls.train(urls.labelled(spark).limit(0))
    assert urls.judge(pages, empty, []).where("verdict = 'block' OR rule IS NOT NULL").count() == 0


def test_urls_judges_hosts_that_it_has_not_seen(spark):
    """Sites, whatever their subdomains, are in one fold; two of five folds are held out in turn."""
    site = F.regexp_extract("url", r"://(?:(?:www|m|blog|shop)\.)?([^.]*)", 1)
    rows = urls.labelled(spark).withColumn("fold", F.crc32(site) % 5).cache()
    right = {0: [], 1: []}
    for fold in (0, 1):
        model = urls.train(rows.where(F.col("fold") != fold))
        held = rows.where(F.col("fold") == fold).withColumn("page_id", F.col("label"))
        for r in urls.judge(held, model, []).collect():
            right[r.page_id].append(r.verdict == "block")
    assert len(right[0]) > 200 and len(right[1]) > 150
    assert np.mean(right[1]) >= 0.93 and np.mean(right[0]) <= 0.01


def test_urls_labels_are_not_those_of_the_pages(spark):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["url"].dropna()
    hosts = {u.split("://", 1)[1].split("/")[0] for u in pages if "://" in u}
    assert not hosts & {u.split("://", 1)[1].split("/")[0] for u, _ in urls.LABELLED if "://" in u}


def test_urls_of_topics_in_other_words(spark):
    model = urls.train(urls.labelled(spark))
    bad = "mega-slots viagra-shop porn-tube lottery-prize malware-download phishing-login".split()
    good = "trackandfield stackoverflow guardian analytics therapist adidas madison".split()
    rows = [(h in bad, f"https://www.{h}.com/en/77") for h in bad + good]
    verdicts = urls.judge(spark.createDataFrame(rows, "page_id boolean, url string"), model, []).collect()
    assert sum(r.verdict == "block" for r in verdicts if r.page_id) >= 5
    assert sum(r.verdict == "block" for r in verdicts if not r.page_id) == 0


def test_urls_empty_and_repeated_rows(spark):
    model = urls.Model([0.0] * urls.BUCKETS + [-1.0])
    pages = spark.createDataFrame([(None, "http://a.org/"), (1, "http://a.org/"), (1, "http://a.org/"), (2, None)], "page_id long, url string")
    got = sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in urls.judge(pages, model).collect() if r.host)
    assert got == [(0, "a.org", "org/", "allow"), (1, "a.org", "org/", "allow"), (1, "a.org", "org/", "allow")]
    assert urls.judge(pages.limit(0), model).collect() == []


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        rest = sum(weight[s] for s in names if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in capped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        capped |= over


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(0, 60))), "en", rng.choice(["a", "b", "b", "b", "c", "Z", None])) for i in range(900)]
    rows += [(10_000 + i, t, "en", "tiny") for i, t in enumerate(["one two", None, ""])]
    rows += [rows[0]] * 3 + [(None, "x y", "en", "a"), (None, "x y", "en", "a"), (11_000, "z", "en", "")]
    docs = tools.documents(spark, rows).withColumn("size", F.lit("clash"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(tools.blank_words(t))
    wanted, taken, largest = plain_targets(dict(sizes)), Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], abs_tol=1e-6)
        rate = wanted[r.source] / max(1, sizes[r.source])
        assert r.taken == r.copies * r.size and (r.copies in (math.floor(rate), math.ceil(rate)) or r.size == 0 or math.isclose(rate, round(rate)))
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - wanted[s]) <= largest[s] + 1e-6 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in out), key=key) == sorted((tuple(r) for r in again), key=key)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id IN (10001, 10002)")).collect()] == [0, 0]


def test_pivotal_steps_keep_mass_and_expectation(spark):
    """Every fold keeps the words of a block and decides all units but one; over many seeds the mean stays."""
    units = [(f"s{seed}", f"{seed}-{i}".encode(), 3 + i % 7, 0.3) for seed in range(400) for i in range(24)]
    df = spark.createDataFrame(units, "source string, key binary, size long, p double")
    out = mixing._level(df, F.lit(0)).collect()
    words, open_units = Counter(), Counter()
    for r in out:
        words[r.source] += r.size * r.p
        open_units[r.source] += r.open
        assert r.open or r.p in (0.0, 1.0)
    assert all(math.isclose(w, sum(3 + i % 7 for i in range(24)) * 0.3) for w in words.values()) and max(open_units.values()) == 1
    mean = np.mean([r.p for r in out])
    assert abs(mean - 0.3) < 0.02
    rounded = mixing.round_copies(df, 24 * 400)
    assert rounded.count() == len(units) and {r.extra for r in rounded.select("extra").distinct().collect()} == {0, 1}


def test_pipeline_stages(spark, tmp_path):
    """Every stage on its own input against a brute-force version of its decision."""
    docs = spark.read.parquet(f"{tools.SF}/documents.parquet")
    extra = tools.documents(spark, [(10**6 + i, t, "en", None) for i, t in enumerate(tools.AWKWARD)]).select(*docs.columns)
    docs.unionByName(extra).withColumn("place", F.lit(1)).write.parquet(str(tmp_path / "0"))
    now = spark.read.parquet(str(tmp_path / "0"))
    columns = now.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        before = now
        stage(spark, before, tools.SF).write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        old = {r.doc_id: r.text for r in before.collect()}
        new = {r.doc_id: r for r in now.collect()}
        if name == "quality":
            labels = spark.read.parquet(f"{tools.SF}/labels.parquet")
            judged = quality.scores(before, quality.train(before, labels)).collect()
            assert set(new) == {r.doc_id for r in judged if r.predicted == 1}
        elif name == "near_duplicates":
            ids = sorted(old)
            roots = tools.components([old[d] for d in ids])
            assert set(new) == {ids[k] for k in range(len(ids)) if roots[k] == k}
        elif name == "decontamination":
            bench = [tools.alnum_words(r.text) for r in spark.read.parquet(f"{tools.SF}/benchmark.parquet").collect()]
            windows = {tuple(w[k : k + 10]) for w in bench for k in range(max(1, len(w) - 9)) if w}
            sizes = {len(w) for w in windows}
            hit = {d for d, t in old.items() if (w := tools.alnum_words(t)) and any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
            assert set(new) == set(old) - hit
        elif name == "pii":
            assert set(new) == set(old)
            for d, r in new.items():
                assert r.text is None and old[d] is None or not pii.base_spans(r.text)
                assert r.n_chars == (len(r.text) if r.text is not None else None)
                assert any(c.isdigit() or c == "@" for c in old[d] or "") or r.text == old[d]
        else:
            assert set(new) == set(old) and sum(r.taken for r in new.values()) > 0
        assert name == "mixing" or now.columns == columns
    assert corpus_pipeline.run(spark, tools.SF).count() > 0


def test_pipeline_on_repeated_rows(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s")] * 3 + [(None, "a b c d e f g", "en", "s"), (None, "p q r s t u", "en", "s"), (None, "p q r s t u", "en", "s"), (2, None, "en", "s")]
    tools.documents(spark, rows).write.parquet(str(tmp_path / "d"))
    kept = jaccard.representatives(spark.read.parquet(str(tmp_path / "d")))
    assert tools.rows_of(kept, "doc_id", "text") == [(1, "a b c d e f g"), (2, None), (None, "p q r s t u")]
    empty = spark.read.parquet(str(tmp_path / "d")).limit(0)
    empty.write.parquet(str(tmp_path / "e"))
    now = spark.read.parquet(str(tmp_path / "e"))
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, tools.SF)
        assert now.count() == 0


def test_representatives_when_later_scans_are_split_otherwise(spark, tmp_path):
    rows = [(i, f"alone {i} " + " ".join(f"w{i}x{k}" for k in range(i + 8)), "en", "s") for i in range(40)]
    rows += [(100 + i, rows[3 * i][1], "en", "s") for i in range(8)]
    tools.documents(spark, rows).repartition(12, "doc_id").write.parquet(str(tmp_path / "d"))
    sizes = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    old = {k: spark.conf.get(k) for k in sizes}
    kept = jaccard.representatives(spark.read.parquet(str(tmp_path / "d")))
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_pieces_of_sliced_arrays():
    array = pa.array(["a", None, "b c", ""], pa.large_string()).slice(1)
    assert [p.data.tobytes() for p in text.pieces(array)] == [b"b c"]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_whose_letters_balance_do_not_collide(spark):
    """Linear word hashes give the word and its twin one hash, whatever their base."""
    swap = str.maketrans("ab", "ba")
    words = [thue_morse(n) for n in (512, 1024, 2048, 4096)]
    docs = tools.documents(spark, [(i, w, "en", "s") for i, w in enumerate([*words, *(w.translate(swap) for w in words)])])
    out = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert out == {i: i for i in range(8)}


def test_near_misses_make_few_pairs(spark):
    """A group of texts of which many are near misses of each other, in several components until all links are found."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    base = rng.choices(vocabulary, k=120)
    texts = [" ".join(edited(rng, base, rng.choice((0.004, 0.01, 0.02, 0.03)))) for _ in range(250)]
    docs = tools.documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    out = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert [out[i] for i in range(len(texts))] == tools.components(texts)


def test_long_page_ids_come_back_whole(spark):
    ids = ["p" * 60 + str(i) for i in range(3)]
    pages = spark.createDataFrame([(i, f"http://x.org/{i}", "h" * 1200) for i in ids], "page_id string, url string, html string")
    out = tools.rows_of(warc.page_records(pages), "page_id", "record_type", "refers_to")
    assert out == sorted([(ids[0], "revisit", ids[2]), (ids[1], "revisit", ids[2]), (ids[2], "response", None)])
