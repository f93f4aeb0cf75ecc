"""What the near-duplicate join shuffles and stores: no texts of rows that stay, no bit sketches for words of few sets."""

import os
import random

import pytest

from gridspark.llm import jaccard, tables
from tests.llm import tools


@pytest.fixture
def own(spark):
    """A session without broadcast joins, as if all tables were large."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return session


def shuffle_bytes(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    files = (os.path.join(at, f) for top in folders for at, _, names in os.walk(str(top)) for f in names)
    return {f: os.path.getsize(f) for f in files if os.path.basename(f).startswith("shuffle_") and f.endswith(".data")}


def test_texts_of_rows_that_stay_are_not_shuffled(own, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.randbytes(4).hex() for _ in range(200)) for _ in range(1_500)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, texts[0], texts[1], None, "", " "])]
    rows += [rows[7], rows[7], (None, "of no id", "en", "s"), (None, "of no id", "en", "s")]
    tools.documents(own, rows).write.parquet(str(tmp_path / "d"))
    kept = jaccard.representatives(own.read.parquet(str(tmp_path / "d")))
    before = shuffle_bytes(own)
    out = kept.select("doc_id", "text").collect()
    written = sum(size for f, size in shuffle_bytes(own).items() if f not in before)
    assert written < 0.1 * sum(map(len, texts))
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "")) for r in out) == sorted(
        (i is None, i or 0, t or "") for i, t in [*enumerate(texts), (1502, None), (1503, ""), (1504, " "), (None, "of no id")]
    )


def changed(rng, words, times):
    out = list(words)
    for at in rng.sample(range(len(words)), times):
        out[at] = f"c{rng.random()}"
    return out


def near_misses(rng, groups, members, times):
    """Texts of groups whose members are like each other, but mostly not enough to link."""
    out = []
    for _ in range(groups):
        base = [f"w{rng.random()}" for _ in range(200)]
        out += [" ".join(changed(rng, base, times)) for _ in range(members)]
    return out


def recorded(monkeypatch):
    """The tables that the join stores from now on, by tag."""
    seen = {}

    def stored(df, tag):
        seen[tag] = tables.stored(df, tag)
        return seen[tag]

    monkeypatch.setattr(jaccard, "stored", stored)
    return seen


def test_words_of_few_sets_store_no_bit_sketches(spark, monkeypatch):
    texts = near_misses(random.Random(1), 30, 2, 4)
    seen = recorded(monkeypatch)
    docs = tools.documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    out = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert out == dict(enumerate(tools.components(texts)))
    assert seen["jaccard-blocks"].count() == 0
    assert seen["jaccard-pairs"].count() > 0


@pytest.mark.parametrize("few", [0, 4, 1_000])
def test_components_by_pairs_of_ids_and_by_blocks(spark, monkeypatch, few):
    rng = random.Random(2)
    texts = near_misses(rng, 3, 12, 3) + near_misses(rng, 8, 2, 2) + near_misses(rng, 1, 20, 2)
    monkeypatch.setattr(jaccard, "FEW", few, raising=False)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)  # more is left to the open pairs
    seen = recorded(monkeypatch)
    docs = tools.documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    out = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert out == dict(enumerate(tools.components(texts)))
    assert len(set(out.values())) < len(texts)
    assert (seen["jaccard-blocks"].count() > 0) == (few < 1_000)


def test_pairs_meet_each_side_once(spark):
    pairs = spark.createDataFrame([(1, 2, 20)], "a long, b long, total long")
    sets = spark.createDataFrame([(1, bytearray(64)), (2, bytearray(64))], "sid long, bits binary")
    close = jaccard._close(pairs, sets, 80)
    assert close._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert [tuple(r) for r in close.collect()] == [(1, 2)]
