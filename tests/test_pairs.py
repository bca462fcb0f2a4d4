import math
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from truthmill.operators import pairs
from truthmill.operators.shared import stored


def terms():
    return F.filter(F.split("content", " "), lambda t: t != "")


def plain_pairs(rows, threshold):
    """{(unreliable id, credible id): (sizes, cosine)} of all pairs, one by one."""
    bags = [(key, label, Counter(t for t in text.split(" ") if t)) for key, label, text in rows]
    bags = [b for b in bags if b[2]]
    df = Counter(w for _, _, b in bags for w in b)
    classes = defaultdict(list)
    for key, label, b in bags:
        classes[label, tuple(sorted(b.items()))].append(key)
    vectors = {}
    for (label, bag), keys in classes.items():
        v = {w: n * math.log((len(bags) + 1) / (df[w] + 1)) for w, n in bag}
        vectors[label, min(keys)] = (len(keys), v, math.sqrt(sum(x * x for x in v.values())))
    out = {}
    for (la, a), (n, v, x) in vectors.items():
        for (lb, b), (m, w, y) in vectors.items():
            if la == 0 and lb == 1 and x and y:
                cosine = round(sum(v[t] * w[t] for t in v if t in w) / x / y, 6)
                if cosine >= threshold:
                    out[a, b] = (n, m, cosine)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(25)) for _ in range(12)]
    out = []
    for i in range(240):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(60)}"
        out.append((i, float(rng.randrange(2)), " ".join(["hot", *words])))
    out += [(1000 + i, float(i % 2), "hot copy of one text") for i in range(60)]
    return out + [(2000, 0.0, ""), (2001, 1.0, " "), (2002, 0.0, "hot"), (2003, 1.0, "hot"), (2004, 0.0, "rare"), (2005, 1.0, "rare rare")]


@pytest.mark.parametrize("threshold, block", [(0.3, 512), (0.6, 512), (0.6, 3), (0.95, 512), (1.0, 4)])
def test_pairs_equal_the_plain_search(spark, rows, threshold, block):
    df = spark.createDataFrame(rows, "doc_id long, label double, content string")
    found = pairs.similar_articles(df, terms(), threshold, block_rows=block).collect()
    got = {(r.unreliable_id, r.credible_id): (r.unreliable_articles, r.credible_articles, r.cosine) for r in found}
    want = plain_pairs(rows, threshold)
    assert len(found) == len(got) == len(want) > 0
    assert got.keys() == want.keys()
    for at in got:
        assert got[at] == pytest.approx(want[at], abs=2e-6)
    assert got[1000, 1001] == (30, 30, 1.0)  # sixty copies are one pair


def test_few_pairs_meet(spark, rows):
    """Only words with enough left of the vector from them on are joined."""
    df = spark.createDataFrame(rows, "doc_id long, label double, content string")
    classes = pairs.article_classes(df, terms(), "doc_id", "label")
    weights = pairs.inverse_frequency_weights(classes, "label").filter("label = 0").drop("label")
    _, prefix = pairs._vectors(weights, 0.9, "left")
    assert prefix.count() < 0.5 * weights.count()
    assert prefix.filter("left_rest < 0.9 - 1e-8").isEmpty()


def test_weights_of_any_sign_and_bad_thresholds(spark):
    schema = "id long, word string, df long, weight double"
    left = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, -1.0), (2, "a", 1, 1.0)], schema)
    right = spark.createDataFrame([(7, "a", 1, 2.0), (7, "b", 2, -2.0), (8, "b", 2, 1.0), (9, "c", 1, 1.0)], schema)
    found = pairs.similar_pairs(left, right, 0.5).collect()
    assert sorted(map(tuple, found)) == [(1, 7, 1.0), (2, 7, round(1 / math.sqrt(2), 6))]
    assert pairs.similar_pairs(left.limit(0), right, 0.5).count() == 0
    with pytest.raises(ValueError):
        pairs.similar_pairs(left, right, 0.0)


def test_members_of_classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, label double, content string")
    members = pairs.class_members(df, terms(), "doc_id", "label").collect()
    assert len(members) == len(rows) - 2
    assert {r.id for r in members if 1000 <= r.doc_id < 2000} == {1000, 1001}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_only_pairs_at_the_threshold_leave_their_tasks(spark, rows, chunk, monkeypatch):
    """Vectors are shuffled, pairs are not: nothing is exchanged above the step that makes them, whatever share a word."""
    monkeypatch.setattr(pairs, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "doc_id long, label double, content string")
    weights = pairs.inverse_frequency_weights(pairs.article_classes(df, terms(), "doc_id", "label"), "label")
    sides = [weights.filter(F.col("label") == c).drop("label") for c in (0.0, 1.0)]
    found = pairs.similar_pairs(*sides, 0.2, block_rows=50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapCoGroupsInArrow")[0] and "FlatMapCoGroupsInArrow" in plan
    want = {at: cosine for at, (_, _, cosine) in plain_pairs(rows, 0.2).items()}
    assert {(r.left, r.right): r.cosine for r in found.collect()} == pytest.approx(want, abs=2e-6)


def test_blocks_in_waves_leave_no_shuffles(spark, rows, monkeypatch):
    """With many blocks, what is shuffled at once is a few times the vectors, and it is gone when the wave's pairs are stored."""
    local = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in local for p in d.rglob("shuffle_*.data")}
    left_over, store = [], pairs.stored_alone

    def seen(df):
        before = files()
        out = store(df)
        until = time.time() + 30
        while files() - before and time.time() < until:  # they are removed in the background
            time.sleep(0.2)
        left_over.append(len(files() - before))
        return out

    monkeypatch.setattr(pairs, "stored_alone", seen)
    df = spark.createDataFrame(rows, "doc_id long, label double, content string")
    weights = pairs.inverse_frequency_weights(pairs.article_classes(df, terms(), "doc_id", "label"), "label")
    sides = [stored(weights.filter(F.col("label") == c).drop("label")) for c in (0.0, 1.0)]
    found = pairs.similar_pairs(*sides, 0.2, block_rows=20)
    assert len(left_over) > 1 and not any(left_over)
    before = files()
    stored(sides[0].groupBy("word").count())
    assert files() - before  # others stay
    want = {at: cosine for at, (_, _, cosine) in plain_pairs(rows, 0.2).items()}
    assert {(r.left, r.right): r.cosine for r in found.collect()} == pytest.approx(want, abs=2e-6)
