"""Hard negatives, byte pairs and periodic runs against plain versions, on given and on odd rows."""

import random
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute

from truthmill.llm import byte_pairs, hard_negatives, periodic
from truthmill.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- hard negatives ----------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (0, 3, 5), (7, 64, 33), (130, 17, 9), (40, 0, 40), (65, 64, 257)])
def test_strassen_is_the_exact_product(shape):
    rng = np.random.default_rng(shape[0])
    a, b = rng.integers(-(2**27), 2**27, shape[:2]), rng.integers(-(2**27), 2**27, shape[1:])
    assert (hard_negatives.strassen(a, b) == a @ b).all()


def test_heaps_merge_like_a_full_sort():
    rng = np.random.default_rng(4)
    scores, among = rng.integers(-5, 5, (20, 300)), rng.random((20, 300)) < 0.6
    heaps = hard_negatives.Heaps(20, 7)
    for first in range(0, 300, 50):
        heaps.offer(scores[:, first : first + 50], among[:, first : first + 50], first)
    for i in range(20):
        best = sorted(np.flatnonzero(among[i]), key=lambda j: (-scores[i, j], j))[:7]
        assert heaps.at[i].tolist() == best + [-1] * (7 - len(best))


def plain_negatives(rows):
    """Sorted result rows from (id, label, vector, is anchor) by full sorts."""
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    whole = [[int(np.floor(256 * float(x))) for x in r[2]] for r in ok]
    out = []
    for i, (a, label, _, is_anchor) in enumerate(ok):
        if not is_anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(whole[i], whole[j])), ok[j][0], ok[j][1]) for j in range(len(ok)) if j != i]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(a, pid, rank, s[1], -p, -s[0]) for rank, s in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("stripe, block", [(131_072, 4_096), (40, 3)])
def test_hard_negatives_of_hot_tied_and_odd_rows(spark, monkeypatch, stripe, block):
    monkeypatch.setattr(hard_negatives, "LEAST_STRIPE", 8)
    rng = random.Random(7)
    rows = [(i, 1 if rng.random() < 0.5 else rng.randrange(6), [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(rng.choice([5, 6]))]) for i in range(260)]
    same = [0.5, 0.25, 0.5, 0.0, 0.25]
    rows += [(1000 + i, i % 2, same) for i in range(90)] + [(1000, 0, same), (20, 3, same)]  # copies, repeated keys
    rows += [(None, 1, same), (2000, None, same), (2020, 1, None), (2040, 1, [0.5, None]), (2060, 1, [float("nan")]), (2080, 2, [float("-inf")]), (2100, 2, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    for name in ("_row", "_id", "_label", "rank", "slot", "q", "home", "stripe", "scores"):
        df = df.withColumn(name, F.lit("clash"))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, stripe=stripe, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives([(*r, r[0] is not None and r[0] % 20 == 0) for r in rows])
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(df.withColumn("embedding", F.array(F.lit(1e9))), F.lit(True))


def test_hard_negatives_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    result = con.execute(ORACLES["op11_hard_negatives"])
    columns = [c[0] for c in result.description]
    got = QUERIES["op11_hard_negatives"](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


# ---- byte pairs --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return byte_pairs.Encoder(VOCABULARY, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.table.ranks, special_tokens={})


def test_neighbours_are_those_that_merging_keeps(encoder):
    rng, table = random.Random(1), encoder.table
    names = list(table.tokens)
    for _ in range(4000):
        left, right = rng.choice(names), rng.choice(names)
        whole = table.tokens[left]
        if rng.random() < 0.6 and len(whole) > 1:  # parts of a token are the likely ones to merge
            cut = rng.randrange(1, len(whole))
            left, right = table.ranks.get(whole[:cut], left), table.ranks.get(whole[cut:], right)
        a, b = table.tokens[left], table.tokens[right]
        assert table.follows(left, right) == (table.merged(a + b) == [a, b])


PIECES = ["a", "b", " ", "  ", "\n", "'", "re", "ll", "s", "é", "漢", "1", "-", "==", "tion", "The", "\x1c", "\xa0", "🙂", "<|endoftext|>"]


def test_texts_encode_as_by_the_library_and_edits_as_from_scratch(encoder, library):
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(60)))
        ids = encoder.encode(text).tolist()
        assert ids == library.encode_ordinary(text)
        stored = encoder.prefixes(text)
        assert encoder.ids(text.encode(), stored) == ids
        start = rng.randrange(len(text) + 1)
        end = rng.choice([start, len(text), min(len(text), start + 4)])
        new = rng.choice(["", "s", "'", "re", " ", "x y", "  \n", "1" * 40])
        changed, after, _ = encoder.edited(text, stored, start, end, new)
        assert changed == text[:start] + new + text[end:]
        assert (after == encoder.prefixes(changed)).all()


@pytest.mark.parametrize("text", ["ab" * 3000, "x" * 5000, "漢字" * 2000, "some words " * 3000])
def test_an_edit_or_append_works_near_its_place_only(encoder, library, text):
    stored = encoder.prefixes(text)
    assert encoder.encode(text).tolist() == library.encode_ordinary(text)
    _, after, worked = encoder.edited(text, stored, len(text), len(text), "tail")
    assert (after == encoder.prefixes(text + "tail")).all() and worked < 60
    if " " in text:
        changed, after, worked = encoder.edited(text, stored, 40, 43, "ed")
        assert (after == encoder.prefixes(changed)).all() and worked < 60


def plain_ids(library, docs):
    out = []
    for key, text in docs:
        ids = library.encode_ordinary(text or "")
        out.append((key, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text or "")))
    return out


def test_byte_pair_query_gives_the_library_ids(spark, library, real):
    docs = [(r.doc_id, r.text) for r in real.collect()]
    assert sorted(map(tuple, QUERIES["op12_byte_pairs"](spark, FOLDER).collect())) == sorted(plain_ids(library, docs))


def test_byte_pairs_of_odd_rows(spark, library, odd, nothing):
    encoded = byte_pairs.encode(odd, VOCABULARY, public_tokenizers.PATTERN, prefixes=True)
    decoded = byte_pairs.decode(encoded, VOCABULARY)
    order = lambda rows: sorted(rows, key=repr)
    got = order((r.doc_id, list(r.ids), bytes(r.data)) for r in decoded.collect())
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect()]
    assert got == order(want)
    assert byte_pairs.encode(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    some = encoded.filter("doc_id = 9").join(odd.select("doc_id", "text"), "doc_id")
    edits = some.crossJoin(spark.createDataFrame([(None, None, " more"), (3, 5, None), (99, 2, "x")], "start int, end int, new string"))
    text = odd.filter("doc_id = 9").first().text
    want = [text + " more", text[:3] + text[5:], text + "x"]
    out = byte_pairs.edit(edits, VOCABULARY, public_tokenizers.PATTERN).collect()
    assert sorted(r.text for r in out) == sorted(want)
    assert all(list(r.ids) == library.encode_ordinary(r.text) for r in out)
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert byte_pairs.decode(null, VOCABULARY).first().data is None


# ---- periodic runs -----------------------------------------------------------------------


def plain_runs(w, exponent=4, least=6):
    """[(start, length, period)] by following every period over the whole text."""
    _, ids = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)
    seen = {}
    for q in range(1, len(w) // exponent + 1):
        equal = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(np.diff(equal))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + q >= max(least, exponent * q):
                seen.setdefault((i, j - i + q), q)
    return sorted((s, n, q) for (s, n), q in seen.items())


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_transform_of_squared_differences_is_exact():
    rng = np.random.default_rng(3)
    for block in (1, 2, 8, 64):
        values = rng.integers(0, 3, 9 * block).astype(np.uint64)
        got = periodic.mismatches(values, block, 1, 4)
        for d in range(block):
            for i in range(4):
                at = (1 + i) * block
                a, b = values[at : at + block].astype(int), values[at + block + d : at + 2 * block + d].astype(int)
                assert int(got[d, i]) == (int(((a - b) ** 2).sum()) or periodic.PRIME)


def test_runs_equal_the_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(250):
        texts = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 130))
            t = rng.integers(0, int(rng.integers(1, 5)), n)
            if n and rng.random() < 0.6:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, 25))
                t[a:] = np.resize(t[a : a + p], n - a)
            texts.append(t)
        exponent, least = int(rng.integers(3, 6)), int(rng.integers(1, 9))
        found = zip(*(x.tolist() for x in periodic.find_runs(texts, exponent, least)))
        got = [[] for _ in texts]
        for i, *run in found:
            got[i].append(tuple(run))
        assert got == [plain_runs(t.tolist(), exponent, least) for t in texts]


def test_long_periods_and_long_runs():
    t = np.arange(20_000)
    t[5000:] = np.resize(t[5000:8500], 15_000)
    assert [x.tolist() for x in periodic.find_runs([t])] == [[0], [5000], [15_000], [3500]]
    assert [x.tolist() for x in periodic.find_runs([np.zeros(50_000, int)])] == [[0], [0], [50_000], [1]]
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, exponent=2)


def plain_periods(docs):
    out = []
    for key, text in docs:
        w = brute.BLANK_WORD.findall(text or "")
        n = len(w)
        if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
            g = zlib.crc32(str(key).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((key, len(runs), *best, milli, brute.sha(lines), brute.sha(plain_collapsed(w, runs))))
    return out


def test_periodic_query_equals_the_plain_version(spark, real):
    docs = [(r.doc_id, r.text) for r in real.collect()]
    got = QUERIES["op13_periodic_runs"](spark, FOLDER)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == columns
    want = plain_periods(docs)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 5


def test_periodic_runs_of_odd_rows(spark, odd, nothing):
    order = lambda rows: sorted(rows, key=repr)
    rows = odd.unionByName(odd.limit(1).withColumn("text", F.lit("x y\tx y x\ny x y z a a a a a a a")).withColumn("doc_id", F.lit(50).cast("long")))
    got = order((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in periodic.periodic_runs(rows).collect())
    want = []
    for r in rows.collect():
        w = brute.BLANK_WORD.findall(r.text or "")
        runs = plain_runs(w)
        want.append((r.doc_id, len(w), runs, plain_collapsed(w, runs)))
    assert got == order(want)
    assert any(r[2] == [(0, 8, 2), (9, 7, 1)] for r in got)
    assert periodic.periodic_runs(nothing).count() == 0
