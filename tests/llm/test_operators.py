"""Every operator against a plain version on given and on odd rows, and on empty tables."""

import math
import sys
import tracemalloc
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import brute

from truthmill.llm import language_model, licenses, linedups, nearcopies, packing, quality, shards, substrings, suffixes, winnow
from truthmill.llm.repeats import hash_of
from truthmill.llm.textarrays import Rolling, window_minima, word_hashes


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def with_least(rows):
    """Plain versions compare keys, so a null key is the smallest number there."""
    return [(k if k is not None else -(1 << 63), t) for k, t in rows]


def nulled(rows):
    return [tuple(None if x == -(1 << 63) else x for x in r) for r in rows]


@pytest.mark.parametrize("hot", [8192, 1])
@pytest.mark.parametrize("which", ["real", "odd"])
def test_substrings(request, which, hot):
    df = request.getfixturevalue(which)
    cut = substrings.drop_repeated_passages(df, hot=hot)
    out = cut.select("doc_id", "n_words", "n_removed", hash_of("kept_text")).collect()
    assert ordered(out) == ordered(nulled(brute.substrings(with_least(pairs(df)))))


@pytest.mark.parametrize("which", ["real", "odd"])
def test_suffixes(request, which):
    df = request.getfixturevalue(which)
    cut = suffixes.drop_repeated_strings(df)
    out = cut.select("doc_id", "n_bytes", "n_removed", "n_spans", hash_of("kept")).collect()
    assert ordered(out) == ordered(brute.suffixes(pairs(df)))


def test_suffixes_of_edited_copies(spark):
    """Copies of one text with edits, cuts and shifts at many places, so that windows are settled in every round; and runs of one byte."""
    rng = np.random.default_rng(5)
    base = "".join(chr(97 + c) for c in rng.integers(0, 26, 3000))
    rows = [(0, base), (1, base), (2, "a" * 900), (3, "a" * 399), (4, "b" * 401)]
    for key in range(5, 45):
        lo, hi = sorted(rng.integers(0, 3000, 2).tolist())
        at = int(rng.integers(0, 3000))
        edited = base[:at] + "#" * int(rng.integers(0, 3)) + base[at + int(rng.integers(0, 3)) :]
        rows.append((key, f"{key}" + edited[lo : hi + 450]))
    for i, at in enumerate(range(1000, 1420, 7)):  # one odd byte at growing distances
        rows.append((100 + i, f"{i}-" + base[at - 400 : at] + "?" + base[at + 1 : at + 410 - i] + f"{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window, k in ((400, 100), (64, 20), (40, 40)):
        cut = suffixes.drop_repeated_strings(docs, window=window, k=k)
        out = cut.select("doc_id", "n_bytes", "n_removed", "n_spans", hash_of("kept")).collect()
        assert ordered(out) == ordered(brute.suffixes(rows, window))


def test_suffixes_catch_planted_passages(spark):
    """Passages of 400 to 900 bytes in pairs of documents that have nothing else in common: all are removed from both, and from nothing else."""
    rng = np.random.default_rng(8)
    rows, planted = [], {}
    for i in range(60):
        passage = "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(400, 900))))
        for j in (0, 1):
            own = ["".join(chr(65 + c) for c in rng.integers(0, 26, 500)) for _ in (0, 1)]
            own = [own[0] + str(j), str(j) + own[1]]  # so that no passage goes on by chance
            rows.append((2 * i + j, own[0] + passage + own[1]))
            planted[2 * i + j] = own[0] + own[1]
    rows += [(1000 + i, "".join(chr(65 + c) for c in rng.integers(0, 26, 2000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in suffixes.drop_repeated_strings(docs).collect()}
    assert all(bytes(out[k].kept).decode() == own for k, own in planted.items())
    assert all(out[1000 + i].n_removed == 0 for i in range(60))


def test_suffixes_hold_few_positions_at_once():
    """A task's numbers for each byte follow the piece of text it works on: memory beside a batch stays a small multiple of a long text."""
    rng = np.random.default_rng(4)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 100_000)) for _ in range(24)]
    keys = pa.array(range(24))
    slices = pa.RecordBatch.from_arrays([keys, keys, pa.array(texts)], names=["_key", "_mark", "_text"])
    spans = [pa.array([[at] for at in range(24)], pa.list_(pa.int64())), pa.array([[at + 500] for at in range(24)], pa.list_(pa.int64()))]
    cuts = pa.RecordBatch.from_arrays([keys, pa.array(texts), *spans], names=["_key", "_text", "_starts", "_ends"])
    for work, batch, column, expected in ((suffixes._slices(400, 100), slices, "n", 24 * 99_601), (suffixes._cut, cuts, "n_removed", 24 * 500)):
        tracemalloc.start()
        total = sum(sum(out.column(column).to_pylist()) for out in work(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total == expected
        assert peak < 40e6


@pytest.mark.parametrize("which", ["real", "odd"])
def test_near_copies(request, which):
    df = request.getfixturevalue(which)
    out = nearcopies.near_copies(df).drop("text_hash").collect()
    rows = pairs(df)
    if which == "real":
        assert ordered(out) == ordered(brute.near(rows))
    else:
        found = {(r.doc_id, r.n_shingles): r for r in out}
        assert len(out) == len(rows)
        assert {found[k, 116].component_id for k in (5, 6, None)} == {5} and found[None, 116].kept is False
        assert found[7, 117].component_id == 5 and found[11, 1].component_id == 10
        assert found[1, 0].kept and found[2, 0].kept and found[None, 0].component_id is None


@pytest.mark.parametrize("compared", [1024, 2])
def test_near_copies_of_families_around_the_threshold(spark, real, monkeypatch, compared):
    """Copies with one to four edited words in a hundred, some beyond the threshold; small buckets force dealing anew."""
    monkeypatch.setattr(nearcopies, "COMPARED", compared)
    rng = np.random.default_rng(3)
    rows = []
    for _, text in sorted(pairs(real))[:12]:
        words = (text.split() * 3)[:150]
        for _ in range(6):
            own = list(words)
            for at in rng.integers(0, len(own), rng.integers(1, 7)):
                own[at] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(own)))
    out = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()
    assert ordered(out) == ordered(brute.near(rows))


@pytest.mark.parametrize("sent", [8_000_000, 0])
@pytest.mark.parametrize("which", ["real", "odd"])
def test_language_model(request, which, sent, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 20_000)
    df = request.getfixturevalue(which)
    rows = pairs(df)
    out = ordered(language_model.score_texts(df, sent_words=sent).collect())
    fixed = [("" if k is None else k, t) for k, t in rows]
    expected = ordered((None if r[0] == "" else r[0], *r[1:]) for r in brute.language_model(fixed))
    assert len(out) == len(expected)
    for a, b in zip(out, expected):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_words_of_one_text_are_not_sent(spark, monkeypatch):
    """Only words of two texts and more count against the bound; what a text alone has is counted there, and its pairs stay."""
    monkeypatch.setattr(language_model, "_joined_pairs", None)
    rows = [(i, f"both a{i} a{i} b{i} both both a{i} a{i}" + " more" * (i % 2)) for i in range(40)]
    rows += [(i, None if i % 2 else "c" * i) for i in range(40, 44)]
    out = ordered(language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sent_words=3).collect())
    expected = ordered(brute.language_model(rows))
    assert [r[:5] for r in out] == [r[:5] for r in expected]
    assert [r[5:] for r in out] == [pytest.approx(r[5:], rel=1e-9) for r in expected]


def test_only_a_to_z_are_lowered_in_license_scans(spark):
    docs = spark.createDataFrame([(1, "MIT LICENSE"), (2, "m\u0130t license"), (3, "apache licen\u017fe"), (4, "Apache  License")], "doc_id long, text string")
    out = {r.doc_id: (r.n_words, r.base_labels) for r in licenses.license_scan(docs).collect()}
    assert out == {1: (2, "mit"), 2: (2, ""), 3: (2, ""), 4: (2, "apache")}


def test_model_beats_single_words_on_held_out_texts(real):
    sums = language_model.score_texts(real).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


@pytest.mark.parametrize("which", ["real", "odd"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(df, path, public_tokenizers.PATTERN).collect()
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for key, text in pairs(df):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start, length, piece = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            expected.append((key, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            start, length, piece = start + length, 2048, piece + 1
    assert ordered((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in out) == ordered(expected)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for slots in bins.values():
        assert sum(n for _, n in slots) <= 2048
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
    assert len(bins) <= 1.05 * -(-sum(r.length for r in out) // 2048) + 1


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_item_once(histogram):
    bins, seen = defaultdict(list), defaultdict(set)
    for length, rank, first, each, offset in packing.plan(histogram, 64):
        after = [r[1] for r in packing.plan(histogram, 64) if r[0] == length and r[1] > rank]
        for i in range(rank, min(after, default=histogram[length])):
            seen[length].add(i)
            bins[first + (i - rank) // each].append((offset + (i - rank) % each * length, length))
    assert {k: len(v) for k, v in seen.items()} == histogram
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("which", ["real", "odd"])
def test_shards(request, which):
    df = request.getfixturevalue(which).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
    df = df.withColumn("group", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = shards.shard(df, "size", "group", shards=5, task_bytes=20_000).collect()
    assert len(out) == df.count()
    by, groups = defaultdict(list), defaultdict(set)
    for r in out:
        by[r.shard].append(r)
        groups[r.group].add(r.shard)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert set(by) <= set(range(5))
    if which == "real":
        total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
        assert all(abs(sum(r["size"] for r in rows) - total / 5) <= 2 * largest for rows in by.values())
        assert sum(len(s) > 1 for s in groups.values()) <= 4


def test_shards_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, 10, i, f"a{i}", "b", "c", "d", "e") for i in range(40)], "k long, n long, g long, _at string, _size string, _part string, _place string, _base string")
    out = shards.shard(rows, "n", "g", shards=4)
    assert out.columns == [*rows.columns, "shard", "slot"]
    assert {(r.k, r["_at"], r["_base"]) for r in out.collect()} == {(i, f"a{i}", "e") for i in range(40)}


def test_shard_query_against_the_contract(spark, real):
    from truthmill.llm.queries import op2_histogram_shards

    texts = {r.doc_id: r.text or "" for r in real.collect()}
    out = op2_histogram_shards(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    slots, weight = defaultdict(list), defaultdict(int)
    for r in out:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
    assert set(slots) <= set(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean, largest = sum(weight.values()) / 40, max(r["size"] for r in out)
    assert max(weight.values()) <= mean + largest  # a row cannot be cut, so no shard is over by more than one


def test_a_hot_group_is_cut_between_shards(spark):
    rows = spark.range(3000).select("id", F.lit(10).alias("size"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"))
    sizes = [r[1] for r in shards.shard(rows, "size", "g", shards=10).groupBy("shard").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 30


def test_odd_rows_of_the_native_operators(odd, odd_rows):
    scan = licenses.license_scan(odd).collect()
    assert len(scan) == len(odd_rows) and all(r.labels == "" and r.score == 0 for r in scan)
    cut = linedups.drop_repeated_lines(odd).collect()
    assert len(cut) == len(odd_rows) and all(r.n_removed == 0 for r in cut)
    rules = quality.quality_rules(odd, least_rows=3).collect()
    assert len(rules) == len(odd_rows)
    assert {r.kept for r in rules if r.n_words < 10} == {False}


def test_overlap_on_odd_rows(spark, odd, odd_rows):
    items = [(7, "s3 S4 s5 s6 s7 s8 s9 s10 s11 s12 s13"), (8, "A b"), (9, None), (None, "one"), (7, "tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for sent in (winnow.SENT_FINGERPRINTS, 0):
        out = {(r.doc_id, r.n_words): r for r in winnow.benchmark_overlap(odd, bench, sent_fingerprints=sent).collect()}
        assert out[5, 120].hits == list(range(3, 14)) and out[5, 120]["items"] == ["7"]
        assert out[7, 121].hits == [*range(3, 14), 120]
        assert out[10, 4].hits == [0, 1] and out[11, 4]["items"] == ["8"]
        assert out[4, 1].hits == [] and out[1, 0].hits == []
    empty = winnow.benchmark_overlap(odd, bench.limit(0))
    assert empty.filter(F.size("hits") > 0).isEmpty() and empty.count() == len(odd_rows)


def test_notices_wrapped_over_lines(spark, real):
    text = {label: t.lower() for label, t in licenses.TEMPLATES if label in ("mit", "bsd", "cc-by")}
    text["mit"] = licenses.TEMPLATES[4][1]

    def wrapped(label, width, mark=""):
        w = text[label].split()
        return "x y\n" + "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width)) + "\nthe end of it"

    rows = [(1, wrapped("mit", 9)), (2, wrapped("bsd", 7, " * ")), (3, wrapped("cc-by", 4, "// ")), (4, wrapped("mit", 1)), (5, wrapped("bsd", 99))]
    far = "\n".join(w + " z" * 5 for w in text["bsd"].split())  # all its words, but no stretch holds enough of them
    other = "it was released\nLicensed under the Apache License, Version 2.0."  # four of five words of a notice it does not hold
    docs = spark.createDataFrame([*rows, (6, far), (7, "\n \n"), (8, other)], "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert [out[k].labels for k in range(1, 9)] == ["mit", "bsd", "cc-by", "mit", "bsd", "", "", "apache"]
    assert all(out[k].score >= 0.8 for k in range(1, 6)) and out[6].score == 0

    # given texts, each line broken after every fourth blank, against plain lines and stretches of words
    broken = [(k, "\n".join(" ".join(w[i : i + 4]) for x in t.split("\n") for w in [x.split(" ")] for i in range(0, len(w), 4))) for k, t in pairs(real)]
    expected = {}
    for key, t in broken:
        w, shares = licenses.words_of(t), []
        for label, template in licenses.TEMPLATES:
            own, reach = set(licenses.tokens(template)), len(licenses.words_of(template))
            blocks = [set(licenses.words_of(x)) for x in t.split("\n")] + [set(w[i : i + reach]) for i in range(len(w))]
            shares += [(len(b & own) / len(own), label) for b in blocks if len(b & own) >= licenses.needed(len(own), licenses.THRESHOLD)]
        labels = {label for _, label in shares} | {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {' '.join(w)} "}
        expected[key] = ",".join(sorted(labels))
    found = licenses.license_scan(spark.createDataFrame(broken, "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in found.collect()} == expected


def test_runs_of_lines(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n b \nc\n\nd\ny"), (3, "b\nc"), (4, "q\nq\nq\nq\nq"), (None, "m\nn\no"), (5, "m\nn\no\np")]
    out = {r.doc_id: r for r in linedups.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept_text == "a\nb\nc\nd"
    assert out[2].kept_text == "x\n\ny" and out[2].n_removed == 3
    assert out[3].kept_text == "b\nc"  # two lines are no run
    assert out[4].kept_text == "q" and out[None].n_removed == 0 and out[5].kept_text == "p"


def test_repeated_paragraphs_of_one_or_two_lines(spark, real):
    para, half = " ".join(f"p{i}" for i in range(60)), [" ".join(f"{c}{i}" for i in range(30)) for c in "gh"]
    rows = [(1, f"a\n{para}\nb"), (2, para), (3, "\n".join(["x", *half, "y"])), (4, "\n\n".join(half)), (5, f"{half[0]}\na"), (6, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in linedups.drop_repeated_lines(docs, long_words=50).collect()}
    assert [out[k].n_removed for k in range(1, 7)] == [0, 1, 0, 2, 0, 0] and out[2].kept_text == ""
    assert linedups.drop_repeated_lines(docs).filter("n_removed > 0").isEmpty()  # the registered rule: runs of three only

    seen, expected = set(), {}
    for key, text in sorted(pairs(real)):
        whole, gone = text.split("\n"), set()
        lines = [(x.strip(linedups.BLANKS), i) for i, x in enumerate(whole) if x.strip(linedups.BLANKS)]
        for n in (1, 2, 3):
            for i in range(len(lines) - n + 1):
                run = tuple(x for x, _ in lines[i : i + n])
                if n == 3 or sum(len(x.split()) for x in run) >= 50:
                    gone |= {at for _, at in lines[i : i + n]} if run in seen else set()
                    seen.add(run)
        expected[key] = "\n".join(x for i, x in enumerate(whole) if i not in gone)
    assert {r.doc_id: r.kept_text for r in linedups.drop_repeated_lines(real, long_words=50).collect()} == expected


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("wor", "te", "ran", "mil") for b in ("d", "xt", "ge", "ler", "sing")]
    rows = [(i, " ".join(rng.choice(words, rng.integers(30, 300))) + ".", "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in rng.choice(words, 100)), "en", "s") for i in range(20)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept or r.base_failed for r in out.collect()}
    assert not any(kept[1000 + i] for i in range(20)) and sum(not kept[i] for i in range(400)) <= 2


def test_quality_rejects_junk_beyond_a_quarter_of_a_group(spark):
    rng = np.random.default_rng(7)
    words = [f"{a}{b}" for a in ("wor", "te", "ran", "mil") for b in ("d", "xt", "ge", "ler", "sing")]
    rows = []
    for source, junk in (("s20", 20), ("s30", 30), ("s40", 40)):
        for i in range(500):
            bad = i < 5 * junk
            own = rng.choice(words, 100 if bad else rng.integers(30, 300))
            rows.append((len(rows), " ".join(w + "$$$" if bad and rng.random() < 0.8 else w for w in own) + ".", "en", source, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).filter("NOT base_failed").collect()}
    assert {k for k, *_, bad in rows if bad and kept.get(k)} == set()
    assert sum(not kept[k] for k, *_, bad in rows if not bad and k in kept) <= 6


@pytest.mark.parametrize(
    "run",
    [
        language_model.score_texts, licenses.license_scan, suffixes.drop_repeated_strings, linedups.drop_repeated_lines,
        nearcopies.near_copies, quality.quality_rules, substrings.drop_repeated_passages,
        lambda df: packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
        lambda df: shards.shard(df.withColumn("g", F.xxhash64("text")), "n_chars", "g"),
        lambda df: winnow.benchmark_overlap(df, df.withColumnRenamed("doc_id", "item_id")),
    ],
)
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=40), st.integers(1, 9))
def test_window_minima(values, width):
    x = np.array(values, dtype=np.uint64) << np.uint64(40)
    expected = [i + int(np.argmin(x[i : i + width])) for i in range(len(x) - width + 1)]
    assert window_minima(x, width).tolist() == expected


def test_rolling_hash_names_equal_stretches():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    roll = Rolling(1)
    at = np.arange(7)
    names = roll.stretch(roll.sums(data), at, at + 3)
    assert names[0] == names[3] and len(set(names.tolist())) == 4


# ---- words that a sum of powers takes for equal --------------------------------------------


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of two letters whose sums of powers agree modulo 2**64 for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_different_words_stay_different(spark, n):
    one, two = thue_morse(n)
    assert Rolling(1).sums(np.frombuffer(one.encode(), np.uint8))[-1] == Rolling(1).sums(np.frombuffer(two.encode(), np.uint8))[-1]
    rest = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {rest}"), (4, f"{two} {rest}")], "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert near[1] == 1 and near[2] == 2
    cut = {r.doc_id: r.n_removed for r in substrings.drop_repeated_passages(docs).collect()}
    assert cut == {1: 0, 2: 0, 3: 0, 4: 0}
    found = winnow.benchmark_overlap(docs, spark.createDataFrame([(7, one)], "item_id long, text string")).collect()
    assert {r.doc_id: len(r.hits) for r in found} == {1: 1, 2: 0, 3: 1, 4: 0}
    out = language_model.score_texts(docs).collect()
    assert ordered(tuple(r)[:5] for r in out) == ordered(r[:5] for r in brute.language_model(pairs(docs)))


def test_word_hashes_tell_lengths_and_places_apart():
    rng = np.random.default_rng(8)
    made = {bytes(rng.integers(0, 3, rng.integers(0, 40), dtype=np.uint8)) for _ in range(4000)} | {b"\0" * i for i in range(1, 700, 7)}
    made = sorted(made)
    data = np.frombuffer(b"".join(made), np.uint8)
    end = np.cumsum([len(x) for x in made])
    start = end - [len(x) for x in made]
    for seed in (1, 2):
        assert len(set(word_hashes(data, start, end, seed).tolist())) == len(made)
    turned = np.roll(np.arange(len(made)), 1)
    assert (word_hashes(data, start[turned], end[turned], 1) == word_hashes(data, start, end, 1)[turned]).all()


# ---- near copies, compared inside tasks ---------------------------------------------------


def test_intersections_and_forests():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype("<u8")) for _ in range(40)]
    got = nearcopies._intersections(sets)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    link = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4)):
        link[a, b] = link[b, a] = True
    assert len(nearcopies._forest(link, np.arange(6))) == 3
    assert len(nearcopies._forest(link, np.array([0, 0, 0, 3, 4, 5]))) == 1
    assert len(nearcopies._forest(link, np.array([0, 1, 2, 0, 4, 5]))) == 3


@pytest.mark.parametrize("compared", [1024, 8])
def test_links_of_a_large_family_are_as_many_as_its_copies(spark, monkeypatch, compared):
    """Edited copies of one text, alike in all buckets: what leaves a task is bounded by the classes it reads, and no link is lost."""
    monkeypatch.setattr(nearcopies, "COMPARED", compared)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(words)
        for at in rng.integers(0, 100, 3):
            own[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join([*words[:40], *(f"o{i}_{j}" for j in range(60))])) for i in range(60)]  # a common passage only
    out = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()
    assert ordered(out) == ordered(brute.near(rows))


def test_recall_at_the_threshold_through_dealt_buckets(spark, monkeypatch):
    """Pairs between 0.75 and 0.9 that also share a passage with hundreds of other texts, so that their buckets are dealt anew."""
    monkeypatch.setattr(nearcopies, "COMPARED", 16)
    rng = np.random.default_rng(11)
    common = [f"c{i}" for i in range(60)]
    rows, pairs_of = [], []
    for i in range(120):
        own = [f"p{i}_{j}" for j in range(60)]
        other = list(own)
        other[-int(rng.integers(1, 8)) :] = ["z"]
        pairs_of.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(common + own)), (len(rows) + 1, " ".join(common + other))]
    want = {r[0]: r[2] for r in brute.near(rows)}
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [p for p in pairs_of if want[p[0]] == want[p[1]]]
    assert len(linked) > 100
    assert sum(got[a] == got[b] for a, b in linked) >= 0.98 * len(linked)


def test_bands_that_would_miss_links_are_refused(spark, odd):
    with pytest.raises(ValueError, match="miss"):
        nearcopies.near_copies(odd, similar=50)
