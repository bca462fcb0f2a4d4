"""Log probabilities of texts under a bigram model by deleted interpolation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from truthmill.llm.textarrays import BLANKS, lowered, pieces, signed, word_hashes, words
from truthmill.operators.shared import stored

#: Of the training folds 1 to 9, this one is held back from the counts that the weights are learnt on.
DELETED_FOLD = 9
ROUNDS = 15
#: Contexts are put together by the power of two of their count.
FREQUENCIES = 32
#: Up to so many words (16 bytes each) travel to every task; with more, tokens are joined with them by shuffles.
SENT_WORDS = 8_000_000
BUCKET_TOKENS = 1_200_000
#: Pairs of so many tokens are scored where they stand; there are at most total / HOT_TOKENS of them.
HOT_TOKENS = 100_000
END, START = np.uint64(1), np.uint64(2)
#: Words of the vocabulary that tasks must be told about: what a text alone has, it can count itself.
SENT = "n > 0 and texts > 1"


class Tokens:
    """Word hashes of the texts of a piece, each text followed by its end."""

    def read(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """Sets word (hashes), doc, and first: the bounds of each text's tokens."""
        data = lowered(data)
        n = len(offsets) - 1
        doc, start, end = words(data, offsets, BLANKS)
        hashes = word_hashes(data, start, end, 1)
        hashes += np.uint64(3) * (hashes < np.uint64(3))  # keeps the marks of end and start free
        self.doc = np.concatenate([doc, np.arange(n)])
        order = np.argsort(self.doc, kind="stable")
        self.doc, self.word = self.doc[order], np.concatenate([hashes, np.full(n, END)])[order]
        self.first = np.searchsorted(self.doc, np.arange(n + 1))


def _ordered(key: np.ndarray, most: int) -> np.ndarray:
    """Places of the keys, each ``most`` at most, in ascending order, equal ones as they stand; short keys are sorted together with their places."""
    bits = len(key).bit_length()
    if int(most).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    at = np.sort((key.astype(np.int64) << bits) | np.arange(len(key)))
    return at & ((1 << bits) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each piece of texts with their tokens in the training folds and in the deleted one, and the texts they stand in."""
    tokens = Tokens()
    for batch in batches:
        fold = batch.column("_fold").to_numpy()
        for lo, hi, data, offsets in pieces(batch.column("_text")):
            tokens.read(data, offsets)
            of = fold[lo + tokens.doc]
            word, place = np.unique(tokens.word, return_inverse=True)
            held = np.bincount(place, weights=of == DELETED_FOLD, minlength=len(word)).astype(np.int64)
            total = np.bincount(place, weights=of != 0, minlength=len(word)).astype(np.int64)
            stands = np.sort(tokens.doc * len(word) + place)
            texts = np.bincount(stands[np.append(True, stands[1:] != stands[:-1])] % len(word), minlength=len(word))
            columns = (signed(word), total, held, texts.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "n", "held", "texts"])


class Lookup:
    """Places of words in the sorted vocabulary of words of several texts; other words share the place behind the last, starts the one after.

    ``total`` and ``types`` count the tokens and the distinct words of all training texts.
    """

    def __init__(self, vocabulary: dict):
        self.word, self.n, self.counted, self.total, self.types = (vocabulary[name] for name in ("word", "n", "counted", "total", "types"))

    def ids(self, word: np.ndarray) -> np.ndarray:
        size = len(self.word)
        at = np.minimum(np.searchsorted(self.word, word), max(size - 1, 0))
        known = self.word[at] == word if size else np.zeros(len(word), bool)
        return np.where(known, at, size)


def _in_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pa.array([np.ascontiguousarray(c.to_numpy()).tobytes()], pa.binary()) for c in batch.columns]
        yield pa.RecordBatch.from_arrays(packed, names=["word", "n", "held"])


def _collected(vocabulary: DataFrame, size: int, kind: type, docs) -> dict[str, np.ndarray]:
    """The words to send as arrays in the order of their hashes; one partition at a time comes to the driver.

    The counts have two more places: 0 for unseen words, and the texts for starts.
    """
    word, n, counted, at = np.empty(size, np.uint64), np.empty(size, kind), np.empty(size, kind), 0
    packed = vocabulary.filter(SENT).select("word", "n", "held").mapInArrow(_in_columns, "word binary, n binary, held binary")
    for row in packed.toLocalIterator():
        own, total, held = np.frombuffer(row[0], np.uint64), np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int64)
        word[at : at + len(own)], n[at : at + len(own)], counted[at : at + len(own)] = own, total, total - held
        at += len(own)
    order = np.argsort(word)
    with_ends = lambda x, starts: np.append(x[order], np.array([0, starts], dtype=kind))
    return {"word": word[order], "n": with_ends(n, docs[0]), "counted": with_ends(counted, docs[1])}


_NO_PAIRS = np.zeros(0, np.uint64), np.zeros(0, np.int64)
_PACKET = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary"


def _packets(sent, buckets: int, learn: bool, hot: tuple[np.ndarray, np.ndarray] = _NO_PAIRS, weights: np.ndarray | None = None) -> Callable:
    """Pairs of neighbouring tokens, packed by bucket.

    To learn: distinct pairs with their counts outside and inside the deleted fold. To score:
    distinct pairs with the documents they stand in, and a packet of each document's key,
    counts of tokens, and sum over the pairs that are scored in place: the hot ones, whose counts every task knows, so that no bucket
    takes all occurrences of a frequent pair, and those of a word that only this text has, whose counts are the text's own. Such words
    are not among the sent ones, and their pairs of the deleted fold, which stand nowhere else, go as a packet of kind 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, look = Tokens(), Lookup(sent.value)
        size, total, types = len(look.word), look.total, look.types
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            fold = batch.column("_fold").to_numpy()
            for lo, hi, data, offsets in pieces(batch.column("_text")):
                tokens.read(data, offsets)
                chunk += 1
                doc, of = tokens.doc, fold[lo + tokens.doc]
                own, word = np.unique(tokens.word, return_inverse=True)
                place = look.ids(own)
                alone = place == size  # a word of one text, or of none that is trained on
                n_own = np.where(alone, np.bincount(word, weights=of != 0, minlength=len(own)).astype(np.int64), look.n[place])
                own_place = np.append(place, size + 1)  # the last is the start's
                own_n = np.append(n_own, look.n[size + 1])
                own_counted = np.append(np.where(alone, n_own - np.bincount(word, weights=of == DELETED_FOLD, minlength=len(own)).astype(np.int64), look.counted[place]), look.counted[size + 1])
                alone = np.append(alone, False)
                context = np.empty_like(word)
                context[1:] = word[:-1]
                context[tokens.first[:-1]] = len(own)
                out: list[tuple] = []
                if learn:
                    some = of != 0
                    word, context, of, doc = word[some], context[some], of[some], doc[some]
                wide, each = len(own) + 1, word
                order = _ordered(context * wide + word, wide * wide)
                word, context, of, doc = word[order], context[order], of[order], doc[order]
                lead = np.ones(len(word), bool)
                lead[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
                firsts = np.flatnonzero(lead)
                n = np.diff(np.append(firsts, len(word)))
                held = np.add.reduceat(of == DELETED_FOLD, firsts, dtype=np.int64) if len(word) else n
                trained = np.add.reduceat(of != 0, firsts, dtype=np.int64) if len(word) else n
                word, context = word[firsts], context[firsts]
                pair = (own_place[context].astype(np.uint64) << np.uint64(32)) | own_place[word].astype(np.uint64)
                here = alone[context] | alone[word]
                if learn:
                    cells = here & (held > 0)
                    if cells.any():
                        parts = (own_counted[context[cells]], own_counted[word[cells]], held[cells])
                        out.append((chunk % buckets, 2, *(x.astype(np.int64).tobytes() for x in parts), b""))
                else:
                    count = np.where(here, trained, 0)
                    if len(hot[0]):
                        at = np.minimum(np.searchsorted(hot[0], pair), len(hot[0]) - 1)
                        frequent = ~here & (hot[0][at] == pair)
                        here, count = here | frequent, np.where(frequent, hot[1][at], count)
                    log = np.zeros(len(pair))
                    if here.any():
                        log[here] = probability(weights, own_n[context[here]], count[here], own_n[word[here]], total, types)
                    base = np.log10((n_own + 0.1) / (total + 0.1 * (types + 1)))
                    known = np.bincount(tokens.doc, weights=n_own[each] > 0, minlength=hi - lo).astype(np.int64)
                    score = np.bincount(tokens.doc, weights=base[each], minlength=hi - lo)
                    placed = np.bincount(doc, weights=np.repeat(log, n), minlength=hi - lo)
                    key = batch.column("_key").slice(lo, hi - lo)
                    rows = np.stack([key.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(key.is_valid()), fold[lo:hi] == 0, np.diff(tokens.first), known])
                    out.append((chunk % buckets, 0, rows.astype(np.int64).tobytes(), score.tobytes(), placed.tobytes(), b""))
                left = ~here
                firsts, n, held, trained, pair = firsts[left], n[left], held[left], trained[left], pair[left]
                bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
                by = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                bounds = np.searchsorted(bucket[by], np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(bounds))
                firsts, n, held, trained, pair = firsts[by], n[by], held[by], trained[by], pair[by]
                step = np.diff(pair, prepend=np.uint64(0))  # small numbers pack well
                step[bounds[some]] = pair[bounds[some]]
                if learn:
                    columns, ends = (step, (n - held).astype("<u4"), held.astype("<u4")), None
                else:
                    upto = np.append(0, np.cumsum(n))
                    at = np.repeat(firsts - upto[:-1], n) + np.arange(upto[-1])
                    columns, ends, docs = (step, n.astype("<u4"), trained.astype("<u4")), upto[bounds], doc[at].astype("<u4")
                for i in some.tolist():
                    parts = [x[bounds[i] : bounds[i + 1]].tobytes() for x in columns]
                    out.append((i, 1, *parts, b"" if learn else docs[ends[i] : ends[i + 1]].tobytes()))
                cells = list(zip(*out)) or [()] * 6
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
                a = [pa.array(x, t) for x, t in zip(cells, kinds)]
                yield pa.RecordBatch.from_arrays([a[0], pa.array([chunk] * len(out), pa.int64()), *a[1:]], names=["bucket", "chunk", "kind", "a", "b", "c", "d"])

    return run


def _unpacked(table: pa.Table):
    """(packet number of each pair, pairs, two counts, documents) of a bucket's packets."""
    pairs = [np.cumsum(np.frombuffer(x, np.uint64)) for x in table.column("a").to_pylist()]
    b, c, d = ([np.frombuffer(x, "<u4") for x in table.column(name).to_pylist()] for name in "bcd")
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(pairs)), [len(x) for x in pairs]), joined(pairs), joined(b).astype(np.int64), joined(c).astype(np.int64), d


def frequency(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the power of two."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def _seen(sent, hot: int) -> Callable:
    """The deleted fold's pairs as rows (context frequency, pair share, word share, tokens), and rows of pairs with ``hot`` tokens and more."""

    def run(table: pa.Table) -> pa.Table:
        look = Lookup(sent.value)
        is_pair = pa.compute.equal(table.column("kind"), 1)
        _, pair, count, held, _ = _unpacked(table.filter(is_pair))
        distinct, place = np.unique(pair, return_inverse=True)
        count = np.bincount(place, weights=count, minlength=len(distinct)).astype(np.int64)
        held = np.bincount(place, weights=held, minlength=len(distinct)).astype(np.int64)
        some, often = held > 0, count + held >= hot
        context, word = (distinct[some] >> np.uint64(32)).astype(np.int64), (distinct[some] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        alone = table.filter(pa.compute.equal(table.column("kind"), 2))
        its_context, its_word, its_held = (np.frombuffer(b"".join(alone.column(c).to_pylist()), np.int64) for c in "abc")
        cells = [look.counted[context], count[some], look.counted[word]], [its_context, np.zeros(len(its_held), np.int64), its_word]
        cells = np.concatenate([np.stack(x).astype(np.int64) for x in cells], axis=1)
        order = np.lexsort(cells)
        cells, tokens = cells[:, order], np.concatenate([held[some], its_held])[order]
        begin = np.flatnonzero(np.append(True, (cells[:, 1:] != cells[:, :-1]).any(axis=0))) if len(tokens) else order
        cells, n = cells[:, begin], np.add.reduceat(tokens, begin) if len(tokens) else tokens
        more = np.zeros(int(often.sum()), dtype=np.int64)
        columns = [np.concatenate([x.astype(np.int64), more]) for x in (*cells, n)]
        columns += [np.concatenate([np.full(len(n), -1), signed(distinct[often])]), np.concatenate([np.zeros(len(n), np.int64), (count + held)[often]])]
        return pa.table(dict(zip(("context", "pair", "word", "n", "hot", "hot_n"), columns)))

    return run


def _scored(sent, weights: np.ndarray) -> Callable:
    """Log probabilities of each packet's pairs, added up for the documents that the packet holds; packets of keys pass through."""

    def run(table: pa.Table) -> pa.Table:
        look = Lookup(sent.value)
        packets = table.filter(pa.compute.equal(table.column("kind"), 1))
        packet, pair, reach, count, docs = _unpacked(packets)
        distinct, place = np.unique(pair, return_inverse=True)
        count = np.bincount(place, weights=count, minlength=len(distinct))
        context, word = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        log = probability(weights, look.n[context], count, look.n[word], look.total, look.types)[place]
        bounds = np.searchsorted(packet, np.arange(len(docs) + 1))
        places, sums = [], []
        for i, doc in enumerate(docs):
            part = slice(bounds[i], bounds[i + 1])
            of, at = np.unique(doc, return_inverse=True)
            places.append(of.astype("<u4").tobytes())
            sums.append(np.bincount(at, weights=np.repeat(log[part], reach[part]), minlength=len(of)).tobytes())
        rest = table.filter(pa.compute.equal(table.column("kind"), 0))
        chunks = packets.column("chunk").to_pylist() + rest.column("chunk").to_pylist()
        kind = [1] * packets.num_rows + [0] * rest.num_rows
        none = [None] * packets.num_rows
        with_rest = lambda own, name: pa.array(own + rest.column(name).to_pylist(), pa.binary())
        return pa.table(
            {
                "chunk": pa.array(chunks, pa.int64()), "kind": pa.array(kind, pa.int32()),
                "rows": with_rest(places, "a"), "sums": with_rest(sums, "c"), "base": with_rest(none, "b"),
            }
        )

    return run


_OUT = "_key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _merged(total: int) -> Callable:
    """Rows of the documents of a chunk: their keys and counts, and the sums of all buckets."""

    def run(table: pa.Table) -> pa.Table:
        rows, parts = None, []
        for kind, cells, sums, of in zip(*(table.column(c).to_pylist() for c in ("kind", "rows", "sums", "base"))):
            if kind:
                parts.append((np.frombuffer(cells, "<u4"), np.frombuffer(sums)))
            else:
                rows, score, base = np.frombuffer(cells, np.int64).reshape(5, -1), np.frombuffer(sums).copy(), np.frombuffer(of)
        for places, sums in sorted(parts, key=lambda x: (len(x[0]), x[1].sum())):
            score[places] += sums
        key = pa.array(rows[0], mask=rows[1] == 0)
        columns = (key, rows[2].astype(bool), rows[3], rows[4], np.full(len(base), total), base, score)
        return pa.table(dict(zip((c.split(" ")[0] for c in _OUT.split(", ")), map(pa.array, columns))))

    return run


def probability(weights: np.ndarray, context, pair, word, total: int, size: int):
    """Log10 of the mixed shares: of the pair in its context, of the word in all tokens, and of one word in all and the unseen."""
    w = weights[frequency(context)]
    return np.log10(w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] / (size + 1))


def learnt_weights(seen: DataFrame, total: int, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of each context frequency by expectation-maximisation on rows (context, pair, word, n).

    A round is one aggregation to at most 32 rows.
    """
    shares = seen.select(
        F.when(F.col("context") > 0, 1 + F.floor(F.log2("context"))).otherwise(0).cast("int").alias("f"),
        (F.col("pair") / F.greatest("context", F.lit(1))).alias("p2"),
        (F.col("word") / F.lit(max(total, 1))).alias("p1"),
        "n",
    )
    weights = np.tile([0.4, 0.5, 0.1], (FREQUENCIES * 2, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for _ in range(rounds):
        at = lambda k: F.get(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("f"))  # noqa: B023, E731
        parts = shares.select("f", "n", (at(0) * F.col("p2")).alias("a"), (at(1) * F.col("p1")).alias("b"), (at(2) / F.lit(size + 1)).alias("c"))
        share = lambda x: F.sum(F.col("n") * F.col(x) / (F.col("a") + F.col("b") + F.col("c")))
        for r in parts.groupBy("f").agg(share("a"), share("b"), share("c")).collect():
            got = np.array(r[1:])
            # one token's worth of the even mixture keeps every weight above nothing
            weights[r[0]] = (got + [0.0 if r[0] == 0 else 0.3, 0.4, 0.3]) / (got.sum() + (0.7 if r[0] == 0 else 1.0))
    return weights


def _joined_pairs(rows: DataFrame, vocabulary: DataFrame, starts: tuple[int, int]):
    """Tokens with their counts and those of their context and pair, by shuffles: for vocabularies too large to send."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for lo, _, data, offsets in pieces(batch.column("_text")):
                tokens.read(data, offsets)
                context = np.append(START, tokens.word[:-1])
                context[tokens.first[:-1]] = START
                take = pa.array(lo + tokens.doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").take(take), batch.column("_fold").take(take), pa.array(signed(context)), pa.array(signed(tokens.word))],
                    names=["_row", "_fold", "context", "word"],
                )

    tokens = stored(rows.select("_row", "_fold", "_text").mapInArrow(exploded, "_row long, _fold int, context long, word long"))
    pairs = tokens.filter("_fold > 0").groupBy("context", "word").agg(F.count("*").alias("p"), F.count_if(F.col("_fold") == DELETED_FOLD).alias("p_held"))
    named = lambda c: vocabulary.select(F.col("word").alias(c), F.col("n").alias(f"{c}_n"), (F.col("n") - F.col("held")).alias(f"{c}_counted"))
    each = tokens.groupBy("_row", "_fold", "context", "word").agg(F.count("*").alias("k"))
    each = each.join(stored(pairs), ["context", "word"], "left").join(named("word"), "word", "left").join(named("context"), "context", "left")
    at_start = F.col("context") == int(START)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return stored(
        each.select(
            "_row", "_fold", "k", zero("p").alias("p"), (zero("p") - zero("p_held")).alias("p_counted"), zero("word_n").alias("word_n"),
            zero("word_counted").alias("word_counted"), F.when(at_start, starts[0]).otherwise(zero("context_n")).alias("context_n"),
            F.when(at_start, starts[1]).otherwise(zero("context_counted")).alias("context_counted"),
        )
    )


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", sent_words: int = SENT_WORDS) -> DataFrame:
    """Log10 probability of every text, by a model learnt from the texts that are not held out.

    Tokens are words, A-Z in lower case, and one end for each text. The fold of a text is the CRC-32
    of its key as text, modulo 10 (a null key's text is empty); fold 0 is held out. Deleted interpolation: a token's probability
    mixes its share among the tokens that follow its context, its share of all tokens, and an even
    share of one word among all seen and the unseen. The weights depend on the context's frequency, by powers of
    two, and are learnt by expectation-maximisation on the tokens of fold 9 under the counts
    of folds 1 to 8. Scores use the counts of all training folds.

    Distinct pairs of a few megabytes of text travel packed to the bucket of their hash, where their counts
    are added; a bucket sends back one sum for each document that a packet of it holds, and pairs of very many tokens are scored
    in place. Words of two texts and more and their counts are sent
    to all tasks while they are few enough (the driver then holds 16 bytes a word, and each worker a copy), else tokens are joined with the vocabulary by shuffles, to the
    same scores. A word that only one text has is counted there, and so are its pairs, which never travel.

    Returns key, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (single words with 0.1
    added to each count) and score, one row per input row. A null text is empty, which is one token. Without
    training texts all tokens are unseen. Repeated rows count each; other columns are not read.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    of = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(10)).cast("int")
    rows = docs.select(F.col(key).cast("long").alias("_key"), of.alias("_fold"), value.alias("_text"))
    spark = docs.sparkSession
    vocabulary = rows.select("_fold", "_text").mapInArrow(_counts, "word long, n long, held long, texts long")
    vocabulary = stored(vocabulary.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "held", "texts"))))
    size, total, held, sent_size = vocabulary.agg(F.count_if(F.col("n") > 0), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "held")), F.count_if(F.expr(SENT))).first()
    ends = vocabulary.filter(F.col("word") == int(END)).select("n", F.col("n") - F.col("held")).first() or (0, 0)

    if sent_size > sent_words:
        named = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
        tokens = _joined_pairs(named, vocabulary.filter("n > 0"), tuple(ends))
        seen = tokens.filter(F.col("_fold") == DELETED_FOLD).select(F.col("context_counted").alias("context"), F.col("p_counted").alias("pair"), F.col("word_counted").alias("word"), F.col("k").alias("n"))
        weights = learnt_weights(seen, total - held, size)

        @F.pandas_udf("double")
        def log(context: pd.Series, pair: pd.Series, word: pd.Series) -> pd.Series:
            return pd.Series(probability(weights, context.to_numpy(), pair.to_numpy(), word.to_numpy(), total, size))

        k, n = F.col("k"), F.col("word_n")
        sums = tokens.groupBy("_row").agg(
            F.sum("k").alias("n_tokens"), F.sum(F.when(n > 0, k).otherwise(0)).alias("n_known"),
            F.sum(k * F.log10((n + 0.1) / (total + 0.1 * (size + 1)))).alias("base_score"), F.sum(k * log("context_n", "p", "word_n")).alias("score"),
        )
        out = named.select("_row", "_key", (F.col("_fold") == 0).alias("held_out")).join(sums, "_row")
        out = out.withColumn("train_tokens", F.lit(total).cast("long"))
    else:
        known = _collected(vocabulary, sent_size, np.uint32 if total < 1 << 32 else np.int64, ends)
        sent = spark.sparkContext.broadcast({**known, "total": total, "types": size})
        buckets = int(total // BUCKET_TOKENS) + 1
        columns = rows.select("_key", "_fold", "_text")
        pairs = columns.mapInArrow(_packets(sent, buckets, True), _PACKET)
        found = "context long, pair long, word long, n long, hot long, hot_n long"
        seen = stored(pairs.groupBy("bucket").applyInArrow(_seen(sent, HOT_TOKENS), found))
        weights = learnt_weights(seen.filter("hot = -1"), total - held, size)
        known = seen.filter("hot <> -1").select("hot", "hot_n").toArrow().sort_by("hot")
        hot = known["hot"].to_numpy().astype(np.int64).view(np.uint64), known["hot_n"].to_numpy()
        packets = columns.mapInArrow(_packets(sent, buckets, False, hot, weights), _PACKET)
        sums = packets.groupBy("bucket").applyInArrow(_scored(sent, weights), "chunk long, kind int, rows binary, sums binary, base binary")
        out = stored(sums.groupBy("chunk").applyInArrow(_merged(total), _OUT))
        sent.destroy()  # the vocabulary is not needed any more, and workers would keep it
    return out.select(F.col("_key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
