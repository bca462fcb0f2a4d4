"""Byte-level BPE by the last token of every prefix: encoding, decoding, and encoding again after an edit."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Answers kept by a worker: token ids of matches (twice so many) and pairs of tokens. Full tables are emptied, so memory is bounded.
KNOWN_MATCHES, KNOWN_PAIRS = 3 << 17, 1 << 20
#: First bytes of a match whose last tokens are kept.
HEAD = 6
#: Matches of longer texts are taken one by one instead of as a list.
LISTED = 1 << 22
#: A match may depend on so many characters behind it: an apostrophe and its two letters.
AHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: on each line a token's bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixTokens:
    """The last tokens of all prefixes of a byte string.

    Merging by rank works alike inside any part that no merge crosses, so a sequence of tokens is the
    encoding of its bytes just when each two neighbours are the encoding of theirs. Of the tokens that end a prefix, exactly one
    may therefore follow the last token of the prefix before it. Adding bytes at the end
    changes no earlier prefix, and walking back from the end reads off the encoding.
    """

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.longest = max(self.lengths.values())
        self.size = max(self.tokens) + 1
        self.pairs: dict[int, bool] = {}
        self.reached = {bytes([b]): ranks[bytes([b])] for b in range(256)}  # tokens that merging their bytes gives
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for token in ranks:
            if len(token) > 1 and len(parts := self.merged(token, ranks[token])) == 2 and max(map(self.made_at, parts)) < ranks[token]:
                self.reached[token] = ranks[token]
                self.parts[token] = tuple(parts)
        self.endings = {token[i:] for token in self.reached for i in range(len(token))}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}

    def merged(self, data: bytes, before: int | None = None) -> list[bytes]:
        """Merging by rank, step by step, up to a rank if one is given; only for strings of two tokens' length."""
        stop = self.size if before is None else before
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank = [self.ranks.get(a + b, self.size) for a, b in zip(parts, parts[1:])]
            least = min(rank)
            if least >= stop:
                break
            at = rank.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def made_at(self, token: bytes) -> int:
        """When merging makes a token: at its rank; single bytes are there from the start."""
        return self.ranks[token] if len(token) > 1 else -1

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """(part, when it is made, when it goes into the next) of the parts that ever touch an end of the token: 0 its first byte, 1 its last."""
        found = self.edges.get((token, side))
        if found is None:
            found, part, until = [], token, self.size
            while True:
                found.append((part, self.made_at(part), until))
                if len(part) == 1:
                    break
                until = self.ranks[part]
                part = self.parts[part][side]
            self.edges[token, side] = found
        return found

    def follows(self, left: int, right: int) -> bool:
        """May one token stand behind the other? Only if no two parts that touch at some time merge then.

        Of two merges of one rank the one further left comes first: that within the left token before one across,
        and one across before that within the right token.
        """
        pair = left * self.size + right
        known = self.pairs.get(pair)
        if known is None:
            known = True
            for a, made_a, until_a in self.edge(self.tokens[left], 1):
                for b, made_b, until_b in self.edge(self.tokens[right], 0):
                    at = self.ranks.get(a + b)
                    if at is not None:
                        at = max(at, made_a, made_b)
                        if at < until_a and at <= until_b:
                            known = False
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            self.pairs[pair] = known
        return known

    def last(self, data: bytes, before: list[int], end: int) -> int:
        """The last token of the prefix of ``end`` bytes; ``before`` are those of all shorter ones."""
        size, token_of, pairs = self.size, self.reached.get, self.pairs.get
        start = end - 1
        while start > 0:
            part = data[start:end]
            token = token_of(part)
            if token is not None:
                left = before[start - 1]
                fits = pairs(left * size + token)
                if fits or (fits is None and self.follows(left, token)):
                    return token
            elif part not in self.endings:
                break
            start -= 1
        token = token_of(data[:end]) if start == 0 else None
        if token is None:
            raise ValueError(f"no token ends {data[max(0, end - self.longest) : end]!r}")
        return token

    def extended(self, data: bytes, known: list[int]) -> list[int]:
        """Last tokens of all prefixes of ``data``, given those of its first ``len(known)`` bytes."""
        out = list(known)
        for end in range(len(out) + 1, len(data) + 1):
            out.append(self.last(data, out, end))
        return out

    def read_off(self, last: list[int]) -> list[int]:
        """The tokens of the whole string, from the last ones of its prefixes."""
        ids, end, length = [], len(last), self.lengths
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= length[token]
        return ids[::-1]

    def whole(self, data: bytes, last: list[int]) -> list[int]:
        """Token ids of a match: itself if it is a token, as the merging library has it too."""
        token = self.ranks.get(data)
        return self.read_off(last) if token is None else [token]


class Encoder:
    """Texts to token ids, each match of the pattern by itself."""

    def __init__(self, path: str, pattern: str):
        import regex

        # White space as the Unicode property: some engines count four control characters more.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.table = PrefixTokens(read_ranks(path))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[bytes, list[int]] = {}

    def last_tokens(self, data: bytes) -> list[int]:
        """Last tokens of all prefixes of a match; many begin alike, so those of the first bytes are kept."""
        head = data[:HEAD]
        last = self.heads.get(head)
        if last is None:
            if len(self.heads) >= KNOWN_MATCHES:
                self.heads.clear()
            last = self.heads[head] = self.table.extended(head, [])
        return self.table.extended(data, last) if len(data) > HEAD else last

    def ids_of(self, match: str) -> bytes:
        """Token ids of a match as 32-bit numbers."""
        ids = self.known.get(match)
        if ids is None:
            ids = self.older.get(match)
            if ids is None:
                data = match.encode()
                ids = np.array(self.table.whole(data, [] if data in self.table.ranks else self.last_tokens(data)), dtype="<i4").tobytes()
            if len(self.known) >= KNOWN_MATCHES:
                self.known, self.older = {}, self.known
            if len(match) < 256:
                self.known[match] = ids
        return ids

    def matches(self, text: str, start: int = 0) -> Iterator[tuple[int, str]]:
        """(place, match) of the text from a place on; the pattern must leave nothing out."""
        at = start
        for m in self.pattern.finditer(text, start):
            if m.start() != at or m.end() == at:
                raise ValueError("the pattern leaves characters out")
            yield at, m.group()
            at = m.end()
        if at != len(text):
            raise ValueError("the pattern leaves characters out")

    def encode(self, text: str) -> np.ndarray:
        found = self.pattern.findall(text) if len(text) <= LISTED else (m.group() for m in self.pattern.finditer(text))
        known, ids_of = self.known.get, self.ids_of
        return np.frombuffer(b"".join([known(m) or ids_of(m) for m in found]), dtype="<i4")

    def prefixes(self, text: str) -> np.ndarray:
        """For each byte the last token of its match up to there; the first byte of a match holds it as -1 - token."""
        return np.concatenate([np.zeros(0, np.int32), *(self._marked(self.table.extended(m.encode(), [])) for _, m in self.matches(text))])

    @staticmethod
    def _marked(last: list[int]) -> np.ndarray:
        out = np.array(last, dtype=np.int32)
        out[0] = -1 - out[0]
        return out

    def ids(self, data: bytes, stored: np.ndarray) -> list[int]:
        """Token ids from stored prefixes."""
        starts = np.append(np.flatnonzero(stored < 0), len(stored))
        last = np.where(stored < 0, -1 - stored, stored).tolist()
        return list(chain.from_iterable(self.table.whole(data[a:b], last[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())))

    def edited(self, text: str, stored: np.ndarray, start: int, end: int, new: str) -> tuple[str, np.ndarray, int]:
        """(text, prefixes, bytes worked on) after the characters from start to before end are replaced.

        Matches that end well before the edit stay. From there on, the text is matched again until a match starts behind the edit
        where one started before: all later ones are the same. Of a match that starts where an old one did, the common bytes keep
        their tokens; inside a long one, work ends as soon as the last tokens agree over the length of the
        longest token, since later ones follow from those.
        """
        start, end = max(0, min(start, len(text))), max(0, min(end, len(text)))
        end = max(start, end)
        out_text = text[:start] + new + text[end:]
        old = text.encode()
        first_bytes = np.flatnonzero((np.frombuffer(old, np.uint8) & 0xC0) != 0x80)  # place of every character
        at_byte = lambda i: int(first_bytes[i]) if i < len(first_bytes) else len(old)
        begins = np.searchsorted(first_bytes, np.flatnonzero(stored < 0))  # characters where old matches begin
        ends = np.append(begins[1:], len(text))
        keep = int(np.searchsorted(ends, start - AHEAD, side="right"))
        resume = int(ends[keep - 1]) if keep else 0
        old_begins = set(begins[keep:].tolist())
        shift, behind = len(new) - (end - start), start + len(new)
        parts, worked = [stored[: at_byte(resume)]], 0
        for at, match in self.matches(out_text, resume):
            before = at - shift
            if at >= behind and before in old_begins:
                parts.append(stored[at_byte(before) :])
                break
            data, known, tail = match.encode(), [], None
            if at in old_begins and at <= start:
                lo = at_byte(at)
                hi = at_byte(int(ends[np.searchsorted(begins, at)]))
                was = np.where(stored[lo:hi] < 0, -1 - stored[lo:hi], stored[lo:hi]).tolist()
                same = _common(data, old[lo:hi])
                known, tail = was[:same], (old[lo:hi], was)
            last, fresh = self._rejoined(data, known, tail)
            worked += fresh
            parts.append(self._marked(last))
        return out_text, np.concatenate(parts), worked

    def _rejoined(self, data: bytes, known: list[int], tail: tuple[bytes, list[int]] | None) -> tuple[list[int], int]:
        """Last tokens of a match that shares its first bytes, and maybe its last ones, with an old match; and how many are new."""
        out, longest = list(known), self.table.longest
        gone = len(tail[0]) - len(data) if tail else 0
        joined = len(data) - _common(data[::-1], tail[0][::-1]) if tail else len(data)
        agree = 0
        for end in range(len(out) + 1, len(data) + 1):
            out.append(self.table.last(data, out, end))
            place = end - 1 + gone
            agree = agree + 1 if end > joined and place >= len(known) and tail and out[-1] == tail[1][place] else 0
            if agree >= longest:
                return out + tail[1][place + 1 :], end - len(known)
        return out, len(data) - len(known)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else []
    return int(differ[0]) if len(differ) else n


def _sent(df: DataFrame, path: str, pattern: str) -> Broadcast[Encoder]:
    """The vocabulary's tables, as large as the vocabulary; a worker keeps them, and what it has learnt, from task to task."""
    return df.sparkSession.sparkContext.broadcast(Encoder(path, pattern))


def _encoded(sent: Broadcast[Encoder], prefixes: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = [text or "" for text in batch.column("_text").slice(lo, 256).to_pylist()]
                columns = [batch.column("_key").slice(lo, 256)]
                if prefixes:
                    last = [made.prefixes(text) for text in texts]
                    columns.append(_lists([made.ids(text.encode(), p) for text, p in zip(texts, last)]))
                    columns.append(_lists(last))
                else:
                    columns.append(_lists([made.encode(text) for text in texts]))
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "ids", "prefixes"][: len(columns)])

    return run


def _lists(rows: list) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *(np.asarray(r, dtype=np.int32) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", prefixes: bool = False) -> DataFrame:
    """Token ids of whole texts: (key, ids) and, if asked for, the last tokens of all prefixes for ``edit``.

    ``vocabulary`` is the path of a file of ranks that the driver and every executor has; ``pattern`` cuts the texts, and each match is encoded by itself. A
    null or empty text has no ids. Repeated rows are encoded each; an empty table gives no rows; strings of
    special tokens are ordinary text; other columns are not read. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {kind}, ids array<int>" + (", prefixes array<int>" if prefixes else "")
    return rows.mapInArrow(_encoded(_sent(docs, vocabulary, pattern), prefixes), schema).withColumnRenamed("_key", key)


def _decoded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data = []
                for ids in part.column("ids"):
                    if not ids.is_valid:
                        data.append(None)
                        continue
                    try:
                        data.append(b"".join(map(tokens.__getitem__, ids.values.to_numpy(zero_copy_only=False).tolist())))
                    except KeyError as unknown:
                        raise ValueError(f"the vocabulary has no token {unknown}") from None
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=["_key", "ids", "data"])

    return run


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """The bytes of token ids: (key, ids, data). Null ids have null bytes; an id beyond the vocabulary is refused."""
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("_key"), "ids")
    return rows.mapInArrow(_decoded(vocabulary), f"_key {kind}, ids array<int>, data binary").withColumnRenamed("_key", key)


def _edited(sent: Broadcast[Encoder]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("text", "prefixes", "start", "end", "new")))
            lo = 0
            while part := list(islice(rows, 256)):
                texts, ids, last, work = [], [], [], []
                for text, stored, start, end, new in part:
                    text, stored = text.as_py() or "", np.array(stored.as_py() or [], dtype=np.int32)
                    at = len(text) if start.as_py() is None else start.as_py()
                    until = at if end.as_py() is None else end.as_py()
                    text, stored, n = made.edited(text, stored, at, until, new.as_py() or "")
                    texts.append(text)
                    ids.append(made.ids(text.encode(), stored))
                    last.append(stored)
                    work.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").slice(lo, len(part)), pa.array(texts, pa.string()), _lists(ids), _lists(last), pa.array(work, pa.int64())],
                    names=["_key", "text", "ids", "prefixes", "bytes_worked"],
                )
                lo += len(part)

    return run


def edit(edits: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Encodings after an edit, from the stored prefixes: exactly those of the new text, by work near the edit only.

    ``edits`` holds key, text, prefixes (from ``encode``), start, end (characters; a null start appends, a null end
    inserts) and new (null: nothing). Returns key, text, ids, prefixes and bytes_worked, one row per input row. Places outside the text are moved to
    its ends. The pattern must match every character and look no more than three characters ahead, as the public ones do.
    """
    kind = edits.schema[key].dataType.simpleString()
    rows = edits.select(F.col(key).alias("_key"), "text", "prefixes", F.col("start").cast("long"), F.col("end").cast("long"), "new")
    schema = f"_key {kind}, text string, ids array<int>, prefixes array<int>, bytes_worked long"
    return rows.mapInArrow(_edited(_sent(edits, vocabulary, pattern)), schema).withColumnRenamed("_key", key)
