"""Byte-level BPE: texts to token ids and back, by a vocabulary of ranks.

A text is cut into pieces by the vocabulary's pattern.  A piece that is a token as it stands is that
token; any other one begins as its single bytes.  A segment tree over the piece's byte positions has at
each live position the rank of what this position's part and its live neighbour's would join to, and in
every node the least rank below it, the leftmost among equal ones.  The root names the next merge; a
merge changes three leaves (the joined part, its left neighbour and the place that is no longer live)
and the nodes above them.  Ids are ranks, as in the published rank files.

Trees of many pieces of like length are worked at once, in numpy; a few long pieces, one by one.
Pieces met before are taken from a memory of bounded size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: No rank of a pair.
NONE = np.int64(1) << 62
#: Leaves of the trees that are worked at once; from this size on a piece is worked by itself.
LEAVES, LONG = 1 << 15, 1 << 11
#: Pieces, and bytes of one, that a task remembers.
KNOWN_PIECES, KNOWN_BYTES = 1 << 17, 64
#: Bytes of text that are encoded together.
TEXT_BYTES = 1 << 20
#: Bytes of a rank file that may be broadcast.
MOST_BYTES = 64 << 20

#: Code points that Unicode made letters or numbers after its version 16, hexadecimal; the
#: tokenizer's pattern takes them for other characters.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_LATER = regex.compile("[" + "".join("-".join(chr(int(x, 16)) for x in span.split("-")) for span in LATER.split()) + "]")
#: Texts whose UTF-8 has only smaller bytes hold none of them.
_LATER_BYTE = chr(int(LATER.split()[0], 16)).encode()[0]
#: Neither letter, number nor white space.
_OTHER = "•"


@dataclass
class Vocabulary:
    """tokens by id, ids by token, and every pair of tokens that joins to one: sorted keys
    left * 2^32 + right, and the ids they join to."""

    tokens: list[bytes]
    ids: dict[bytes, int]
    pairs: np.ndarray
    joined: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        """From ranks by token; a single byte without a rank raises ValueError."""
        if missing := [x for x in range(256) if bytes([x]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing[:8]}")
        tokens = [b""] * (max(ranks.values()) + 1)
        found = []
        for token, rank in ranks.items():
            tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        found.sort()
        pairs, joined = np.array(found, np.int64).reshape(-1, 2).T.copy()
        return cls(tokens, ranks, pairs, joined)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair joins to, or NONE; a side below 0 is no token."""
        key = (left << 32) | right
        if not len(self.pairs):
            return np.full(len(key), NONE)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.joined[at], NONE)


def load_vocabulary(path: str) -> Vocabulary:
    """A rank file's vocabulary, read where the driver runs: a line has a token in base64 and its rank.
    A file of more than MOST_BYTES raises ValueError: the vocabulary is broadcast."""
    if (size := os.path.getsize(path)) > MOST_BYTES:
        raise ValueError(f"a rank file of {size} bytes, {MOST_BYTES} at most")
    with open(path, "rb") as lines:
        return Vocabulary.of({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())})


def _one_tree(vocabulary: Vocabulary, piece: bytes, token: list[int], ranks: list[int]) -> list[int]:
    """The ids of one long piece, from its bytes' ids and the ranks of neighbours."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none, known, tokens = int(NONE), vocabulary.ids, vocabulary.tokens
    # a node is rank * size + position: the leftmost of equal ranks is the least
    tree = [none] * size + [none if r == none else r * size + k for k, r in enumerate(ranks)] + [none] * (size - n)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(at: int, value: int) -> None:
        k = at + size
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    def pair(at: int) -> int:
        if at < 0 or after[at] >= n:
            return none
        rank = known.get(tokens[token[at]] + tokens[token[after[at]]])
        return none if rank is None else rank * size + at

    while tree[1] != none:
        rank, at = divmod(tree[1], size)
        gone = after[at]
        token[at], after[at] = rank, after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    out, at = [], 0
    while at < n:
        out.append(token[at])
        at = after[at]
    return out


def _trees(vocabulary: Vocabulary, pieces: list[bytes], size: int) -> list[bytes]:
    """The packed ids of pieces of at most `size` bytes, a power of two: a row of each array is one piece."""
    n, width = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    inside = np.arange(size) < width[:, None]
    token = np.full((n, size + 1), -1, np.int64)  # the last column stands for no neighbour
    single = np.fromiter((vocabulary.ids[bytes([x])] for x in range(256)), np.int64, 256)
    token[:, :size][inside] = single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
    after[:, size] = size
    before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
    tree = np.full((n, 2 * size), NONE)
    rank = vocabulary.rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, size)
    tree[:, size:] = np.where(rank == NONE, NONE, rank * size + np.arange(size))
    half = size
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        rank, at = np.divmod(tree[live, 1], size)
        gone = after[live, at]
        right, left = after[live, gone], before[live, at]
        token[live, at], after[live, at] = rank, right
        token[live, gone] = -1
        before[live, right] = at
        tree[live, size + gone] = NONE
        joins = vocabulary.rank(rank, token[live, right])
        tree[live, size + at] = np.where(joins == NONE, NONE, joins * size + at)
        has = left >= 0
        joins = vocabulary.rank(token[live[has], left[has]], rank[has])
        tree[live[has], size + left[has]] = np.where(joins == NONE, NONE, joins * size + left[has])
        rows = np.concatenate([live, live, live[has]])
        node = np.concatenate([gone, at, left[has]]) + size
        for _ in range(size.bit_length() - 1):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        live = live[tree[live, 1] != NONE]
    kept = token[:, :size] >= 0
    packed = token[:, :size][kept].astype("<u4").tobytes()
    ends = (4 * np.cumsum(kept.sum(1))).tolist()
    return [packed[lo:hi] for lo, hi in zip([0, *ends], ends)]


def merged(vocabulary: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Each piece's ids, packed as little-endian 32-bit numbers."""
    out: list[bytes] = [b""] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        whole = vocabulary.ids.get(piece)
        if whole is not None:
            out[k] = whole.to_bytes(4, "little")
        elif piece:
            by_size.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(k)
    for size, held in by_size.items():
        if size >= LONG:
            for k in held:
                token = np.fromiter((vocabulary.ids[pieces[k][x : x + 1]] for x in range(len(pieces[k]))), np.int64, len(pieces[k]))
                ranks = vocabulary.rank(token[:-1], token[1:]).tolist() + [int(NONE)]
                out[k] = np.array(_one_tree(vocabulary, pieces[k], token.tolist(), ranks), "<u4").tobytes()
            continue
        step = max(1, LEAVES // size)
        for lo in range(0, len(held), step):
            some = held[lo : lo + step]
            for k, ids in zip(some, _trees(vocabulary, [pieces[k] for k in some], size)):
                out[k] = ids
    return out


def split_pieces(pattern: regex.Pattern, text: str) -> list[str]:
    """The text's pieces, in order."""
    if text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < _LATER_BYTE or not _LATER.search(text):
        return pattern.findall(text)
    return [text[m.start() : m.end()] for m in pattern.finditer(_LATER.sub(_OTHER, text))]


def _runs(texts: list[bytes | None]) -> Iterator[list[str]]:
    """Texts in runs of about TEXT_BYTES; a single longer one is a run."""
    held, size = [], 0
    for data in texts:
        data = data or b""
        if held and size + len(data) > TEXT_BYTES:
            yield held
            held, size = [], 0
        held.append(data.decode("utf-8", "replace"))
        size += len(data)
    if held:
        yield held


def _encoded(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cut = shared.value, regex.compile(pattern)
        known: dict[str, bytes] = {}
        for batch in batches:
            packed: list[bytes] = []
            for texts in _runs(batch.column("text").cast(pa.binary()).to_pylist()):
                split = [split_pieces(cut, text) for text in texts]
                fresh = [p for p in {p for pieces in split for p in pieces} if p not in known]
                known.update(zip(fresh, merged(vocabulary, [p.encode() for p in fresh])))
                packed += [b"".join(map(known.__getitem__, pieces)) for pieces in split]
                if len(known) > KNOWN_PIECES:
                    known = {}
                for p in fresh:
                    if len(p) > KNOWN_BYTES:
                        known.pop(p, None)
            counts = pa.array([len(x) // 4 for x in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), counts, pa.array(packed, pa.binary())], names=["id", "n_tokens", "ids"])

    return run


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids): each row's whole text as token ids, packed as little-endian unsigned
    32-bit numbers; `token_ids` makes an array of them.

    Each match of the pattern is encoded by itself; what no match covers is left out, and no special
    token is made.  Null and empty texts have no tokens; rows with a null or a repeated id are encoded
    like any other, one row each.  Bytes that are no UTF-8 are read as U+FFFD.  An empty table gives an
    empty result; other columns are ignored.  The rank file is read by
    the driver and its vocabulary broadcast, 64 MB at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(ranks_path))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_encoded(shared, pattern), f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of `encoded` with a column `decoded`: the bytes that the packed ids in its column `ids`
    stand for.  Null ids give no bytes; an id that the vocabulary lacks raises IndexError."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(ranks_path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return encoded.drop("decoded").mapInArrow(_decoded(shared), f"{schema}, decoded binary")


def token_ids(packed: pa.BinaryArray) -> pa.ListArray:
    """Packed ids of an Arrow column as lists of integers, for Pandas and Arrow functions."""
    lists = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in packed.to_pylist()]
    return pa.array(lists, pa.list_(pa.int64()))
