"""Byte-level BPE encoding and decoding.

Method: the distinct words of the corpus that are frequent (a dictionary bounded by ``max_dictionary``) are folded, inside
Spark higher-order functions, by ranked merges over arrays of their bytes; the ranks are a literal map in the plan.  Words
outside the dictionary go through the same merges in the task that has them, as the fold costs five times as much there
(figures in the README).  Decoding concatenates the binary pieces of the ids.

Defined results: a null or empty text gives no ids and decodes to nothing; repeated rows give repeated results; columns
other than the id and the text are ignored; an empty table gives an empty table; a text of one very long word costs time with the square of that word's length,
as its merges do, and nothing is cut.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialize, remembered

BUCKETS = 16384
NONE = 2147483647
#: Stands before a word that no merge changes any more; below the characters of ids.
DONE = "!"


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def char_of(rank: int) -> str:
    """The character that stands for an id while its word is folded: one after another, without the surrogates."""
    code = rank + 0x100
    return chr(code if code < 0xD800 else code + 0x800)


def id_of(c: Column) -> Column:
    code = F.ascii(c)
    return F.when(code < 0xD800, code - 0x100).otherwise(code - 0x900)


@lru_cache(maxsize=4)
def rank_map(path: str) -> tuple[str, str, str]:
    """The rank map as JSON, and the characters of the 256 bytes and of their ids.

    The map has an entry for each two pieces of the vocabulary that join to a third: the key is their two characters, the
    value the character of the third and then the key.  As characters sort by rank, the least value is the merge to do.
    The entries are dealt to small maps by the hash of the key, as a look-up in a Spark map scans its keys.

    A file where some piece isn't the result of its own merges is refused: the order of merges would then matter."""
    ranks = load_ranks(path)
    char = {piece: char_of(i) for piece, i in ranks.items()}
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    made: set[bytes] = {p for p in ranks if len(p) == 1}
    if len(made) < 256:
        raise ValueError("the rank file lacks single bytes")
    for piece in sorted(ranks, key=ranks.get):
        parts = list(map(bytes, zip(piece)))
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                raise ValueError(f"piece {piece!r} isn't made by its merges")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        for k in range(1, len(piece)):
            if piece[:k] in char and piece[k:] in char:
                key = char[piece[:k]] + char[piece[k:]]
                buckets[xxhash.xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = char[piece] + key
    every = [bytes([b]) for b in range(256)]
    return json.dumps(buckets), "".join(b.decode("latin-1") for b in every), "".join(char[b] for b in every)


def fold_merges(word: Column, ranks_path: str) -> Column:
    """Ids of one word: its bytes, one character each, are folded by the merges of the lowest rank until none is left.

    A step merges all places of one pair from left to right, which is what merging them one after another gives, as no
    merge makes room for one of a lower rank."""
    text, bytes_in, bytes_out = rank_map(ranks_path)
    ranks = F.from_json(F.lit(text), "array<map<string,string>>")

    def look(pair: Column) -> Column:
        return F.element_at(F.get(ranks, F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), pair)

    start = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), bytes_in, bytes_out)

    def step(s: Column, _: Column) -> Column:
        # the word while it still changes, then the word behind a mark
        places = F.sequence(F.lit(1), F.length(s) - 1)
        found = F.filter(F.transform(places, lambda i: look(F.substring(s, i, F.lit(2)))), lambda x: x.isNotNull())

        def merged(all_: Column) -> Column:
            low = F.substring(F.array_min(all_), 1, 1)
            return F.transform(F.slice(F.filter(all_, lambda x: F.startswith(x, low)), 1, 1), lambda x: F.replace(s, F.substring(x, 2, 2), F.substring(x, 1, 1)))

        done = F.startswith(s, F.lit(DONE))
        out = F.get(F.flatten(F.transform(F.array(found), merged)), F.lit(0))
        return F.when(done, s).when(F.length(s) < 2, F.concat(F.lit(DONE), s)).otherwise(F.coalesce(out, F.concat(F.lit(DONE), s)))

    steps = F.when(F.length(start) > 1, F.sequence(F.lit(1), F.length(start))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.split(F.ltrim(F.aggregate(steps, start, step), F.lit(DONE)), ""), id_of)


def encode_words(words: DataFrame, ranks_path: str, word_col: str = "word") -> DataFrame:
    """Adds ``ids`` (array<int>) to a table of distinct, non-empty words."""
    return words.withColumn("ids", fold_merges(F.col(word_col), ranks_path))


#: Fixed value: the pattern for which a space or line end between two other characters always starts a match of its own.
#: Texts are cut there for this pattern; they go whole through any other one.
CUT_AT_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def units(text: str, pattern: str = CUT_AT_SPACES) -> list[str] | None:
    """Parts that the pattern splits as it splits the text, or None if there is white space other than single spaces and
    line ends between words.  A space or line end between two other characters always starts a match of its own.  The
    first part stands as it is; the others have a line end or, left out, a space before them."""
    if pattern != CUT_AT_SPACES or len(text.split()) != text.count(" ") + text.count("\n") + 1:
        return None
    return text.replace("\n", " \n").split(" ")


def unit_text(unit: str) -> str:
    return unit if unit[:1] == "\n" else " " + unit


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one word of a document that isn't in the dictionary."""
    parts = [word[i : i + 1] for i in range(len(word))]
    near = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while near and (low := min(near)) != NONE:
        i = near.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del near[i]
        if i:
            near[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        if i < len(near):
            near[i] = ranks.get(parts[i] + parts[i + 1], NONE)
    return [ranks[p] for p in parts]


def word_counts(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """Distinct matches of the pattern with their counts; summed before the shuffle, so that no word is hot."""

    def count(cols):
        find, seen, out = _pattern(pattern).findall, Counter(), Counter()
        for text in cols[text_col]:
            if parts := units(text or "", pattern):
                out.update(find(parts[0]))
                seen.update(parts[1:])
            elif text:
                out.update(find(text))
        for unit, n in seen.items():
            for w in find(unit_text(unit)):
                out[w] += n
        return {"word": list(out), "n": list(out.values())}

    return arrow_map(docs.select(text_col), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, pattern: str, limit: int, text_col: str = "text") -> DataFrame:
    """At most ``limit`` distinct words: all that occur at least as often as the least count that keeps within it."""
    counts = materialize(word_counts(docs, pattern, text_col).where("n > 1"))
    tally = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    least, total = None, 0
    for r in tally.toLocalIterator():  # a row for each distinct count down to the limit
        total += r["words"]
        if total > limit:
            break
        least = r["n"]
    return counts.where(F.col("n") >= least if least else F.lit(False)).select("word")


@lru_cache(maxsize=4)
def _pattern(p: str):
    import regex

    return regex.compile(p)


#: Each Python worker remembers the ids of so many parts of texts; then it starts anew.
REMEMBERED = 600_000


class Encoder(dict):
    """Ids, as bytes of little-endian 32-bit integers, of parts of texts; what it hasn't seen, it makes."""

    def __init__(self, pattern: str, words: dict[str, bytes], ranks: dict[bytes, int], limit: int = REMEMBERED):
        self.limit, self.pattern, self.find, self.words, self.ranks = limit, pattern, _pattern(pattern).findall, words, ranks

    def pieces(self, text: str) -> bytes:
        words, ranks = self.words, self.ranks
        return b"".join(words[w] if w in words else np.array(merge_bytes(w.encode(), ranks), "<i4").tobytes() for w in self.find(text))

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        x = self[unit] = self.pieces(unit_text(unit))
        return x

    def encode(self, text: str | None) -> np.ndarray:
        parts = units(text or "", self.pattern)
        if parts is None:
            return np.frombuffer(self.pieces(text or ""), "<i4")
        return np.frombuffer(self.pieces(parts[0]) + b"".join(map(self.__getitem__, parts[1:])), "<i4")


class Decoder:
    """Bytes and decimal names of ids, by look-up in flat tables."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces] or [0], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces) or b"\0", np.uint8)
        width = len(str(len(pieces))) + 1
        self.names = np.frombuffer(b"".join(f"{i},".encode().ljust(width, b"\0") for i in range(max(1, len(pieces)))), np.uint8).reshape(-1, width)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.flat[at + np.arange(len(at))].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        named = self.names[ids].reshape(-1)
        return named[named != 0].tobytes()[:-1]


def coder(docs: DataFrame, ranks_path: str, pattern: str, text_col: str, max_dictionary: int, limit: int = REMEMBERED):
    """A function for tasks that gives the worker's :class:`Encoder` and :class:`Decoder`.

    The driver holds the ranks and the dictionary of frequent words; both are bounded by the vocabulary and by
    ``max_dictionary``, whatever the size of the corpus."""
    sc = docs.sparkSession.sparkContext
    frequent = encode_words(frequent_words(docs, pattern, max_dictionary, text_col), ranks_path).toArrow()
    known = dict(zip(frequent["word"].to_pylist(), [np.array(x, "<i4").tobytes() for x in frequent["ids"].to_pylist()], strict=True))
    shared = sc.broadcast((known, load_ranks(ranks_path), pieces_of(ranks_path)))
    key = uuid.uuid4().hex

    def get() -> tuple[Encoder, Decoder]:
        if key not in _made:
            _made.clear()
            known, ranks, pieces = shared.value
            _made[key] = Encoder(pattern, known, ranks, limit), Decoder(pieces)
        return _made[key]

    return get


_made: dict[str, tuple[Encoder, Decoder]] = {}
remembered.append(_made)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_dictionary: int = 200_000) -> DataFrame:
    """``(id_col, ids array<int>)`` for each row: every match of ``pattern`` is encoded by itself, without special tokens."""
    get = coder(docs, ranks_path, pattern, text_col, max_dictionary)

    def run(cols):
        encoder, _ = get()
        return {id_col: cols[id_col], "ids": [encoder.encode(t) for t in cols[text_col]]}

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def pieces_of(ranks_path: str) -> list[bytes]:
    """The piece of each id; an id that the file leaves out has an empty one."""
    ranks = load_ranks(ranks_path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return out


def decode(coded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded`` (binary), the pieces of ``ids`` put together, to a table of ids."""
    shared = coded.sparkSession.sparkContext.broadcast(pieces_of(ranks_path))

    def run(cols):
        decoder = Decoder(shared.value)
        return {id_col: cols[id_col], "ids": cols["ids"], "decoded": [decoder.decode(x) for x in cols["ids"]]}

    return arrow_map(coded.select(id_col, "ids"), run, f"`{id_col}` {dict(coded.dtypes)[id_col]}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_dictionary: int = 200_000, limit: int = REMEMBERED) -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)``: each text encoded and its ids decoded in one pass, which spares
    sending the ids between processes.  A worker remembers ``limit`` parts of texts; fewer cost time, not results."""
    get = coder(docs, ranks_path, pattern, text_col, max_dictionary, limit)

    def run(cols):
        encoder, decoder = get()
        ids = [encoder.encode(t) for t in cols[text_col]]
        return {
            id_col: cols[id_col],
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(decoder.decimal(x)).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids],
        }

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
