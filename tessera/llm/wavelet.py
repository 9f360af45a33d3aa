"""Token ids as wavelet matrices.

Method: documents are dealt out by ranges of their ids, in order, and each task cuts its documents into shards.  A shard
is one compressed value, a file of its own: for each bit of the ids, from the highest, a plane of bits in the order that
the planes before leave, in chunks that are compressed one by one, with the ones before each for rank and select.  To give
a token, count tokens or find an occurrence, only a chunk or two of each plane are unpacked; reading it all goes from the
last plane to the first.

The shards are kept as rows of a Parquet table, so that any store that Spark reads can hold them.

Defined results: a null or empty text has only the end id; rows that repeat an id are ordered by their texts; null ids
come first; an empty table gives no shards; a text of any length is one document of one shard, which it fills alone if it
has more ids than a shard; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, make_room, remembered

MAGIC = b"TSWM0002"
#: Bytes of a plane that are compressed together.
CHUNK = 8192
#: Ids in a shard; a document that is longer has a shard of its own.
SHARD = 1 << 20
#: Each Python worker remembers the ids of so many words, and as many older ones.
REMEMBERED = 600_000
#: Bytes of text that a worker splits at a time; a longer text is split by itself.
BATCH = 12 << 20


class WaveletMatrix:
    """Access, rank, select and counting over one shard.

    A plane is kept in chunks; each is unpacked when it is first needed, and ones are counted from its beginning."""

    def __init__(self, size: int, width: int, zeros: list[int], before: np.ndarray, chunks: dict[tuple[int, int], np.ndarray], packed=None):
        self.size, self.width, self.zeros, self.before = size, width, zeros, before
        self._chunks, self._packed = chunks, packed

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids, np.uint32)
        width = max(1, int(ids.max(initial=0)).bit_length())
        seq = ids.astype(np.uint16) if width <= 16 else ids
        n_chunks = -(-len(ids) // (8 * CHUNK))
        before, zeros, chunks = np.zeros((width, n_chunks + 1), np.uint64), [], {}
        for level in range(width):
            ones = (seq & seq.dtype.type(1 << (width - 1 - level))) != 0
            plane = np.packbits(ones, bitorder="little")
            for k in range(n_chunks):
                chunks[level, k] = plane[k * CHUNK : (k + 1) * CHUNK]
                before[level, k + 1] = before[level, k] + np.bitwise_count(chunks[level, k]).sum(dtype=np.uint64)
            zeros.append(len(ids) - int(before[level, -1]))
            # index lists are several times faster than masks here
            seq = np.concatenate([seq.take(np.flatnonzero(~ones)), seq.take(np.flatnonzero(ones))])
        return cls(len(ids), width, zeros, before, chunks)

    def to_bytes(self) -> bytes:
        """Sizes, ones before each chunk, lengths of the chunks and the chunks, each compressed by itself."""
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = [pack(self._chunk(level, k)) for level in range(self.width) for k in range(self.before.shape[1] - 1)]
        head = struct.pack("<QIQ", self.size, self.width, self.before.shape[1] - 1)
        return b"".join([MAGIC, head, self.before.astype("<u8").tobytes(), np.array([len(x) for x in packed], "<u4").tobytes(), *packed])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size, width, n_chunks = struct.unpack_from("<QIQ", raw, 8)
        at = 28 + 8 * width * (n_chunks + 1)
        before = np.frombuffer(raw, "<u8", width * (n_chunks + 1), 28).reshape(width, n_chunks + 1)
        ends = at + 4 * width * n_chunks + np.cumsum(np.frombuffer(raw, "<u4", width * n_chunks, at), dtype=np.int64)
        starts = np.concatenate([[at + 4 * width * n_chunks], ends[:-1]])
        return cls(size, width, [size - int(x) for x in before[:, -1]], before, {}, (raw, starts.tolist(), ends.tolist()))

    def _chunk(self, level: int, k: int) -> np.ndarray:
        found = self._chunks.get((level, k))
        if found is None:
            raw, starts, ends = self._packed
            i = level * (self.before.shape[1] - 1) + k
            found = self._chunks[level, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[starts[i] : ends[i]]), np.uint8)
        return found

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, 8 * CHUNK)
        count = int(self.before[level, k])
        if rest:
            chunk = self._chunk(level, k)
            count += int(np.bitwise_count(chunk[: rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                count += (int(chunk[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of the given value."""
        r = self.before[level].astype(np.int64)
        if not bit:
            r = np.minimum(np.arange(len(r), dtype=np.int64) * 8 * CHUNK, self.size) - r
        c = int(np.searchsorted(r, k, "right")) - 1
        bits = np.unpackbits(self._chunk(level, c), bitorder="little")[: self.size - c * 8 * CHUNK]
        return c * 8 * CHUNK + int(np.flatnonzero(bits == bit)[k - int(r[c])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        out = 0
        for level in range(self.width):
            ones = self._rank1(level, i)
            bit = self._rank1(level, i + 1) - ones
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        if symbol < 0 or symbol >> self.width:
            return 0, 0
        for level in range(self.width):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.width - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in a range of places."""
        a, b = self._range(symbol, start, self.size if end is None else end)
        return b - a

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(symbol, 0, self.size)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.width - 1, -1, -1):
            bit = symbol >> (self.width - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def to_array(self) -> np.ndarray:
        """All ids, from the last plane to the first."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        out = np.zeros(self.size, kind)
        for level in range(self.width - 1, -1, -1):
            plane = np.concatenate([self._chunk(level, k) for k in range(self.before.shape[1] - 1)] or [np.zeros(0, np.uint8)])
            ones = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            out[self.zeros[level] :] |= kind(1 << (self.width - 1 - level))
            up = np.empty_like(out)
            up[np.flatnonzero(~ones)] = out[: self.zeros[level]]
            up[np.flatnonzero(ones)] = out[self.zeros[level] :]
            out = up
        return out.astype(np.uint32)


#: Where one of these stands, lower case may change what composes.
UNEVEN = re.compile("[\u0130\u03a3\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]")


#: Marks that part from the letters before them; not the apostrophe, which begins endings.
MARKS = ".,;:!?*$%&#|<>()[]\"/+=-"
#: Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}


def bytes_of(texts: pa.Array) -> bytes:
    """The bytes of all texts on end."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    return data[int(at[texts.offset]) : int(at[texts.offset + len(texts)])].to_pybytes() if data and len(texts) else b""


class Tokenizer:
    """Ids of texts.  A batch's words between ASCII white space are numbered by Arrow; each different one is looked up, or
    encoded when it is first seen, and the ids of all words are then put together at once.

    White space only parts words for this kind of tokenizer, it drops case, and it parts marks from the letters before
    them; a text with the string of an added token goes through whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.tokenize = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f).get("added_tokens", ())]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        data = bytes_of(texts)
        for token in self.added:
            if token.encode() in data:
                whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        # texts that go through whole have no words here
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(~whole), texts, "") if whole.any() else texts)
        coded = lists.flatten().dictionary_encode()
        pieces = pa.array(self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        # copies each word's bytes to its places
        put = pieces.take(coded.indices)
        _, offsets, data = put.buffers()
        ends = np.frombuffer(offsets, np.int64, len(put) + 1) // 4 if len(put) else np.zeros(1, np.int64)
        ids = np.frombuffer(data, "<u4", int(ends[-1])) if ends[-1] else np.zeros(0, "<u4")
        cuts = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])]
        out = [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(whole):
            out[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, words))
        for i, x in enumerate(out):
            if x is None:
                out[i] = self._word(words[i])
        return out

    def _word(self, w: str) -> bytes:
        x = self.young.get(w)
        if x is None:
            x = self.young[w] = self.old.get(w) or self._made(w)
        return x

    def _made(self, w: str) -> bytes:
        if w.isalpha():
            # letters alone, in lower case and composed, are one word to the model: no need to normalise and split
            if w.isascii():
                return array("I", [t.id for t in self.tokenize(w.lower())]).tobytes()
            if not UNEVEN.search(w) and unicodedata.is_normalized("NFC", w):
                return array("I", [t.id for t in self.tokenize(w.lower().encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
        else:
            base = w.rstrip(MARKS)
            # not where lower-casing or composing leaves a mark at the base's end, which joins the marks that follow
            if base and len(base) < len(w) and base.isalpha() and not UNEVEN.search(base) and unicodedata.is_normalized("NFC", base):
                return self._word(base) + self._word(w[len(base) :])
        return array("I", self.library.encode(w, add_special_tokens=False).ids).tobytes()


_made: dict[str, Tokenizer] = {}
remembered.append(_made)


def slices(batch: pa.RecordBatch):
    """Parts of a batch with about BATCH bytes of text in column 1 each, and a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH, "right")))
        yield batch.slice(at, end - at)
        at = end


def shards(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``(part, seq, ids, sizes, n, file)`` rows: a wavelet matrix of the ids of consecutive documents each.

    ``ids`` and ``sizes`` are the documents of the shard, in order, and their counts of tokens with the end id."""
    kind = dict(docs.dtypes)[id_col]
    key = uuid.uuid4().hex
    out = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("file", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        names, sizes, held, total = [], [], [], 0

        def flush():
            nonlocal seq, names, sizes, held, total
            row = [part], [seq], [names], [sizes], [total], [WaveletMatrix.build(np.concatenate(held)).to_bytes()]
            seq, names, sizes, held, total = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, out, strict=True)], schema=out)

        make_room(_made)
        if key not in _made:
            _made.clear()
            _made[key] = Tokenizer(tokenizer_path)
        tok = _made[key]
        end = np.array([end_id], "<u4")
        for whole in batches:
            for b in slices(whole):
                for i, ids in zip(b.column(0).to_pylist(), tok.encode_all(b.column(1)), strict=True):
                    if held and total + len(ids) + 1 > shard:
                        yield flush()
                    names.append(i)
                    sizes.append(len(ids) + 1)
                    held += [ids, end]
                    total += len(ids) + 1
        if held:
            yield flush()

    rows = docs.select(F.col(id_col), F.col(text_col)).repartitionByRange(F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(F.col(id_col), F.xxhash64(text_col), F.col(text_col))
    return rows.mapInArrow(run, f"part int, seq int, ids array<{kind}>, sizes array<long>, n long, file binary")


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, **options) -> None:
    """Writes the shards as a table, each shard's file a value of its own, compressed already."""
    shards(docs, tokenizer_path, end_id, **options).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def documents(stored: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files alone.

    ``start`` counts the ids of all documents before it: sums by part, then inside each part, so that no task sees more
    than one row for each part or each shard of a part."""

    def run(cols):
        out = {k: [] for k in ("part", "seq", "doc_id", "at", "n_tokens", "ids_crc32")}
        for part, seq, ids, sizes, raw in zip(cols["part"], cols["seq"], cols["ids"], cols["sizes"], cols["file"], strict=True):
            tokens, at = WaveletMatrix.from_bytes(raw).to_array().astype("<u4"), 0
            for i, n in zip(list(ids), map(int, sizes), strict=True):
                for k, v in zip(out, (part, seq, i, at, n, zlib.crc32(tokens[at : at + n].tobytes())), strict=True):
                    out[k].append(v)
                at += n
        return out

    kind = dict(stored.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    rows = arrow_map(stored.select("part", "seq", "ids", "sizes", "file"), run, f"part int, seq int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    parts = stored.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.select("part", "seq", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inside")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
