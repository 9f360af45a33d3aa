"""Token counts of documents of any length by overlapping chunks that are spliced where they agree.

Method: a document beyond ``chunk`` code points is cut into chunks that overlap.  Each chunk is encoded on its own, with offsets,
and reports, in the two zones that it shares with its neighbours, where pre-tokens begin and how many tokens stand
before.  Two neighbours are spliced at the first place where both begin a pre-token.  Such a place is stable: pre-tokens never
merge across their limits, the pattern looks back at nothing, so from a common beginning both go on alike, and what a chunk says is
taken only up to ``guard`` code points before its end, more than the pattern looks ahead and than an added token is long, so
that its end can't have changed it.  By induction from the document's start every splice is a beginning in the
whole text, so tokens between splices add up to the library's count.  Where neighbours have no common beginning, the
overlap is widened: the chunk on the left takes in the next one whole and is encoded again, until all agree; after ``ROUNDS``
widenings what still fails is encoded whole, as are texts made of one pre-token.

How rows flow: short documents are counted where they are read.  Chunks of long ones are shuffled with their text and
equal texts' chunks are merged before the shuffle, so copies are encoded once and one huge document is shared by many tasks; a
worker holds one batch of chunks, of at most ``BATCH`` code points.  Splices are a window over a row for each chunk.

The proof needs a tokenizer file with the byte-level pre-tokenizer's own pattern, without a normalizer and with plain added tokens
that don't overlap each other; others are refused.

Defined results: a null text counts as empty, 0 bytes and 0 tokens; rows that repeat are counted each; texts are read
whole; other columns aren't read, but those named by ``keep`` go through; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import os
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialize, quoted, remembered, small

CHUNK, OVERLAP, ROUNDS, BATCH, REMEMBERED = 16_384, 256, 3, 1 << 19, 300_000
RESULT = ("n_bytes", "n_tokens", "over_limit")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer without truncation or padding, with one thread a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def guard(path: str) -> int:
    """Code points before a chunk's end that prove nothing; refuses files for which splices aren't proven."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        raise ValueError("splices are proven for the byte-level pre-tokenizer alone")
    added = [a["content"] for a in spec.get("added_tokens") or []]
    if any(a[k] for a in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take white space or whole words aren't supported")
    if any(" " in a for a in added):
        raise ValueError("added tokens may hold no space")
    if any(a.endswith(b[:n]) for a in added for b in added for n in range(1, len(b) + (a != b)) if not (a == b and n == len(b))):
        raise ValueError("added tokens may not overlap")
    return max(map(len, added), default=0) + 4  # contractions look two ahead, runs of spaces one


def batches(texts: list[str], most: int = BATCH):
    """Slices of the list that hold at most so many code points, or one text."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > most:
            yield texts[i:j]
            i, size = j, 0
        size += len(t)
    if texts[i:]:
        yield texts[i:]


#: Tokens of pieces " word" that a worker has counted, lately and before; less than zero where a piece may not be cut off.
counted: dict[str, int] = {}
counted_before: dict[str, int] = {}
remembered += [counted, counted_before]
WHOLE = -(1 << 50)


def count_batch(path: str, texts: list[str]) -> list[int]:
    """Tokens of whole texts.

    Between a character and a single space before another a pre-token always begins, so such pieces are counted once
    each; a text with other white space beside a space goes to the library whole."""
    t = tokenizer(path)
    if len(counted) > REMEMBERED:
        counted_before.clear()
        counted_before.update(counted)
        counted.clear()
    parts = [x.split(" ") for x in texts]
    new = set().union(*[p[1:] for p in parts]).difference(counted)
    counted.update({w: counted_before[w] for w in new if w in counted_before})
    new = list(new.difference(counted))
    size = lambda words: [len(e) for part in batches(words) for e in t.encode_batch_fast(part, add_special_tokens=False)]
    fit = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
    counted.update(dict.fromkeys(new, WHOLE))
    counted.update(zip(fit, size([" " + w for w in fit]), strict=True))
    begun = size([p[0] for p in parts])
    out = [WHOLE if len(p) > 1 and p[0][-1:].isspace() else n + sum(map(counted.__getitem__, p[1:])) for n, p in zip(begun, parts, strict=True)]
    left = [i for i, n in enumerate(out) if n < 0]
    for i, n in zip(left, size([texts[i] for i in left]), strict=True):
        out[i] = n
    return out


CUT = re.compile(r"(?<=\S) (?=\S)")


def beginnings(encoding, since: int, until: int, shift: int = 0, before: int = 0) -> tuple[list[int], list[int]]:
    """Places in [since, until) where a pre-token begins, each with the tokens before it; ``shift`` and ``before`` are what
    stands before the encoded text."""
    places, tokens, last = [], [], None
    for n, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if (word is None or word != last) and since <= at + shift < until:
            places.append(at + shift)
            tokens.append(before + n)
        last = word
    return places, tokens


def _zones(path: str, texts: list[str], overlap: int, unsure: int):
    """``(n, head, head_n, tail, tail_n)`` of each chunk; between the first cut after the head and one before the tail
    pieces are counted, and only what is left at both ends is encoded with offsets."""
    ends, middles = [], []
    for x in texts:
        a = CUT.search(x, overlap)
        b = a and CUT.search(x, max(a.start() + 1, len(x) - overlap - 100), max(0, len(x) - overlap))
        i, j = (a.start(), b.start()) if b else (len(x), len(x))
        ends += [x[:i], x[j:]]
        middles.append(x[i:j])
    encode = tokenizer(path).encode_batch
    encoded = [e for part in batches(ends) for e in encode(part, add_special_tokens=False)]
    for k, (x, middle, n) in enumerate(zip(texts, middles, count_batch(path, middles), strict=True)):
        left, right = encoded[2 * k : 2 * k + 2]
        since, until = len(x) - overlap, len(x) - unsure + 1
        tail = beginnings(right, since, until, len(x) - len(ends[2 * k + 1]), len(left) + n) if middle else beginnings(left, since, until)
        yield len(left) + n + len(right), *beginnings(left, 0, overlap), *tail


CODED = "sha string, k long, start long, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"


def _coded(chunks: DataFrame, path: str, overlap: int, unsure: int) -> DataFrame:
    """Chunks ``(sha, k, start, text, last)`` with their counts and the beginnings in their zones, as places of the document."""

    def run(cols):
        found = list(_zones(path, cols["text"], overlap, unsure))
        out = {c: cols[c] for c in ("sha", "k", "start")}
        for i, name in enumerate(("n", "head", "head_n", "tail", "tail_n")):
            out[name] = [f[i] if name.endswith("n") else [s + p for p in f[i]] for s, f in zip(cols["start"], found, strict=True)]
        return out

    return arrow_map(chunks.select("sha", "k", "start", "text"), run, CODED)


def _zones_of(t, texts: list[str], overlap: int, unsure: int):
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        head, head_n, tail, tail_n = zones(e, overlap, len(text) - overlap)
        sure = sum(1 for p in tail if p <= len(text) - unsure)
        yield len(e), (head, head_n, tail[:sure], tail_n[:sure])


def _spliced(coded: DataFrame) -> DataFrame:
    """Adds ``joint``, the first beginning that a chunk shares with the one before it, and ``gain``, what its document's count
    gets from the splice."""
    w = Window.partitionBy("sha").orderBy("k")
    x = coded.withColumn("tail_b", F.lag("tail").over(w)).withColumn("tail_nb", F.lag("tail_n").over(w))
    x = x.withColumn("first", F.row_number().over(w) == 1).withColumn("n_next", F.lead("k").over(w))
    x = x.withColumn("joint", F.array_min(F.array_intersect("tail_b", "head")))
    at = lambda places, counts: F.element_at(counts, F.array_position(places, F.col("joint")).cast("int"))
    gain = F.when(F.col("joint").isNotNull(), at("tail_b", "tail_nb") - at("head", "head_n")).otherwise(F.lit(0))
    return x.select("sha", "k", "first", F.coalesce(~F.col("first") & F.col("joint").isNull(), F.lit(False)).alias("failed"), (gain + F.when(F.col("n_next").isNull(), F.col("n")).otherwise(F.lit(0))).alias("gain"))


def long_counts(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(sha, n_tokens)`` of each different text, by chunks."""
    unsure = guard(path)
    if overlap <= unsure or chunk < 2 * overlap:
        raise ValueError("a chunk holds two overlaps, and an overlap more than what its end leaves open")

    def cut(cols):
        out = {"sha": [], "k": [], "start": [], "text": []}
        for sha, text in zip(cols["sha"], cols["text"], strict=True):
            for k, start in enumerate(range(0, max(1, len(text)), chunk)):
                if start and len(text) - start <= overlap:
                    break  # the chunk before reaches the end
                out["sha"].append(sha)
                out["k"].append(k)
                out["start"].append(start)
                out["text"].append(text[start : start + chunk + overlap])
        return out

    texts = docs.select(F.sha2(F.col(quoted(text_col)), 256).alias("sha"), F.col(quoted(text_col)).alias("text"))
    pieces = arrow_map(texts, cut, "sha string, k long, start long, text string")
    chunks = materialize(pieces.groupBy("sha", "k", "start").agg(F.first("text").alias("text")))
    coded = materialize(_coded(chunks, path, overlap, unsure))
    for r in range(ROUNDS + 2):  # nothing fails after the last widening
        joints = materialize(_spliced(coded))
        bad = joints.where("failed").select("sha").distinct()
        if not bad.limit(1).count():
            break
        # runs of chunks without a splice between them become one; all of a document after the last round
        w = Window.partitionBy("sha").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        run = F.sum((~F.col("failed")).cast("long")).over(w) if r < ROUNDS else F.lit(0)
        runs = joints.join(bad, "sha", "left_semi").withColumn("run", run)
        runs = runs.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("sha", "run"))).where("size > 1").select("sha", "k", "run")
        taken = materialize(runs)
        parts = chunks.join(taken, ["sha", "k"]).groupBy("sha", "run").agg(F.array_sort(F.collect_list(F.struct("k", "start", "text"))).alias("all"))
        text = F.array_join(F.transform("all", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], overlap + 1, 2**31 - 1))), "")
        merged = materialize(parts.select("sha", F.col("all")[0]["k"].alias("k"), F.col("all")[0]["start"].alias("start"), text.alias("text")))
        chunks = materialize(chunks.join(taken, ["sha", "k"], "left_anti").unionByName(merged))
        coded = materialize(coded.join(taken, ["sha", "k"], "left_anti").unionByName(_coded(merged, path, overlap, unsure)))
    return joints.groupBy("sha").agg(F.sum("gain").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ``keep`` columns with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) of each row."""
    if set(keep) & set(RESULT):
        raise ValueError(f"kept columns may not be named {', '.join(RESULT)}")
    guard(path)
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    held = F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.lit(None).cast("struct<none:int>")
    x = docs.select(held.alias("keep"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.length(text).alias("size"))
    whole = arrow_map(x.where(F.col("size") <= chunk), lambda cols: {"n_tokens": count_batch(path, cols["text"])}, "n_tokens long", keep=("keep", "n_bytes"))
    longer = x.where(F.col("size") > chunk)
    counts = long_counts(longer, path, "text", chunk, overlap)
    named = longer.select("keep", "n_bytes", F.sha2("text", 256).alias("sha")).join(small(materialize(counts)), "sha")
    both = whole.unionByName(named.select("keep", "n_bytes", "n_tokens"))
    return both.select(*[F.col("keep").getField(c).alias(c) for c in keep], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
