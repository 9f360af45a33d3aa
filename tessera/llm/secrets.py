"""Secret scans with corpus-wide ownership frequency.

Method: candidates are found by pattern in each text, hashed, and the hashes are aggregated over the corpus by distinct
repositories and owners.  A value that several owners have, or that stands in many repositories of whatever owners, is an
example that people copy; any other looks live.  Base kinds are always reported; what looks live is added under the kind ``live``, be it the value of a base
match or a further candidate: a run of letters and digits of 20 or more with both, and of high entropy.

The owner of a document is its source and its repository the source together with its text's hash, so exact copies
inside a source are one repository.

Defined results: a null or empty text has no spans; ties are ordered by kind; rows that repeat an id are scanned each for
itself and counted once in the corpus if their texts agree; null and empty texts and ids stay apart; a text is scanned
whole, whatever its length; an empty table gives an empty table; columns beside the id, text and source are ignored, or
passed on as they are by ``redact``, whatever their names and types.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialize, pack, quoted, unpack

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
FURTHER = re.compile(r"[A-Za-z0-9]{20,}")
KINDS = ("assign", "access", "hex", "live")
#: Bits a character from which a further candidate counts as random.
LEAST_ENTROPY = 3.5
#: Owners from which a value counts as copied.
COPIED = 3
#: Repositories (different texts of a source) from which a value counts as copied even by fewer owners.
COPIED_REPOS = 10


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans of values to be looked up in the corpus, both as (kind or value, start, end)."""
    base, values = [], []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            base.append(("assign", *m.span()))
            values.append((m[2], *m.span(2)))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            base.append((kind, *m.span()))
            values.append((m[0], *m.span()))
    for m in FURTHER.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= LEAST_ENTROPY:
            values.append((v, *m.span()))
    return base, values


def row_key(id_: Column, text: Column) -> Column:
    """A key that rows share only if their ids and texts agree; null stays apart from any value."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.md5(F.concat(part(F.md5(text.cast("binary"))), part(id_.cast("string"))).cast("binary"))


SPANS = "array<struct<kind:string,start:int,end:int>>"
VALUES = "array<struct<hash:long,start:int,end:int>>"


def found_in(text: str | None) -> tuple[list[dict], list[dict], str | None]:
    """Base spans, values with their hashes, and the repository's part that is the text's."""
    base, values = scan(text or "")
    return (
        [{"kind": k, "start": i, "end": j} for k, i, j in base],
        [{"hash": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "start": i, "end": j} for v, i, j in dict.fromkeys(values)],
        hashlib.md5((text or "").encode()).hexdigest() if values else None,
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: its id and key, its base spans, its values with their hashes, its owner and its repository."""

    def run(cols):
        base, values, repo = zip(*map(found_in, cols["text"])) if cols["text"] else ((), (), ())
        return {"base": base, "values": values, "repo": repo}

    id_, text = F.col(id_col), F.col(text_col)
    rows = docs.select(id_.alias("id"), row_key(id_, text).alias("row"), F.col(source_col).alias("owner"), text.alias("text"))
    return arrow_map(rows, run, f"base {SPANS}, values {VALUES}, repo string", ("id", "row", "owner")).withColumnRenamed("id", id_col)


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, owners, repos)``: first one row for each value, owner and repository, then counts, so that a value that
    everybody copies is summed in steps."""
    one = found.select("owner", "repo", F.explode("values.hash").alias("hash")).groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = one.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def live_spans(found: DataFrame) -> DataFrame:
    """``(row, added)``: the spans of each document's values that look live; only documents with values take part."""
    live = materialize(ownership(found).where((F.col("owners") < COPIED) & (F.col("repos") < COPIED_REPOS)).select("hash"))
    hit = found.select("row", F.explode("values").alias("v")).select("row", "v.hash", "v.start", "v.end").join(live, "hash")
    return hit.groupBy("row").agg(F.collect_set(F.struct(F.lit("live").alias("kind"), "start", "end")).alias("added"))


def scan_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id_col, base, spans)`` for each row: arrays of (kind, start, end) in order; ``spans`` also has what looks live."""
    found = materialize(candidates(docs, id_col, text_col, source_col))
    added = live_spans(found)
    rank = F.array(*[F.lit(k) for k in KINDS])

    def ordered(spans):
        keyed = F.transform(spans, lambda x: F.struct(x["start"], F.array_position(rank, x["kind"]).alias("rank"), x["end"], x["kind"]))
        return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"], x["start"], x["end"]))

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    spans = F.concat("base", F.coalesce("added", none))
    return found.join(added, "row", "left").select(id_col, ordered(F.col("base")).alias("base"), ordered(spans).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans."""

    def n(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with each value that looks live replaced by a mask; copied examples stay as they are.

    The documents are written once with what was found in them, so that only those with values are shuffled to the
    corpus's verdicts; all others are passed on from where they lie."""
    used = [id_col, text_col, source_col]

    def note(cols):
        _, values, repo = zip(*map(found_in, cols[text_col])) if cols[text_col] else ((), (), ())
        return {"__values": values, "__repo": repo}

    rows = pack(docs, used)
    noted = materialize(arrow_map(rows, note, f"__values {VALUES}, __repo string", tuple(rows.columns)))
    with_values = noted.where(F.col("__repo").isNotNull()).withColumn("__row", row_key(F.col(id_col), F.col(text_col)))
    found = with_values.select(F.col("__row").alias("row"), F.col(source_col).alias("owner"), F.col("__values").alias("values"), F.col("__repo").alias("repo"))
    added = live_spans(found).select(F.col("row").alias("__row"), "added")

    def masked(cols):
        out = []
        for text, spans in zip(cols[text_col], cols["added"], strict=True):
            parts, at = [], 0
            for i, j in sorted((x["start"], x["end"]) for x in spans or ()):
                if i >= at:
                    parts += [text[at:i], mask]
                at = max(at, j)
            out.append("".join([*parts, text[at:]]) if parts else text)
        return {text_col: out}

    hit = with_values.join(added, "__row", "left").select(*rows.columns, "added")
    hit = arrow_map(hit, masked, f"{quoted(text_col)} string", tuple(c for c in rows.columns if c != text_col))
    return unpack(noted.where(F.col("__repo").isNull()).select(*rows.columns).unionByName(hit), docs.columns, used)
