"""Quality rules learned as decision lists.

Method: statistics of labelled texts are covered one rule after another.  A rule grows by the threshold that gains most
(FOIL's gain) until it covers no good text of the growing part, then loses the last conditions that don't help on the
pruning part; it is held if it is precise enough there.  The rules leave as ordered Spark conditional expressions; what no
rule covers is kept.

The learner sees at most ``max_rows`` labelled ids, those with the least hash, with a row each; statistics and verdicts cover
all documents.

Defined results: a null text has no words; ids with two labels are left out of learning; without labels, or with labels of
one class, there are no rules and only the base rules reject; rows that repeat an id are judged each for itself; a text is
read whole, whatever its length; an empty table gives an empty table; columns beside the id and text are passed by, by
``kept`` whatever their names and types.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, pack, quoted, unpack

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "mean_word", "symbols", "upper", "marks", "bars", "digits", "dup_lines", "repeats", "distinct", "line_words", "punctuation")
_UPPER, _MARKS, _DIGITS, _ENDS = bytes(range(65, 91)), b"!?", b"0123456789", b".,;:"
_FACTOR = np.random.default_rng(7).integers(1, 2**62, WINDOW, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    # equal words have equal hashes: windows whose sums all differ can't repeat
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(size):
        sums += h[k : k + n] * _FACTOR[k]
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    step = 1
    while step < size:  # numbers of windows of 2, 4 and 8 words; sizes are powers of two
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
        step *= 2
    found = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(found), 1)
    np.add.at(edge, np.flatnonzero(found) + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> dict[str, float]:
    """Base counts and features of one text."""
    raw = (text or "").encode()
    words = raw.split()
    dense = raw.translate(None, SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text or "") - (len(raw) - len(dense))

    def share(of: bytes) -> float:
        return (len(dense) - len(dense.translate(None, of))) / max(1, chars)

    n, dup, rep = len(words), len(lines) - len(set(lines)), repeated_words(words)
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": len(dense) - len(dense.translate(None, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": rep,
        "words": float(n),
        "mean_word": chars / max(1, n),
        "symbols": share(SYMBOLS),
        "upper": share(_UPPER),
        "marks": share(_MARKS),
        "bars": share(b"|"),
        "digits": share(_DIGITS),
        "dup_lines": dup / max(1, len(lines)),
        "repeats": rep / max(1, n),
        "distinct": len(set(words)) / max(1, n),
        "line_words": n / max(1, len(lines)),
        "punctuation": share(_ENDS),
    }


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and the statistics of each row's text, under names with two underscores."""
    keep = docs.columns if keep is None else keep

    def run(cols):
        stats = [statistics(t) for t in cols["__text"]]
        return {f"__{k}": [s[k] for s in stats] for k in (*BASE, *FEATURES)}

    schema = ", ".join([*(f"__{k} long" for k in BASE), *(f"__{k} double" for k in FEATURES)])
    return arrow_map(docs.select(*map(quoted, keep), F.col(quoted(text_col)).alias("__text")), run, schema, tuple(keep))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) that rejects."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.conditions:
            out &= x[f] <= t if op == "<=" else x[f] > t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            out = out & (F.col(f"__{f}") <= t if op == "<=" else F.col(f"__{f}") > t)
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, most: int) -> Rule:
    conditions: list[tuple[str, str, float]] = []
    inside = np.ones(len(bad), bool)
    while (bad & inside).any() and (~bad & inside).any() and len(conditions) < most:
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 0.0
        for f in FEATURES:
            v = x[f][inside]
            order = np.argsort(v, kind="stable")
            v, good = v[order], np.cumsum(~bad[inside][order])
            hit = np.cumsum(bad[inside][order])
            at = np.unique(np.linspace(0, len(v) - 2, cuts).astype(int)) if len(v) > 1 else np.array([], int)
            at = at[v[at] < v[at + 1]]
            for op, p, n in (("<=", hit[at], good[at]), (">", p0 - hit[at], n0 - good[at])):
                g = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0)))
                if len(g) and (k := int(np.argmax(g))) is not None and g[k] > gain + 1e-9:
                    best, gain = (f, op, float((v[at[k]] + v[at[k] + 1]) / 2)), float(g[k])
        if best is None:
            break
        conditions.append(best)
        inside &= Rule((best,)).covers(x)
    return Rule(tuple(conditions))


def learn(rows: list[dict], least_precision: float = 0.95, least_cover: int = 2, cuts: int = 400, most_conditions: int = 4, most_rules: int = 20) -> list[Rule]:
    """Rules from rows with ``quality`` (0: reject) and the features; the order of the rows decides the parts."""
    if not rows:
        return []
    x = {f: np.array([r[f"__{f}"] for r in rows], float) for f in FEATURES}
    bad = np.array([r["quality"] == 0 for r in rows])
    grow = np.arange(len(rows)) % 3 < 2
    left, rules = np.ones(len(rows), bool), []
    while len(rules) < most_rules and (bad & left & grow).any() and (~bad & left & grow).any():
        part = left & grow
        rule = _grow({f: v[part] for f, v in x.items()}, bad[part], cuts, most_conditions)

        def worth(r: Rule) -> tuple[float, int]:
            c = r.covers(x) & left & ~grow
            p, n = int((c & bad).sum()), int((c & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0, -len(r.conditions))

        shorter = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        if not shorter:
            break
        rule = max(shorter, key=worth)
        c = rule.covers(x) & left
        if (c & bad).sum() < least_cover or (c & bad).sum() < least_precision * c.sum():
            break
        rules.append(rule)
        left &= ~c
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> list[Rule]:
    """Learns from at most ``max_rows`` labelled documents."""
    one = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("quality"), F.max(label_col).alias("__most")).where("quality = __most")
    chosen = one.select(F.col(id_col).alias("__id"), "quality").orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    # bounded by max_rows, as is what the driver fetches: of rows that repeat an id the one of the least statistics
    labelled = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    stats = with_statistics(labelled, "__text", ["__id", "quality"])
    found = stats.groupBy("__id", "quality").agg(F.min(F.struct(*[f"__{f}" for f in FEATURES])).alias("x")).select("__id", "quality", "x.*").toArrow().to_pylist()
    found.sort(key=lambda r: r["__id"])
    mixed = np.random.default_rng(11).permutation(len(found))
    return learn([found[i] for i in mixed])


def verdict(rules: list[Rule]) -> Column:
    """False by the first rule that covers a row, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with the statistics, ``__base_failed`` and ``__kept``."""
    out = with_statistics(docs, text_col, keep).withColumn("__base_failed", base_failed())
    return out.withColumn("__kept", ~F.col("__base_failed") & verdict(rules))


def kept(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that neither the base rules nor the learned ones reject, with their columns as they are."""
    return unpack(judge(pack(docs, [text_col]), rules, text_col).where("__kept"), docs.columns, [text_col])
