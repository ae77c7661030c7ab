"""Quality classifier: histogram gradient-boosted trees over document
statistics.

Statistics are computed in Arrow batches with numpy.  Training bins each
statistic by quantiles, grows depth-limited trees on gradient and hessian
histograms of the logistic loss, and stops early on labelled rows kept out of
the fit.  Trees are stored as flat arrays (feature, threshold, left, right,
value), and scoring walks all rows of a batch through one level of a tree at a
time.

Bounds: at most ``max_labelled`` labelled rows (smallest hashed ids) are
learned from, as rows of statistics on the driver.  Scoring reads every whole
text.

Defined cases: a null or empty text has all statistics 0 and is scored like
any other; with labels of one kind, or none, every score is that kind's share
(0.5 without labels); rows with a null label teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices

FEATURES = ("chars", "words", "lines", "word_chars", "distinct_share", "repeat_share", "symbol_share",
            "separator_share", "digit_share", "upper_share", "mark_share", "space_share",
            "duplicate_lines", "marked_lines", "longest_word", "words_per_line")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(float)

    symbols, separators, digits = count(r"[#*$%&<>{}\\^~_=+@]"), count(r"[|»›·•]"), count(r"[0-9]")
    upper, marks, spaces = count(r"\p{Lu}"), count(r"[.!?…]"), count(r"[\x20\x09-\x0D]")
    words_of = pc.split_pattern_regex(pc.utf8_trim_whitespace(texts), r"[\x20\x09-\x0D]+")
    out = np.zeros((n, len(FEATURES)))
    words = words_of.flatten()
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = pc.list_value_length(words_of).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), n_words)
    span = int(code.max()) + 1 if len(code) else 1
    distinct = np.bincount(np.unique(owner * span + code) // span, minlength=n).astype(float)
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, same, n)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    n_words = np.where(chars > 0, n_words, 0).astype(float)
    lines_of = pc.split_pattern(texts, "\n")
    lines = lines_of.flatten()
    n_lines = pc.list_value_length(lines_of).to_numpy(zero_copy_only=False).astype(np.int64)
    line_owner = np.repeat(np.arange(n), n_lines)
    line_code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_span = int(line_code.max()) + 1 if len(line_code) else 1
    distinct_lines = np.bincount(np.unique(line_owner * line_span + line_code) // line_span, minlength=n)
    ended = pc.match_substring_regex(lines, r"[.!?…]['\")\]]*\s*$").to_numpy(zero_copy_only=False)
    marked = np.bincount(line_owner, ended, n)
    base, per_word = np.maximum(chars, 1), np.maximum(n_words, 1)
    word_chars = chars - spaces
    for i, col in enumerate((
            chars, n_words, n_lines, word_chars / per_word, distinct / per_word, repeats / per_word,
            symbols / base, separators / base, digits / base, upper / base, marks / base, spaces / base,
            1 - distinct_lines / np.maximum(n_lines, 1), marked / np.maximum(n_lines, 1),
            longest, n_words / np.maximum(n_lines, 1))):
        out[:, i] = np.where(chars > 0, col, 0)
    return out


@dataclass(frozen=True)
class TreeSettings:
    max_labelled: int = 20_000
    bins: int = 64
    depth: int = 4
    trees: int = 120
    rate: float = 0.15
    least_rows: int = 10
    shrink: float = 1.0           # L2 on leaf values
    patience: int = 15            # trees without improvement on the rows kept out


@dataclass(frozen=True)
class Trees:
    """Flat trees: inner nodes have left >= 0; x <= threshold goes left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.left[at] >= 0
                if not inner.any():
                    break
                go_left = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, s: TreeSettings = TreeSettings()) -> Trees:
    """Boosted trees on rows ``~held``; the number of trees by the loss on
    ``held``."""
    nothing = np.zeros(0, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else min(max(share, 0.001), 0.999)
        return Trees(float(np.log(p / (1 - p))), nothing, np.zeros(0), nothing, nothing, np.zeros(0), nothing, 0)
    if held.all() or not held.any() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    xt, yt = x[~held], y[~held].astype(float)
    cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, s.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[f], xt[:, f], side="left") for f in range(x.shape[1])], 1)
    base = float(np.log(yt.mean() / (1 - yt.mean())))
    margin = np.full(len(yt), base)
    nodes: list[list] = []           # feature, threshold, left, right, value
    roots: list[int] = []
    test = np.full(int(held.sum()), base)
    best, kept = np.inf, 0
    for t in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = yt - p, np.maximum(p * (1 - p), 1e-12)
        roots.append(len(nodes))
        nodes.append([0, 0.0, -1, -1, 0.0])
        todo = [(roots[-1], np.arange(len(yt)), 0)]
        while todo:
            node, rows, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[node][4] = s.rate * g / (h + s.shrink)
            margin_of = nodes[node][4]
            split = _best_split(binned[rows], grad[rows], hess[rows], cuts, s) if level < s.depth else None
            if split is None:
                margin[rows] += margin_of
                continue
            f, b = split
            goes = binned[rows, f] <= b
            nodes[node][:4] = [f, float(cuts[f][b]), len(nodes), len(nodes) + 1]
            nodes += [[0, 0.0, -1, -1, 0.0], [0, 0.0, -1, -1, 0.0]]
            todo += [(nodes[node][2], rows[goes], level + 1), (nodes[node][3], rows[~goes], level + 1)]
        if held.any():
            one = _packed(0.0, nodes, roots[-1:], s.depth)
            test += np.log(np.maximum(p1 := one.score(x[held]), 1e-300)) - np.log1p(-p1)
            z = np.clip(test, -30, 30)
            loss = float(np.mean(np.log1p(np.exp(-z)) + (1 - y[held]) * z))
            if loss < best - 1e-6:
                best, kept = loss, t + 1
            elif t + 1 - kept >= s.patience:
                break
        else:
            kept = t + 1
    return _packed(base, nodes, roots[:max(kept, 1)], s.depth)


def _packed(base: float, nodes: list, roots: list, depth: int) -> Trees:
    cols = list(zip(*nodes))
    return Trees(base, np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]),
                 np.array(cols[4]), np.array(roots), depth + 1)


def _best_split(binned, grad, hess, cuts, s: TreeSettings) -> tuple[int, int] | None:
    """Feature and last bin of the left side with the largest gain."""
    g, h, n = grad.sum(), hess.sum(), len(grad)
    best, found = 1e-6, None
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        m = len(edges) + 1
        gl = np.cumsum(np.bincount(binned[:, f], grad, m))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], hess, m))[:-1]
        nl = np.cumsum(np.bincount(binned[:, f], minlength=m))[:-1]
        gain = gl ** 2 / (hl + s.shrink) + (g - gl) ** 2 / (h - hl + s.shrink) - g ** 2 / (h + s.shrink)
        gain[(nl < s.least_rows) | (n - nl < s.least_rows)] = -np.inf
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, found = gain[b], (f, b)
    return found


def _featured(docs: DataFrame, extra: str, slice_bytes: int = 3_000_000) -> DataFrame:
    names = [f.name for f in docs.schema if f.name != "t"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        for b in batches:
            texts = pc.fill_null(b.column(b.schema.get_field_index("t")), "")
            rest = [b.column(b.schema.get_field_index(x)) for x in names]
            for lo, hi in in_slices(pc.binary_length(texts).to_pylist(), slice_bytes):
                x = statistics(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in rest], pa.array(list(x), pa.list_(pa.float64()))],
                    names=[*names, extra])

    return docs.mapInArrow(run, ", ".join(f"{x} {kinds[x]}" for x in names) + f", {extra} array<double>")


def train(docs: DataFrame, labels: DataFrame, learn: Column, hold: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", settings: TreeSettings = TreeSettings()) -> Trees:
    """Fit on the labelled documents that ``learn`` selects; ``hold`` marks
    those that only decide when to stop (conditions over the labels)."""
    chosen = (labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("k"))
              .agg(F.max(F.col(label_col).cast("int")).alias("y"), F.first(hold).alias("held"))
              .orderBy(F.xxhash64("k"), "k").limit(settings.max_labelled))
    # At most max_labelled rows of three small columns: safe to broadcast.
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(
        F.broadcast(chosen), "k").groupBy("k").agg(      # of an id's texts the greatest teaches
            F.max("y").alias("y"), F.max("held").alias("held"), F.max("t").alias("t"))
    got = sorted(_featured(rows, "x").select("k", "y", "held", "x").collect(), key=lambda r: str(r["k"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], int), np.array([r["held"] for r in got], bool), settings)


def score_documents(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text",
                    slice_bytes: int = 3_000_000) -> DataFrame:
    """One row per document: ``id_col``, score (chance of label 1)."""
    src = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    key_type = src.schema["k"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for lo, hi in in_slices(pc.binary_length(texts).to_pylist(), slice_bytes):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.array(trees.score(statistics(texts.slice(lo, hi - lo))))], names=["k", "score"])

    return src.mapInArrow(run, f"k {key_type}, score double").withColumnRenamed("k", id_col)
