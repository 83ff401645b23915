"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are computed for whole blocks of texts as arrays. Trees are grown on binned statistics of a bounded
labelled sample and flattened into arrays (feature, threshold, first child, value), through which all documents of a
block move together, one level at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ready_python
from scriptloom.llm.labelled import crc_mod, labelled_sample
from scriptloom.llm.textnum import blocks, mix, split_words

SAMPLE = 20_000

#: Byte classes: lower, upper, digit, blank, line end, full stop or comma, other ASCII punctuation by group, the rest.
CLASS = np.full(256, 10, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,", b"!?", b"|", b"#$%&*@^~+=<>{}[]\\/_`", b"'\"-:;()")):
    CLASS[list(_chars)] = _k
CLASSES = 11
STATISTICS = ["log_bytes", *(f"class_{k}" for k in range(CLASSES)), "log_words", "word_length", "word_spread", "short_words", "long_words", "distinct_words", "distinct_pairs", "distinct_triples", "words_per_line", "distinct_lines", "top_word"]


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    keys = np.unique(text.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    return np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, len(STATISTICS)) statistics, finite for empty texts too."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    classes = np.bincount(owner * CLASSES + CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    w = split_words(data, offsets)
    words = w.counts
    text = np.repeat(np.arange(n), words)
    length = (w.ends - w.starts).astype(np.float64)
    some, pairs, triples = np.maximum(words, 1), np.maximum(words - 1, 1), np.maximum(words - 2, 1)
    mean = np.bincount(text, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(text, length * length, n) / some - mean * mean, 0))
    h = w.hashes
    two = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    three = mix(two[:-1] * np.uint64(0xA0761D6478BD642F) + h[2:])
    in2, in3 = text[1:] == text[:-1], text[2:] == text[:-2]
    keys, times = np.unique(text.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20), return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, (keys >> np.uint64(44)).astype(np.int64), times)
    breaks = np.flatnonzero(data == 10)
    line_owner = np.concatenate([np.arange(n), owner[breaks]])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_start, line_owner))
    line_owner, line_start = line_owner[order], line_start[order]
    line_words = np.diff(np.searchsorted(w.starts, np.append(line_start, len(data))))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(line_words)])
    filled = line_words > 0
    line_hash = mix(sums[at[1:]] - sums[at[:-1]])
    lines = np.bincount(line_owner[filled], minlength=n)
    total = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), *(classes[:, k] / total for k in range(CLASSES)), np.log1p(words), mean, spread,
        np.bincount(text, length <= 3, n) / some, np.bincount(text, length > 12, n) / some,
        np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=n) / some,
        _distinct(text[:-1][in2], two[in2], n) / pairs, _distinct(text[:-2][in3], three[in3], n) / triples,
        words / np.maximum(lines, 1), _distinct(line_owner[filled], line_hash[filled], n) / np.maximum(lines, 1), top / some,
    ])


class Trees:
    """Boosted trees as flat arrays; a leaf is its own first child with an infinite threshold."""

    def __init__(self, base: float):
        self.base, self.roots = base, []
        self.feature, self.threshold, self.child, self.value = [], [], [], []

    def flat(self) -> Trees:
        for name, kind in (("roots", np.int64), ("feature", np.int64), ("threshold", np.float64), ("child", np.int64), ("value", np.float64)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def score(self, x: np.ndarray, depth: int) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(depth if self.roots.size else 0):
            right = x[rows, self.feature[node]] > self.threshold[node]
            node = self.child[node] + right
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[node].sum(axis=1), -35, 35)))


DEPTH = 4


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Newton boosting of the log loss. Each level's splits come from one histogram of gradients per statistic."""
    share = (y.sum() + 1.0) / (len(y) + 1.2)  # with no rows most documents count as good
    model = Trees(float(np.log(share / (1 - share))))
    if len(y) < 2 * least or y.min() == y.max():
        return model.flat()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        place = np.zeros(len(y), np.int64)  # the tree's node of each row
        nodes = [len(model.feature)]
        model.roots.append(nodes[0])
        for name, new in (("feature", 0), ("threshold", np.inf), ("child", nodes[0]), ("value", 0.0)):
            getattr(model, name).append(new)
        place += nodes[0]
        level = nodes
        for _ in range(DEPTH):
            slot = np.full(len(model.feature), -1)
            slot[level] = np.arange(len(level))
            own = slot[place]
            live = own >= 0
            best = [(0.0, -1, -1)] * len(level)
            for f in range(x.shape[1]):
                width = len(edges[f]) + 1
                if width < 2:
                    continue
                key = own[live] * width + binned[live, f]
                sums = [np.bincount(key, v, len(level) * width).reshape(-1, width).cumsum(axis=1) for v in (g[live], h[live], None)]
                gl, hl, nl = (s[:, :-1] for s in sums)
                gt, ht, nt = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                at = gain.argmax(axis=1)
                for k, b in enumerate(at.tolist()):
                    if gain[k, b] > best[k][0] + 1e-9:
                        best[k] = (float(gain[k, b]), f, b)
            following = []
            for k, node in enumerate(level):
                gain, f, b = best[k]
                if f < 0:
                    continue
                left = len(model.feature)
                model.feature[node], model.threshold[node], model.child[node] = f, float(edges[f][b]), left
                for new in (left, left + 1):
                    model.feature.append(0)
                    model.threshold.append(np.inf)
                    model.child.append(new)
                    model.value.append(0.0)
                rows = np.flatnonzero(place == node)
                place[rows] = left + (binned[rows, f] > b)
                following += [left, left + 1]
            level = following
            if not level:
                break
        gs, hs = np.bincount(place, g, len(model.feature)), np.bincount(place, h, len(model.feature))
        for node in np.unique(place).tolist():
            model.value[node] = -rate * gs[node] / (hs[node] + l2)
        margin += np.array(model.value)[place]
    return model.flat()


def train(docs: DataFrame, labels: DataFrame, held_out, sample_rows: int) -> Trees:
    names = ["doc_id", "label", *STATISTICS]

    def measured(batches):
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(2).slice(row, n), *(pa.array(c) for c in statistics(data, offsets).T)], names=names)

    sample = labelled_sample(docs, labels, "quality", held_out, sample_rows).select("doc_id", "text", "label")
    rows = sample.mapInArrow(measured, "doc_id long, label int, " + ", ".join(f"{s} double" for s in STATISTICS)).toPandas().sort_values(names)
    return fit(rows[STATISTICS].to_numpy(), rows["label"].to_numpy(np.float64))


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the columns named in ``carry``.

    Learns from at most ``sample_rows`` labelled documents that are not held out (statistics of these alone reach the
    driver). Null or empty text has statistics of 0; a null doc_id is not held out; repeated rows score alike; with no
    labels every document scores above 0.5. An empty table gives no rows.
    """
    ready_python(docs.sparkSession)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs, labels, held_out, sample_rows)
    rest = [docs.schema[c] for c in carry]

    def scored(batches):
        for batch in batches:
            for row, data, offsets in blocks(batch.column(2)):
                n = len(offsets) - 1
                score = model.score(statistics(data, offsets), DEPTH)
                columns = [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                columns += [batch.column(3 + k).slice(row, n) for k in range(len(rest))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", *carry])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("_measured"), *carry)
    schema = "doc_id long, held_out boolean, score double, predicted int" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in rest)
    return rows.mapInArrow(scored, schema)
