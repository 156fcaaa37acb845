"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed marks: the first 3 to 6 bytes of its words (A-Z
folded), alone and with steps of their share of the words, the last 2 and 3
bytes, and buckets of a few shares (repeated words, capitals, bars). One weight vector ``w`` serves all grades; ordered
thresholds ``t_1 < t_2 < ...`` cut its scale: ``P(grade >= k) = sigmoid(w.x - t_k)``.
That gives an expected grade and, for selection, the probability of the tail.

Fitting takes at most ``max_rows`` rated rows (a stated bound; chosen by a hash
of the id, so the same rows at every run), whose marks are made in parallel
and fitted in one task by FTRL-proximal steps; the L1 term leaves only weights
that ratings support. Scoring is one pass over the texts with the non-zero
weights (at most 2**22, a fixed table), without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm import words as W
from tablelens.llm.stage import ship_package

BITS = 22
#: Rated rows used for fitting at most.
MAX_ROWS = 8_000
_RUN = 256  # texts whose marks are sent in one batch
_HEADS, _TAILS = (3, 4, 5, 6), (2, 3)
_HEAD_SHARES = (0.0, 0.004, 0.008, 0.016, 0.032)
_LOWEST_BIT = np.uint64(64 - BITS)


def _share(part: int, whole: int) -> int:
    return int(10 * part / whole) if whole else 0


def text_marks(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct mark numbers (below 2**BITS) of each text; a null is empty."""
    data, offsets = W.column_bytes(column)
    for i, j in W.text_groups(offsets):
        h, s, e, first = W.words_of_rows(data, offsets, i, j, lower=True)
        marks = []
        if len(h):
            begin, end = int(s[0]), int(e[-1])
            part, s, e = data[begin:end], s - begin, e - begin
            if len(part) <= 4 * W.BLOCK:
                marks = _word_marks(part, s, e)
            else:  # a very long text: in runs of words
                step = 1 << 16
                chunks = []
                for k in range(0, len(s), step):
                    x, y = s[k:k + step], e[k:k + step]
                    chunks.append(_word_marks(part[x[0]:y[-1]], x - x[0], y - x[0]))
                marks = [np.concatenate(c) for c in zip(*chunks)]
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            n = b - a
            own = [m[a:b] for m in marks]
            if n:
                again = int((h[a + 1:b] == h[a:b - 1]).sum())
                distinct = len(np.unique(h[a:b]))
                row = data[offsets[i + r]:offsets[i + r + 1]]
                capitals = int(((row >= 65) & (row <= 90)).sum())
                bars = int((row == 124).sum())
                shares = [(1, _share(again, n)), (2, _share(distinct, n)), (3, _share(capitals, len(row))),
                          (4, _share(bars, n)), (5, again.bit_length()), (6, bars.bit_length())]
            else:
                shares = [(7, 0)]
            extra = W.mix(np.array([k * 1000 + v for k, v in shares], dtype=np.uint64)) >> _LOWEST_BIT
            if n:
                # marks of heads that make up a share of the words, by steps of it
                heads, times = np.unique(np.concatenate(own[:len(_HEADS)]), return_counts=True)
                heads, times = heads[times > 1], times[times > 1]
                own += [W.mix(heads[times >= share * n] + np.uint64(step << 32)) >> _LOWEST_BIT
                        for step, share in enumerate(_HEAD_SHARES, 1)]
            yield np.unique(np.concatenate([*own, extra]).astype(np.int32))


def _word_marks(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    out = []
    for k in _HEADS:
        h = W.hash_words(part, s, np.minimum(e, s + k), lower=True) ^ (e - s < k).astype(np.uint64)
        out.append(W.mix(h + np.uint64(k)) >> _LOWEST_BIT)
    for k in _TAILS:
        out.append(W.mix(W.hash_words(part, np.maximum(s, e - k), e, lower=True) + np.uint64(100 + k)) >> _LOWEST_BIT)
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_ordinal(marks: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = 8, alpha: float = 0.5,
                l1: float = 0.5, l2: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark numbers, their non-zero weights, thresholds). Weights are at most 0:
    a mark can only lower a grade, so a long text does not make up for it. Only
    marks take part whose texts are mostly below the top grade (the lower
    two-sigma Wilson bound of that share is at least 0.6)."""
    # counts by mark, text by text: no second copy of all marks at any time
    numbers = max((int(m.max()) + 1 for m in marks if len(m)), default=0)
    texts, low = np.zeros(numbers, dtype=np.int32), np.zeros(numbers, dtype=np.int32)
    for m, below in zip(marks, grades < levels - 1):
        texts[m] += 1  # (a text's marks are distinct)
        if below:
            low[m] += 1
    used = [np.zeros(0, dtype=np.int32)]
    for k in range(0, numbers, 1 << 18):  # from here on only the telling marks, numbered anew
        at = np.flatnonzero(texts[k:k + (1 << 18)]) + k
        n = texts[at]
        share = low[at] / n
        bound = (share + 2 / n - 2 * np.sqrt(share * (1 - share) / n + 1 / n ** 2)) / (1 + 4 / n)
        used.append(at[bound >= 0.6].astype(np.int32))
    used = np.concatenate(used)
    del texts, low
    place = np.full(numbers, -1, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    rows = []
    for m in marks:
        own = place[m]
        rows.append(own[own >= 0])
    del place
    z, square = np.zeros(len(used)), np.zeros(len(used))
    share = np.array([(grades >= k).mean() for k in range(1, levels)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    cut = -np.log(share / (1 - share))
    cut = np.maximum.accumulate(cut + 1e-3 * np.arange(levels - 1))
    # every grade counts alike, up to a factor of four
    count = np.maximum(np.bincount(grades, minlength=levels), 1)
    weight = np.clip(len(grades) / levels / count, 0.5, 4.0)
    random = np.random.RandomState(seed)
    for epoch in range(epochs):
        rate = 0.05 / (1 + epoch)
        for r in random.permutation(len(rows)):
            x, y = rows[r], int(grades[r])
            w = -np.maximum(z[x] - l1, 0.0) / ((1.0 + np.sqrt(square[x])) / alpha + l2)
            score = w.sum()
            low = _sigmoid(score - cut[y - 1]) if y else 1.0
            high = _sigmoid(score - cut[y]) if y < levels - 1 else 0.0
            g = -(1.0 - low - high) * weight[y]
            sigma = (np.sqrt(square[x] + g * g) - np.sqrt(square[x])) / alpha
            z[x] += g - sigma * w
            square[x] += g * g
            p = max(low - high, 1e-9)
            if y:
                cut[y - 1] -= rate * weight[y] * min(low * (1 - low) / p, 5.0)
            if y < levels - 1:
                cut[y] += rate * weight[y] * min(high * (1 - high) / p, 5.0)
            if levels > 2:
                cut = np.maximum.accumulate(cut)
                cut[1:] = np.maximum(cut[1:], cut[:-1] + 1e-3)
    w = -np.maximum(z - l1, 0.0) / ((1.0 + np.sqrt(square)) / alpha + l2)
    score = np.array([w[x].sum() for x in rows])
    # thresholds with the grades' weights; but where those would turn away texts
    # without any telling mark (score 0), all texts count alike
    even, alike = fit_cuts(score, grades, levels, weight[grades]), fit_cuts(score, grades, levels, np.ones(len(score)))
    return used[w != 0], w[w != 0], np.maximum.accumulate(np.where(even < 0, even, alike))


def fit_cuts(score: np.ndarray, grades: np.ndarray, levels: int, weight: np.ndarray, steps: int = 400) -> np.ndarray:
    """Thresholds of the largest weighted likelihood for given scores."""
    share = np.clip([(grades >= k).mean() for k in range(1, levels)], 1e-3, 1 - 1e-3)
    cut = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    for _ in range(steps):
        edge = np.concatenate(([-np.inf], cut, [np.inf]))
        low, high = (np.where(np.isinf(e), np.where(e < 0, 1.0, 0.0), _sigmoid(score - np.where(np.isinf(e), 0.0, e)))
                     for e in (edge[grades], edge[grades + 1]))
        p = np.maximum(low - high, 1e-9)
        up = np.minimum(high * (1 - high) / p, 5.0)
        down = np.minimum(low * (1 - low) / p, 5.0)
        up, down = up * weight, down * weight
        slope = np.array([up[grades == k].sum() - down[grades == k + 1].sum() for k in range(levels - 1)])
        cut = np.maximum.accumulate(cut + 4.0 * slope / max(weight.sum(), 1.0))
        cut[1:] = np.maximum(cut[1:], cut[:-1] + 1e-3)
    return cut


@dataclass(frozen=True)
class OrdinalModel:
    """Thresholds and the broadcast non-zero weights. Without usable ratings
    there are no thresholds: every text then has a tail probability of 1."""

    cuts: tuple[float, ...]
    weights: object  # broadcast of (mark numbers ascending, weights)

    def score(self, text: Column) -> Column:
        weights = self.weights

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            index, value = weights.value
            out = np.zeros(len(column))
            if len(index):
                for r, m in enumerate(text_marks(column)):
                    at = np.minimum(np.searchsorted(index, m), len(index) - 1)
                    out[r] = value[at][index[at] == m].sum()
            return pa.array(out)

        return scored.asNondeterministic()(text)

    def expected(self, score: Column) -> Column:
        total = F.lit(0.0)
        for c in self.cuts:
            total = total + 1 / (1 + F.exp(F.lit(c) - score))
        return total

    def tail(self, score: Column, grade: int) -> Column:
        """P(grade at least ``grade``)."""
        if not 1 <= grade <= len(self.cuts):
            return F.lit(1.0) + score * 0
        return 1 / (1 + F.exp(F.lit(self.cuts[grade - 1]) - score))


def _marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, _RUN):
            batch = whole.slice(k, _RUN)
            marks = list(text_marks(batch.column(1)))
            offsets = np.concatenate(([0], np.cumsum([len(m) for m in marks], dtype=np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(marks)))],
                names=["grade", "marks"])
    pa.default_memory_pool().release_unused()


def _fit(levels: int):
    def fit(table: pa.Table) -> pa.Table:
        marks = []
        for lists in table.column("marks").chunks:  # views, not copies
            values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            marks += [values[bounds[r]:bounds[r + 1]] for r in range(len(lists))]
        index, weight, cut = fit_ordinal(marks, table.column("grade").to_numpy().astype(np.int64), levels)
        return pa.table({"mark": pa.array(np.concatenate((-1 - np.arange(len(cut)), index)), pa.int32()),
                         "weight": pa.array(np.concatenate((cut, weight)))})

    return fit


def fit_quality(docs: DataFrame, ratings: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text",
                grade_col: str = "grade", max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fit on documents with a rating 0 .. levels-1.

    Ratings that are null or out of range, ids that are null or in one of the
    tables only are ignored; several ratings of one id count as the lowest. A
    repeated document counts once per row. Other columns are not read. No usable
    rating: a model without weights (see ``OrdinalModel``).
    """
    spark = docs.sparkSession
    ship_package(spark)
    rated = (ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade"))
             .where(f"doc_id is not null and grade between 0 and {levels - 1}")
             .groupBy("doc_id").agg(F.min("grade").alias("grade")))
    # a share that leaves about max_rows of them, by a hash of the id
    total = rated.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30))
    if total > max_rows:
        rated = rated.where(part < int((1 << 30) * max_rows / total))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rated = F.broadcast(rated)  # at most about max_rows ids
    marks = texts.join(rated, "doc_id").select("grade", "text").mapInArrow(_marks_of, "grade int, marks array<int>")
    found = marks.withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(_fit(levels), "mark int, weight double").collect()
    cuts = tuple(r["weight"] for r in sorted((r for r in found if r["mark"] < 0), key=lambda r: -r["mark"]))
    rows = sorted((r["mark"], r["weight"]) for r in found if r["mark"] >= 0)
    weights = (np.array([m for m, _ in rows], dtype=np.int32), np.array([w for _, w in rows]))
    return OrdinalModel(cuts, spark.sparkContext.broadcast(weights))


def grade_documents(docs: DataFrame, model: OrdinalModel, select_grade: int, text_col: str = "text") -> DataFrame:
    """``docs`` with score, expected_grade and p_select = P(grade >= select_grade);
    a null text scores as an empty one. Repeated rows get equal scores. Refuses
    input that already has one of these columns."""
    if {"score", "expected_grade", "p_select"} & set(docs.columns):
        raise ValueError("docs has a column score, expected_grade or p_select")
    out = docs.withColumn("score", model.score(F.col(f"`{text_col}`").cast("string")))
    return (out.withColumn("expected_grade", model.expected(F.col("score")))
            .withColumn("p_select", model.tail(F.col("score"), select_grade)))


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels table: 0 low quality, 1 toxic, 2 neither."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
