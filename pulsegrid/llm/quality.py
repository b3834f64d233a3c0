"""Quality rules: fixed base rules, and a calibrated logistic regression on hashed word and character n-grams.

Method. Word 1- and 2-grams and character 3- and 4-grams of a whole text are hashed into one weight table each; a document's score is
the mean weight of its word grams plus that of its character grams plus a bias. The weights are fitted by logistic loss to a
bounded sample of labelled rows, the scores are mapped to probabilities on held-out rows of the sample (Platt scaling), and
documents are scored in Arrow batches against a fixed threshold. The model is a table of fixed size, broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words

#: log2 of the size of either weight table.
TABLE_BITS = 17
#: Bound of the labelled rows that the classifier is fitted to; those with the least hash of doc_id.
TRAIN_ROWS = 2_000
#: Documents with a lower calibrated probability of good quality are rejected.
THRESHOLD = 0.5
#: A gram must be in so many documents of the sample (or a hundredth of a small sample) to have a weight.
LEAST_DOCS = 20
DAMPING = 1e-5
MIN_WORDS = 50
REPEAT_PERCENT = 50

_CHAR_START = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MASK = np.uint64((1 << TABLE_BITS) - 1)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another is equal to it, and whether an earlier one is."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    any_, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = equal
    any_[order[1:]] = equal
    any_[order[:-1]] |= equal
    return any_, earlier


def counts(part: words.Slice) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    start = _CHAR_START[part.data]
    blank = _BLANK[part.data]
    at, h = part.grams(3)
    row = np.searchsorted(part.word_at, at, "right") - 1
    again, _ = _repeated(words.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    covered = np.zeros(len(part.begin) + 3, bool)
    for j in range(3):
        covered[at[again] + j] = True
    breaks = np.flatnonzero(part.data == 0x0A)
    begins = np.unique(np.concatenate([part.text_at[:-1], breaks + 1]))
    begins = begins[begins < len(part.data)]
    line_row = np.searchsorted(part.text_at, begins, "right") - 1
    next_break = np.append(breaks, len(part.data))[np.searchsorted(breaks, begins)]
    ends = np.minimum(next_break, part.text_at[line_row + 1])
    has_word = np.searchsorted(part.begin, ends) > np.searchsorted(part.begin, begins)
    begins, ends, line_row = begins[has_word], ends[has_word], line_row[has_word]
    _, earlier = _repeated(words.mix(part.spans(begins, ends) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return {
        "n_words": np.diff(part.word_at),
        "word_chars": _per_row(start & ~blank, part.text_at),
        "n_symbols": _per_row(_SYMBOL[part.data], part.text_at),
        "n_dup_lines": np.bincount(line_row[earlier], minlength=part.rows),
        "n_repeat_words": _per_row(covered[: len(part.begin)], part.word_at),
    }


def _word_grams(part: words.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each word gram."""
    rows, slots = [part.row_of_word()], [part.hashes & _MASK]
    at, h = part.grams(2)
    rows.append(np.searchsorted(part.word_at, at, "right") - 1)
    slots.append(h & _MASK)
    return np.concatenate(rows), np.concatenate(slots).astype(np.int64)


def _char_grams(part: words.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each character gram."""
    begin = np.flatnonzero(_CHAR_START[part.data])
    bound = np.append(begin, len(part.data))
    row = np.searchsorted(part.text_at, begin, "right") - 1
    rows, slots = [], []
    for n in (3, 4):
        first = bound[: max(0, len(bound) - n)]
        inside = row[: len(first)] == row[n - 1 : n - 1 + len(first)]
        rows.append(row[: len(first)][inside])
        slots.append(part.spans(first[inside], bound[n:][: len(first)][inside]) & _MASK)
    return np.concatenate(rows), np.concatenate(slots).astype(np.int64)


def _mean_weight(weights: np.ndarray, row: np.ndarray, slot: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights[slot], rows) / np.maximum(1, np.bincount(row, minlength=rows))


@dataclass
class Model:
    """Weights of word and character grams, bias, and the calibration p = 1 / (1 + exp(-(a * score + b)))."""

    word: np.ndarray
    char: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, part: words.Slice) -> np.ndarray:
        score = self.bias + _mean_weight(self.word, *_word_grams(part), part.rows) + _mean_weight(self.char, *_char_grams(part), part.rows)
        return _sigmoid(self.a * score + self.b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as a sparse vector of mean counts; slots of the character table follow those of the word table."""
    for batch in batches:
        for part in words.slices(batch.column("text")):
            grams = []
            for table, (row, slot) in enumerate((_word_grams(part), _char_grams(part))):
                key, n = np.unique((row << (TABLE_BITS + 1)) + (table << TABLE_BITS) + slot, return_counts=True)
                total = np.bincount(row, minlength=part.rows)
                grams.append((key, n / total[key >> (TABLE_BITS + 1)]))
            key, value = (np.concatenate(x) for x in zip(*grams))
            order = np.argsort(key)
            key, value = key[order], value[order].astype("<f4")
            at = np.searchsorted(key >> (TABLE_BITS + 1), np.arange(part.rows + 1))
            slot = (key & ((1 << (TABLE_BITS + 1)) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(part.first, part.rows),
                    pa.array([slot[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                    pa.array([value[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                ],
                ["label", "slots", "values"],
            )


#: Entries of the sample that a step of the fit has in hand at once.
FIT_ENTRIES = 250_000


def _fit(slot: np.ndarray, value: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1e-6):
    """Weights and bias by AdaGrad on all rows, row weights given; and the scores of the rows.

    Grams of few documents are left out, as they would be learned by heart, and the damping keeps the rarer ones of the rest small. Sums run
    over some rows at a time, so that beside the sample itself little memory is needed.
    """
    tables = 2 << TABLE_BITS
    at = np.concatenate([[0], np.cumsum(size)])
    cuts = [0]
    while cuts[-1] < len(y):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + FIT_ENTRIES, "right")) - 1))

    def parts():
        """Rows a to b - 1: their bounds, the row of each entry, its slot and value."""
        for a, b in zip(cuts, cuts[1:]):
            inside = slice(at[a], at[b])
            yield a, b, np.repeat(np.arange(b - a), size[a:b]), slot[inside].astype(np.int64), value[inside]

    found, squares = np.zeros(tables, np.int64), np.zeros(tables)
    for _, _, _, s, v in parts():
        found += np.bincount(s, minlength=tables)
        squares += np.bincount(s, np.square(v, dtype=np.float64), tables)
    common = found >= max(2, min(LEAST_DOCS, len(y) // 100))
    scale = (common / np.sqrt(squares / len(y) + DAMPING)).astype(np.float32)
    w, bias, sum_w, sum_b = np.zeros(tables, np.float32), 0.0, np.full(tables, 1e-12), 1e-12
    for _ in range(rounds):
        g, total, weights = ridge * w.astype(np.float64), 0.0, w * scale
        for a, b, row, s, v in parts():
            gap = weight[a:b] * (_sigmoid(np.bincount(row, v * weights[s], b - a) + bias) - y[a:b])
            g += np.bincount(s, v * scale[s] * gap.astype(np.float32)[row], tables)
            total += gap.sum()
        sum_w += g * g
        w -= (0.1 * g / np.sqrt(sum_w)).astype(np.float32)
        sum_b += total**2
        bias -= 0.1 * total / np.sqrt(sum_b)
    weights = w * scale
    return weights, bias, np.concatenate([np.bincount(row, v * weights[s], b - a) for a, b, row, s, v in parts()]) + bias


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the calibration, by Newton's method with smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([score, np.ones(len(y))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ theta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


_MODEL_SQL = "word binary, char binary, bias double, a double, b double"


def _fit_rows(sample: pa.Table) -> pa.Table:
    """The sample's rows to one row with the model, or none where either class has under ten rows."""
    sample = sample.sort_by([("order", "ascending"), ("label", "ascending")])
    y = sample.column("label").to_numpy().astype(np.int64)
    slot, at = words.column_bytes(sample.column("slots"))
    value, _ = words.column_bytes(sample.column("values"))
    held = np.arange(len(y)) % 4 == 0
    out = {"word": [], "char": [], "bias": [], "a": [], "b": []}
    if min(y.sum(), len(y) - y.sum()) >= 10:
        # the rarer class weighs as much as the other
        weight = np.where(y == 1, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y[~held]).sum())) * ~held
        w, bias, score = _fit(slot.view("<u4"), value.view("<f4"), np.diff(at) // 4, y, weight)
        a, b = _platt(score[held], y[held])
        tables = [w[: 1 << TABLE_BITS].astype("<f4").tobytes(), w[1 << TABLE_BITS :].astype("<f4").tobytes()]
        out = {name: [v] for name, v in zip(out, [*tables, bias, a, b])}
    kinds = [pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
    return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds)})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model | None:
    """A model of labels(doc_id, `label` 0/1), fitted to at most `rows` labelled documents, the same at every run.

    Rows with a null are left out. None where either class has under ten documents: then there is nothing to learn. One task holds the sample's
    vectors, 2 MB a row at most whatever the texts' lengths, and fits them; the driver gets the model alone.
    """
    sample = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .dropna()
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    found = (
        docs.select("doc_id", "text")
        .dropna()
        .join(F.broadcast(sample), "doc_id")
        .select("label", "text", F.xxhash64("doc_id", "text").alias("order"))
        .mapInArrow(_with_order, "label int, order long, slots binary, values binary")
        .orderBy("order", "label")
        .limit(rows)
    )
    fitted = found.groupBy().applyInArrow(_fit_rows, _MODEL_SQL).first()
    if fitted is None:
        return None
    return Model(np.frombuffer(fitted.word, "<f4"), np.frombuffer(fitted.char, "<f4"), fitted.bias, fitted.a, fitted.b)


def _with_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for out in _vectors(iter([batch])):
            order = batch.column("order").slice(done, out.num_rows)
            done += out.num_rows
            yield pa.RecordBatch.from_arrays([out.column(0), order, out.column(1), out.column(2)], ["label", "order", "slots", "values"])


def quality_rules(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text; a null or empty text has none and fails the base rules. base_failed: under MIN_WORDS
    words, or over REPEAT_PERCENT of them within 3-word windows that occur twice or more in the text. kept: not base_failed and
    probability >= threshold; without a model (None) the probability is null and the base rules decide. Repeated rows, null doc_ids and more
    columns change nothing; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in words.slices(batch.column("text")):
                found = counts(part)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"])
                p = fitted.probability(part) if fitted else None
                kept = ~failed & (p >= threshold) if fitted else ~failed
                columns = [pa.array(v.astype(np.int64)) for v in found.values()]
                chance = pa.array(p, pa.float64()) if fitted else pa.nulls(part.rows, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, part.rows), *columns, pa.array(failed), pa.array(kept), chance],
                    ["doc_id", *found, "base_failed", "kept", "probability"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def quality_filter(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            keep = []
            for part in words.slices(batch.column(text)):
                found = counts(part)
                ok = (found["n_words"] >= MIN_WORDS) & (100 * found["n_repeat_words"] <= REPEAT_PERCENT * found["n_words"])
                keep.append(ok & (fitted.probability(part) >= threshold) if fitted else ok)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
