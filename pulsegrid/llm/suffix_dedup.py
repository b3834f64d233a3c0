"""Passages that repeat across documents, found with a sparse suffix array.

Method. Suffixes are retained at minimiser positions only: among WINDOW consecutive GRAM-word grams the one with the least hash. The choice
depends on content alone, so two occurrences of a passage of `length` words retain the same suffix within their first WINDOW positions, with
``length - WINDOW + 1`` equal words to the right of it, its head.

The suffix array is sorted in two steps. Heads are dealt to owners, and those that only one row has are left out, as no passage of theirs repeats. The rest go
to their head's owner with the words that follow the head and those that precede the suffix, WINDOW - 1 on either side, as no passage that the suffix
stands for reaches further. There suffixes are sorted by all their words and neighbours compared, which gives the number of words that each has in common with the next
one. A match of two suffixes is then extended left: suffixes with ``length - a`` words to the right in common are neighbours in the array, and those of them with the same `a` words to the
left share the passage that begins `a` words before. The extents that a suffix shares with another row make spans; spans that touch are one.

Texts stay where they are, in blocks of bounded size; what leaves a block is each head, and each suffix with its words, once, however many of the block's rows have it, and
whether that are several. So an owner of a passage that a third of all rows hold gets it once from each block, and equal texts need no handling of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words
from pulsegrid.llm.shared import save_bucketed

GRAM = 8
WINDOW = 24
SIDE = WINDOW - 1
LENGTH = 50
DOCS_PER_OWNER = 4_000
BLOCK_BYTES = 16 << 20
#: Bytes of a word's hash that go to an owner; words are compared only where their suffixes have equal heads.
WORD_BYTES = 6
#: What a null doc_id counts as.
LAST = (1 << 63) - 1


def minimisers(part: words.Slice, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of each passage of `length` words within one text, and the retained suffix it belongs to, the leftmost of equal grams."""
    count = len(part.hashes)
    left = np.repeat(part.word_at[1:], np.diff(part.word_at)) - np.arange(count)
    starts = np.flatnonzero(left >= length)
    if not len(starts):
        return starts, starts
    grams = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    at = np.flatnonzero(left >= GRAM)
    grams[at] = part.runs(at, GRAM)
    place, width = np.arange(count), 1  # of the least gram among `width` from each position on

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[a] <= grams[b], a, b)

    while 2 * width <= WINDOW:
        place = lesser(place[: len(place) - width], place[width:])
        width *= 2
    return starts, lesser(place[starts], place[starts + WINDOW - width])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the block that they are in: those of a task, up to BLOCK_BYTES of text or one row."""
    from pyspark import TaskContext

    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        ends = np.cumsum(words.column_bytes(batch.column("text"))[1][1:] - words.column_bytes(batch.column("text"))[1][:-1])
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = int(np.searchsorted(ends, before + BLOCK_BYTES - held, "right"))
            last = max(last, first + (held == 0))
            if last > first:
                rows = batch.slice(first, last - first)
                held += int(ends[last - 1] - before)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, block)), *rows.columns], ["block", *rows.schema.names])
            if last < batch.num_rows:
                block, held = block + 1, 0
            first = last


def _distinct(block: pa.Table) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's distinct texts; of each row which it has; of each text the number of its rows and their least doc_id."""
    _, once, which, rows = np.unique(block.column("name").to_numpy(), return_index=True, return_inverse=True, return_counts=True)
    least = np.full(len(once), LAST)
    np.minimum.at(least, which, block.column("doc_id").fill_null(LAST).to_numpy())
    return block.column("text").take(pa.array(once)), which, rows, least


def _heads(texts: pa.ChunkedArray, length: int) -> Iterator[tuple[words.Slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice of the texts: the retained suffixes (word numbers), their texts and their heads' hashes."""
    for part in words.slices(texts):
        at = np.unique(minimisers(part, length)[1])
        yield part, at, np.searchsorted(part.word_at, at, "right") - 1, part.runs(at, length - SIDE)


def _once(text: np.ndarray, key: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key once: an entry that has it, the key, whether several rows have it, and their least doc_id. rows and least are the texts'."""
    order = np.lexsort((text, key))
    t, k = text[order], key[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    order, t, k, new_key = (x[new_key | np.concatenate([[True], t[1:] != t[:-1]])] for x in (order, t, k, new_key))
    first = np.flatnonzero(new_key)
    return order[first], k[first], np.add.reduceat(rows[t], first) > 1, np.minimum.reduceat(least[t], first)


def _dealt(owner: np.ndarray, **columns: np.ndarray) -> Iterator[tuple[int, dict[str, bytes]]]:
    """Each owner's entries, as bytes."""
    order = np.argsort(owner, kind="stable")
    cut = np.flatnonzero(np.diff(owner[order])) + 1
    for rows in np.split(order, cut) if len(order) else ():
        yield int(owner[rows[0]]), {name: np.ascontiguousarray(x[rows]).tobytes() for name, x in columns.items()}


_HEADS = pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())])
_CONTEXTS = pa.schema([("block", pa.int64()), ("owner", pa.int64()), *((n, pa.binary()) for n in ("keys", "names", "several", "least", "reach", "sides"))])
_MATCHED = pa.schema([("block", pa.int64()), ("keys", pa.binary())])
_EXTENTS = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("keys", "names", "extents", "least"))])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _table(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.table({f.name: pa.array([r[f.name] for r in rows], f.type) for f in schema}, schema)


def _deal_heads(length: int, owners: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        texts, _, rows, least = _distinct(block)
        found = [(part.first + text, key) for part, _, text, key in _heads(texts, length) if len(key)]
        if not found:
            return _table(_HEADS, [])
        _, key, several, _ = _once(*(np.concatenate(x) for x in zip(*found)), rows, least)
        dealt = _dealt((key % np.uint64(owners)).astype(np.int64), keys=key, several=several)
        return _table(_HEADS, [{"block": block.column("block")[0].as_py(), "owner": o, **x} for o, x in dealt])

    return run


def _column(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in group.column(name).to_pylist()])


def _match_heads(group: pa.Table) -> pa.Table:
    """For each block those of its heads that several rows have."""
    sizes = [len(x) // 8 for x in group.column("keys").to_pylist()]
    key, several = _column(group, "keys", "<u8"), _column(group, "several", bool)
    _, run, count = np.unique(key, return_inverse=True, return_counts=True)
    many = (count > 1) | (np.bincount(run, several) > 0)
    keep = many[run]
    ends = np.cumsum(sizes)
    rows = [{"block": b.as_py(), "keys": key[e - n : e][keep[e - n : e]].tobytes()} for b, n, e in zip(group.column("block"), sizes, ends)]
    return _table(_MATCHED, [r for r in rows if r["keys"]])


def _sides(part: words.Slice, at: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes: the words before them, nearest first, and those behind their heads (SIDE of each, 0 where the text ends); how many of each there are."""
    head = length - SIDE
    left = np.minimum(SIDE, at - part.word_at[text])
    right = np.minimum(SIDE, part.word_at[text + 1] - at - head)
    j = np.arange(SIDE)
    own = np.concatenate([at[:, None] - 1 - j, at[:, None] + head + j], 1)
    there = np.concatenate([j < left[:, None], j < right[:, None]], 1)
    return np.where(there, part.hashes[np.where(there, own, 0)], np.uint64(0)), left, right


def _name(key: np.ndarray, sides: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of a suffix with the words on its sides."""
    h = key + (left * 64 + right).astype(np.uint64)
    for j in range(sides.shape[1]):
        h = (h ^ sides[:, j]) * np.uint64(0x9E3779B97F4A7C15)
    return words.mix(h)


def _deal_contexts(length: int, owners: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, matched: pa.Table) -> pa.Table:
        if not block.num_rows or not matched.num_rows:
            return _table(_CONTEXTS, [])
        wanted = _column(matched, "keys", "<u8")
        texts, _, rows, least = _distinct(block)
        found = []
        for part, at, text, key in _heads(texts, length):
            keep = np.isin(key, wanted)
            at, text, key = at[keep], text[keep], key[keep]
            if len(at):
                sides, left, right = _sides(part, at, text, length)
                found.append((part.first + text, key, sides, left, right, _name(key, sides, left, right)))
        if not found:
            return _table(_CONTEXTS, [])
        text, key, sides, left, right, name = (np.concatenate(x) for x in zip(*found))
        at, name, several, least = _once(text, name, rows, least)
        reach = np.stack([left[at], right[at]], 1).astype(np.uint8)
        packed = np.ascontiguousarray(sides[at].astype("<u8")).view(np.uint8).reshape(len(at), -1, 8)[:, :, 8 - WORD_BYTES :]
        owner = (key[at] % np.uint64(owners)).astype(np.int64)
        dealt = _dealt(owner, keys=key[at], names=name, several=several, least=least, reach=reach, sides=packed)
        return _table(_CONTEXTS, [{"block": block.column("block")[0].as_py(), "owner": o, **x} for o, x in dealt])

    return run


def extents(key: np.ndarray, sides: np.ndarray, left: np.ndarray, right: np.ndarray, several: np.ndarray, least: np.ndarray):
    """Of each suffix the fewest and most words before it at which a passage begins that several rows have (-1 for none), and the least doc_id with one.

    sides: SIDE words to the left, nearest first, and SIDE words behind the head.
    """
    count = len(key)
    order = np.lexsort((*(sides[:, SIDE + j] for j in range(SIDE - 1, -1, -1)), key))
    key, sides, left, right, several = key[order], sides[order], left[order], right[order], several[order]
    # words behind the head that a suffix has in common with the one before it in the array; -1: not even the head
    equal = sides[1:, SIDE:] == sides[:-1, SIDE:]
    common = np.where(key[1:] == key[:-1], np.where(equal.all(1), SIDE, np.argmin(equal, 1)), -1)
    few, most, low = np.full(count, -1), np.full(count, -1), np.full(count, LAST)
    before = np.zeros(count, np.uint64)  # hash of the `a` words to the left
    own = least[order]
    for a in range(SIDE + 1):
        if a:
            before = words.mix((before ^ sides[:, a - 1]) * np.uint64(0x9E3779B97F4A7C15))
        able = np.flatnonzero((left >= a) & (right >= SIDE - a))
        if not len(able):
            continue
        run = np.concatenate([[0], np.cumsum(common < SIDE - a)])[able]
        by = np.lexsort((before[able], run))
        able, run = able[by], run[by]
        first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (before[able][1:] != before[able][:-1])]))
        size = np.diff(np.append(first, len(able)))
        met = np.repeat((size > 1) | np.maximum.reduceat(several[able], first), size)
        found = able[met]
        few[found] = np.where(few[found] < 0, a, few[found])
        most[found] = a
        low[found] = np.minimum(low[found], np.repeat(np.minimum.reduceat(own[able], first), size)[met])
    out = np.empty((3, count), np.int64)
    out[:, order] = few, most, low
    return out[0], out[1], out[2]


def _extend(group: pa.Table) -> pa.Table:
    """For each block the extents of its suffixes that share any with other rows."""
    sizes = [len(x) // 8 for x in group.column("keys").to_pylist()]
    key, name, least = _column(group, "keys", "<u8"), _column(group, "names", "<u8"), _column(group, "least", "<i8")
    reach = _column(group, "reach", np.uint8).reshape(-1, 2).astype(np.int64)
    wide = np.zeros((len(key), 2 * SIDE, 8), np.uint8)
    wide[:, :, 8 - WORD_BYTES :] = _column(group, "sides", np.uint8).reshape(len(key), 2 * SIDE, WORD_BYTES)
    few, most, low = extents(key, wide.view("<u8").reshape(len(key), -1), reach[:, 0], reach[:, 1], _column(group, "several", bool), least)
    rows = []
    for block, n, end in zip(group.column("block"), sizes, np.cumsum(sizes)):
        own = np.flatnonzero(most[end - n : end] >= 0) + end - n
        if len(own):
            extent = np.stack([few[own], most[own]], 1).astype(np.uint8)
            rows.append({"block": block.as_py(), "keys": key[own].tobytes(), "names": name[own].tobytes(), "extents": extent.tobytes(), "least": low[own].tobytes()})
    return _table(_EXTENTS, rows)


_SPANS = pa.schema([(n, pa.int64()) for n in ("doc_id", "start_word", "end_word", "n_words", "first_doc_id")])


def _spans(length: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return _table(_SPANS, [])
        wanted, name = _column(answers, "keys", "<u8"), _column(answers, "names", "<u8")
        extent, low = _column(answers, "extents", np.uint8).reshape(-1, 2).astype(np.int64), _column(answers, "least", "<i8")
        order = np.argsort(name)
        name, extent, low = name[order], extent[order], low[order]
        texts, which, _, _ = _distinct(block)
        found = []
        for part, at, text, key in _heads(texts, length):
            keep = np.isin(key, wanted)
            at, text, key = at[keep], text[keep], key[keep]
            if not len(at):
                continue
            own = _name(key, *_sides(part, at, text, length))
            i = np.minimum(np.searchsorted(name, own), len(name) - 1)
            keep = name[i] == own
            place, i = (at - part.word_at[text])[keep], i[keep]
            found.append((part.first + text[keep], place - extent[i, 1], place - extent[i, 0], low[i]))
        text, begin, last, low = (np.concatenate(x) for x in zip(*found)) if found else np.zeros((4, 0), np.int64)
        order = np.lexsort((begin, text))
        text, begin, last, low = text[order], begin[order], last[order], low[order]
        # the furthest passage begun so far in a text, by one running maximum over all
        stride = int(last.max(initial=0)) + length + 2
        reached = np.maximum.accumulate(last + text * stride)
        opens = np.flatnonzero(np.concatenate([[True], begin[1:] + text[1:] * stride > reached[:-1] + length])) if len(text) else np.zeros(0, np.int64)
        ends = np.append(opens[1:], len(text)) - 1
        of, start, end = text[opens], begin[opens], reached[ends] - text[opens] * stride + length
        low = np.minimum.reduceat(low, opens) if len(opens) else low
        # each row of the block has the spans of its text
        at = np.searchsorted(of, np.arange(len(texts) + 1))
        size = np.diff(at)[which]
        row = np.repeat(np.arange(len(which)), size)
        span = np.repeat(at[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
        doc = block.column("doc_id").take(pa.array(row))
        return pa.table([doc, *(pa.array(x[span]) for x in (start, end, end - start, low))], schema=_SPANS)

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id): spans of words that repeat across rows of docs(doc_id, text).

    A span is a maximal run of words (`[^\\x20\\x09-\\x0D]+`, numbered from 0, end exclusive) covered by or joining passages of `length`
    words (WINDOW + GRAM at least) that occur, word for word, in another row; repeats within one row alone don't count, repeated rows do. first_doc_id is
    the least doc_id with a passage of the span (null ids count as the largest long): a deduplicator cuts spans with first_doc_id < doc_id.
    Null, empty and shorter texts have no row; more columns are ignored; an empty table gives an empty result. Spans within a row that touch
    are one.
    """
    if length < WINDOW + GRAM:
        raise ValueError(f"length must be {WINDOW + GRAM} at least")
    spark = docs.sparkSession
    owners = max(16, -(-docs.count() // DOCS_PER_OWNER))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("name", F.xxhash64("text")).mapInArrow(_in_blocks, "block long, doc_id long, text string, name long")
    blocks = save_bucketed(text, "passages", "block", max(owners, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    by_block = blocks.groupBy("block")
    heads = by_block.applyInArrow(_deal_heads(length, owners), _sql(_HEADS))
    matched = heads.groupBy("owner").applyInArrow(_match_heads, _sql(_MATCHED))
    contexts = by_block.cogroup(matched.groupBy("block")).applyInArrow(_deal_contexts(length, owners), _sql(_CONTEXTS))
    answers = contexts.groupBy("owner").applyInArrow(_extend, _sql(_EXTENTS))
    schema = ", ".join(f"{f.name} long" for f in _SPANS)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_spans(length), schema)


ORACLE_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), passages AS (
  SELECT row, doc_id, p AS start_word, md5(array_to_string(words[p + 1 : p + 50], ' ')) AS passage
  FROM (SELECT row, doc_id, words, unnest(range(0, len(words) - 49)) AS p FROM texts WHERE len(words) >= 50)
), repeated AS (
  SELECT passage, min(doc_id) AS first_doc_id FROM passages GROUP BY passage HAVING count(DISTINCT row) > 1
), marked AS (
  SELECT row, doc_id, start_word, first_doc_id,
         CASE WHEN start_word <= lag(start_word) OVER (PARTITION BY row ORDER BY start_word) + 50 THEN 0 ELSE 1 END AS opens
  FROM passages JOIN repeated USING (passage)
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY row ORDER BY start_word) AS span FROM marked
)
SELECT doc_id, min(start_word)::BIGINT AS start_word, (max(start_word) + 50)::BIGINT AS end_word,
       (max(start_word) + 50 - min(start_word))::BIGINT AS n_words, min(first_doc_id)::BIGINT AS first_doc_id
FROM numbered GROUP BY row, doc_id, span
"""
