"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, links confirmed on full shingle sets.

Method. A document's set is its distinct n-word shingles. Sets a and b with similarity t or more differ in at most
``k = floor((1 - t) / (1 + t) * (|a| + |b|))`` shingles. The signature is one-permutation MinHash: a hash deals the shingles to
K chunks of BINS bins, and each bin keeps the b bits of its least shingle hash. A differing shingle changes one bin, so two such sets
have signatures at a Hamming distance of k bins at most. By pigeonhole, with K > k chunks, K - k chunks at least agree in all bins, and with
``errors = 1`` half as many chunks do, each chunk then being looked up once with each bin left out. Documents that agree in
a chunk are candidates, and *every* pair within the signature distance is one: no chance is involved. ``errors = 0`` looks chunks up as they are.

Chunks with too few shingles say little, and neither do common shingles (all texts with one licence line would meet there), so chunks with too few
uncommon shingles are not looked up; a document that is left with too few chunks for the guarantee deals its shingles anew under the next seed too,
until one seed suits it; under later seeds common shingles count too, and under the last all chunks are looked up. Of a linked pair either both stop at the same seed or the earlier one
meets the other there, as agreeing chunks hold the same shingles; so the guarantee holds whatever counts as common. That is
judged by a bounded sample: it saves comparisons, and no result depends on it.

K depends on the size class; a pair spans neighbouring classes at most, so each document is looked up in its own and the next class.

Candidates form clusters (connected components). One passage that many texts share can chain them into a cluster that grows faster than the table;
so clusters beyond one block are looked up anew, each on its own, by rare shingles: in any one order of all shingles, two sets of similarity t or more
share one of the first ``n - ceil(t * n) + 1`` of either. The order is by the number in a sample of these clusters, so what their documents have in
common comes last, and a cluster falls apart that only this holds together; no result depends on the sample. Links are confirmed within them on full sets, tile by tile: a cluster is
split into blocks of bounded size, one task compares two blocks through an inverted index, and gives a spanning forest of its links,
fewer rows than documents. Equal sets are one node from the start. No pair list of a group is ever made.

Disk. Of a large table the keys take more room than its texts. As two sets meet in one size class, the classes are looked up in several passes over the texts,
and a pass's keys go before the next one's come; so do tiles, in rounds that hold about as much text as the documents with candidates have.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm import words
from pulsegrid.llm.shared import connected_components, discard, fresh, join_unique, save

BINS = 6
BITS = 32
#: Wrong bins that a chunk may have, 0 or 1: the chunk is looked up once with each bin left out.
ERRORS = 1
#: How many more chunks there are than must agree, and how many uncommon shingles a looked-up chunk is asked for at most.
SPARE, MOST_SHINGLES = 0.08, 3
#: Seeds under which uncommon shingles count, and seeds in all: under those between all shingles count.
RARE_SEEDS, MAX_SEEDS = 3, 8
#: Shingles in at least COMMON_DOCS of the SAMPLE_DOCS sampled documents (of SAMPLE_SHINGLES at most) are common.
SAMPLE_DOCS = 5_000
SAMPLE_SHINGLES = 2_000
COMMON_DOCS = 5
TILE_SHINGLES = 1_000_000
TILE_DOCS = 5_000
DOCS_PER_OWNER = 6_000
FLUSH_KEYS = 1_000_000
KEY_BYTES = 5
#: Passes in which keys are looked up at most, each of so many keys at least; and the shingles of a round of tiles, if those of all documents with candidates aren't more.
PASSES, PASS_KEYS = 4, 10_000_000
ROUND_SHINGLES = 40_000_000
#: Beyond every size class.
NO_CLASS = 1 << 30
#: In lookups a document's name is the upper half of its node's. Nodes of one name, about documents / 2^32 of them, count as candidates of each other.
NAME_BITS = 32
#: Clusters beyond one block are looked up anew, so often at most, and while that makes at least half of their comparisons needless.
REFINEMENTS = 4
#: 64-bit words of the bitmap that tells which texts have candidates.
SIFT_WORDS = 1 << 17
_LOOKUPS_SQL = "owner long, nodes binary, counts binary, keys binary, links binary"


@lru_cache(maxsize=None)
def thin_share(mean: float, least: int, errors: int) -> float:
    """The share of chunks that hold under `least` shingles, with errors without their fullest bin, where `mean` shingles a chunk are dealt by chance."""
    bins = BINS if errors else 1
    top = int(mean + 10 * math.sqrt(mean)) + 10
    p = math.exp(-mean / bins) * np.cumprod(np.concatenate([[1.0], mean / bins / np.arange(1, top + 1)]))
    if not errors:
        return float(p[:least].sum())

    def within(most: int, under: int) -> float:
        """The chance that every bin holds `most` at most, and all together less than `under`."""
        d = np.ones(1)
        for _ in range(bins):
            d = np.convolve(d, p[: most + 1])
        return float(d[:under].sum())

    return sum(within(m, least + m) - (within(m - 1, least + m) if m else 0.0) for m in range(top + 1))


@lru_cache(maxsize=None)
def class_plan(size_class: int, percent: int, errors: int) -> tuple[int, int, int]:
    """(chunks, largest size, least shingles of a chunk) for the pairs that meet in a size class.

    Some more chunks than must agree. A chunk is looked up with as many shingles as leave the usual set, between the least and the largest of the
    two classes that meet here, enough chunks under the first seed.
    """
    largest = max(1, math.ceil((100 / percent) ** (size_class + 1)) - 1)
    must = chunks_needed(largest, largest, percent, errors)
    chunks = must + math.ceil(SPARE * must)
    usual = largest * (percent / 100) ** 1.5
    mean = usual / chunks
    spare = 1 - chunks_needed(int(usual), largest, percent, errors) / chunks
    fits = [n for n in range(MOST_SHINGLES, 1, -1) if must > 2 * n and thin_share(round(mean, 2), n, errors) <= 0.95 * spare]
    return chunks, largest, max(fits, default=1)


def chunks_needed(size, largest, percent: int, errors: int):
    """How many looked-up chunks suffice for a set of that size against any linked one up to the largest."""
    return (size + largest) * (100 - percent) // (100 + percent) // (errors + 1) + 1


def size_classes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """floor(log(size) / log(100 / percent)), by comparison with the class bounds, so that no rounding moves a size."""
    bounds, edge = [], 0
    while not bounds or bounds[-1] <= max(1, sizes.max(initial=1)):
        bounds.append(math.ceil((100 / percent) ** edge - 1e-9))
        edge += 1
    return np.searchsorted(np.array(bounds), sizes, "right") - 1


def node_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets; 0 for an empty one."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(words.mix(h + np.uint64(0x51_7C_C1_B7_27_22_0A_95)), out=sums[1:])
    size = np.diff(at).astype(np.uint64)
    name = words.mix((sums[at[1:]] - sums[at[:-1]]) ^ (size * np.uint64(0x9E3779B97F4A7C15)))
    return np.where(size == 0, np.uint64(0), np.maximum(name, np.uint64(1)))


def chunk_keys(
    h: np.ndarray, at: np.ndarray, percent: int, errors: int, common: np.ndarray = np.zeros(0, np.uint64), first: int = 0, end: int = NO_CLASS
) -> tuple[np.ndarray, np.ndarray]:
    """Row and lookup key of every chunk that is looked up in the size classes from `first` to before `end`, for sets given as hashes and offsets; `common` is sorted."""
    sizes = np.diff(at)
    rare = np.ones(len(h), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
    own = size_classes(sizes, percent)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for up in (0, 1):
        todo = np.flatnonzero((sizes > 0) & (own + up >= first) & (own + up < end))
        for seed in range(MAX_SEEDS):
            if not len(todo):
                break
            counted = rare if seed < RARE_SEEDS else np.ones(len(h), bool)
            todo = _deal(h, at, counted, todo, own + up, seed, percent, errors, rows, keys, last=seed == MAX_SEEDS - 1)
    return np.concatenate(rows), np.concatenate(keys)


def _deal(h, at, counted, todo, classes, seed, percent, errors, rows, keys, last) -> np.ndarray:
    """One seed for the sets `todo`; adds their keys, returns the sets that need another seed."""
    plans = {c: class_plan(int(c), percent, errors) for c in np.unique(classes[todo])}
    chunks, largest, least = (np.array([plans[c][i] for c in classes[todo]]) for i in range(3))
    sizes = np.diff(at)[todo]
    which = np.repeat(np.arange(len(todo)), sizes)
    hash_at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[todo], sizes)
    dealt = words.mix(h[hash_at] + np.uint64((0xA0761D6478BD642F * (seed + 1)) % (1 << 64)))
    base = np.concatenate([[0], np.cumsum(chunks)])
    slot = ((dealt >> np.uint64(32)) * chunks[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[which]
    low = words.mix(dealt)
    counted = counted[hash_at]
    place = slot * BINS + (low % np.uint64(BINS)).astype(np.int64)
    bins = np.full(base[-1] * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(bins, place, low)
    signature = (bins >> np.uint64(64 - BITS)).reshape(-1, BINS)
    held = np.bincount(place[counted], minlength=base[-1] * BINS).reshape(-1, BINS)
    row = np.repeat(np.arange(len(todo)), chunks)
    tag = words.mix(
        (np.arange(base[-1]) - base[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        + classes[todo][row].astype(np.uint64) * np.uint64(1 << 32)
        + np.uint64(seed)
    )
    parts = [words.mix(signature[:, j] + np.uint64((j + 1) << 40)) for j in range(BINS)]
    whole = sum(parts[1:], parts[0])
    # keys, each with the number of counted shingles in the bins that it is made of: a partner that agrees there holds the same ones
    picked = [(whole, held.sum(1))] if errors == 0 else [(whole - parts[j] + np.uint64(j + 1), held.sum(1) - held[:, j]) for j in range(BINS)]
    fewest = picked[0][1] if errors == 0 else held.sum(1) - held.max(1)  # whichever bin is left out
    thin = np.bincount(row[fewest < least[row]], minlength=len(todo))
    again = thin > chunks - chunks_needed(sizes, largest, percent, errors)
    # if no seed suits a set, its thin chunks are looked up too, so that nothing is missed
    every = again[row] if last else np.zeros(len(row), bool)
    for key, shingles in picked:
        look = (shingles >= least[row]) | every
        rows.append(todo[row[look]])
        keys.append(words.mix(key[look] ^ tag[look]))
    return todo[again]


def prefix_keys(h: np.ndarray, at: np.ndarray, percent: int, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lookup key of the first shingles of each set, by their counts and hashes, for its own and the next size class."""
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = np.zeros(len(h), np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, h), len(common) - 1)
        n = np.where(common[place] == h, counts[place], 0)
    mixed = words.mix(h)
    order = np.lexsort((mixed, n, owner))
    taken = np.arange(len(h)) - np.repeat(at[:-1], sizes) < np.repeat(sizes - -(-sizes * percent // 100) + 1, sizes)
    row, key = owner[taken], mixed[order][taken]
    classes = size_classes(sizes, percent)[row].astype(np.uint64)
    return np.concatenate([row, row]), np.concatenate([words.mix(key + words.mix(classes + np.uint64(up))) for up in (0, 1)])


def forest(h: np.ndarray, at: np.ndarray, percent: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with `block`, of those between block 0 and block 1 only."""
    count = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(count), size)
    _, code, df = np.unique(h, return_inverse=True, return_counts=True)
    shared = df[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    posted, starts = owner[order], np.searchsorted(code[order], np.arange(len(df) + 1))
    mine = np.searchsorted(owner, np.arange(count + 1))
    up = list(range(count))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    found = []
    for i in range(count):
        if block is not None and block[i]:
            continue
        c = code[mine[i] : mine[i + 1]]
        if not len(c):
            continue
        n = starts[c + 1] - starts[c]
        take = np.repeat(starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(posted[take], minlength=count)
        ok = 100 * both >= percent * (size[i] + size - both)
        if block is None:
            ok[: i + 1] = False
        else:
            ok &= block == 1
        for j in np.flatnonzero(ok):
            a, b = find(i), find(int(j))
            if a != b:
                up[b] = a
                found.append((i, int(j)))
    return found


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch.column("text"), lower=True):
                _, h, at = words.shingles(part, width)
                span = batch.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays(
                    [span.column("doc_id"), span.column("uid"), pa.array(np.diff(at)), _as_long(node_of(h, at))],
                    ["doc_id", "uid", "n_shingles", "node"],
                )

    return run


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch.column("text"), lower=True):
                _, h, at = words.shingles(part, width)
                _, once = np.unique(node_of(h, at), return_index=True)
                seen, n = np.unique(np.concatenate([h[at[i] : at[i + 1]] for i in once]), return_counts=True)
                yield pa.RecordBatch.from_arrays([_as_long(seen), pa.array(n)], ["h", "n"])

    return run


def _common(shown: DataFrame, one: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles of the sample, sorted, and their counts: at most SAMPLE_DOCS * SAMPLE_SHINGLES / COMMON_DOCS of them, copies aside."""
    sample = one.filter(F.col("n") <= SAMPLE_SHINGLES).select("uid")
    sample = sample.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE_DOCS)
    counted = shown.join(F.broadcast(sample), "uid").select("text").mapInArrow(_counted(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") >= COMMON_DOCS).toArrow()
    common, counts = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]


_LOOKUPS = pa.schema([("owner", pa.int64()), ("nodes", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("links", pa.binary())])


def pack_keys(keys: np.ndarray) -> bytes:
    """The upper KEY_BYTES bytes of each key; its owner has the rest. Equal keys stay equal; a chance match is only verified in vain."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :]).tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    wide[:, 8 - KEY_BYTES :] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").reshape(-1)


def _starred(node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with its least name, and pairs of the other names with a key and the least, each once, as name * 2^32 + least."""
    order = np.lexsort((node, key))
    node, key = node[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.repeat(node[first], np.diff(np.concatenate([first, [len(key)]])))
    met = node != least
    return node[first], key[first], np.unique(node[met].astype(np.uint64) << np.uint64(32) | least[met])


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs of _starred() that connect what all of them do: fewer than names."""
    names, at = np.unique(pairs.astype("<u8").view("<u4"), return_inverse=True)
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for i, (a, b) in enumerate(at.reshape(-1, 2).tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[b] = a
            keep.append(i)
    return pairs[np.array(keep, int)]


def _lookups(width: int, percent: int, errors: int | None, owners: int, common: Broadcast, first: int = 0, end: int = NO_CLASS):
    """For each owner of keys one row a flush: names, how many of its keys each has, and the keys; and links found within the flush.

    A key goes to its owner once a flush, with the least of its names; the others are linked to that one here. So an owner of a key that a third of all
    documents share receives it from each flush, not from each document. Texts meet within their `cluster` only, 0 for all, and in the size classes from `first`
    to before `end`; without `errors` by their rare shingles, in all classes.
    """

    def flush(nodes: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, key, links = _starred(np.concatenate(nodes), np.concatenate(keys))
        owner = (key % np.uint64(owners)).astype(np.int64)
        order = np.lexsort((node, owner))
        node, key, owner = node[order], key[order], owner[order]
        cut = np.flatnonzero(np.diff(owner)) + 1
        rows = [(int(links[0] % np.uint64(owners)), b"", b"", b"", spanning(links).astype("<u8").tobytes())] if len(links) else []
        for a, b in zip([0, *cut], [*cut, len(owner)]):
            own = node[a:b]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(np.concatenate([start, [b - a]])).astype("<u4")
            rows.append((int(owner[a]), own[start].astype("<u4").tobytes(), counts.tobytes(), pack_keys(key[a:b]), b""))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LOOKUPS)], schema=_LOOKUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, held = [], [], 0
        for batch in batches:
            for part in words.slices(batch.column("text"), lower=True):
                _, h, at = words.shingles(part, width)
                node = node_of(h, at)
                _, once = np.unique(node, return_index=True)  # copies are looked up once
                if errors is not None:
                    own = size_classes(np.diff(at), percent)[once]
                    once = once[(own + 1 >= first) & (own < end)]
                if not len(once):
                    continue
                size = np.diff(at)[once]
                take = np.repeat(at[once] - np.cumsum(size) + size, size) + np.arange(size.sum())
                sets = h[take], np.concatenate([[0], np.cumsum(size)])
                row, key = prefix_keys(*sets, percent, *common.value) if errors is None else chunk_keys(*sets, percent, errors, common.value[0], first, end)
                cluster = batch.column("cluster").slice(part.first, part.rows).to_numpy()[once].view(np.uint64)
                nodes.append((node[once] >> np.uint64(64 - NAME_BITS)).astype(np.uint32)[row])
                keys.append(key ^ words.mix(cluster)[row])
                held += len(key)
                if held >= FLUSH_KEYS:
                    yield from flush(nodes, keys)
                    nodes, keys, held = [], [], 0
        if held:
            yield from flush(nodes, keys)

    return run


def _meet(group: pa.Table) -> pa.Table:
    """(a, b): links that connect the names of an owner that share a key, and those that came along. Keys are sorted by parts, so that memory is that of a part."""
    joined = lambda c, kind: np.frombuffer(b"".join(x.as_buffer() for x in group.column(c)), kind)
    node = np.repeat(joined("nodes", "<u4"), joined("counts", "<u4"))
    packed = joined("keys", np.uint8).reshape(-1, KEY_BYTES)
    links = [joined("links", "<u8")]
    parts = max(1, min(256, -(-len(node) // FLUSH_KEYS)))
    part = (packed[:, -1].astype(np.uint16) * parts >> 8).astype(np.uint8)
    for i in range(parts):
        mine = np.flatnonzero(part == i)
        if len(mine):
            links.append(_starred(node[mine], unpack_keys(packed[mine].tobytes()))[2])
    links = spanning(np.unique(np.concatenate(links)))
    return pa.table({"a": _as_long(links >> np.uint64(32)), "b": _as_long(links & np.uint64(0xFFFFFFFF))})


def _tile(width: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        tile = group.column("ti")[0].as_py(), group.column("tj")[0].as_py()
        nodes = group.column("node").to_numpy()
        _, once = np.unique(nodes, return_index=True)
        group = group.take(pa.array(once))
        hs, sizes = [], []
        for part in words.slices(group.column("text"), lower=True):
            _, h, at = words.shingles(part, width)
            hs.append(h)
            sizes.append(np.diff(at))
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        block = None if tile[0] == tile[1] else (group.column("block").to_numpy() == tile[1]).astype(np.int8)
        name = group.column("node").to_numpy()
        for i, j in forest(np.concatenate(hs), at, percent, block):
            found_a.append(name[i])
            found_b.append(name[j])
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, errors: int = ERRORS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text); more columns are ignored.

    Linked: 100 * |a & b| >= percent * |a | b| over distinct `width`-word shingles, A-Z lower-cased; component_id is the least
    doc_id reachable, kept marks it. A null or wordless text has an empty set, is linked with nothing and kept. A null doc_id
    counts as larger than any other, so it is the component_id only where a component has no other. Repeated rows are equal sets, hence
    linked, and all rows with the least doc_id are kept. An empty table gives an empty result.
    """
    return _marked(docs, percent, width, errors).select("doc_id", "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, percent: int, width: int, errors: int, more: tuple[str, ...] = ()) -> DataFrame:
    """The rows of near_duplicates() with their uid, the hash of doc_id and text, and of their component what `more` names."""
    text = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    sized = save(
        text.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "uid").mapInArrow(
            _sizes(width), "doc_id long, uid long, n_shingles long, node long"
        ),
        "sized",
    )
    one = sized.filter("n_shingles > 0").groupBy("node").agg(F.min("uid").alias("uid"), F.max("n_shingles").alias("n"))
    one = save(one.withColumn("name", F.shiftrightunsigned("node", 64 - NAME_BITS)), "one")
    shown = text.select("uid", F.lit(0).cast("long").alias("cluster"), F.coalesce("text", F.lit("")).alias("text"))
    members = _candidates(shown, one, percent, width, errors)
    shown = save(_sifted(shown.drop("cluster"), members).join(members.select("uid", "node"), "uid"), "shown")
    members = _refined(members, shown, percent, width)
    roots = connected_components(_confirmed(shown.drop("uid"), members, percent, width))
    discard(shown)

    nodes = sized.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = nodes.join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    nodes = save(nodes, "nodes")
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_unique(nodes, roots, "root", "members", "inner").select("node", "component_id", "copies", *more)
    out = join_unique(sized, save(named, "named"), "node", "copies")
    least = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept"), "uid", *more)


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, without near-duplicates: of each component one with its least doc_id, of several texts
    with that doc_id, or none in the component with any, the one with the least hash.

    Of rows equal in doc_id and text one stays. Nulls and empty texts as in near_duplicates(); `__uid` must not be a column of docs.
    """
    kept = _marked(docs, percent, width, ERRORS, ("root",)).filter("kept")
    alone = F.when(F.col("n_shingles") == 0, F.col("uid"))  # linked with nothing
    chosen, place = fresh("__kept", docs.columns), fresh("__place", docs.columns)
    kept = kept.groupBy("root", alone.alias("alone")).agg(F.min("uid").alias(chosen)).select(chosen)
    rows = docs.join(kept, F.xxhash64("doc_id", "text") == F.col(chosen), "left_semi")
    again = Window.partitionBy(F.xxhash64("doc_id", "text")).orderBy("doc_id")
    return rows.withColumn(place, F.row_number().over(again)).filter(F.col(place) == 1).drop(place)


def _candidates(shown: DataFrame, one: DataFrame, percent: int, width: int, errors: int | None) -> DataFrame:
    """(uid, node, n, name, cluster) of the nodes in `one` that have candidates among those of their cluster in shown(uid, cluster, text)."""
    sent = one.sparkSession.sparkContext.broadcast(_common(shown, one, width))
    nodes, met = one.count(), []
    for first, end, share in [(0, NO_CLASS, 1.0)] if errors is None else _passes(one, percent, errors):
        owners = max(16, math.ceil(nodes * share / DOCS_PER_OWNER))
        keys = shown.select("cluster", "text").mapInArrow(_lookups(width, percent, errors, owners, sent, first, end), _LOOKUPS_SQL)
        met.append(save(keys.groupBy("owner").applyInArrow(_meet, "a long, b long"), "met"))
    found = connected_components(reduce(DataFrame.unionByName, met))
    for done in met:
        discard(done)
    found = found.select(F.col("node").alias("name"), F.col("root").alias("cluster"))
    found = save(found.unionByName(found.select(F.col("cluster").alias("name"), "cluster").distinct()), "found")
    shared = one.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").join(found, "name", "left_anti")
    found = found.unionByName(shared.select("name", F.col("name").alias("cluster")))
    return save(one.select("uid", "node", "n", "name").join(found, "name"), "members")


def _passes(one: DataFrame, percent: int, errors: int) -> list[tuple[int, int, float]]:
    """(first, end, share): the size classes that each pass looks up, every class in one of them, and its share of the keys. Classes and keys are
    estimated here, which decides only where passes end.
    """
    keys: Counter[int] = Counter()
    sizes = one.groupBy(F.floor(F.ln("n") / math.log(100 / percent)).cast("int").alias("c")).agg(F.count("*"))
    for own, docs in sizes.collect():
        for c in (own, own + 1):
            keys[c] += docs * class_plan(c, percent, errors)[0] * (BINS if errors else 1)
    total = sum(keys.values())
    count = max(1, min(PASSES, total // PASS_KEYS))
    shares, before = Counter(), 0
    starts: dict[int, int] = {}
    for c in sorted(keys):
        at = (2 * before + keys[c]) * count // (2 * total)
        starts.setdefault(at, c)
        shares[at] += keys[c] / total
        before += keys[c]
    firsts = [0, *list(starts.values())[1:]]
    return list(zip(firsts, [*firsts[1:], NO_CLASS], list(shares.values()) or [1.0]))


def _sifted(shown: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of `shown` without most of those whose uid no member has, so that a join need not move them: a bitmap of fixed size tells."""
    word, bit = F.pmod("uid", F.lit(SIFT_WORDS)), F.expr("shiftleft(1L, cast(pmod(shiftright(uid, 40), 64) as int))")
    bits = save(members.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "bits")
    return shown.join(F.broadcast(bits), (word == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0), "left_semi")


def _shape(members: DataFrame) -> DataFrame:
    """docs, sum_n and blocks of each cluster."""
    shape = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("sum_n"))
    return shape.withColumn("blocks", F.greatest(F.ceil(F.col("docs") / TILE_DOCS), F.ceil(F.col("sum_n") / TILE_SHINGLES)))


def _refined(members: DataFrame, shown: DataFrame, percent: int, width: int) -> DataFrame:
    """The members, with clusters beyond one block replaced by those of the candidates that they have on their own."""
    for _ in range(REFINEMENTS):
        large = save(_shape(members).filter("blocks > 1").select("cluster", "docs", "blocks"), "large")
        work = large.agg(F.sum(F.col("docs") * F.col("blocks"))).first()[0]
        if not work:
            break
        inside = save(members.join(large.select("cluster"), "cluster"), "inside")
        texts = shown.select("uid", "node", "text").join(inside.select("node", "cluster"), "node").select("uid", "cluster", "text")
        texts = save(texts, "texts")
        split = _candidates(texts, inside.select("uid", "node", "n", "name"), percent, width, None)
        discard(texts)
        members = save(members.join(large.select("cluster"), "cluster", "left_anti").unionByName(split.select(members.columns)), "members")
        if 2 * (_shape(split).filter("blocks > 1").agg(F.sum(F.col("docs") * F.col("blocks"))).first()[0] or 0) > work:
            break
    return members


def _confirmed(shown: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): links between nodes of the clusters, confirmed on the full sets of shown(node, text); enough of them to connect all that are linked."""
    shape = save(_shape(members), "shape")
    small = shape.filter("blocks = 1").agg(F.sum("sum_n"), F.sum("docs")).first()
    bins = max(1, math.ceil((small[0] or 0) / TILE_SHINGLES), math.ceil((small[1] or 0) / TILE_DOCS))
    placed = members.join(shape.select("cluster", "blocks"), "cluster")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.select(
        "node",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("cluster"),
        "blocks",
        block.alias("block"),
    )
    tiles = shown.join(placed, "node").select(
        "node",
        "text",
        "cluster",
        "block",
        F.col("blocks") > 1,
        F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"),
    )
    tiles = tiles.select(
        "node", "text", F.concat_ws(":", "(blocks > 1)", "cluster").alias("cluster"), "block",
        F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
    )
    mine, compared = shape.agg(F.sum("sum_n"), F.sum(F.col("sum_n") * F.col("blocks"))).first()
    rounds = max(1, math.ceil((compared or 0) / max(mine or 0, ROUND_SHINGLES)))
    turn, links = F.pmod(F.xxhash64("cluster", "ti", "tj"), F.lit(rounds)), []
    for i in range(rounds):
        links.append(save(tiles.filter(turn == i).groupBy("cluster", "ti", "tj").applyInArrow(_tile(width, percent), "a long, b long"), "links"))
    return reduce(DataFrame.unionByName, links)
