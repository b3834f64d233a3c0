"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Method. Pre-tokens are taken out of every whole text with their positions. A block, some thousand documents of one task, numbers
its distinct pre-tokens; a document's positions are then a column of numbers. The distinct words of all blocks are shuffled to
their owner (by a hash of the word), which encodes each distinct word once. The ids return to the blocks, where each document
is reassembled by position. Decoding joins ids with the token-byte table, whose size is that of the vocabulary.

A word that fills the corpus reaches its owner once from each block, so no word is hot. Blocks end at a bound of tokens or of
distinct words, and owners number as the documents, so the memory of a task doesn't grow with the input.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import save_bucketed

BLOCK_TOKENS = 5_000_000
BLOCK_WORDS = 300_000
CHUNK_TOKENS = 500_000
DOCS_PER_OWNER = 4_000

_STATIONS = "block long, owner long, doc_ids array<long>, sizes array<long>, payload binary, words binary, numbers binary"
_STATIONS_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("owner", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("payload", pa.binary()),
        ("words", pa.binary()),
        ("numbers", pa.binary()),
    ]
)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: each line has a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as four byte planes, compressed: small numbers leave the upper planes empty."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").reshape(n)


def pack_words(found: list[bytes]) -> bytes:
    sizes = pack(np.fromiter(map(len, found), np.uint32, len(found)))
    joined = b"".join(found)
    return len(sizes).to_bytes(8, "little") + sizes + len(joined).to_bytes(8, "little") + pa.compress(joined, "zstd", asbytes=True)


def unpack_words(blob: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(blob[:8], "little")
    sizes = unpack(blob[8:at])
    joined = pa.decompress(blob[at + 8 :], int.from_bytes(blob[at : at + 8], "little"), "zstd", asbytes=True) if len(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[begin : begin + size], one after the other."""
    total = int(size.sum())
    return flat[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(total)]


def _pretokens(pattern, text: str) -> Iterator[list[str]]:
    """In one list, or for a very long text in several, so that its words aren't all held at once."""
    if len(text) < 1_000_000:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while some := list(islice(found, 200_000)):
        yield some


def _stations(pattern_text: str, owners: int) -> Callable:
    """Tokenises: rows with documents (doc_ids, sizes, payload) and rows with a block's words for one owner (words, numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        pattern = regex.compile(pattern_text)
        task = TaskContext.get().partitionId() << 32
        block, numbers, ids, sizes, held, total = 0, _Numbers(), [], [], [], 0

        def row(**values) -> pa.RecordBatch:
            full = {"block": task + block} | values
            return pa.RecordBatch.from_arrays([pa.array([full.get(f.name)], f.type) for f in _STATIONS_ARROW], schema=_STATIONS_ARROW)

        def documents() -> pa.RecordBatch:
            every = np.concatenate(held) if held else np.zeros(0, np.uint32)
            return row(doc_ids=ids, sizes=sizes, payload=pack(every))

        def dictionary() -> Iterator[pa.RecordBatch]:
            by_owner = defaultdict(lambda: ([], []))
            for raw, n in sorted((word.encode(), n) for word, n in numbers.items()):  # neighbours compress well
                words, ns = by_owner[zlib.crc32(raw) % owners]
                words.append(raw)
                ns.append(n)
            for owner, (words, ns) in by_owner.items():
                yield row(owner=owner, words=pack_words(words), numbers=pack(np.array(ns, np.uint32)))

        in_chunk = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 0
                for words in _pretokens(pattern, text):
                    held.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                    n += len(words)
                ids.append(doc_id)
                sizes.append(n)
                in_chunk, total = in_chunk + n, total + n
                full = total >= BLOCK_TOKENS or len(numbers) >= BLOCK_WORDS
                if full or in_chunk >= CHUNK_TOKENS or len(ids) >= 50_000:
                    yield documents()
                    ids, sizes, held, in_chunk = [], [], [], 0
                if full:
                    yield from dictionary()
                    block, numbers, total = block + 1, _Numbers(), 0
        if ids:
            yield documents()
        yield from dictionary()

    return run


def _owner(ranks_file: Broadcast, pattern_text: str) -> Callable:
    """Encodes each distinct word of an owner once, and answers each block."""

    def run(group: pa.Table) -> pa.Table:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern_text, mergeable_ranks=ranks_file.value, special_tokens={})
        known: dict[bytes, np.ndarray] = {}
        blobs = []
        for words in group.column("words").to_pylist():
            found = []
            for word in unpack_words(words):
                if (got := known.get(word)) is None:
                    known[word] = got = encoding.encode_ordinary(word.decode())
                found.append(got)
            counts = np.fromiter(map(len, found), np.uint32, len(found))
            flat = np.fromiter((i for got in found for i in got), np.uint32, int(counts.sum()))
            blobs.append((pack(counts), pack(flat)))
        return pa.table(
            {
                "block": group.column("block").combine_chunks(),
                "numbers": group.column("numbers").combine_chunks(),
                "counts": pa.array([c for c, _ in blobs], pa.binary()),
                "flat": pa.array([f for _, f in blobs], pa.binary()),
            }
        )

    return run


def _bytes_of(tokens: np.ndarray, table: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """The bytes of ids by the token-byte table, and where each id's bytes end."""
    joined, size = table
    begin = np.cumsum(size) - size
    ends = np.cumsum(size[tokens])
    flat = np.frombuffer(joined, np.uint8)
    parts = [gather(flat, begin[t], size[t]).tobytes() for t in np.array_split(tokens, max(1, len(tokens) // 200_000))]
    return b"".join(parts), ends


def _reassemble(table: Broadcast | None) -> Callable:
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        numbers = [unpack(b) for b in answers.column("numbers").to_pylist()]
        counts = [unpack(b) for b in answers.column("counts").to_pylist()]
        flat = np.concatenate([unpack(b) for b in answers.column("flat").to_pylist()] or [np.zeros(0, np.uint32)])
        number, count = (np.concatenate(x or [np.zeros(0, np.uint32)]).astype(np.int64) for x in (numbers, counts))
        begin, size = np.zeros((2, len(number)), np.int64)
        size[number] = count
        begin[number] = np.cumsum(count) - count
        out = []
        for i in range(documents.num_rows):
            positions = unpack(documents.column("payload")[i].as_py())
            per_word = size[positions]
            tokens = gather(flat, begin[positions], per_word)
            sizes = np.array(documents.column("sizes")[i].as_py(), np.int64)
            ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum(sizes)]
            raw = tokens.astype("<u4").tobytes()
            starts = np.concatenate([[0], ends[:-1]])
            columns = {
                "doc_id": documents.column("doc_ids")[i].values,
                "n_tokens": pa.array(ends - starts),
                "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
            }
            if table is not None:
                text, at = _bytes_of(tokens.astype(np.int64), table.value)
                at = np.concatenate([[0], at])
                columns["decoded"] = pa.array([text[a:b] for a, b in zip(at[starts].tolist(), at[ends].tolist())], pa.binary())
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of docs(doc_id, text); ids are little-endian unsigned 32-bit integers.

    Each match of `pattern` is encoded separately, without special tokens: their strings are ordinary text. With `decoded`, the bytes of
    the ids by the token-byte table are a further column, as decode() adds it. A null text is empty and has no ids; repeated
    rows, null doc_ids and texts of any length are rows like others; more columns are ignored; an empty table gives an empty
    result. The rank file is read on the driver and sent to the executors (as large as the vocabulary).

    What the blocks hold is a table bucketed by block in the shared folder, so the documents' positions aren't shuffled to meet their ids.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    owners = max(16, -(-docs.count() // DOCS_PER_OWNER))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    stations = save_bucketed(text.mapInArrow(_stations(pattern, owners), _STATIONS), "stations", "block", max(owners, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    answers = (
        stations.filter("owner is not null")
        .select("block", "owner", "words", "numbers")
        .groupBy("owner")
        .applyInArrow(_owner(ranks, pattern), "block long, numbers binary, counts binary, flat binary")
    )
    documents = stations.filter("owner is null").select("block", "doc_ids", "sizes", "payload")
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    table = token_table(spark, ranks_path) if decoded else None
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reassemble(table), schema)


def token_table(spark: SparkSession, ranks_path: str) -> Broadcast:
    """The token-byte table: all tokens' bytes in the order of their ids, and where each begins."""
    ranks = read_ranks(ranks_path)
    size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return spark.sparkContext.broadcast((b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), size))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded`, the bytes of the ids, to a table with `ids`; null ids give empty bytes, an unknown id is an error."""
    table = token_table(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            decoded = [_bytes_of(np.frombuffer(i or b"", "<u4").astype(np.int64), table.value)[0] for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "decoded binary"])
    return encoded.select(*(f"`{f.name}`" for f in fields)).mapInArrow(run, schema)
