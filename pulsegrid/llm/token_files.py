"""Token ids as flat files: unsigned integers, 64-bit document offsets, read through memory maps.

Format. A part holds documents of a range of doc_id, in ascending order, as three files without headers, all little-endian: `.bin`, the ids of all its documents one after
the other (16 bits where the vocabulary allows, else 32); `.idx`, a 64-bit offset for each document and one more for the end, in
ids from the part's start; `.doc`, the 64-bit doc_ids. The manifest lists the parts in order with their bases, the prefix sums of the documents and ids
before each; a document's place in the whole is its part's base plus its offset. Parts are written by tasks under names of their own attempt, and
the manifest names those of tasks that ended well, so lost executors and repeated attempts leave the result whole.
"""

from __future__ import annotations

import json
import sys
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import save, shared_dir

DOCS_PER_PART = 8_000
#: Pieces of a generation that a worker keeps.
CACHED_WORDS = 450_000
READ_TOKENS = 2_000_000


_encoders: dict = {}


def _encoder(tokenizer_json: str, kind: str):
    """bytes of a text -> bytes of its ids. A worker process keeps its encoder from task to task.

    A tokenizer of the known steps (see _by_pieces) lower-cases, drops white space and never joins what white space or a full stop or comma parts
    from letters, so a text's ids are those of its pieces between ASCII white space. Each piece is encoded by the library when it is first met, one of small Latin-1 letters by its model
    alone, as no other step changes it; one with capitals, or with such a mark at its end, is made of pieces already met. Any other tokenizer gets whole texts.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    if (key := (hash(tokenizer_json), kind)) in _encoders:
        return _encoders[key]
    tokenizer = Tokenizer.from_str(tokenizer_json)
    code = "H" if kind == "<u2" else "I"

    def as_bytes(numbers: list[int]) -> bytes:
        ids = array(code, numbers)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def by_library(text: str) -> bytes:
        return as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)

    split = tokenizer.model.tokenize  # of one word, in the letters that stand for bytes
    byte_letters = str.maketrans({c: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if c.isalpha()})

    class Pieces(dict):
        """Ids of pieces in two generations: when one is full it becomes the older one, and what is used of that moves on."""

        older: dict = {}

        def __missing__(self, piece: bytes) -> bytes:
            if (ids := self.older.get(piece)) is None:
                ids = self.made(piece)
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
            return ids

        def made(self, piece: bytes) -> bytes:
            text = piece.decode()
            bare = text[:-1] if text[-1] in ".," else text
            if not (bare.isalpha() and max(bare) < "\u0100"):
                return by_library(text)
            # letters whose lower case is one letter, whatever stands around them
            if bare != text:
                return self[bare.encode()] + self[text[-1:].encode()]
            if (low := text.lower()) != text:
                return self[low.encode()]
            return as_bytes([t.id for t in split(text.translate(byte_letters))])

    known = Pieces()

    def encode(text: bytes) -> bytes:
        return b"".join(map(known.__getitem__, text.split()))

    _encoders.clear()
    _encoders[key] = encode if _by_pieces(json.loads(tokenizer_json)) else lambda text: by_library(text.decode())
    return _encoders[key]


#: The normaliser and pre-tokeniser for which texts may be cut at ASCII white space.
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS_OF = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _by_pieces(described: dict) -> bool:
    """Whether the tokenizer takes the known steps, and no added token holds white space or takes that beside it."""
    steps = ((described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        (described.get("normalizer") or {}).get("normalizers") == _NORMALISER
        and (steps.get("pattern"), steps.get("behavior"), steps.get("invert")) == ({"Regex": _WORDS_OF}, "Removed", True)
        and not described["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in described["added_tokens"])
    )


def _write(folder: str, tokenizer_json: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = arrow_fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        encode = _encoder(tokenizer_json, kind)
        end = np.array([end_id], kind).tobytes()
        width = len(end)
        docs = ids = nulls = 0
        opened = None
        for batch in batches:
            if opened is None:
                store.create_dir(root, recursive=True)
                opened = [store.open_output_stream(f"{root}/{name}.{x}") for x in ("bin", "idx", "doc")]
                opened[1].write(np.zeros(1, "<u8").tobytes())
            data = [encode(t) + end for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // width
            opened[0].write(b"".join(data))
            opened[1].write((ids + np.cumsum(sizes)).astype("<u8").tobytes())
            opened[2].write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
            docs, ids, nulls = docs + len(data), ids + int(sizes.sum()), nulls + batch.column(0).null_count
        if opened:
            for f in opened:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [docs], "ids": [ids], "nulls": [nulls]}, _PART)

    return run


_PART = pa.schema([("part", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("nulls", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> str:
    """Writes docs(doc_id, text) in ascending doc_id order (nulls first, equal ids by a hash of the text); gives the manifest's address.

    Every whole text is encoded by the library as loaded, with add_special_tokens=False, and ends with end_id (a special token's string in a text is
    its id, as the library has it); a null text is empty. Repeated rows are written
    each; more columns are ignored; an empty table gives a manifest without parts. The folder is a new one in the shared folder unless given, and must be
    one that all machines reach by its address. The tokenizer's file is read on the driver and goes with the tasks.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    vocabulary = max([end_id, *_added_ids(tokenizer_json)]) + 1
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    parts = max(1, -(-docs.count() // DOCS_PER_PART))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    order = F.asc_nulls_first("doc_id"), F.xxhash64("text")  # the ranges' bounds are sampled, so no text is part of them
    ordered = text.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = save(ordered.mapInArrow(_write(folder, tokenizer_json, end_id, kind), "part long, name string, docs long, ids long, nulls long"), "parts")
    listed, doc_base, id_base = [], 0, 0
    for p in written.orderBy("part").collect():  # a row for each part
        listed.append({"name": p.name, "docs": p.docs, "ids": p.ids, "nulls": p.nulls, "doc_base": doc_base, "id_base": id_base})
        doc_base, id_base = doc_base + p.docs, id_base + p.ids
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"kind": kind, "docs": doc_base, "ids": id_base, "parts": listed}).encode())
    return f"{folder}/manifest.json"


def _added_ids(tokenizer_json: str) -> Iterator[int]:
    described = json.loads(tokenizer_json)
    yield from described["model"]["vocab"].values()
    yield from (x["id"] for x in described.get("added_tokens", []))


def _map(store: arrow_fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's numbers; through a memory map where the store has files, so that only what is used is read."""
    if isinstance(store, arrow_fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _read(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                offsets = _map(store, f"{root}/{part['name']}.idx", "<u8").astype(np.int64)
                doc_ids = _map(store, f"{root}/{part['name']}.doc", "<i8")
                ids = _map(store, f"{root}/{part['name']}.bin", kind) if part["ids"] else np.zeros(0, kind)
                first = 0
                while first < part["docs"]:
                    last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_TOKENS, "right")) - 1)
                    at = offsets[first : last + 1]
                    raw = ids[at[0] : at[-1]].astype("<u4").tobytes()
                    cut = (4 * (at - at[0])).tolist()
                    mask = np.arange(first, last) < part["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(doc_ids[first:last]), pa.int64(), mask=mask),
                            pa.array(at[:-1] + part["id_base"]),
                            pa.array(np.diff(at)),
                            pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    first = last

    return run


def read_token_files(spark: SparkSession, manifest: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files; ids as little-endian unsigned 32-bit integers."""
    folder = manifest.rpartition("/")[0]
    store, path = arrow_fs.FileSystem.from_uri(manifest)
    with store.open_input_stream(path) as f:
        listed = json.loads(f.read())
    rows = [(p["name"], p["docs"], p["ids"], p["nulls"], p["id_base"]) for p in listed["parts"]]
    parts = spark.createDataFrame(rows, "name string, docs long, ids long, nulls long, id_base long")
    parts = parts.repartition(max(1, len(rows)), "name")
    return parts.mapInArrow(_read(folder, listed["kind"]), "doc_id long, start long, n_tokens long, ids binary")
