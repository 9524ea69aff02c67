"""Token ids in length-delimited binary records with masked checksums and an offset index beside them.

Record:  u64 length | u32 masked crc32 of the length bytes | payload | u32 masked crc32 of the payload
Payload: u8 flags (1: id is null) | u8 bytes an id | i64 id | u32 tokens | ids
Index:   magic | u64 records | one entry a record (id, null, offset, length, first token, tokens) | u32 masked crc32
Manifest: JSON, one entry a shard: its files, documents, tokens, bytes and the tokens before it.
All numbers are little-endian. A shard holds one range of ids, in order. Every attempt of a task writes
under names of its own, and the manifest names those that count, so nothing is ever renamed or replaced.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ship, shuffle_partitions
from .tokens import crc32_u32, tokenizer

MAGIC = b"SGIX0001"
HEAD, PAYLOAD = struct.Struct("<QI"), struct.Struct("<BBqI")
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u8"), ("start", "<u8"), ("tokens", "<u4")])
_MANIFEST = "shard int, path string, docs long, tokens long, bytes long"


def masked(data: bytes) -> int:
    """A crc32 turned and shifted, so that a checksum stored in checked data stays sound."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def frame(key: int | None, ids: bytes, width: int) -> bytes:
    """One record; ``ids`` are little-endian, ``width`` bytes each."""
    body = PAYLOAD.pack(key is None, width, key or 0, len(ids) // width) + ids
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", masked(size)) + body + struct.pack("<I", masked(body))


def write_shard(batches: Iterator[pa.RecordBatch], shard: int, out_dir: str, tokenizer_path: str, end_id: int) -> pa.RecordBatch:
    """Stream (id, text) batches to a record file and its index; returns the manifest row."""
    tok = tokenizer(tokenizer_path)
    store, root = _store(out_dir)
    store.create_dir(root, recursive=True)
    width, end = tok.dtype.itemsize, np.asarray([end_id], dtype=tok.dtype).tobytes()
    name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
    entries, parts, place, start, docs = [], [], 0, 0, 0
    with store.open_output_stream(f"{root}/{name}.rec") as f:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.encode(text.as_py()) + end
                record = frame(key, ids, width)
                f.write(record)
                n = len(ids) // width
                entries.append((key or 0, key is None, place, len(record) - HEAD.size - 4, start, n))
                place += len(record)
                start += n
                if len(entries) == 4096:  # packed, 37 bytes a document
                    parts.append(np.array(entries, dtype=ENTRY).tobytes())
                    entries.clear()
                    docs += 4096
    docs += len(entries)
    index = MAGIC + struct.pack("<Q", docs) + b"".join([*parts, np.array(entries, dtype=ENTRY).tobytes()])
    with store.open_output_stream(f"{root}/{name}.idx") as f:
        f.write(index + struct.pack("<I", masked(index)))
    return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "docs": [docs], "tokens": [start], "bytes": [place]})


def _writer(out_dir: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield write_shard(batches, TaskContext.get().partitionId(), out_dir, tokenizer_path, end_id)

    return write


def write_records(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None) -> tuple[str, list[dict]]:
    """Encode every text, append ``end_id``, and write shards in ascending order of ids.

    Returns the folder (by default one in shared storage) and its manifest, one entry a shard: the only
    thing that the driver gathers; it is written to the folder too. Null text is empty and has the end id
    alone; null ids come first; rows that share an id are ordered by text, and repeated rows are written
    each. Other columns are not written. An empty table writes no or empty shards.
    """
    spark = docs.sparkSession
    ship(spark)
    out_dir = out_dir or new_path(spark, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions or shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    shards = [r.asDict() for r in ordered.mapInArrow(_writer(out_dir, tokenizer_path, end_id), _MANIFEST).collect()]
    shards.sort(key=lambda s: s["shard"])
    first = 0
    for s in shards:
        s["first_token"] = first
        first += s["tokens"]
    store, root = _store(out_dir)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(shards).encode())
    return out_dir, shards


def read_manifest(out_dir: str) -> list[dict]:
    """The manifest of a folder that ``write_records`` made."""
    store, root = _store(out_dir)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_index(uri: str) -> np.ndarray:
    """The entries of one shard's index, its checksum checked."""
    store, path = _store(uri)
    with store.open_input_stream(path) as f:
        raw = f.read()
    if raw[:8] != MAGIC or struct.unpack("<I", raw[-4:])[0] != masked(raw[:-4]):
        raise ValueError(f"{uri}: the index is damaged")
    return np.frombuffer(raw[16:-4], dtype=ENTRY)


def parse_record(raw: bytes, entry) -> np.ndarray:
    """The ids of one record's bytes, by its index entry, lengths and checksums checked."""
    size, check = HEAD.unpack_from(raw)
    body = raw[HEAD.size : -4]
    if size != len(body) or check != masked(raw[:8]) or struct.unpack("<I", raw[-4:])[0] != masked(body):
        raise ValueError(f"record at {entry['offset']} is damaged")
    _, width, key, n = PAYLOAD.unpack_from(body)
    ids = np.frombuffer(body, dtype=f"<u{width}", offset=PAYLOAD.size)
    if len(ids) != n or key != entry["id"]:
        raise ValueError(f"record at {entry['offset']} does not fit its index")
    return ids


def read_entries(f, part: np.ndarray, most: int = 8 << 20) -> Iterator[np.ndarray]:
    """The ids of each entry's record; records that follow one another are read at once, about ``most`` bytes at a time."""
    ends = part["offset"] + part["length"] + HEAD.size + 4
    k = 0
    while k < len(part):
        j = k + 1
        while j < len(part) and part["offset"][j] == ends[j - 1] and ends[j] - part["offset"][k] <= most:
            j += 1
        first = int(part["offset"][k])
        f.seek(first)
        raw = f.read(int(ends[j - 1]) - first)
        for e, end in zip(part[k:j], ends[k:j]):
            yield parse_record(raw[int(e["offset"]) - first : int(end) - first], e)
        k = j


def read_shard(out_dir: str, path: str, first: int, with_ids: bool, shuffle_seed: int | None, size: int) -> Iterator[pa.RecordBatch]:
    """The records of one shard in batches of ``size``; ``first`` ids come before the shard."""
    index = read_index(f"{out_dir}/{path}.idx")
    store, root = _store(f"{out_dir}/{path}.rec")
    order = np.arange(len(index)) if shuffle_seed is None else np.random.default_rng([shuffle_seed, first]).permutation(len(index))
    with store.open_input_file(root) as f:
        for i in range(0, len(order), size):
            part = index[order[i : i + size]]
            ids = list(read_entries(f, part))
            out = {
                "doc_id": pa.array(part["id"], mask=part["null"].astype(bool)),
                "start": pa.array(part["start"].astype("i8") + first),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([crc32_u32(x) for x in ids], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


def read_records(spark: SparkSession, out_dir: str, manifest: list[dict] | None = None, with_ids: bool = True, shuffle_seed: int | None = None, batch: int = 512) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, read from the files.

    With ``shuffle_seed`` shards and the records in each come in a random order, read through the index.
    Without ``manifest`` the folder's own is read.
    """
    ship(spark)
    manifest = read_manifest(out_dir) if manifest is None else manifest

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for path, first in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                yield from read_shard(out_dir, path, first, with_ids, shuffle_seed, batch)

    shards = [(s["path"], s["first_token"]) for s in manifest if s["docs"]]
    if shuffle_seed is not None:
        np.random.default_rng(shuffle_seed).shuffle(shards)
    given = spark.createDataFrame(spark.sparkContext.parallelize(shards, max(1, len(shards))), "path string, first_token long")
    return given.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
