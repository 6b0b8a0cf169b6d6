"""Operator 3: token ids in binary shards, found by document key through a minimal perfect hash.

Layout of a store (a folder that every executor reaches):

* ``ids-SSSSSSSS.bin``   little-endian ids of all documents of a shard, in ascending key order, end id included;
* ``len-SSSSSSSS.bin``   one little-endian 8-byte length per document of the shard, in the same order;
* ``idx-PPPPPPPP.bin``   one index partition: header, pilots of the hash buckets, then one slot per distinct key;
* ``manifest.json``      id width, end id, number of index partitions, documents of and ids before each shard.

A key's index partition, bucket and slot follow from its XXH64 and the bucket's pilot; the slot keeps a 64-bit
fingerprint of the key with the place of its ids. A keyed read is three bounded reads whatever the store's size.

Defined cases: null text is an empty text (only the end id is written); a null key is stored first, under its own hash;
rows that repeat a key are stored one after the other, in the order of their texts' XXH64 and then of the texts, null
first, so that the store is the same each time, and one slot points at the whole run. A run may go on in the next shards:
rows of one key are split by the hash of their texts, and only rows alike in key and text, which are written as a stream,
share a shard whatever their number. An empty table gives a store without shards. Only the key and the text column are
read, so other columns may have any names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from .common import cut, prepare
from .encoding import default_vocabulary, encoder

#: Keys in an index partition, on average; an index task holds so many slots in memory.
KEYS_PER_PARTITION = 32_768
KEYS_PER_BUCKET = 4
SLOT = np.dtype([("print", "<u8"), ("shard", "<u4"), ("count", "<u4"), ("first", "<u8"), ("offset", "<u8")])
#: Number of buckets and of keys.
HEAD, HEAD_SIZE = "<QQ", 16
META = "key long, shard int, first long, offset long, n long"
#: A shard and a place in it as one number: more than all ids that fit in a shard.
SHARD = 1 << 44


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _write(uri: str, name: str, data: bytes) -> None:
    files, base = _open(uri)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, f"{base}/{name}")


def key_hash(key, seed: int = 0) -> int:
    data = b"null" if key is None else int(key).to_bytes(8, "little", signed=True)
    return xxhash.xxh64_intdigest(data, seed)


def _slot(h: int, pilot: int, n: int) -> int:
    return xxhash.xxh64_intdigest(h.to_bytes(8, "little"), pilot) % n


def build_mph(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pilots and the slot of each hash, a bijection on range(len(hashes)).

    Hash and displace: larger buckets first look for a pilot that sends their keys to free slots; a bucket of one
    takes any free slot, written as -slot-1 in place of a pilot.
    """
    n = len(hashes)
    buckets: list[list[int]] = [[] for _ in range(max(1, -(-n // KEYS_PER_BUCKET)))]
    for i, h in enumerate(hashes):
        buckets[h % len(buckets)].append(i)
    pilots, slots, used = np.zeros(len(buckets), "<i8"), np.zeros(n, "<i8"), bytearray(n)
    order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
    free = iter(())
    for at, b in enumerate(order):
        members = buckets[b]
        if len(members) == 1:
            if at == 0 or len(buckets[order[at - 1]]) > 1:
                free = iter([s for s in range(n) if not used[s]])
            slots[members[0]] = s = next(free)
            pilots[b] = -s - 1
            continue
        pilot = 0
        while members:
            trial = [_slot(hashes[i], pilot, n) for i in members]
            if len(set(trial)) == len(trial) and not any(used[s] for s in trial):
                for i, s in zip(members, trial):
                    slots[i], used[s] = s, 1
                pilots[b] = pilot
                break
            pilot += 1
    return pilots, slots


def _shard_writer(uri: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, files, lengths, shard, offset, first = encoder(vocabulary), None, [], None, 0, 0
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                shard = batch.column("shard")[0].as_py()
                files, base = _open(uri)
                own = f"{base}/.ids-{shard:08d}.{uuid.uuid4().hex}"
                out = files.open_output_stream(own)
            counts = []
            for text in batch.column("text"):
                data = coder.encode(text.as_py()) + end
                out.write(data)
                counts.append(len(data) // coder.dtype.itemsize)
            n = np.array(counts, "<u8")
            lengths.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.full(len(n), shard, "i4")), pa.array(np.arange(first, first + len(n))), pa.array(offset + np.cumsum(n).astype("i8") - n.astype("i8")), pa.array(n.astype("i8"))], names=["key", "shard", "first", "offset", "n"])
            first, offset = first + len(n), offset + int(n.sum())
        if files is not None:
            out.close()
            files.move(own, f"{base}/ids-{shard:08d}.bin")
            _write(uri, f"len-{shard:08d}.bin", np.concatenate(lengths).tobytes())

    return write


def _index_writer(uri: str):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        keys = [None if k is None else int(k) for k in pdf["key"]]
        hashes = [key_hash(k) for k in keys]
        pilots, slots = build_mph(hashes)
        table = np.zeros(len(keys), SLOT)
        table["print"][slots] = np.array([key_hash(k, 1) for k in keys], "u8")
        for name in ("shard", "count", "first", "offset"):
            table[name][slots] = pdf[name].to_numpy()
        _write(uri, f"idx-{part:08d}.bin", struct.pack(HEAD, len(pilots), len(keys)) + pilots.tobytes() + table.tobytes())
        return pd.DataFrame({"part": [part], "keys": [len(keys)]})

    return write


def _part(key, parts: int):
    """The same partition number in Spark and in Python: crc32 of the key's text. Keys cross into pandas as text, since
    pandas would turn integers with nulls into floats."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % parts


def part_of(key, parts: int) -> int:
    return (0 if key is None else zlib.crc32(str(int(key)).encode())) % parts


def write_store(docs: DataFrame, uri: str, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes docs into a store at uri and returns its manifest.

    One shuffle of the texts, by key range; a second one of a small row per key for the index. Only one number per
    shard comes to the driver.
    """
    vocabulary = vocabulary or default_vocabulary()
    files, base = _open(uri)
    files.create_dir(base, recursive=True)
    rows = prepare(docs).select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("key", "hash").sortWithinPartitions("key", "hash", "text").drop("hash").withColumn("shard", F.spark_partition_id())
    meta = cut(rows.mapInArrow(_shard_writer(uri, vocabulary, end_id), META))
    totals = {r["shard"]: (r["docs"], r["ids"]) for r in meta.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("ids")).collect()}
    at = F.col("shard").cast("long") * SHARD
    runs = meta.groupBy("key").agg(F.min(at + F.col("first")).alias("first"), F.min(at + F.col("offset")).alias("offset"), F.count(F.lit(1)).alias("count"))
    runs = runs.select("key", F.expr(f"first div {SHARD}").cast("int").alias("shard"), (F.col("first") % SHARD).alias("first"), (F.col("offset") % SHARD).alias("offset"), "count")
    parts = max(1, -(-sum(d for d, _ in totals.values()) // KEYS_PER_PARTITION))
    runs.withColumn("part", _part(F.col("key"), parts)).withColumn("key", F.col("key").cast("string")).groupBy("part").applyInPandas(_index_writer(uri), "part long, keys long").agg(F.sum("keys")).collect()
    before, starts = 0, {}
    for shard in sorted(totals):
        starts[shard], before = before, before + totals[shard][1]
    manifest = {"dtype": encoder(vocabulary).dtype.str, "end_id": end_id, "parts": parts, "docs": {str(k): totals[k][0] for k in sorted(totals)}, "starts": {str(k): v for k, v in starts.items()}, "ids": before}
    _write(uri, "manifest.json", json.dumps(manifest).encode())
    return manifest


def _pieces(place: dict, docs: dict[str, int]) -> Iterator[tuple[int, int, int, int]]:
    """(shard, first, offset, count) of the part of a run in each shard, from the place where it begins."""
    shard, first, offset, left = place["shard"], place["first"], place["offset"], place["count"]
    for own in sorted(int(k) for k in docs if int(k) >= shard):
        count = min(left, docs[str(own)] - first)
        if count:
            yield own, first, offset, count
        first, offset, left = 0, 0, left - count
        if not left:
            return


class TokenStore:
    """Keyed access to a store: `ids(key)` is the list of id arrays stored under the key, empty if there are none."""

    def __init__(self, uri: str):
        self._files, self._base = _open(uri)
        with self._files.open_input_file(f"{self._base}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.dtype = np.dtype(self.manifest["dtype"])

    def place(self, key) -> dict | None:
        name = f"{self._base}/idx-{part_of(key, self.manifest['parts']):08d}.bin"
        if self._files.get_file_info(name).type == pafs.FileType.NotFound:
            return None
        with self._files.open_input_file(name) as f:
            buckets, n = struct.unpack(HEAD, f.read_at(HEAD_SIZE, 0))
            h = key_hash(key)
            pilot = int(np.frombuffer(f.read_at(8, HEAD_SIZE + 8 * (h % buckets)), "<i8")[0])
            slot = -pilot - 1 if pilot < 0 else _slot(h, pilot, n)
            found = np.frombuffer(f.read_at(SLOT.itemsize, HEAD_SIZE + 8 * buckets + SLOT.itemsize * slot), SLOT)[0]
        return {k: int(found[k]) for k in SLOT.names} if int(found["print"]) == key_hash(key, 1) else None

    def ids(self, key) -> list[np.ndarray]:
        at = self.place(key)
        if at is None:
            return []
        found: list[np.ndarray] = []
        for shard, first, offset, count in _pieces(at, self.manifest["docs"]):
            with self._files.open_input_file(f"{self._base}/len-{shard:08d}.bin") as f:
                lengths = np.frombuffer(f.read_at(8 * count, 8 * first), "<u8").astype("i8")
            with self._files.open_input_file(f"{self._base}/ids-{shard:08d}.bin") as f:
                size = self.dtype.itemsize
                run = np.frombuffer(f.read_at(size * int(lengths.sum()), size * offset), self.dtype)
            found += np.split(run, np.cumsum(lengths)[:-1])
        return found


def _finder(uri: str, docs: dict[str, int]):
    """Places of keys, one for each shard that a key's run lies in: an index partition is read once, then each key costs one pilot and one slot."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        files, base = _open(uri)
        name = f"{base}/idx-{int(pdf['part'].iloc[0]):08d}.bin"
        rows = []
        if files.get_file_info(name).type != pafs.FileType.NotFound:
            with files.open_input_file(name) as f:
                data = f.read()
            buckets, n = struct.unpack_from(HEAD, data)
            pilots = np.frombuffer(data, "<i8", buckets, HEAD_SIZE)
            slots = np.frombuffer(data, SLOT, n, HEAD_SIZE + 8 * buckets)
            for k in pdf["key"]:
                key = None if k is None else int(k)
                h = key_hash(key)
                pilot = int(pilots[h % buckets])
                found = slots[-pilot - 1 if pilot < 0 else _slot(h, pilot, n)]
                if int(found["print"]) == key_hash(key, 1):
                    rows += [(k, *piece) for piece in _pieces({x: int(found[x]) for x in ("shard", "first", "offset", "count")}, docs)]
        return pd.DataFrame(rows, columns=["key", "shard", "first", "offset", "count"])

    return find


def _reader(uri: str, manifest: dict):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _open(uri)
        dtype, at, ids, lens = np.dtype(manifest["dtype"]), None, None, None
        for pdf in batches:
            rows = []
            for key, shard, first, offset, count in pdf[["key", "shard", "first", "offset", "count"]].itertuples(index=False):
                if shard != at:
                    for f in (ids, lens):
                        if f is not None:
                            f.close()
                    at, ids, lens = shard, files.open_input_file(f"{base}/ids-{shard:08d}.bin"), files.open_input_file(f"{base}/len-{shard:08d}.bin")
                start = manifest["starts"][str(shard)] + offset
                place = dtype.itemsize * offset
                for done in range(0, count, 4096):
                    for n in np.frombuffer(lens.read_at(8 * min(4096, count - done), 8 * (first + done)), "<u8").tolist():
                        got = np.frombuffer(ids.read_at(dtype.itemsize * n, place), dtype)
                        rows.append((key, start, n, zlib.crc32(got.astype("<u4").tobytes())))
                        start, place = start + n, place + dtype.itemsize * n
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_store(keys: DataFrame, uri: str, manifest: dict, id_col: str = "doc_id") -> DataFrame:
    """Looks up every distinct key through the index, then reads the shards in order.

    Returns doc_id, start, n_tokens and ids_crc32 for each stored document of each key; unknown keys give no row.
    """
    parts = manifest["parts"]
    asked = keys.select(F.col(id_col).cast("long").alias("key")).distinct().withColumn("part", _part(F.col("key"), parts)).withColumn("key", F.col("key").cast("string"))
    places = asked.groupBy("part").applyInPandas(_finder(uri, manifest["docs"]), "key string, shard int, first long, offset long, count long")
    ordered = places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    found = ordered.mapInPandas(_reader(uri, manifest), "doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
