"""Packed blocks as binary shards: a Spark data source that writes them in two phases and reads them back.

Layout below the path: ``<column>/<first seq_id>-<attempt>.bin``, little-endian values of consecutive blocks without header, and
``_manifest.json``, which lists the shards that count. Tasks write files under names of their own; only the commit,
by replacing the manifest in one step, makes those of the successful attempts count, so a repeated or speculative task adds
nothing, readers never see half a table, and nothing is renamed or copied. Files no manifest lists are removed by the commit.

Files go through ``pyarrow.fs`` (local or mounted paths, HDFS, S3, GCS); no task needs another's disk. Shards are bounded by ``BLOCKS``
blocks, the driver holds one short entry per shard.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "token_shards"
BLOCKS = 1 << 16
READ_BYTES = 4 << 20
MANIFEST = "_manifest.json"
# 16 and 32 bits without sign for ids, 8 bits for masks.
ELEMENTS = {"H": "<u2", "I": "<u4", "B": "u1"}


def write(blocks: DataFrame, path: str, columns: dict[str, str], mode: str = "error", shard_blocks: int = BLOCKS) -> None:
    """Write array ``columns`` (name to H, I or B) of ``(seq_id, ...)``; all arrays of a column are of one length.

    A shard holds consecutive blocks of one range of ``shard_blocks`` numbers; ranges are dealt to tasks by hash, so the blocks are
    computed once and nothing is sampled. ``mode``: ``append`` adds shards, ``overwrite`` replaces the table,
    ``error`` refuses a path that holds one. An empty table is written as one without shards.
    """
    blocks.sparkSession.dataSource.register(TokenShards)
    if mode not in ("append", "overwrite", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "error" and _manifest(path) is not None:
        raise FileExistsError(path)
    dealt = blocks.select("seq_id", *columns).repartition(F.expr(f"seq_id div {shard_blocks}")).sortWithinPartitions("seq_id")
    options = {"columns": json.dumps(columns), "shard_blocks": str(shard_blocks)}
    dealt.write.format(FORMAT).options(**options).mode("overwrite" if mode == "overwrite" else "append").save(path)


def read(spark: SparkSession, path: str, *columns: str, raw: bool = False) -> DataFrame:
    """Blocks as ``(seq_id, <column>...)``, only the ``columns`` named (all without names); ``raw`` gives the bytes of each."""
    spark.dataSource.register(TokenShards)
    return spark.read.format(FORMAT).option("columns", json.dumps(columns)).option("raw", str(raw).lower()).load(path)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    system, root = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system, root.rstrip("/")


def _manifest(path: str) -> dict | None:
    system, root = _open(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{root}/{MANIFEST}") as source:
        return json.loads(source.read())


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _table(self) -> dict:
        found = _manifest(self.options["path"])
        if found is None:
            raise FileNotFoundError(f"{self.options['path']} holds no {MANIFEST}")
        return found

    def _names(self, table: dict) -> list[str]:
        asked = json.loads(self.options.get("columns", "[]"))
        unknown = set(asked) - set(table["columns"])
        if unknown:
            raise ValueError(f"no column {sorted(unknown)} in {self.options['path']}")
        return list(asked or table["columns"])

    def schema(self) -> str:
        # Spark asks for a schema before the first write too, when there is no table.
        table = self._table()
        kind = "binary" if self.options.get("raw") == "true" else "array<bigint>"
        return ", ".join(["seq_id bigint", *(f"`{name}` {kind}" for name in self._names(table))])

    def reader(self, schema: StructType) -> DataSourceReader:
        table = self._table()
        return ShardReader(self.options["path"], table, self._names(table), self.options.get("raw") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self.options["path"], json.loads(self.options["columns"]), int(self.options.get("shard_blocks", BLOCKS)), overwrite)


@dataclass
class Written(WriterCommitMessage):
    """What one attempt wrote: shards as ``[first, blocks, name]`` and the length of each column's arrays."""

    shards: list
    lengths: dict


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: dict[str, str], shard_blocks: int, overwrite: bool):
        self.path, self.columns, self.shard_blocks, self.overwrite = path, columns, shard_blocks, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        attempt = uuid.uuid4().hex
        done = Written([], {})
        streams: dict[str, pa.NativeFile] = {}
        following = None
        try:
            for batch in iterator:
                numbers = batch.column(batch.schema.get_field_index("seq_id")).to_numpy(zero_copy_only=False)
                if not len(numbers):
                    continue
                cut = np.flatnonzero((np.diff(numbers) != 1) | (numbers[1:] % self.shard_blocks == 0)) + 1
                payload = {name: _encoded(batch.column(batch.schema.get_field_index(name)), name, kind, done.lengths) for name, kind in self.columns.items()}
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(numbers)]):
                    first = int(numbers[a])
                    if first != following or first % self.shard_blocks == 0:
                        _close(streams)
                        if done.shards and first == following - 1:
                            raise ValueError(f"block {first} occurs twice")
                        name = f"{first:015d}-{attempt}.bin"
                        for column in self.columns:
                            system.create_dir(f"{root}/{column}", recursive=True)
                            streams[column] = system.open_output_stream(f"{root}/{column}/{name}")
                        done.shards.append([first, 0, name])
                    for column in self.columns:
                        streams[column].write(payload[column][a:b].tobytes())
                    done.shards[-1][1] += b - a
                    following = first + b - a
        finally:
            _close(streams)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        table = None if self.overwrite else _manifest(self.path)
        table = table or {"columns": self.columns, "lengths": {}, "shards": []}
        if table["columns"] != self.columns:
            raise ValueError(f"{self.path} holds columns {table['columns']}, not {self.columns}")
        for message in filter(None, messages):
            for column, length in message.lengths.items():
                if table["lengths"].setdefault(column, length) != length:
                    raise ValueError(f"arrays of {column} have {length} elements, others {table['lengths'][column]}")
            table["shards"] += message.shards
        table["shards"].sort()
        for (first, blocks, _), (after, *_) in zip(table["shards"], table["shards"][1:]):
            if first + blocks > after:
                raise ValueError(f"block {after} occurs twice")
        system.create_dir(root, recursive=True)
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(table).encode())
        system.move(draft, f"{root}/{MANIFEST}")
        self._sweep(system, root, {name for *_, name in table["shards"]})

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for message in filter(None, messages):
            for *_, name in message.shards:
                for column in self.columns:
                    system.delete_file(f"{root}/{column}/{name}")

    def _sweep(self, system: pafs.FileSystem, root: str, listed: set[str]) -> None:
        for column in self.columns:
            for entry in system.get_file_info(pafs.FileSelector(f"{root}/{column}", allow_not_found=True)):
                if entry.is_file and entry.base_name.endswith(".bin") and entry.base_name not in listed:
                    system.delete_file(entry.path)


def _close(streams: dict) -> None:
    for stream in streams.values():
        stream.close()
    streams.clear()


def _encoded(arrays: pa.Array, name: str, kind: str, lengths: dict) -> np.ndarray:
    """Arrays of a batch as a matrix of their element type; refuses other lengths, nulls and values that do not fit."""
    sizes = np.diff(arrays.offsets.to_numpy())
    length = lengths.setdefault(name, int(sizes[0]))
    values = arrays.flatten()
    if arrays.null_count or values.null_count or (sizes != length).any():
        raise ValueError(f"arrays of {name} hold nulls or differ in length from {length}")
    values = values.to_numpy(zero_copy_only=False)
    limit = np.iinfo(ELEMENTS[kind]).max
    if len(values) and (values.min() < 0 or values.max() > limit):
        raise ValueError(f"a value of {name} does not fit 0..{limit}")
    return values.astype(ELEMENTS[kind]).reshape(len(arrays), length)


@dataclass
class Shard(InputPartition):
    first: int
    blocks: int
    name: str


class ShardReader(DataSourceReader):
    def __init__(self, path: str, table: dict, names: list[str], raw: bool):
        self.path, self.names, self.raw = path, names, raw
        self.kinds = {name: np.dtype(ELEMENTS[table["columns"][name]]) for name in names}
        self.lengths, self.shards = table["lengths"], table["shards"]

    def partitions(self) -> list[Shard]:
        return [Shard(*shard) for shard in self.shards]

    def read(self, shard: Shard | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(shard, Shard):  # a table without shards is read as one empty partition
            return
        system, root = _open(self.path)
        widths = {name: self.lengths[name] * self.kinds[name].itemsize for name in self.names}
        step = max(1, READ_BYTES // max(1, *widths.values()))
        sources = {name: system.open_input_stream(f"{root}/{name}/{shard.name}") for name in self.names}
        for done in range(0, shard.blocks, step):
            rows = min(step, shard.blocks - done)
            columns = [pa.array(np.arange(shard.first + done, shard.first + done + rows), pa.int64())]
            for name in self.names:
                data = sources[name].read(rows * widths[name])
                if len(data) != rows * widths[name]:
                    raise ValueError(f"{root}/{name}/{shard.name} is cut short")
                offsets = np.arange(rows + 1, dtype=np.int32)
                if self.raw:
                    bounds = pa.py_buffer(offsets * np.int32(widths[name]))
                    columns.append(pa.Array.from_buffers(pa.binary(), rows, [None, bounds, pa.py_buffer(data)]))
                else:
                    values = pa.array(np.frombuffer(data, self.kinds[name]).astype(np.int64))
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets * np.int32(self.lengths[name])), values))
            yield pa.RecordBatch.from_arrays(columns, names=["seq_id", *self.names])
        _close(sources)
