"""Packed token-id sequences by best-fit decreasing, with segment bounds and position resets."""

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder
from .worker import slices, tidy


class Rooms:
    """A segment tree over free capacities 0..size: bins by what they have left; the tightest that fits in O(log size)."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)  # bins below each node
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._count(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(bin, its room) for the least room of at least need; takes the bin out."""
        at, tree = need + self.leaves, self.tree
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):  # up, until a sibling to the right holds a bin
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._count(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes; no bin's lengths add to more than size. Ties keep the order given."""
    rooms, bins = Rooms(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = rooms.tightest(lengths[i])
        if got is None:
            bins.append([i])
            got = len(bins) - 1, size
        else:
            bins[got[0]].append(i)
        if got[1] - lengths[i]:
            rooms.put(got[1] - lengths[i], got[0])
    return bins


SCHEMA = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_starts array<int>, doc_ids array<long>, doc_starts array<long>"


def packed_sequences(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", seq_len: int = 2048,
                     end_id: int = 1, pad_id: int = 0, block_tokens: int = 4_000_000) -> DataFrame:
    """A row per sequence: n_tokens real ids, ids (seq_len little-endian unsigned 32-bit, padded with pad_id),
    cu_seqlens (0, the end of each segment), position_starts (where positions restart at 0), doc_ids and doc_starts.

    A row is a line of the packed id matrix. Documents get end_id; one longer than seq_len is split without loss into
    whole windows and a rest. Rests of about block_tokens ids are packed together, best fit first by falling length, a
    block a time within a partition: bounded memory, one pass, no shuffle, the same ids when a task runs again.
    Null and empty texts are their end id alone; repeated rows are packed again; null keys stay null in doc_ids; other
    columns are ignored, whatever their names; an empty table gives no row.
    """

    def run(batches):
        part, enc, number = TaskContext.get().partitionId(), encoder(tokenizer), 0
        end, step = np.asarray([end_id], dtype="<u4").tobytes(), 4 * seq_len
        pad = np.asarray([pad_id], dtype="<u4").tobytes()
        schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                            ("position_starts", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])
        whole: list[list[tuple]] = []
        rests: list[tuple] = []
        held = 0

        def flush():
            nonlocal number, whole, rests, held
            bins = whole + [[rests[i] for i in b] for b in best_fit_decreasing([len(r[2]) // 4 for r in rests], seq_len)]
            whole, rests, held = [], [], 0
            for at in range(0, len(bins), 512):
                rows = []
                for b in bins[at : at + 512]:
                    ends = np.cumsum([len(p[2]) // 4 for p in b]).tolist()
                    ids = b"".join(p[2] for p in b)
                    rows.append(((part << 32) + number, ends[-1], ids + pad * (seq_len - ends[-1]), [0, *ends], [0, *ends[:-1]], [p[0] for p in b], [p[1] for p in b]))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in slices(batches):
            ids = enc.ids([x or "" for x in batch.column(1).to_pylist()])
            for doc, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                x += end
                for at in range(0, len(x), step):
                    piece = (doc, at // 4, x[at : at + step])
                    if len(piece[2]) == step:
                        whole.append([piece])
                    else:
                        rests.append(piece)
                held += len(x) // 4
                if held >= block_tokens:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(tidy(run), SCHEMA)


def write_binary(sequences: DataFrame, folder: str, seq_len: int = 2048) -> list:
    """Write packed sequences as binary files to a folder that executors reach by its URI; a Row per file.

    NAME.ids.bin is the id matrix (seq_len little-endian unsigned 32-bit ids a line), NAME.cu_seqlens.bin the cumulative
    lengths of each line in turn (every line's begin with 0), NAME.position_starts.bin the places where positions restart.
    A task writes under names of its attempt, so that lost and repeated tasks do no harm; the driver renames the files of
    the attempts that count and deletes the rest. The folder must not exist yet. Rows: name, sequences, segments.
    """
    spark = sequences.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(f"{folder} exists")
    fs.mkdirs(path)
    kinds = ("ids", "cu_seqlens", "position_starts")

    def run(batches):
        task = TaskContext.get()
        name, out, counts = f"part-{task.partitionId():05d}", None, [0, 0]
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            if out is None and batch.num_rows:
                out = [store.open_output_stream(f"{root}/_{name}-{task.taskAttemptId()}.{k}.bin") for k in kinds]
            for ids, ends, resets in zip(*(batch.column(k).to_pylist() for k in kinds), strict=True):
                if len(ids) != 4 * seq_len:
                    raise ValueError(f"a line has {len(ids) // 4} ids, not {seq_len}")
                for stream, data in zip(out, (ids, np.asarray(ends, "<u4").tobytes(), np.asarray(resets, "<u4").tobytes()), strict=True):
                    stream.write(data)
                counts = [counts[0] + 1, counts[1] + len(resets)]
        if out:
            for stream in out:
                stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, f"_{name}-{task.taskAttemptId()}", *counts)], names=["name", "written", "sequences", "segments"])

    files = sequences.select(*kinds).mapInArrow(tidy(run), "name string, written string, sequences long, segments long").collect()  # a row a task
    for f in files:
        for k in kinds:
            fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{f.written}.{k}.bin"), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{f.name}.{k}.bin"))
    for left in fs.listStatus(path):
        if left.getPath().getName().startswith("_"):
            fs.delete(left.getPath(), False)
    return files


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    s = packed_sequences(docs, tokenizer)
    return s.select("sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", "position_starts", "doc_ids", "doc_starts")
