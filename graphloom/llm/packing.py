"""Sum-of-squares online packing of token ids into windows."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder
from .worker import slices, tidy


class Packer:
    """Places pieces of at most `size` ids. levels[f] counts the open windows with f ids; a piece goes to the level
    that makes the sum of the squared counts least (the fuller on ties), or opens a window. Full windows leave at once.

    One rule bounds memory and ends a partition alike: when more than `most_open` windows are open, and at the end, the
    emptiest are cut up to fill the others, so that at most one window stays partly filled; at the end that one leaves as
    windows whose lengths are powers of two. Documents may be cut freely, so nothing is padded either way: sf0.1 in one
    partition gives 4,940 windows, 5 of them not full, whether at most 8,192 may be open (556 are) or 64 (52 fills).
    """

    def __init__(self, size: int, most_open: int = 8192):
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.windows: dict[int, list[list[tuple]]] = {}
        self.n_open, self.out, self.next = 0, [], 0

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.size
        for at in range(0, len(ids), step):
            piece = (doc, at // 4, ids[at : at + step], total)
            if len(piece[2]) == step:
                self._emit([piece])
            else:
                self._place(piece)
        if self.n_open > self.most_open:
            self._fill(last=False)

    def _place(self, piece: tuple) -> None:
        n, levels = len(piece[2]) // 4, self.levels
        rooms = np.flatnonzero(levels[1 : self.size - n + 1]) + 1
        cost = 2 * (levels[rooms + n] - levels[rooms]) + 2  # one window less at its level, one more above
        cost[rooms + n == self.size] = 1 - 2 * levels[self.size - n]  # a full window isn't counted
        best = len(rooms) - 1 - int(np.argmin(cost[::-1])) if len(rooms) else -1
        if best >= 0 and cost[best] <= 2 * levels[n] + 1:
            at = int(rooms[best])
            window = self.windows[at].pop()
            levels[at] -= 1
            self.n_open -= 1
        else:
            at, window = 0, []
        window.append(piece)
        self._keep(at + n, window)

    def _keep(self, fill: int, window: list[tuple]) -> None:
        if fill == self.size:
            self._emit(window)
            return
        self.levels[fill] += 1
        self.windows.setdefault(fill, []).append(window)
        self.n_open += 1

    def _fill(self, last: bool) -> None:
        every = [(f, w) for f in sorted(self.windows, reverse=True) for w in self.windows[f]]
        self.levels[:], self.windows, self.n_open = 0, {}, 0
        give: list[tuple] = []  # pieces of windows that are cut up
        while every:
            fill, window = every.pop(0) if not last or len(every) > 1 else every.pop()
            while fill < self.size and (give or every):
                if not give:
                    give = every.pop()[1]
                doc, start, ids, total = give.pop()
                room = 4 * (self.size - fill)
                window.append((doc, start, ids[:room], total))
                fill += min(len(ids), room) // 4
                if len(ids) > room:
                    give.append((doc, start + room // 4, ids[room:], total))
            if fill == self.size:
                self._emit(window)
            else:
                give = window
                break
        fill = sum(len(p[2]) // 4 for p in give)
        if not last:
            if give:
                while fill >= self.size:
                    raise AssertionError("a full window was left")
                self._keep(fill, give)
            return
        while fill:
            length = min(self.size, 1 << (fill.bit_length() - 1))
            window, need = [], length
            while need:
                doc, start, ids, total = give.pop(0)
                window.append((doc, start, ids[: 4 * need], total))
                if len(ids) > 4 * need:
                    give.insert(0, (doc, start + need, ids[4 * need :], total))
                need -= min(need, len(ids) // 4)
            self._emit(window)
            fill -= length

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def finish(self) -> None:
        self._fill(last=True)


SCHEMA = "{key} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """A row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each input partition packs its own documents as they stream by, in one pass without any shuffle; memory holds one
    batch and the open windows. sequence_id is the partition number times 2^32 plus a counter, so a task that runs
    again gives the same rows. A null or empty text is its end id alone. Repeated rows are packed as often as they
    come; other columns are ignored; an empty table gives no row. A null key stays null.
    """

    def run(batches):
        part, packer, enc = TaskContext.get().partitionId(), Packer(seq_len), encoder(tokenizer)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def rows(final: bool = False):
            if len(packer.out) < 2048 and not final:
                return
            got = packer.take()
            for at in range(0, len(got), 4096):
                cols = list(zip(*got[at : at + 4096], strict=True))
                cols[5] = [(part << 32) + x for x in cols[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in slices(batches):
            ids = enc.ids([x or "" for x in batch.column(1).to_pylist()])
            for doc, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                packer.add(doc, x + end)
            yield from rows()
        packer.finish()
        yield from rows(final=True)

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(tidy(run), SCHEMA.format(key=key))


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
