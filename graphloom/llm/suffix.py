"""Repeated strings across documents: difference-cover suffix sorting over the places that can repeat.

A text is a row of symbols, its bytes or its words. Every string of `length` symbols is assigned to its anchor, the
least hash among its grams. Equal strings have equal anchors, so strings whose anchor occurs once in the corpus are
unique, and the rest fall into independent shards by anchor. A shard is a text of its own: its suffix array is built
with the difference cover {1, 2} modulo 3 (sort the sampled triples, recurse on their names, merge the remaining
suffixes) and the prefixes of adjacent suffixes compared: in a task while the shard is small, and by Spark's
range-partitioned sorts (difference_cover.py) beyond.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .difference_cover import suffix_array, suffix_order, with_neighbours
from .minhash import _mixed
from .worker import slices, tidy

_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Symbols that a task sorts at once (names of three then fit into 63 bits); larger shards are sorted by the cluster.
SHARD = 1 << 20
#: Symbols of contexts that a sorting task gets on average.
TASK_SYMBOLS = 2 << 20
#: Words of the grams whose least hash is the anchor of a string of words.
WORD_GRAM = 10
#: Bytes of a symbol.
WIDTH = {"byte": 1, "word": 8}


# symbols --------------------------------------------------------------------------------------------------------------

#: A random 64-bit value of each byte, for hashes of words.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs without ASCII white space."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    change = np.diff(word)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


class Symbols:
    """Texts (bytes) as rows of symbols: uint8 bytes, or a 64-bit hash of each word."""

    def __init__(self, unit: str):
        self.unit, self.dtype = unit, np.dtype(np.uint8 if unit == "byte" else np.uint64)
        self.up = self.down = np.empty(0, _U)

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return data if self.unit == "byte" else self.words(data)

    def words(self, data: np.ndarray, part: int = 1 << 20) -> np.ndarray:
        starts, ends = word_bounds(data)
        out = np.empty(len(starts), _U)
        at = 0
        while at < len(starts):  # by parts of some million bytes; a word is never cut
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + part, side="right")))
            a, b = int(starts[at]), int(ends[to - 1])
            if len(self.up) <= b - a:
                self.up = np.concatenate(([_U(1)], np.cumprod(np.full(b - a + 1, _BASE, _U))))
                self.down = np.concatenate(([_U(1)], np.cumprod(np.full(b - a + 1, _INVERSE, _U))))
            sums = np.zeros(b - a + 1, _U)
            np.cumsum(_BYTES[data[a:b]] * self.up[: b - a], out=sums[1:])
            x, y = starts[at:to] - a, ends[at:to] - a
            out[at:to] = _mixed((sums[y] - sums[x]) * self.down[x] + (y - x).astype(_U))
            at = to
        return out

    def spans(self, text: bytes, spans: list[list[int]]) -> list[list[int]]:
        """Byte ranges of ranges of symbols."""
        if self.unit == "byte" or not spans:
            return spans
        starts, ends = word_bounds(np.frombuffer(text, np.uint8))
        return [[int(starts[a]), int(ends[b - 1])] for a, b in spans]


# suffixes of a shard ----------------------------------------------------------------------------------------------------


def repeated_starts(strings: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each row of symbols the starts of its strings of `length` that start anywhere else in the rows, itself included."""
    ends = np.cumsum([len(s) + 1 for s in strings])
    begins = ends - [len(s) + 1 for s in strings]
    total = int(ends[-1])
    wide = strings[0].dtype != np.uint8
    text = np.zeros(total + 8, dtype=strings[0].dtype)
    for s, b in zip(strings, begins.tolist(), strict=True):
        text[b : b + len(s)] = s
    named = np.unique(text[:total], return_inverse=True)[1] if wide else text[:total]
    symbols = named.astype(np.int64) + len(strings) + 1
    symbols[ends - 1] = np.arange(1, len(strings) + 1)  # a separator of its own ends each string
    order = suffix_array(symbols)
    whole = np.zeros(total, dtype=bool)
    for b, e in zip(begins, ends, strict=True):
        whole[b : max(b, e - length)] = True
    order = order[whole[order]]
    same = np.arange(len(order) - 1) if len(order) else np.empty(0, np.int64)
    step = 1 if wide or length < 8 else 8
    word = (lambda i: text[i]) if step == 1 else (lambda i: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)[i]).view(_U).ravel())
    for at in [*range(0, length - step + 1, step), *([length - step] if length % step else [])]:  # compare adjacent prefixes
        if not len(same):
            break
        same = same[word(order[same] + at) == word(order[same + 1] + at)]
    hit = np.zeros(total, dtype=bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return [np.flatnonzero(hit[b:e]) for b, e in zip(begins, ends, strict=True)]


# anchors --------------------------------------------------------------------------------------------------------------


class Anchors:
    """Runs of windows of `length` symbols that share their least gram hash."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        self.up = self.down = np.empty(0, _U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.concatenate(([_U(1)], np.cumprod(np.full(n, _BASE, _U))))
            self.down = np.concatenate(([_U(1)], np.cumprod(np.full(n, _INVERSE, _U))))

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first window, windows, whether the hash stands at two places of the run) over texts that end at `ends`."""
        n, w = len(data), self.span
        self._powers(n)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(data.astype(_U) * self.up[:n], out=sums[1:])
        m = n - self.gram + 1
        g = _mixed((sums[self.gram :] - sums[:-self.gram]) * self.down[:m])
        for e in ends[:-1]:  # grams across a text's end
            g[max(0, e - self.gram + 1) : e] = _MAX
        k = n - self.length + 1  # windows
        rows = -(-m // w)
        padded = np.full(rows * w, _MAX, dtype=_U)
        padded[:m] = g
        blocks = padded.reshape(rows, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:k], ahead[w - 1 : w - 1 + k])
        text = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))[:k]
        valid = np.ones(k, dtype=bool)
        for e in ends[:-1]:
            valid[max(0, e - self.length + 1) : e] = False
        new = np.ones(k, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        count = np.diff(np.append(start, k))
        early, late = np.full(len(start), n, np.int64), np.full(len(start), -1, np.int64)
        at = np.flatnonzero(g[:k] == least)[::-1]
        early[run[at]] = at
        at = np.flatnonzero(g[w - 1 : w - 1 + k] == least)
        late[run[at]] = at + w - 1
        ok = valid[start]
        return least[start][ok], start[ok], count[ok], (late > early)[ok]

    def of_texts(self, texts: list[np.ndarray], part: int = 1 << 20):
        """(which text, hash, first window, windows, twice, context) of every run; long texts go by in overlapping parts."""
        group: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for i, t in enumerate(texts):
            for at in range(0, max(len(t) - self.length + 1, 0), part):
                piece = t[at : at + part + self.length - 1]
                group.append((i, at, piece))
                size += len(piece)
                if size >= part:
                    yield from self._group(group)
                    group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, group):
        data = np.concatenate([p for _, _, p in group])
        ends = np.cumsum([len(p) for _, _, p in group])
        h, start, count, twice = self.runs(data, ends)
        owner = np.searchsorted(ends, start, side="right")
        begins = ends - [len(p) for _, _, p in group]
        raw, width = data.tobytes(), data.itemsize
        for o, x, s, c, t in zip(owner.tolist(), h.view(np.int64).tolist(), start.tolist(), count.tolist(), twice.tolist(), strict=True):
            i, at, _ = group[o]
            yield i, x, at + s - int(begins[o]), c, t, raw[s * width : (s + c + self.length - 1) * width]


# plan -----------------------------------------------------------------------------------------------------------------


def _occurrences(named: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    def run(batches):
        anchors, symbols = Anchors(length, gram), Symbols(unit)
        names = ["h", "ch", "id", "th", "first", "n", "twice"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        for batch in slices(batches, rows=512, size=1 << 21):
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, h, first, n, twice, context in anchors.of_texts([symbols.of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)]):
                rows.append((h, xxhash.xxh3_128_digest(context), ids[i], ths[i], first, n, twice))
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return named.select("id", "th", "b").mapInArrow(tidy(run), "h long, ch binary, id long, th long, first long, n int, twice boolean")


def _contexts(wanted: DataFrame, length: int, unit: str) -> DataFrame:
    """The symbols of the contexts listed for each text."""

    def run(batches):
        symbols = Symbols(unit)
        for batch in slices(batches, rows=128, size=1 << 21):
            for row in batch.to_pylist():
                text = symbols.of(row["b"])
                out = [(w["h"], w["k"], row["id"], row["th"], w["first"], text[w["first"] : w["first"] + w["n"] + length - 1].tobytes()) for w in row["wanted"]]
                for at in range(0, len(out), 4096):
                    cols = list(zip(*out[at : at + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.binary()], strict=True)], names=["h", "k", "id", "th", "first", "context"])

    return wanted.mapInArrow(tidy(run), "h long, k long, id long, th long, first long, context binary")


_MARK = "id long, th long, start long, stop long"


def _mark_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=["id", "th", "start", "stop"])


def _spans(starts: np.ndarray, length: int):
    """Maximal byte ranges covered by windows at sorted starts."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > length) + 1
        for part in np.split(starts, cut):
            yield int(part[0]), int(part[-1]) + length


def _sorted_shards(contexts: DataFrame, length: int, tasks: int, unit: str) -> DataFrame:
    """Marks of windows that repeat among the contexts of an anchor; rows come in the order of their anchors."""
    dtype, width, most = Symbols(unit).dtype, WIDTH[unit], SHARD

    def solve(group):
        found = []
        for (_, k, i, th, first, _), starts in zip(group, repeated_starts([np.frombuffer(r[5], dtype) for r in group], length), strict=True):
            if k == 1:  # others occur twice as they are
                found += [(i, th, first + a, first + b) for a, b in _spans(starts, length)]
        return found

    def run(batches):
        group, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                need = len(r[5]) // width + 1
                # shards are joined up to a block; equal windows have equal anchors, so more of them in a sort do no harm
                if group and r[0] != last and size + need > most:
                    if found := solve(group):
                        yield _mark_batch(found)
                    group, size = [], 0
                group.append(r)
                size += need
                last = r[0]
        if group and (found := solve(group)):
            yield _mark_batch(found)

    return contexts.repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(tidy(run), _MARK)


def _large_shards(contexts: DataFrame, length: int, unit: str, scratch: Scratch) -> DataFrame:
    """The same for anchors with more symbols than a task sorts: the cluster sorts their suffixes.

    All such contexts are one text, a separator of its own behind each; a row is a place of it. Adjacent suffixes are
    compared by 128-bit fingerprints of their prefixes, which each place brings along.
    """
    dtype, width = Symbols(unit).dtype, WIDTH[unit]

    def placed(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, rows=512, size=1 << 21):
            sizes = np.array([len(c.as_buffer()) // width + 1 for c in batch.column("context")], np.int64)
            begins = at + np.cumsum(sizes) - sizes
            at = int(begins[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(sizes), pa.int32()), pa.array(begins), pa.array(sizes), *(batch.column(c) for c in ("k", "id", "th", "first", "context"))], names=["part", "at", "size", "k", "id", "th", "first", "context"])

    text = scratch.write(contexts.mapInArrow(tidy(placed), "part int, at long, size long, k long, id long, th long, first long, context binary"), batch_rows=1000)
    sizes = sorted(text.groupBy("part").agg(F.sum("size")).collect())  # a row a partition
    total, before = 0, {}
    for part, size in sizes:
        before[part], total = total, total + size

    def symbols(batches):
        for batch in slices(batches, rows=64, size=1 << 18):
            for part, at, context in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "context")), strict=True):
                s, start = np.frombuffer(context, dtype), before[part] + at
                names = np.empty(len(s) + 1, np.int64)
                names[:-1] = (1 << 62) + (s.astype(np.int64) if width == 1 else (s >> _U(2)).astype(np.int64))
                names[-1] = 1 + start + len(s)  # the separator
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(names))), pa.array(names)], names=["pos", "sym"])

    def windows(batches):
        for batch in slices(batches, rows=64, size=1 << 18):
            for part, at, k, i, th, first, context in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "k", "id", "th", "first", "context")), strict=True):
                m, start = len(context) // width - length + 1, before[part] + at
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(context[x * width : (x + length) * width]) for x in range(m)), np.int64).reshape(m, 2)
                same = lambda x: pa.array(np.full(m, x) if x is not None else [None] * m, pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(start, start + m)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), same(k), same(i), same(th), pa.array(np.arange(first, first + m))],
                    names=["at", "f", "g", "k", "id", "th", "start"],
                )

    places = text.mapInArrow(tidy(symbols), "pos long, sym long")
    order = suffix_order(places, total, length, scratch)
    prints = scratch.write(text.mapInArrow(tidy(windows), "at long, f long, g long, k long, id long, th long, start long"))
    # a suffix that is too short for a window differs from its neighbours in a separator, so it may stay between them
    order = scratch.write(order.join(prints, F.col("pos") == F.col("at"), "left").select("row", "f", "g", "k", "id", "th", "start"))
    scratch.free_shuffles()
    near = with_neighbours(order, "row", {"f": (-1, 1), "g": (-1, 1)})
    hit = near.where("k = 1 and ((f = `f-1` and g = `g-1`) or (f = `f+1` and g = `g+1`))")
    hit = scratch.write(hit.select("id", "th", "start", (F.col("start") + length).alias("stop")))
    scratch.drop(text, prints, order)
    scratch.free_shuffles()
    return hit


def repeated_spans(named: DataFrame, scratch: Scratch, length: int, gram: int, unit: str = "byte") -> DataFrame:
    """Marks (id, th, start, stop): ranges of symbols, with overlaps, whose every window repeats. named: id, th, b (binary)."""
    occ = scratch.write(_occurrences(named, length, gram, unit), batch_rows=1000)
    kinds = occ.groupBy("h", "ch").agg(F.count("*").alias("k"), F.max("twice").alias("twice"), F.min(F.struct("id", "th", "first", "n")).alias("at"))
    kinds = scratch.write(kinds)
    scratch.free_shuffles()
    anchors = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("k").alias("least"), F.max(F.col("twice") & (F.col("k") == 1)).alias("twice"), F.sum(F.col("at.n") + length).alias("size"))
    anchors = anchors.where("(kinds > 1 and least = 1) or twice").select(F.col("h").alias("ah"), "size")
    copies = kinds.where("k > 1").select(F.col("h").alias("kh"), F.col("ch").alias("kch"))
    whole = occ.join(copies, (F.col("h") == F.col("kh")) & (F.col("ch") == F.col("kch"))).select("id", "th", F.col("first").alias("start"), (F.col("first") + F.col("n") + (length - 1)).alias("stop"))
    whole = scratch.write(whole)
    need = kinds.join(anchors, F.col("h") == F.col("ah")).select("h", "k", "size", "at.*")
    need = scratch.write(need)
    scratch.drop(occ, kinds)
    scratch.free_shuffles()
    wanted = need.groupBy(F.col("id").alias("wid"), F.col("th").alias("wth")).agg(F.collect_list(F.struct("h", "k", "first", "n")).alias("wanted"))
    # rows that repeat a key and a text would give the same contexts twice
    held = named.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).select("id", "th", "b", "wanted")
    contexts = scratch.write(_contexts(held, length, unit).dropDuplicates(["h", "id", "th", "first"]), batch_rows=1000)
    scratch.free_shuffles()
    large = need.where(F.col("size") > SHARD).select("h").distinct()
    some_large = not large.isEmpty()
    small = contexts.join(large, "h", "left_anti") if some_large else contexts
    tasks = 1 + (need.agg(F.sum(F.col("n") + length)).first()[0] or 0) // TASK_SYMBOLS
    marks = scratch.write(_sorted_shards(small, length, tasks, unit))
    if some_large:
        marks = marks.union(_large_shards(contexts.join(large, "h", "left_semi"), length, unit, scratch))
    scratch.drop(contexts, need)
    scratch.free_shuffles()
    return whole.union(marks)


def _merged(marks) -> list[list[int]]:
    """Disjoint maximal ranges of overlapping or touching ones."""
    spans: list[list[int]] = []
    for m in sorted(marks or (), key=lambda m: m["start"]):
        if spans and m["start"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], m["stop"])
        else:
            spans.append([m["start"], m["stop"]])
    return spans


def _rest(data: bytes, spans: list[list[int]]) -> list[bytes]:
    """What is left of the data outside the spans."""
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return [*parts, data[at:]]


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("th"), F.encode(t, "UTF-8").alias("b"))


def _marked(docs: DataFrame, scratch: Scratch, text: str, key: str, length: int, gram: int, unit: str, to: str = "marks") -> DataFrame:
    # n words take 2 n - 1 bytes at least
    named = _named(docs, text, key).where(F.length("b") >= (length if unit == "byte" else 2 * length - 1))
    marks = repeated_spans(named, scratch, length, gram, unit)
    return scratch.write(marks.groupBy(F.col("id").alias(f"{to}_id"), F.col("th").alias(f"{to}_th")).agg(F.collect_list(F.struct("start", "stop")).alias(to)))


def _with(rows: DataFrame, marks: DataFrame, to: str = "marks") -> DataFrame:
    # marks grow with the corpus: the same plan at every size
    return rows.join(marks.hint("merge"), F.col("id").eqNullSafe(F.col(f"{to}_id")) & (F.col("th") == F.col(f"{to}_th")), "left").drop(f"{to}_id", f"{to}_th")


def repeated_bytes(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", length: int = 400, gram: int = 160, words: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs; with `words` also n_passage_words.

    A byte goes when a `length`-byte string that covers it also starts anywhere else, in any text, the same included;
    overlaps count, matches stay inside texts, and strings are judged on the texts as given. n_passage_words are the
    words in strings of `words` words (whatever the white space between them) that also start anywhere else: they show
    passages shorter than `length` bytes, which the first columns leave alone. Null and empty texts have no byte. Rows
    that repeat a text lose it wherever a string fits in, as each copy starts elsewhere. Extra columns are ignored; an
    empty table gives no row.
    """
    joined = _with(_named(docs, text, key), _marked(docs, scratch, text, key, length, gram, "byte"))
    scratch.free_shuffles()
    joined = _with(joined, _marked(docs, scratch, text, key, words, WORD_GRAM, "word", "passages"), "passages") if words else joined.withColumn("passages", F.col("marks"))

    def run(batches):
        for batch in slices(batches, rows=256, size=1 << 21):
            out = []
            for r in batch.to_pylist():
                spans = _merged(r["marks"])
                out.append((r["id"], len(r["b"]), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(_rest(r["b"], spans))).hexdigest(), sum(b - a for a, b in _merged(r["passages"]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string(), pa.int64()], strict=True)], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    out = joined.select("id", "b", "marks", "passages").mapInArrow(tidy(run), f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")
    return out if words else out.drop("n_passage_words")


def without_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", length: int = 50, gram: int | None = None, unit: str = "word") -> DataFrame:
    """docs with strings of `length` symbols (words or bytes) that also start anywhere else taken out of the text.

    Words match whatever the white space between them, and the white space around what goes stays; of bytes, whole
    characters stay. Every row and column stays; null and empty texts stay as they are; rows that repeat a text lose it
    wherever a string fits in. A column n_chars is counted anew.
    """
    marks = _marked(docs, scratch, text, key, length, gram or (160 if unit == "byte" else WORD_GRAM), unit)

    def cut(batches):
        symbols = Symbols(unit)
        for batch in slices(batches, rows=256, size=1 << 21):
            out = []
            for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (t or "").encode()
                out.append("".join(p.decode("utf-8", "ignore") for p in _rest(data, symbols.spans(data, _merged(m)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "left"])

    t = F.coalesce(F.col(text), F.lit(""))
    joined = _with(docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("th"), t.alias("t")), marks)
    plain = joined.where("marks is null").select("row.*")
    row_type = joined.schema["row"].dataType.simpleString()
    changed = joined.where("marks is not null").select("row", "t", "marks").mapInArrow(tidy(cut), f"row {row_type}, left string")
    new = {text: F.col("left")} | ({"n_chars": F.length("left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return plain.unionByName(changed.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]))


def digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return repeated_bytes(docs, scratch, words=50)
