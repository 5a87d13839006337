"""Stupid-backoff language-model scores of documents, from counts over the whole corpus.

scores_by_rows() is the plain relational plan: n-gram count tables partitioned by hash, joined to exploded n-grams,
summed per document. backoff_scores() is the same plan over blocks, which shuffles a fraction of its bytes: a chunk is a
run of documents with about `chunk_words` words, a row holds the distinct n-grams of a chunk that fall into one hash
bucket. Bucket by bucket the rows of all chunks are summed into the n-gram count table and joined back to the rows they
came from; a chunk's answers meet its documents again, whose scores are summed there. A frequent n-gram is one entry a
chunk, so no bucket is hot; a chunk has at most a row for each of its n-grams, so rows grow with the corpus only.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .minhash import Shingler, _mixed
from .rules import words
from .worker import tidy

_U = np.uint64


def _planes(a: np.ndarray) -> bytes:
    """The array byte place by byte place: sorted hashes and small numbers then compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _of_planes(b, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _chunks(docs: DataFrame, text: str, key: str, chunk_words: int) -> DataFrame:
    """(chunk, ids, lengths, grams, words): a row a chunk; words index the sorted distinct word hashes in grams."""

    def run(batches):
        part, number, hasher = TaskContext.get().partitionId(), 0, Shingler(1)
        ids, lengths, hashes, held = [], [], [], 0

        def flush():
            nonlocal number, ids, lengths, hashes, held
            flat = np.concatenate(hashes) if hashes else np.empty(0, _U)
            grams, at = np.unique(flat, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([_planes(grams)], pa.binary()), pa.array([_planes(at.astype("<u4"))], pa.binary()),
                ],
                names=["chunk", "ids", "lengths", "grams", "words"],
            )
            number += 1
            ids, lengths, hashes, held = [], [], [], 0

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                h = hasher.word_hashes((t.as_py() or "").encode().lower().split())
                if ids and held + len(h) > chunk_words:
                    yield from flush()
                ids.append(i.as_py())
                lengths.append(len(h))
                hashes.append(h)
                held += len(h)
        if ids:
            yield from flush()

    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return named.mapInArrow(tidy(run), "chunk long, ids array<long>, lengths array<long>, grams binary, words binary")


class Chunk:
    """A chunk's tokens and, level by level, its distinct n-grams with their corpus counts."""

    def __init__(self, row: dict, order: int):
        self.ids, self.lengths = row["ids"], np.asarray(row["lengths"], dtype=np.int64)
        self.hashes = [_of_planes(row["grams"], "<u8")]
        self.tokens = [_of_planes(row["words"], "<u4").astype(np.int64)]  # per level: index of the n-gram that ends at a token
        ends = np.cumsum(self.lengths)
        self.nth = np.arange(int(ends[-1])) - np.repeat(ends - self.lengths, self.lengths)  # place in the document
        self.counts: list[np.ndarray] = []
        self.token_hash = self.hashes[0][self.tokens[0]]
        self.order = order

    def answered(self, answers: list[dict], level: int, buckets: int, least: int) -> None:
        """Take the counts of a level and find the n-grams of the next one."""
        order, where = by_bucket(self.hashes[level], buckets)
        counts = np.zeros(len(where), np.int64)
        for a in answers:
            b = a["bucket"]
            counts[order[np.searchsorted(where, b) : np.searchsorted(where, b, side="right")]] = _of_planes(a["counts"], "<i8")
        self.counts.append(counts)
        if level + 1 < self.order:
            self.extend(level + 1, least)

    def extend(self, level: int, least: int) -> None:
        """n-grams of `level` + 1 words: only where both that they hold were counted often enough can they be."""
        n, shorter = len(self.nth), self.tokens[level - 1]
        full = self.nth >= level
        if level > 1:
            often = np.zeros(n, bool)
            often[shorter >= 0] = self.counts[level - 1][shorter[shorter >= 0]] >= least
            full &= often & np.concatenate(([False], often[:-1]))
        at = np.flatnonzero(full)
        h = np.full(len(at), level, _U)
        for k in range(level, -1, -1):
            h = _mixed((h ^ self.token_hash[at - k]) * _U(0x9E3779B97F4A7C15) + _U(k + 1))
        grams, inverse = np.unique(h, return_inverse=True)
        token = np.full(n, -1, np.int64)
        token[at] = inverse
        self.hashes.append(grams)
        self.tokens.append(token)

    def requests(self, level: int, buckets: int):
        """(bucket, hashes, counts in the chunk) of a level's n-grams."""
        grams, token = self.hashes[level], self.tokens[level]
        here = np.bincount(token[token >= 0], minlength=len(grams)).astype("<i8")
        order, where = by_bucket(grams, buckets)
        for part in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where)) + 1) if len(where) else ():
            s = order[part]
            yield int(where[part[0]]), _planes(grams[s]), _planes(here[s])

    def scores(self, total: int, least: int, penalty: float) -> np.ndarray:
        """Sum over each document's words of the log of the stupid-backoff score."""
        n = len(self.nth)
        out, done = np.zeros(n), np.zeros(n, bool)
        for level in range(self.order - 1, -1, -1):
            token = self.tokens[level]
            count = np.zeros(n, np.int64)
            count[token >= 0] = self.counts[level][token[token >= 0]]
            hit = ~done & (token >= 0) & ((count >= least) | (level == 0))
            below = np.full(n, total, np.int64)
            if level:
                before = np.concatenate(([-1], self.tokens[level - 1][:-1]))
                below[hit] = self.counts[level - 1][before[hit]]
            backed = np.minimum(self.nth, self.order - 1) - level
            out[hit] = np.log(count[hit]) - np.log(below[hit]) + backed[hit] * np.log(penalty)
            done |= hit
        ends = np.cumsum(self.lengths).tolist()
        return np.array([out[e - k : e].sum() for e, k in zip(ends, self.lengths.tolist(), strict=True)])


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order of hashes by bucket, the buckets in that order); a bucket is a range of hashes."""
    bucket = ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def backoff_scores(
    docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", order: int = 3, penalty: float = 0.4,
    least: int = 2, chunk_words: int = 1_000_000, bucket_words: int = 2_000_000,
) -> DataFrame:
    """(key, n_words, log_score, mean_log_score) of every row of docs.

    Words are runs without ASCII white space, A-Z lowered. A word w after its context scores c(context w) / c(context)
    for the longest context of up to order - 1 words whose n-gram occurs at least `least` times in the corpus, times
    `penalty` for each word by which the context was shortened; the last resort is c(w) / c(all words). n-grams stay
    inside documents. With least = 2 a text's own words alone don't make them likely.

    Null and empty texts have 0 words, log_score 0 and a null mean. Repeated rows count as often as they come; extra
    columns are ignored; an empty table gives no row.
    """
    chunks = scratch.write(_chunks(docs, text, key, chunk_words), batch_rows=1000)
    total = chunks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, int(total // bucket_words) + 1)

    def summed(group: pa.Table) -> pa.Table:
        """A bucket: sum each n-gram over the chunks and give every chunk its counts back in its own order."""
        parts = [_of_planes(x.as_buffer(), "<u8") for x in group.column("grams")]
        here = np.concatenate([_of_planes(x.as_buffer(), "<i8") for x in group.column("counts")])
        grams, at = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.zeros(len(grams), "<i8")
        np.add.at(sums, at, here)
        sums = sums[at]
        cuts = np.cumsum([0, *(len(p) for p in parts)])
        blobs = [_planes(sums[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"chunk": group.column("chunk"), "level": group.column("level"), "bucket": group.column("bucket"), "counts": pa.array(blobs, pa.binary())})

    def rebuilt(row: dict, level: int) -> Chunk:
        c = Chunk(row, order)
        for k in range(level):
            c.answered([a for a in row["answers"] if a["level"] == k], k, buckets, least)
        return c

    def asking(levels: range):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    c = rebuilt(row, levels.start - 1 if levels.start > 1 else 0)
                    if levels.start > 1:
                        c.answered([a for a in row["answers"] if a["level"] == levels.start - 1], levels.start - 1, buckets, least)
                    elif len(levels) > 1:
                        c.extend(1, least)
                    for level in levels:
                        for b, grams, counts in c.requests(level, buckets):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([b], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([level], pa.int32()), pa.array([grams], pa.binary()), pa.array([counts], pa.binary())],
                                names=["bucket", "chunk", "level", "grams", "counts"],
                            )

        return run

    requests = "bucket int, chunk long, level int, grams binary, counts binary"
    answers = None

    def with_answers():
        per = answers.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("level", "bucket", "counts")).alias("answers"))
        return chunks.join(per, F.col("chunk") == F.col("of"), "left").drop("of")

    for levels in [range(0, min(2, order)), *(range(k, k + 1) for k in range(2, order))]:
        source = chunks if answers is None else with_answers()
        got = source.mapInArrow(tidy(asking(levels)), requests).groupBy("level", "bucket").applyInArrow(summed, "chunk long, level int, bucket int, counts binary")
        got = scratch.write(got, batch_rows=1)
        answers = got if answers is None else answers.union(got)
        scratch.free_shuffles()

    def scored(batches):
        for batch in batches:
            for row in batch.to_pylist():
                row["answers"] = row["answers"] or []
                c = rebuilt(row, order)
                s = c.scores(total, least, penalty)
                mean = [x / n if n else None for x, n in zip(s.tolist(), c.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.lengths), pa.array(s), pa.array(mean, pa.float64())], names=["id", "n", "s", "m"])

    out = scratch.write(with_answers().mapInArrow(tidy(scored), "id long, n long, s double, m double"), batch_rows=1)
    return out.toDF(key, "n_words", "log_score", "mean_log_score")


def scores_by_rows(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", penalty: float = 0.4, least: int = 2) -> DataFrame:
    """What backoff_scores() gives for order 3, by rows: a row an n-gram, count tables joined to them on their hashes.

    Counts are combined before they are shuffled; a frequent n-gram makes the join's larger side skewed, which adaptive
    execution splits. Shuffles several times the bytes of backoff_scores() (figures in the README).
    """
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = docs.select(F.col(key).cast("long").alias("id"), F.transform(words(low), lambda w: F.xxhash64(w)).alias("hs"))
    base = scratch.write(base.withColumn("row", F.monotonically_increasing_id()))
    h = lambda *back: F.xxhash64(F.lit(len(back)), *[F.get("hs", F.col("i") - k) for k in back])
    ngrams = base.select("row", "hs", F.posexplode("hs").alias("i", "w"))
    ngrams = ngrams.select("row", "i", h(0).alias("g1"), F.when(F.col("i") > 0, h(1, 0)).alias("g2"), F.when(F.col("i") > 1, h(2, 1, 0)).alias("g3"), F.when(F.col("i") > 0, h(1)).alias("p1"), F.when(F.col("i") > 1, h(2, 1)).alias("p2"))
    counts = {k: scratch.write(ngrams.where(f"g{k} is not null").groupBy(F.col(f"g{k}").alias("g")).agg(F.count("*").alias("n")).where(F.col("n") >= (1 if k == 1 else least))) for k in (1, 2, 3)}
    scratch.free_shuffles()
    total = counts[1].agg(F.sum("n")).first()[0] or 0
    for name, k in (("g3", 3), ("p2", 2), ("g2", 2), ("p1", 1), ("g1", 1)):
        ngrams = scratch.write(ngrams.join(counts[k].select(F.col("g").alias("of"), F.col("n").alias(f"c_{name}")), F.col(name) == F.col("of"), "left").drop("of", name))
        scratch.free_shuffles()
    back = F.log(F.lit(penalty))
    score = (
        F.when(F.col("c_g3").isNotNull(), F.log("c_g3") - F.log("c_p2"))
        .when(F.col("c_g2").isNotNull(), F.log("c_g2") - F.log("c_p1") + F.when(F.col("i") > 1, back).otherwise(0.0))
        .otherwise(F.log("c_g1") - F.log(F.lit(max(total, 1))) + F.least(F.col("i"), F.lit(2)) * back)
    )
    sums = ngrams.groupBy(F.col("row").alias("of")).agg(F.sum(score).alias("s"))
    n = F.size("hs").cast("long")
    out = base.join(sums, F.col("row") == F.col("of"), "left")
    return out.select(F.col("id").alias(key), n.alias("n_words"), F.coalesce("s", F.lit(0.0)).alias("log_score"), (F.col("s") / n).alias("mean_log_score"))


def digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    s = backoff_scores(docs, scratch)
    return s.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


#: The same in DuckDB's SQL, for the columns of digest().
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i-1] || ' ' || ws[i] END AS b, CASE WHEN i > 2 THEN ws[i-2] || ' ' || ws[i-1] || ' ' || ws[i] END AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d)),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w), c2 AS (SELECT b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b),
c3 AS (SELECT g, count(*) AS n FROM t WHERE g IS NOT NULL GROUP BY g), s AS (SELECT count(*) AS n FROM t),
j AS (SELECT t.doc_id, t.i, c1.n AS w, c2.n AS b, c3.n AS g, lag(c1.n) OVER o AS pw, lag(c2.n) OVER o AS pb
      FROM t JOIN c1 ON t.w = c1.w LEFT JOIN c2 ON t.b = c2.b LEFT JOIN c3 ON t.g = c3.g WINDOW o AS (PARTITION BY t.doc_id ORDER BY t.i)),
x AS (SELECT doc_id, sum(CASE WHEN g >= 2 THEN ln(g) - ln(pb)
                              WHEN b >= 2 THEN ln(b) - ln(pw) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                              ELSE ln(w) - ln(s.n) + least(i - 1, 2) * ln(0.4) END) AS l FROM j, s GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(l, 0), 4) AS log_score, round(l / len(ws), 6) AS mean_log_score FROM d LEFT JOIN x USING (doc_id)
"""
