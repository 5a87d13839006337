"""Quality rules: lines are judged first, then the document by what is left. DataFrame functions only."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Phrases of boilerplate lines, matched in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "enable javascript", "lorem ipsum", "privacy policy",
    "read more", "sign in to", "sign up for", "subscribe to", "terms of service", "terms of use", "use cookies",
)
#: Separators of navigation lines.
NAVIGATION = r"[|»›•·]"
SYMBOLS = r"[#*$%&|<>]"
#: Marks that end a sentence, and what may stand behind them.
ENDS, CLOSERS = ".!?…。！？", "\"'”’»)\\]"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row, however often body's own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_matches(text: Column, pattern: str) -> Column:
    """Number of characters that match a one-character class (native length arithmetic, no array)."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeat_words(ws: Column, width: int) -> Column:
    """Words inside windows of `width` words found twice or more; windows are compared by 64-bit hash within one text."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = _let(ordered, lambda o: F.filter(o, lambda e, k: (e["x"] == F.get(o, k + 1)["x"]) | (e["x"] == F.get(o, k - 1)["x"])))
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return _let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def of_words(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        some = lambda v, n, i: F.xxhash64(*[F.get(v, i + k) for k in range(n)])
        narrow = _let(hashed, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - half), lambda i: some(v, half, i)))
        wide = lambda q: F.transform(F.sequence(F.lit(0), F.size(q) - 1 - (width - half)), lambda i: F.xxhash64(F.get(q, i), F.get(q, i + (width - half))))
        alone = lambda h: F.size(F.array_distinct(h)) == F.size(h)
        # a window found twice has its first half twice as well: most texts end there
        return F.when(F.size(w) <= width, none).otherwise(
            _let(narrow, lambda q: F.when(alone(q), none).otherwise(_let(wide(q), lambda h: F.when(alone(h), none).otherwise(covered(h))))))

    half, none = -(-width // 2), F.lit(0).cast("long")
    return _let(ws, of_words)


def line_passes(line: Column, max_symbol_share: float, max_bars: int, shout_words: int, open_words: int) -> Column:
    """Whether a line with words is kept: punctuation (too many symbols, no end of a sentence in a line of open_words words
    or more, shouting), navigation and boilerplate rules."""
    bare = F.regexp_replace(line, SPACE, "")
    low = F.lower(line)
    symbols = F.length(bare) - F.length(F.regexp_replace(bare, r"[#*$%&<>{}\\^~|]", ""))
    bars = F.length(bare) - F.length(F.regexp_replace(bare, NAVIGATION, ""))
    bangs = F.length(bare) - F.length(F.regexp_replace(bare, "!", ""))
    n = F.size(F.split(F.trim(F.regexp_replace(line, SPACE, " ")), " "))
    return ~(
        (symbols > max_symbol_share * F.length(bare))
        | ((bars >= max_bars) & (bars * 4 >= n))
        | ((n >= open_words) & ~line.rlike(rf"[{ENDS}][{CLOSERS}]*[\x20\x09-\x0D]*\z"))
        | line.rlike(r"\A[\x20\x09-\x0D]*(?:https?://|www\.)[^\x20\x09-\x0D]+[\x20\x09-\x0D]*\z")
        | ((n >= shout_words) & (bangs * 2 >= n))
        | low.rlike("|".join(BOILERPLATE))
    )


def quality(
    docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, window: int = 8,
    max_lost_percent: int = 50, max_symbol_share: float = 0.1, max_bars: int = 3, shout_words: int = 5, open_words: int = 4,
) -> DataFrame:
    """Every row of docs, with clean_text and the figures behind its verdict.

    Adds q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words, q_kept_words, q_base_failed, q_kept, q_text.
    q_text is the text without the lines that failed; a document is kept when its base figures pass and at most
    max_lost_percent of its words went with failing lines. A null or empty text has no words, hence fails the base.
    Repeated rows are judged alike; extra columns pass through. One scan: no shuffle, no Python.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    with_words = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    is_kept = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_passes(x, max_symbol_share, max_bars, shout_words, open_words)
    counted = _let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("words"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w, window).alias("repeat")))
    # only a text with one of the marks or phrases that the rules look for, or an open line, can lose a line
    low = F.lower(t)
    suspect = t.rlike(rf"[^{ENDS}\x20\x09-\x0D][\x20\x09\x0B-\x0D]*(?:\n|\z)") | t.rlike(r"[#*$%&<>{}\\^~|»›•·!]") | reduce(lambda a, b: a | b, [low.contains(p) for p in (*BOILERPLATE, "http", "www.")])
    out = docs.withColumn("q_counted", counted).withColumns(
        {
            "q_words": F.col("q_counted.words"),
            "q_word_chars": F.col("q_counted.chars"),
            "q_symbols": n_matches(t, SYMBOLS),
            "q_dup_lines": _let(with_words, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long"),
            "q_repeat_words": F.col("q_counted.repeat"),
            "q_text": F.when(suspect, F.array_join(F.filter(lines, is_kept), "\n")).otherwise(t),
        }
    )
    out = out.drop("q_counted")
    same = F.col("q_text") == t
    out = out.withColumn("q_kept_words", F.when(same, F.col("q_words")).otherwise(F.size(words(F.col("q_text"))).cast("long")))
    failed = (F.col("q_words") < min_words) | (F.col("q_repeat_words") * 100 > F.col("q_words") * max_repeat_percent)
    lost = (F.col("q_words") - F.col("q_kept_words")) * 100 > F.col("q_words") * max_lost_percent
    return out.withColumn("q_base_failed", failed).withColumn("q_kept", ~F.col("q_base_failed") & ~lost)


def clean(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents kept, with the failing lines taken out of their text; the columns of docs, whatever their names."""
    judged = quality(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")), **options).where("q_kept")
    new = {text: F.col("q_text")} | ({"n_chars": F.length("q_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return judged.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    q = quality(docs.select("doc_id", "text"))
    return q.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"),
                    F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat_words").alias("n_repeat_words"),
                    F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


#: The same in DuckDB's SQL, for the columns of digest().
_SYM, _BAR, _CLOSERS = r"[#*$%&<>{}\\^~|]", NAVIGATION, CLOSERS.replace("'", "''")
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS x FROM w),
lq AS (SELECT doc_id, x, regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') AS b,
       len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n FROM ln),
lk AS (SELECT doc_id, n, NOT (
         len(b) - len(regexp_replace(b, '{_SYM}', '', 'g')) > 0.1 * len(b)
         OR (len(b) - len(regexp_replace(b, '{_BAR}', '', 'g')) >= 3 AND (len(b) - len(regexp_replace(b, '{_BAR}', '', 'g'))) * 4 >= n)
         OR (n >= 4 AND NOT regexp_matches(x, '[{ENDS}][{_CLOSERS}]*[\x20\x09-\x0D]*$'))
         OR regexp_matches(x, '^[\x20\x09-\x0D]*(https?://|www\.)[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$')
         OR (n >= 5 AND (len(b) - len(regexp_replace(b, '!', '', 'g'))) * 2 >= n)
         OR regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')) AS ok FROM lq),
kw AS (SELECT doc_id, sum(CASE WHEN ok THEN n ELSE 0 END)::BIGINT AS kept_words FROM lk GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
      coalesce(kept_words, 0) AS kept_words FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN kw USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AS base_failed,
  NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND NOT ((n_words - kept_words) * 100 > n_words * 50) AS kept
FROM f
"""
