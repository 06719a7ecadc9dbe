"""Quality rules: a threshold table compiled into one projection, all in Spark functions.

Each rule of the table is a ratio of two counts with a lower and an upper bound. The
counts come from the whole text: its words, symbols, stop words, lines and the words in
repeated 8-word windows. Nothing is shuffled, and no user function runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8

# Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is was it for on with as be by are at from this have not "
    "le la les de des et un une du en est que pour dans qui sur pas au il ne "
    "der die das und ist nicht mit von den ein eine zu auf sich für dem es im "
    "el los las y se por con no su para al lo como más"
).split()
_STOP_FORMS = sorted({w + end for w in STOP_WORDS for end in ("", ",", ".", ";", ":")})

#: name, numerator, denominator, least, most (None: no bound). A document is kept if every
#: ratio lies in its bounds; a ratio with denominator 0 passes.
THRESHOLDS = (
    ("mean_word_length", "word_chars", "n_words", 3.0, 10.0),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null."""
    return F.array_remove(F.split(F.translate(text, WHITE[1:], " " * (len(WHITE) - 1)), " "), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once a row, even where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words of ``w`` in windows found twice or more in it. Hashes of the windows only show
    that nothing repeats; where they repeat, the windows themselves are compared."""
    starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))
    texts = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("t"), i.alias("i")))

    def repeated(s: Column) -> Column:
        def at(x: Column, k: Column) -> Column:
            same = lambda j: F.try_element_at(s, j)["t"] == x["t"]
            return F.when(F.when(k > 0, same(k)).otherwise(False) | F.coalesce(same(k + 2), F.lit(False)), x["i"])

        return F.array_sort(F.filter(F.transform(s, at), lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        gap = lambda i, k: F.least(F.lit(window), F.coalesce(F.try_element_at(p, k + 2) - i, F.lit(window)))
        return F.aggregate(F.transform(p, gap), F.lit(0), lambda a, x: a + x)

    exact = _let(F.array_sort(texts), lambda s: _let(repeated(s), covered))
    none = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(w) <= window, 0).when(none, 0).otherwise(exact)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as a struct ``row`` beside the counts n_words, word_chars, n_symbols,
    n_stop_words, n_lines, n_dup_lines and n_repeat_words (long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    base = base.select("row", "text", "w", lines.alias("lines"))
    count = lambda c, name: c.cast("long").alias(name)
    return base.select(
        "row",
        count(F.size("w"), "n_words"),
        count(F.length(F.translate("text", WHITE, "")), "word_chars"),
        count(F.length("text") - F.length(F.translate("text", SYMBOLS, "")), "n_symbols"),
        count(F.size(F.filter("w", lambda x: x.isin(_STOP_FORMS))), "n_stop_words"),
        count(F.size("lines"), "n_lines"),
        count(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        count(repeat_words(F.col("w")), "n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over the counts."""
    ok = F.lit(True)
    for _, over, under, least, most in thresholds:
        # Products, not quotients: no division by zero and no rounding of the ratio.
        if least is not None:
            ok = ok & (F.col(over) >= F.lit(least) * F.col(under))
        if most is not None:
            ok = ok & (F.col(over) <= F.lit(most) * F.col(under))
    return ok


def judge(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns as a struct), the counts,
    base_failed and kept. A null or empty text has no words and fails. Other columns,
    whatever their names, stay inside ``row``. An empty table gives an empty result."""
    found = features(docs, text_col).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    # A projection with this id isn't passed by filters. Else the optimizer would put the
    # verdict below the projection that makes the words, and make them for each window.
    found = judge(docs, text_col).withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return found.filter("kept").select("row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP_FORMS)
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS t
        FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (
          SELECT win.r, unnest(range(i, i + 8)) AS p FROM win
          JOIN (SELECT r, t FROM win GROUP BY r, t HAVING count(*) > 1) m ON win.r = m.r AND win.t = m.t) GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS n_stop,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN rep USING (r)),
g AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 3.0 * n_words AND word_chars <= 10.0 * n_words AND n_symbols <= 0.1::DOUBLE * n_words
    AND n_stop >= 0.02::DOUBLE * n_words AND n_dup_lines <= 0.5::DOUBLE * len(lines) AS kept
FROM g
"""
