"""Line-first cleaning (operator 7), DataFrame functions only.

Every line is judged alone by punctuation, navigation, boilerplate, capitals and repetition
rules; failing lines are removed, and a document that loses more than half of its characters
this way is rejected. The cleaning never looks across rows, so there is no shuffle at all.

Defined results: a null text counts as ''; a text without words has zeros everywhere and fails
the base test; lines without a word are never judged and stay; repeated rows are judged one by
one; `clean_documents` carries other columns through, but for those named like its results, which it
replaces; the pipeline's stage keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefield.llm.common import WORD, let, table

#: Words in a window of the repetition count.
WINDOW = 8
#: A document may lose this part of its characters.
MAX_LOSS = 0.5
SYMBOLS = r"[#*$%&|<>]"
#: Ends of a sentence, quotes and brackets after them included.
TERMINAL = r"[.!?:;\x{2026}][\x22'\x{201D}\x{2019})\]]*[\x20\x09-\x0D]*$"
#: Site furniture, matched without regard to case in lines of at most BOILER_WORDS words.
BOILERPLATE = (
    r"(?i)(\bcookies?\b|privacy policy|terms of (use|service)|all rights reserved|\bsubscribe\b|\bsign (up|in)\b"
    r"|\blog ?in\b|javascript|\bcopyright\b|read more|click here|share this|skip to (main )?content|newsletter)"
)
BOILER_WORDS = 20


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line (with its words) breaks a rule; lines without words never do."""
    n = F.size(words)
    noise = _count(line, r"[#*$%&|<>!]")
    separators = _count(line, r"[|>\x{00BB}]")
    upper, lower = _count(line, "[A-Z]"), _count(line, "[a-z]")
    punctuation = (noise >= 3) & (2 * noise >= n)
    navigation = ((separators >= 3) & (3 * separators >= n)) | ((n <= 2) & ~F.rlike(line, F.lit(TERMINAL)))
    capitals = (upper >= 10) & (upper > 4 * lower)
    boilerplate = (n <= BOILER_WORDS) & F.rlike(line, F.lit(BOILERPLATE))
    repetition = (n >= 10) & (3 * F.size(F.array_distinct(words)) < n)
    return (n > 0) & (punctuation | navigation | capitals | boilerplate | repetition)


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text. Windows are told
    apart by 64-bit hashes of word hashes; only texts with a repeated one are sorted."""

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(y["h"] == x["h"], F.lit(False))
        again = let(pairs, lambda p: F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1))))
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            starts, zero,
            lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n")),
            lambda acc: acc["n"],
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(found)


def clean_documents(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """docs with clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept added; text stays as it was."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    split = docs.withColumn("lines_", lines)
    split = split.withColumn("line_words_", F.transform("lines_", lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))
    judged = split.withColumns({
        "words_": F.flatten("line_words_"),
        "judged_": F.zip_with(
            "lines_", "line_words_",
            lambda x, w: F.struct(x.alias("line"), (F.size(w) > 0).alias("full"), line_fails(x, w).alias("fails"), F.length(x).alias("chars")),
        ),
    })
    full = F.transform(F.filter("judged_", lambda x: x["full"]), lambda x: x["line"])
    total = lambda of: F.aggregate(F.filter("judged_", of), F.lit(0), lambda a, x: a + x["chars"])
    counted = judged.withColumns({
        "n_words": F.size("words_").cast("long"),
        "word_chars": F.length(F.array_join("words_", "")).cast("long"),
        "n_symbols": _count(F.coalesce(F.col("text"), F.lit("")), SYMBOLS).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(F.col("words_")).cast("long"),
        "lost_": total(lambda x: x["fails"]),
        "chars_": total(lambda x: x["full"]),
        "clean_text": F.array_join(F.transform(F.filter("judged_", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
    })
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.col("lost_") <= F.lit(max_loss) * F.col("chars_")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict).drop(
        "lines_", "line_words_", "words_", "judged_", "lost_", "chars_"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rejected documents go, failing lines of the others too."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    # a filter on a generated column stays above it: the lines are judged once, not once more to filter
    judged = clean_documents(rows).select("row", F.explode(F.array(F.struct("clean_text", "kept"))).alias("judged")).where("judged.kept")
    return judged.select("row", "judged.clean_text").select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _sql_count(text: str, pattern: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


def oracle() -> str:
    quoted = lambda p: p.replace("'", "''")
    noise, seps = _sql_count("line", "[#*$%&|<>!]"), _sql_count("line", r"[|>\x{00BB}]")
    upper, lower = _sql_count("line", "[A-Z]"), _sql_count("line", "[a-z]")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM d),
win AS (SELECT rid, i, array_to_string(words[i + 1:i + {WINDOW}], ' ') AS s
        FROM (SELECT rid, words, unnest(range(0, len(words) - {WINDOW - 1})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT rid, line, regexp_extract_all(line, '{WORD}') AS lw FROM l0),
l2 AS (SELECT rid, line, lw, len(lw) AS n, {noise} AS noise, {seps} AS seps, {upper} AS up, {lower} AS low FROM l1 WHERE len(lw) > 0),
l3 AS (SELECT rid, line, ((noise >= 3 AND 2 * noise >= n) OR (seps >= 3 AND 3 * seps >= n)
        OR (n <= 2 AND NOT regexp_matches(line, '{quoted(TERMINAL)}')) OR (up >= 10 AND up > 4 * low)
        OR (n <= {BOILER_WORDS} AND regexp_matches(line, '{quoted(BOILERPLATE)}'))
        OR (n >= 10 AND 3 * len(list_distinct(lw)) < n)) AS fails FROM l2),
l4 AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(length(line)) AS chars,
        sum(CASE WHEN fails THEN length(line) ELSE 0 END) AS lost FROM l3 GROUP BY rid),
r AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        {_sql_count("text", SYMBOLS)}::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(chars, 0) AS chars
      FROM w LEFT JOIN cov USING (rid) LEFT JOIN l4 USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND lost <= {MAX_LOSS} * chars) AS kept FROM b"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": oracle()}
