"""Quality rules: counts of words, symbols and repeats, and divergence from the language.

The characters of a document (by class) and its common words (the function words of its
language and all others) make two histograms. Each is compared with the same histogram summed
over all long enough documents of the language, by Jensen-Shannon distance. Documents too
short for a histogram are not judged by it.

DataFrame functions only; all of a document's counts are made inside its row.
"""

from pyspark.sql import Column, DataFrame, functions as F

#: Frequent function words by language.
COMMON = {
    "en": "the of and to in a is that for it was on with as by at".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "es": "de la que el en y los se del las un por con no una su".split(),
}
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"#*$%&|<>"
#: Least words and characters of a document for base rules and histograms.
LEAST_WORDS, LEAST_CHARS = 50, 400
#: Least words of a document for its histogram of words.
LEAST_COMMON = 100
#: Largest share of repeated words, in percent.
MOST_REPEATED = 50
#: Largest distances of characters and of words; a language has a reference from so many documents.
MOST_CLASS, MOST_WORD, LEAST_DOCS = 0.3, 0.28, 5
CLASSES = ["lower", "upper", "digit", "mark", "symbol", "blank", "rest"]


def only_chars(text: Column, kept: str) -> Column:
    """How many characters of the class there are."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, language, words and the four counts of the base rules, class and word counts.

    Null texts count as empty. `language` is lang if its function words are known, else
    "other". A word is a run without ASCII white space.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.when(F.col("lang").isin(*COMMON), F.col("lang").cast("string"))
        .otherwise("other")
        .alias("language"),
    ).withColumn("words", F.filter(F.split("text", BLANK + "+"), lambda w: w != ""))
    words = F.col("words")
    trios = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    common = F.create_map(
        *(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v))))
    )
    known = sorted({w for v in COMMON.values() for w in v})
    rows = rows.withColumns(
        {
            "trios": F.when(F.size(words) >= 3, trios).otherwise(F.array().cast("array<bigint>")),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANK[1:]}")),
            "common": F.coalesce(
                F.try_element_at(common, F.col("language")), F.array().cast("array<string>")
            ),
            "hits": F.filter(F.transform(words, F.lower), lambda w: w.isin(*known)),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": only_chars(text, SYMBOLS),
            "lower": only_chars(text, "a-z"),
            "upper": only_chars(text, "A-Z"),
            "digit": only_chars(text, "0-9"),
            "mark": only_chars(text, r".,;:!?'\"()\-"),
            "n_chars": F.length(text).cast("long"),
        }
    )
    hits, common = F.col("hits"), F.col("common")
    each = F.transform(common, lambda c: F.size(F.filter(hits, lambda w: w == c)).cast("long"))
    again = F.size(F.array_distinct("trios")) < F.size("trios")
    placed = F.transform("trios", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumns(
        {
            "sorted": F.when(again, F.sort_array(placed)).otherwise(nothing),
            "each": each,
            "blank": F.col("n_chars") - F.col("word_chars"),
        }
    )
    s = F.col("sorted")
    twice = F.filter(
        F.transform(
            s,
            lambda x, k: F.when(
                (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2))))
    named = ("lower", "upper", "digit", "mark", "n_symbols", "blank")
    rest = F.col("n_chars") - sum(F.col(c) for c in named)
    total = F.aggregate("each", F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select(
        "doc_id",
        "language",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        "n_chars",
        F.array(*named, rest).alias("by_class"),
        F.concat("each", F.array(F.size("words") - total)).alias("by_word"),
    )


def references(counts: DataFrame) -> DataFrame:
    """Summed histograms of each language, at most one row per key of COMMON and "other"."""
    fit = counts.filter((F.col("n_words") >= LEAST_WORDS) & (F.col("n_chars") >= LEAST_CHARS))
    most = max(map(len, COMMON.values())) + 1
    sums = [F.sum(F.get("by_class", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))]
    sums += [F.sum(F.get("by_word", F.lit(k))).alias(f"w{k}") for k in range(most)]
    found = fit.groupBy("language").agg(F.count("*").alias("docs"), *sums)
    return found.filter(F.col("docs") >= LEAST_DOCS).select(
        "language",
        F.array(*(f"c{k}" for k in range(len(CLASSES)))).alias("class_ref"),
        F.filter(F.array(*(f"w{k}" for k in range(most))), lambda n: n.isNotNull()).alias(
            "word_ref"
        ),
    )


def divergence(mine: Column, other: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts of one length."""

    def shares(counts):
        whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
        return F.transform(counts, lambda n: n / F.greatest(whole, F.lit(1)))

    def half(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    both = F.zip_with(
        shares(mine),
        shares(other),
        lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2),
    )
    whole = F.aggregate(both, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(whole / 2, F.lit(0.0)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, distances and verdicts.

    base_failed: fewer than 50 words, or over half of them in repeated windows of three.
    kept: not base_failed and neither distance too large. A distance is null, and does not
    count, if the document is shorter than LEAST_CHARS (or LEAST_COMMON words) or its language has fewer than
    LEAST_DOCS documents. The references are at most five rows, so they are broadcast.
    """
    counts = counted(docs)
    judged = counts.join(F.broadcast(references(counts)), "language", "left")
    long_enough = F.col("n_chars") >= LEAST_CHARS
    base = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return (
        judged.withColumn("base_failed", base)
        .withColumn(
            "class_distance",
            F.when(long_enough, divergence(F.col("by_class"), F.col("class_ref"))),
        )
        .withColumn(
            "word_distance",
            F.when(
                long_enough & (F.col("n_words") >= LEAST_COMMON),
                divergence(F.col("by_word"), F.col("word_ref")),
            ),
        )
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS)
            & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD),
        )
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: the counts of the base rules and both verdicts."""
    return quality_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def check_sql() -> str:
    """The same by grouped rows instead of arrays, over the table documents."""

    def quoted(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    lists = " ".join(f"WHEN lang = '{k}' THEN {quoted(v)}" for k, v in COMMON.items())
    chars = {"lower": "a-z", "upper": "A-Z", "digit": "0-9"}
    chars |= {"mark": r".,;:!?''\"()\-", "n_symbols": SYMBOLS}
    classes = ", ".join(
        f"length(regexp_replace(t, '[^{v}]', '', 'g')) AS {k}" for k, v in chars.items()
    )
    return f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                   CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON)}) THEN lang
                        ELSE 'other' END AS language,
                   CASE {lists} ELSE CAST([] AS VARCHAR[]) END AS common
            FROM documents),
        s AS (
            SELECT *, list_filter(regexp_split_to_array(t, '{BLANK}+'), lambda x: x <> '') AS ws,
                   list_filter(string_split(t, chr(10)),
                               lambda x: regexp_matches(x, '[^{BLANK[1:]}')) AS ls,
                   {classes}
            FROM d),
        trios AS (
            SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS trio
            FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)),
        twice AS (SELECT r, i FROM trios QUALIFY count(*) OVER (PARTITION BY r, trio) > 1),
        covered AS (
            SELECT r, count(DISTINCT i + k) AS n
            FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
        f AS (
            SELECT s.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                   length(t) AS n_chars, coalesce(c.n, 0) AS n_repeat_words
            FROM s LEFT JOIN covered c USING (r)),
        classes AS (
            SELECT r, language, n_words, n_chars, unnest(['lower', 'upper', 'digit', 'mark',
                       'symbol', 'blank', 'rest']) AS cell,
                   unnest([lower, upper, digit, mark, n_symbols, n_chars - word_chars,
                           word_chars - lower - upper - digit - mark - n_symbols]) AS n
            FROM f),
        hits AS (
            SELECT r, w, count(*) AS n
            FROM (SELECT r, lower(unnest(ws)) AS w FROM f) GROUP BY r, w),
        named AS (
            SELECT f.r, f.language, f.n_words, f.n_chars, c.cell, coalesce(h.n, 0) AS n
            FROM f JOIN (SELECT r, unnest(common) AS cell FROM f) c ON c.r = f.r
            LEFT JOIN hits h ON h.r = c.r AND h.w = c.cell),
        words AS (
            SELECT * FROM named
            UNION ALL
            SELECT f.r, f.language, f.n_words, f.n_chars, '' AS cell,
                   f.n_words - coalesce(sum(named.n), 0) AS n
            FROM f LEFT JOIN named ON named.r = f.r
            GROUP BY f.r, f.language, f.n_words, f.n_chars),
        cells AS (SELECT 'class' AS kind, * FROM classes
                  UNION ALL SELECT 'word' AS kind, * FROM words),
        refs AS (
            SELECT kind, language, cell, sum(n) AS n FROM cells
            WHERE n_words >= {LEAST_WORDS} AND n_chars >= {LEAST_CHARS}
            GROUP BY kind, language, cell HAVING count(*) >= {LEAST_DOCS}),
        shares AS (
            SELECT c.kind, c.r,
                   c.n / greatest(sum(c.n) OVER (PARTITION BY c.kind, c.r), 1) AS p,
                   q.n / greatest(sum(q.n) OVER (PARTITION BY c.kind, c.r), 1) AS q
            FROM cells c JOIN refs q USING (kind, language, cell)),
        far AS (
            SELECT kind, r, sqrt(greatest(sum(
                       CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                       + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS x
            FROM shares GROUP BY kind, r)
        SELECT doc_id, n_words, word_chars, n_symbols,
               len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words,
               (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
                   AS base_failed,
               NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
                   AND (n_chars < {LEAST_CHARS} OR coalesce(a.x, 0) <= {MOST_CLASS})
                   AND (n_chars < {LEAST_CHARS} OR n_words < {LEAST_COMMON}
                        OR coalesce(b.x, 0) <= {MOST_WORD}) AS kept
        FROM f
        LEFT JOIN far a ON a.r = f.r AND a.kind = 'class'
        LEFT JOIN far b ON b.r = f.r AND b.kind = 'word'
    """
