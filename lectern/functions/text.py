"""Text columns built from Spark's own functions."""

from functools import reduce

from pyspark.sql import Column, functions as F

from lectern.sources import vocab


def lowered(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit("")))


def has_any(col: Column, literals) -> Column:
    """True when any literal occurs in the text, also inside a word."""
    return reduce(lambda a, b: a | b, [col.contains(x) for x in literals])


def first_rule(rules) -> Column:
    """(condition, value) pairs tried in order; NULL when none holds."""
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    without = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    return F.floor(without / F.octet_length(needle))


def occurs_at_least(text: Column, needle: Column, n: int) -> Column:
    """True when a non-empty needle occurs n times without overlap.

    Cutting the text at the n-th occurrence, overlapping or not, is cheap and settles most
    rows; only where it succeeds are the occurrences counted.
    """
    cut = F.call_function("substring_index", text, needle, F.lit(n))
    possible = F.octet_length(cut) < F.octet_length(text)
    return F.when(possible, occurrences(text, needle) >= n).otherwise(F.lit(False))


def quoted(literal: Column) -> Column:
    """A pattern that matches the literal itself."""
    return F.concat(
        F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )


def whole_word_pattern(literal: Column) -> Column:
    """Pattern for the literal between two word boundaries, word characters being ASCII.

    Written with look-around so that it does not depend on the JDK's idea of a boundary,
    and with the literal in front, which lets the engine skip through the text.
    """
    text = quoted(literal)
    before = F.when(literal.rlike(r"^\w"), F.lit(r"(?<!\w")).otherwise(F.lit(r"(?<=\w"))
    after = F.when(literal.rlike(r"\w$"), F.lit(r"(?!\w)")).otherwise(F.lit(r"(?=\w)"))
    return F.concat(text, before, text, F.lit(")"), after)


def has_whole_word(text: Column, literal: Column) -> Column:
    """True when the literal stands between word boundaries.

    An occurrence of a literal of word characters alone overlaps no other one, so such literals
    are replaced by one sign, which counts as a word character, and a sign that stands alone is
    looked for; a pattern of its own for each row is built for the others only.
    """
    sign = F.lit("\u0001")
    marked = F.replace(F.replace(text, sign, F.lit(" ")), literal, sign)
    plain = literal.rlike(r"^\w+$")
    alone = marked.rlike(r"\x01(?![\w\x01])(?<![\w\x01]\x01)")
    return F.when(plain, alone).otherwise(F.rlike(text, whole_word_pattern(literal)))


def highlighted(text: Column, terms: Column, opening="<mark>", closing="</mark>") -> Column:
    pattern = F.concat(
        F.lit("(?i)("), F.array_join(F.transform(terms, quoted), "|"), F.lit(")")
    )
    marked = F.regexp_replace(text, pattern, F.lit(f"{opening}$1{closing}"))
    return F.when(F.size(terms) > 0, marked).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def reading_minutes(text: Column, words_per_minute: int = 200) -> Column:
    return F.greatest(F.lit(1), F.ceil(word_count(text) / F.lit(words_per_minute)).cast("int"))


def filled_lines(text: Column) -> Column:
    """Number of non-blank lines."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S")))


def author_list(authors: Column, n: int) -> Column:
    listed = F.coalesce(authors, F.array().cast("array<string>"))
    return F.concat(
        F.array_join(F.slice(listed, 1, n), ", "),
        F.when(F.size(listed) > n, F.lit(" et al.")).otherwise(F.lit("")),
    )


def citation(authors, title, journal, pub_date, pmid) -> Column:
    return F.format_string(
        "%s. %s %s. %s. PMID: %s",
        author_list(authors, 3), title, journal, pub_date.cast("string"), pmid,
    )


def titled_code(code: Column) -> Column:
    """`meta_analysis` as `Meta Analysis`."""
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def label_of(code: Column, labels: dict, default: Column | None = None) -> Column:
    found = first_rule([(code == k, F.lit(v)) for k, v in labels.items()])
    return F.coalesce(found, code if default is None else default)


def relevance_label(relevance: Column) -> Column:
    return F.when(relevance == 5, F.lit("Practice-Changing")).when(
        relevance >= 4, F.lit("High Relevance")
    )


def article_url(pmid: Column) -> Column:
    return F.concat(F.lit(vocab.ARTICLE_URL), pmid, F.lit("/"))


def doi_url(doi: Column) -> Column:
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit(vocab.DOI_URL), doi))


def text_or_array(value: Column) -> Column:
    """A JSON text holding an array of plain values as an array; anything else as []."""
    parsed = F.try_variant_get(F.try_parse_json(value), "$", "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def array_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def lower_terms(*arrays: Column) -> Column:
    """Distinct lower-case terms of several arrays of one row."""
    joined = F.concat(*[array_or_empty(a) for a in arrays])
    return F.array_distinct(F.transform(joined, lambda t: F.lower(t)))
