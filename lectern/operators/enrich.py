"""Enrichment by a language model: what to ask for, and what came back.

The call itself is left to the caller: requests are a table, and landed responses are one.
"""

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import filled_lines

TEMPLATE = (
    "Summarise the paper below for urologists in Korea. Answer with JSON only, with the "
    "keys summary_ko (three Korean sentences on separate lines: aim, method and results, "
    "meaning), structured (study_design, sample_size, key_finding, population), "
    "clinical_relevance (1 to 5) and qa (one list entry with q and a).\n\n"
    "Title: {title}\n\nAbstract: {abstract}\n\nJSON response:"
)

RESPONSE = """candidates array<struct<content: struct<
    parts: array<struct<text: string, thought: boolean>>>>>"""
ANSWER = """struct<summary_ko: string,
    structured: struct<study_design: string, sample_size: string, key_finding: string,
                       population: string>,
    qa: array<struct<q: string, a: string>>>"""


def incomplete() -> Column:
    summary = F.coalesce("summary_ko", F.lit(""))
    no_answers = F.col("qa_data").isNull() | (F.size("qa_data") == 0)
    no_relevance = F.coalesce("clinical_relevance", F.lit(0)) == 0
    return (filled_lines(summary) < 3) | no_answers | no_relevance


def enrichment_candidates(papers: DataFrame, newest: int | None = None) -> DataFrame:
    """Papers with an abstract and something missing; with `newest`, only the newest of them."""
    missing = papers.where((F.col("abstract") != "") & incomplete())
    if newest is None:
        return missing
    return missing.orderBy(F.desc_nulls_first("fetched_at"), "id").limit(newest)


def enrichment_requests(
    papers: DataFrame, template: str = TEMPLATE, abstract_chars: int | None = None
) -> DataFrame:
    """One prompt per paper; `abstract_chars` cuts the abstract for a service with a limit."""

    def given(column, default):
        return F.when(F.coalesce(column, F.lit("")) != "", F.col(column)).otherwise(default)

    before, rest = template.split("{title}")
    between, after = rest.split("{abstract}")
    abstract = given("abstract", "No abstract.")
    if abstract_chars is not None:
        abstract = F.substring(abstract, 1, abstract_chars)
    prompt = F.concat(
        F.lit(before),
        given("title", "Untitled"),
        F.lit(between),
        abstract,
        F.lit(after),
    )
    return papers.select("id", "pmid", prompt.alias("prompt"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def answer_text(body: Column) -> Column:
    """The last part with text that is no thought, else the last part with text."""
    first = F.get(F.from_json(body, RESPONSE)["candidates"], 0)
    parts = first["content"]["parts"]
    spoken = F.filter(parts, lambda p: p["text"].isNotNull())
    final = F.filter(spoken, lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    return _stripped(
        F.coalesce(
            F.try_element_at(final, F.lit(-1))["text"],
            F.try_element_at(spoken, F.lit(-1))["text"],
        )
    )


def without_fence(text: Column) -> Column:
    opened = F.when(
        text.startswith("```"), F.regexp_replace(text, r"^```[^\n]*(\n|$)", "")
    ).otherwise(text)
    closed = F.when(opened.endswith("```"), F.regexp_replace(opened, r"```$", ""))
    return _stripped(F.coalesce(closed, opened))


def parsed_responses(responses: DataFrame) -> DataFrame:
    """Fields to store per response (pmid, body); a response without text is left out.

    A text that is no JSON object becomes the summary as it is, and so does one whose
    relevance is no number; its structured part is kept then, its questions are not.
    """
    answers = responses.select("pmid", answer_text(F.col("body")).alias("raw")).where(
        F.coalesce("raw", F.lit("")) != ""
    )
    cleaned = answers.withColumn("cleaned", without_fence(F.col("raw")))
    is_object = F.col("cleaned").startswith("{") & F.try_parse_json("cleaned").isNotNull()
    read = cleaned.withColumn("is_object", is_object).withColumn(
        "answer", F.when(F.col("is_object"), F.from_json("cleaned", ANSWER))
    )
    stated = F.get_json_object("cleaned", "$.clinical_relevance")
    number = F.coalesce(stated.try_cast("int"), stated.try_cast("double").cast("int"))
    given = F.when(~stated.isin("", "0", "false", "null"), stated)
    readable = F.col("is_object") & (given.isNull() | number.isNotNull())
    structured = F.col("answer.structured")
    some_structure = F.coalesce(
        *[structured[f] for f in ("study_design", "sample_size", "key_finding", "population")]
    )
    result = read.select(
        "pmid",
        F.when(readable, F.coalesce("answer.summary_ko", F.lit("")))
        .otherwise(F.col("raw"))
        .alias("summary_ko"),
        F.when(some_structure.isNotNull(), structured).alias("structured_data"),
        F.when(readable & given.isNotNull(), number).alias("clinical_relevance"),
        F.when(readable & (F.size("answer.qa") > 0), F.col("answer.qa")).alias("qa_data"),
        readable.alias("parsed"),
    )
    lines = filled_lines(F.col("summary_ko"))
    return result.withColumn("malformed", (F.col("summary_ko") != "") & (lines != 3))


def enrichment_report(requests: DataFrame, parsed: DataFrame) -> DataFrame:
    """Requests, answers stored, answers missing, and answers not of three lines."""
    answered = parsed.select("pmid", "malformed").dropDuplicates(["pmid"])
    joined = requests.select("pmid").join(answered, "pmid", "left")
    return joined.agg(
        F.count("*").alias("asked"),
        F.count("malformed").alias("done"),
        F.count_if(F.col("malformed").isNull()).alias("failed"),
        F.count_if(F.col("malformed")).alias("malformed"),
    )
