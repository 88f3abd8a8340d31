"""What answers may say about findings, decided over tables of both.

Facts are taken apart once into their leaves, whatever their nesting. From the leaves come four small tables: the
numbers that a finding allows, the signs of its changes, the labels of the data by their words, and how sure a finding
is. An answer is taken apart the same way, into numbers, directions, runs of capitalised words and sentences, and joins
on citations and words leave what the facts don't cover: one row for each problem, nothing for an answer that may be
shown.

Kinds of problems: `empty` text; `uncited`, no cited finding exists; `number` that no cited finding allows; `name` that
shares no label's words; `direction` against the sign of every cited change; `cause` claimed without a finding that
splits a change; `certainty` about what is doubtful in all cited findings; `absent` subject spoken of in a sentence
that doesn't deny it; `advice`; `length`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.functions.text import directive_count, numbers_in
from salesprism.plans.findings import Finding
from salesprism.scratch import written

# Words that claim a cause, hedges, words of direction, types of findings that may name a cause.
CAUSES = ("because", "caused by", "caused", "due to", "driven by", "drove", "as a result of", "resulted in", "led to", "leading to", "explains why", "the reason", "thanks to", "owing to", "brought about")
HEDGES = ("may", "might", "appears", "appear", "seems", "seem", "suggests", "suggest", "not clear", "unclear", "possibly", "roughly", "around", "about", "tentative", "early", "not certain", "cannot be separated", "within normal")
UP = ("rose", "grew", "increased", "climbed", "up", "higher", "gained", "improved")
DOWN = ("fell", "dropped", "declined", "decreased", "down", "lower", "lost", "shrank")
CAUSAL_TYPES = ("DECOMPOSITION", "REPEAT_VS_NEW")
MOST_WORDS, LONGEST_NAME = 160, 60
#: A sentence with one of these denies something.
DENIALS = r"\b(no|not|nor|none|nothing|never|neither|without|cannot|unable)\b|n't\b"
#: Facts of the engine whose sign is a direction.
SIGNED = ("change", "change_pct", "total_change", "largest_mover_change", "trend_per_period", "volume_effect", "price_effect", "new_change_pct", "repeat_change_pct", "peak_lift", "trough_dip", "elasticity")
SURE = ("strong", "clear", "descriptive")
NAME_RUN = r"\p{Lu}[\p{L}\p{N}&'-]*(?: \p{Lu}[\p{L}\p{N}&'-]*)+"
ANSWERS, FINDINGS = "answer_id string, text string, cited array<string>, absent array<string>", "id string, type string, summary string, facts string, strength string"


def fact_leaves(findings: DataFrame) -> DataFrame:
    """(id, key, text, number) of every leaf of the facts; key is that of the object around it, through lists. Keys of objects are leaves as well, without a key."""
    spark = findings.sparkSession
    level = findings.select("id", F.lit("").alias("key"), F.parse_json("facts").alias("v"))
    deepest, out = _depth(findings), None
    for _ in range(deepest):
        parts = level.alias("l").lateralJoin(spark.tvf.variant_explode(F.col("l.v").outer()).alias("x"))
        parts = parts.select("id", F.coalesce(F.col("x.key"), F.col("l.key")).alias("key"), F.col("x.key").alias("own_key"), F.col("x.value").alias("v")).withColumn("kind", F.schema_of_variant("v"))
        text = F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string"))
        number = F.when(~F.col("kind").rlike("^(STRING|BOOLEAN|VOID|OBJECT|ARRAY)"), F.try_variant_get("v", "$", "double"))
        leaves = parts.select("id", "key", text.alias("text"), number.alias("number")).where("text is not null or number is not null")
        leaves = leaves.unionByName(parts.where("own_key is not null").select("id", F.lit("").alias("key"), F.col("own_key").alias("text"), F.lit(None).cast("double").alias("number")))
        out = leaves if out is None else out.unionByName(leaves)
        level = parts.where(F.col("kind").rlike("^(OBJECT|ARRAY)")).select("id", "key", "v")
    return out


def _depth(findings: DataFrame) -> int:
    """An upper bound of how deep facts nest, from their opening brackets."""
    nesting = F.aggregate(
        F.regexp_extract_all("facts", F.lit(r"([\[\]{}])"), F.lit(1)), F.struct(F.lit(0).alias("now"), F.lit(1).alias("most")),
        lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most")), lambda a: a["most"],
    )
    return max(1, findings.agg(F.max(nesting)).first()[0] or 1)


def _plain(value: Column, digits: int) -> Column:
    """A number as text with so many digits, without zeros at the end of a fraction."""
    text = value.try_cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if digits else text


def allowed_numbers(findings: DataFrame, leaves: DataFrame) -> DataFrame:
    """(id, number): as it is, as per cent, in thousands and millions, to whole numbers and one or two digits; numbers inside texts as they stand."""
    size = F.abs("number")
    forms = F.array(*[_plain(x, d) for x in (size, size * 100, size / 1e3, size / 1e6) for d in (0, 1, 2)])
    written = leaves.where("text is not null").select("id", "text").unionByName(findings.select("id", F.col("summary").alias("text")))
    return leaves.where("number is not null").select("id", F.explode(forms).alias("number")).unionByName(written.select("id", F.explode(numbers_in(F.col("text"))).alias("number"))).where("number is not null").distinct()


def signs(leaves: DataFrame) -> DataFrame:
    """(id, sign) of what rose (1) or fell (-1)."""
    sign = F.when(F.col("key").isin(*SIGNED) & (F.col("number") != 0), F.signum("number").cast("int")).when(F.col("key") == "direction", F.when(F.col("text") == "up", 1).when(F.col("text") == "down", -1))
    return leaves.select("id", sign.alias("sign")).where("sign is not null").distinct()


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def labels_of(leaves: DataFrame) -> DataFrame:
    """(label, words): the labels of the data; longer texts are sentences."""
    labels = leaves.where(F.length("text") <= LONGEST_NAME).select(F.lower(F.trim("text")).alias("label")).distinct()
    return labels.withColumn("words", words_of(F.col("label"))).where(F.size("words") > 0)


def _any_of(words: tuple[str, ...]) -> str:
    return rf"\b({'|'.join(words)})\b"


def _says(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(_any_of(words))


def unknown_names(answers: DataFrame, leaves: DataFrame) -> DataFrame:
    """(answer_id, name) of runs of capitalised words that neither hold all words of a label nor lie within one.

    A label that lies in a run shares its rarest word with it, and so does a run that lies in a label: both meet by
    that word only, so words that many labels have join nothing.
    """
    labels = written(labels_of(leaves), "labels")
    runs = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({NAME_RUN})"), F.lit(1)))).alias("name")).withColumn("run_words", words_of(F.col("name")))
    counts = labels.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def rarest(table: DataFrame, words: str, *keys: str) -> DataFrame:
        """table with `word`, the rarest of its words among labels; none if one is in no label."""
        t = table.select(*keys, words, F.explode(words).alias("word")).join(counts, "word", "left").groupBy(*keys, words)
        return t.agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").drop("n")

    around = runs.select("answer_id", "name", "run_words", F.explode("run_words").alias("word")).join(rarest(labels, "words", "label"), "word").where(F.size(F.array_except("words", "run_words")) == 0)
    within = rarest(runs, "run_words", "answer_id", "name").join(labels.select("words", F.explode("words").alias("word")), "word").where(F.size(F.array_except("run_words", "words")) == 0)
    known = around.select("answer_id", "name").unionByName(within.select("answer_id", "name")).distinct()
    return runs.select("answer_id", "name").join(known, ["answer_id", "name"], "left_anti")


def problems(answers: DataFrame, findings: DataFrame) -> DataFrame:
    """(answer_id, kind, detail) of all problems of answers (answer_id, text, cited, absent) with findings (id, type, summary, facts, strength)."""
    # both tables and the leaves are read by every check; they are made once
    findings = written(findings, "findings")
    leaves = written(fact_leaves(findings), "leaves")
    low = F.lower("text")
    answers = answers.select("answer_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited"), F.coalesce("absent", F.array().cast("array<string>")).alias("absent"))
    answers = written(answers, "answers")
    spoken = answers.where(F.trim("text") != "")
    cites = spoken.select("answer_id", F.explode(F.array_distinct("cited")).alias("id")).join(findings.select("id", "type", "strength"), "id")
    backed = cites.groupBy("answer_id").agg(F.max(F.col("strength").isin(*SURE)).alias("sure"), F.max(F.col("type").isin(*CAUSAL_TYPES)).alias("splits"))
    backed = written(backed, "backed")
    used = written(spoken.join(backed, "answer_id"), "used")
    found = lambda rows, kind, detail=F.lit(""): rows.select("answer_id", F.lit(kind).alias("kind"), detail.alias("detail"))

    numbers = used.select("answer_id", F.explode(F.array_distinct(numbers_in(F.col("text")))).alias("number"))
    allowed = cites.select("answer_id", "id").join(allowed_numbers(findings, leaves), "id").select("answer_id", "number").distinct()
    directions = used.select("answer_id", F.explode(F.array_compact(F.array(F.when(_says(low, UP), 1), F.when(_says(low, DOWN), -1)))).alias("sign"))
    known_signs = cites.select("answer_id", "id").join(signs(leaves), "id").select("answer_id", "sign").distinct()
    turned = directions.join(known_signs.select("answer_id").distinct(), "answer_id").join(known_signs, ["answer_id", "sign"], "left_anti")
    sentences = used.select("answer_id", "absent", F.explode(F.split(low, r"(?<=[.!?])\s+")).alias("sentence"))
    spoken_of = sentences.select("answer_id", "sentence", F.explode("absent").alias("subject")).where(F.contains("sentence", F.lower("subject")) & ~F.col("sentence").rlike(DENIALS))
    parts = [
        found(answers.where(F.trim("text") == ""), "empty"),
        found(spoken.join(backed, "answer_id", "left_anti"), "uncited"),
        found(numbers.join(allowed, ["answer_id", "number"], "left_anti"), "number", F.col("number")),
        found(unknown_names(used.select("answer_id", "text"), leaves), "name", F.col("name")),
        found(turned, "direction", F.when(F.col("sign") > 0, "up").otherwise("down")),
        found(used.where(_says(low, CAUSES) & ~F.col("splits")), "cause"),
        found(used.where(~F.col("sure") & ~_says(low, HEDGES)), "certainty"),
        found(spoken_of.select("answer_id", "subject").distinct(), "absent", F.col("subject")),
        found(used.where(directive_count(F.col("text")) > 0), "advice"),
        found(used.where(F.size(F.split(F.trim("text"), r"\s+")) > MOST_WORDS), "length"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(answers: DataFrame, findings: DataFrame) -> DataFrame:
    """(answer_id, shown, problems): one row an answer, its problems sorted, as kind or kind:detail."""
    listed = problems(answers, findings).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.when(F.col("detail") == "", F.col("kind")).otherwise(F.concat_ws(":", "kind", "detail")))).alias("problems"))
    return answers.select("answer_id").join(listed, "answer_id", "left").select("answer_id", F.col("problems").isNull().alias("shown"), F.coalesce(F.array_join("problems", ", "), F.lit("")).alias("problems"))


def findings_table(spark: SparkSession, found: list[Finding]) -> DataFrame:
    """Findings of a story as the table that answers are checked against."""
    import json

    return spark.createDataFrame([(f.id, f.type, f.summary, json.dumps(f.facts, default=str), f.strength) for f in found], FINDINGS)


def check_answers(spark: SparkSession, answers: list[tuple[str, list[str], list[str]]], found: list[Finding]) -> list[list[str]]:
    """The problems of each of some answers (text, cited, absent)."""
    table = spark.createDataFrame([(f"{k:09d}", *a) for k, a in enumerate(answers)], ANSWERS)
    got = {r["answer_id"]: r["problems"] for r in verdicts(table, findings_table(spark, found)).collect()}
    return [x.split(", ") if x else [] for _, x in sorted(got.items())]
