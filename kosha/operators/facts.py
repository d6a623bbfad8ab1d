"""Mining, validating and reviewing knowledge units (facts with evidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import any_of, bound, cascade, phrase

# Kinds of units and domains, and the word lists of the heuristics, in the order in which they are tried.
UNIT_TYPES = ["claim", "definition", "process", "comparison", "observation", "practice", "principle", "prescription"]
DOMAINS = ["crop", "practice", "input_material", "season", "region", "pest", "soil", "water", "general"]
NEED_BOTH = ["claim", "comparison", "prescription"]
NEED_SUBJECT = ["principle", "observation", "practice"]
UNITS = ["kg", "g", "litre", "liter", "ml", "ton", "acre", "hectare", "day", "days", "hour", "hours", "%"]
VERBS = [
    "increase", "increases", "increased", "reduce", "reduces", "improve", "improves", "enhance", "enhances", "should", "must", "recommended", "apply", "applied",
    "prepared", "ferment", "compost", "compared", "versus", "means", "defined as", "is", "are",
]
NOUNS = ["soil", "crop", "seed", "water", "yield", "pest", "disease"]
COMPARING = ["compared", "versus", "than"]
HEDGES = ["may", "might", "possibly"]
TYPE_RULES = [
    ("comparison", COMPARING),
    ("prescription", ["should", "must", "recommended", "advised", "apply"]),
    ("definition", ["is defined as", "means", "is known as", "is called"]),
    ("practice", ["prepared by", "method", "process", "mix", "ferment", "composting"]),
    ("claim", ["increases", "reduces", "improves", "enhances", "leads to", "results in"]),
    ("observation", ["kharif", "rabi", "monsoon", "summer", "winter", "rainfall"]),
    ("principle", ["principle", "philosophy", "law of return"]),
]
DOMAIN_RULES = [
    ("soil", ["soil", "humus", "organic matter"]),
    ("water", ["rain", "irrigation", "water"]),
    ("pest", ["pest", "disease", "fungus", "insect", "weed"]),
    ("crop", ["seed", "crop", "wheat", "rice", "millet", "cotton", "pulse"]),
    ("input_material", ["manure", "dung", "urine", "fertilizer", "fertiliser", "jaggery", "compost"]),
    ("season", ["kharif", "rabi", "summer", "winter", "season", "month", "monsoon"]),
    ("practice", ["method", "practice", "process", "farming", "cultivation", "composting"]),
    ("region", ["india", "state", "region", "district", "zone"]),
]
MARKERS = [
    " is defined as ", " is known as ", " is called ", " is ", " are ", " should be ", " should ", " must be ", " must ", " can ", " may ", " increases ", " reduces ",
    " improves ", " enhances ", " leads to ", " results in ", " compared to ", " versus ", " than ", " prepared by ", " applied to ", " used for ", " consists of ", " contains ",
]
CONDITION = r"(during|before|after|within|for|at|in)\s+[^.]{0,90}(\d+[^.]{0,40}|kharif|rabi|monsoon|summer|winter)"
RESPONSE = (
    "units array<struct<type:string,language:string,domain_type:string,subject:string,predicate:string,object:string,conditions:string,"
    "confidence:double,evidence:array<struct<book_id:string,chapter_id:string,page_start:int,page_end:int,snippet:string>>>>"
)


def parse_responses(rows: DataFrame, key: str, body: str, schema: str = RESPONSE, field: str = "units", most: int = 35) -> DataFrame:
    """(key, pos, unit, rejected): the first `most` units of a JSON response, code fences removed.

    A body that is no JSON object with a list gives one row with rejected true.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(body), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    parsed = rows.select(key, F.from_json(bare, schema)[field].alias("u"))
    found = parsed.select(key, F.posexplode_outer(F.slice("u", 1, most)).alias("pos", "unit"), F.col("u").isNull().alias("rejected"))
    return found.where("unit is not null or rejected")


def failures(unit: str = "") -> Column:
    """Array of the rules that a unit breaks; valid if empty. Columns are taken from struct `unit`, or the row."""
    c = lambda n: F.col(f"{unit}.{n}" if unit else n)
    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    rules = {
        "type": ~F.coalesce(c("type").isin(UNIT_TYPES), F.lit(False)),
        "domain": ~F.coalesce(c("domain_type").isin(DOMAINS), F.lit(False)),
        "predicate": F.coalesce(F.length(c("predicate")) > 50, F.lit(False)),
        "confidence": ~F.coalesce(c("confidence").between(0.0, 1.0), F.lit(False)),
        "evidence": F.coalesce(F.size(c("evidence")), F.lit(0)) < 1,
        "snippet": F.coalesce(F.exists(c("evidence"), lambda e: F.length(e["snippet"]) > 600), F.lit(False)),
        "subject_object": c("type").isin(NEED_BOTH) & (blank("subject") | blank("object")),
        "subject": c("type").isin(NEED_SUBJECT) & blank("subject"),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())


def status_of(confidence: Column) -> Column:
    return F.when(confidence < 0.65, "needs_review").otherwise("extracted")


def salience(c: Column) -> Column:
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    listed = lambda low: (
        points(any_of(low, UNITS), 1.5) + points(any_of(low, VERBS), 2.0) + points(any_of(low, NOUNS), 1.0)
        + points(any_of(low, COMPARING), 1.0) - points(any_of(low, HEDGES), 0.5)
    )
    return points(c.rlike(r"\d"), 2.0) + bound(F.lower(c), listed)


def fact_type(c: Column) -> Column:
    return cascade(F.lower(c), TYPE_RULES, "claim")


def domain_type(c: Column) -> Column:
    return cascade(F.lower(c), DOMAIN_RULES, "general")


def statements(rows: DataFrame, text: str, kind: Column) -> DataFrame:
    """rows with subject, predicate, object of a text: split at the first marker of the list that lies past the second character.

    Each step is a column that the next one uses, so nothing is computed twice; without a marker the first four words
    are the subject.
    """
    c, low, spaced = F.col(text), F.col("__low"), F.array(*map(F.lit, MARKERS))
    # contains is the cheaper test, and most sentences fail it
    first = F.coalesce(*[F.when(F.contains(low, F.lit(m)) & (F.instr(low, m) > 2), F.lit(i)) for i, m in enumerate(MARKERS, 1)])
    found = rows.withColumn("__low", F.lower(c)).withColumn("__first", first)
    found = found.withColumn("__mark", F.try_element_at(spaced, F.col("__first"))).withColumn("__words", F.split(F.trim(c), r"\s+"))
    found = found.withColumn("__at", F.position(F.col("__mark"), low) - 1)
    none, words, at, mark = F.col("__mark").isNull(), F.col("__words"), F.col("__at"), F.trim("__mark")
    before = F.when(none, F.array_join(F.slice(words, 1, 4), " ")).otherwise(F.substring(c, F.lit(1), at))
    after = F.when(none, F.array_join(F.slice(words, 5, F.greatest(F.size(words), F.lit(1))), " ")).otherwise(F.substring(c, at + F.length(mark) + 3, F.length(c)))
    found = found.withColumn("__subject", phrase(before, 90)).withColumn("__rest", F.nullif(phrase(after, 220), F.lit("")))
    whole = F.when(kind.isin(NEED_BOTH), F.coalesce("__rest", phrase(c, 220))).otherwise(F.col("__rest"))
    return found.select(
        *rows.columns,
        F.when(F.col("__subject") == "", phrase(F.element_at(words, 1), 90)).otherwise(F.col("__subject")).alias("subject"),
        F.coalesce(mark, F.lit("states")).alias("predicate"),
        F.when(~kind.isin("definition", "observation", "principle"), whole).alias("object"),
    )


def condition(c: Column) -> Column:
    """The condition of a sentence as it is written; its words are looked for in any case."""
    found = phrase(F.regexp_extract(c, "(?iu)" + CONDITION, 0), 120)
    return F.when(found != "", found)


def confidence(c: Column, language: Column) -> Column:
    low = F.lower(c)
    classical = F.when(any_of(low, ["may", "might", "can"]), 0.65).otherwise(0.70)
    usual = F.when(any_of(low, [*HEDGES, "can"]), 0.65).when(any_of(low, ["approximately", "around", "about"]), 0.70).otherwise(0.80)
    return F.when(language == "sa", classical).otherwise(usual)


def diverse_top(rows: DataFrame, book: str, page: str, score: str, tie: str, most: int = 20) -> DataFrame:
    """rows with n, 1 to most in each book: the best of every page first, then the rest, each by score, page and tie."""
    in_page = F.row_number().over(Window.partitionBy(book, page).orderBy(F.desc(score), tie))
    ranked = rows.withColumn("__p", (in_page > 1).cast("int"))
    order = Window.partitionBy(book).orderBy("__p", F.desc(score), page, tie)
    return ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("__p")


def patch(rows: DataFrame, patches: DataFrame, key: str, fields: list[str], stamp: Column) -> tuple[DataFrame, DataFrame]:
    """rows with the non-null fields of patches applied, and (key, before, after) of the rows that had a patch."""
    new = patches.select(key, F.lit(True).alias("__hit"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = rows.join(new, key, "left")
    after = {f: F.coalesce(f"__{f}", f) for f in fields}
    out = both.select(*[after.get(c, F.col(c)).alias(c) for c in rows.columns], F.when(F.col("__hit"), stamp).alias("updated_at"))
    diff = both.where("__hit").select(key, F.struct(*fields).alias("before"), F.struct(*[after[f].alias(f) for f in fields]).alias("after"))
    return out, diff


def conflicts(units: DataFrame, subject: list[str], what: str, book: str) -> DataFrame:
    """Subjects that different books give different objects: (subject, objects, books)."""
    found = units.groupBy(*subject).agg(F.countDistinct(what).alias("objects"), F.countDistinct(book).alias("books"))
    return found.where("objects > 1 and books > 1")


def review_sample(units: DataFrame, reviewed: DataFrame, reviewers: list, stratum: str, unit: str, reviewer: str, most: int, seed: int = 1) -> DataFrame:
    """(reviewer, stratum, unit, n): for each reviewer `most` units of every stratum that they have not reviewed.

    Units come in the order of a hash of seed, reviewer and unit, so the choice favours nothing, is the same however
    rows are dealt out, and a larger sample begins with a smaller one. Only the first `most` of a stratum leave a task.
    reviewed holds (reviewer, unit); reviewers is a short list. Rows with a null unit take no part; repeated units count
    once; a null stratum is a stratum.
    """
    asked = units.where(F.col(unit).isNotNull()).select(stratum, unit).dropDuplicates([unit]).select("*", F.explode(F.array(*map(F.lit, reviewers))).alias(reviewer))
    fresh = asked.join(reviewed.select(reviewer, unit), [reviewer, unit], "left_anti")
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(reviewer).cast("string"), F.col(unit).cast("string")), 256)
    order = Window.partitionBy(reviewer, stratum).orderBy("__h", unit)
    drawn = fresh.withColumn("__h", draw).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return drawn.select(reviewer, stratum, unit, "n")


def mark_conflicts(units: DataFrame, subject: list[str], what: str, book: str, group: Column, status: str = "status") -> DataFrame:
    """units with group_id and the status conflicting where different books give a subject different objects.

    group names a subject's group from its columns; other units keep their status and have no group.
    """
    found = conflicts(units, subject, what, book).select(*subject, group.alias("group_id"))
    both = units.join(found, subject, "left")
    return both.withColumn(status, F.when(F.col("group_id").isNotNull(), "conflicting").otherwise(F.col(status)))


def bulk_status(rows: DataFrame, ids: DataFrame, key: str, status: str, new: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """rows with the status `new` where ids (key) ask for it, and (key, found, before, after) of every id asked for.

    Repeated ids count once, null ids not at all. Raises ValueError if a call asks for more than `most` ids.
    """
    asked = ids.where(F.col(key).isNotNull()).select(key).distinct()
    if asked.limit(most + 1).count() > most:
        raise ValueError(f"a call changes at most {most} rows")
    told = F.broadcast(asked.withColumn("__asked", F.lit(True)))
    changed = rows.join(told, key, "left").withColumn(status, F.when(F.col("__asked"), new).otherwise(F.col(status))).select(*rows.columns)
    met = rows.join(F.broadcast(asked), key, "left_semi").select(key, F.col(status).alias("before"), F.lit(True).alias("found"))
    outcome = asked.join(met, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"), "before", F.when(F.col("found"), new).alias("after"))
    return changed, outcome
