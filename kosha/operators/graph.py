"""The concept graph as tables: nodes, typed edges, processes, traversal, merging and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.language import mapped
from ..session import shared_folder

# Predicates and their relation types, domains and their node labels, languages with a label of their own.
RELATIONS = {
    "is": "IS_A", "is a": "IS_A", "defines": "IS_A", "defined as": "IS_A", "improves": "IMPROVES", "improve": "IMPROVES", "causes": "CAUSES", "cause": "CAUSES",
    "leads to": "CAUSES", "requires": "REQUIRES", "require": "REQUIRES", "needs": "REQUIRES", "produces": "PRODUCES", "produce": "PRODUCES", "results in": "PRODUCES",
    "inhibits": "INHIBITS", "inhibit": "INHIBITS", "reduces": "INHIBITS", "contains": "CONTAINS", "contain": "CONTAINS", "includes": "CONTAINS", "supports": "SUPPORTS",
    "support": "SUPPORTS", "promotes": "SUPPORTS", "compares": "COMPARED_TO", "compared to": "COMPARED_TO", "recommends": "RECOMMENDS", "recommend": "RECOMMENDS",
    "prescribes": "RECOMMENDS", "used for": "USED_FOR", "applied to": "APPLIED_TO", "derived from": "DERIVED_FROM", "part of": "PART_OF", "associated with": "ASSOCIATED_WITH",
}
NO_RELATION = "RELATES_TO"
DOMAIN_LABELS = {
    "crop": "Crop", "practice": "Practice", "input_material": "InputMaterial", "season": "Season", "region": "Region", "pest": "Pest", "soil": "Soil", "water": "Water",
}
LANGUAGES = ["en", "mr", "hi", "sa"]


def relation_type(predicate: Column, relations: dict[str, str] = RELATIONS) -> Column:
    """The type of a predicate, by the whole of it or its first word; else its own words in upper snake case."""
    key = F.lower(F.trim(predicate))
    names = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    own = F.regexp_replace(F.regexp_replace(F.upper(key), r"[\s\-]+", "_"), r"(?U)[^\w]", "")
    first = F.element_at(F.split(key, r"\s+"), 1)
    usable = F.when(own.rlike(r"^\p{L}"), F.left(own, F.lit(50)))
    return F.coalesce(F.try_element_at(names, key), F.try_element_at(names, first), usable, F.lit(NO_RELATION))


def node_label(domain: Column, labels: dict[str, str] = DOMAIN_LABELS) -> Column:
    extra = mapped(F.lower(domain), labels, "")
    return F.when(extra == "", "Concept").otherwise(F.concat(F.lit("Concept:"), extra))


def label_column(language: Column) -> Column:
    return F.concat(F.lit("label_"), mapped(F.lower(language), {k: k for k in LANGUAGES}, "en"))


def route(status: Column, subject: Column, kind: Column, what: Column) -> Column:
    """Where a unit goes: relation, definition, process, or null where it is skipped."""
    skip = (status == "rejected") | (F.coalesce(subject, F.lit("")) == "")
    return (
        F.when(skip, F.lit(None).cast("string"))
        .when(kind.isin("process", "practice"), "process")
        .when(F.coalesce(what, F.lit("")) != "", "relation")
        .otherwise("definition")
    )


def nodes(units: DataFrame, sides: list[tuple[str, str]], order: list[str], languages: list[str] = LANGUAGES) -> DataFrame:
    """One node per key: its last label per language, its books, and when it was first seen.

    units holds language, book, ts and for each side (key column, label column); order breaks ties of the last label.
    """
    every = None
    for key, label in sides:
        part = units.select(F.col(key).alias("key"), F.col(label).alias("label"), "language", "book", "ts", *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
        every = part if every is None else every.unionByName(part)
    seq = F.struct(*[f"__{i}" for i in range(len(order))], "label")
    last = [F.max_by(F.when(F.col("language") == x, F.col("label")), F.when(F.col("language") == x, seq)).alias(f"label_{x}") for x in languages]
    return every.where("key is not null").groupBy("key").agg(*last, F.sort_array(F.collect_set("book")).alias("books"), F.min("ts").alias("first_seen"))


def edges(units: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each edge key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return units.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def steps(units: DataFrame, key: str, array: str) -> DataFrame:
    """(process, step_order, step) of units with an array of steps; an empty array gives the process with a null step."""
    made = units.select(F.concat(F.col(key), F.lit("_process")).alias("process"), F.posexplode_outer(array).alias("step_order", "step"))
    return made.dropDuplicates(["process", "step_order"])


def both_ways(found: DataFrame, extra: list[str] | None = None) -> DataFrame:
    more = extra or []
    back = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more)
    return found.select("src", "dst", *more).unionByName(back)


def neighbourhood(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within 1 to 4 undirected hops of seeds (node), each with the least number of hops.

    Each front is checkpointed, so a hop reads the fronts before it instead of making them again.
    """
    if not 1 <= hops <= 4:
        raise ValueError("hops must be 1 to 4")
    shared_folder(links.sparkSession)
    pairs = both_ways(links).distinct().checkpoint()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        new = front.join(pairs, front.node == pairs.src).select(F.col("dst").alias("node")).distinct()
        front = new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        seen = seen.unionByName(front)
    return seen


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each connected component, by stars that shrink until nothing changes.

    Each round is checkpointed, so lineage stays short; the number of rounds grows with the log of the longest chain.
    """
    shared_folder(links.sparkSession)
    now = links.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct().checkpoint()
    mark = None
    for _ in range(most_rounds):
        pairs = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        mark = new
    raise RuntimeError("components did not settle")


def subgraph(links: DataFrame, seeds: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """(src, dst, rel, hop): edges that paths of at most `hops` steps from seeds (node) take, each with its least hop.

    Edges are walked both ways and come back as they are stored; relations restricts the walk to those types, before
    it begins. An edge's hop is one more than the hop of its nearer end. Repeated edges count once.
    """
    kept = links.where(F.col("rel").isin(relations)) if relations is not None else links
    kept = kept.select("src", "dst", "rel").distinct()
    seen = neighbourhood(kept, seeds, hops)
    ends = [seen.select(F.col("node").alias(c), F.col("hop").alias(f"__{c}")) for c in ("src", "dst")]
    both = kept.join(ends[0], "src").join(ends[1], "dst").withColumn("hop", F.least("__src", "__dst") + 1)
    return both.where(F.col("hop") <= hops).select("src", "dst", "rel", "hop")


def resolved(renames: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(old, new) of renames (old, new) with every chain followed to its end: a to b and b to c make a to c.

    Pointers jump twice as far each round, so a chain of n takes log n rounds; each is checkpointed. Raises ValueError
    for a key that is renamed to two keys and for renames that run in a circle. Renames to the key itself go.
    """
    shared_folder(renames.sparkSession)
    now = renames.where("old is not null and new is not null and old <> new").distinct().checkpoint()
    if not now.groupBy("old").count().where("count > 1").isEmpty():
        raise ValueError("a key is renamed to two keys")
    before = None
    for _ in range(most_rounds):
        step = now.select(F.col("old").alias("new"), F.col("new").alias("further"))
        open_ends = now.join(step, "new").count()
        if not open_ends:
            return now
        if open_ends == before:  # every round ends some chain, unless only circles are left
            raise ValueError("renames run in a circle")
        before = open_ends
        now = now.join(step, "new", "left").select("old", F.coalesce("further", "new").alias("new")).checkpoint()
    raise RuntimeError(f"renames did not settle in {most_rounds} rounds")


def renamed(rows: DataFrame, column: str, renames: DataFrame) -> DataFrame:
    """rows with the keys in column replaced by what resolved renames (old, new) make of them."""
    to = renames.select(F.col("old").alias(column), F.col("new").alias("__new"))
    named = F.coalesce("__new", column).alias(column)
    return rows.join(to, column, "left").select(*[named if c == column else F.col(c) for c in rows.columns])


def merge(links: DataFrame, renames: DataFrame, extra: list[str]) -> DataFrame:
    """links with ends renamed by (old, new), chains followed to their end; self-loops and repeated edges go."""
    return _relinked(links, resolved(renames), extra)


def _relinked(links: DataFrame, to: DataFrame, extra: list[str]) -> DataFrame:
    moved = renamed(renamed(links.select("src", "dst", *extra), "src", to), "dst", to)
    return moved.where("src <> dst").distinct()


def merge_concepts(nodes: DataFrame, links: DataFrame, units: DataFrame, renames: DataFrame, labels: list[str], sides: list[str], extra: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, links and units after the concepts of renames (old, new) went into others, chains and all.

    nodes (key, labels..., books array, first_seen): what stays has its own label of each language, or if it has none the
    one of the smallest merged key that has; aliases holds the labels that gave way; books are united, first_seen is the
    earliest. A key that only renames know makes no node. links (src, dst, extra...): ends are moved, self-loops and
    repeated edges go. units: the keys in the columns `sides` are moved, rows stay.
    """
    to = resolved(renames)
    own = renamed(nodes.select("*", F.col("key").alias("__old")), "key", to)
    rank = F.struct((F.col("__old") != F.col("key")).alias("moved"), "__old")
    best = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in labels]
    every = F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(*labels), lambda x: x.isNotNull()))))
    united = F.array_distinct(F.flatten(F.collect_set("books")))
    made = own.groupBy("key").agg(*best, every.alias("__labels"), F.sort_array(united).alias("books"), F.min("first_seen").alias("first_seen"))
    kept = F.array_except("__labels", F.filter(F.array(*labels), lambda x: x.isNotNull()))
    made = made.select("key", *labels, "books", "first_seen", F.sort_array(kept).alias("aliases"))
    for side in sides:
        units = renamed(units, side, to)
    return made, _relinked(links, to, extra), units


def first_edges(links: DataFrame, most: int, order: list[str]) -> DataFrame:
    w = Window.partitionBy("src").orderBy(*order)
    return links.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def weighed_edges(units: DataFrame, key: list[str], unit: str, confidence: str, order: list[str]) -> DataFrame:
    """(key, unit, confidence, evidence): of each edge key the last unit by order, its confidence (the
    greatest, of rows that tie), and how many units bear it.

    One partial aggregate: no task holds the units of an edge.
    """
    last = F.max(F.struct(*order, F.col(unit).alias("__u"), F.col(confidence).alias("__c")))
    made = units.groupBy(*key).agg(last.alias("__l"), F.count("*").alias("evidence"))
    return made.select(*key, F.col("__l.__u").alias(unit), F.col("__l.__c").alias(confidence), "evidence")


def beats(links: DataFrame, concepts: DataFrame, neighbours: int = 10, related: int = 8, relations: int = 3) -> DataFrame:
    """(node, intent, related) of concepts (node): its first relation types, and the first keys around it.

    Edges count both ways, the first `neighbours` of a concept by key; intent joins its first relation types by name, or is
    RELATES_TO without any. A concept without edges has no related keys.
    """
    around = both_ways(links, ["rel"]).join(concepts.select(F.col("node").alias("src")).distinct(), "src", "left_semi").distinct()
    few = first_edges(around, neighbours, ["dst", "rel"]).groupBy(F.col("src").alias("node")).agg(F.collect_set("rel").alias("r"), F.collect_set("dst").alias("d"))
    both = concepts.select("node").distinct().join(few, "node", "left")
    kinds, keys = (F.array_join(F.slice(F.sort_array(F.coalesce(c, F.array().cast("array<string>"))), 1, n), ",") for c, n in (("r", relations), ("d", related)))
    return both.select("node", F.coalesce(F.nullif(kinds, F.lit("")), F.lit(NO_RELATION)).alias("intent"), keys.alias("related"))


def quality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges, same_as, orphan_rate, label_coverage, type_coverage; nodes (node, label, type), links (src, dst, rel)."""
    linked = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().withColumn("linked", F.lit(1))
    rows = nodes.join(linked, "node", "left")
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    told = rows.agg(F.count("*").alias("nodes"), share(F.col("linked").isNull(), "orphan_rate"), share(F.coalesce("label", F.lit("")) != "", "label_coverage"), share(F.col("type").isNotNull(), "type_coverage"))
    of_links = links.agg(F.count("*").alias("edges"), F.count(F.when(F.col("rel") == "SAME_AS", 1)).alias("same_as"))
    return told.join(of_links)  # one row each
