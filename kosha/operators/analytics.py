"""Relational analytics over jobs, units, logs and owners, and evaluation of retrieval and extraction."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usage(rows: DataFrame, keys: dict[str, str], sums: dict[str, Column], ts: str, since: Column | None = None, until: Column | None = None, days: int = 30, by_cost: str = "cost") -> DataFrame:
    """(grouped_by, k, calls, sums...): totals by each of keys (name: column) and over all, within [since, until].

    One pass over grouping sets; grouping_id tells a row over all from a row of nulls, whose k is unknown. By default
    until is now and since `days` days before it. Highest by_cost first within a grouping. Rows without a time count nowhere; a period without
    rows gives none.
    """
    until = F.current_timestamp() if until is None else until
    since = until - F.expr(f"interval {days} days") if since is None else since
    kept = rows.where(F.col(ts).between(since, until)).select(*[F.col(c).cast("string").alias(n) for n, c in keys.items()], *[c.alias(n) for n, c in sums.items()])
    names = list(keys)
    made = kept.groupingSets([[n] for n in names] + [[]], *names).agg(
        F.count("*").alias("calls"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums], F.grouping_id(*names).alias("__g"),
    )
    whole = 2 ** len(names) - 1
    by = F.lit("total")
    k = F.lit("total")
    for i, n in enumerate(names):
        mine = F.col("__g") == whole - 2 ** (len(names) - 1 - i)
        by, k = F.when(mine, n).otherwise(by), F.when(mine, F.coalesce(n, F.lit("unknown"))).otherwise(k)
    return made.select(by.alias("grouped_by"), k.alias("k"), "calls", *sums).orderBy("grouped_by", F.desc(by_cost), "k")


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round((tokens_in * 0.005 + tokens_out * 0.015) / 1000, 6).cast("decimal(10,6)")


def latest(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keyset_page(rows: DataFrame, ts: str, key: str, before: tuple | None, size: int) -> tuple[DataFrame, bool, tuple | None]:
    """The page of rows after cursor `before` (ts, key), newest first; whether more follow, and the next cursor."""
    if before is not None:
        rows = rows.where((F.col(ts) < F.lit(before[0])) | ((F.col(ts) == F.lit(before[0])) & (F.col(key) < F.lit(before[1]))))
    page = rows.orderBy(F.desc(ts), F.desc(key)).limit(size + 1)
    ends = page.select(ts, key).collect()  # at most a page
    more = len(ends) > size
    last = (ends[size - 1][0], ends[size - 1][1]) if more else None
    return page.orderBy(F.desc(ts), F.desc(key)).limit(size), more, last


def visible(rows: DataFrame, owner: str, user: int, key: str, granted: DataFrame) -> DataFrame:
    """Rows of the user, and those that granted (key) shares with them."""
    shared = granted.select(F.col(key), F.lit(True).alias("__shared")).distinct()
    return rows.join(shared, key, "left").where((F.col(owner) == user) | F.coalesce("__shared", F.lit(False))).drop("__shared")


def stage_progress(spark, weights: dict[str, float]) -> DataFrame:
    """(stage, before, weight): what earlier stages add up to; a small fixed table."""
    total, rows = 0.0, []
    for stage, weight in weights.items():
        rows.append((stage, total, weight))
        total += weight
    return spark.createDataFrame(rows, "stage string, before double, weight double")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two stores holds."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def retrieval_metrics(hits: DataFrame, truth: DataFrame, least_share: float = 0.9, n_true: DataFrame | None = None, books: DataFrame | None = None) -> DataFrame:
    """(query_id, recall, precision, book_recall, median_score, citation_share, citation_ok) per query of hits or truth.

    hits (query_id, vec_id, score[, book, cited]), truth (query_id, vec_id), books (query_id, book): what is expected. A
    query without expected rows or books has recall 1, one without hits precision and citation share 0. citation_ok: at
    least `least_share` of the hits carry a citation (cited; null counts as none). With n_true (query_id, n_true), truth
    needs to hold the relevant hits only.
    """
    if n_true is None:
        n_true = truth.groupBy("query_id").agg(F.count("*").alias("n_true"))
    for c, kind in (("book", "string"), ("cited", "boolean")):
        hits = hits if c in hits.columns else hits.withColumn(c, F.lit(None).cast(kind))
    marked = hits.join(truth.select("query_id", "vec_id", F.lit(1).alias("good")), ["query_id", "vec_id"], "left")
    cited = F.sum(F.coalesce(F.col("cited").cast("int"), F.lit(0))).alias("cited")
    found = marked.groupBy("query_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.expr("percentile(score, 0.5)").alias("median_score"), cited)
    both = found.join(n_true, "query_id", "full")
    if books is None:
        both = both.withColumns({"n_books": F.lit(0), "met": F.lit(0)})
    else:
        seen = hits.where("book is not null").select("query_id", "book", F.lit(1).alias("met")).distinct()
        told = books.select("query_id", "book").distinct().join(seen, ["query_id", "book"], "left")
        both = both.join(told.groupBy("query_id").agg(F.count("*").alias("n_books"), F.count("met").alias("met")), "query_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda a, b, empty: F.when(zero(b) == 0, empty).otherwise(zero(a) / F.greatest(zero(b), F.lit(1)))
    cited = share("cited", "n", 0.0)
    return both.select(
        "query_id", share("good", "n_true", 1.0).alias("recall"), share("good", "n", 0.0).alias("precision"), share("met", "n_books", 1.0).alias("book_recall"),
        "median_score", cited.alias("citation_share"), (cited >= least_share).alias("citation_ok"),
    )


def macro_summary(metrics: DataFrame, language: str, pass_recall: float = 0.5) -> DataFrame:
    """(language, n, recall, precision, book_recall, pass_rate) by language and over all (`all`; a null one is unknown).

    A query passes with a recall of pass_recall or more and enough citations.
    """
    passed = ((F.col("recall") >= pass_recall) & F.col("citation_ok")).cast("int")
    told = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "book_recall")]
    made = metrics.withColumn(language, F.coalesce(language, F.lit("unknown"))).withColumn("__p", passed).rollup(language).agg(F.count("*").alias("n"), *told, F.round(F.avg("__p"), 6).alias("pass_rate"))
    return made.withColumn(language, F.coalesce(language, F.lit("all")))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 judgements."""
    n, same = F.count("*"), F.avg((F.col(a) == F.col(b)).cast("int"))
    pa, pb = F.avg(a), F.avg(b)
    chance = pa * pb + (1 - pa) * (1 - pb)
    return rows.agg(n.alias("n"), F.round((same - chance) / (1 - chance), 6).alias("kappa"))


def coherence(rows: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """(group, n, coherence): mean cosine of all pairs of a group's unit vectors, from the length of their sum.

    The sum is taken component by component, so a group of any size is a partial aggregate.
    """
    parts = [F.sum(F.element_at(vector, i + 1).cast("double")) for i in range(dims)]
    told = rows.groupBy(group).agg(F.count("*").alias("n"), F.array(*parts).alias("s"))
    length = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    return told.select(group, "n", ((length - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def retained(rows: DataFrame, ts: str, end: Column, masks: dict[str, tuple[int, Column]]) -> DataFrame:
    """rows in which a column gives way to its mask once the row is so many days older than end: {column: (days, mask)}.

    A row without a time counts as old: what cannot be dated is not kept.
    """
    old = lambda days: F.coalesce(F.col(ts) < end - F.expr(f"interval {days} days"), F.lit(True))
    return rows.select(*[F.when(old(masks[c][0]), masks[c][1]).otherwise(F.col(c)).alias(c) if c in masks else F.col(c) for c in rows.columns])


def book_report(books: DataFrame, chunks: DataFrame, units: DataFrame, key: str, status: str, approved: str) -> DataFrame:
    """(key, chunks, units, statuses, coverage) of every book: counts, a map of units by status, and the approved share.

    Coverage has four decimals and is null for a book without units, whose map is empty.
    """
    cut = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    by = units.groupBy(key, status).agg(F.count("*").alias("n"))
    told = by.groupBy(key).agg(
        F.sum("n").alias("units"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(status, F.lit("unknown")), "n")))).alias("statuses"),
        F.sum(F.when(F.col(status) == approved, F.col("n"))).alias("__ok"),
    )
    both = books.select(key).join(cut, key, "left").join(told, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.round(F.coalesce("__ok", F.lit(0)) / F.col("units"), 4)
    return both.select(key, zero("chunks"), zero("units"), F.coalesce("statuses", F.create_map().cast("map<string,bigint>")).alias("statuses"), share.alias("coverage"))


def store_counts(stores: dict[str, DataFrame]) -> DataFrame:
    """(store, n): the rows of each store."""
    made = [df.agg(F.lit(name).alias("store"), F.count("*").alias("n")) for name, df in stores.items()]
    return functools.reduce(DataFrame.unionByName, made)
