"""Retrieval and answer metrics over samples.

A sample has ``expected_docs`` and ``retrieved_docs`` (arrays, best first), and for answers ``query``,
``generated_answer`` and ``retrieved_texts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions import text as X

_E, _R = "expected_docs", "retrieved_docs"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _hit(doc: Column) -> Column:
    return F.array_contains(_E, doc)


def precision_at(k: int) -> Column:
    """Relevant among the first k, by the rows that there are; repeats count each time."""
    head = F.slice(_R, 1, k)
    return _ratio(F.size(F.filter(head, _hit)), F.size(head))


def recall_at(k: int) -> Column:
    head = F.slice(_R, 1, k)
    return _ratio(F.size(F.filter(F.col(_E), lambda e: F.array_contains(head, e))), F.size(_E))


def reciprocal_rank() -> Column:
    ranks = F.filter(F.transform(F.col(_R), lambda d, i: F.when(_hit(d), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(1.0 / F.try_element_at(ranks, F.lit(1)), F.lit(0.0))


def ndcg_at(k: int) -> Column:
    gain = F.aggregate(F.transform(F.slice(_R, 1, k), lambda d, i: F.when(_hit(d), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    n = F.least(F.lit(k), F.size(_E))
    ideal = F.aggregate(F.transform(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= n), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    return _ratio(gain, ideal)


def hit_rate() -> Column:
    return F.when(F.exists(F.col(_R), _hit), 1.0).otherwise(0.0)


def _held(words: Column, seen: Column) -> Column:
    """How many of ``words``, with repeats, occur in ``seen``: both are sorted together, so that one pass
    over the row counts them."""
    tagged = F.concat(F.transform(F.array_distinct(seen), lambda w: F.struct(w.alias("w"), F.lit(0).alias("t"))), F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(1).alias("t"))))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.when(x.t == 0, x.w).otherwise(a.w).alias("w"), (a.n + ((x.t == 1) & (x.w == a.w)).cast("int")).alias("n"))
    return F.aggregate(F.array_sort(tagged), start, step, lambda a: a.n)


def _answer() -> Column:
    return X.tokens(F.col("generated_answer"))


def _seen() -> Column:
    return F.flatten(F.transform(F.col("retrieved_texts"), X.tokens))


def faithfulness(answer: Column | None = None, seen: Column | None = None) -> Column:
    """Answer tokens, with repeats, that some retrieved text holds."""
    answer, seen = _answer() if answer is None else answer, _seen() if seen is None else seen
    return _ratio(_held(answer, seen), F.size(answer))


def answer_relevancy(answer: Column | None = None, asked: Column | None = None) -> Column:
    """Answer tokens, with repeats, that the query holds."""
    answer, asked = _answer() if answer is None else answer, X.tokens(F.col("query")) if asked is None else asked
    return _ratio(_held(answer, asked), F.size(answer))


def answer_correctness(answer: Column | None = None, truth: Column | None = None) -> Column:
    """F1 of the token sets of answer and truth."""
    a = F.array_distinct(_answer() if answer is None else answer)
    t = F.array_distinct(X.tokens(F.col("ground_truth")) if truth is None else truth)
    both = F.size(F.array_intersect(a, t))
    p, r = _ratio(both, F.size(a)), _ratio(both, F.size(t))
    return _ratio(2 * p * r, p + r)


def retrieval_metrics(samples: DataFrame, k: int = 5) -> DataFrame:
    return samples.withColumns({
        "precision": precision_at(k), "recall": recall_at(k), "mrr": reciprocal_rank(), "ndcg": ndcg_at(k), "hit_rate": hit_rate(),
    })


def answer_metrics(samples: DataFrame) -> DataFrame:
    """Each text is tokenized once, into columns that the metrics share."""
    given = samples.withColumns({"__a": _answer(), "__s": _seen(), "__q": X.tokens(F.col("query")), "__t": X.tokens(F.col("ground_truth"))})
    a = F.col("__a")
    out = given.withColumns({"faithfulness": faithfulness(a, F.col("__s")), "relevancy": answer_relevancy(a, F.col("__q")), "correctness": answer_correctness(a, F.col("__t"))})
    return out.drop("__a", "__s", "__q", "__t")


def ranked_metrics(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """The retrieval metrics of long tables, where relevant documents may be too many for an array.

    ``ranked (query_id, rank from 1, hit)`` has a row for each retrieved document, ``expected (query_id, n)``
    the number of relevant ones; a query without retrieved documents scores 0.
    """
    hit, head = F.col("hit"), F.col("rank") <= k
    found = ranked.groupBy("query_id").agg(
        F.count_if(head).alias("shown"), F.count_if(head & hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(head & hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
    )
    n = F.least(F.lit(k), F.col("n")).cast("int")
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    joined = expected.join(found, "query_id", "left")
    return joined.select(
        "query_id", _ratio(F.coalesce("hits", F.lit(0)), F.coalesce("shown", F.lit(0))).alias("precision"), _ratio(F.coalesce("hits", F.lit(0)), F.col("n")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), _ratio(F.coalesce("gain", F.lit(0.0)), ideal).alias("ndcg"), F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"),
    )


def report(scored: DataFrame, metrics: list[str], answer: str | None = None) -> DataFrame:
    """Mean of each metric as rows; with ``answer``, over samples that have one."""
    use = lambda m: F.avg(F.when(F.col(answer) != "", F.col(m))) if answer else F.avg(m)
    wide = scored.agg(F.count("*").alias("samples"), *[F.coalesce(use(m), F.lit(0.0)).alias(m) for m in metrics])
    return wide.select("samples", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in sorted(metrics)])).alias("x")).select("samples", "x.metric", "x.value")


def report_lines(rows: DataFrame) -> DataFrame:
    return rows.select("metric", F.format_string("  %-30s %.4f", "metric", "value").alias("line"))


def dataset_from_recordings(recorded: DataFrame, most: int, judge: Column | None = None) -> DataFrame:
    """First recording of each query that returned something, at most ``most``, in order of ``seq``.

    ``judge`` says per retrieved URI whether it is relevant; without one all are.
    """
    first = F.row_number().over(Window.partitionBy("query").orderBy("seq"))
    kept = recorded.where(F.size("retrieved_uris") > 0).withColumn("n", first).where("n = 1").orderBy("seq").limit(most)
    expected = F.filter(F.col("retrieved_uris"), lambda u: judge(u)) if judge is not None else F.col("retrieved_uris")
    return kept.select("seq", "query", "retrieved_uris", expected.alias("expected_docs"))
