"""Bulk search: BM25 over postings for a table of queries, top k each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..sources.scratch import stored
from .candidates import candidate, of_product
from .constraints import active_constraints, evaluate

K1, B = 0.9, 0.4
#: Impacts are whole millionths, so sums don't depend on the order in which they are made.
SCALE = 1_000_000
#: Documents whose ids follow each other and whose postings make one block of a term.
BLOCK = 16
#: Blocks of the greatest bounds that set the score which a query's k-th document reaches at least, and documents in them for each of k.
LEADING, LEADING_DOCS = 16, 16


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def corpus_stats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From docs (doc_id, text): per (term, doc_id) counts with the document's length, per term document counts, and one row of totals."""
    tokens = docs.select("doc_id", terms(F.col("text")).alias("t"))
    # The length first, so that no list goes along with each of its terms.
    counts = tokens.withColumn("length", F.size("t")).select("doc_id", "length", F.explode("t").alias("term")).groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    totals = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("mean_length"))
    return counts, frequency, totals


def postings(docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(term, doc_id, impact), the impact a whole number of millionths."""
    counts = stored(corpus_stats(docs)[0])
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    # Two numbers, whatever the size of the corpus.
    n, total = docs.count(), counts.agg(F.sum("tf")).first()[0] or 0
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / (total / n if total else 1.0)))
    return counts.join(frequency, "term").select("term", "doc_id", F.round(SCALE * idf * part).cast("long").alias("impact"))


def posting_blocks(posted: DataFrame) -> DataFrame:
    """(term, block, most, entries): a term's postings of BLOCK neighbouring doc_ids, numbers, with their greatest impact; stored, ordered by term within each file."""
    numbered = posted.withColumn("block", F.floor(F.col("doc_id") / BLOCK).cast("long"))
    entry = F.struct("doc_id", "impact")
    return stored(numbered.groupBy("term", "block").agg(F.max("impact").alias("most"), F.collect_list(entry).alias("entries")).sortWithinPartitions("term", "block"))


def _named(queries: DataFrame) -> DataFrame:
    """(query_id, words): the distinct words of each query in order, as one text; queries without any go."""
    words = F.array_join(F.array_sort(F.array_distinct(terms(F.col("query")))), " ")
    return queries.select("query_id", words.alias("words")).where("words <> ''")


def _best() -> Column:
    return F.row_number().over(W.partitionBy("words").orderBy(F.desc("score"), "doc_id"))


def _judged(wanted: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(words, block, bound, read): whether a block's documents can reach the query's floor; stored."""
    heads = wanted.join(blocks.select("term", "block", "most"), "term").groupBy("words", "block").agg(F.sum("most").alias("bound"))
    heads = stored(heads)
    place = F.row_number().over(W.partitionBy("words").orderBy(F.desc("bound"), "block"))
    leading = heads.withColumn("place", place).where(F.col("place") <= max(LEADING, -(-LEADING_DOCS * k // BLOCK))).select("words", "block")
    floor = _scored(leading, wanted, blocks).withColumn("rank", _best()).where(F.col("rank") == k).select("words", F.col("score").alias("floor"))
    return stored(heads.join(floor, "words", "left").select("words", "block", "bound", (F.col("bound") >= F.coalesce("floor", F.lit(0))).alias("read")))


def _scored(cells: DataFrame, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """(words, doc_id, score) of the documents in cells (words, block)."""
    found = cells.join(wanted, "words").join(blocks.select("term", "block", "entries"), ["term", "block"])
    return found.select("words", F.explode("entries").alias("e")).groupBy("words", F.col("e.doc_id").alias("doc_id")).agg(F.sum("e.impact").alias("score"))


def _wanted(named: DataFrame) -> DataFrame:
    return stored(named.select("words").distinct().select("words", F.explode(F.split("words", " ")).alias("term")))


def search_topk(queries: DataFrame, posted: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of each query's best k documents; ties go to the smaller doc_id.

    Queries with the same words are searched once. The greatest impacts of a block's postings bound the scores in
    it. The blocks of the greatest bounds are scored first; their k-th score is a floor that a query's k-th
    document reaches at least, so blocks that are bound to stay under it are skipped, and only the postings of
    the others are read. Ranks are those of all terms over all documents.
    """
    named, blocks = _named(queries), posting_blocks(posted)
    wanted = _wanted(named)
    read = _judged(wanted, blocks, k).where("read").select("words", "block")
    ranked = _scored(read, wanted, blocks).withColumn("rank", _best()).where(F.col("rank") <= k)
    return named.join(ranked, "words").select("query_id", "doc_id", "score", "rank")


def search_blocks(queries: DataFrame, posted: DataFrame, k: int) -> DataFrame:
    """(query_id, blocks, read): how many blocks have any of a query's words, and how many of these search_topk reads."""
    named = _named(queries)
    judged = _judged(_wanted(named), posting_blocks(posted), k)
    counted = judged.groupBy("words").agg(F.count("*").alias("blocks"), F.count_if("read").alias("read"))
    return named.join(counted, "words").select("query_id", "blocks", "read")


def search_candidates(requests: DataFrame, posted: DataFrame, catalog: DataFrame, search_limit: int = 50, return_limit: int = 10) -> DataFrame:
    """One row for each request (request_id, query, constraints): status, reason, ranked candidates, and the first one's checks.

    A blank query is an error with all active constraints violated; no hit is no error.
    """
    asked = requests.withColumn("query", collapse(F.col("query")))
    hits = search_topk(asked.where("query <> ''").select(F.col("request_id").alias("query_id"), "query"), posted, search_limit)
    known = hits.join(catalog, hits["doc_id"] == catalog["row_id"])
    placed = known.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= return_limit)
    lists = placed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", candidate(of_product(), F.col("place")).alias("c"))), lambda a, b: a["place"] - b["place"]).alias("found"))
    joined = asked.join(lists, F.col("request_id") == F.col("query_id"), "left").withColumn("candidates", F.transform("found", lambda f: f["c"]))
    first = F.get(F.col("candidates"), F.lit(0))
    result = {f: first[f] for f in ("price", "color", "brand", "category", "product_category", "title", "query")}
    out = joined.withColumn("checks", evaluate(result, F.col("constraints"), first.isNotNull()))
    none, active = F.col("candidates").isNull(), active_constraints(F.col("constraints"))
    return out.select(
        "request_id",
        "query",
        F.when(F.col("query") == "", "error").otherwise("observed").alias("status"),
        F.when(F.col("query") == "", "missing_gold_search_query").when(none, "no_matching_results").alias("reason"),
        "candidates",
        F.transform(F.filter("checks", lambda c: F.coalesce(c["matched"], F.lit(False))), lambda c: c["field"]).alias("satisfied"),
        F.when(none, active).otherwise(F.transform(F.filter("checks", lambda c: c["violated"]), lambda c: c["field"])).alias("violated"),
    )
