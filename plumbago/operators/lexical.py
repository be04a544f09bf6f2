"""The lexical index as tables, and BM25 over them.

postings(term, chunk_id, tf, dl), terms(term, df, idf) and stats(n, avgdl); or without an index, by one scan. Scoring joins query terms with terms and postings, so only the postings of these terms are read; they are pre-aggregated per query and chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbago.functions.tokens import tokens
from plumbago.sources.versions import Versions

K1, B, EPSILON = 1.5, 0.75, 0.25
#: A raw score of this much counts as 1.
FULL = 20.0
#: Asked terms of all queries together that are broadcast; more shuffle.
ASKED_TERMS = 200_000
_held: list[DataFrame] = []
#: What the last write of a version leaves.
_LAST = "stats/_SUCCESS"


@dataclass
class LexicalIndex:
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, spark: SparkSession, path: str) -> None:
        """A version of the index. Postings are laid out by term, so that a query reads the row groups of its terms."""
        versions = Versions(spark, path)
        at = versions.next(_LAST)
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/postings")
        saved = spark.read.parquet(f"{at}/postings")
        terms = idf(saved, self.stats)
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/terms")
        self.stats.write.mode("overwrite").parquet(f"{at}/stats")
        versions.prune(_LAST)

    def changed(self, gone: DataFrame, new: DataFrame, content: Column | None = None, with_han: bool = True) -> LexicalIndex:
        """The index without the chunks ``gone`` (chunk_id, content) and with those of ``new``; only these are tokenised."""
        less, more = build(gone, content, with_han=with_han), build(new, content, with_han=with_han)
        postings = self.postings.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti").select(*more.postings.columns).union(more.postings)
        size = lambda s, sign: s.select((F.col("n") * sign).alias("n"), (F.coalesce(F.col("avgdl"), F.lit(0.0)) * F.col("n") * sign).alias("length"))
        total = size(self.stats, 1).union(size(less.stats, -1)).union(size(more.stats, 1)).agg(F.sum("n").alias("n"), F.round(F.sum("length")).alias("length"))
        stats = total.select("n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).alias("avgdl"))
        return LexicalIndex(postings, idf(postings, stats), stats)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        """Whether a whole index is saved there."""
        return Versions(spark, path).current(_LAST) is not None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        at = Versions(spark, path).current(_LAST)
        return cls(*(spark.read.parquet(f"{at}/{t}") for t in ("postings", "terms", "stats")))


def _kept(df: DataFrame) -> DataFrame:
    _held.append(df.persist())
    return df


def release() -> None:
    """Free what earlier builds and scans have kept; frames that still need it compute it anew."""
    while _held:
        _held.pop().unpersist()


def build(chunks: DataFrame, content: Column | None = None, chunk_id: str = "chunk_id", with_han: bool = True) -> LexicalIndex:
    """Tokenise once: postings are kept (in memory, then on disk), and terms and stats follow from them and from the number of chunks."""
    said = tokens(F.col("content") if content is None else content, with_han)
    cut = chunks.select(F.col(chunk_id).alias("chunk_id"), said.alias("tokens"))
    postings = _kept(cut.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))
    n = chunks.agg(F.count("*").alias("n"))
    length = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length"))
    stats = n.crossJoin(length).select("n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).alias("avgdl"))  # one row each
    return LexicalIndex(postings, idf(postings, stats), stats)


def idf(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf; a negative idf becomes EPSILON times the mean over all terms."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", _raw(F.col("n")))  # stats has one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row


def _terms(queries: DataFrame, text: str, query_id: str, with_han: bool) -> tuple[DataFrame, bool]:
    """query_id, term, qtf; and whether the asked terms are few enough to be broadcast, by a count."""
    asked = _kept(queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text), with_han)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    return asked, asked.count() <= ASKED_TERMS


def _summed(asked: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, chunk_id, raw from asked terms with idf and their postings; only positive sums."""
    hit = postings.join(asked, "term").crossJoin(F.broadcast(stats))  # one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("raw")).filter("raw > 0")


def scores(queries: DataFrame, index: LexicalIndex, text: str = "question", query_id: str = "query_id", with_han: bool = True) -> DataFrame:
    """query_id, chunk_id, raw: summed over query tokens, a repeated token counting again. Postings aren't shuffled where the asked terms are few."""
    asked, few = _terms(queries, text, query_id, with_han)
    hint = F.broadcast if few else lambda df: df
    return _summed(hint(index.terms.join(hint(asked), "term").select("query_id", "term", "qtf", "idf")), index.postings, index.stats)


def scan(queries: DataFrame, chunks: DataFrame, content: Column | None = None, text: str = "question", with_han: bool = True) -> DataFrame:
    """What scores() gives, without an index: one pass over the chunks for the postings of the asked terms alone. The mean over all terms is computed only if a term that is asked stands in more than half of the chunks."""
    spark = chunks.sparkSession
    asked, few = _terms(queries, text, "query_id", with_han)
    cut = chunks.select("chunk_id", tokens(F.col("content") if content is None else content, with_han).alias("tokens"))
    hint = F.broadcast if few else lambda df: df
    mark = F.lit("")  # no token; each chunk's row of it tells the numbers of chunks and tokens in the same pass
    wanted = asked.select("term").distinct().union(spark.range(1).select(mark))
    said = cut.select("chunk_id", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(mark))).alias("term")).join(hint(wanted), "term")
    found = _kept(said.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.sum("dl").alias("total")))
    n, length = found.filter("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    postings = found.filter("term != ''").drop("total")
    stats = spark.createDataFrame([(n, length / n if n else None)], "n long, avgdl double")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    if (df.agg(F.max("df")).first()[0] or 0) > n / 2:
        every = cut.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        mean = every.agg(F.avg(_raw(F.lit(n))).alias("mean")).first()[0]
    else:
        mean = 0.0
    raw = _raw(F.lit(n))
    terms = asked.join(hint(df), "term").select("query_id", "term", "qtf", F.when(raw < 0, EPSILON * mean).otherwise(raw).alias("idf"))
    return _summed(hint(terms), postings, stats)


def _raw(n: Column) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def top(scored: DataFrame, k: int, by: Column, tie: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each query, ranked; Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(by.desc(), tie)
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def retrieve(queries: DataFrame, index: LexicalIndex, k: int = 5, text: str = "question", with_han: bool = True, among: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score (at most 1), rank. ``among``: the chunk_ids that count, chosen before the cut; the statistics stay those of the whole index."""
    raw = scores(queries, index, text, with_han=with_han)
    return ranked(raw if among is None else raw.join(among.select("chunk_id"), "chunk_id", "left_semi"), k)


def ranked(raw: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score (at most 1), rank from raw scores."""
    return top(raw, k, F.round("raw", 9)).select("query_id", "chunk_id", F.least(F.col("raw") / FULL, F.lit(1.0)).alias("score"), "rank")
