"""The queries of the problems on texts over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import table
from .abuse import abuse_rates, abuse_scores, judgements
from .encode import decoded, token_counts, token_ids
from .ngrams import term_frequencies
from .packing import faults, fill, pack


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and runs of up to three of them, and codes."""
    return term_frequencies(table(spark, sf_dir, "clean_crime"), texts=["text_general_code"], codes=["ucr_general"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and codes that are too rare or too common."""
    return _terms(spark, sf_dir).where((F.col("length") == 1) & F.col("mark").isNotNull()).select("field", "term")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms and codes with their counts and marks."""
    return _terms(spark, sf_dir).where("length = 1").drop("length")


def p1_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of up to three terms with their counts and marks."""
    return _terms(spark, sf_dir).where("field = 'text_general_code'")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return token_ids(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each document's text as its token ids give it back."""
    return decoded(token_ids(table(spark, sf_dir, "documents"))).select("doc_id", F.md5("text").alias("digest"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(containers, sizes with their spec)."""
    documents, specs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_spec")
    packed, sizes = None, None
    for name in sorted(r[0] for r in specs.select("tokenizer").distinct().collect() if r[0]):  # fixed: one
        own, size = specs.where(F.col("tokenizer") == name), written(token_counts(documents, tokenizer=name), "sizes")
        more, held = pack(size, own), size.withColumn("tokenizer", F.lit(name))
        packed, sizes = (more, held) if packed is None else (packed.unionByName(more), sizes.unionByName(held))
    return packed, sizes


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or piece of one, for each capacity."""
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill(_packed(spark, sf_dir)[0], table(spark, sf_dir, "pack_spec"))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, containers above their capacity, documents cut though they fit, and documents with tokens lost or doubled, by spec."""
    packed, sizes = _packed(spark, sf_dir)
    return faults(packed, sizes, table(spark, sf_dir, "pack_spec"))


_scores: dict[tuple[str, str], DataFrame] = {}


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a folder of tables, whose model is fitted once an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _scores:
        _scores[at] = abuse_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_label"), keep=("source",))
    return _scores[at]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _abuse(spark, sf_dir).where("offends").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each document."""
    return _abuse(spark, sf_dir).select("doc_id", "score", "offends")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by source."""
    return abuse_rates(_abuse(spark, sf_dir))


def p8_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of each judged document."""
    return judgements(table(spark, sf_dir, "content_label")).select("doc_id", "raters", "least", "most", F.round("mean", 6).alias("mean"))


QUERIES = {q.__name__: q for q in (p1_found, p1_terms, p1_ngrams, p6_ids, p6_roundtrip, p7_pack, p7_fill, p7_faults, p8_found, p8_scores, p8_rates, p8_judgements)}

_HELD = (
    "held AS (SELECT 'text_general_code' AS field, term, count(*) AS occurrences, count(DISTINCT crime_id) AS records FROM (SELECT crime_id, unnest(regexp_extract_all(lower(text_general_code), '[\\p{L}\\p{Nd}]+')) AS term FROM clean_crime) GROUP BY term "
    "UNION ALL SELECT 'ucr_general', ucr_general::VARCHAR, count(*), count(*) FROM clean_crime WHERE ucr_general IS NOT NULL GROUP BY ucr_general), "
    "marked AS (SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM clean_crime) THEN 'common' END AS mark FROM held)"
)
SQL = {
    "p6_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_faults": "SELECT spec_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS torn, 0::BIGINT AS lost FROM pack_spec WHERE capacity > 0",
    "p8_judgements": "SELECT doc_id, count(*) AS raters, min(offends) AS least, max(offends) AS most, round(avg(offends), 6) AS mean FROM content_label WHERE doc_id IS NOT NULL AND offends IN (0, 1) GROUP BY doc_id",
    "p1_found": f"WITH {_HELD} SELECT field, term FROM marked WHERE mark IS NOT NULL",
    "p1_terms": f"WITH {_HELD} SELECT field, term, occurrences, records, mark FROM marked",
    "p1_ngrams": "WITH cut AS (SELECT crime_id, regexp_extract_all(lower(text_general_code), '[\\p{L}\\p{Nd}]+') AS t FROM clean_crime), pos AS (SELECT crime_id, t, unnest(range(1, len(t) + 1)) AS i FROM cut), grams AS (SELECT crime_id, n AS length, array_to_string(t[i:i + n - 1], ' ') AS term FROM pos, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(t)), held AS (SELECT term, length, count(*) AS occurrences, count(DISTINCT crime_id) AS records FROM grams GROUP BY ALL) SELECT 'text_general_code' AS field, term, length, occurrences, records, CASE WHEN records < 5 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM clean_crime) THEN 'common' END AS mark FROM held",
}
