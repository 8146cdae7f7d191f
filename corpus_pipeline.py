"""A training corpus from ``documents`` in five stages, each a table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import byte_bpe, line_dedup, mixing, ngram_join, quality_rules
from tallyspark.llm.common import table, written

#: The mix wanted of what the stages before leave, and its size against theirs: a fifth more, nearly all of it good, with as much
#: toxic text as a filter is later to be tried on, and hardly any of low quality.
TARGETS = {"good": 0.92, "low": 0.005, "toxic": 0.075}
BUDGET = 1.2
#: The greatest multiple of a posterior in a rate: targets are rather missed than most text left out.
MOST = 50.0


# In every stage: other columns pass through, whatever their names; a null id is an id like any other; rows that repeat an id
# are judged by their own texts; an empty table gives an empty one.


def with_key(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, the row's other columns, and a key of id and text by which results come back to it; rows that agree
    in both have one key."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    return docs.select("doc_id", "text", others.alias("__doc"), F.xxhash64("doc_id", "text").alias("__key"))


def unpacked(rows: DataFrame, columns: list[str], text: str = "text", changed: bool = False) -> DataFrame:
    """The rows as they were; with a changed text, its own number of characters."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if changed else {})
    return rows.select(*((new[c] if c in new else F.col("__doc").getField(c)).alias(c) for c in columns))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; the others lose the lines that break a rule. Equal texts fare
    alike; repeated rows stay."""
    # A table before the filter, which would else be pushed into the lambdas and be computed for each of their elements.
    found = written(quality_rules.quality_rules(with_key(docs)).select("__doc", "clean_text", "kept"), "pipeline-ruled").where("kept")
    return unpacked(found, docs.columns, "clean_text", changed=True)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, by id and line, go, and documents of which nothing is left; those that had no line with a word
    before stay. Null ids come last; rows with equal id and text stay both, as neither is earlier."""
    found = line_dedup.dedup_lines(with_key(docs)).where("n_lines_left > 0 or n_lines_removed = 0")
    return unpacked(found, docs.columns, changed=True)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, that with the least id stays, null ids last; ties go by a hash of the text, and of equal
    rows one stays. Documents without a word link with none and stay."""
    rows = with_key(docs)
    groups = written(ngram_join.ngram_components(rows.select("__key", "text"), "__key").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group"), "n_shingles"), "pipeline-groups")
    worded = groups.where("n_shingles > 0").groupBy("__key").agg(F.min("__group").alias("__group"), F.count(F.lit(1)).alias("__copies"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    ids = rows.select("doc_id", "__key").distinct().join(worded, "__key")
    first = ids.groupBy("__group").agg(F.min(place).alias("p")).select(F.col("p.__key").alias("__key"))
    others = written(ids.join(first, "__key", "left_anti").select("__key"), "pipeline-others")
    repeated = written(worded.where("__copies > 1").select("__key"), "pipeline-repeated")
    left = rows.drop("doc_id").join(others, "__key", "left_anti")
    once = left.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])
    return unpacked(left.join(repeated, "__key", "left_anti").unionByName(once), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; what is over a whole number is decided by a hash of its id and text, so rows
    that agree in both fare alike. Null and empty texts have a rate as any."""
    rows = with_key(docs)
    rates = mixing.mixing_rates(rows, table(spark, sf_dir, "labels"), TARGETS, BUDGET, carry=("__key",), most=MOST)
    chance = F.pmod(F.xxhash64("__key", F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    copies = rates.groupBy("__key").agg(F.first("rate").alias("rate")).select("__key", F.floor(F.col("rate") + chance).cast("int").alias("__copies"))
    joined = rows.drop("doc_id").join(copies, "__key").where("__copies > 0")
    return unpacked(joined.select("text", "__doc", F.explode(F.sequence(F.lit(1), F.col("__copies")))), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, unsigned 32-bit and little-endian, and a digest of what they decode to. Null texts have none."""
    found = byte_bpe.decode(byte_bpe.encode(docs))
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", clean_lines),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]

#: Set joins by links, the fit and byte-pair merges can't be put in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
