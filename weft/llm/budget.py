"""Token budgets per source and language, and encoding of the whole corpus.

The distinct pre-split pieces of a table are merged once for the whole table (see ``bpe``): tasks count them per slice where
they read the texts, so that no text is shuffled, and what is shuffled are the counts of pieces that are no single token,
at most one row per task, slice and piece. Repeated keys are found without their texts; only the texts of keys that do come
again are moved.

Defined results: null slices are a slice of their own; null and empty texts have no tokens; records with a null key
belong to no slice; of a repeated key the least record counts, by slice and then by the hash of its texts; ``level`` names
the columns that a row is a total of, so that a null there is no total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.common import folded, table
from weft.llm import bpe
from weft.session import cut, written

#: Three-letter codes of languages and their two-letter ones.
CODES = {"eng": "en", "deu": "de", "ger": "de", "spa": "es", "fra": "fr", "fre": "fr", "por": "pt", "zho": "zh", "chi": "zh"}


def language(c: Column | str) -> Column:
    """A language's two-letter code from its usual spellings; region and script are dropped."""
    main = F.regexp_extract(folded(c), r"^([\p{L}]+)", 1)
    codes = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.nullif(F.coalesce(F.try_element_at(codes, main), main), F.lit(""))


def levels(base: DataFrame, dims: list[str], sets: list[list[str]]) -> DataFrame:
    """``base(dims, n_rows, n_tokens)`` summed up to one level for each of ``sets``."""
    out = base.groupingSets(sets, *dims).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.grouping_id().alias("g"))
    marks = [F.when(F.col("g").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, F.lit(c)) for i, c in enumerate(dims)]
    return out.withColumn("level", F.coalesce(F.nullif(F.concat_ws("+", *marks), F.lit("")), F.lit("total"))).drop("g")


def slices(counted: DataFrame, key: str, dims: list[str], sets: list[list[str]]) -> DataFrame:
    """Rows and tokens per slice of records whose tokens are known; a repeated key counts once."""
    once = counted.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(c).alias(c) for c in dims), F.max("tokens").alias("tokens"))
    return levels(once.groupBy(*dims).agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("n_tokens")), dims, sets)


def once_per_key(records: DataFrame, key: str, dims: list[str], texts: str, few: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(one row per key with its dims, the records that count, with dims and texts).

    Keys that come again are broadcast if they are ``few``, and joined by a shuffle if they are more.
    """
    tagged = records.where(F.col(key).isNotNull()).select(key, *dims, texts, F.xxhash64(texts).alias("_h"))
    keys = cut(tagged.groupBy(key).agg(F.min(F.struct(*dims, "_h")).alias("v"), F.count("*").alias("_n")))
    again = keys.where("_n > 1").select(F.col(key).alias("_k"), *(F.col(f"v.{c}").alias(f"_{c}") for c in dims), F.col("v._h").alias("_same"))
    n = again.count()
    if not n:
        return keys.select(*(F.col(f"v.{c}").alias(c) for c in dims)), tagged.select(*dims, texts)
    again = F.broadcast(again) if n <= few else again
    single = tagged.join(again, F.col(key) == F.col("_k"), "left_anti")
    picked = (F.col(key) == F.col("_k")) & (F.col("_h") == F.col("_same"))
    for c in dims:
        picked = picked & F.col(c).eqNullSafe(F.col(f"_{c}"))
    twice = tagged.join(again, picked).dropDuplicates([key])
    return keys.select(*(F.col(f"v.{c}").alias(c) for c in dims)), single.select(*dims, texts).unionByName(twice.select(*dims, texts))


def token_base(records: DataFrame, key: str, dims: list[str], texts: str, path: str = bpe.VOCABULARY) -> DataFrame:
    """(dims, n_rows, n_tokens) of ``records(key, dims, texts)``, one row per slice."""
    keys, counted = once_per_key(records, key, dims, texts)
    counts = written(bpe.piece_counts(counted, dims, texts, path))
    sizes = written(bpe.piece_sizes(counts.where("piece is not null").select("piece").distinct(), path))
    tokens = counts.join(sizes, "piece", "left").groupBy(*dims).agg(F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("n_tokens"))
    rows = keys.groupBy(*dims).agg(F.count("*").alias("n_rows"))
    tokens = tokens.select(*(F.col(c).alias(f"_{c}") for c in dims), "n_tokens")
    same = F.lit(True)
    for c in dims:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(tokens, same, "left").select(*dims, "n_rows", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def token_slices(records: DataFrame, key: str, dims: list[str], texts: str, sets: list[list[str]], path: str = bpe.VOCABULARY) -> DataFrame:
    """Rows and tokens per slice of ``records(key, dims, texts)``, one level for each of ``sets``."""
    return levels(token_base(records, key, dims, texts, path), dims, sets)


def document_tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of each row of documents."""
    return bpe.count_tokens(documents.select("doc_id", folded("source").alias("source"), language("lang").alias("lang"), folded("topic").alias("topic"), "text"), "text")


def sample_tokens(samples: DataFrame) -> DataFrame:
    """(sample_id, source, sample_type, tokens) over all contents of each sample's messages."""
    contents = F.transform("messages", lambda m: m["content"])
    return bpe.count_tokens(samples.select("sample_id", folded("source_subset").alias("source"), folded("sample_type").alias("sample_type"), contents.alias("texts")), "texts")


def p6_token_budget(spark, root: str) -> DataFrame:
    """Both tables in one pass, so that a piece that stands in both is merged once."""
    none = F.lit(None).cast("string")
    samples = table(spark, root, "sft_samples").select(
        F.lit("sft_samples").alias("origin"), F.concat(F.lit("sample "), F.col("sample_id")).alias("key"), folded("source_subset").alias("source"), none.alias("lang"), none.alias("topic"), folded("sample_type").alias("sample_type"),
        F.transform("messages", lambda m: m["content"]).alias("texts"),
    )
    docs = table(spark, root, "documents").select(
        F.lit("documents").alias("origin"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("key"), folded("source").alias("source"), language("lang").alias("lang"), folded("topic").alias("topic"), none.alias("sample_type"),
        F.array("text").alias("texts"),
    )
    base = cut(token_base(samples.unionByName(docs), "key", ["origin", "source", "lang", "topic", "sample_type"], "texts"))
    of = lambda origin, dims, sets: levels(base.where(F.col("origin") == origin).select(*dims, "n_rows", "n_tokens"), dims, sets).withColumn("origin", F.lit(origin))
    columns = ["origin", "level", "source", "lang", "topic", "sample_type", "n_rows", "n_tokens"]
    by_sample = of("sft_samples", ["source", "sample_type"], [["source", "sample_type"], ["source"], ["sample_type"], []]).withColumns({"lang": none, "topic": none})
    by_doc = of("documents", ["source", "lang", "topic"], [["source", "lang", "topic"], ["source", "lang"], ["source"], ["lang"], ["topic"], []]).withColumn("sample_type", none)
    return by_sample.select(columns).unionByName(by_doc.select(columns))


def p7_ids(spark, root: str) -> DataFrame:
    """One row in, one row out: doc_id is the table's key, so nothing is shuffled."""
    return bpe.encode(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")
