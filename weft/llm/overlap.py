"""Same or nearly same records across splits.

Exact copies: texts are canonicalised (case, accents, invisible characters, marks and white space dropped), and the hash
of their words in sorted order is the class of a text; evaluation hashes are joined with training hashes.

Near copies: every class is one representative, whatever the number of its copies. A representative's words are
numbered by occurrence and ordered, words of one side only first, then by their document frequency, rarest first. Two texts
that share at least ``share`` of the longer one's words must share a word among the first n - ceil(share n) + 1 of
each, so a join on these prefixes, with length and position bounds, finds every such pair exactly; each candidate is then
counted in full. Only training prefixes meet evaluation prefixes. Nothing is capped or sampled.

Texts are read and canonicalised once (``members``). Words that make up at least 1/``HEAVY`` of all are ``HEAVY`` at most,
so their frequencies are broadcast and such words never leave their text's task; only rarer words are shuffled to meet
theirs. The results are pairs of classes and the membership of samples; pairs of samples are expanded from these for
``p2_found`` alone, which asks for them.

Defined results: null partitions, partitions beyond the four known ones, null keys, samples without a user message,
and texts without a word belong to no pair; a key that comes again counts once.
"""

from __future__ import annotations

import sys
import unicodedata
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.common import folded, table
from weft.session import cut

TRAIN, EVALUATION = ("train",), ("validation", "test_iid", "test_ood")
#: A word that is at least one of so many words is heavy; there can be no more heavy words than this.
HEAVY = 1 << 16


def _accents() -> tuple[str, str]:
    """Each lower-case letter whose decomposition is one base character and marks, and that base, by Unicode's own rule."""
    pairs = {}
    for code in range(0x80, min(sys.maxunicode, 0x1FFFF) + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        base = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != ch:
            pairs[ch] = base[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def canonical_words(c: Column | str) -> Column:
    """Runs of letters or digits after lower-casing and dropping accents and invisible characters; each Han character is a word."""
    low = F.lower(c)
    bare = F.when(low.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(low, _FROM, _TO), r"[\p{Mn}\p{Me}\p{Cf}]", "")).otherwise(low)
    return F.regexp_extract_all(bare, F.lit(r"(\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))


def members(samples: DataFrame) -> DataFrame:
    """(sample_id, is_train, partition, source_subset, class, place, text) of ``samples(sample_id, partition, source_subset, messages)``, written once.

    text: the words in sorted order, a blank between them; class: its md5; place: a number of its own for every row.
    """
    first = F.get(F.filter("messages", lambda m: folded(m["role"]) == "user"), F.lit(0))["content"]
    rows = samples.withColumn("partition", folded("partition")).where(F.col("partition").isin(*TRAIN, *EVALUATION) & F.col("sample_id").isNotNull())
    rows = rows.select("sample_id", F.col("partition").isin(*TRAIN).alias("is_train"), "partition", folded("source_subset").alias("source_subset"), F.array_join(F.sort_array(canonical_words(first)), " ").alias("text"))
    return cut(rows.where("text <> ''").select("sample_id", "is_train", "partition", "source_subset", F.unhex(F.md5("text")).alias("class"), F.monotonically_increasing_id().alias("place"), "text"))


def _tokens(rows: DataFrame) -> DataFrame:
    """(class, id, f, t): the words of every class, numbered by occurrence, as hashes; all of a class in one task.

    id: a number of the class; f: the sides that it stands on, 1 training, 2 evaluation, 3 both.
    """
    reps = rows.groupBy("class").agg(F.min("place").alias("id"), F.bit_or(F.when(F.col("is_train"), 1).otherwise(2)).alias("f"), F.first("text").alias("text"))
    counted = reps.select("class", "id", "f", F.explode(F.split("text", " ")).alias("w")).groupBy("class", "id", "f", "w").agg(F.count("*").alias("c"))
    return counted.select("class", "id", "f", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("k"), "w").select("class", "id", "f", F.xxhash64("w", "k").alias("t"))


def _ordered(rows: DataFrame) -> DataFrame:
    """(class, id, f, tokens, n) of every class, its words in the one order that all classes share; written once."""
    tokens = _tokens(rows)
    frequency = cut(tokens.groupBy("t").agg(F.count("*").alias("df"), F.bit_or("f").alias("sides")))
    frequency = frequency.withColumn("o", F.when(F.col("sides") < 3, 0).otherwise(F.col("df")))
    is_heavy = F.col("df") * HEAVY >= frequency.agg(F.sum("df").alias("n")).scalar()
    heavy = frequency.where(is_heavy).select("t", F.col("o").alias("heavy"))
    known = tokens.join(F.broadcast(heavy), "t", "left")  # at most HEAVY rows
    pair = lambda o: F.collect_list(F.struct(F.col(o).alias("o"), "t"))
    here = known.groupBy("class", "id", "f").agg(F.collect_list(F.when(F.col("heavy").isNotNull(), F.struct(F.col("heavy").alias("o"), "t"))).alias("x"))
    rare = known.where("heavy is null").select("class", "t").join(frequency.where(~is_heavy).select("t", "o"), "t").groupBy("class").agg(pair("o").alias("y"))
    both = here.join(rare, "class", "left")
    none = F.array().cast("array<struct<o:bigint,t:bigint>>")
    order = F.transform(F.array_sort(F.concat("x", F.coalesce("y", none))), lambda x: x["t"])
    return cut(both.select("class", "id", "f", order.alias("tokens"))).withColumn("n", F.size("tokens"))


def class_pairs(rows: DataFrame, share: Fraction = Fraction(17, 20)) -> DataFrame:
    """(class_a, class_b, shared, longer): classes with training members and classes with evaluation members whose texts are the same or nearly the same.

    shared: the words they share, counted with repetition; longer: the words of the longer text.
    """
    num, den = share.numerator, share.denominator
    ordered = _ordered(rows)
    need = F.floor((F.col("n") * num + (den - 1)) / den).cast("int")  # ceil(share n)

    def prefixes(side: str, bit: int) -> DataFrame:
        kept = ordered.where(F.col("f").bitwiseAND(bit) > 0).select("id", "n", F.posexplode(F.slice("tokens", F.lit(1), F.col("n") - need + 1)).alias("pos", "t"))
        return kept.select(F.col("id").alias(f"id_{side}"), F.col("n").alias(f"n_{side}"), F.col("pos").alias(f"pos_{side}"), "t")

    a, b = prefixes("a", 1), prefixes("b", 2)
    longer, shorter = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    reach = 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    near = a.join(b, "t").where((F.col("id_a") != F.col("id_b")) & (shorter * den >= longer * num) & (reach * den >= longer * num))
    near = near.select("id_a", "id_b").distinct()
    side = lambda s, bit: ordered.where(F.col("f").bitwiseAND(bit) > 0).select(F.col("id").alias(f"id_{s}"), F.col("class").alias(f"class_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    near = near.join(side("a", 1), "id_a").join(side("b", 2), "id_b")
    near = near.select("class_a", "class_b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("shared"), F.greatest(F.size("tokens_a"), F.size("tokens_b")).alias("longer"))
    same = ordered.where("f = 3").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.col("n").alias("shared"), F.col("n").alias("longer"))
    return same.unionByName(near.where(F.col("shared") * den >= F.col("longer") * num))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who is in which class, per side; no text."""
    return (
        rows.where("is_train").select(F.col("sample_id").alias("train_id"), F.col("class").alias("class_a")).distinct(),
        rows.where("not is_train").select(F.col("sample_id").alias("eval_id"), "partition", "source_subset", F.col("class").alias("class_b")).distinct(),
    )


def _input(spark, root: str) -> DataFrame:
    return members(table(spark, root, "sft_samples").select("sample_id", "partition", "source_subset", "messages"))


def _hex(c: str):
    return F.lower(F.hex(c))


def p2_pairs(spark, root: str) -> DataFrame:
    """The pairs of a training class and an evaluation class, with the words they share; ``p2_members`` says who is in them."""
    return class_pairs(_input(spark, root)).select(_hex("class_a").alias("train_class"), _hex("class_b").alias("eval_class"), F.col("shared").cast("long").alias("shared"), F.col("longer").cast("long").alias("longer"))


def p2_members(spark, root: str) -> DataFrame:
    """One row per sample that has a text in a known partition: its class."""
    rows = _input(spark, root)
    return rows.select("sample_id", "is_train", "partition", "source_subset", _hex("class").alias("class_id")).distinct()


def p2_found(spark, root: str) -> DataFrame:
    """The pairs of classes, expanded to their members."""
    rows = _input(spark, root)
    train, evaluation = _sides(rows)
    pairs = class_pairs(rows).select("class_a", "class_b").join(train, "class_a").join(evaluation.select("eval_id", "class_b"), "class_b").where("train_id <> eval_id")
    return pairs.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b")).distinct()


def p2_links(spark, root: str) -> DataFrame:
    """One row per evaluation sample: its class, and how many training samples have the same or nearly the same text; no pair is expanded."""
    rows = _input(spark, root)
    train, evaluation = _sides(rows)
    links = class_pairs(rows).join(train.groupBy("class_a").agg(F.count("*").alias("n")), "class_a").groupBy("class_b").agg(F.sum("n").alias("n_links"))
    return evaluation.join(links, "class_b", "left").select("eval_id", "partition", "source_subset", _hex("class_b").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p2_report(spark, root: str) -> DataFrame:
    """Overlaps per evaluation partition and source subset: pairs, and evaluation samples with a partner, counted without expanding the pairs."""
    rows = _input(spark, root)
    train, evaluation = _sides(rows)
    weights = class_pairs(rows).join(train.groupBy("class_a").agg(F.count("*").alias("n")), "class_a").groupBy("class_b").agg(F.sum("n").alias("partners"))
    by = evaluation.join(weights, "class_b", "left").groupBy("partition", "source_subset")
    return by.agg(F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"), F.count("partners").alias("overlapping"), F.count("*").alias("samples"))
