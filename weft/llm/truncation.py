"""Texts that were cut off by field limits or broken transfers, in SQL.

Word trigrams are counted inside the lines of all distinct texts and at the lines' ends, by kind of line (prose, log,
bullet, ...). Every text's last trigram is joined with these counts, less the text's own end, so that neither a text nor
its copies vouch for themselves. It stands for a cut if it is frequent inside lines but almost never ends one, or if
its last word is but the beginning of a word that stands there otherwise. Names, codes and
numbers are classes (``§``, ``K``, ``0``), so that not every trigram is a new one; each Han character is a word. Marks
that a system puts after a cut are taken off before.

Two exact rules go with it: a structure that is still open (fence, bracket, JSON string) is a cut, and so is prose
whose last line ends neither in a sentence mark nor in a trigram that is known to end lines.

Whole lines and words are looked at, whatever their length. Texts are shuffled once, to be distinct; the trigram counts are
pre-aggregated before they are shuffled, and their number follows the vocabulary, not the texts. Whether a word is the
beginning of others is asked of their order: running sums over the sorted words that can follow, apart by first letter. The
judgement is made once per distinct last trigram and goes back to the texts by a salted join, so that an end that a third of
all texts have is no single task. Four dots are a sentence's own and three more, unless a word is cut.

Defined results: null, empty and blank texts are no cases, nor are texts without a letter; a null key has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.common import folded, table
from weft.session import cut

#: Fixed value: what systems leave after a cut, as a pattern at the end of a line.
MARKS = r"(?i)(?:\s*(?:\.{2,}|…|\[\s*(?:\.{2,}|…|truncated|cut|more|snip|continued)\s*\]|\(\s*(?:\.{2,}|…|more|truncated|cut|continued)\s*\)|�|</?[a-z]{0,10}|&[a-z#0-9]{0,8}|\\u[0-9a-f]{0,3}|\\x[0-9a-f]?|\\))+$"
#: Whether a line may end in such a mark at all: by its last characters, or because it has what begins one.
_MAYBE = "(right({0}, 2) = '..' OR right({0}, 1) IN ('…', ']', ')', '�') OR contains({0}, '<') OR contains({0}, '&') OR contains({0}, '\\\\'))"
#: Parts into which the texts of one last trigram go.
SALT = 8
#: Fixed value: white space and invisible characters at the end of a text.
_BLANKS = " \t\n\r\f\v\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"
#: The share of its uses below which a trigram almost never ends a line, by the rule of succession, so that few uses prove
#: nothing; the share above which it ends even prose without a sentence mark. Both are shares of the uses elsewhere.
ALMOST_NEVER, MOSTLY = 0.02, 0.5

_SENTENCE = r"""(?:[.!?。！？]|\p{So})[\s"'”’»」』)\]*_`\p{So}\p{Sk}\x{200D}\x{FE0F}]*$"""
#: How a line begins, and the kind of line by the last character of that.
_BEGINS = r"""regexp_extract(line, r'^(?:\s*(?:\d{4}-\d\d-\d\d|(?:[-*+•]|\d+[.)])\s|[|>—–])|#\p{L}|[\s{}\[\]"])', 0)"""
_KIND = r"""
    CASE WHEN begins = '' THEN 'prose' WHEN left(begins, 1) = '#' THEN 'tags' WHEN right(begins, 1) = '|' THEN 'table' WHEN right(begins, 1) = '>' THEN 'quote' WHEN right(begins, 1) IN ('—', '–') THEN 'signature'
         WHEN right(begins, 1) BETWEEN '0' AND '9' THEN 'log' WHEN right(begins, 1) IN ('{', '}', '[', ']', '"') OR NOT begins RLIKE r'\S' THEN 'code' ELSE 'bullet' END
"""
_MASKED = r"""
    regexp_replace(regexp_replace(regexp_replace(line, r'#\d+|\b[A-Z]{2}-?\d+', 'K'), r'\d+', '0'), r'#\p{L}+|\p{Lu}\p{Ll}[\p{L}]*', '§')
"""

_WORDS = rf"""{_KIND} AS kind, regexp_extract_all(concat('^ ^ ', {_MASKED}), r'(\p{{IsHan}}|[\p{{L}}_&&[^\p{{IsHan}}]]+|[^\s\p{{L}}])', 1) AS words"""

#: No filter stands above the words, or they would be made a second time for it.
LINES = rf"""
SELECT {_WORDS} FROM (SELECT line, {_BEGINS} AS begins FROM (
  SELECT CASE WHEN {_MAYBE.format('line')} THEN regexp_replace(line, :marks, '') ELSE line END AS line
  FROM (SELECT DISTINCT body FROM texts) LATERAL VIEW explode(split(body, '\n')) AS line WHERE line RLIKE r'\S'
))
"""

TEXTS = rf"""
SELECT doc_id, source, whole, CASE WHEN {_MAYBE.format('whole')} THEN regexp_replace(whole, :marks, '') ELSE whole END AS body
FROM (SELECT doc_id, source, trim(TRAILING :blanks FROM replace(text, '\r', '')) AS whole FROM input WHERE doc_id IS NOT NULL AND text RLIKE r'\p{{L}}')
"""

TRIGRAMS = r"""
SELECT kind, a, b, c, count_if(d IS NOT NULL) AS inside, count_if(d IS NULL) AS at_end FROM (
  SELECT kind, inline(arrays_zip(words, slice(words, 2, size(words)), slice(words, 3, size(words)), slice(words, 4, size(words)))) AS (a, b, c, d) FROM lines
) WHERE c IS NOT NULL GROUP BY kind, a, b, c
"""

_DEPTH = "length({0}) - length(translate({0}, '[{{', '')) > length({0}) - length(translate({0}, ']}}', ''))"
_STRINGS = r"""r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'"""

#: One pass over the texts: what is open or closed at their ends, and the last three words of their last lines.
ENDS = rf"""
SELECT doc_id, source, open, marked, dotted, closed, kind, try_element_at(words, -3) AS a, try_element_at(words, -2) AS b, element_at(words, -1) AS c FROM (
  SELECT doc_id, source,
    (length(whole) - length(replace(whole, '```', ''))) % 6 <> 0
    OR coalesce(contains(bare, '"') OR {_DEPTH.format('bare')}, false)
    OR (NOT ended AND (contains(line, '(') OR contains(line, '（')) AND length(translate(line, '(（', '')) < length(translate(line, ')）', ''))) AS open,
    NOT ended AND length(body) < length(whole) AND right(whole, 2) <> '..' AND right(whole, 1) <> '…' OR right(line, 1) = '#' AND line RLIKE r'(?:^|\s)#$' AS marked,
    right(whole, 4) = '....' AND right(whole, 5) RLIKE r'^[^\s.]' AS dotted,
    ended OR right(body, 1) IN (']', '}}', '|') OR right(body, 3) = '```' OR contains(line, '/') AND line RLIKE r'^\S*/\S*\.\w{{1,5}}$' OR (line RLIKE r'\d' AND line RLIKE r'^[\p{{Lu}}\d#/\s,;:_-]+$') AS closed,
    {_WORDS}
  FROM (
    SELECT doc_id, source, whole, body, line, line RLIKE :sentence OR NOT line RLIKE r'[\p{{L}}\p{{N}}]' AND body RLIKE :sentence AS ended,
           regexp_replace(CASE WHEN body RLIKE r'^\s*[\[{{]' THEN body WHEN contains(line, '{{') OR contains(line, '[') THEN line END, {_STRINGS}, '') AS bare, {_BEGINS} AS begins
    FROM (SELECT doc_id, source, whole, body, substring_index(body, '\n', -1) AS line FROM texts)
  )
)
"""

LAST = "SELECT kind, a, b, c FROM ends WHERE NOT closed AND a IS NOT NULL GROUP BY kind, a, b, c"

#: Longer words than the last one that begin like it, after the same two words: a sum over all words in order, up to the last
#: that can begin so, less the sum up to the word itself.
BEGINNINGS = r"""
SELECT kind, a, b, w AS c, max(CASE WHEN side = 2 THEN upto END) - max(CASE WHEN side = 1 THEN upto END) AS longer FROM (
  SELECT kind, a, b, w, side, sum(n) OVER (PARTITION BY kind, a, b, f ORDER BY key, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM (
    SELECT t.kind, t.a, t.b, left(t.c, 1) AS f, t.c AS key, 0 AS side, t.c AS w, t.inside + t.at_end AS n
    FROM trigrams t LEFT SEMI JOIN last e ON e.kind = t.kind AND e.a = t.a AND e.b = t.b AND left(e.c, 1) = left(t.c, 1)
    WHERE length(t.c) > 1 AND t.c RLIKE r'^\p{L}+$' AND t.inside + t.at_end > 1
    UNION ALL SELECT kind, a, b, left(c, 1), c, 1, c, 0 FROM last WHERE c RLIKE r'^\p{L}+$'
    UNION ALL SELECT kind, a, b, left(c, 1), concat(c, decode(unhex('F48FBFBF'), 'UTF-8')), 2, c, 0 FROM last WHERE c RLIKE r'^\p{L}+$'
  )
) WHERE side > 0 GROUP BY kind, a, b, w
"""

#: What the trigrams say of each distinct end; ``others`` are its uses as an end elsewhere.
JUDGED = r"""
SELECT e.kind, e.a, e.b, e.c, explode(sequence(0, :salt - 1)) AS salt, t.inside, t.at_end - 1 AS others, g.longer
FROM last e
LEFT JOIN trigrams t ON t.kind = e.kind AND t.a = e.a AND t.b = e.b AND t.c = e.c
LEFT JOIN beginnings g ON g.kind = e.kind AND g.a = e.a AND g.b = e.b AND g.c = e.c
"""

VERDICT = r"""
SELECT o.doc_id, o.source, CASE
    WHEN NOT o.closed AND j.longer > j.others THEN 'inside a word'
    WHEN NOT o.closed AND NOT o.dotted AND j.others + 1 < :never * (j.inside + j.others + 2) THEN 'inside a sentence'
    WHEN o.open THEN 'open structure'
    WHEN o.closed OR o.dotted THEN NULL
    WHEN o.marked OR length(o.c) = 1 AND o.c RLIKE r'\p{Lu}' AND o.c NOT IN ('K') THEN 'no known end'
    WHEN o.kind IN ('prose', 'code') AND j.others <= :mostly * (j.inside + j.others) THEN 'no known end'
  END AS cut
FROM (SELECT *, pmod(xxhash64(doc_id), :salt) AS part FROM ends) o
LEFT JOIN judged j ON j.salt = o.part AND j.kind = o.kind AND j.a = o.a AND j.b = o.b AND j.c = o.c
"""


def verdicts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut): why each text with a letter counts as cut, or null; ``documents(doc_id, source, text)``, one row per doc_id.

    The trigram counts and the ends of the texts are written once, since both are read more than once.
    """
    spark = documents.sparkSession
    args = {"marks": MARKS, "blanks": _BLANKS, "sentence": _SENTENCE, "never": ALMOST_NEVER, "mostly": MOSTLY, "salt": SALT}
    documents.createOrReplaceTempView("weft_truncation_input")
    parts = {"input": "SELECT doc_id, source, text FROM weft_truncation_input", "texts": TEXTS, "lines": LINES, "trigrams": TRIGRAMS, "ends": ENDS}

    def run(last: str, *names: str) -> DataFrame:
        return spark.sql("WITH " + ", ".join(f"{name} AS ({parts[name]})" for name in names) + last, args=args)

    cut(run("SELECT * FROM trigrams", "input", "texts", "lines", "trigrams")).createOrReplaceTempView("weft_truncation_trigrams")
    cut(run("SELECT * FROM ends", "input", "texts", "ends")).createOrReplaceTempView("weft_truncation_ends")
    parts |= {"trigrams": "SELECT * FROM weft_truncation_trigrams", "ends": "SELECT * FROM weft_truncation_ends", "last": LAST, "beginnings": BEGINNINGS, "judged": JUDGED}
    return run(VERDICT, "trigrams", "ends", "last", "beginnings", "judged")


def _documents(spark, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "source", "text")


def p9_found(spark, root: str) -> DataFrame:
    return verdicts(_documents(spark, root)).where("cut is not null").select("doc_id").distinct()


def p9_report(spark, root: str) -> DataFrame:
    """Per source the texts, those that are cut, and their share; by reason, those of the trigrams first."""
    docs = table(spark, root, "documents").where("doc_id is not null").groupBy(folded("source").alias("source")).agg(F.count("*").alias("n_docs"))
    reasons = ("inside a word", "inside a sentence", "open structure", "no known end")
    found = verdicts(_documents(spark, root)).where("cut is not null").groupBy(folded("source").alias("cut_source")).agg(F.count("*").alias("n_cut"), *(F.count_if(F.col("cut") == r).alias(r.replace(" ", "_")) for r in reasons))
    by = docs.join(found, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source").na.fill(0, ["n_cut", *(r.replace(" ", "_") for r in reasons)])
    return by.withColumn("share", F.try_divide(F.col("n_cut").cast("double"), F.col("n_docs")))
