"""Document fingerprints by I-Match, with DataFrame functions only.

Terms: the lower-case text's maximal runs of ASCII letters and digits and of characters beyond ASCII. The lexicon is the
terms within a band of inverse document frequency, `rare` >= documents / df >= `common`, over all documents. At each of five
levels, a keyed hash deals the lexicon to 16 * 4^level random subsets, of which 16 count: denser subsets for short texts,
sparser ones for long texts. For each subset that a document meets, its distinct terms there are sorted and hashed; the
fingerprint is the list of these entries (level digit, subset digit, six hex digits). A document without lexicon terms has
the digest of all its sorted distinct terms, behind an 'x'.

Likeness of two fingerprints: 1 if they are equal; else, the largest over levels of equal entries over subsets that either
meets (level 0) or that number but eight at least (sparser levels); 0 where either has no entry.

The order of documents (descending id, then text) is cut into ranges of ids of about `rows_per_range` documents (the root
of their number where that is more); rows of one id are one range. One
shuffle of the texts by range, neighbours by a window within it, and of each range the first document as the next of the
range above. The lexicon holds at most `rare` terms for every distinct term of a mean document, whatever the number of
documents; it is broadcast only where counted to be small, and joined by a shuffle beyond that.

Edge cases: null texts count as empty; null ids come after the smallest id; rows that repeat are kept, in order of their
text; of a single document the next is itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

COMMON, RARE = 16, 4096
LEVELS = 5
BROADCAST_TERMS = 400_000
SEPARATORS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), SEPARATORS), ""))


def lexicon(docs: DataFrame, n: int, common: int = COMMON, rare: int = RARE) -> DataFrame:
    """term -> subsets (two hex digits each) of the terms within the band."""
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.filter((F.col("df") * common <= n) & (F.col("df") * rare >= n))
    digest = F.md5(F.col("term").cast("binary"))
    dealt = []
    for level in range(LEVELS):
        s = F.conv(F.substring(digest, 1 + 6 * level, 6), 16, 10).cast("long") % (16 * 4**level)
        dealt.append(F.when(s < 16, F.concat(F.lit(str(level)), F.lower(F.hex(s)))))
    return materialise(band.select("term", F.array_compact(F.array(*dealt)).alias("slots")), "lexicon")


def ranges(docs: DataFrame, n: int, rows_per_range: int = 4000) -> list[int]:
    """Lower bounds of ranges of ids, ascending; the first range has none. Ranges of rows_per_range rows, or of the square
    root of the number of rows where that is more: neither their number nor their size outgrows a task or the driver."""
    count = max(1, -(-n // max(rows_per_range, isqrt(n))))
    if count == 1:
        return []
    shares = F.lit(np.arange(1, count) / count)
    found = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * count)).alias("b")).first().b or []
    return sorted(set(found))


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the id, by halving; null ids are in the lowest range."""
    if not bounds:
        return F.lit(0)
    held = F.lit(np.array(bounds, np.int64))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        above = F.element_at(held, F.least(middle, F.lit(len(bounds) - 1)) + 1) > doc_id
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & ~above, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & above, middle).otherwise(s["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["low"])
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(found)


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    both = F.array_intersect(a, b)
    met = F.array_union(F.transform(a, lambda e: F.substring(e, 1, 2)), F.transform(b, lambda e: F.substring(e, 1, 2)))
    of = lambda entries, level: F.size(F.filter(entries, lambda e: F.startswith(e, F.lit(str(level))))).cast("double")
    shares = [of(both, k) / F.greatest(of(met, k), F.lit(8.0 if k else 1.0)) for k in range(LEVELS)]
    return F.when(whole_a == whole_b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(*shares))


def fingerprints(docs: DataFrame, common: int = COMMON, rare: int = RARE, rows_per_range: int = 4000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    bounds = ranges(docs, n, rows_per_range)
    lex = lexicon(docs, n, common, rare)
    dealt = docs.withColumn("range", range_of(F.col("doc_id"), bounds))

    # the first document of each range is the next of the last one above it; the lowest range's next is the topmost
    heads = docs_of_heads(dealt)
    order = W.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "text")
    placed = dealt.repartition("range").withColumns({"rn": F.row_number().over(order), "below": F.lead("text").over(order)})
    placed = placed.join(heads.select("range", "head"), "range")
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring(F.coalesce("below", "head"), F.lit(1), cut))
    texts = placed.select("range", "rn", "doc_id", "text", size.cast("long").alias("n_chars"), edited.alias("edited"))
    sets = texts.select("range", "rn", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), terms(F.col("text")).alias("t0"), terms(F.col("edited")).alias("t1"))
    # kind 0 and 1: a term of the text, of the edited text; 2: the edited text's digest; 3 and 4: digests of all terms
    whole = lambda t: F.md5(F.array_join(F.array_sort(t), " ").cast("binary"))
    pieces = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("terms")) for k, v in enumerate((F.col("t0"), F.col("t1"), F.array("sha"), F.array(whole(F.col("t0"))), F.array(whole(F.col("t1")))))])
    rows = sets.select("range", "rn", "doc_id", "n_chars", F.inline(pieces)).select("range", "rn", "doc_id", "n_chars", "kind", F.explode("terms").alias("term"))
    small = lex.count() <= BROADCAST_TERMS
    known = rows.join(F.broadcast(lex) if small else lex, "term", "left").filter("kind > 1 or slots is not null")
    slots = known.withColumn("slot", F.explode(F.when(F.col("kind") > 1, F.array(F.lit(""))).otherwise(F.col("slots"))))
    key = ["range", "rn", "doc_id", "n_chars"]
    signed = slots.groupBy(*key, "kind", "slot").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    entry = F.when(F.col("kind") > 1, F.col("terms")[0]).otherwise(F.concat("slot", F.substring(F.md5(F.array_join("terms", " ").cast("binary")), 1, 6)))
    signed = signed.select(*key, "kind", entry.alias("entry"))
    lists = {f"e{k}": F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("entry")))) for k in range(5)}
    prints = signed.groupBy(*key).agg(*[v.alias(k) for k, v in lists.items()])
    text_of = lambda e, w: F.when(F.size(e) > 0, F.array_join(e, "")).otherwise(F.concat(F.lit("x"), F.col(w)[0]))
    prints = prints.select(*key, F.col("e2")[0].alias("edited_sha256"), "e0", "e1", text_of(F.col("e0"), "e3").alias("fingerprint"), text_of(F.col("e1"), "e4").alias("edited_fingerprint"))
    prints = materialise(prints, "imatch")

    first = F.broadcast(next_of(prints.filter("rn = 1").select("range", F.col("e0").alias("he"), F.col("fingerprint").alias("hf"))))
    order = W.partitionBy("range").orderBy("rn")
    out = prints.withColumns({"be": F.lead("e0").over(order), "bf": F.lead("fingerprint").over(order)}).join(first, "range")
    near = likeness(F.col("e0"), F.col("e1"), F.col("fingerprint"), F.col("edited_fingerprint"))
    after = likeness(F.col("e0"), F.coalesce("be", "he"), F.col("fingerprint"), F.coalesce("bf", "hf"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near_edited"), after.alias("near_next"))


def docs_of_heads(dealt: DataFrame) -> DataFrame:
    """range -> head: the text of the first document of the range below (of the topmost, for the lowest range)."""
    top = dealt.groupBy("range").agg(F.max("doc_id").alias("top"))  # a row a range
    keys = top.select(F.col("range").alias("r"), "top")
    rows = dealt.join(F.broadcast(keys), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("top")))
    return materialise(next_of(rows.groupBy("range").agg(F.min("text").alias("head"))), "heads")


def next_of(firsts: DataFrame) -> DataFrame:
    """firsts by range (at most as many rows as there are ranges) -> each range with the columns of the range below it."""
    ranked = firsts.withColumn("k", F.row_number().over(W.orderBy("range")))
    names = [c for c in firsts.columns if c != "range"]
    count = F.max("k").over(W.partitionBy())
    here = ranked.withColumn("to", F.when(F.col("k") == count, F.lit(1)).otherwise(F.col("k") + 1))
    return here.select(F.col("to").alias("k"), *names).join(ranked.select("k", "range"), "k").select("range", *names)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _entries(kind: int) -> str:
    return f"coalesce(list_sort(list(entry) FILTER (kind = {kind})), [])"


def _near(a: str, b: str, fa: str, fb: str) -> str:
    met = f"list_distinct(list_concat(list_transform({a}, lambda e: substr(e, 1, 2)), list_transform({b}, lambda e: substr(e, 1, 2))))"
    shares = [f"len(list_filter(list_intersect({a}, {b}), lambda e: e[1] = '{k}'))::DOUBLE / greatest(len(list_filter({met}, lambda e: e[1] = '{k}'))::DOUBLE, {8.0 if k else 1.0})" for k in range(LEVELS)]
    return f"CASE WHEN {fa} = {fb} THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE greatest({', '.join(shares)}) END::DOUBLE"


_SLOTS = " UNION ALL ".join(f"SELECT term, '{k}' || lower(to_hex(v)) AS slot FROM (SELECT term, (('0x' || substr(md5(term), {1 + 6 * k}, 6))::BIGINT) % {16 * 4**k} AS v FROM band) WHERE v < 16" for k in range(LEVELS))
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS rn FROM d),
p AS (SELECT *, coalesce(lead(text) OVER (ORDER BY rn), first_value(text) OVER (ORDER BY rn)) AS below, length(text) AS n FROM o),
x AS (SELECT rn, doc_id, text, n::BIGINT AS n_chars, substr(text, 1, (n - n // 3)::INT) || substr(below, 1, (n // 3)::INT) AS edited FROM p),
t AS (SELECT rn, 0 AS kind, list_distinct(list_filter(regexp_split_to_array(lower(text), '{SEPARATORS}'), lambda w: w <> '')) AS terms FROM x
  UNION ALL SELECT rn, 1, list_distinct(list_filter(regexp_split_to_array(lower(edited), '{SEPARATORS}'), lambda w: w <> '')) FROM x),
u AS (SELECT rn, kind, unnest(terms) AS term FROM t),
band AS (SELECT term FROM u WHERE kind = 0 GROUP BY term HAVING count(*) * {COMMON} <= (SELECT count(*) FROM d) AND count(*) * {RARE} >= (SELECT count(*) FROM d)),
slots AS ({_SLOTS}),
s AS (SELECT rn, kind, slot || substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 6) AS entry FROM u JOIN slots USING (term) GROUP BY rn, kind, slot),
e AS (SELECT rn, {_entries(0)} AS e0, {_entries(1)} AS e1 FROM s GROUP BY rn),
w AS (SELECT rn, max(md5(array_to_string(list_sort(terms), ' '))) FILTER (kind = 0) AS w0, max(md5(array_to_string(list_sort(terms), ' '))) FILTER (kind = 1) AS w1 FROM t GROUP BY rn),
f AS (SELECT x.rn, doc_id, n_chars, sha256(edited) AS edited_sha256, coalesce(e0, []) AS e0, coalesce(e1, []) AS e1,
  CASE WHEN len(coalesce(e0, [])) > 0 THEN array_to_string(e0, '') ELSE 'x' || w0 END AS fingerprint,
  CASE WHEN len(coalesce(e1, [])) > 0 THEN array_to_string(e1, '') ELSE 'x' || w1 END AS edited_fingerprint
  FROM x JOIN w USING (rn) LEFT JOIN e USING (rn)),
g AS (SELECT *, coalesce(lead(e0) OVER (ORDER BY rn), first_value(e0) OVER (ORDER BY rn)) AS ne, coalesce(lead(fingerprint) OVER (ORDER BY rn), first_value(fingerprint) OVER (ORDER BY rn)) AS nf FROM f)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_near("e0", "e1", "fingerprint", "edited_fingerprint")} AS near_edited, {_near("e0", "ne", "fingerprint", "nf")} AS near_next FROM g
"""
