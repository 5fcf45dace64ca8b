"""Document fingerprints from closed syncmers, in native expressions only.

The letters of the alphabet are word pieces.  A run of up to 12 characters
that are not blanks is one piece.  A longer run is cut by its content, so that
texts without blanks keep their pieces when something is put in front: each
character beyond ASCII is a piece, and ASCII pieces end with a character of
ENDS (only after 12 characters without one is a piece cut by its length).  A k-mer of K consecutive pieces is a closed syncmer if the
smallest hash among its inner s-mers (S pieces) stands at its first or last
s-mer.  Whether a k-mer is chosen depends on its own pieces alone, so an edit
changes only the anchors that touch it, and equal passages have equal anchors
wherever they stand.  About 2 / (K - S + 1) of all k-mers are chosen.

A fingerprint holds all anchors in the order of the text: the distance from the
anchor before, in pieces, and the hash.  Matching is by position: an anchor of
two texts matches if in both the anchor before it is the same and as far away,
that is if the pair stands at one offset.  The likeness of two fingerprints is
the Jaccard similarity of their sets of such steps (the first step is the first
anchor itself), so it is a function of the fingerprints alone, moved passages
keep all steps but those at their seams, and shuffled anchors have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

K, S = 6, 2
ENDS = r"aeiouAEIOU0257_/.,;:=&?!\-"
PIECE = rf"(?<!\S)\S{{1,12}}(?!\S)|[^\s\x00-\x7F]|(?:(?![{ENDS}])[\x00-\x7F&&\S]){{0,11}}[{ENDS}]|(?:(?![{ENDS}])[\x00-\x7F&&\S]){{1,12}}"


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>>: the closed syncmers of a text by piece number.

    A text whose pieces give no syncmer (all of fewer than K pieces, many of K
    to K + 2) has one anchor, its whole sequence; a text without a piece, or
    null, has none.
    """
    inner = K - S + 1  # s-mers in a k-mer

    def smers(h: Column) -> Column:
        n = F.size(h) - 1
        return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))

    def chosen(s: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            last = F.get(s, i + (inner - 1))
            middle = [F.get(s, i + j) for j in range(1, inner - 1)]
            hit = last.isNotNull() & (F.least(x, last) <= F.least(*middle))
            return F.when(hit, F.struct(i.alias("pos"), F.xxhash64(x, middle[1], last).alias("hash")))

        return F.filter(F.transform(s, at), lambda a: a.isNotNull())

    def of(h: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
        found = F.when(F.size(h) < K, F.slice(whole, 1, 0)).otherwise(_let(smers(h), chosen))
        return _let(found, lambda a: F.when((F.size(a) == 0) & (F.size(h) > 0), whole).otherwise(a))

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    return _let(F.transform(pieces, lambda w: F.xxhash64(w)), of)


def fingerprint(found: Column) -> Column:
    """Anchors as a string: distance and hash in hexadecimal, joined by blanks."""
    def step(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(found, i - 1)["pos"], F.lit(0))
        return F.concat(F.hex(x["pos"] - before), F.lit("."), F.hex(x["hash"]))

    return F.concat_ws(" ", F.transform(found, step))


def steps(found: Column) -> Column:
    """array<bigint>: the distinct steps of a text's anchors."""
    def step(x: Column, i: Column) -> Column:
        before = F.get(found, i - 1)
        return F.when(i == 0, x["hash"]).otherwise(F.xxhash64(before["hash"], x["hash"], (x["pos"] - before["pos"]).cast("long")))

    return F.array_distinct(F.transform(found, step))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of the steps of two fingerprints; of two without an anchor, 1."""
    def of(both: Column) -> Column:
        return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))

    return _let(F.size(F.array_intersect(a, b)), of)


def ring(keys: DataFrame) -> DataFrame:
    """For distinct rows (k, kn, th) in descending order of k (kn: no doc_id,
    last), then th: each row and its successor next_k, next_kn, next_th; the
    last row's is the first.

    Rows are sorted by ranges, so no task holds all; the few rows at the seams,
    one for each range, are put in order by themselves.
    """
    order = [F.asc("kn"), F.desc("k"), F.asc("th")]
    parts = stored(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ring")
    me = F.struct("kn", "k", "th")
    w = Window.partitionBy("part").orderBy(*order)
    linked = parts.select(*parts.columns, F.lead(me).over(w).alias("nxt"))
    heads = parts.select("part", me.alias("head"), F.row_number().over(w).alias("i")).filter("i = 1").drop("i")
    by = Window.orderBy("part")
    seams = heads.select("part", F.lead("head").over(by).alias("seam"), F.first("head").over(by).alias("very_first"))
    nxt = F.coalesce("nxt", "seam", "very_first")
    return linked.join(seams, "part").select("k", "kn", "th", *(nxt[c].alias(f"next_{c}") for c in ("k", "kn", "th")))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Edited: the last floor(n_chars / 2) code points give way to the first as
    many (or all) of the next document, in descending order of doc_id; after
    the last comes the first.  Null texts are empty.  Rows without a doc_id
    come last; rows of one doc_id are ordered by a hash of their text, and
    rows equal in both are one document here, each row getting its result.

    The likeness columns compare the fingerprints.  The texts are shuffled once by
    document and once more, whole, to the document that takes them in: a text
    packs better than its anchors, which are worked out there.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("kn"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = docs.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("kn"), F.xxhash64(text).alias("th"))
    links = stored(ring(keys.distinct()), "links")
    on = ["k", "kn", "th"]
    to = links.select(F.col("k").alias("to_k"), F.col("kn").alias("to_kn"), F.col("th").alias("to_th"), *(F.col(f"next_{c}").alias(c) for c in on))
    given = rows.join(to, on).select(
        F.col("to_k").alias("k"), F.col("to_kn").alias("kn"), F.col("to_th").alias("th"),
        F.col("text").alias("next"),
    )
    given = given.groupBy(*on).agg(F.first("next").alias("next"))  # a repeated next document gives the same each time
    n = F.char_length("text")
    both = rows.join(given, on).select(
        "k", "kn", n.cast("long").alias("n_chars"), "text", "next",
        F.expr("substring(text, 1, char_length(text) - char_length(text) div 2) || substring(next, 1, char_length(text) div 2)").alias("edited"),
    )
    done = both.select("k", "kn", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), *(anchors(F.col(c)).alias(f"{c}_anchors") for c in ("text", "edited", "next")))
    done = done.select("*", *(steps(F.col(f"{c}_anchors")).alias(f"{c}_steps") for c in ("text", "edited", "next")))
    return done.select(
        F.when(~F.col("kn"), F.col("k")).alias("doc_id"), "n_chars", "edited_sha256",
        fingerprint(F.col("text_anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("text_steps"), F.col("edited_steps")).alias("near_edited"), likeness(F.col("text_steps"), F.col("next_steps")).alias("near_next"),
    )
