"""Document fingerprints by order MinHash (operator 11), in DataFrame functions only.

A text is the sequence of its words, words of more than ``PIECE`` code points cut into pieces. Every ``k`` words in a row
are a k-mer; equal k-mers of a text are numbered in text order, so that a pair (k-mer, number) occurs once. Pairs are put
on a circle by a hash. From each of ``bins`` evenly spaced points on, the ``least`` pairs that come first are taken, put
back in text order, and their k-mers are hashed as one tuple: one pass over the pairs serves all tuples, and texts with
few words have full tuples too. Where text is moved, left out or put in, tuples differ even if the set of words does not,
so the share of equal tuples falls with the edit distance. Sorting hashes and looking at neighbours in sorted arrays
does all of it: k-mers that occur once, most of them, keep their own hash; only repeated ones are numbered.

Defined cases: null text counts as empty; a text of fewer than k words has one k-mer, all its words; texts without words
have empty fingerprints, which are alike; a text with fewer pairs than a tuple holds has shorter tuples. For the next
document rows stand by descending id, nulls last, then by the hash of their text; rows with equal id and text count as
one there and get equal results, each its own row; the only document is its own next one; an empty table gives no rows;
other columns are not read. Memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table

PIECE, K, LEAST, BINS = 16, 3, 2, 32
BIN_BITS = BINS.bit_length() - 1
WIDTH = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _kmers(words: Column) -> Column:
    """The hash of every k words in a row, or of all words if fewer."""
    return _let(words, lambda t: F.transform(F.slice(t, 1, F.greatest(F.size(t) - (K - 1), F.least(F.size(t), F.lit(1)))), lambda x, i: F.xxhash64(x, *(F.get(t, i + j) for j in range(1, K)))))


def _packed(value: Column, place: Column, bits: Column) -> Column:
    """The upper bits of a hash, over the place: orders by hash, then by place, and is not negative."""
    return F.call_function("shiftleft", F.call_function("shiftrightunsigned", value, bits + 1), bits).bitwiseOR(place.cast("long"))


def fingerprint(text: Column) -> Column:
    """``bins`` hexadecimal numbers of eight digits, or nothing for a text without words."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    return _let(_kmers(words), lambda g: F.when(F.size(g) == 0, F.lit("")).otherwise(_let(F.length(F.bin(F.size(g).cast("long"))), lambda bits: _tuples(g, bits))))


def _tuples(g: Column, bits: Column) -> Column:
    def upper(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 63 - BIN_BITS)

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (upper(x) != upper(F.get(s, i - 1))))

    def numbered(s: Column) -> Column:
        """The later ones of equal k-mers, hashed anew with their numbers. s has none but those."""
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (upper(F.get(s, i)) != upper(F.get(s, i - 1))))
        number = _let(begins, lambda b: F.flatten(F.transform(b, lambda at, j: F.sequence(F.lit(2), F.coalesce(F.get(b, j + 1), F.size(s)) - at + 1))))
        return F.zip_with(s, number, lambda x, n: _packed(F.xxhash64(F.get(g, place(x).cast("int")), n), place(x), bits))

    def nearest(s: Column) -> Column:
        """The first pairs of each bin, of a sorted array."""
        return F.filter(s, lambda x, i: (i < LEAST) | (bin_of(x) != bin_of(F.get(s, i - LEAST))))

    def pairs(s: Column) -> Column:
        """The first pairs of each bin, numbered ones included, in order."""
        def both(once: Column) -> Column:
            later = F.filter(s, lambda x, i: (i > 0) & (upper(x) == upper(F.get(s, i - 1))))
            return F.when(F.size(once) == F.size(s), nearest(once)).otherwise(_let(F.sort_array(F.concat(nearest(once), _let(later, numbered))), nearest))

        return _let(firsts(s), both)

    def tuples(c: Column) -> Column:
        marked = F.sort_array(F.concat(c, F.array(*(F.lit(b << (63 - BIN_BITS)) for b in range(BINS)))))
        take = F.least(F.size(c), F.lit(LEAST))

        def one(every: Column, b: int) -> Column:
            at = F.array_position(every, F.lit(b << (63 - BIN_BITS))).cast("int") - 1 - b
            got = [place(F.get(c, F.pmod(at + j, F.size(c)))).cast("int") for j in range(LEAST)]
            ordered = F.sort_array(F.slice(F.array(*got), 1, take))
            return _let(ordered, lambda o: F.hash(*(F.get(g, F.get(o, j)) for j in range(LEAST))))

        return _let(marked, lambda every: F.array_join(F.array(*(F.lpad(F.hex(one(every, b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), WIDTH, "0") for b in range(BINS))), ""))

    packed = F.transform(g, lambda x, i: _packed(x, i, bits))
    return _let(F.sort_array(packed), lambda s: _let(pairs(s), tuples))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples of two fingerprints."""
    same = [(F.substring(a, WIDTH * i + 1, WIDTH) == F.substring(b, WIDTH * i + 1, WIDTH)).cast("int") for i in range(BINS)]
    some = sum(same[1:], same[0]) / F.lit(float(BINS))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(some)


def next_documents(docs: DataFrame) -> DataFrame:
    """key, hash, doc_id, n, n_chars, next_key, next_hash: one row for each id and text of docs (key, hash, doc_id,
    n_chars), with the number of rows and the document that comes next by descending id, after the last the first. Only
    these short rows are sorted; each range of them is a group, and the last of a range looks at the first of the next."""
    keys = docs.groupBy("key", "hash", "doc_id").agg(F.count("*").alias("n"), F.max("n_chars").alias("n_chars"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    ranged = materialize(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "keys")
    within, own = Window.partitionBy("part").orderBy(*order), F.struct("key", "hash")
    rows = ranged.withColumn("next", F.lead(own).over(within)).withColumn("place", F.row_number().over(within))
    firsts = rows.where("place = 1").select("part", own.alias("first"))
    parts = Window.orderBy("part")  # one row for each range
    follows = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    joined = rows.join(follows, "part").withColumn("next", F.coalesce("next", "after"))
    return joined.select("key", "hash", "doc_id", "n", "n_chars", F.col("next.key").alias("next_key"), F.col("next.hash").alias("next_hash"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """key, hash, doc_id, n, n_chars, next_key, next_hash, text, edited: each text, and the text whose last
    floor(n_chars / 2) code points give way to the first as many (or all) of the next document. One row for each id and
    text. Keys are never null, so that all three joins share one shuffle of the texts; half of them move once more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text", F.col("doc_id").isNull()).alias("hash"), "doc_id", "text")
    follow = materialize(next_documents(rows.select("key", "hash", "doc_id", F.char_length("text").cast("long").alias("n_chars"))), "next")
    once = rows.select("key", "hash", "text").dropDuplicates(["key", "hash"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    asked = follow.select(F.col("key").alias("own_key"), F.col("hash").alias("own_hash"), half.alias("half"), F.col("next_key").alias("key"), F.col("next_hash").alias("hash"))
    heads = once.join(asked, ["key", "hash"]).select(F.col("own_key").alias("key"), F.col("own_hash").alias("hash"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"))
    met = once.join(follow, ["key", "hash"]).join(heads, ["key", "hash"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.col("head"))
    return met.select("key", "hash", "doc_id", "n", "n_chars", "next_key", "next_hash", "text", edited.alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint: one row for each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text").cast("string")).alias("fingerprint"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    return edit_report(table(spark, sf_dir, "documents"))


def edit_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    made = edited_texts(docs).select(
        "key", "hash", "doc_id", "n", "n_chars", "next_key", "next_hash", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint")
    )
    made = materialize(made, "fingerprints")
    after = made.select(F.col("key").alias("next_key"), F.col("hash").alias("next_hash"), F.col("fingerprint").alias("next_fingerprint"))
    met = made.join(after, ["next_key", "next_hash"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return met.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
