"""Secret scans by corpus-wide ownership frequency (operator 6), in DataFrame functions only.

Fixed patterns give the base spans. Patterns of known token shapes give further candidates. The value of every span is
hashed and counted over the corpus by distinct repositories and distinct owners: a value that many owners hold is a
widely copied example, one that few hold looks live. Base spans are all reported; a further candidate becomes a span if
it looks live. Positions count code points; a span's end is exclusive. Values that a large share of all spans have are
few, and are joined by broadcast. Added patterns bound or possess their repeats, and matches are placed block by block,
so that time grows with a text's length.

Defined cases: null text counts as empty; null owners and repositories count as one owner and one repository; rows with
null or repeated ids are scanned each on its own, and equal rows get equal results; an empty table gives no rows; other
columns are not read, and stay as they are, whatever their names, where texts are redacted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import join_common, materialize, table, unused


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    value_group: int
    least: int
    added: bool = False


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
    Kind("bearer", r"(?i)\bbearer\x20{1,16}([A-Za-z0-9._~+/-]{20,}+=*+)", 1, 20, True),
    Kind("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}+", 0, 40, True),
    Kind("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}+", 0, 15, True),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 28, True),
    Kind("urlpass", r"\b[a-z][a-z0-9+.-]{0,15}://[^\s/:@]{1,256}:([^\s/:@]{8,256})@", 1, 8, True),
    Kind("pem", r"-----BEGIN\x20[A-Z\x20]{0,40}PRIVATE\x20KEY-----", 0, 27, True),
)
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
PLACEHOLDER = "[SECRET]"
BLOCK, CHUNK = 256, 4096
_SPAN = "array<struct<start:int,rank:int,stop:int,value:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _walked(items: Column, step: Callable[[Column, Column], Column], emitted: str) -> Column:
    """What step emits along the items, from left to right. step(state, item) gives a struct of the new state ``at``, an
    int that begins with 0, and the array ``out`` of what has been emitted, of type ``emitted``. Items are taken in blocks,
    so that no long array is copied for each item."""
    none = F.array().cast(emitted)

    def blocks(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), lambda i: F.slice(every, i * BLOCK + 1, BLOCK))

    def block(acc: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{emitted}>").alias("out"))
    return _let(items, lambda every: F.when(F.size(every) > 0, F.flatten(F.aggregate(blocks(every), begin, block, lambda acc: acc["out"]))).otherwise(none))


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """Spans of one kind. The matches and what lies between them add up to the text, so running lengths give places."""
    whole, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    matches = F.filter(F.zip_with(whole, gaps, lambda w, g: F.struct(w.alias("w"), F.char_length(g).alias("g"))), lambda x: x["w"].isNotNull())

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        stop = start + F.char_length(x["w"])
        value = F.regexp_extract(x["w"], kind.pattern, kind.value_group) if kind.value_group else x["w"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.xxhash64(value).alias("value"))
        size = F.char_length(value if kind.name == "assign" else x["w"])
        return F.struct(stop.alias("at"), F.when(size >= kind.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(kind.pattern), _walked(matches, place, _SPAN)).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """doc_id, text_hash (of equal texts), repository, owner, found (all candidate spans in order)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    found = [_spans(F.col("text"), k, kind).alias(f"s{k}") for k, kind in enumerate(KINDS)]
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "repository", "owner", *found)
    return rows.select("doc_id", "text_hash", "repository", "owner", F.array_sort(F.concat(*(f"s{k}" for k in range(len(KINDS))))).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories, n: distinct holders of each candidate value in the corpus, and spans that have it."""
    held = found.select("repository", "owner", F.explode("found.value").alias("value")).groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def scan(docs: DataFrame, repository: Column, owner: Column, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, text_hash, spans (start, rank of the kind, stop, value, live), one row for each row of docs."""
    found = materialize(candidates(docs, repository, owner), "candidates")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    values = materialize(ownership(found).select("value", "n", live.alias("live")), "values")
    each = found.where(F.size("found") > 0).select("doc_id", "text_hash", "found").distinct().select("doc_id", "text_hash", F.explode("found").alias("s"))
    judged = join_common(each.select("*", F.col("s.value").alias("value")), values, "value")
    base_rank = sum(not kind.added for kind in KINDS)
    judged = judged.where(F.col("live") | (F.col("s.rank") < base_rank))
    span = F.struct(*(F.col(f"s.{f}").alias(f) for f in ("start", "rank", "stop")), "value", "live")
    spans = judged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    some = found.where(F.size("found") > 0).select("doc_id", "text_hash").alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,value:bigint,live:boolean>>")
    with_spans = some.join(spans.alias("b"), same, "left").select("a.doc_id", "a.text_hash", F.coalesce("b.spans", empty).alias("spans"))
    return with_spans.union(found.where(F.size("found") == 0).select("doc_id", "text_hash", empty.alias("spans")))


def _shown(spans: Column) -> Column:
    names = F.array(*(F.lit(kind.name) for kind in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_examples."""
    spans, base = F.col("spans"), sum(not kind.added for kind in KINDS)

    def count(test) -> Column:
        return F.size(F.filter(spans, test)).cast("long")

    def of_rank(k: int) -> Column:
        return count(lambda s: s["rank"] == k)

    return scanned.select(
        "doc_id", *(of_rank(k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS[:base])),
        F.sha2(_shown(F.filter(spans, lambda s: s["rank"] < base)), 256).alias("base_sha256"), _shown(spans).alias("spans"),
        count(lambda s: s["rank"] >= base).alias("n_added"), count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_examples"),
    )


def redact(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """docs with every live-looking span of its text replaced by a placeholder, spans that overlap by one; examples
    stay."""
    live = scan(docs, repository, owner).select("doc_id", "text_hash", F.filter("spans", lambda s: s["live"]).alias("spans")).where(F.size("spans") > 0).distinct()
    own_hash = unused("hash", docs.columns)
    keyed = docs.withColumn(own_hash, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{own_hash}") == F.col("b.text_hash"))
    text = F.col("a.text").cast("string")
    new = F.when(F.col("b.spans").isNotNull(), _replaced(text, F.col("b.spans"))).otherwise(text).alias("text")
    return keyed.join(live.alias("b"), same, "left").select(*(new if c == "text" else F.col(f"a.`{c}`") for c in docs.columns))


def _replaced(text: Column, spans: Column) -> Column:
    """The text, chunk by chunk, without the spans, which are in order. A placeholder stands where a span begins that no
    earlier one overlaps."""

    def apart(acc: Column, s: Column) -> Column:
        """Cuts: the part of each span that no earlier one covers; none opens a placeholder but where it begins anew."""
        start = F.greatest(acc["at"], s["start"])
        cut = F.struct(start.alias("start"), s["stop"].alias("stop"), (s["start"] >= acc["at"]).alias("opens"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["stop"] > start, F.concat(acc["out"], F.array(cut))).otherwise(acc["out"]).alias("out"))

    cuts = _walked(spans, apart, "array<struct<start:int,stop:int,opens:boolean>>")

    def chunk(part: Column, i: Column, every: Column) -> Column:
        low, size = i * CHUNK, F.char_length(part)
        inside = F.filter(every, lambda c: (c["start"] < low + size) & (c["stop"] > low))
        begins = F.concat(F.array(F.lit(0)), F.transform(inside, lambda c: F.least(c["stop"] - low, size)))
        ends = F.concat(F.transform(inside, lambda c: F.greatest(c["start"] - low, F.lit(0))), F.array(size))
        marks = F.concat(F.transform(inside, lambda c: F.when(c["opens"] & (c["start"] >= low), F.lit(PLACEHOLDER)).otherwise(F.lit(""))), F.array(F.lit("")))
        kept = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e"), marks.alias("m")), lambda x: F.concat(F.substring(part, x["b"] + 1, x["e"] - x["b"]), x["m"]))
        return F.array_join(kept, "")

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return _let(cuts, lambda every: F.array_join(F.transform(chunks, lambda part, i: chunk(part, i, every)), ""))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner; what it has in one language is a repository."""
    return report(scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), F.col("source")))
