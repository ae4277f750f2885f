"""Spelling variant grouping by a relational trie frontier (operator 12).

The words are kept as two tries, of the words and of the words read backwards, in an edge table: a node is a prefix, and
has one row with its letters, and for each letter what lies beyond: one word or more, the next letters and the numbers
of letters left (as bit sets). A frontier of states (word, path, depth, edits) is joined with the edge table level by
level. A state without edits stands at a prefix of its word and puts out states of one edit (another letter, one letter
more, one less), whose path is then fixed; a state with one edit goes on only where its path is in the trie. States that
come to a word's end, or to an edge behind which there is one word, meet the words and become neighbours.

One edit leaves the first half of a word or its second half as it is, so the forward trie takes the edits behind the
middle and the backward trie those before; frontiers start at the middle, where tries are sparse, and each pair comes
from one trie alone. Edits are made where word and path first differ, so each pair comes up once.

Words of more than ``LONG`` letters would make deep tries: there the words without one letter each are hashed, and
words that share such a remainder are compared.

Defined cases: null text has no words, null ids count as the empty text before the colon; all rows count, equal ones
too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import HOT_ROWS, HOT_SHARE, materialize, stream, table

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST, TIMES, LONG = 7, 10, 64
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """word: every run of at least so many letters of every text, A-Z in lower case."""
    found = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(found).alias("run")).select("doc_id", F.translate("run", *_LOWER).alias("word"))


def misspelt(words: DataFrame, every: int = 31) -> DataFrame:
    """words (doc_id, word), of which those whose h = crc32("<doc_id>:<word>") ``every`` divides lose code point
    h % length."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.when(F.col("h") % every == 0, F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))).otherwise(F.col("word"))
    return words.withColumn("h", h).select("doc_id", cut.alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST, often: int = 2) -> DataFrame:
    """word, n: the words of at least ``least`` letters that occur ``often`` times or more."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _next_bit(text: Column, at: Column) -> Column:
    """A bit, of 64, for the two letters from ``at`` on."""
    return _bit(F.pmod(F.hash(F.substring(text, at, F.lit(2))), F.lit(64)))


def _left_bit(n: Column) -> Column:
    return _bit(F.least(n, F.lit(63)))


def _rest(text: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(text, at, F.lit(2 * LONG)))


def _middle(length: Column) -> Column:
    """How many letters the trie takes as they are: the greater half forwards, the smaller backwards."""
    return F.floor((length + F.when(F.col("backward"), 0).otherwise(1)) / 2).cast("int")


def edge_table(words: DataFrame) -> DataFrame:
    """backward, node, depth, edges: one row for each prefix that more than one word has. words has backward and path, the
    word as that trie reads it; a word has nodes from where the frontier of a word a letter shorter begins."""
    size, path, at = F.char_length("path"), F.col("path"), F.col("depth") + 1
    rows = words.select("backward", "path", F.explode(F.sequence(_middle(size - 1), size)).alias("depth")).select(
        "backward", F.substring(path, F.lit(1), F.col("depth")).alias("node"), F.substring(path, at, F.lit(1)).alias("letter"),
        _rest(path, at + 1).alias("rest"), _next_bit(path, at + 1).alias("next"), _left_bit(size - F.col("depth")).alias("left"),
    )
    edges = rows.groupBy("backward", "node", "letter").agg(F.count("*").alias("n"), F.min("rest").alias("rest"), F.expr("bit_or(next)").alias("next"), F.expr("bit_or(left)").alias("left"))
    edge = F.struct("letter", (F.col("n") > 1).alias("many"), "rest", "next", "left")
    nodes = edges.groupBy("backward", "node").agg(F.sum("n").alias("n"), F.collect_list(edge).alias("edges")).where("n > 1")
    return nodes.select("backward", "node", F.char_length("node").alias("depth"), "edges")


#: What a state knows of the text behind the next letter of its path: of one that changes the letter (or goes on), puts
#: one in, or leaves its own out. Computed once for each state.
_KINDS = ("same", "more", "less")


def _with_behind(states: DataFrame) -> DataFrame:
    """states with own (the next letter), behind, and, for each kind, the bits and the hash that its edges must have."""
    path, depth = F.col("path"), F.col("depth")
    cut = states.withColumns({"before": F.substring(path, F.lit(1), depth), "own": F.substring(path, depth + 1, F.lit(1)), "behind": F.substring(path, depth + 2, F.lit(2 * LONG)), "size": F.char_length("path") - depth})
    texts = {"same": F.col("behind"), "more": F.concat("own", "behind"), "less": F.substring(F.col("behind"), F.lit(2), F.lit(2 * LONG))}
    sizes = {"same": F.col("size"), "more": F.col("size") + 1, "less": F.greatest(F.col("size") - 1, F.lit(0))}
    facts = {f"{k}_{name}": value for k in _KINDS for name, value in (("left", _left_bit(sizes[k])), ("next", _next_bit(texts[k], F.lit(1))), ("rest", _rest(texts[k], F.lit(1))))}
    return cut.withColumns(facts)


def _fits(e: Column, kind: str) -> Column:
    """Whether a word may lie behind the edge that goes on as that kind of state does."""
    beyond = F.when(e["many"], e["next"].bitwiseAND(F.col(f"{kind}_next")) != 0).otherwise(e["rest"] == F.col(f"{kind}_rest"))
    return (e["left"].bitwiseAND(F.col(f"{kind}_left")) != 0) & beyond


def _steps() -> Column:
    """The states (path, edits, many) that the edges of a state's node lead to; many is false where one word is behind."""
    path, edges, before, own, behind = (F.col(c) for c in ("path", "edges", "before", "own", "behind"))

    def states(test, new, edits: int) -> Column:  # noqa: ANN001
        return F.transform(F.filter(edges, test), lambda e: F.struct(new(e).alias("path"), F.lit(edits).alias("edits"), e["many"].alias("many")))

    other = lambda e: (e["letter"] != own) & (e["letter"] != "")
    longer = states(lambda e: other(e) & _fits(e, "more"), lambda e: F.concat(before, e["letter"], own, behind), 1)
    changed = states(lambda e: other(e) & _fits(e, "same"), lambda e: F.concat(before, e["letter"], behind), 1)
    next_letter = F.substring(behind, F.lit(1), F.lit(1))
    shorter = states(lambda e: (e["letter"] == next_letter) & (e["letter"] != own) & _fits(e, "less"), lambda e: F.concat(before, behind), 1)
    same = states(lambda e: (e["letter"] == own) & e["many"], lambda e: path, 0)
    on = states(lambda e: (e["letter"] == own) & _fits(e, "same"), lambda e: path, 1)
    return F.when(F.col("edits") > 0, on).when(own != "", F.concat(same, changed, longer, shorter)).otherwise(longer)


def _at_nodes(states: DataFrame, nodes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """states with the edges of their nodes. Up to HOT_ROWS states are broadcast, so that the last levels shuffle nothing;
    of more, the nodes at which more than HOT_ROWS and one in HOT_SHARE stand, HOT_SHARE at most, are."""
    if total <= HOT_ROWS:
        return nodes.join(F.broadcast(states), keys)
    often = states.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select(*keys)
    often = materialize(often, "common-nodes")
    if often.isEmpty():
        return states.join(nodes, keys)
    few = F.broadcast(nodes.join(F.broadcast(often), keys))
    return states.join(few, keys).unionByName(states.join(F.broadcast(often), keys, "left_anti").join(nodes, keys))


def trie_neighbours(words: DataFrame) -> DataFrame:
    """word, near: every pair of words (word, n) of at most LONG letters that one edit parts, in both orders."""
    two = F.explode(F.array(F.struct(F.lit(False).alias("backward"), F.col("word").alias("path")), F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("path"))))
    both = words.where(F.char_length("word") <= LONG).select("word", two.alias("t")).select("word", "t.backward", "t.path")
    nodes = materialize(edge_table(both), "edges")
    states = both.select("word", "backward", "path", _middle(F.char_length("path")).alias("depth"), F.lit(0).alias("edits"))
    states, ended, least, keys = materialize(states, "frontier"), [], (LEAST - 1) // 2, ["backward", "node"]
    while total := states.count():
        keyed = states.withColumn("node", F.substring(F.col("path"), F.lit(1), F.col("depth")))
        facts = nodes.where(F.col("depth") >= least).drop("depth")  # each level is a letter deeper
        made = _with_behind(_at_nodes(keyed, facts, keys, total)).select("word", "backward", "depth", F.explode(_steps()).alias("s"))
        made = materialize(made.select("word", "backward", "s.path", (F.col("depth") + 1).alias("depth"), "s.edits", "s.many"), "frontier")
        ended.append(made.where(~F.col("many")).select("word", "backward", "path"))
        states, least = made.where("many").drop("many"), least + 1
    found = reduce(DataFrame.unionAll, ended) if ended else states.select("word", "backward", "path")
    near = F.when(F.col("backward"), F.reverse("path")).otherwise(F.col("path"))
    half = F.floor((F.char_length("word") + 1) / 2).cast("int")
    once = ~F.col("backward") | (F.substring(F.col("word"), F.lit(1), half) != F.substring(F.col("near"), F.lit(1), half))
    return found.select("word", "backward", near.alias("near")).where(once).select("word", "near")


_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


def _remainders(word: str) -> tuple[list[int], int]:
    """Hashes of the word without each of its letters, and of the whole word."""
    back, ahead, power, inverse = 0, 0, 1, pow(_BASE, -1, _PRIME)
    codes = [int(x >> 3) for x in stream(31, 256)]
    for c in word:
        ahead, power = (ahead + codes[ord(c) & 255] * power) % _PRIME, power * _BASE % _PRIME
    whole, power, out = ahead, 1, []
    for c in word:
        own = codes[ord(c) & 255] * power % _PRIME
        ahead = (ahead - own) % _PRIME
        out.append((back + ahead * inverse) % _PRIME)
        back, power = (back + own) % _PRIME, power * _BASE % _PRIME
    return out, whole


def long_neighbours(words: DataFrame) -> DataFrame:
    """word, near: the pairs of which one word at least has more than LONG letters."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column(0).to_pylist():
                less, whole = _remainders(word)
                n = len(less)
                columns = [pa.array([whole] * (n + 1), pa.int64()), pa.array([n] * (n + 1), pa.int32()), pa.array([*less, whole], pa.int64()), pa.array([*range(n), -1], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "hash", "place"])

    rows = words.where(F.char_length("word") >= LONG).select("word")
    keys = materialize(rows.mapInArrow(hashed, "id long, size int, hash long, place int"), "remainders")
    named = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([_remainders(w)[1] for w in b.column(0).to_pylist()], pa.int64())], names=["word", "id"]) for b in batches), "word string, id long")
    less, whole = keys.where("place >= 0"), keys.where("place < 0")
    other = less.select(F.col("id").alias("near_id"), "size", "hash", "place")
    changed = less.join(other, ["size", "hash", "place"]).where("id <> near_id").select("id", "near_id")
    shorter = less.select("id", (F.col("size") - 1).alias("size"), "hash").join(whole.select(F.col("id").alias("near_id"), "size", "hash"), ["size", "hash"]).select("id", "near_id")
    pairs = changed.union(shorter).union(shorter.select("near_id", "id")).distinct()
    met = pairs.join(named, "id").join(named.select(F.col("word").alias("near"), F.col("id").alias("near_id")), "near_id")
    longest = F.greatest(F.char_length("word"), F.char_length("near"))
    return met.where((longest > LONG) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every word with every word that one inserted, deleted or replaced code point makes of it."""
    pairs = trie_neighbours(words)
    if words.where(F.char_length("word") > LONG).count():
        pairs = pairs.unionAll(long_neighbours(words))
    return pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n. words has word and n, each word once."""
    words = materialize(words, "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    fine = -F.col("best.n") >= times * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fine, F.col("best.near")).alias("form"), F.when(fine, -F.col("best.n")).alias("form_n")
    )
    formed = materialize(formed, "formed")
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. A form occurs ten times as often as its word, so chains are short; each
    round doubles the way that every word has gone."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not jumped.where("moved").count():
            return jumped.select("word", "root")
        steps = jumped.drop("moved")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts with their near words and forms; every 31st occurrence, by its hash, is misspelt."""
    return variants(vocabulary(misspelt(letter_runs(table(spark, sf_dir, "documents")))))
