"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

All of it is DataFrame functions. A text's paragraphs (lines that are not empty), each with its
occurrence number, are digested to 64-bit keys. A sketch has three tables of ``s`` cells, a power of
two; a key adds itself to one cell of each: to its count, by exclusive or to its key sum and check sum.
A sketch is kept sparse, as its cells that are not zero in order. Two texts' sketches are compared at the
size of the smaller, to which the larger one folds by taking its cells modulo that size; they subtract cell by
cell, and peeling cells that hold one key recovers the keys on either side only. Where that gets
stuck, both are sketched again at a size for all their keys, then twice as large and so on. Keys and cells are
made from sorted arrays and the places where their runs begin, so the work is a sort's, whatever a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, n_parts, null_safe, read
from .expressions import let

CELL = "struct<cell:long,n:long,k:long,c:long>"
ROUNDS, RETRIES = 40, 7


def by_runs(items: Column, key, body) -> Column:
    """``body(items, first place, length)`` of each run of equal ``key`` in an array; places from 1."""

    def runs(own: Column) -> Column:
        n = F.size(own)
        opens = F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(key(F.element_at(own, i)) != key(F.get(own, i - 2)), F.lit(True)))
        starts = F.when(n > 0, opens).otherwise(F.array().cast("array<int>"))
        return let(starts, lambda at: F.transform(at, lambda first, j: body(own, first, F.coalesce(F.get(at, j + 1), n + 1) - first)))

    return let(items, runs)


def paragraph_hashes(text: Column) -> Column:
    return F.sort_array(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.xxhash64(p)))


def keys(hashes: Column) -> Column:
    """A key for each paragraph and occurrence; equal paragraphs are next to each other in ``hashes``."""
    return F.flatten(by_runs(hashes, lambda x: x, lambda own, first, n: F.transform(F.sequence(F.lit(1), n), lambda nth: F.xxhash64(F.element_at(own, first), nth))))


def check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def cells_of(k: Column, n: Column, s: Column) -> Column:
    """The three cells of a key that is there ``n`` times."""
    c = check(k)
    return F.array(*[F.struct((F.lit(j).cast("long") * s + F.pmod(F.shiftright(k, 21 * j), s)).alias("cell"), n.alias("n"), k.alias("k"), c.alias("c")) for j in range(3)])


def fold(entries: Column) -> Column:
    """Cells by number, entries of one cell added up, without those that are zero."""
    zero = F.struct(*[F.lit(0).cast("long").alias(a) for a in ("n", "k", "c")])

    def add(acc: Column, e: Column) -> Column:
        return F.struct((acc["n"] + e["n"]).alias("n"), acc["k"].bitwiseXOR(e["k"]).alias("k"), acc["c"].bitwiseXOR(e["c"]).alias("c"))

    def total(own: Column, first: Column, n: Column) -> Column:
        one = F.element_at(own, first)
        many = let(F.aggregate(F.slice(own, first, n), zero, add), lambda t: F.struct(one["cell"].alias("cell"), t["n"].alias("n"), t["k"].alias("k"), t["c"].alias("c")))
        return F.when(n == 1, one).otherwise(many)

    return F.filter(by_runs(F.sort_array(entries), lambda e: e["cell"], total), lambda e: (e["n"] != 0) | (e["k"] != 0) | (e["c"] != 0))


def signed(k: Column, sign: int, s: Column) -> Column:
    """The cells of all keys, not yet added up."""
    return F.flatten(F.transform(k, lambda x: cells_of(x, F.lit(sign).cast("long"), s)))


def sketch(k: Column, s: Column) -> Column:
    return fold(signed(k, 1, s))


def smaller(cells: Column, s: Column, to: Column, sign: int = 1) -> Column:
    """The entries of a sketch of size ``s`` in one of size ``to``, which divides it; not yet added up."""
    at = lambda c: F.floor(c["cell"] / s).cast("long") * to + F.pmod(F.pmod(c["cell"], s), to)
    return F.transform(cells, lambda c: F.struct(at(c).alias("cell"), (c["n"] * sign).alias("n"), c["k"].alias("k"), c["c"].alias("c")))


def cells_for(n: Column) -> Column:
    """Cells of each table for n keys: a power of two, 1.5 to 3 cells a key in all."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(2.0)))).cast("int"))


def printed(cells: Column, s: Column, n: Column) -> Column:
    """A sketch as text: keys, cells of a table, and base 64 of its cells."""
    hexed = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["cell"]), 8, "0"), F.lpad(F.hex(c["n"]), 16, "0").substr(9, 8), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["c"]), 8, "0")))
    return F.concat_ws("|", n.cast("string"), s.cast("string"), F.regexp_replace(F.base64(F.unhex(F.array_join(hexed, ""))), r"\s", ""))


def sides(pure: Column) -> Column:
    """The distinct keys of cells that hold one, by the sign of their count."""

    def own(n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(pure, lambda c: c["n"] == n), lambda c: c["k"]))

    return F.struct(own(1).alias("plus"), own(-1).alias("minus"))


def peeled(difference: Column, s: Column) -> Column:
    """(plus, minus, left): keys recovered on either side, and cells that peeling left."""
    start = F.struct(difference.alias("cells"), F.lit(0).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus"), (F.size(difference) == 0).alias("over"))

    def once(state: Column) -> Column:
        def take(own: Column) -> Column:
            undo = F.concat(signed(own["plus"], -1, s), signed(own["minus"], 1, s))
            got = F.size(own["plus"]) + F.size(own["minus"])
            rest = F.when(got > 0, fold(F.concat(state["cells"], undo))).otherwise(state["cells"])
            return let(rest, lambda cells: F.struct(cells.alias("cells"), (state["plus"] + F.size(own["plus"])).alias("plus"), (state["minus"] + F.size(own["minus"])).alias("minus"), ((got == 0) | (F.size(cells) == 0)).alias("over")))

        return F.when(state["over"], state).otherwise(let(let(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == check(c["k"]))), sides), take))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: once(state))
    return let(done, lambda d: F.struct(d["plus"].alias("plus"), d["minus"].alias("minus"), F.size(d["cells"]).alias("left")))


def likeness(a: Column, a_s: Column, b: Column, b_s: Column, a_keys: Column, b_keys: Column) -> Column:
    """(ratio, tries) of two sketches a and b of sizes a_s and b_s: paragraphs that both texts have by those that
    either has (0 to 1; 1 for none), from the difference of the sketches at the smaller size; while
    peeling is stuck, of sketches made again from the keys, at a size for all of them, then twice, four times ...
    as large. ``tries`` is how many differences were peeled, 0 of equal sketches; should all sizes be
    stuck, the keys themselves are compared and it is -1."""

    def first(s: Column) -> Column:
        return let(fold(F.concat(smaller(a, a_s, s), smaller(b, b_s, s, -1))), lambda d: tried(d, s, F.lit(1)))

    def tried(difference: Column, s: Column, nth: Column) -> Column:
        return let(peeled(difference, s), lambda p: F.struct(p["plus"].alias("plus"), p["minus"].alias("minus"), p["left"].alias("left"), nth.cast("int").alias("tries")))

    def again(acc: Column, t: Column) -> Column:
        size = F.call_function("shiftleft", cells_for(F.size(a_keys) + F.size(b_keys)), t)
        return F.when(acc["left"] == 0, acc).otherwise(let(size, lambda s: let(fold(F.concat(signed(a_keys, 1, s), signed(b_keys, -1, s))), lambda d: tried(d, s, t + 2))))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES - 1)), let(F.least(a_s, b_s), first), again)

    def ratio(g: Column) -> Column:
        done = g["left"] == 0
        plus = F.when(done, g["plus"]).otherwise(F.size(F.array_except(a_keys, b_keys)).cast("long"))
        minus = F.when(done, g["minus"]).otherwise(F.size(F.array_except(b_keys, a_keys)).cast("long"))
        own = F.size(a_keys)
        value = F.when(own + minus == 0, 1.0).otherwise((own - plus) / (own + minus))
        return F.struct(value.alias("ratio"), F.when(done, g["tries"]).otherwise(-1).alias("tries"))

    same = F.struct(F.lit(1.0).alias("ratio"), F.lit(0).alias("tries"))
    return F.when((a_s == b_s) & (a == b), same).otherwise(let(found, ratio))


def successors(ids: DataFrame) -> DataFrame:
    """Adds next_id and next_h to rows of (doc_id, h): those of the row after it by falling doc_id
    (null last), then h; after the last, of the first. Rows are range-partitioned and sorted; the
    last of a partition meets the first of the next through a table of one row per partition."""
    ranged = ids.repartitionByRange(n_parts(ids.sparkSession), F.col("doc_id").desc_nulls_last(), F.col("h"))
    ranged = ranged.sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.col("h"))
    placed = cut(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    one = F.struct("doc_id", "h")
    heads = placed.groupBy("part").agg(F.min_by(one, "at").alias("head"), F.max("at").alias("tail"))
    every = W.orderBy("part")
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    inside = placed.withColumn("next", F.lead(one).over(W.partitionBy("part").orderBy("at")))
    # One row per partition of the range exchange: bounded by their number.
    out = inside.join(F.broadcast(heads.select("part", "after")), "part").withColumn("next", F.coalesce("next", "after"))
    return out.select(*ids.columns, F.col("next")["doc_id"].alias("next_id"), F.col("next")["h"].alias("next_h"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text (its last half of
    code points replaced by the beginning of the next document by falling id), with the likeness
    of the two and that to the next document.

    Null texts are empty. Rows with the same id and text are one document in the order, and each
    gets its row. Texts that differ in empty lines only have the same fingerprint. Other columns of ``docs``
    are not looked at. ``edited_tries`` and ``next_tries`` tell how often the two were sketched to peel.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = rows.select("doc_id", "h", F.floor(F.length("text") / 2).alias("need")).distinct()
    order = cut(successors(ids))
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.struct("doc_id", "h", "need").alias("by"))
    hashed = rows.withColumn("hashes", paragraph_hashes(F.col("text")))
    keyed = hashed.withColumn("keys", keys(F.col("hashes"))).drop("hashes")
    gifts = null_safe(keyed, asked, ["doc_id", "h"])
    gifts = gifts.select(F.col("by")["doc_id"].alias("doc_id"), F.col("by")["h"].alias("h"), F.substr("text", F.lit(1), F.col("by")["need"].cast("int")).alias("begin"), F.col("keys").alias("next_keys"))
    both = null_safe(keyed, gifts.dropDuplicates(["doc_id", "h"]), ["doc_id", "h"])
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("begin"))
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = both.withColumn("hashes", paragraph_hashes(F.col("edited"))).withColumn("edited_keys", keys(F.col("hashes")))
    k, e, x = F.col("keys"), F.col("edited_keys"), F.col("next_keys")
    both = both.withColumns({"s": cells_for(F.size(k)), "edited_s": cells_for(F.size(e)), "next_s": cells_for(F.size(x))})
    both = both.withColumns({"sketch": sketch(k, F.col("s")), "edited_sketch": sketch(e, F.col("edited_s")), "next_sketch": sketch(x, F.col("next_s"))})
    own, edited, following = ((F.col(c), F.col(s)) for c, s in (("sketch", "s"), ("edited_sketch", "edited_s"), ("next_sketch", "next_s")))
    both = both.withColumns({"to_edited": likeness(*own, *edited, k, e), "to_next": likeness(*own, *following, k, x)})
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(*own, F.size(k)).alias("fingerprint"),
        printed(*edited, F.size(e)).alias("edited_fingerprint"),
        F.col("to_edited")["ratio"].alias("near_edited"),
        F.col("to_next")["ratio"].alias("near_next"),
        F.col("to_edited")["tries"].alias("edited_tries"),
        F.col("to_next")["tries"].alias("next_tries"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents", "doc_id", "text"))
