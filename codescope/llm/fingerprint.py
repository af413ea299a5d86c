"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs (long ones in parts that end with a sentence) are hashed to
digests. A sketch has three subtables of cells; each digest is added to one cell
of each: a count, the XOR of digests and the XOR of their check values. The
sketches of two versions are subtracted cell by cell, which leaves the digests
that differ, and peeling recovers them: a cell that holds one digest names it,
and taking it out of its other cells frees more. Where peeling gets stuck, both
texts get larger sketches, split into blocks by digest, until it succeeds.

Everything happens inside a row with array functions, so digests are never
shuffled; the texts are, once, to stand next to their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Cells in each of the three subtables of a fingerprint.
CELLS = 8
#: Digests per block of a larger sketch, and its first cells per subtable.
BLOCK_ITEMS = 20
BLOCK_CELLS = 16
ROUNDS = 6
#: A paragraph, or a part of one: to the first end of a sentence after 60 characters, 200 at most.
PARAGRAPH = r"[^\n]{60,200}?[.!?]+(?=\s)|[^\n]{1,200}"
NO_ID = -(2**63)
#: Ranges of doc_id follow the shuffle partitions, up to so many.
MOST_BUCKETS = 1 << 16


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not wherever it is named."""
    return F.transform(F.array(value), use)[0]


def check(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(1000 + seed))


def places(key: Column, width: int, seed: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(seed))
    return [F.pmod(F.shiftright(h, 21 * i), F.lit(width)).cast("int") for i in range(3)]


def sketch(keys: Column, width: int, seed: int = 0) -> Column:
    """Cells (n, k, c) of all three subtables in a row."""
    units = F.transform(keys, lambda k: F.struct(k.alias("k"), check(k, seed).alias("c"), *[p.alias(f"p{i}") for i, p in enumerate(places(k, width, seed))]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def add(a: Column, u: Column) -> Column:
        return F.struct((a["n"] + 1).alias("n"), a["k"].bitwiseXOR(u["k"]).alias("k"), a["c"].bitwiseXOR(u["c"]).alias("c"))

    def table(units: Column, i: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda at: F.aggregate(F.filter(units, lambda u: u[f"p{i}"] == at), zero, add))

    return let(units, lambda u: F.concat(table(u, 0), table(u, 1), table(u, 2)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peeled(cells: Column, width: int, seed: int = 0) -> Column:
    """Struct of ``got`` (array of n: 1 only in a, -1 only in b; k: digest) and ``ok``."""
    none = F.array().cast("array<struct<n:int,k:bigint,c:bigint>>")

    def taken(cells: Column, placed: Column) -> Column:
        def less(x: Column, at: Column) -> Column:
            here = F.filter(placed, lambda p: (p["p0"] == at) | (p["p1"] == at) | (p["p2"] == at))
            return F.aggregate(here, x, lambda c, p: F.struct((c["n"] - p["n"]).alias("n"), c["k"].bitwiseXOR(p["k"]).alias("k"), c["c"].bitwiseXOR(p["c"]).alias("c")))

        return F.transform(cells, less)

    def step(state: Column, turn: Column) -> Column:
        # subtables take turns, so that no digest is found in two cells at once
        mine = F.pmod(turn, F.lit(3)).cast("int")
        pure = F.filter(F.slice(state["t"], mine * width + 1, F.lit(width)), lambda x: (F.abs(x["n"]) == 1) & (check(x["k"], seed) == x["c"]))
        placed = F.transform(pure, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k"), p["c"].alias("c"), *[(q + i * width).alias(f"p{i}") for i, q in enumerate(places(p["k"], width, seed))]))

        def moved(placed: Column) -> Column:
            found = F.transform(placed, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k"), p["c"].alias("c")))
            return F.when(F.size(placed) > 0, F.struct(taken(state["t"], placed).alias("t"), F.concat(state["got"], found).alias("got"))).otherwise(state)

        return let(placed, moved)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(3 * ROUNDS - 1)), F.struct(cells.alias("t"), none.alias("got")), step)
    return let(end, lambda s: F.struct(s["got"].alias("got"), F.forall(s["t"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)).alias("ok")))


def as_text(cells: Column) -> Column:
    """A sketch as hexadecimal text: per cell two digits of the count, sixteen of the digests, eight of the checks."""
    hexed = F.transform(cells, lambda x: F.concat(F.lpad(F.hex(F.pmod(x["n"], F.lit(256))), 2, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.substring(F.lpad(F.hex(x["c"]), 16, "0"), 9, 8)))
    return F.lower(F.array_join(hexed, ""))


def counted(peel: Column) -> Column:
    return let(peel, lambda p: F.struct(p["ok"].alias("ok"), F.size(F.filter(p["got"], lambda x: x["n"] > 0)).alias("a"), F.size(F.filter(p["got"], lambda x: x["n"] < 0)).alias("b")))


def differences(pairs: DataFrame) -> DataFrame:
    """``id``, ``a`` and ``b``: how many digests only one side has, for ``pairs(id, x, y)`` of digest arrays.

    Larger and larger sketches, until all pairs are peeled.
    """
    width, seed, done = BLOCK_CELLS, 1, None
    rows = pairs
    while True:
        blocks = F.greatest(F.lit(1), F.ceil((F.size("x") + F.size("y")) / BLOCK_ITEMS)).cast("int")
        # a long text's blocks are dealt in two steps, so that its digests aren't read once for each block
        wide = F.when(blocks <= 16, blocks).otherwise(F.ceil(F.sqrt(blocks.cast("double")))).cast("int")
        parts = rows.select("id", "x", "y", blocks.alias("m"), wide.alias("w"))
        parts = parts.withColumn("group", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / F.col("w")).cast("int"))))
        place = lambda k: F.pmod(F.xxhash64(k, F.lit(500 + seed)), F.col("m"))  # noqa: B023, E731
        some = [F.when(F.col("m") == F.col("w"), F.col(c)).otherwise(F.filter(c, lambda k: F.floor(place(k) / F.col("w")) == F.col("group"))).alias(c) for c in ("x", "y")]
        last = F.least(F.col("m"), (F.col("group") + 1) * F.col("w")) - 1
        parts = parts.select("id", "m", *some, F.explode(F.sequence(F.col("group") * F.col("w"), last)).alias("at"))
        parts = parts.select("id", *[F.filter(c, lambda k: place(k) == F.col("at")).alias(c) for c in ("x", "y")])
        parts = parts.select("id", counted(peeled(subtracted(sketch(F.col("x"), width, seed), sketch(F.col("y"), width, seed)), width, seed)).alias("r"))
        found = common.materialize(parts.groupBy("id").agg(F.min("r.ok").alias("ok"), F.sum("r.a").alias("a"), F.sum("r.b").alias("b")))
        good = found.filter("ok").select("id", "a", "b")
        done = good if done is None else done.union(good)
        stuck = found.filter("not ok").select("id")
        if stuck.isEmpty():
            return done
        if width > 1 << 12:
            raise RuntimeError("sketches don't peel")
        rows = common.materialize(rows.join(stuck.hint("merge"), "id", "left_semi"))
        width, seed = width * 2, seed + 1


def neighbours(docs: DataFrame) -> DataFrame:
    """Each text beside the next document's: id, doc_id, text, next_text.

    Documents are in order of doc_id, null first, and of text; the last one's
    next is the first. They are dealt by quantiles of doc_id, and the first of
    each range also goes to the range before it.
    """
    spark = docs.sparkSession
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("key"), common.text_or_empty(docs).alias("text"))
    parts = min(MOST_BUCKETS, max(4, 4 * common.shuffle_parts(spark)))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(parts)], max(20_000, 8 * parts))).first()[0]
    cuts = sorted(set(cuts or [0]))
    many = len(cuts)
    wide = max(1, int(many**0.5))
    bounds, coarse = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (cuts, cuts[::wide]))  # folded to one literal each
    above = (F.size(F.filter(coarse, lambda b: b <= F.col("key"))) - 1) * wide
    bucket = above + F.size(F.filter(F.slice(bounds, above + 1, F.lit(wide)), lambda b: b <= F.col("key"))) - 1
    rows = rows.withColumn("bucket", bucket)
    first = F.col("key") == F.element_at(bounds, F.col("bucket") + 1)
    own = F.struct("bucket", F.lit(0).alias("ghost"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(many)).alias("bucket"), F.lit(1).alias("ghost"))
    rows = rows.select("key", "text", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("p"))
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "text")
    rows = rows.select("key", "text", "p.bucket", "p.ghost")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "nth": F.row_number().over(order)}).filter("ghost = 0")
    return rows.select((F.col("bucket").cast("long") * (1 << 40) + F.col("nth")).alias("id"), F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "text", "next_text")


def likeness(size: Column, only_a: Column, only_b: Column) -> Column:
    """Shared digests over all digests; two texts without any are alike."""
    both = size + only_b
    return F.when(both == 0, F.lit(1.0)).otherwise((size - only_a) / both)


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, its edited text and the next one, and their likeness.

    Null texts are empty, and have no digests. Rows with one doc_id are rows of
    their own. Extra columns are left out; an empty table gives no rows.
    """
    n, q = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = neighbours(docs).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - q), F.col("next_text").substr(F.lit(1), q)))
    rows = rows.select("id", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("u"), digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("v"))
    rows = common.materialize(rows)
    own, edited, after = (sketch(F.col(c), CELLS) for c in "uev")
    keep = ["id", "doc_id", "n_chars", "edited_sha256", "u", "e", "v"]
    tables = rows.select(*keep, own.alias("su"), edited.alias("se"), after.alias("sv"))
    tried = common.materialize(tables.select(*keep, counted(peeled(subtracted(F.col("su"), F.col("se")), CELLS)).alias("re"), counted(peeled(subtracted(F.col("su"), F.col("sv")), CELLS)).alias("rv")))
    common.discard(rows)
    sides = [F.struct((F.col("id") * 2 + i).alias("id"), F.col(y).alias("y"), F.col(r).alias("r")) for i, (y, r) in enumerate((("e", "re"), ("v", "rv")))]
    again = tried.select("u", F.explode(F.array(*sides)).alias("p")).filter("not p.r.ok").select("p.id", F.col("u").alias("x"), "p.y")
    # peeling is the work here: many small parts, whatever the size of a file
    more = differences(common.materialize(again.repartition(4 * common.shuffle_parts(docs.sparkSession), "id")))
    flat = tried.select(F.explode(F.array(F.struct((F.col("id") * 2).alias("id"), F.col("re").alias("r")), F.struct((F.col("id") * 2 + 1).alias("id"), F.col("rv").alias("r")))).alias("p"))
    every = flat.filter("p.r.ok").select("p.id", F.col("p.r.a").cast("long").alias("a"), F.col("p.r.b").cast("long").alias("b")).union(more)
    odd = F.pmod(F.col("id"), F.lit(2)) == 1
    wide = every.groupBy(F.floor(F.col("id") / 2).cast("long").alias("id")).agg(*[F.max(F.when(odd if s == "v" else ~odd, F.col(c))).alias(c + s) for s in "ev" for c in "ab"])
    out = tried.drop("v", "re", "rv").join(wide.hint("merge"), "id").withColumn("size", F.size("u"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(sketch(F.col("u"), CELLS)).alias("fingerprint"), as_text(sketch(F.col("e"), CELLS)).alias("edited_fingerprint"),
        likeness(F.col("size"), F.col("ae"), F.col("be")).alias("near_edited"), likeness(F.col("size"), F.col("av"), F.col("bv")).alias("near_next"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(common.table(spark, sf_dir, "documents"))
