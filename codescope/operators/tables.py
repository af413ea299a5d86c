"""Metric operators over any rows: clusters, densities, churn, joins, graphs."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from codescope import functions as fn
from codescope import shared


def clusters(df: DataFrame, key: str, member: str, least: int = 2) -> DataFrame:
    """Groups of rows with one fingerprint: size and first member."""
    return df.groupBy(key).agg(F.count("*").alias("size"), F.min(member).alias("first_member")).filter(F.col("size") >= least)


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a costly value that is computed once a row, not wherever it is named: a generator is no projection to merge."""
    return df.withColumn(name, F.explode(F.array(value)))


def halstead(df: DataFrame, operators: Column, operands: Column, keys: list[str]) -> DataFrame:
    """Halstead counts and measures from arrays of operator and operand tokens, row by row."""
    raw = once(df, F.struct(operators.alias("o"), operands.alias("d")), "_t").select(*keys, F.col("_t.o").alias("_o"), F.col("_t.d").alias("_d"))
    n1, n2 = F.size(F.array_distinct("_o")).cast("long"), F.size(F.array_distinct("_d")).cast("long")
    counts = raw.select(*keys, n1.alias("n1"), n2.alias("n2"), F.size("_o").cast("long").alias("total_operators"), F.size("_d").cast("long").alias("total_operands"))
    vocabulary, length = F.col("n1") + F.col("n2"), F.col("total_operators") + F.col("total_operands")
    v, d = fn.volume(vocabulary, length), fn.difficulty(F.col("n1"), F.col("n2"), F.col("total_operands"))
    return counts.withColumns({"vocabulary": vocabulary, "length": length, "volume": v, "difficulty": d, "effort": v * d})


def churn(df: DataFrame, entity: str, added: Column, deleted: Column, when: str) -> DataFrame:
    return df.groupBy(entity).agg(F.sum(added).alias("insertions"), F.sum(deleted).alias("deletions"), F.count("*").alias("commit_count"), F.min(when).alias("first_seen"), F.max(when).alias("last_seen"))


def hotspot_join(complexity: DataFrame, churned: DataFrame, key: str, min_commits: int) -> DataFrame:
    """Full outer join of complexity and churn, with the reason why a row is out (null if it is in)."""
    both = complexity.join(churned, key, "full_outer")
    reason = F.when(F.col("commit_count").isNull(), "no_churn").when(F.col("sum_ccx").isNull(), "no_functions").when(F.col("commit_count") < min_commits, "below_min_commits")
    return both.withColumn("reject", reason)


def quadrants(df: DataFrame, x: str, y: str, least: int = 8, share: float = 0.75) -> DataFrame:
    """High or low on two axes, by nearest-rank percentiles; cutoffs are one broadcast row."""
    cut = df.agg(F.expr(f"percentile_disc({share}) within group (order by {x})").alias("cut_x"), F.expr(f"percentile_disc({share}) within group (order by {y})").alias("cut_y"), F.count("*").alias("_n"))
    hi_x, hi_y = F.col(x) >= F.col("cut_x"), F.col(y) >= F.col("cut_y")
    name = F.when(F.col("_n") < least, "insufficient_data").when(hi_x & hi_y, "hotspot").when(hi_x, "stable_complex").when(hi_y, "churning_simple").otherwise("calm")
    return df.crossJoin(F.broadcast(cut)).withColumn("quadrant", name).drop("cut_x", "cut_y", "_n")


def cluster_report(members: DataFrame, key: str, member: str, least: int, limit: float) -> DataFrame:
    """One row for each cluster of ``least`` members and, if the share of all rows that have a twin is over ``limit``, one for the share.

    Rows with a null key are compared with nothing, and count among all rows.
    Columns: kind (cluster or density), first_member, value, threshold.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("size"), F.min(member).alias("first_member"))
    rows = sizes.filter((F.col("size") >= least) & F.col(key).isNotNull()).select(F.lit("cluster").alias("kind"), "first_member", F.col("size").cast("double").alias("value"), F.lit(float(least)).alias("threshold"))
    share = sizes.agg(F.try_divide(F.sum(F.when((F.col("size") >= 2) & F.col(key).isNotNull(), F.col("size")).otherwise(0)), F.sum("size")).alias("value"))
    density = share.filter(F.col("value") > limit).select(F.lit("density").alias("kind"), F.lit(None).cast(dict(members.dtypes)[member]).alias("first_member"), F.round("value", 6).alias("value"), F.lit(float(limit)).alias("threshold"))
    return density.unionByName(rows)


def histogram(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of all values, zero where there are none."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(every).join(df.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, point_id: str, span_id: str) -> DataFrame:
    """Each point with the shortest span of its key that covers it; of equal spans the smaller id.

    The best span is an aggregate, combined before the shuffle, not a sort.
    """
    cover = points.join(spans, (points[key] == spans[key]) & points[at].between(spans[start], spans[end])).drop(spans[key])
    return cover.groupBy(point_id).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("width"), F.col(span_id).alias("span"))).alias("b")).select(point_id, F.col("b.span").alias(span_id))


def sibling_overlap(uses: DataFrame, group: str, unit: str, item: str, min_shared: int, min_score: float) -> DataFrame:
    """Pairs of units of one group that share ``min_shared`` items and a score of shared items by the larger unit's.

    Only prefixes meet: with its items from the rarest to the most common in the
    group, a unit that must share k of n has one of its first n - k + 1 in common
    with any partner. Common items stand last and rarely make a pair; units too
    small to share enough, or of too different sizes, make none. What meets is
    counted in full.
    """
    uses = uses.select(group, unit, item).distinct()
    often = uses.groupBy(group, item).agg(F.count("*").alias("_n"))
    sets = uses.join(often.hint("merge"), [group, item]).groupBy(group, unit).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", item))), lambda x: x[item]).alias("_items")).withColumn("_size", F.size("_items"))
    least = max(0.0, min_score - 0.0005)  # scores are rounded to three places
    need = F.greatest(F.lit(min_shared), F.lit(1), F.ceil(F.col("_size") * least))
    sets = sets.filter(F.col("_size") >= min_shared)
    heads = sets.select(group, unit, "_size", F.explode(F.slice("_items", F.lit(1), F.greatest(F.lit(1), F.col("_size") - need + 1).cast("int"))).alias("_i"))
    of = lambda df, side, *more: df.select(group, F.col(unit).alias(f"unit_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in more])
    a, b = of(heads, "a", "_size", "_i").withColumnRenamed("_i_a", "_i"), of(heads, "b", "_size", "_i").withColumnRenamed("_i_b", "_i")
    alike = F.least("_size_a", "_size_b") >= F.greatest("_size_a", "_size_b") * least
    pairs = a.join(b.hint("merge"), [group, "_i"]).filter((F.col("unit_a") < F.col("unit_b")) & alike).select(group, "unit_a", "unit_b").distinct()
    for side in "ab":
        pairs = pairs.join(of(sets, side, "_items", "_size").hint("merge"), [group, f"unit_{side}"])
    shared = F.size(F.array_intersect("_items_a", "_items_b")).cast("long")
    score = F.round(F.col("shared") / F.greatest("_size_a", "_size_b"), 3)
    out = pairs.withColumn("shared", shared).withColumn("score", score).filter((F.col("shared") >= min_shared) & (F.col("score") >= min_score))
    return out.select(group, "unit_a", "unit_b", "shared", "score")


def merged(df: DataFrame, group: list[str], place: list[str], sums: list[str], most: list[str], unions: list[str], first: list[str]) -> DataFrame:
    """One row for each group of declarations: sums, largest values, arrays without repeats in the order of ``place``, and ``first`` of the first one.

    What a union gathers is its distinct values only, each with its first place.
    Nulls add nothing; a group without values has an empty array. Rows of one
    place count in the order of the other columns named in ``first``.
    """
    at = F.struct(*place, *[c for c in first if c not in place])
    out = df.groupBy(*group).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most], F.min(at).alias("_first"))
    out = out.select(*group, *sums, *most, *[F.col(f"_first.{c}").alias(c) for c in dict.fromkeys([*place, *first]) if c not in group])
    for c in unions:
        values = df.select(*group, F.struct(*place).alias("_p"), F.posexplode(c).alias("_i", "_v")).filter("_v is not null")
        values = values.groupBy(*group, "_v").agg(F.min(F.struct("_p", "_i")).alias("_o"))
        values = values.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias(c))
        same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
        out = out.alias("l").join(values.alias("r"), same, "left").select("l.*", F.coalesce(f"r.{c}", F.array().cast(df.schema[c].dataType)).alias(c))
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """Ca, Ce and instability of each node of distinct edges(src, dst)."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    both = out.join(into, "node", "full_outer").select("node", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return both.withColumn("instability", fn.instability(F.col("ca"), F.col("ce")))


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node`` and ``component`` (smallest member) of strongly connected components of two or more nodes.

    Every round makes the graph smaller: nodes without an edge in or out go;
    nodes with one edge in and one out are taken out of their chains, whose ends
    are found by doubling, so a chain takes rounds as its length's logarithm and a
    ring is settled by them; only where neither is left are components settled
    by colours: each node gets the smallest of the hashed names that reach it, and
    the nodes of a colour that reach its root are a component. There are as many
    roots a round as colours, and hashed names cut a line of components anywhere,
    not at its end. Then the chains come back, last ones first: they belong to
    the component of their ends, if that is one.

    Every round is written to the shared checkpoint folder, so lost executors
    cost no more than the round. No join is a broadcast, for each would take a
    part of the graph through the driver. Rounds go on until no edge is left;
    more than ``most`` rounds of colours, if given, are an error.
    """
    live = shared.written(edges.select("src", "dst").filter("src <> dst").distinct())
    levels: list[DataFrame] = []
    kind = edges.schema["src"].dataType
    found = edges.sparkSession.createDataFrame([], StructType().add("n", kind).add("c", kind))
    size, coloured = live.count(), 0
    while size:
        both = live.select(F.col("src").alias("n")).distinct().hint("merge").join(live.select(F.col("dst").alias("n")).distinct(), "n", "left_semi")
        live = shared.written(live.hint("merge").join(both.withColumnRenamed("n", "src"), "src", "left_semi").hint("merge").join(both.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"))
        before, size = size, live.count()
        if not size:
            break
        chains = _chains(live)
        if chains is not None:
            rings, inside = chains.filter("open").select(F.col("u").alias("n"), F.col("m").alias("c")), chains.filter("not open").select("u", "w", "v")
            found = found.union(rings)
            levels.append(inside)
            gone = chains.select("u")
            rest = live.hint("merge").join(gone.withColumnRenamed("u", "src"), "src", "left_anti").hint("merge").join(gone.withColumnRenamed("u", "dst"), "dst", "left_anti").select("src", "dst")
            live = shared.written(rest.union(inside.filter("w <> v").select("w", "v")).distinct())
            size = live.count()
        elif size == before:
            if coloured == most:
                raise RuntimeError("cycles didn't settle")
            coloured += 1
            nodes = shared.written(live.select(F.col("src").alias("n")).union(live.select("dst")).distinct().select("n", F.struct(F.xxhash64("n").alias("h"), F.col("n").alias("n")).alias("l")))
            colour = _spread(live, nodes)
            of = lambda side: colour.select(F.col("n").alias(side), F.col("l").alias(f"l_{side}"))  # noqa: B023, E731
            inner = shared.written(live.hint("merge").join(of("src"), "src").hint("merge").join(of("dst"), "dst").filter("l_src = l_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            back = _spread(inner, nodes).withColumnRenamed("l", "back")
            settled = shared.written(colour.hint("merge").join(back, "n").filter("l = back").select("n", F.col("l.n").alias("c")))
            found = found.union(settled)
            gone = settled.select("n")
            live = shared.written(live.hint("merge").join(gone.withColumnRenamed("n", "src"), "src", "left_anti").hint("merge").join(gone.withColumnRenamed("n", "dst"), "dst", "left_anti").select("src", "dst"))
            size = live.count()
    for inside in reversed(levels):
        ends = inside.hint("merge").join(found.select(F.col("n").alias("w"), F.col("c").alias("cw")), "w", "left").hint("merge").join(found.select(F.col("n").alias("v"), F.col("c").alias("cv")), "v", "left")
        held = shared.written(ends.select("u", "w", "cw", F.when(F.col("w") == F.col("v"), F.coalesce("cw", "w")).when(F.col("cw") == F.col("cv"), F.col("cw")).alias("c")).filter("c is not null"))
        # a chain that comes back to where it began makes a component of its end, too
        ring = held.filter("cw is null").select(F.col("w").alias("n"), "c").distinct()
        found = shared.written(found.union(held.select("u", "c")).union(ring))
    names = found.groupBy("c").agg(F.min("n").alias("component"), F.count("*").alias("size")).filter("size > 1")
    return found.hint("merge").join(names, "c").select(F.col("n").alias("node"), "component")


def _chains(live: DataFrame) -> DataFrame | None:
    """``u, w, v, m, open`` for nodes with one edge in and one out: the ends of the chain before and after; ``open`` on rings without ends, whose smallest node is m."""
    out = live.groupBy(F.col("src").alias("u")).agg(F.count("*").alias("o"), F.min("dst").alias("v")).filter("o = 1")
    into = live.groupBy(F.col("dst").alias("u")).agg(F.count("*").alias("i"), F.min("src").alias("w")).filter("i = 1")
    mids = shared.written(out.hint("merge").join(into, "u").select("u", "w", "v"))
    count = mids.count()
    if not count:
        return None
    own = mids.select("u")
    walk = mids.hint("merge").join(own.select(F.col("u").alias("v"), F.lit(True).alias("go_v")), "v", "left").hint("merge").join(own.select(F.col("u").alias("w"), F.lit(True).alias("go_w")), "w", "left")
    walk = shared.written(walk.select("u", "w", "v", F.col("u").alias("m"), F.coalesce("go_v", F.lit(False)).alias("go_v"), F.coalesce("go_w", F.lit(False)).alias("go_w")))
    for _ in range(count.bit_length() + 1):
        if walk.filter("go_v or go_w").isEmpty():
            break
        # what has come to an end joins nothing, under its own name
        rows = walk.withColumns({"kv": F.when(F.col("go_v"), F.col("v")).otherwise(F.col("u")), "kw": F.when(F.col("go_w"), F.col("w")).otherwise(F.col("u"))})
        ahead = walk.select(F.col("u").alias("kv"), F.lit(True).alias("go_v"), F.col("v").alias("v2"), F.col("m").alias("m2"), F.col("go_v").alias("gv2"))
        behind = walk.select(F.col("u").alias("kw"), F.lit(True).alias("go_w"), F.col("w").alias("w2"), F.col("go_w").alias("gw2"))
        walk = shared.written(rows.hint("merge").join(ahead, ["kv", "go_v"], "left").hint("merge").join(behind, ["kw", "go_w"], "left").select("u", F.coalesce("w2", "w").alias("w"), F.coalesce("v2", "v").alias("v"), F.least("m", "m2").alias("m"), F.coalesce("gv2", F.lit(False)).alias("go_v"), F.coalesce("gw2", F.lit(False)).alias("go_w")))
    return walk.select("u", "w", "v", "m", F.col("go_v").alias("open"))


def _spread(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The smallest label ``l`` of ``nodes(n, l)`` that reaches each node over ``edges(src, dst)``.

    After a few plain rounds each node also follows, by doubling, the neighbour
    that its label came from, so long ways take few rounds.
    """
    state, many = nodes.select("n", "l"), None
    for done in itertools.count():
        near = edges.hint("merge").join(state, edges["src"] == state["n"]).groupBy(F.col("dst").alias("n")).agg(F.min(F.struct("l", "src")).alias("m"))
        less = F.coalesce(F.col("m.l") < F.col("l"), F.lit(False))
        step = shared.written(state.hint("merge").join(near, "n", "left").select("n", F.when(less, F.col("m.l")).otherwise(F.col("l")).alias("l"), F.when(less, F.col("m.src")).otherwise(F.col("n")).alias("p"), less.alias("moved")))
        state = step.select("n", "l")
        if step.filter("moved").isEmpty():
            return state
        if done >= 4:
            many = many or nodes.count().bit_length()
            for _ in range(many):
                up = step.select(F.col("n").alias("p"), F.col("l").alias("l2"), F.col("p").alias("p2"))
                step = shared.written(step.hint("merge").join(up, "p").select("n", F.least("l", "l2").alias("l"), F.col("p2").alias("p"), (F.col("p2") != F.col("p")).alias("moved")))
                if step.filter("moved").isEmpty():
                    break
            state = step.select("n", "l")


def depth(parents: DataFrame) -> DataFrame:
    """Distance of each ``id`` to its root over ``parents(id, parent)``, by pointer doubling: rounds grow as the logarithm.

    An id that is its own parent is a root. On a cycle, and above one, the way
    ends at the first id that comes again.
    """
    parents = parents.select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent")).checkpoint()
    walk = _climb(parents)
    settled, open_ = walk.filter("up is null").select("id", "depth"), walk.filter("up is not null")
    if open_.isEmpty():
        return settled
    # after more steps than there are ids, all who still climb are on cycles
    ring = open_.select(F.col("up").alias("id")).distinct().checkpoint()
    least = ring.select("id", F.col("id").alias("least"))
    hop = parents.join(ring, "id").select("id", F.col("parent").alias("up")).checkpoint()
    for _ in range(max(1, ring.count().bit_length())):
        above = hop.select(F.col("id").alias("u_id"), F.col("up").alias("u_up")).join(least.select(F.col("id").alias("u_id"), F.col("least").alias("u_least")), "u_id")
        both = hop.join(least, "id").join(above, F.col("up") == F.col("u_id")).select("id", F.col("u_up").alias("up"), F.least("least", "u_least").alias("least")).checkpoint()
        hop, least = both.select("id", "up"), both.select("id", "least")
    size = least.join(least.groupBy("least").agg(F.count("*").alias("size")), "least").select("id", (F.col("size") - 1).alias("more"))
    off = open_.select("id").join(parents, "id").join(size.select("id", F.lit(True).alias("ring")), "id", "left")
    steps = _climb(off.select("id", F.when(F.col("ring").isNull(), F.col("parent")).alias("parent")).checkpoint(), True)
    way = steps.join(size.withColumnRenamed("id", "root"), "root").select("id", (F.col("depth") + F.col("more")).alias("depth"))
    return settled.unionByName(way)


def _climb(parents: DataFrame, rooted: bool = False) -> DataFrame:
    """``id``, ``up`` (null at the end of the way), ``depth`` and ``root`` after more steps than there are ids."""
    walk = parents.select("id", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"), F.coalesce("parent", "id").alias("root")).checkpoint()
    for _ in range(max(1, parents.count().bit_length()) + 1):
        if walk.filter("up is not null").isEmpty():
            break
        above = walk.select(F.col("id").alias("u_id"), F.col("up").alias("u_up"), F.col("depth").alias("u_depth"), F.col("root").alias("u_root"), F.lit(True).alias("live"))
        # finished rows join nothing, each under its own id
        rows = walk.withColumns({"live": F.col("up").isNotNull(), "u_id": F.coalesce("up", "id")})
        walk = rows.join(above, ["u_id", "live"], "left").select("id", F.when(F.col("live"), F.col("u_up")).alias("up"), (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"), F.coalesce("u_root", "root").alias("root")).checkpoint()
    return walk


def orphans(symbols: DataFrame, references: DataFrame, key: str, max_refs: int = 0) -> DataFrame:
    """Symbols with at most ``max_refs`` references."""
    if max_refs == 0:
        return symbols.join(references.select(key), key, "left_anti").withColumn("refs", F.lit(0).cast("long"))
    counts = references.groupBy(key).agg(F.count("*").alias("refs"))
    return symbols.join(counts, key, "left").withColumn("refs", F.coalesce("refs", F.lit(0))).filter(F.col("refs") <= max_refs)


def block_state(df: DataFrame, key: str, order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Whether each row lies inside an open block: running sum of openings minus closings before it."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    step = opens.cast("int") - closes.cast("int")
    return df.withColumn("inside", F.coalesce(F.sum(step).over(before), F.lit(0)) > 0)


def last_mark(df: DataFrame, key: str, order: list[str], mark: Column) -> DataFrame:
    """Whether the nearest row before with a ``mark`` opened a block: true after an opening, false after a closing or where there is none."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)))


def capped(df: DataFrame, order: list[Column], most: int | None) -> DataFrame:
    """The first ``most`` rows in a total order, with how many there were (``total``) and whether some are left out (``truncated``)."""
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    head = df if most is None else df.orderBy(*order).limit(most)
    return head.crossJoin(total).withColumn("truncated", F.lit(False) if most is None else F.col("total") > most).orderBy(*order)
