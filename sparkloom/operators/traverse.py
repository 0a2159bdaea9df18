"""Walks over a call graph as joins of a frontier with the calls, a bounded number of levels deep."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import bitreach, blockreach, returns
from sparkloom.operators.places import in_order
from sparkloom.scratch import saved


def reach(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """seed, node, depth: nodes within `most` edges of each seed (depth 0: itself), each at its least depth; a row a pair.

    seeds: method_id; edges: a, b, followed from a to b.
    """
    marks = bitreach.numbered(seeds)
    found = reduce(DataFrame.unionByName, (new.withColumn("depth", F.lit(depth)) for depth, new, _ in bitreach.levels(marks, edges, most)))
    return bitreach.unpacked(found).join(marks, ["block", "bit"]).select("seed", "node", "depth")


def on_cycle(calls: DataFrame, most: int) -> DataFrame:
    """method_id of the methods that reach themselves within `most` calls: the shortest closed walk repeats no call.

    Cycles of one and two calls are joins of the distinct calls. For those of three, each method's calls to and from methods
    of higher degree (then id) are paired, and a pair whose ends call each other back is a cycle: every cycle is found at its
    method of least degree alone, so a hub pairs few of its calls. Longer ones are reach from every method that calls and is called.
    """
    hops = saved(calls.select("src", "dst").distinct())
    loops = hops.where("src = dst").select(F.col("src").alias("method_id"))
    hops = hops.where("src <> dst")
    if most > 3:
        both = hops.select(F.col("src").alias("method_id")).intersect(hops.select(F.col("dst").alias("method_id")))
        marks = bitreach.numbered(both)
        back = hops.select(F.col("src").alias("b"), F.col("dst").alias("a"))
        within = reduce(DataFrame.unionByName, (new for depth, new, _ in bitreach.levels(marks, back, most - 1) if depth))
        # a seed lies on a cycle where a method that it calls is among those that reach it
        called = hops.join(marks, F.col("src") == F.col("seed")).select("seed", "block", F.col("dst").alias("node"), bitreach.bit().alias("own"))
        return loops.unionByName(called.join(within, ["block", "node"]).where("own & bits <> 0").select(F.col("seed").alias("method_id"))).distinct()
    out = loops
    if most > 1:
        back = hops.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        out = out.unionByName(hops.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("method_id")))
    if most > 2:
        ends = hops.select(F.explode(F.array("src", "dst")).alias("m")).groupBy("m").agg(F.count("*").alias("degree"))
        ranked = hops.join(ends.select(F.col("m").alias("src"), F.col("degree").alias("src_degree")), "src").join(ends.select(F.col("m").alias("dst"), F.col("degree").alias("dst_degree")), "dst")
        up = F.struct("src_degree", "src") < F.struct("dst_degree", "dst")
        leaving = ranked.where(up).select(F.col("src").alias("at"), F.col("dst").alias("to"))
        coming = ranked.where(~up).select(F.col("dst").alias("at"), F.col("src").alias("from"))
        closing = hops.select(F.col("src").alias("to"), F.col("dst").alias("from"))
        found = coming.join(leaving, "at").join(closing, ["to", "from"], "left_semi")
        out = out.unionByName(found.select(F.explode(F.array("at", "to", "from")).alias("method_id")))
    return out.distinct()


def core(calls: DataFrame, rounds: int) -> DataFrame:
    """The calls left when those from methods nobody calls, and to methods that call nobody, go, `rounds` times or until none does: all that cycles use."""
    n = None
    for _ in range(rounds):
        calls = calls.join(calls.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        calls = saved(calls.join(calls.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        left = calls.count()
        if left == n:
            break
        n = left
    return calls


def closed_walks(calls: DataFrame, length: int, trails: bool = True) -> DataFrame:
    """n0 .. n(length - 1), ways, turns: closed walks of `length` calls over methods, each from its least method on.

    ways: the trails (no call twice) along the walk, where methods call each other more than once. turns: how many of its
    starts, from the first on, are this row's; the walk comes again for the next visit of its least method. Methods are
    structs of degree and id. The first half of a walk meets the second, so the longest walks that are held have half the calls; as all
    methods of a walk follow its first in order of degree, a hub begins no walk through lesser methods. Without `trails` walks that
    no trail goes along are there too.
    """
    ends = calls.select(F.explode(F.array("src", "dst")).alias("m")).groupBy("m").agg(F.count("*").alias("degree"))
    node = lambda side: ends.select(F.col("m").alias(side), F.struct("degree", "m").alias(f"{side}_node"))
    hops = calls.groupBy("src", "dst").agg(F.count("*").alias("many")).join(node("src"), "src").join(node("dst"), "dst")
    hops = saved(hops.select(F.col("src_node").alias("a"), F.col("dst_node").alias("b"), "many"))
    first, last = length - length // 2, length // 2
    head = hops.where("b >= a").select(F.col("a").alias("n0"), F.col("b").alias("n1"), F.col("many").alias("m0"))
    for i in range(1, first):
        head = head.join(hops, (F.col(f"n{i}") == F.col("a")) & (F.col("b") >= F.col("n0"))).drop("a").withColumnsRenamed({"b": f"n{i + 1}", "many": f"m{i}"})
    tail = hops.where("a >= b").select(F.col("b").alias("n0"), F.col("a").alias(f"n{length - 1}"), F.col("many").alias(f"m{length - 1}"))
    for i in range(length - 2, length - 1 - last, -1):
        tail = tail.join(hops, (F.col(f"n{i + 1}") == F.col("b")) & (F.col("a") >= F.col("n0"))).drop("b").withColumnsRenamed({"a": f"n{i}", "many": f"m{i}"})
    walks = head.join(tail, ["n0", f"n{first}"]) if length > 1 else head.where("n0 = n1")
    at = [F.col(f"n{i % length}") for i in range(length + 1)]
    ways = _ways([F.col(f"m{i}") for i in range(length)], at, length)
    turns = F.coalesce(*(F.when(at[i] == at[0], i) for i in range(1, length)), F.lit(length))
    return walks.withColumns({"ways": ways, "turns": turns}).where("ways > 0" if trails else "true").select(*(f"n{i}" for i in range(length)), "ways", "turns")


def closed_trails(calls: DataFrame, least: int, most: int) -> DataFrame:
    """start, cycle, depth: every closed trail (no call twice) of `least` to `most` calls, once for each call that it may start with.

    cycle: the methods on the way, joined by `>`.
    """
    hops, out = core(calls.select("call_id", "src", "dst"), 3), []
    for depth in range(least, most + 1):
        names = F.array(*(F.col(f"n{i}.m").cast("string") for i in range(depth)))
        walks = closed_walks(hops, depth).select(names.alias("nodes"), F.explode(F.sequence(F.lit(1), "turns")).alias("turn"), "ways")
        turned = F.concat(F.slice("nodes", F.col("turn"), F.lit(depth)), F.slice("nodes", F.lit(1), F.col("turn")))
        rows = walks.select(turned.alias("nodes"), F.explode(F.sequence(F.lit(1).cast("long"), "ways")))
        out.append(rows.select(F.get("nodes", F.lit(0)).cast("long").alias("start"), F.array_join("nodes", ">").alias("cycle"), F.lit(depth).alias("depth")))
    return reduce(DataFrame.unionByName, out)


def _trails_between(hops: DataFrame, own: str, least: int, most: int) -> DataFrame:
    """The rows of closed_trails() whose start fulfils `own`, a condition on `start`.

    The first half of a trail, from its start on, meets the second, from its end back.
    """
    heads = [saved(hops.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("nodes"), F.array("call_id").alias("ids")).where(own))]
    tails = [saved(hops.select(F.col("dst").alias("start"), F.col("src").alias("at"), F.array("src").alias("nodes"), F.array("call_id").alias("ids")).where(own))]
    fresh = ~F.array_contains("ids", F.col("call_id"))
    while len(heads) < most - most // 2:
        heads.append(saved(heads[-1].join(hops, (F.col("at") == F.col("src")) & fresh).select("start", F.col("dst").alias("at"), F.concat("nodes", F.array("src")).alias("nodes"), F.concat("ids", F.array("call_id")).alias("ids"))))
    while len(tails) < most // 2:
        tails.append(saved(tails[-1].join(hops, (F.col("at") == F.col("dst")) & fresh).select("start", F.col("src").alias("at"), F.concat(F.array("src"), F.col("nodes")).alias("nodes"), F.concat(F.array("call_id"), F.col("ids")).alias("ids"))))
    out = []
    for depth in range(least, most + 1):
        head = heads[depth - depth // 2 - 1]
        if depth > 1:
            tail = tails[depth // 2 - 1].select("start", "at", F.col("nodes").alias("back"), F.col("ids").alias("back_ids"))
            nodes = head.join(tail, ["start", "at"]).where(~F.arrays_overlap("ids", "back_ids")).select("start", F.concat("nodes", "back").alias("nodes"))
        else:
            nodes = head.where("at = start").select("start", "nodes")
        way = F.array_join(F.concat("nodes", F.array("start")).cast("array<string>"), ">")
        out.append(nodes.select("start", way.alias("cycle"), F.lit(depth).alias("depth")))
    return reduce(DataFrame.unionByName, out)


def first_trails(calls: DataFrame, least: int, most: int, first: int) -> DataFrame:
    """The `first` so many rows of closed_trails() by start, length and way, found from the least starts on.

    Few starts are looked at first, then more at a time, until there are enough trails or no starts: trails of other starts are not made.
    """
    hops, found, below, many, n = core(calls.select("call_id", "src", "dst"), 3), [], None, 4, 0
    while True:
        left = hops if below is None else hops.where(F.col("src") > below)
        last = left.select("src").distinct().orderBy("src").limit(many).agg(F.max("src")).first()[0]
        if last is None and found:
            break
        own = "false" if last is None else f"start <= {last}" if below is None else f"start > {below} AND start <= {last}"
        found.append(saved(_trails_between(hops, own, least, most).orderBy("start", "depth", "cycle").limit(first - n)))
        n += found[-1].count()
        if n >= first or last is None:
            break
        below, many = last, many * 8
    return reduce(DataFrame.unionByName, found)


def _ranked(hops: DataFrame) -> DataFrame:
    """a, b, many of src, dst, many: the methods as numbers from 0 on in order of degree and then id."""
    ends = hops.select(F.explode(F.array("src", "dst")).alias("m"), "many").groupBy("m").agg(F.sum("many").alias("degree"))
    one = ends.select(F.lit(0).alias("seed"), F.lit(False).alias("crosses"), "m", "degree")
    place = saved(in_order(one, ["degree", "m"])[0].select("m", (F.col("place") - 1).alias("nth")))
    side = lambda old, new: place.select(F.col("m").alias(old), F.col("nth").alias(new))
    return saved(hops.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b", "many"))


def _repeating(hops: DataFrame, most: int) -> dict[int, DataFrame]:
    """By length, n0 .. n(length - 1): the closed walks of up to `most` hops that take a hop more than once, from each of their starts; most <= 5.

    A hop comes again at once, where it leads from a method to itself, or after the hop back.
    """
    loops = saved(hops.where("a = b").select(F.col("a").alias("u")))
    pairs = saved(hops.select(F.col("a").alias("u"), F.col("b").alias("v")).join(hops.select(F.col("b").alias("u"), F.col("a").alias("v")), ["u", "v"], "left_semi"))
    ways = {2: loops.select("u", F.col("u").alias("n1")), 3: loops.select("u", F.col("u").alias("n1"), F.col("u").alias("n2"))}
    if most > 3:
        ways[4] = pairs.select("u", "v", F.col("u").alias("x"), F.col("v").alias("y")).unionByName(pairs.join(loops, "u", "left_semi").select("u", F.col("u").alias("v"), F.col("u").alias("x"), F.col("v").alias("y")))
    if most > 4:
        # what a closed walk of three has beside a method that is in a pair or has a hop to itself
        some = saved(loops.select(F.col("u").alias("m"), F.lit(True).alias("own")).unionByName(pairs.select(F.col("u").alias("m"), F.lit(False).alias("own"))).groupBy("m").agg(F.bool_or("own").alias("own")))
        beside = lambda x, y: hops.join(some.where("own").withColumnRenamed("m", x), x, "left_semi").select(F.col(y).alias("m"))
        at = lambda x, rows: rows.select(F.col("m").alias(x), F.lit(True).alias(f"at_{x}")).distinct()
        marked = hops.select("a", "b").join(at("a", some), "a", "left").join(at("b", some), "b", "left")
        marked = marked.where("at_a OR at_b").select("a", "b").unionByName(hops.select("a", "b").join(at("a", beside("a", "b")), "a", "left_semi").join(at("b", beside("b", "a")), "b", "left_semi"))
        calls = saved(marked.distinct().select(F.col("a").alias("src"), F.col("b").alias("dst")))
        three = [F.col(f"n{i}.m") for i in range(3)]
        turned = [F.struct(*(three[(i + k) % 3].alias(n) for i, n in enumerate("uvx"))) for k in range(3)]
        round_ = saved(closed_walks(calls, 3, trails=False).select(F.explode(F.array(*turned)).alias("w")).select("w.*").distinct())
        ways[5] = round_.join(pairs, ["u", "v"], "left_semi").select("u", "v", F.col("u").alias("n2"), F.col("v").alias("n3"), "x").unionByName(round_.join(loops, "u", "left_semi").select("u", F.col("u").alias("v"), F.col("u").alias("n2"), F.col("v").alias("n3"), "x"), allowMissingColumns=True)
    out = {}
    for length, rows in ways.items():
        if length <= most:
            all_ = F.array(*(F.struct(*(F.col(rows.columns[(i + k) % length]).alias(f"n{i}") for i in range(length))) for k in range(length)))
            out[length] = saved(rows.select(F.explode(all_).alias("w")).select("w.*").distinct())
    return out


def _ways(many: list, at: list, length: int):
    """How many trails go along a closed walk: a call that is taken is gone."""
    ways = F.lit(1).cast("long")
    for i in range(length):
        used = reduce(lambda x, y: x + y, (((at[j] == at[i]) & (at[j + 1] == at[i + 1])).cast("long") for j in range(i)), F.lit(0).cast("long"))
        ways = ways * F.greatest(many[i] - used, F.lit(0).cast("long"))
    return ways


def trail_counts(calls: DataFrame, least: int, most: int) -> DataFrame:
    """depth, trails: how many rows closed_trails() has of each number of calls, counted without making them.

    Up to five calls these are all closed walks, put together from walks that first return to their least method, without what
    those that take a hop again have too many; longer ones are counted walk by walk.
    """
    short, sums = min(most, 5), []
    if most > 5:
        hops = core(calls.select("call_id", "src", "dst"), 3)
        sums = [closed_walks(hops, depth).agg(F.sum(F.col("ways") * F.col("turns")).alias("trails")).select(F.lit(depth).alias("depth"), F.coalesce("trails", F.lit(0)).cast("long").alias("trails")) for depth in range(max(least, 6), most + 1)]
    if least > short:
        return reduce(DataFrame.unionByName, sums)
    ranked = _ranked(core(saved(calls.groupBy("src", "dst").agg(F.count("*").alias("many"))), 3))
    n = (ranked.agg(F.max(F.greatest("a", "b"))).first()[0] or 0) + 1
    first = returns.first_returns(ranked, n, short).groupBy("a").pivot("length", list(range(1, short + 1))).agg(F.sum("walks"))
    first = saved(first)  # it stands in the sum of every depth
    f = {t: F.coalesce(F.col(str(t)), F.lit(0)) for t in range(1, short + 1)}
    closed = {0: F.lit(1).cast("long")}
    for n in range(1, short):
        closed[n] = reduce(lambda x, y: x + y, (f[t] * closed[n - t] for t in range(1, n + 1)))
    depths = range(max(least, 1), short + 1)
    totals = first.agg(*(F.coalesce(F.sum(reduce(lambda x, y: x + y, (F.lit(t) * f[t] * closed[depth - t] for t in range(1, depth + 1)))), F.lit(0)).cast("long").alias(str(depth)) for depth in depths))
    again = _repeating(ranked, short)
    if again:  # walks stand there from each of their starts
        at = saved(reduce(DataFrame.unionByName, (rows.select(F.col("n0").alias("m")) for rows in again.values())).distinct())
        ranked = saved(ranked.join(at.withColumnRenamed("m", "a"), "a", "left_semi").join(at.withColumnRenamed("m", "b"), "b", "left_semi"))
    for depth in depths:
        total = totals.select(F.col(str(depth)).alias("total"))
        if depth in again:
            rows = again[depth]
            for i in range(depth):
                rows = rows.join(ranked.select(F.col("a").alias(f"n{i}"), F.col("b").alias("to"), F.col("many").alias(f"m{i}")).withColumnRenamed("to", f"n{(i + 1) % depth}"), [f"n{i}", f"n{(i + 1) % depth}"]) if depth > 1 else rows
            many = [F.col(f"m{i}") for i in range(depth)]
            excess = reduce(lambda x, y: x * y, many) - _ways(many, [F.col(f"n{i % depth}") for i in range(depth + 1)], depth)
            total = total.crossJoin(rows.agg(F.coalesce(F.sum(excess), F.lit(0)).alias("excess"))).select((F.col("total") - F.col("excess")).alias("total"))
        sums.append(total.select(F.lit(depth).alias("depth"), F.col("total").cast("long").alias("trails")))
    return reduce(DataFrame.unionByName, sums)


#: Entries of each app that upstream_entries() follows first at least, and how many times more at least in each later round.
ENTRIES_FIRST, ENTRIES_MORE = 64, 8


def upstream_entries(graph, starts: DataFrame, most: int = 6, per_start: int = 50) -> DataFrame:
    """start, entry, depth: entry methods of the start's app that reach it within `most` calls; at most `per_start` a start, by id.

    What lies between may belong to any app. Entries are followed down to the starts, those of least id in each app first, and in
    each round as many more as the starts that lack some seem to need: where most entries reach most starts, few are followed. The
    first round goes by the mean number of calls of a method.
    """
    apps = graph.methods.where("app_id IS NOT NULL").select(F.col("method_id").alias("start"), "app_id")
    left = saved(starts.select(F.col("method_id").alias("start")).distinct().join(apps, "start").withColumn("n", F.lit(0).cast("long")))
    entries = graph.methods.where("is_entry").select(F.col("app_id").alias("seed"), "method_id", F.lit(False).alias("crosses"))
    entries = saved(in_order(entries, ["method_id"])[0].select(F.col("seed").alias("app_id"), F.col("method_id").alias("entry"), "place"))
    edges = graph.calls.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    last, n_methods = entries.agg(F.max("place")).first()[0] or 0, max(graph.methods.count(), 1)
    reached = min(sum((edges.count() / n_methods) ** depth for depth in range(1, most + 1)), n_methods)
    low, many, out = 0, min(max(ENTRIES_FIRST, int(per_start * n_methods / max(reached, 1))), max(last, 1)), []
    while not out or low < last:
        some = entries.where((F.col("place") > low) & (F.col("place") <= low + many)).join(left.select("app_id").distinct(), "app_id", "left_semi")
        low += many
        marks = bitreach.numbered(some.select(F.col("entry").alias("method_id")))
        new = (rows.withColumn("depth", F.lit(depth)) for depth, rows, _ in bitreach.levels(marks, edges, most))
        found = reduce(DataFrame.unionByName, new).where("depth > 0").join(left.withColumnRenamed("start", "node"), "node")
        own = marks.join(some, F.col("seed") == F.col("entry")).groupBy("block", "app_id").agg(F.bit_or(bitreach.bit()).alias("own"))
        hits = found.join(own, ["block", "app_id"]).select("block", "node", "n", "depth", F.expr("bits & own").alias("bits")).where("bits <> 0")
        pairs = bitreach.unpacked(hits).join(marks, ["block", "bit"]).select(F.col("node").alias("start"), F.col("seed").alias("entry"), "depth", "n")
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("entry")))
        out.append(saved(ranked.where(F.col("rank") <= per_start - F.col("n")).select("start", "entry", "depth")))
        more = out[-1].groupBy("start").agg(F.count("*").alias("more"))
        left = saved(left.join(more, "start", "left").select("start", "app_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")).where(F.col("n") < per_start))
        lacking, had = left.agg(F.count("*"), F.sum("n")).first()
        if not lacking:
            break
        many = max(many * ENTRIES_MORE, low * per_start * lacking // had) if had else last
    return reduce(DataFrame.unionByName, out)


def impacted_endpoints(graph, facts: DataFrame) -> DataFrame:
    """table_name, column_name, entry, via_method, depth: entry methods upstream of the methods that access a column.

    facts: table_name, column_name, method_id, access_count. An entry is named once a column, by the method of the most
    accesses (then the smallest id) that it reaches.
    """
    facts = facts.select("table_name", "column_name", "method_id", "access_count")
    found = upstream_entries(graph, facts.select("method_id").distinct()).withColumnRenamed("start", "method_id")
    first = Window.partitionBy("table_name", "column_name", "entry").orderBy(F.desc("access_count"), "method_id")
    ranked = facts.join(found, "method_id").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return ranked.select("table_name", "column_name", "entry", F.col("method_id").alias("via_method"), "depth")


def impact(graph, changed: DataFrame, most: int = 6, upstream: bool = True) -> DataFrame:
    """changed, n_methods, n_entries: how many methods a change reaches, upstream (who calls it) or downstream.

    Where methods have so many calls that nearly all are reached one call earlier, most changes are counted by _reaching_all(), the
    others block by block in tasks.
    """
    a, b = ("dst", "src") if upstream else ("src", "dst")
    seeds = saved(changed.select("method_id").distinct())
    hops = saved(graph.calls.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    known = graph.methods.select(F.col("method_id").alias("node"), "is_entry")
    n_methods = max(known.count(), 1)
    if most < 2 or (hops.count() / n_methods) ** (most - 1) < n_methods * log(n_methods):
        return _impact_of(known, seeds, hops, most)
    dense = blockreach.numbered(hops, known)
    counted = saved(_reaching_all(known, seeds, dense, most))
    return counted.unionByName(_impact_of(known, seeds.join(counted.select(F.col("changed").alias("method_id")), "method_id", "left_anti"), hops, most, dense)).where("n_methods > 0")


def _impact_of(known: DataFrame, seeds: DataFrame, hops: DataFrame, most: int, dense: blockreach.Numbered | None = None) -> DataFrame:
    """impact() by the bits of every seed, which tasks of their own follow where that is `dense`."""
    if dense:
        numbers = dense.of(seeds)
        sums = blockreach.counts(dense, numbers, most).join(dense.nodes, "node").select(F.col("id").alias("seed"), "n_methods", "n_entries")
        own = sums.join(known.withColumnRenamed("node", "seed"), "seed", "left")
    else:
        marks = bitreach.numbered(seeds)
        *_, (_, _, every) = bitreach.levels(marks, hops, most)
        sums = bitreach.counts(every.join(known, "node"), n_methods=F.lit(True), n_entries=F.col("is_entry"))
        own = marks.join(known.withColumnRenamed("node", "seed"), "seed", "left").join(sums, ["block", "bit"])
    less = lambda n, flag: (F.col(n) - F.coalesce(flag.cast("long"), F.lit(0))).alias(n)
    # a method reaches itself, which does not count
    return own.select(F.col("seed").alias("changed"), less("n_methods", F.col("is_entry").isNotNull()), less("n_entries", F.col("is_entry"))).where("n_methods > 0")


def _reaching_all(known: DataFrame, seeds: DataFrame, dense: blockreach.Numbered, most: int) -> DataFrame:
    """Rows of impact(), those of no methods too, for the seeds that surely reach all but strays.

    Each seed names the method that most seeds hop to of those that it hops to, its hub, of which those that several name are
    followed, one hop less far. A seed that hops to a hub that reaches all but strays does so too. Strays, what some of these hubs
    do not reach, are followed back from. The rest of the seeds is left to others.
    """
    near = dense.hops.join(dense.of(seeds).withColumnRenamed("node", "a"), "a", "left_semi")
    arrivals = near.groupBy("b").agg(F.count("*").alias("n"))
    best = F.max(F.col("n") * (1 << 31) + F.col("b"))  # numbers of nodes are smaller
    votes = near.join(arrivals, "b").groupBy("a").agg(F.pmod(best, F.lit(1 << 31)).alias("node"))
    hubs = saved(votes.groupBy("node").count().where("count > 1").select("node"))
    met = saved(blockreach.hubs(dense, hubs, most - 1))
    strays = saved(met.where("NOT good").select("node").distinct())
    sure = saved(near.join(met.where("good").select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct())
    if strays.count() >= sure.count():  # no less than to follow the seeds
        return known.where("false").select(F.col("node").alias("changed"), F.lit(0).cast("long").alias("n_methods"), F.lit(0).cast("long").alias("n_entries"))
    lacking = blockreach.lacking(dense, strays, most).groupBy("node").agg(F.sum("methods").alias("less"), F.sum("entries").alias("less_entries"))
    n_methods, n_entries = dense.facts.where("arrives").agg(F.coalesce(F.sum("methods"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    ever = known.join(dense.nodes.select(F.col("id").alias("node"), F.col("node").alias("nth")), "node").join(dense.facts.where("arrives").select(F.col("node").alias("nth")), "nth", "left_semi")
    own = sure.join(lacking, "node", "left").join(dense.nodes, "node").select(F.col("id").alias("seed"), "less", "less_entries")
    own = own.join(ever.select(F.col("node").alias("seed"), "is_entry"), "seed", "left")  # a method that is reached does not count for itself
    total = lambda n, less, flag: F.lit(n).cast("long") - F.coalesce(less, F.lit(0)) - F.coalesce(flag.cast("long"), F.lit(0))
    return own.select(F.col("seed").alias("changed"), total(n_methods, "less", F.col("is_entry").isNotNull()).alias("n_methods"), total(n_entries, "less_entries", F.col("is_entry")).alias("n_entries"))


def trace(graph, entries: DataFrame, most: int = 10, target: DataFrame | None = None, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """(visits, paths) of trace_with_hops()."""
    return trace_with_hops(graph, entries, most, target, hops)[:2]


def trace_with_hops(graph, entries: DataFrame, most: int = 10, target: DataFrame | None = None, hops: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A breadth-first trace from every entry: (visits, paths, followed).

    visits: seed, node, depth, rank (in order of visit within a depth). paths: seed, path (methods, a table last where it
    ends in one, as `table:<id>`), end (`seen`, `target` or `table`). A method is expanded on its first visit alone; each
    later arrival, at any depth, ends a path. Arrivals beyond `most` calls are dropped without a path. Where `target`
    (seed, target) names a method, arrivals there end a path and it is not visited. Calls into other apps are followed
    for the first `hops` of them in order of visit, per seed; internal calls always. Ties inside a depth are in order
    of the caller's rank, then call_id. most <= 0 counts as 10. followed: seed, call_id of the calls into other apps, of
    methods at the last depth too, though nothing beyond it is visited.
    """
    most = most if most > 0 else 10
    goal = target if target is not None else entries.select(F.col("method_id").alias("seed"), F.lit(None).cast("long").alias("target"))
    owner = graph.methods.select(F.col("method_id").alias("m"), "app_id")
    calls = graph.calls.join(owner.select(F.col("m").alias("src"), F.col("app_id").alias("from_app")), "src").join(owner.select(F.col("m").alias("dst"), F.col("app_id").alias("to_app")), "dst")
    calls = saved(calls.select("call_id", "src", "dst", ((F.col("call_type") == "EXTERNAL") & (F.col("from_app") != F.col("to_app"))).alias("crosses"), (F.col("call_type") == "INTERNAL").alias("internal")))
    level = entries.select(F.col("method_id").alias("seed"), F.col("method_id").alias("node"), F.array("method_id").alias("path"), F.lit(1).cast("long").alias("rank"), F.lit(0).alias("crossed"))
    level = level.join(goal, "seed", "left")
    visits = paths = followed = visited = None
    for depth in range(most + 1):
        at_goal = F.coalesce(F.col("node") == F.col("target"), F.lit(False))
        said = F.col("path").cast("array<string>").alias("path")
        met = level.withColumn("nth", F.row_number().over(Window.partitionBy("seed", "node").orderBy("rank")))
        if visits is not None:
            met = met.join(visits.select("seed", "node", F.lit(True).alias("old")), ["seed", "node"], "left")
        else:
            met = met.withColumn("old", F.lit(None).cast("boolean"))
        end = F.when(at_goal, "target").when(F.col("old").isNotNull() | (F.col("nth") > 1), "seen")
        met = saved(met.withColumn("end", end).select("seed", "node", "path", "rank", "crossed", "target", "end"))
        ended = met.where("end IS NOT NULL").select("seed", said, "end")
        fresh = met.where("end IS NULL").drop("end")
        new = fresh.select("seed", "node", F.lit(depth).alias("depth"), "rank")
        visits = new if visits is None else visits.unionByName(new)
        paths = ended if paths is None else paths.unionByName(ended)
        went_by = fresh.select("seed", "node", said)
        visited = went_by if visited is None else visited.unionByName(went_by)
        out = fresh.withColumnRenamed("rank", "parent_rank").join(calls.where("internal OR crosses"), F.col("node") == F.col("src"))
        out, totals = in_order(out, ["parent_rank", "call_id"])
        out = out.withColumn("so_far", F.col("so_far") + F.col("crossed")).where(F.col("internal") | (F.col("so_far") <= hops))
        went = out.where("crosses").select("seed", "call_id")  # at the last depth too, where what they lead to is not visited
        followed = went if followed is None else followed.unionByName(went)
        if depth == most:
            break
        crossed = F.least(F.col("crossed") + F.col("total"), F.lit(hops)).cast("int")
        level = out.join(totals, "seed").select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.col("place").alias("rank"), crossed.alias("crossed"), "target")
    # one join for all depths: accesses are read once
    hits = visited.join(graph.accesses, F.col("node") == F.col("method_id"))
    words = F.concat("path", F.array(F.concat(F.lit("table:"), F.col("table_id").cast("string"))))
    return visits, paths.unionByName(hits.select("seed", words.alias("path"), F.lit("table").alias("end"))), followed
