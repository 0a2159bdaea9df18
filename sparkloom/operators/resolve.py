"""Resolution of textual call and access targets to methods.

A prefix test becomes a join by ranges of sorted texts, a suffix test one on the suffixes of the lengths that
occur, and a substring test one on windows of a few characters, checked afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import names
from sparkloom.scratch import saved

#: Texts of the sample that places the cuts of ranges, by partition, and the greatest character.
TEXTS_A_RANGE, LAST = 64, "\U0010ffff"
#: Methods of a class that a task pairs at once, about.
CLASS_BLOCK = 2000
#: Calls of one source that are too many for one task, and texts of a range.
OFTEN, RANGE_TEXTS = 100_000, 50_000


def _begun(key: tuple, names: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a name and a text of one range that begins with it: in sorted texts they follow each other."""
    texts = np.sort(held["whole"].to_numpy(object)) if len(held) else np.zeros(0, object)
    asked = names["name"].to_numpy(object)
    low = [bisect_left(texts, n) for n in asked]
    high = [bisect_right(texts, n + LAST, lo=a) for n, a in zip(asked, low, strict=True)]
    many = np.subtract(high, low) if len(asked) else np.zeros(0, int)
    return pd.DataFrame({"name": np.repeat(asked, many), "whole": np.concatenate([texts[a:b] for a, b in zip(low, high, strict=True)]) if len(asked) else asked})


def beginnings(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """name, whole: all pairs of a `name` of `wanted` and a `whole` of `held` that starts with it, each once.

    Texts are dealt to ranges in their order, by cuts from a bounded sample; a name goes to the ranges from itself to its
    last continuation, one or two unless it is very short. Every text takes part once, however many names it has. An
    empty name is none.
    """
    spark = held.sparkSession
    wanted, held = wanted.select("name").where("name <> ''").distinct(), saved(held.select("whole").where("whole IS NOT NULL").distinct())
    many = held.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // RANGE_TEXTS)
    every = max(1, many // (parts * TEXTS_A_RANGE))
    some = sorted(r[0] for r in held.where(F.pmod(F.xxhash64("whole"), F.lit(every)) == 0).collect())  # TEXTS_A_RANGE a partition, about
    cuts = F.lit([some[len(some) * i // parts] for i in range(1, parts)] if some else []).cast("array<string>")
    place = lambda c: F.size(F.filter(cuts, lambda x: x <= c))
    names = wanted.select("name", F.explode(F.sequence(place(F.col("name")), place(F.concat("name", F.lit(LAST))))).alias("part"))
    texts = held.select("whole", place(F.col("whole")).alias("part"))
    return names.groupBy("part").cogroup(texts.groupBy("part")).applyInPandas(_begun, "name string, whole string")


def by_prefix(wanted: DataFrame, methods: DataFrame, most: int | None = 50) -> DataFrame:
    """name, method_id, app_id: for each name the first `most` methods, by id, whose signature starts with it."""
    pairs = beginnings(wanted, methods.select(F.col("signature").alias("whole")))
    found = pairs.join(methods.select("method_id", "app_id", F.col("signature").alias("whole")), "whole").drop("whole")
    if most is None:
        return found
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("method_id"))).where(F.col("nth") <= most).drop("nth")


def containing(wanted: DataFrame, held: DataFrame, window: int = 6) -> DataFrame:
    """text, whole: all pairs of a `text` of `wanted` and a `whole` of `held` that contains it.

    Both are joined on one window of each text, the one that the fewest wholes have, so that a beginning that all names
    share brings nothing together. An empty text is in none.
    """
    wanted, held = saved(wanted.select("text").where("text <> ''").distinct()), held.select("whole").where("whole IS NOT NULL").distinct()
    size = F.least(F.length("text"), F.lit(window))
    sizes = [r[0] for r in wanted.select(size).distinct().collect()]  # `window` at most
    if not sizes:
        return wanted.select("text", F.lit(None).cast("string").alias("whole"))

    def cut(c: str, n: Column) -> Column:
        """All windows of n characters; none of a shorter text."""
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.flatten(F.array(*(cut("whole", F.lit(n)) for n in sizes))))
    keys = saved(held.select("whole", F.explode(every).alias("key")))
    asked = wanted.select("text", F.explode(F.array_distinct(cut("text", size))).alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("n"))
    # a window that no whole has gives its text none
    best = asked.join(often, "key", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best"))
    rare = best.where("best.n > 0").select("text", F.col("best.key").alias("key"))
    return rare.join(keys, "key").where(F.contains("whole", "text")).select("text", "whole")


def entries(methods: DataFrame, app: int | str | None = None) -> DataFrame:
    """method_id, app_id, signature, http_path, http_method, class_name of the entry methods of an app; None or `%` means all."""
    found = methods.where("is_entry")
    if app is not None and app != "%":
        found = found.where(F.col("app_id") == app)
    return found.select("method_id", "app_id", "signature", F.col("path").alias("http_path"), "http_method", "class_name")


def by_id(wanted: DataFrame, methods: DataFrame) -> DataFrame:
    """The methods whose full_id is one of `wanted` (full_id)."""
    return methods.join(wanted.select("full_id").distinct(), "full_id", "left_semi")


def resolve_callers(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """call_id, src, how of raw calls (call_id, source): the method of that full_id, else the first by id, of any app, whose signature starts with the source's name."""
    sources = saved(raw.groupBy("source").agg(F.count("*").alias("n")).where("source IS NOT NULL"))
    exact = sources.join(methods.select(F.col("method_id").alias("src"), F.col("full_id").alias("source")), "source").select("source", "src", F.lit("exact").alias("how"))
    rest = sources.join(exact, "source", "left_anti").withColumn("name", names.method_name(F.col("source")))
    known = saved(exact.unionByName(rest.join(by_prefix(rest, methods, 1), "name").select("source", F.col("method_id").alias("src"), F.lit("prefix").alias("how"))))
    # a source of very many calls would be one task's: the few such are looked up where the calls lie
    often = F.broadcast(sources.where(F.col("n") > OFTEN).select("source"))
    seldom = raw.join(often, "source", "left_anti").join(known, "source")
    return seldom.unionByName(raw.join(F.broadcast(known.join(often, "source", "left_semi")), "source")).select("call_id", "src", "how")


def resolve_calls(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """call_id, src, dst, how: raw calls (call_id, src, target, call_type) whose target names a known method.

    `exact`: the target is the full_id of another method. Else the methods whose signature starts with the target's
    name are looked at, the first 50 by id: one of the caller's app other than the caller, then the caller itself; for
    external calls then any other one, then any. A call without such a method is dropped.
    """
    caller = methods.select(F.col("method_id").alias("src"), F.col("app_id").alias("src_app"), F.col("full_id").alias("src_full"))
    calls = raw.join(caller, "src")
    exact = calls.join(methods.select(F.col("method_id").alias("dst"), F.col("full_id").alias("target")), "target").where("src <> dst")
    sure = exact.select("call_id", "src", "dst", F.lit("exact").alias("how"))
    rest = calls.join(exact.select("call_id"), "call_id", "left_anti").withColumn("name", names.method_name(F.col("target")))
    options = rest.join(by_prefix(rest, methods), "name")
    same, self_ = F.col("app_id") == F.col("src_app"), F.col("method_id") == F.col("src")
    outside = F.col("call_type") == "EXTERNAL"
    rank = F.when(same & ~self_, 1).when(same & self_, 2).when(outside & ~self_, 3).when(outside, 4)
    ranked = options.withColumn("rank", rank).where(F.col("rank").isNotNull())
    first = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("call_id").orderBy("rank", "method_id"))).where("nth = 1")
    return sure.unionByName(first.select("call_id", "src", F.col("method_id").alias("dst"), F.lit("prefix").alias("how")))


def accesses_exact(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """access_id, method_id of raw accesses (access_id, app_id, source) whose source is a full_id."""
    return raw.join(methods.select("method_id", F.col("full_id").alias("source")), "source").select("access_id", "method_id")


def access_tables(raw: DataFrame) -> DataFrame:
    """table_id (`table:` app `:` table), table_name of raw accesses (app_id, table_name): every accessed table, whether a method is known for the access or not."""
    return raw.select(F.concat_ws(":", F.lit("table"), F.col("app_id").cast("string"), "table_name").alias("table_id"), "table_name").distinct()


def accesses_prefix(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """As accesses_exact(), or whose signature, in the same app, starts with the source's name; every such method."""
    equal = raw.join(methods.select("method_id", F.col("full_id").alias("source"), F.col("app_id").alias("app")), "source").where("app = app_id")
    named = raw.withColumn("name", names.method_name(F.col("source"))).withColumnRenamed("app_id", "app")
    starts = named.join(by_prefix(named, methods, None), "name").where("app = app_id")
    return equal.select("access_id", "method_id").unionByName(starts.select("access_id", "method_id")).distinct()


def by_class(wanted: DataFrame, methods: DataFrame) -> DataFrame:
    """caller_class, caller_method, method_id: all pairs of a row of `wanted` and a method of its class, each once.

    The methods of a class are dealt to blocks of about CLASS_BLOCK, and what is wanted of the class goes to each of them, so
    that one class of very many pairs is made by many tasks. Pairs are not shuffled, and methods are not broadcast, of which there
    are far more than the size of their table tells.
    """
    parts = int(methods.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = saved(methods.select(F.col("class_name").alias("caller_class"), "method_id").where("class_name IS NOT NULL").distinct())
    blocks = held.groupBy("caller_class").agg(F.ceil(F.count("*") / CLASS_BLOCK).cast("int").alias("blocks"))
    dealt = held.join(blocks, "caller_class").withColumn("block", F.pmod(F.xxhash64("method_id"), F.col("blocks")).cast("int")).drop("blocks")
    asked = wanted.join(blocks, "caller_class").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    both = asked.repartition(parts, "caller_class", "block").join(dealt.repartition(parts, "caller_class", "block").hint("merge"), ["caller_class", "block"])
    return both.select("caller_class", "caller_method", "method_id")


def accesses_capture(captured: DataFrame, methods: DataFrame, window: int = 6) -> DataFrame:
    """caller_class, caller_method, method_id: methods whose full_id contains class.method or ends with method, or of that very class.

    Those of the class, of which there may be very many, are distinct as they are made; only the others are compared. Joins with
    methods and with what is wanted sort both sides: texts are made of short columns, so that Spark takes them for small and would hold all in memory.
    """
    wanted = saved(captured.select("caller_class", "caller_method").distinct().withColumn("text", F.concat_ws(".", "caller_class", "caller_method")))
    keep = ["caller_class", "caller_method", "method_id"]
    inside = containing(wanted.select("text"), methods.select(F.col("full_id").alias("whole")), window)
    others = wanted.hint("merge").join(inside, "text").join(methods.select("method_id", F.col("full_id").alias("whole")).hint("merge"), "whole").select(keep)
    last: dict[int, list[str]] = {}
    for n, c in wanted.where("caller_method IS NOT NULL").select(F.length("caller_method"), F.expr("right(caller_method, 1)")).distinct().collect():  # lengths of names and their last characters: a few hundred
        last.setdefault(n, []).append(c)
    if last:
        end = lambda n: F.when(F.expr("right(full_id, 1)").isin(last[n]) if n else F.col("full_id").isNotNull(), F.expr(f"right(full_id, {n})"))
        ends = methods.select("method_id", F.explode(F.array(*map(end, sorted(last)))).alias("caller_method")).where("caller_method IS NOT NULL")
        others = others.unionByName(wanted.join(ends.hint("merge"), "caller_method").select(keep))
    own = methods.select("method_id", F.col("class_name").alias("caller_class"))
    return by_class(wanted.select("caller_class", "caller_method"), methods).unionByName(others.distinct().join(own.hint("merge"), ["method_id", "caller_class"], "left_anti").select(keep))


def resolve_external(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """call_id, dst, protocol: where external calls (call_id, src, expression) lead.

    An address resolves to the first entry method, by id, of another app with that path (HTTP); with an address in the
    text nothing else is tried. A dubbo name resolves to the first entry method, by id, of another app whose class name
    contains it (Dubbo).
    """
    app = methods.select(F.col("method_id").alias("src"), F.col("app_id").alias("src_app"))
    texts = saved(calls.join(app, "src").select("call_id", "src_app", names.url_path(F.col("expression")).alias("path"), names.rpc_method(F.col("expression")).alias("name")))
    http = texts.where("path IS NOT NULL").join(methods.where("is_entry").select("method_id", "app_id", "path"), "path")
    named = texts.where("path IS NULL AND name IS NOT NULL")
    classes = methods.where("is_entry").groupBy("class_name", "app_id").agg(F.min("method_id").alias("method_id"))  # the first of a class in an app is enough
    pairs = containing(named.select(F.col("name").alias("text")), classes.select(F.col("class_name").alias("whole")))
    rpc = named.join(pairs.withColumnRenamed("text", "name"), "name").join(classes.withColumnRenamed("class_name", "whole"), "whole").select("call_id", "src_app", "app_id", "method_id")
    first = Window.partitionBy("call_id").orderBy("method_id")
    pick = lambda rows, kind: rows.where("app_id <> src_app").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("call_id", F.col("method_id").alias("dst"), F.lit(kind).alias("protocol"))
    return pick(http, "HTTP").unionByName(pick(rpc, "Dubbo"))
