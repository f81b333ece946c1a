"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern; a pattern
offers its words once, twice, ... at rising costs (so repetition spreads before it deepens), and a
min-cost flow routes that capacity to the sources' quotas. What flows from a pattern says how often
all of its documents are taken, and what share of them, in a seeded order, once more.

Patterns whose source no other pattern has need no flow; with many of them targets and quotas are worked out as tables.
Only sums by pattern, and by pattern and hash bucket, are gathered; the order within a pattern is
never sorted as a whole: buckets are taken whole up to one that is cut, and only that one is sorted.

Null or empty text has size 0 and takes no part (taken 0, copies 0). A null source is a source of its own, last in
order. Equal rows are separate documents; rows that also share their id stand next to each other in the order. An empty table gives an empty result.
Extra columns are carried along, by `mix` all but those that have a name of its results, which it replaces, by `mixed_documents` all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import WORD, looked_up, materialise, small_side
from tessella.llm.merkle import numbered

WEIGHTS = (5, 2, 1)
LIMIT = 3
BUCKETS = 4096
#: Patterns that are planned on the driver; more are planned as tables.
FEW = 5_000
#: Patterns with sources in common that the driver routes then; more of these are an error.
PATTERNS = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], limit: float = LIMIT) -> list[float]:
    """Shares of the whole by weight; none above limit times its size, the excess going to the others by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(limit * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def route(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], limit: int = LIMIT) -> list[int]:
    """Words to take of each pattern: a min-cost maximum flow.

    The r-th copy of a pattern's words costs r squared each. Patterns that share sources, if only by way of others, are routed together; a
    pattern that shares none takes what its one source wants.
    """
    parent = list(range(len(quotas)))

    def find(s: int) -> int:
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for own in members:
        for s in own[1:]:
            parent[find(s)] = find(own[0])
    groups: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        if own:
            groups.setdefault(find(own[0]), []).append(p)
    out = [0] * len(sizes)
    for patterns in groups.values():
        if len(patterns) == 1 and len(members[patterns[0]]) == 1:
            p = patterns[0]
            out[p] = min(limit * sizes[p], quotas[members[p][0]])
        else:
            for p, flow in zip(patterns, _flow([sizes[p] for p in patterns], [members[p] for p in patterns], quotas, limit), strict=True):
                out[p] = flow
    return out


def _flow(sizes: list[int], members: list[Sequence[int]], quotas: Sequence[int], limit: int) -> list[int]:
    """The flow of patterns that belong together. Nodes: 0, patterns, sources, the last.

    Only what a copy costs differs between paths, so the cheapest paths are all that use first copies, then second ones, and so on: a
    maximum flow for each copy in turn, which keeps the flow before it, by blocking flows on shortest paths.
    """
    used = {s: 1 + len(sizes) + k for k, s in enumerate(sorted({s for own in members for s in own}))}
    end = 1 + len(sizes) + len(used)
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, capacity: int) -> int:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))
        return len(to) - 2

    first = [edge(0, 1 + p, 0) for p in range(len(sizes))]
    for p, own in enumerate(members):
        for s in own:
            edge(1 + p, used[s], limit * sizes[p])
    for s, node in used.items():
        edge(node, end, quotas[s])
    for _ in range(limit):
        for e, size in zip(first, sizes, strict=True):
            room[e] += size
        while True:
            level = [-1] * (end + 1)
            level[0], queue = 0, [0]
            for a in queue:
                for e in graph[a]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[end] < 0:
                break
            at, path, node = [0] * (end + 1), [], 0
            while True:  # a blocking flow: dead ends are left behind
                if node == end:
                    flow = min(room[e] for e in path)
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path.clear()
                    node = 0
                    continue
                for k in range(at[node], len(graph[node])):
                    e = graph[node][k]
                    if room[e] and level[to[e]] == level[node] + 1:
                        at[node] = k
                        path.append(e)
                        node = to[e]
                        break
                else:
                    at[node] = len(graph[node])
                    if not path:
                        break
                    node = to[path.pop() ^ 1]
                    at[node] += 1
    return [room[e ^ 1] for e in first]


def _few(spark, by_pattern: list, weights: Sequence[float], limit: int) -> DataFrame:
    """__key, source_size, target, __whole and __rest of each pattern: the flow is routed on the driver."""
    patterns = sorted(by_pattern, key=lambda r: [(x is None, x or "") for x in r[0]])
    names = sorted({x for r in patterns for x in r[0]}, key=lambda x: (x is None, x or ""))
    index = {x: i for i, x in enumerate(names)}
    members = [[index[x] for x in r[0]] for r in patterns]
    own = [sum(r["size"] for r, k in zip(patterns, members, strict=True) if i in k) for i in range(len(names))]
    weight = [weights[i % len(weights)] for i in range(len(names))]
    whole = sum(r["size"] for r in patterns)
    goal = targets(own, weight, limit) if whole == sum(own) else [g * whole / max(1, sum(own)) for g in targets(own, weight, limit)]
    flows = route([r["size"] for r in patterns], members, [round(g) for g in goal], limit)

    schema = T.StructType([T.StructField("__pattern", T.ArrayType(T.StringType())), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("__whole", T.LongType()), T.StructField("__rest", T.LongType())])
    plan = spark.createDataFrame([(r[0], own[k[0]] if k else 0, goal[k[0]] if k else 0.0, f // r["size"] if r["size"] else 0, f % r["size"] if r["size"] else 0) for r, k, f in zip(patterns, members, flows, strict=True)], schema)
    return plan.withColumn("__key", F.to_json(F.struct(F.col("__pattern").alias("p")))).drop("__pattern")


def _many(by_pattern: DataFrame, weights: Sequence[float], limit: int) -> DataFrame:
    """__key, source_size, target, __whole and __rest of each pattern, for any number of sources.

    by_pattern: __pattern and size, written. Sources are numbered and their targets found as tables: in each round those above the limit are fixed and the rest is shared by
    the others. Patterns whose source nobody shares need no flow; the driver routes the others, at most PATTERNS.
    """
    spark = by_pattern.sparkSession
    name = lambda c: F.coalesce(F.concat(F.lit("0"), c), F.lit("1"))  # noqa: E731  (null last)
    known = materialise(by_pattern.select("size", F.transform("__pattern", name).alias("names"), F.to_json(F.struct(F.col("__pattern").alias("p"))).alias("__key")), "patterns")
    own = known.select("size", F.explode("names").alias("name"), (F.size("names") > 1).alias("shared")).groupBy("name").agg(F.sum("size").alias("own"), F.bool_or("shared").alias("shared"))
    placed = numbered(own.withColumn("all", F.lit("")), "all", ["all", "name"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    goals = materialise(placed.select("name", "own", "shared", weight.alias("weight"), F.when(F.col("own") <= 0, 0.0).alias("goal")), "goals")
    whole, held = (float(x or 0) for x in (known.agg(F.sum("size")).first()[0], goals.agg(F.sum("own")).first()[0]))
    while True:
        open_ = goals.filter("goal IS NULL").agg(F.sum("weight").alias("w")).first()["w"]
        if not open_:
            break
        left = held - float(goals.agg(F.sum("goal")).first()[0] or 0)
        share = F.col("weight") * (left / open_)
        over = F.col("goal").isNull() & (share > limit * F.col("own"))
        if goals.filter(over).isEmpty():
            goals = materialise(goals.withColumn("goal", F.coalesce("goal", share)), "goals")
            break
        goals = materialise(goals.withColumn("goal", F.coalesce("goal", F.when(over, limit * F.col("own").cast("double")))), "goals")
    goals = goals.withColumn("goal", F.col("goal") * (whole / max(1.0, held)) if whole != held else F.col("goal"))
    first = known.withColumn("name", F.get("names", F.lit(0))).join(goals, "name", "left").withColumn("quota", F.bround("goal").cast("long"))
    first = materialise(first.withColumn("met", F.coalesce(F.col("shared"), F.lit(False)) | (F.size("names") > 1)), "quotas")
    alone = first.filter("NOT met").select("__key", F.coalesce("own", F.lit(0)).alias("source_size"), F.coalesce("goal", F.lit(0.0)).alias("target"), "size", F.coalesce(F.least(F.col("size") * limit, F.col("quota")), F.lit(0)).alias("flow"))
    met = first.filter("met").select("__key", "names", "size", "own", "goal").limit(PATTERNS + 1).collect()
    if len(met) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns that share sources")
    if met:
        met.sort(key=lambda r: r["names"])  # so that reruns agree
        quotas = {r["name"]: round(r["goal"]) for r in goals.join(F.broadcast(spark.createDataFrame([(n,) for n in {n for r in met for n in r["names"]}], "name string")), "name").orderBy("name").collect()}  # the sources of `met`
        index = {n: k for k, n in enumerate(quotas)}
        flows = route([r["size"] for r in met], [[index[n] for n in r["names"]] for r in met], list(quotas.values()), limit)
        schema = "__key string, source_size long, target double, size long, flow long"
        alone = alone.unionByName(spark.createDataFrame([(r["__key"], r["own"], r["goal"], r["size"], f) for r, f in zip(met, flows, strict=True)], schema))
    some = F.col("size") > 0
    return materialise(alone.select("__key", "source_size", "target", F.when(some, F.floor(F.col("flow") / F.col("size"))).otherwise(0).cast("long").alias("__whole"), F.when(some, F.col("flow") % F.col("size")).otherwise(0).cast("long").alias("__rest")), "plan")


def mix(docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """docs with size, sources (the pattern), taken and copies, source_size and target (of the first source).

    sources: an array of source names a document belongs to; by default its `source` alone.
    weights: given in turn to the sources by code point, null last. taken = copies * size.
    """
    spark = docs.sparkSession
    pattern = F.array(F.col("source")) if sources is None else F.array_sort(F.array_distinct(sources))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    key = F.to_json(F.struct(pattern.alias("p")))  # arrays that hold null compare as equal by this
    marks = {"__key": key, "__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "__order": order, "__bucket": F.pmod(order, F.lit(buckets)).cast("int")}
    sized = materialise(docs.select("doc_id", pattern.alias("__pattern"), *[c.alias(n) for n, c in marks.items()]), "sizes")
    totals = materialise(sized.groupBy("__pattern").agg(F.sum("__size").alias("size")), "totals")
    by_pattern = totals.limit(FEW + 1).collect()
    many = len(by_pattern) > FEW
    plan = _many(totals, weights, limit) if many else _few(spark, by_pattern, weights, limit)
    # buckets are whole below the one in which the remainder ends
    sums = sized.groupBy("__key", "__bucket").agg(F.sum("__size").alias("__in"))
    plan = small_side(plan)
    before = F.sum("__in").over(Window.partitionBy("__key").orderBy("__bucket")) - F.col("__in")
    cut = sums.withColumn("__before", before).join(plan.select("__key", "__rest"), "__key").filter((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__in") >= F.col("__rest")))
    cut = small_side(materialise(cut.select("__key", F.col("__bucket").alias("__cut"), (F.col("__rest") - F.col("__before")).alias("__left")), "cuts"))

    # within the cut bucket, documents are taken while more than half of one still fits
    at_cut = F.col("__bucket") == F.col("__cut")
    ranked = sized.join(cut, "__key").filter(at_cut & (F.col("__size") > 0)).groupBy("__key", "__order", "doc_id", "__left").agg(F.sum("__size").alias("__in"))
    upto = F.sum("__in").over(Window.partitionBy("__key").orderBy("__order", "doc_id"))
    edge = ranked.withColumn("__upto", upto).filter(F.col("__upto") - F.col("__in") / 2 <= F.col("__left")).groupBy("__key").agg(F.max(F.struct("__order", "doc_id")).alias("__last"))
    edge = small_side(materialise(edge, "edges"))
    keyed = docs.withColumns(marks | {"__pattern": pattern})
    sides = (plan, cut, edge)
    if many:  # what is decided by id and pattern is found without texts, a hot pattern's documents in many tasks; texts then meet it by id
        found = sized.select("doc_id", "__key").distinct()
        for side in sides:
            found = looked_up(found, side, ["__key"])
        same = keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["__key"] == found["__key"])
        keyed = keyed.join(found, same, "left").drop(found["doc_id"]).drop(found["__key"])
    else:
        for side in sides:
            keyed = keyed.join(side, "__key", "left")
    upto_last = (F.col("__order") < F.col("__last.__order")) | ((F.col("__order") == F.col("__last.__order")) & (F.coalesce(F.col("doc_id") <= F.col("__last.doc_id"), F.lit(True))))
    extra = F.coalesce((F.col("__bucket") < F.col("__cut")) | (at_cut & upto_last), F.lit(False)).cast("int")
    copies = F.when(F.col("__size") > 0, F.col("__whole") + extra).otherwise(0).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "sources", "taken", "copies", "source_size", "target")]
    return keyed.select(*kept, F.col("__size").alias("size"), F.col("__pattern").alias("sources"), "source_size", "target", (copies * F.col("__size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    taken = mix(docs.withColumns({f"__own_{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}), **options).filter("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)])
