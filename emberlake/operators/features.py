"""Features, graphs, belief fusion and small portfolio maths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.normalize import ratio, text_similarity
from emberlake.operators.windows import running_total


def temporal_graph_features(ticks: DataFrame) -> DataFrame:
    """Dense ids, z-scores, log volume, progress within the contract's life, hour on the circle."""
    s = ticks.groupBy("contract").agg(F.avg("usdc").alias("mu"), F.stddev_pop("usdc").alias("sd"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    u = running_total(ticks.select("wallet").distinct().withColumn("one", F.lit(1)), ["wallet"], {"u_id": "one"}).select("wallet", (F.col("u_id") - 1).cast("int").alias("u_id"))
    hour = F.pmod(F.floor(F.col("ts") / 3600), F.lit(24)) * (2 * math.pi / 24)
    x = ticks.join(s, "contract").join(u, "wallet")
    return x.select(
        "id", "u_id", ratio(F.col("usdc") - F.col("mu"), F.col("sd")).alias("z"), F.log1p("usdc").alias("log_usdc"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio((F.col("ts") - F.col("t0")).cast("double"), (F.col("t1") - F.col("t0")).cast("double")))).alias("progress"), F.sin(hour).alias("hour_sin"), F.cos(hour).alias("hour_cos"),
    )


def ml_vector(ticks: DataFrame, question: Column) -> DataFrame:
    day = F.floor(F.col("ts") / 86400)
    return ticks.select("id", F.log1p("usdc").alias("log_vol"), "price", F.pmod(F.floor(F.col("ts") / 3600), F.lit(24)).alias("hour"), (F.pmod(day + 3, F.lit(7)) + 1).alias("weekday"), F.size(F.split(question, " ")).alias("words"), (F.col("side") > 0).cast("int").alias("is_long"))


def topic_flags(texts: DataFrame, patterns: dict[str, str], column: str = "text") -> DataFrame:
    """Share of rows each pattern matches, and that any does."""
    hit = {n: F.coalesce(F.col(column).rlike(p), F.lit(False)).cast("int") for n, p in patterns.items()}
    any_hit = F.greatest(*hit.values()) if len(hit) > 1 else next(iter(hit.values()))
    s = texts.agg(F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in hit.items()), F.sum(any_hit).alias("any"))
    names = [*hit, "any"]
    return s.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + ") as (topic, hits)"), "n").withColumn("coverage", F.col("hits") / F.col("n"))


def hyperedges(trades: DataFrame, entity_of: DataFrame) -> DataFrame:
    """Wallet x entity weights: log1p of the money moved."""
    return trades.join(entity_of, "contract_id").groupBy("wallet", "entity").agg(F.log1p(F.sum(F.abs("usdc"))).alias("weight"))


def co_members(edges: DataFrame, a: str, via: str, block: int = 500) -> DataFrame:
    """Pairs of ``a`` that share a ``via``, with the number shared. Members with the same set of vias are one class: classes are compared with each
    other, and their pairs written out by blocks of about ``block`` members, so work is that of the classes and of the pairs that are returned."""
    e = edges.select(F.col(a).alias("a"), F.col(via).alias("via")).where("a is not null and via is not null").distinct()
    own = e.groupBy("a").agg(F.array_sort(F.collect_list("via")).alias("set"))
    classes = own.groupBy("set").agg(F.min("a").alias("c"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    members = own.join(classes, "set").groupBy("c", part.alias("i")).agg(F.collect_list("a").alias("as"))
    x = classes.select("c", "blocks", F.explode("set").alias("via"))
    y = x.toDF("d", "others", "via")
    pairs = x.join(y, "via").where("c <= d").groupBy("c", "d").agg(F.count("*").alias("shared"), F.max("blocks").alias("blocks"), F.max("others").alias("others"))
    pairs = pairs.withColumn("i", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("j", F.explode(F.expr("sequence(if(c = d, i, 0), others - 1)")))
    both = pairs.select("c", "d", "i", "j", "shared").join(members, ["c", "i"]).join(members.toDF("d", "j", "bs"), ["d", "j"])
    # a few rows make very many: dealt to a fixed number of tasks, which adaptive execution would put together
    dealt = both.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c", "i", "d", "j")
    out = dealt.select("c", "i", "d", "j", "shared", F.explode("as").alias("a"), "bs").select("c", "i", "d", "j", "shared", "a", F.explode("bs").alias("b"))
    return out.where("c <> d or i <> j or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")


def path_features(ticks: DataFrame, key: str, back: dict[str, int], reach: int) -> DataFrame:
    """id, for each name of ``back`` the price less the last price at or before so many seconds ago, and ``down``, the highest price of the last
    ``reach`` seconds less the price. Of several rows at a time the one with the largest id stands for it in the look back. ticks: id, ts, price and the key.

    Prices come again as marks, moved on by the look back; time is cut into spans of ``reach`` seconds, and marks and rows of a span are sorted up for the
    last and highest so far, and down for what is left of the span before. Work is linear apart from these sorts; no task holds all of a key."""
    t = ticks.select("id", F.col(key).alias("key"), "ts", "price")
    known = F.col("key").isNotNull() & F.col("ts").isNotNull()
    prices = t.where(known & F.col("price").isNotNull()).groupBy("key", "ts").agg(F.max("price").alias("high"), F.max(F.when(F.col("id").isNotNull(), F.struct("id", "price")))["price"].alias("last"))
    mark = lambda s, name: F.struct((F.col("ts") + s).alias("at"), F.when(F.lit(name == "down"), F.col("high")).alias("left"), *(F.when(F.lit(n == name) & F.col("last").isNotNull(), F.struct("ts", "last")).alias(n) for n in back))
    marks = prices.select("key", F.explode(F.array(mark(reach, "down"), *(mark(s, n) for n, s in back.items()))).alias("m")).select("key", "m.*", F.lit(False).alias("own"))
    u = t.where(known).select("key", F.col("ts").alias("at"), "id", "price", F.lit(True).alias("own")).unionByName(marks, allowMissingColumns=True)
    u = u.withColumn("span", F.floor(F.col("at") / reach))
    w = Window.partitionBy("key", "span")
    up, down = w.orderBy("at"), w.orderBy(F.desc("at"))
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carry = u.groupBy("key", "span").agg(*(F.max(n).alias(n) for n in back)).select("key", "span", *(F.max(n).over(before).alias(f"_{n}") for n in back))
    x = u.withColumns({**{n: F.max(n).over(up) for n in back}, "high": F.max("price").over(up)}).withColumn("left", F.max("left").over(down)).where("own").join(carry, ["key", "span"])
    out = x.select("id", *((F.col("price") - F.coalesce(n, f"_{n}")["last"]).alias(n) for n in back), (F.greatest("high", "left") - F.col("price")).alias("down"))
    none = F.lit(None).cast("double")
    return out.unionByName(t.where(~known).select("id", *(none.alias(n) for n in back), none.alias("down")))


def hops(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """Nodes reached from each start over 1 .. ``most`` edges (a, b), with the number of paths. starts: start."""
    e = edges.select("a", "b").distinct()
    now = starts.select("start", F.col("start").alias("a")).withColumn("paths", F.lit(1).cast("long"))
    out = []
    for hop in range(1, most + 1):
        now = now.join(e, "a").groupBy("start", "b").agg(F.sum("paths").alias("paths")).withColumnRenamed("b", "a")
        out.append(now.select("start", F.lit(hop).alias("hop"), F.col("a").alias("node"), "paths"))
    x = out[0]
    for y in out[1:]:
        x = x.unionByName(y)
    return x


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """Brute-force cosine neighbours of a stated set of query vectors against all rows: a broadcast and a pass over the
    vectors for each ``block`` of queries, of which every batch of vectors gives its best k. The similarity of zero
    vectors, of nulls and of vectors of different lengths is null."""
    from functools import reduce

    import numpy as np
    import pyarrow as pa

    sc = vectors.sparkSession.sparkContext
    vectors, queries = vectors.where("vec_id is not null"), queries.where("vec_id is not null")

    def by_length(ids, embeddings):
        """length to (ids, unit vectors); vectors without a direction have length 0 and no columns."""
        held: dict[int, tuple[list, list]] = {}
        for i, e in zip(ids, embeddings, strict=True):
            x = np.zeros(0) if e is None or any(v is None for v in e) else np.array(e, float)
            norm = np.sqrt(x @ x)
            x = x / norm if norm else x[:0]
            own = held.setdefault(len(x), ([], []))
            own[0].append(i)
            own[1].append(x)
        return {n: (np.array(i, np.int64), np.array(x)) for n, (i, x) in held.items()}

    def one(shared):
        def search(batches):
            for batch in batches:
                rows = by_length(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                ids = np.concatenate([i for i, _ in rows.values()]) if rows else np.zeros(0, np.int64)
                for n, (q_ids, q) in shared.value.items():
                    for lo in range(0, len(q_ids), 256):
                        s = np.concatenate([q[lo : lo + 256] @ x.T if n and n == m else np.full((len(q_ids[lo : lo + 256]), len(i)), -np.inf) for m, (i, x) in rows.items()], axis=1)
                        out = []
                        for q_id, own in zip(q_ids[lo : lo + 256].tolist(), s, strict=True):
                            at = np.flatnonzero(ids != q_id)
                            near = np.round(own[at], 9)
                            if len(at) > k:
                                most = np.flatnonzero(near >= np.partition(near, len(at) - k)[len(at) - k])
                                at, near = at[most], near[most]
                            at = at[np.lexsort((ids[at], -near))[:k]]
                            out.append((np.full(len(at), q_id), ids[at], own[at]))
                        q_id, vec_id, similarity = (np.concatenate(c) for c in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(q_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(similarity, pa.float64(), mask=np.isinf(similarity))], ["q_id", "vec_id", "similarity"])

        return vectors.select("vec_id", "embedding").mapInArrow(search, "q_id long, vec_id long, similarity double")

    blocks = 1 + queries.count() // block
    found = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "embedding").collect()
        found.append(one(sc.broadcast(by_length([r[0] for r in rows], [r[1] for r in rows]))))
    w = Window.partitionBy("q_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    x = reduce(DataFrame.unionByName, found)
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "rank", "vec_id", "similarity")


def best_alias(names: DataFrame, aliases: DataFrame, least: float = 0.9) -> DataFrame:
    """The most similar alias of each name by edit distance, none missed. A name with at most d edits to any alias long
    enough is cut into d + 1 pieces, of which one is left whole and stands in the alias at most d places off: only pairs that
    share such a piece are compared. Equal texts are compared once, an alias under its smallest id."""
    edits = lambda n: f"cast(floor({1 - least!r} * floor({n} / {least!r} + 1e-6) + 1e-6) as int)"
    start, stop = "cast(floor(i * n / (d + 1)) as int)", "cast(floor((i + 1) * n / (d + 1)) as int)"
    n = names.where("name is not null").select("name").distinct().select("name", F.length("name").alias("n")).selectExpr("*", f"{edits('n')} as d")
    n = n.selectExpr("*", "explode(sequence(0, d)) as i").selectExpr("name", "n", "i", f"substring(name, {start} + 1, {stop} - {start}) as piece")
    a = aliases.where("alias is not null").groupBy("alias").agg(F.min("alias_id").alias("alias_id")).withColumn("m", F.length("alias"))
    a = a.selectExpr("*", f"explode(sequence(cast(ceil({least!r} * m - 1e-6) as int), cast(floor(m / {least!r} + 1e-6) as int))) as n").selectExpr("*", f"{edits('n')} as d")
    a = a.selectExpr("*", "explode(sequence(0, d)) as i").selectExpr("*", "explode(sequence(-d, d)) as shift", f"{start} as a", f"{stop} as b")
    a = a.where("a + shift >= 0 and b + shift <= m").selectExpr("alias_id", "alias", "n", "i", "substring(alias, a + shift + 1, b - a) as piece").distinct()
    x = n.join(a, ["n", "i", "piece"]).withColumn("similarity", text_similarity(F.col("name"), F.col("alias"))).where(F.col("similarity") >= least)
    best = lambda x, key: x.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "alias_id"))).where("rn = 1").drop("rn")
    found = best(x.select("name", "alias_id", "similarity"), "name")
    return best(names.select("name_id", "name").join(found, "name"), "name_id").select("name_id", "alias_id", "similarity")


def beta_from_interval(mean: Column, low: Column, high: Column) -> dict[str, Column]:
    """Beta parameters of a mean and its interval, which is four deviations wide. A mean of 0 or 1 is certain (one parameter infinite);
    what does not fit together (a mean outside [0, 1] or its interval, no width, more variance than the mean allows) is the weak prior (1, 1)."""
    sd = (high - low) / 4
    var = sd * sd
    weak = F.coalesce(~mean.between(0, 1) | ~((low >= 0) & (low <= mean) & (mean <= high) & (high <= 1)) | (sd == 0) | (mean * (1 - mean) < var), F.lit(True))
    nu = mean * (1 - mean) / F.nullif(var, F.lit(0.0)) - 1
    nu = F.when(nu <= 0, 1e-6).otherwise(nu)
    pick = lambda at_0, at_1, fit: F.when(mean == 0, at_0).when(mean == 1, at_1).when(weak, 1.0).otherwise(fit)
    sure = float("inf")
    return {"alpha": pick(1.0, sure, mean * nu), "beta": pick(sure, 1.0, (1 - mean) * nu)}


def beta_from_brier(mean: Column, brier: Column) -> dict[str, Column]:
    nu = F.greatest(mean * (1 - mean) / F.greatest(brier, F.lit(1e-6)) - 1, F.lit(1e-6))
    return {"alpha": mean * nu, "beta": (1 - mean) * nu}


def fuse_betas(a1: Column, b1: Column, a2: Column, b2: Column) -> dict[str, Column]:
    """One infinite parameter decides: mean 1 or 0, no variance."""
    a = F.greatest(1 + (a1 - 1) + (a2 - 1), F.lit(1e-3))
    b = F.greatest(1 + (b1 - 1) + (b2 - 1), F.lit(1e-3))
    sure_a, sure_b = a == float("inf"), b == float("inf")
    mean = F.when(sure_a & sure_b, 0.5).when(sure_a, 1.0).when(sure_b, 0.0).otherwise(a / (a + b))
    return {"alpha": a, "beta": b, "mean": mean, "variance": F.when(sure_a | sure_b, 0.0).otherwise(a * b / ((a + b) * (a + b) * (a + b + 1)))}


def kelly_cap(bets: DataFrame, most: float = 0.15) -> DataFrame:
    """Scales fractions of each cluster so their sizes add up to ``most`` at the most."""
    total = F.sum(F.abs("fraction")).over(Window.partitionBy("cluster"))
    return bets.withColumn("capped", F.col("fraction") * F.least(F.lit(1.0), ratio(F.lit(most), total)))


def kelly_cluster(bets: DataFrame, rho: float = 0.2, most: float | None = None) -> DataFrame:
    """Fractions C^-1 E per cluster (cluster, id, edge, variance), where C has the bets' variances and equal correlations; its inverse is known in closed
    form, so two sums over the cluster are enough. ``most``: the sizes of a cluster are scaled to add up to no more than it."""
    sd = F.sqrt("variance")
    w = Window.partitionBy("cluster")
    score = F.col("edge") / sd
    share = rho / (1 - rho + rho * F.count("*").over(w)) * F.sum(score).over(w)
    out = bets.select("cluster", "id", ((score - share) / (sd * (1 - rho))).alias("fraction"))
    if most is None:
        return out
    return out.withColumn("fraction", F.col("fraction") * F.least(F.lit(1.0), ratio(F.lit(most), F.sum(F.abs("fraction")).over(w))))


def covariance(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariances of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    s = rows.agg(*(F.covar_samp(a, b).alias(f"{a}__{b}") for a, b in pairs))
    return s.select(F.expr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', {a}__{b}" for a, b in pairs) + ") as (a, b, cov)"))


def shrunk_covariance(rows: DataFrame, columns: list[str]) -> tuple[list[list[float]], float, float]:
    """Ledoit-Wolf shrinkage of the covariance matrix (by n) to constant correlation: matrix, mean correlation, intensity. Two passes; their sums, a
    fixed number for each pair of columns, come to the driver."""
    import numpy as np

    means = rows.agg(F.count("*").alias("t"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
    t, n = means["t"], len(columns)
    x = [F.col(c) - F.lit(means[f"m{i}"]) for i, c in enumerate(columns)]
    sums = [F.sum(f(x[i], x[j])) for f in (lambda a, b: a * b, lambda a, b: a * a * b * b, lambda a, b: a * a * a * b) for i in range(n) for j in range(n)]
    cov, fourth, third = np.array(rows.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first(), float).reshape(3, n, n) / t
    sd = np.sqrt(np.diag(cov))
    scale = np.outer(sd, sd)
    mean = ((cov / scale).sum() - n) / (n * (n - 1)) if n > 1 else 0.0
    target = mean * scale
    np.fill_diagonal(target, sd * sd)
    spread = fourth - cov * cov  # variance of each covariance
    with_target = third - np.diag(cov)[:, None] * cov
    np.fill_diagonal(with_target, 0)
    shared = np.diag(spread).sum() + mean * ((1 / sd)[:, None] * sd[None, :] * with_target).sum()
    apart = ((cov - target) ** 2).sum()
    intensity = float(max(0.0, min(1.0, (spread.sum() - shared) / apart / t))) if apart > 0 else 0.0
    return (intensity * target + (1 - intensity) * cov).tolist(), float(mean), intensity
