"""Queries on replays, daily runs, first bets, gates, summaries and small table operations."""

from pyspark.sql import functions as F

from emberlake.functions.normalize import ratio
from emberlake.operators import bayes, execution, frames, fresh, intervals, markets as mk, signals, simulate
from emberlake.plans.registry import query, r6
from emberlake.plans.views import MARKETS, TICKS, TRADES, markets, register, table, ticks, trades

_W = f"WITH {TICKS}"
_NOW, _SINCE = 1_000_500_000, 980_000_000


@query(f"""WITH {TRADES}, {MARKETS}, x AS (SELECT t.*, outcome, greatest(0e0, least(1e0, price)) AS p, CASE WHEN tokens > 0 THEN usdc ELSE abs(tokens) * (1 - greatest(0e0, least(1e0, price))) END AS risk,
  wallet * 1000003 + order_id AS id FROM trades t JOIN markets USING (contract_id) WHERE outcome IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts, order_id, contract_id, usdc, tokens) AS n FROM x WHERE risk > 1), g AS (SELECT *, greatest(1e-6, least(1 - 1e-6, price)) AS q FROM f WHERE n = 1)
SELECT wallet, round(risk, 6) AS risk, round(ln(1 + risk), 6) AS log_vol, round(CASE WHEN tokens > 0 THEN (outcome - q) / q ELSE (q - outcome) / (1 - q) END, 6) AS roi, CASE WHEN tokens > 0 THEN outcome > 0.5 ELSE outcome < 0.5 END AS won FROM g""")
def q10b_first_bet(spark, sf):
    t = trades(spark, sf).withColumn("id", F.struct("order_id", "contract_id", "usdc", "tokens"))
    return fresh.first_bet(t, markets(spark, sf)).select("wallet", *r6(risk="risk", log_vol="log_vol", roi="roi"), "won")


def _bets(spark, sf):
    """Ticks as first bets: won more often at high prices."""
    i = F.col("id")
    return ticks(spark, sf).select("id", F.log1p("usdc").alias("log_vol"), "price", ((i * 31) % 97 / 97.0 < 0.2 + 0.6 * F.col("price")).cast("double").alias("won"), F.log1p(((i * 7919) % 900000) / 3600.0).alias("log_ttr"))


@query()
def q10c_cold_start_logit(spark, sf):
    """The four parameters of the first-bet model."""
    fit = fresh.logit(_bets(spark, sf), "won", ["log_vol", "price", "log_ttr"])
    return spark.createDataFrame([(n, round(b, 6)) for n, b in zip(("const", "log_vol", "price", "log_ttr"), fit, strict=True)], "name string, value double")


@query()
def q10d_boosted(spark, sf):
    """How often the boosted trees are right, on bets they did not learn from."""
    b = _bets(spark, sf)
    model = fresh.boosted(b.where("id % 4 <> 0"), "won", ["log_vol", "price", "log_ttr"])
    return model.transform(b.where("id % 4 = 0")).groupBy("won").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("won")).cast("double")).alias("right"))


@query()
def q11b_brier_line(spark, sf):
    t = ticks(spark, sf).select("wallet", "usdc", F.col("side").alias("tokens"), F.when((F.col("id") * 17) % 100 < 50 + F.log1p("usdc") * 5, (F.col("side") > 0).cast("double")).otherwise((F.col("side") < 0).cast("double")).alias("outcome"), F.col("ts").alias("resolved_at"))
    slope, intercept = fresh.brier_line(t, t.where("wallet < 20").select("wallet"))
    return spark.createDataFrame([(round(slope, 6), round(intercept, 6))], "slope double, intercept double")


@query(f"""{_W}, s AS (SELECT id, contract, ts, sum(usdc * side) OVER (PARTITION BY contract ORDER BY ts, id ROWS UNBOUNDED PRECEDING) / 10 AS w, price, (id % 9 - 2)::DOUBLE AS days FROM ticks),
e AS (SELECT *, 0.5 + 0.49 * tanh(w / 5000) - price AS edge FROM s), t AS (SELECT *, days > 0 AND abs(edge) >= 0.05 AND price BETWEEN 0.02 AND 0.98 AS hit FROM e),
m AS (SELECT *, row_number() OVER (PARTITION BY contract, ts // 60 ORDER BY ts, id) AS n FROM t WHERE hit)
SELECT id, CASE WHEN abs(w) > 1000 THEN 'BUY' ELSE 'NONE' END AS entry, w < 500 AS leave_yes, w > -500 AS leave_no FROM m WHERE n = 1""")
def q16b_triggers(spark, sf):
    s = ticks(spark, sf).withColumns({"w": F.sum(F.col("usdc") * F.col("side")).over(signals.running(None, "contract")) / 10, "days": (F.col("id") % 9 - 2).cast("double")})
    hit = s.where(signals.edge_trigger(signals.edge_tanh(F.col("w"), F.col("price")), F.col("price"), F.col("days")))
    w = F.col("w")
    return signals.one_a_minute(hit).select("id", signals.entry_signal(w, 1000.0).alias("entry"), signals.smart_exit(F.lit("YES"), w, 1000.0, 0.5).alias("leave_yes"), signals.smart_exit(F.lit("NO"), w, 1000.0, 0.5).alias("leave_no"))


@query(f"""WITH {TRADES}, {MARKETS}, x AS (SELECT t.ts, started_at AS st, CASE WHEN contract_id % 3 <> 0 THEN started_at + 200000000 END AS en, CASE WHEN outcome IS NOT NULL THEN started_at + 150000000 END AS res FROM trades t JOIN markets USING (contract_id))
SELECT coalesce(ts >= st, true) AND coalesce(ts <= en, true) AS alive, coalesce(ts < res, true) AS open, count(*) AS n FROM x GROUP BY ALL""")
def q03b_life_gates(spark, sf):
    st = F.col("started_at")
    m = markets(spark, sf).select("contract_id", st.alias("st"), F.when(F.col("contract_id") % 3 != 0, st + 200_000_000).alias("en"), F.when(F.col("outcome").isNotNull(), st + 150_000_000).alias("res"))
    x = trades(spark, sf).select("contract_id", "ts").join(m, "contract_id")
    return x.select(mk.in_life(F.col("ts"), F.col("st"), F.col("en")).alias("alive"), mk.before_resolution(F.col("ts"), F.col("res")).alias("open")).groupBy("alive", "open").agg(F.count("*").alias("n"))


@query(f"""WITH {MARKETS}, l AS (SELECT DISTINCT market_id, brand || substr(kind, 1, market_id % 4 * 3) AS entity FROM markets WHERE contract_id % 7 <> 0), k AS (SELECT entity, count(*) AS n FROM l GROUP BY entity),
c AS (SELECT market_id, min(n) AS least FROM l JOIN k USING (entity) GROUP BY market_id), m AS (SELECT market_id, max(liquidity) * 7 AS liq FROM markets GROUP BY market_id)
SELECT market_id, liq > 10000 OR coalesce(least < 5, false) AS review, CASE WHEN least IS NULL THEN 'no entities' WHEN liq > 10000 OR least < 5 THEN 'review' ELSE 'linked' END AS state FROM m LEFT JOIN c USING (market_id)""")
def q24b_review(spark, sf):
    m = markets(spark, sf)
    links = m.where("contract_id % 7 <> 0").selectExpr("market_id", "concat(brand, substr(kind, 1, cast(market_id % 4 * 3 as int))) as entity")
    return mk.needs_review(m.groupBy("market_id").agg((F.max("liquidity") * 7).alias("liquidity")), links)


@query("""WITH r AS (SELECT o_custkey % 20 AS book, (o_orderkey * 7919) % 20000 AS lo, (o_orderkey * 7919) % 20000 + o_custkey % 40 AS hi FROM orders WHERE o_custkey % 20 <> 3), b AS (SELECT unnest(range(20)) AS book),
a AS (SELECT *, max(hi) OVER (PARTITION BY book ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r WHERE hi >= 0 AND lo <= 20100),
g AS (SELECT book, greatest(coalesce(m, -1) + 1, 0) AS lo, lo - 1 AS hi FROM a WHERE lo > coalesce(m, -1) + 1 UNION ALL SELECT book, max(hi) + 1, 20100 FROM a GROUP BY book HAVING max(hi) < 20100 UNION ALL SELECT book, 0, 20100 FROM b WHERE book NOT IN (SELECT book FROM a))
SELECT b.book, CAST(coalesce(sum(hi - lo + 1), 0) AS BIGINT) AS missing, count(lo) AS gaps, count(lo) = 0 AS complete FROM b LEFT JOIN g USING (book) GROUP BY b.book""")
def q28b_completeness(spark, sf):
    lo = (F.col("o_orderkey") * 7919) % 20000
    held = table(spark, sf, "orders").where("o_custkey % 20 <> 3").select((F.col("o_custkey") % 20).alias("book"), lo.alias("lo"), (lo + F.col("o_custkey") % 40).alias("hi"))
    books = spark.range(20).select(F.col("id").alias("book"))
    return intervals.completeness(held, books, 0, 20100, "book")


@query(f"""{_W}, f AS (SELECT contract, ts, min(id) AS id FROM ticks WHERE id % 7 = 0 GROUP BY ALL) SELECT t.id AS order_id, arg_min(f.ts, f.ts) AS ts_next, arg_min(f.id, f.ts) AS id FROM ticks t LEFT JOIN f ON f.contract = t.contract AND f.ts >= t.ts GROUP BY t.id""")
def q34b_asof_forward(spark, sf):
    t = ticks(spark, sf)
    o = t.select(F.col("id").alias("order_id"), "contract", "ts")
    return execution.asof_forward(o, t.where("id % 7 = 0").select("contract", "ts", "id"), "contract", "ts", "id").select("order_id", "ts_next", "id")


@query(f"""{_W}, b AS (SELECT contract, max(price) AS bid FROM ticks WHERE id % 10 = 0 GROUP BY 1 HAVING contract <> 'view'), l AS (SELECT contract, arg_max(price, id) AS last FROM ticks WHERE contract <> 'click' GROUP BY 1), a AS (SELECT contract, sum(usdc) / sum(usdc / price) AS cost FROM ticks GROUP BY 1)
SELECT contract, round(coalesce(bid, last, cost), 6) AS mark FROM a LEFT JOIN b USING (contract) LEFT JOIN l USING (contract)""")
def q39d_mark_price(spark, sf):
    t = ticks(spark, sf)
    b = t.where("id % 10 = 0 and contract <> 'view'").groupBy("contract").agg(F.max("price").alias("bid"))
    l = t.where("contract <> 'click'").groupBy("contract").agg(F.max_by("price", "id").alias("last"))
    a = t.groupBy("contract").agg((F.sum("usdc") / F.sum(F.col("usdc") / F.col("price"))).alias("cost"))
    return a.join(b, "contract", "left").join(l, "contract", "left").select("contract", *r6(mark=execution.mark_price(F.col("bid"), F.col("last"), F.col("cost"))))


def _portfolio(spark, sf):
    i, t = F.col("id"), F.col("ts")
    return ticks(spark, sf).select(
        F.lit(0).alias("config"), "id", "ts", (F.col("wallet") % 60).cast("long").alias("contract"), (F.floor(F.col("wallet") % 60 / 2)).cast("long").alias("market"), "price", (F.col("usdc") > 40).alias("signal"), F.col("usdc").alias("priority"),
        F.when(F.col("wallet") % 60 % 7 != 0, (F.col("wallet") % 2).cast("double")).alias("outcome"), F.when(F.col("wallet") % 60 % 11 != 0, F.lit(1704067200).cast("long") + (F.col("wallet") % 60) * 40000).alias("end"),
    )


@query()
def q44_replay(spark, sf):
    return simulate.portfolio_replay(_portfolio(spark, sf), simulate.PortfolioParams(bank=1500.0, required=2))


@query()
def q44c_drained(spark, sf):
    x = _portfolio(spark, sf)
    m = x.groupBy("contract").agg(F.max("outcome").alias("outcome"), F.max("end").alias("end"))
    last = x.groupBy("contract").agg(F.max_by("price", F.struct("ts", "id")).alias("price"))
    done = simulate.drained(q44_replay(spark, sf), m, last, 1704067200 + 45 * 40000)
    return done.groupBy("state", "won").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def _signal_rows(spark, sf):
    t = ticks(spark, sf)
    w = ratio(F.sum(F.col("usdc") * F.col("side")).over(signals.running(None, "contract")), F.col("usdc"))  # no money, no signal
    return t.select(
        F.lit(0).alias("config"), "id", "ts", (F.col("wallet") % 90).alias("market"), w.alias("signal"), "price", (F.col("id") % 2 == 0).alias("is_yes"), (F.col("wallet") % 90 % 3 == 0).cast("double").alias("outcome"),
        (F.col("ts") + 86400 * (1 + F.col("wallet") % 5)).alias("end"), (F.col("wallet") % 10 < 3).alias("elite"), F.col("side").cast("double").alias("tokens"), F.col("wallet").alias("contract"), ((F.col("id") * 53 % 40) / 100.0).alias("variance"),
        (F.col("usdc") / 100 - 1).alias("margin"), (F.col("wallet") % 8 == 0).alias("hostile"),
    )


@query()
def q44d_signal_replay(spark, sf):
    return simulate.signal_replay(_signal_rows(spark, sf), simulate.SignalParams(bank=500.0, most=100.0, share=0.2))


@query()
def q44e_copy_replay(spark, sf):
    return simulate.copy_replay(_signal_rows(spark, sf), simulate.SignalParams(bank=500.0, most=100.0, share=0.2))


@query()
def q44f_entry_replay(spark, sf):
    return simulate.entry_replay(_signal_rows(spark, sf), simulate.EntryParams(bank=900.0, most_price=0.3, take_profit=0.9))


def _event_rows(spark, sf):
    t = ticks(spark, sf).select("id", "ts", (F.col("wallet") % 40).alias("contract"), "price", F.col("usdc").alias("volume"), (F.col("side") < 0).alias("sell"), ((F.col("wallet") % 30) / 100.0).alias("skill"))
    end = t.groupBy("contract").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("contract", F.col("a").alias("first"), (F.col("b") - 86400).alias("end"))
    one = lambda kind, at: end.select(F.lit(kind).alias("kind"), F.col(at).alias("ts"), "contract", F.lit(0).cast("long").alias("id"))
    trade = t.withColumn("kind", F.lit("TRADE")).join(end.select("contract", "end"), "contract")
    result = F.when(F.col("contract") % 5 == 0, 0.5).otherwise((F.col("contract") % 2).cast("double"))
    return frames.union_by_name(trade, one("NEW", "first"), one("RESOLUTION", "end").withColumn("outcome", result))


@query()
def q44g_event_replay(spark, sf):
    return simulate.event_replay(_event_rows(spark, sf).withColumn("config", F.lit(0)), simulate.EventParams(splash=2000.0, stop_loss=0.4, smart_exit=0.5))


@query()
def q45_grid_tuning(spark, sf):
    return simulate.tune(_event_rows(spark, sf), [1000.0, 2000.0, 4000.0], [0.1, 0.25, 0.5], [0.05, 0.1, 0.2])


@query(f"""{_W}, p AS (SELECT contract, min(ts) AS ts, arg_min(price, id) AS a FROM ticks GROUP BY contract), x AS (SELECT p.contract, p.ts, t.id, t.ts AS "at", t.price AS "now", (t.price - a) / a AS gain FROM p JOIN ticks t ON t.contract = p.contract AND t.ts > p.ts)
SELECT contract, ts, id, "at", "now", round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY "at", id) AS n FROM x WHERE gain < -0.3 OR gain > 0.4) WHERE n = 1""")
def q45c_stop_take(spark, sf):
    t = ticks(spark, sf)
    p = t.groupBy("contract").agg(F.min("ts").alias("ts"), F.min_by("price", "id").alias("avg_price"))
    return simulate.exits(p, t, 0.3, 0.4).select("contract", "ts", "id", "at", "now", *r6(gain="gain"))


@query(f"""WITH {TRADES}, {MARKETS}, m AS (SELECT contract_id, CASE WHEN contract_id % 4 <> 0 THEN outcome END AS outcome, started_at AS st, CASE WHEN contract_id % 6 <> 0 THEN started_at + 201000000 END AS en FROM markets WHERE contract_id % 13 <> 0),
h AS (SELECT contract_id, count(*) AS rows FROM trades WHERE ts <= {_SINCE} GROUP BY 1),
a AS (SELECT CASE WHEN m.outcome IS NOT NULL THEN 'resolve' WHEN m.contract_id IS NULL OR coalesce(en < {_NOW} - 864000, false) THEN 'purge' ELSE 'carry' END AS action, h.contract_id, rows FROM h LEFT JOIN m ON m.contract_id = h.contract_id)
SELECT * FROM a UNION ALL SELECT 'ingest', t.contract_id, count(*) FROM trades t JOIN m USING (contract_id) WHERE ts > {_SINCE} AND price BETWEEN 0 AND 1 AND coalesce(ts >= st, true) AND coalesce(ts <= en, true) GROUP BY t.contract_id""")
def q55d_daily_delta(spark, sf):
    t, st, k = trades(spark, sf), F.col("started_at"), F.col("contract_id")
    m = markets(spark, sf).where("contract_id % 13 <> 0").select("contract_id", F.when(k % 4 != 0, F.col("outcome")).alias("outcome"), st.alias("start"), F.when(k % 6 != 0, st + 201_000_000).alias("end"))
    return bayes.daily_delta(t.where(F.col("ts") <= _SINCE), m, t, _NOW, _SINCE)


@query(f"""WITH {TRADES}, {MARKETS}, m AS (SELECT contract_id, CASE WHEN contract_id % 6 <> 0 THEN started_at + 201000000 END AS en FROM markets), l AS (SELECT contract_id, max(ts) AS last FROM trades GROUP BY 1)
SELECT DISTINCT contract_id FROM trades JOIN m USING (contract_id) LEFT JOIN l USING (contract_id) WHERE coalesce(en < {_NOW} - 864000, false) OR (en IS NULL AND coalesce(last < {_NOW} - 864000, false))""")
def q55e_orphans(spark, sf):
    t = trades(spark, sf)
    m = markets(spark, sf).select("contract_id", F.when(F.col("contract_id") % 6 != 0, F.col("started_at") + 201_000_000).alias("end"))
    return bayes.orphans(t, m.join(t.groupBy("contract_id").agg(F.max("ts").alias("last_ts")), "contract_id", "left"), _NOW)


@query(f"""{_W} SELECT id, (side > 0) <> (id % 3 = 1) AS yes, round(CASE WHEN id % 4 = 0 THEN least(5e0, 1 + 20 * abs(1 / (1 + exp(-(0.1 + 0.2 * ln(1 + usdc) - 0.3 * price + 0.05 * ln(1 + (id % 50))))) - price)) ELSE 1 / (least(1e0, 0.2 + 0.5 / sqrt(id % 4)) + 0.01) END, 6) AS trust FROM ticks""")
def q54b_side_and_trust(spark, sf):
    n = F.col("id") % 4
    t = bayes.trust(0.2 * n, n, F.col("usdc"), F.col("price"), (F.col("id") % 50).cast("double"), [0.1, 0.2, -0.3, 0.05])
    return ticks(spark, sf).select("id", bayes.effective_yes(F.col("side") > 0, F.col("id") % 3 == 1).alias("yes"), *r6(trust=t))


@query("""WITH x AS (SELECT p_partkey, (p_partkey % 7 - 3) / 10e0 AS a, (p_size - 25) / 50e0 AS b, (p_partkey % 11) / 30e0 - 0.05 AS c FROM part)
SELECT p_partkey, a <= 0 AND c >= -0.02 AND a + b + c >= -0.02 AND a / 4 + b / 2 + c > 0.001 AND a / 4 + b / 2 + c <= 0.35 AS valid FROM x""")
def q55f_valid_fit(spark, sf):
    a, b, c = (F.col("p_partkey") % 7 - 3) / 10.0, (F.col("p_size") - 25) / 50.0, (F.col("p_partkey") % 11) / 30.0 - 0.05
    return table(spark, sf, "part").select("p_partkey", bayes.valid_variance_fit(a, b, c).alias("valid"))


@query(f"""{_W} SELECT name, n, round(mean, 5) AS mean, round(sd, 5) AS sd, least, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, most FROM (
 SELECT 'usdc' AS name, count(usdc) AS n, avg(usdc) AS mean, stddev_samp(usdc) AS sd, min(usdc) AS least, quantile_cont(usdc, 0.25) AS q25, quantile_cont(usdc, 0.5) AS q50, quantile_cont(usdc, 0.75) AS q75, max(usdc) AS most FROM ticks
 UNION ALL SELECT 'price', count(price), avg(price), stddev_samp(price), min(price), quantile_cont(price, 0.25), quantile_cont(price, 0.5), quantile_cont(price, 0.75), max(price) FROM ticks)""")
def q57b_describe(spark, sf):
    d = frames.describe(ticks(spark, sf), "usdc", "price")
    return d.select("name", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), "least", *r6(q25="q25", q50="q50", q75="q75"), "most")


@query(f"""{_W}, r AS (SELECT contract, usdc, row_number() OVER (PARTITION BY contract ORDER BY usdc) - 1 AS i, count(*) OVER (PARTITION BY contract) AS n FROM ticks)
SELECT contract, max(CASE WHEN i = floor(0.25 * (n - 1) + 0.5) THEN usdc END) AS q25, max(CASE WHEN i = floor(0.75 * (n - 1) + 0.5) THEN usdc END) AS q75 FROM r GROUP BY contract""")
def q57c_nearest_quantiles(spark, sf):
    return ticks(spark, sf).groupBy("contract").agg(frames.nearest_quantile("usdc", 0.25).alias("q25"), frames.nearest_quantile("usdc", 0.75).alias("q75"))


@query("SELECT l_returnflag AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def q57d_value_counts(spark, sf):
    return frames.value_counts(table(spark, sf, "lineitem"), "l_returnflag").select("value", "n", *r6(share="share"))


@query(f"""{_W}, h AS (SELECT contract, wallet, sum(usdc) AS heat FROM ticks GROUP BY ALL) SELECT contract, wallet, round(heat, 4) AS heat FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY round(heat, 6) DESC, wallet) AS n FROM h) WHERE n <= 3""")
def q64b_top_heat(spark, sf):
    h = ticks(spark, sf).groupBy("contract", "wallet").agg(F.round(F.sum("usdc"), 6).alias("heat"))
    return frames.top_per(h, 3, ["contract"], F.desc("heat"), F.asc("wallet")).select("contract", "wallet", F.round("heat", 4).alias("heat"))


@query()
def q64c_sample(spark, sf):
    return frames.sample_rows(ticks(spark, sf).select("id", "usdc"), 100, "id")


@query("""WITH x AS (SELECT DISTINCT event_type, user_id % 5 AS u FROM events) SELECT event_type, u, row_number() OVER (ORDER BY event_type, u) AS place FROM x""")
def q64d_ordered_once(spark, sf):
    x = frames.ordered_once(table(spark, sf, "events").selectExpr("event_type", "user_id % 5 as u"), "event_type")
    rows = x.collect()  # at most five for each type; the order of rows is what is asked for
    return spark.createDataFrame([(r["event_type"], r["u"], i + 1) for i, r in enumerate(rows)], "event_type string, u long, place long")


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_id * 10 ELSE event_id % 2 END AS stamp FROM events WHERE event_type IS NOT NULL AND CASE WHEN event_id % 3 = 0 THEN event_id * 10 ELSE event_id % 2 END <> 0""")
def q61b_repaired_times(spark, sf):
    e = table(spark, sf, "events").withColumns({"timestamp": F.col("event_id") % 2, "op": F.lit("INSERT")})
    named = frames.rename_present(frames.inserts(frames.drop_nulls(e, "event_type", "absent")), {"event_id": "id", "absent": "x", "timestamp": "stamp"}, only=True)
    found = table(spark, sf, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("id"), (F.col("event_id") * 10).alias("stamp"))
    return frames.without_zero_times(frames.repair_times(named, found, at="stamp"), "stamp")


@query("""SELECT event_id, md5(event_type || event_id) AS digest, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, map_keys(m)[1] AS first_key, m['b'] AS b, cardinality(m) AS n FROM (SELECT *, MAP {'a': event_id % 7, 'b': event_id % 5} AS m FROM events)""")
def q60b_maps_and_hashes(spark, sf):
    e = table(spark, sf, "events").withColumn("m", F.create_map(F.lit("a"), F.col("event_id") % 7, F.lit("b"), F.col("event_id") % 5))
    props = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.md5(F.concat("event_type", F.col("event_id").cast("string")).cast("binary")).alias("digest"), props["k"].cast("long").alias("k"), F.map_keys("m")[0].alias("first_key"), F.col("m")["b"].alias("b"), F.size("m").cast("long").alias("n"))


@query("""SELECT event_id, event_type AS label, '{"id":' || event_id || ',"tags":[{"label":"' || event_type || '"},{"label":"x"}]}' AS text FROM events""")
def q60c_json_labels(spark, sf):
    """An array of objects with labels, written as text and read again."""
    tags = F.array(F.struct(F.col("event_type").alias("label")), F.struct(F.lit("x").alias("label")))
    e = table(spark, sf, "events").withColumn("text", F.to_json(F.struct(F.col("event_id").alias("id"), tags.alias("tags"))))
    labels = F.from_json(F.get_json_object("text", "$.tags"), "array<struct<label:string>>")["label"]
    return e.select("event_id", labels[0].alias("label"), "text")


@query(f"""{_W}, n AS (SELECT contract, min(ts) AS first, CASE WHEN min(id) % 2 = 0 THEN min(ts) - 500 ELSE min(ts) - 40 * 86400 END AS made FROM ticks GROUP BY contract),
u AS (SELECT contract, 'NEW' AS kind, CASE WHEN made < first - 30 * 86400 THEN first - 86400 ELSE made END AS ts, 0 AS id FROM n UNION ALL SELECT contract, 'RESOLUTION', max(ts) + 1, 0 FROM ticks GROUP BY contract UNION ALL SELECT contract, 'PRICE_UPDATE', ts, id FROM ticks)
SELECT kind, contract, ts, id, row_number() OVER (ORDER BY ts, CASE kind WHEN 'NEW' THEN 0 WHEN 'RESOLUTION' THEN 1 ELSE 2 END, id, contract) AS place FROM u""")
def q62b_event_stream(spark, sf):
    """One total order of all contracts' events; a contract made over 30 days before its first trade is moved to the day before that."""
    t = ticks(spark, sf)
    n = t.groupBy("contract").agg(F.min("ts").alias("first"), F.min("id").alias("one")).withColumn("made", F.when(F.col("one") % 2 == 0, F.col("first") - 500).otherwise(F.col("first") - 40 * 86400))
    return mk.event_stream(n.select("contract", "made"), t.select("contract", "ts", "id", "price"), t.groupBy("contract").agg((F.max("ts") + 1).alias("ts"))).select("kind", "contract", "ts", "id", "place")


@query(f"""WITH {TRADES}, {MARKETS}, g AS (SELECT wallet, brand, sum(usdc) AS v FROM trades JOIN markets USING (contract_id) GROUP BY ALL) SELECT count(DISTINCT wallet) AS n_rows, count(DISTINCT brand) AS n_cols, count(*) AS cells, round(sum(v), 2) AS total FROM g""")
def q48b_sparse_matrix(spark, sf):
    x = trades(spark, sf).join(markets(spark, sf).select("contract_id", "brand"), "contract_id")
    m = frames.entity_index(x, "wallet", "brand", "usdc")
    return m.agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count("*").alias("cells"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH b AS (SELECT p_partkey AS k, p_brand AS c FROM part) SELECT x.k AS a, y.k AS b FROM b x JOIN b y ON x.c = y.c AND y.k > x.k AND y.k <= x.k + 60""")
def q49d_cluster_pairs(spark, sf):
    """Pairs of contracts of a cluster that stand near each other: a band join within the cluster, by slots of the band's width."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("c"))
    return execution.band_pairs(p, "c", "a", 60)


@query()
def q43b_walk_forward_replay(spark, sf):
    day, first = 86400, 1704067200
    plan = [tuple(first + day * d for d in (i, i + 12, i + 14, i + 19)) for i in (0, 5, 10)]
    return simulate.walk_forward(_event_rows(spark, sf), plan, [1000.0, 4000.0], [0.1, 0.5], [0.05, 0.2])


@query()
def q55g_calibrated(spark, sf):
    """The models of a daily run, one row each, null where there is none."""
    t = _bets(spark, sf).join(ticks(spark, sf).select("id", "ts"), "id")
    v = t.select("ts", "id", "price", F.pow(F.col("won") - F.col("price"), 2).alias("error"))
    got = fresh.calibrate(t, {"yes": v, "no": v.where("id < 500")}, 1706659200)
    return spark.createDataFrame([(k, [round(x, 6) for x in m] if m else None) for k, m in got.items()], "model string, parameters array<double>")


_VIEWS = """SELECT brand, count(*) AS n, round(sum(usdc), 2) AS usdc, round(avg(CASE WHEN tokens > 0 THEN price END), 6) AS mean_bought, count(DISTINCT wallet) AS wallets
FROM trades JOIN markets USING (contract_id) WHERE price BETWEEN 0.01 AND 0.99 GROUP BY brand HAVING count(*) > 10"""


@query(f"WITH {TRADES}, {MARKETS} {_VIEWS}")
def q00_sql_views(spark, sf):
    """The same text as SQL over the views."""
    register(spark, sf)
    return spark.sql(_VIEWS)


@query(f"""WITH {TRADES}, s AS (SELECT *, abs(tokens) AS q, CASE WHEN tokens > 0 THEN usdc ELSE abs(tokens) * (1 - price) END AS risk FROM trades),
f AS (SELECT wallet, contract_id, tokens > 0 AS long, ts AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts, order_id, contract_id, price, tokens) AS n FROM s) WHERE n = 1)
SELECT wallet, contract_id, long, first_ts, round(sum(risk), 4) AS risk, round(sum(q), 4) AS qty, round(sum(price * q), 4) AS cost FROM s JOIN f USING (wallet, contract_id) WHERE (tokens > 0) = long GROUP BY ALL""")
def q09c_first_by_batches(spark, sf):
    """First positions kept up to date over three stretches of time."""
    t = trades(spark, sf)
    state = spark.createDataFrame([], "wallet long, contract_id long, long boolean, first_ts long, risk double, qty double, cost double")
    for lo, hi in ((0, 850_000_000), (850_000_000, 900_000_000), (900_000_000, 2_000_000_000)):
        state = fresh.update_first(state, t.where((F.col("ts") >= lo) & (F.col("ts") < hi)))
    return state.select("wallet", "contract_id", "long", "first_ts", *(F.round(c, 4).alias(c) for c in ("risk", "qty", "cost")))


@query(f"""WITH {MARKETS}, t AS (SELECT market_id, contract_id, token_index, CASE WHEN market_id % 2 = 0 THEN outcome END AS outcome, contract_id % 5 <> 0 AS resolved, CASE WHEN contract_id % 3 = 0 THEN NULL WHEN contract_id % 7 < 3 THEN 0.995 WHEN contract_id % 7 = 3 THEN 0.005 ELSE 0.5 END AS p FROM markets),
z AS (SELECT *, token_index = min(token_index) OVER (PARTITION BY market_id) AS zero FROM t), g AS (SELECT market_id, max(CASE WHEN zero THEN p END) AS own, max(CASE WHEN NOT zero THEN p END) AS other, bool_or(resolved) AS r, count(outcome) AS k FROM z GROUP BY market_id),
f AS (SELECT market_id, CASE WHEN coalesce(own, 1 - other) >= 0.95 THEN 1e0 WHEN coalesce(own, 1 - other) <= 0.05 THEN 0e0 END AS first FROM g WHERE r AND k = 0)
SELECT market_id, contract_id, CASE WHEN zero THEN first ELSE 1 - first END AS outcome FROM z JOIN f USING (market_id) WHERE first IS NOT NULL""")
def q24c_price_fallback(spark, sf):
    k = F.col("contract_id")
    price = F.when(k % 3 == 0, F.lit(None).cast("double")).when(k % 7 < 3, 0.995).when(k % 7 == 3, 0.005).otherwise(0.5)
    outcome = F.when(F.col("market_id") % 2 == 0, F.col("outcome"))
    return mk.price_fallback(markets(spark, sf).select("market_id", "contract_id", "token_index", outcome.alias("outcome"), (k % 5 != 0).alias("resolved"), price.alias("last_price")))
