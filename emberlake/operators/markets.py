"""Market metadata: token rows, outcomes, payouts, life spans and exclusion rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.windows import running_total

#: Fixed values of the exclusion rules and topics; patterns are searched in lower-cased text.
FROZEN_DOMAINS = r"data\.chain\.link|binance\.com|dotabuff\.com|gol\.gg"
FAST_DOMAINS = r"data\.chain\.link|binance\.com|dotabuff\.com|gol\.gg|hltv\.org"
FROZEN_SPORTS = ("kill_over_under_game", "team_totals", "tennis_first_set_totals")
FAST_SPORTS = ("kill_over_under_game", "team_totals", "tennis_first_set_totals", "cs2_odd_even_total_rounds", "soccer_anytime_goalscorer")
CRYPTO_WORDS = r"bitcoin|btc|\beth\b|ethereum|crypto|solana|dogecoin|token"
SPORTS_WORDS = r"\bvs\.?\b|game|match|nba|nfl|nhl|mlb|o/u|goalscorer|set \d"
POLITICS_WORDS = r"election|president|senate|congress|minister|approval"
LARGE_TEMPLATE = 1000
LARGE_SHARE = 0.8
#: Median life of a market in hours, used where no end is known.
MEDIAN_LIFE_HOURS = 25.9


def explode_tokens(raw: DataFrame) -> DataFrame:
    """raw: market_id, token_ids, prices (JSON arrays of text), status. One row per token of markets with two or more; index 0 is Yes."""
    ids = F.from_json("token_ids", "array<string>")
    x = raw.withColumns({"ids": ids, "quoted": F.transform(F.from_json("prices", "array<string>"), lambda v: v.try_cast("double"))}).where(F.size("ids") >= 2)
    x = x.withColumn("outcome", infer_outcome(F.col("quoted"), F.lower("status").isin("resolved", "closed")))
    y = x.select("market_id", "outcome", F.posexplode("ids").alias("token_index", "contract_id"))
    return y.select("market_id", "contract_id", "token_index", F.when(F.col("token_index") == 0, "Yes").otherwise("No").alias("label"), payout(F.col("outcome"), F.col("token_index")).alias("payout"))


def infer_outcome(prices: Column, settled: Column) -> Column:
    """Winning index of a settled market: 0.5 if the first two prices lie within 0.02 of a half, else the first price of 0.95
    and more; null otherwise. Nothing is inferred for open markets."""
    even = F.forall(F.slice(prices, 1, 2), lambda p: F.coalesce(F.abs(p - 0.5) <= 0.02, F.lit(False))) & (F.size(prices) >= 2)
    at = F.array_position(F.transform(prices, lambda p: F.coalesce(p >= 0.95, F.lit(False))), True)
    return F.when(settled, F.when(even, 0.5).when(at > 0, (at - 1).cast("double")))


def payout(outcome: Column, token_index: Column) -> Column:
    return F.when(outcome.isNull(), F.lit(None).cast("double")).when(F.abs(outcome - 0.5) < 1e-9, 0.5).otherwise((token_index == F.round(outcome)).cast("double"))


def strict_outcome(status: Column, p0: Column, p1: Column, win: float = 0.99) -> Column:
    """Repair gate: struct(outcome, reason); only resolved markets with a clear price count."""
    even = (F.abs(p0 - 0.5) <= 0.02) & (F.abs(p1 - 0.5) <= 0.02)
    made = lambda o, why: F.struct(F.lit(o).cast("double").alias("outcome"), F.lit(why).alias("reason"))
    return F.when(status != "resolved", made(None, "open")).when(even, made(0.5, "void")).when(p0 >= win, made(0.0, "index 0")).when(p1 >= win, made(1.0, "index 1")).otherwise(made(None, "ambiguous"))


def repair_class(tokens: DataFrame) -> DataFrame:
    """trusted (a winner), void (all half), anomaly (values but no winner) or target (all null) per market."""
    g = tokens.groupBy("market_id").agg(
        F.coalesce(F.max(F.col("outcome") == 1), F.lit(False)).alias("won"), F.count("outcome").alias("known"), F.count("*").alias("n"),
        F.coalesce(F.min(F.abs(F.col("outcome") - 0.5) < 1e-9), F.lit(False)).alias("half"),
    )
    kind = F.when(F.col("won"), "trusted").when(F.col("known") == 0, "target").when(F.col("half") & (F.col("known") == F.col("n")), "void").otherwise("anomaly")
    return g.select("market_id", kind.alias("class"))


def price_fallback(tokens: DataFrame, win: float = 0.95, lose: float = 0.05) -> DataFrame:
    """Outcomes by price for markets that are resolved, but of which no token has one: market_id, contract_id, outcome. tokens: market_id, contract_id, token_index,
    outcome, resolved, last_price. The price is token 0's, else 1 less another token's (the lowest index that has one); a market without token 0 takes its lowest as
    such. From ``win`` on token 0 has won, up to ``lose`` the others have; between, and without price, nothing is said."""
    w = Window.partitionBy("market_id")
    x = tokens.withColumn("zero", F.col("token_index") == F.min("token_index").over(w))
    known = F.when(F.col("last_price").isNotNull() & ~F.isnan("last_price"), F.col("last_price"))
    g = x.withColumn("p", known).groupBy("market_id").agg(
        F.min(F.when(F.col("zero"), F.col("p"))).alias("own"), F.min_by(F.when(~F.col("zero"), F.col("p")), F.when(~F.col("zero") & F.col("p").isNotNull(), F.col("token_index"))).alias("other"),
        F.max(F.col("resolved")).alias("resolved"), F.count("outcome").alias("known"),
    )
    p = F.coalesce("own", 1 - F.col("other"))
    first = F.when(p >= win, 1.0).when(p <= lose, 0.0)
    said = g.where("resolved and known = 0").select("market_id", first.alias("first")).where("first is not null")
    return x.join(said, "market_id").select("market_id", "contract_id", F.when(F.col("zero"), F.col("first")).otherwise(1 - F.col("first")).alias("outcome"))


def authority(tokens: DataFrame) -> DataFrame:
    """Outcome per token: any 1 gives 1, any 0.5 gives 0.5, another winner in the market gives 0, else null."""
    t = tokens.groupBy("market_id", "contract_id").agg(F.max((F.col("outcome") == 1).cast("int")).alias("one"), F.max((F.col("outcome") == 0.5).cast("int")).alias("half"))
    m = t.groupBy("market_id").agg(F.max("one").alias("winner"))
    o = F.when(F.col("one") == 1, 1.0).when(F.col("half") == 1, 0.5).when(F.col("winner") == 1, 0.0)
    return t.join(m, "market_id").select("market_id", "contract_id", o.alias("outcome"))


def window_end(closed: Column, closed_time: Column, resolution: Column, start: Column) -> Column:
    """Seconds. Null while open; the closing time if it is not a day before the start, else the resolution time likewise."""
    fits = lambda t: t >= start - 86400
    return F.when(closed, F.when(fits(closed_time), closed_time).when(fits(resolution), resolution))


def scheduled_end(event_start: Column, resolution: Column, game_start: Column, start: Column) -> Column:
    fits = lambda t: F.when(t >= start - 86400, t)
    return F.coalesce(fits(event_start), fits(resolution), fits(game_start), (start + F.lit(MEDIAN_LIFE_HOURS) * 3600).cast("long"))


def is_hostile(template_size: Column, source: Column, sports: Column, question: Column) -> Column:
    """Clauses of which each counts as false where its input is null."""
    no = F.lit(False)
    return F.coalesce(template_size >= LARGE_TEMPLATE, no) | F.coalesce(F.lower(source).rlike(FAST_DOMAINS), no) | F.coalesce(sports.isin(*FAST_SPORTS), no) | F.coalesce(F.lower(question).rlike(CRYPTO_WORDS), no)


def is_hostile_frozen(fees: Column, source: Column, sports: Column, liveness: Column) -> Column:
    """fees: text; true and 1 count, in any case."""
    no = F.lit(False)
    return F.coalesce(F.lower(fees).isin("true", "1"), no) | F.coalesce(F.lower(source).rlike(FROZEN_DOMAINS), no) | F.coalesce(sports.isin(*FROZEN_SPORTS), no) | F.coalesce((liveness > 0) & (liveness <= 3600), no)


def rule_coverage(markets: DataFrame, hostile: str, most: float = LARGE_SHARE) -> DataFrame:
    """Markets, those that a rule takes out, their share, and whether it is more than ``most``: then the rule, not the market, is in doubt."""
    g = markets.agg(F.count_distinct("market_id").alias("markets"), F.count_distinct(F.when(F.col(hostile), F.col("market_id"))).alias("hostile"))
    share = F.col("hostile") / F.greatest(F.col("markets"), F.lit(1))
    return g.withColumn("share", share).withColumn("warn", F.col("share") > most)


def in_life(ts: Column, start: Column, end: Column) -> Column:
    """Trades before the start or after the end of their market do not count; a null bound is open."""
    return F.coalesce(ts >= start, F.lit(True)) & F.coalesce(ts <= end, F.lit(True))


def before_resolution(ts: Column, resolved_at: Column) -> Column:
    """Nothing is learned from trades at or after the resolution; unresolved markets have none."""
    return F.coalesce(ts < resolved_at, F.lit(True))


def needs_review(markets: DataFrame, links: DataFrame, most_liquidity: float = 10_000.0, least_contracts: int = 5) -> DataFrame:
    """links: market_id, entity. A market waits for a person if its liquidity is over the limit, or one of its entities has fewer
    than ``least_contracts`` markets; without entities only liquidity counts. state: also 'no entities' and 'linked'."""
    used = links.select("market_id", "entity").distinct()
    rare = used.groupBy("entity").agg(F.count("*").alias("n"))
    least = used.join(rare, "entity").groupBy("market_id").agg(F.min("n").alias("least"), F.count("*").alias("entities"))
    x = markets.select("market_id", F.coalesce("liquidity", F.lit(0.0)).alias("liquidity")).join(least, "market_id", "left")
    review = (F.col("liquidity") > most_liquidity) | F.coalesce(F.col("least") < least_contracts, F.lit(False))
    return x.select("market_id", review.alias("review"), F.when(F.col("entities").isNull(), "no entities").when(review, "review").otherwise("linked").alias("state"))


def template_sizes(markets: DataFrame) -> DataFrame:
    """Markets whose questions differ in numbers only, counted."""
    return markets.withColumn("template", F.regexp_replace(F.lower("question"), "[0-9]+", "#")).groupBy("template").agg(F.count("*").alias("template_size"))


def sibling_mirror(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Last price per token, where a trade at p also sets the other token of its market to 1 - p. trades: id, contract_id, price, ts."""
    m = markets.select("contract_id", "market_id", "token_index")
    own = trades.join(m, "contract_id").select("market_id", "token_index", "price", "ts", "id")
    both = own.select("market_id", F.explode(F.array(F.struct("token_index", "price"), F.struct((1 - F.col("token_index")).alias("token_index"), (1 - F.col("price")).alias("price")))).alias("x"), "ts", "id")
    return both.groupBy("market_id", F.col("x.token_index").alias("token_index")).agg(F.max_by("x.price", F.struct("ts", "id")).alias("last_price"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Newest row per key; order: most recent first, with a tie-breaker."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def topic(question: Column) -> Column:
    """Coarse topic; politics goes before sports, and sports before crypto."""
    q = F.lower(question)
    return F.when(q.rlike(POLITICS_WORDS), "politics").when(q.rlike(SPORTS_WORDS), "sports").when(q.rlike(CRYPTO_WORDS), "crypto").otherwise("other")


def event_stream(made: DataFrame, trades: DataFrame, resolved: DataFrame, old_days: int = 30) -> DataFrame:
    """NEW_CONTRACT, RESOLUTION and PRICE_UPDATE events with their place in one order: time, then that order of kinds, then id and contract. made: contract, made;
    trades: contract, ts, id, price; resolved: contract, ts. A contract made more than ``old_days`` before its first trade is new a day before that."""
    first = trades.groupBy("contract").agg(F.min("ts").alias("first"))
    late = F.col("made") < F.col("first") - 86400 * old_days
    new = made.join(first, "contract", "left").select("contract", F.when(late, F.col("first") - 86400).otherwise(F.col("made")).alias("ts"), F.lit("NEW").alias("kind"), F.lit(0).cast("long").alias("id"))
    end = resolved.select("contract", "ts", F.lit("RESOLUTION").alias("kind"), F.lit(0).cast("long").alias("id"))
    x = new.unionByName(end).unionByName(trades.withColumn("kind", F.lit("PRICE_UPDATE")), allowMissingColumns=True)
    x = x.withColumns({"pri": F.when(F.col("kind") == "NEW", 0).when(F.col("kind") == "RESOLUTION", 1).otherwise(2), "_one": F.lit(1)})
    return running_total(x, ["ts", "pri", "id", "contract"], {"place": "_one"}).drop("_one", "pri")
