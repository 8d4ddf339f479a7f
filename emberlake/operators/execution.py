"""Order-book state, fills against books and against later trades, positions at average cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.normalize import ratio
from emberlake.operators.windows import decayed_sum


def synth_quotes(ticks: DataFrame) -> DataFrame:
    """Bid, ask and depth about a trade (id, contract, price, usdc, size, side): the spread grows as the liquidity told by the volume
    falls. A purchase stands at the bid with the ask a spread above, a sale at the ask with the bid a spread below, within [0, 1]."""
    liquidity = F.greatest(F.lit(1000.0), F.col("usdc") * 50)
    spread = F.least(F.lit(0.20), 0.01 + 20000.0 / (liquidity + 1000) * 0.0025)
    sale = F.col("side") < 0
    bid = F.greatest(F.lit(0.0), F.when(sale, F.col("price") - spread).otherwise(F.col("price")))
    ask = F.least(F.lit(1.0), F.when(sale, F.col("price")).otherwise(F.col("price") + spread))
    ask = F.when(bid > ask, F.least(F.lit(1.0), bid + 0.001)).otherwise(ask)
    depth = F.greatest(F.lit(100.0), F.col("size") * 2)
    return ticks.select("id", "contract", F.round(bid, 6).alias("bid"), F.round(ask, 6).alias("ask"), F.round(depth, 4).alias("depth"))


def vwap_walk(levels: DataFrame, amount: float, *keys: str) -> DataFrame:
    """Levels (price, size), best first, are taken until ``amount`` of money is spent; the last one in part."""
    w = Window.partitionBy(*keys).orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("price") * F.col("size")).over(w), F.lit(0.0))
    x = levels.where("price > 0 and size > 0").withColumn("spent", F.greatest(F.lit(0.0), F.least(F.col("price") * F.col("size"), amount - before)))
    g = x.where("spent > 0").groupBy(*keys).agg(F.sum("spent").alias("spent"), F.sum(F.col("spent") / F.col("price")).alias("quantity"), F.max("price").alias("worst"))
    return g.withColumn("vwap", ratio(F.col("spent"), F.col("quantity")))


def sweep_limit(levels: DataFrame, amount: float, slippage: float, allowance: float, *keys: str) -> DataFrame:
    """As ``vwap_walk``, over levels with columns signal (the price asked for) and best_bid: a level is not taken, nor those after it, if with
    it the mean price is over the signal by more than ``allowance``, and its share over the signal together with the spread (of best
    ask and bid, as a share of the ask) by more than ``slippage``. The mean rises from level to level, so the first such level ends the walk."""
    w = Window.partitionBy(*keys).orderBy("price")
    before = F.coalesce(F.sum(F.col("price") * F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = levels.where("price > 0 and size > 0").withColumn("best_ask", F.min("price").over(Window.partitionBy(*keys)))
    x = x.withColumn("spent", F.greatest(F.lit(0.0), F.least(F.col("price") * F.col("size"), amount - before))).where("spent > 0")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("mean", F.sum("spent").over(upto) / F.sum(F.col("spent") / F.col("price")).over(upto))
    over = F.col("mean") - F.col("signal")
    spread = (F.col("best_ask") - F.col("best_bid")) / F.col("best_ask")
    x = x.where(~((over / F.col("signal") + spread > slippage) & (over > allowance)))
    g = x.groupBy(*keys).agg(F.sum("spent").alias("spent"), F.sum(F.col("spent") / F.col("price")).alias("quantity"), F.max("price").alias("worst"))
    return g.withColumn("vwap", ratio(F.col("spent"), F.col("quantity")))


def asof_forward(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left (key, at) with the value of right's first row of the key at or after that time; of equal times the least value."""
    first = right.groupBy(key, at).agg(F.min(value).alias(value)).withColumn("_v", F.struct(F.col(at).alias("at"), F.col(value).alias("value")))
    both = left.withColumn("_own", F.lit(True)).unionByName(first.select(key, at, "_v"), allowMissingColumns=True)
    # backwards in time, so that the frame grows row by row: one that shrinks is evaluated anew for every row
    w = Window.partitionBy(key).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where("_own")
    return found.select(*left.columns, F.col("_f.at").alias(f"{at}_next"), F.col("_f.value").alias(value))


def book_state(messages: DataFrame) -> DataFrame:
    """messages: seq, token, kind (book or delta), side, price (text), size. The last snapshot replaces the book, later deltas
    set levels, size 0 deletes; deltas before any snapshot are ignored. A snapshot may come as several rows, one a level: those of a token
    with no delta between. Prices are compared as numbers."""
    own = F.col("kind") == "book"
    begins = own & F.coalesce(F.lag("kind").over(Window.partitionBy("token").orderBy("seq")) != "book", F.lit(True))
    snap = messages.withColumn("_begins", begins).where("_begins").groupBy("token").agg(F.max("seq").alias("since"))
    x = messages.join(snap, "token").where(F.col("seq") >= F.col("since")).withColumn("price", F.col("price").cast("double"))
    last = x.groupBy("token", "side", "price").agg(F.max_by("size", "seq").alias("size"))
    return last.where("size > 0")


def best_quotes(book: DataFrame) -> DataFrame:
    return book.groupBy("token").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"))


def mark_price(best_bid, last_trade, average_cost):
    return F.coalesce(best_bid, last_trade, average_cost)


def match_flow(orders: DataFrame, flow: DataFrame, seconds: int = 300, share: float = 0.5) -> DataFrame:
    """Each order takes ``share`` of the shares of the opposite flow, priced within (0.001, 0.999) at its limit or better, in the ``seconds`` from the
    first trade at or after it, until 0.999 of its money is spent. A purchase costs the price a share, a sale 1 - price; price is the mean
    one by that. The interval join meets two time buckets of each contract only."""
    o = orders.select(F.col("id").alias("order_id"), "contract", "ts", F.col("side").alias("order_side"), F.col("price").alias("limit_price"), F.col("usdc").alias("wanted"))
    o = asof_forward(o, flow.select("contract", "ts", "id"), "contract", "ts", "id").where("ts_next is not null").drop("id", "ts").withColumnRenamed("ts_next", "t0")
    o = o.withColumn("slot", F.explode(F.array(F.floor(F.col("t0") / seconds), F.floor(F.col("t0") / seconds) + 1)))
    f = flow.withColumn("slot", F.floor(F.col("ts") / seconds)).select("id", "contract", "ts", "side", "price", "usdc", "slot")
    j = o.join(f, ["contract", "slot"]).where((F.col("ts") >= F.col("t0")) & (F.col("ts") <= F.col("t0") + seconds) & (F.col("id") != F.col("order_id")) & (F.col("side") == -F.col("order_side")))
    j = j.where(F.when(F.col("order_side") > 0, F.col("price") <= F.col("limit_price")).otherwise(F.col("price") >= F.col("limit_price")))
    j = j.where("price > 0.001 and price < 0.999")
    each = F.when(F.col("order_side") > 0, F.col("price")).otherwise(1 - F.col("price"))
    j = j.withColumns({"each": each, "offered": F.col("usdc") / F.col("price") * share * each})
    w = Window.partitionBy("order_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("before", F.coalesce(F.sum("offered").over(w), F.lit(0.0))).where(F.col("before") < F.col("wanted") * 0.999)
    j = j.withColumn("took", F.least(F.col("offered"), F.col("wanted") - F.col("before"))).withColumn("shares", F.col("took") / F.col("each")).where("shares > 1e-6")
    g = j.groupBy("order_id", "order_side").agg(F.sum("took").alias("filled"), F.sum("shares").alias("shares"), F.count("*").alias("fills"))
    mean = F.col("filled") / F.col("shares")
    return g.select("order_id", "filled", F.when(F.col("order_side") > 0, mean).otherwise(1 - mean).alias("price"), "fills")


def average_cost(ticks: DataFrame) -> DataFrame:
    """Running quantity and average cost of purchases per wallet and contract."""
    w = Window.partitionBy("wallet", "contract").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    x = ticks.where("side > 0").withColumns({"qty": F.sum(F.col("usdc") / F.col("price")).over(w), "cost": F.sum("usdc").over(w)})
    return x.select("id", "wallet", "contract", "qty", ratio(F.col("cost"), F.col("qty")).alias("avg_cost"))


def positions_with_sales(fills: DataFrame) -> DataFrame:
    """fills: wallet, contract, ts, id, side, qty, price. Final quantity, average cost and realised profit with partial sales;
    sales beyond the holding are cut. One ordered group per wallet and contract, as each sale depends on the state before."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        qty = cost = gained = 0.0
        for side, q, p in pdf.sort_values(["ts", "id"])[["side", "qty", "price"]].itertuples(index=False):
            if side > 0:
                cost, qty = cost + q * p, qty + q
            elif qty > 0:
                sold = min(q, qty)
                gained += sold * (p - cost / qty)
                cost -= sold * cost / qty
                qty -= sold
        return pd.DataFrame({"wallet": [pdf["wallet"].iloc[0]], "contract": [pdf["contract"].iloc[0]], "qty": [qty], "avg_cost": [cost / qty if qty > 1e-12 else 0.0], "realised": [gained]})

    return fills.groupBy("wallet", "contract").applyInPandas(run, "wallet long, contract string, qty double, avg_cost double, realised double")


def implied_liquidity(ticks: DataFrame, known: float = 10_000.0) -> DataFrame:
    """Liquidity after each trade: from what is known (a column known_liquidity, else ``known``), smoothed (0.9, 0.1) with half the volume over
    the price move, at moves over 0.005 with volume over 10. Linear in the rows: the smoothing is a decayed sum over the moves so far."""
    by = Window.partitionBy("contract").orderBy("ts", "id")
    move = F.abs(F.col("price") - F.lag("price").over(by))
    counts = F.coalesce((move > 0.005) & (F.col("usdc") > 10), F.lit(False))
    first = F.coalesce("known_liquidity", F.lit(known)) if "known_liquidity" in ticks.columns else F.lit(known)
    x = ticks.withColumns({"move": move, "hit": counts.cast("int"), "first": first})
    x = x.withColumns({"n": F.sum("hit").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), "add": F.when(F.col("hit") == 1, 0.1 * 0.5 * F.col("usdc") / F.col("move")).otherwise(0.0)})
    y = decayed_sum(x.select("contract", "id", "ts", "n", "add", "first"), "contract", ["ts", "id"], "n", "add", 0.9, "ema")
    return y.select("contract", "id", (F.col("ema") + F.col("first") * F.pow(F.lit(0.9), "n")).alias("liquidity"))


def band_pairs(rows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Pairs (a, b) of a key's rows with a < b <= a + width, by slots of that width: each row meets its own slot and the next."""
    x = rows.select(key, F.col(at).alias("a")).withColumn("slot", F.explode(F.array(F.floor(F.col("a") / width), F.floor(F.col("a") / width) + 1)))
    y = rows.select(key, F.col(at).alias("b")).withColumn("slot", F.floor(F.col("b") / width))
    return x.join(y, [key, "slot"]).where((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + width)).select("a", "b")
