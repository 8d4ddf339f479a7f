"""Replays: simulations in which each row acts on the cash and positions that all earlier rows left.

What can be told without that state (signals, gates, first entries) is relational and cuts the rows first. The rest goes, in one total order for
each configuration, through a small state machine: rows stream from a sorted partition, so memory is that of the open positions. Configurations run
beside each other; one configuration is one task by nature. Columns other than those named are not read; rows with null times are left out;
equal times go by id. Every machine's result has one row for each configuration; a configuration without rows has none.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HOUR = 3600


def in_order(rows: DataFrame, columns: list[str], order: list[str], machine: Callable[[int], object], result: str) -> DataFrame:
    """Streams the ``columns`` of each config's rows, ordered by ``order``, into ``machine(config).row(...)``; ``done()`` gives its result rows (tuples)."""
    schema = StructType.fromDDL("config int, " + result)
    kinds = rows.select("config").limit(0).sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches):
        config, sim = None, None

        def finish():
            found = [(config, *r) for r in sim.done()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(kinds)], schema=kinds)

        for batch in batches:
            for c, *values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != config:
                    if sim is not None:
                        yield finish()
                    config, sim = c, machine(c)
                sim.row(*values)
        if sim is not None:
            yield finish()

    own = rows.select("config", *columns, *(c for c in order if c not in columns))
    sorted_rows = own.repartition("config").sortWithinPartitions("config", *order).select("config", *columns)
    return sorted_rows.mapInArrow(run, schema)


class Hourly:
    """Money of a bettor whose bets are settled at the first row an hour after the last settlement."""

    def __init__(self, bank: float):
        self.cash = self.equity = self.peak = bank
        self.pnl = self.drawdown = self.percent = self.calmar = 0.0
        self.beat: int | None = None
        self.open: list[tuple[int, float, float]] = []  # end, profit, stake
        self.bets = self.wins = self.losses = self.short = 0

    def stake(self, most: float, share: float) -> float:
        return min(most, share * self.equity)

    def bet(self, end: int, profit: float, stake: float, won: bool) -> None:
        self.open.append((end, profit, stake))
        self.cash -= stake
        self.bets += 1
        self.wins += won
        self.losses += not won

    def tick(self, ts: int) -> None:
        if self.beat is None:
            self.beat = ts
        if abs(ts - self.beat) < HOUR:
            return
        self.beat = ts
        if not self.open:
            return
        for _, profit, stake in (x for x in self.open if x[0] <= ts):
            self.pnl += profit
            self.equity += profit
            self.cash += profit + stake
        self.open = [x for x in self.open if x[0] > ts]
        self.peak = max(self.peak, self.equity)
        down = self.peak - self.equity
        self.drawdown = max(self.drawdown, down)
        self.percent = max(self.percent, round(down / self.peak, 3) * 100)
        self.calmar = round(min(self.pnl / max(self.drawdown, 0.0001), 100_000), 1)

    RESULT = "bets int, wins int, losses int, short int, pnl double, equity double, cash double, drawdown double, percent double, calmar double"

    def done(self):
        return [(self.bets, self.wins, self.losses, self.short, self.pnl, self.equity, self.cash, self.drawdown, self.percent, self.calmar)]


def backed(price: float, slippage: float, stake: float, winner: bool) -> float:
    """Profit of a stake on the side that wins: the token itself, or the other side of a token that loses."""
    if winner:
        paid = price * (1 + slippage)
        return (1 - paid) * stake / paid
    paid = price * (1 - slippage)
    return paid * stake / (1 - paid)


@dataclass(frozen=True)
class SignalParams:
    bank: float = 10_000.0
    most: float = 10_000.0
    share: float = 0.01
    slippage: float = 0.2
    least: float = 10.0


def _beats(rows: DataFrame, acts: str) -> DataFrame:
    """The rows that can act, and the first of each second, which alone can settle."""
    w = Window.partitionBy("config", "ts").orderBy("id")
    acting = F.coalesce(F.expr(acts), F.lit(False))
    return rows.where("ts is not null").withColumn("_n", F.row_number().over(w)).withColumn("acts", acting).where("acts or _n = 1").drop("_n")


def signal_replay(rows: DataFrame, p: SignalParams = SignalParams()) -> DataFrame:
    """One bet a market, at the first row with a signal over ``least`` in size at a price within (0.05, 0.95) for which there is cash: a share of the
    equity, on the signal's side. rows: config, id, ts, market, signal, price, is_yes (of the token), outcome (over 0: Yes), end."""

    class Machine(Hourly):
        def __init__(self, _):
            super().__init__(p.bank)
            self.seen: set = set()

        def row(self, ts, market, signal, price, is_yes, outcome, end, acts):
            if acts and market not in self.seen:
                stake = self.stake(p.most, p.share)
                self.short += self.cash < stake
                if self.cash > stake:
                    yes = outcome > 0
                    right = signal > 0 if yes else signal < 0
                    profit = backed(price, p.slippage * stake / p.most, stake, yes == is_yes) if right else -stake
                    self.bet(end, profit, stake, right)
                    self.seen.add(market)
            self.tick(ts)

    kept = _beats(rows, f"abs(signal) > {p.least} and price > 0.05 and price < 0.95 and end is not null and outcome is not null")
    return in_order(kept, ["ts", "market", "signal", "price", "is_yes", "outcome", "end", "acts"], ["ts", "id"], Machine, Hourly.RESULT)


def copy_replay(rows: DataFrame, p: SignalParams = SignalParams(), least_return: float = 5.0) -> DataFrame:
    """Copies the first purchase of each market by an elite wallet, priced within (0.05, 0.95), if its return a year would be over ``least_return``; the
    market is used up either way. rows: config, id, ts, market, elite, tokens, price, is_yes, outcome, end."""

    class Machine(Hourly):
        def __init__(self, _):
            super().__init__(p.bank)

        def row(self, ts, price, is_yes, outcome, end, acts):
            if acts:
                stake = self.stake(p.most, p.share)
                right = (outcome > 0) == is_yes
                profit = backed(price, p.slippage * stake / p.most, stake, right)
                self.short += self.cash < stake
                if profit / stake / (max((end - ts) // 86400, 1) / 365) > least_return and self.cash > stake:
                    self.bet(end, profit if right else -stake, stake, right)
            self.tick(ts)

    first = Window.partitionBy("config", "market", "can").orderBy("ts", "id")
    can = F.coalesce(F.col("elite") & (F.col("tokens") > 0) & (F.col("price") > 0.05) & (F.col("price") < 0.95) & F.col("end").isNotNull() & F.col("outcome").isNotNull(), F.lit(False))
    marked = rows.where("ts is not null").withColumn("can", can).withColumn("first", F.col("can") & (F.row_number().over(first) == 1))
    return in_order(_beats(marked, "first"), ["ts", "price", "is_yes", "outcome", "end", "acts"], ["ts", "id"], Machine, Hourly.RESULT)


@dataclass(frozen=True)
class EntryParams:
    bank: float = 10_000.0
    stake: float = 100.0
    share: float | None = None
    most_price: float = 0.10
    most_variance: float = 0.15
    slippage: float = 0.05
    take_profit: float = 0.95


def entry_rule(price, variance, margin, hostile, p: EntryParams = EntryParams()):
    """Whether a row may open a position, apart from the market being new and the cash."""
    return F.coalesce((margin > 0) & (variance < p.most_variance) & (price < p.most_price) & ~hostile, F.lit(False))


def entry_replay(rows: DataFrame, p: EntryParams = EntryParams()) -> DataFrame:
    """Buys by the entry rule, each market once, while there is cash; sells a held token at the take-profit price; settles at the first row an hour after
    the last settlement what has ended, a token of unknown outcome at a half. rows: config, id, ts, contract, market, price, variance,
    margin (in percent of the price), hostile, outcome (of the token), end. A sale pays the price less the slippage, a purchase costs it and more."""

    class Machine:
        def __init__(self, _):
            self.cash = self.equity = self.peak = p.bank
            self.drawdown, self.beat = 0.0, None
            self.held: dict = {}
            self.seen: set = set()
            self.counts = [0, 0, 0, 0]  # bought, sold, won, lost

        def close(self, stake, paid):
            self.cash += paid
            self.equity += paid - stake

        def row(self, ts, contract, market, price, outcome, end, enters):
            if enters and market not in self.seen and contract not in self.held:
                stake = p.stake if p.share is None else max(2.0, self.equity * p.share)
                if stake <= self.cash:
                    paid = max(0.001, min(0.99, price * (1 + p.slippage)))
                    self.held[contract] = (stake / paid, stake, end, 0.5 if outcome is None or math.isnan(outcome) else outcome)
                    self.cash -= stake
                    self.seen.add(market)
                    self.counts[0] += 1
            if contract in self.held and price >= p.take_profit:
                tokens, stake, _, _ = self.held.pop(contract)
                gain = tokens * price * (1 - p.slippage)
                self.close(stake, gain)
                self.counts[1] += 1
                self.counts[2 if gain > stake else 3] += 1
            if self.beat is None:
                self.beat = ts
            if ts - self.beat >= HOUR:
                self.beat = ts
                for c in [c for c, x in self.held.items() if x[2] is not None and ts >= x[2]]:
                    tokens, stake, _, worth = self.held.pop(c)
                    self.close(stake, tokens * worth)
                    self.counts[2] += tokens * worth > stake
                    self.counts[3] += tokens * worth < stake
                self.peak = max(self.peak, self.equity)
                self.drawdown = max(self.drawdown, self.peak - self.equity)

        def done(self):
            return [(*self.counts, len(self.held), self.cash, self.equity, self.drawdown)]

    enters = entry_rule(F.col("price"), F.col("variance"), F.col("margin"), F.coalesce("hostile", F.lit(False)), p)
    kept = _beats(rows.withColumn("enters", enters), f"enters or price >= {p.take_profit}")
    return in_order(kept, ["ts", "contract", "market", "price", "outcome", "end", "enters"], ["ts", "id"], Machine, "bought int, sold int, won int, lost int, held int, cash double, equity double, drawdown double")


@dataclass(frozen=True)
class EventParams:
    cash: float = 10_000.0
    splash: float = 1000.0
    sizing: str = "kelly"  # kelly, fixed_pct or fixed
    size: float = 0.25
    least_edge: float = 0.05
    stop_loss: float | None = None
    smart_exit: float | None = None  # share of splash by which the signal must turn
    liquidity: float = 10_000.0
    friction: float = 0.002
    penalty: float = 0.03
    half_spread: float = 0.0025


class EventMachine:
    """Events of one time step (a minute) are taken together: prices move signals and exits, candidates are ranked by edge a day at its end."""

    RESULT = "trades int, volume double, open int, final_value double, drawdown double"

    def __init__(self, p: EventParams):
        self.p, self.cash, self.trades, self.volume = p, p.cash, 0, 0.0
        self.net: dict = {}
        self.last: dict = {}
        self.liquidity: dict = {}
        self.held: dict = {}  # contract: side, shares, entry, signal at entry
        self.found: dict = {}  # candidates of this step
        self.step: int | None = None
        self.peak, self.drawdown = p.cash, 0.0  # by the values at the ends of steps; the drawdown as a share

    def worth(self, contract) -> float:
        side, shares, entry, _ = self.held[contract]
        price = self.last.get(contract, entry)
        return shares * (price if side > 0 else 1 - price)

    def value(self) -> float:
        return self.cash + sum(self.worth(c) for c in sorted(self.held))

    def cost(self, edge: float) -> float:
        p = self.p
        if p.sizing == "fixed":
            return p.size
        share = p.size if p.sizing == "fixed_pct" else abs(edge) * p.size
        return self.cash * min(share, 0.20)

    def row(self, ts, kind, contract, price, volume, sell, skill, outcome, end):
        step = ts // 60
        if step != self.step:
            self.close_step()
            self.step = step
        if kind == "NEW":
            self.net[contract], self.last[contract] = 0.0, 0.5
        elif kind == "RESOLUTION":
            if contract in self.held:
                side, shares, _, _ = self.held.pop(contract)
                won = outcome == (1.0 if side > 0 else 0.0)
                self.cash += shares * (0.5 if outcome == 0.5 else float(won))
        else:
            self.trade(ts, contract, price, volume, sell, skill, end)
            self.exit(contract)

    def trade(self, ts, contract, price, volume, sell, skill, end):
        p = self.p
        known = self.liquidity.get(contract, p.liquidity)
        if contract in self.last:
            move = abs(price - self.last[contract])
            if move > 0.005 and volume > 10:
                known = 0.9 * known + 0.1 * (0.5 * volume / move)
        self.liquidity[contract] = known
        before = self.last.get(contract, 0.5)
        self.last[contract] = price
        if volume < 1:
            return
        weight = volume * (1 + min(5 * math.log1p(100 * max(0.0, 0.25 - skill)), 10.0))
        net = self.net.get(contract, 0.0) + (-weight if sell else weight)
        if abs(net) <= p.splash:
            self.net[contract] = net
            return
        self.net[contract] = 0.0
        edge = 0.5 + 0.49 * math.tanh(net / 5000) - before
        days = None if end is None else (end - ts) / 86400
        if days is None or days <= 0 or abs(edge) < p.least_edge or not 0.02 <= price <= 0.98 or contract in self.held:
            return
        if self.liquidity[contract] > 1:
            self.found[contract] = (edge / max(1.0, days), edge, price, self.liquidity[contract], self.net[contract])

    def exit(self, contract):
        p = self.p
        if contract not in self.held:
            return
        side, shares, entry, signal = self.held[contract]
        price = self.last[contract]
        gain = (price - entry) / entry if side > 0 else (entry - price) / (1 - entry)
        turned = side * (self.net.get(contract, 0.0) - signal)
        if (p.stop_loss and gain < -p.stop_loss) or (p.smart_exit and turned < -p.splash * p.smart_exit):
            self.cash += shares * (price if side > 0 else 1 - price) * (1 - p.friction) * (1 - p.penalty)
            del self.held[contract]

    def close_step(self):
        p = self.p
        for contract, (daily, edge, price, pool, signal) in sorted(self.found.items(), key=lambda x: (abs(x[1][0]), x[0]), reverse=True):
            cost = self.cost(daily)
            if contract in self.held or cost <= 5 or self.cash <= cost:
                continue
            put = cost / (1 + p.friction) * (1 - p.penalty)
            impact = min(put / (pool + put), 0.15) + p.half_spread
            side = 1 if edge > 0 else -1
            entry = min(price + impact, 0.99) if side > 0 else max(price - impact, 0.01)
            self.held[contract] = (side, put / (entry if side > 0 else 1 - entry), entry, signal)
            self.cash -= cost
            self.trades += 1
            self.volume += cost
        self.found = {}
        if self.step is not None:
            now = self.value()
            self.peak = max(self.peak, now)
            self.drawdown = max(self.drawdown, 1 - now / self.peak)

    def done(self):
        self.close_step()
        return [(self.trades, self.volume, len(self.held), self.value(), self.drawdown)]


def _events(events: DataFrame, machine: Callable[[int], object]) -> DataFrame:
    order = F.when(F.col("kind") == "RESOLUTION", 0).when(F.col("kind") == "NEW", 1).otherwise(2)
    columns = ["ts", "kind", "contract", "price", "volume", "sell", "skill", "outcome", "end"]
    return in_order(events.where("ts is not null").withColumn("_order", order), columns, ["ts", "_order", "id"], machine, EventMachine.RESULT)


def event_replay(events: DataFrame, p: EventParams = EventParams()) -> DataFrame:
    """Long and short positions on price moves. events: config, ts, id, kind (NEW, RESOLUTION or TRADE; at equal times resolutions go first), contract, price,
    volume, sell, skill (a Brier score), outcome, end. A contract's signal adds up its trades, more for skilled wallets, and is reset when it passes
    ``splash``; the model's price then gives an edge over the price before. Candidates of a minute are ranked by edge a day and bought while cash
    lasts, with friction, spread and the impact on the contract's liquidity. Exits: stop loss, turned signal, resolution (a void pays a half).

    A candidate's cash is taken once, when it is bought at the end of its minute."""
    return _events(events, lambda _: EventMachine(p))


def tune(events: DataFrame, splash: list[float], size: list[float], least_edge: list[float], p: EventParams = EventParams()) -> DataFrame:
    """Replays every combination of the three lists, a configuration each, and ranks them by return over drawdown + 0.01; ties go to the first combination.
    events: as for ``event_replay``, without config."""
    grid = list(itertools.product(splash, size, least_edge))
    plans = [replace(p, splash=a, size=b, least_edge=c) for a, b, c in grid]
    own = F.explode(F.array(*(F.lit(i) for i in range(len(grid))))).alias("config")
    done = _events(events.select("*", own), lambda i: EventMachine(plans[i]))
    of = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(g, ("splash", "size", "least_edge"), strict=True))) for g in grid))
    score = (F.col("final_value") / p.cash - 1) / (F.col("drawdown") + 0.01)
    ranked = done.withColumn("score", score).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "config")))  # one row a combination
    return ranked.select("place", "config", F.element_at(of, F.col("config") + 1).alias("g"), "trades", "final_value", "drawdown", "score").select("place", "config", "g.*", "trades", "final_value", "drawdown", "score")


def walk_forward(events: DataFrame, plan: list[tuple[int, int, int, int]], splash: list[float], size: list[float], least_edge: list[float], p: EventParams = EventParams()) -> DataFrame:
    """For each fold of ``plan`` (train start, train end, test start, test end in seconds, ends open) the combination that does best in training, and what it
    gives in the test: fold, splash, size, least_edge, train_score, test_value, test_drawdown, trades. Folds without rows give none."""
    grid = list(itertools.product(splash, size, least_edge))
    plans = [replace(p, splash=a, size=b, least_edge=c) for a, b, c in grid]
    within = lambda lo, hi: (F.col("ts") >= lo) & (F.col("ts") < hi)
    trained = [events.where(within(a, b)).select("*", F.explode(F.array(*(F.lit(i * len(grid) + g) for g in range(len(grid))))).alias("config")) for i, (a, b, _, _) in enumerate(plan)]
    done = _events(reduce(DataFrame.unionByName, trained), lambda c: EventMachine(plans[c % len(grid)]))
    score = (F.col("final_value") / p.cash - 1) / (F.col("drawdown") + 0.01)
    ranked = done.select(F.floor(F.col("config") / len(grid)).cast("int").alias("fold"), (F.col("config") % len(grid)).alias("g"), score.alias("score"))
    best = ranked.groupBy("fold").agg(F.max_by(F.struct("g", "score"), F.struct(F.round("score", 9), -F.col("g"))).alias("b")).collect()  # one row a fold
    chosen = {r["fold"]: (r["b"]["g"], r["b"]["score"]) for r in best}
    if not chosen:
        return events.sparkSession.createDataFrame([], "fold int, splash double, size double, least_edge double, train_score double, test_value double, test_drawdown double, trades int")
    tested = [events.where(within(plan[i][2], plan[i][3])).withColumn("config", F.lit(i)) for i in sorted(chosen)]
    out = _events(reduce(DataFrame.unionByName, tested), lambda c: EventMachine(plans[chosen[c][0]]))
    named = events.sparkSession.createDataFrame([(i, *grid[g], s) for i, (g, s) in chosen.items()], "fold int, splash double, size double, least_edge double, train_score double")
    return named.join(out.select(F.col("config").alias("fold"), F.col("final_value").alias("test_value"), F.col("drawdown").alias("test_drawdown"), "trades"), "fold")


@dataclass(frozen=True)
class PortfolioParams:
    bank: float = 10_000.0
    stake: float = 100.0
    slippage: float = 0.05
    take_profit: float = 0.95
    required: int = 1  # signals of a contract before it is bought
    consecutive: bool = True


class PortfolioMachine:
    """Rows of one second are taken together: settle what has ended, sell at take-profit, buy by priority."""

    RESULT = "market long, contract long, entry_ts long, exit_ts long, price double, shares double, stake double, paid double, state string"

    def __init__(self, p: PortfolioParams):
        self.p, self.cash = p, p.bank
        self.open: dict = {}
        self.due: list = []
        self.seen: set = set()
        self.counts: dict = {}
        self.second: list = []
        self.rows: list = []

    def row(self, ts, id_, contract, market, price, signal, priority, outcome, end):
        if self.second and self.second[0][0] != ts:
            self.flush()
        self.second.append((ts, id_, contract, market, price, signal, priority, outcome, end))

    def out(self, contract, ts, paid, state):
        market, entry, price, shares, _ = self.open.pop(contract)
        self.cash += paid
        self.rows.append((market, contract, entry, ts, price, shares, self.p.stake, paid, state))

    def settle(self, ts):
        while self.due and self.due[0][0] <= ts:
            end, contract, entry = heapq.heappop(self.due)
            held = self.open.get(contract)
            if held and held[1] == entry and held[4] is not None:
                self.out(contract, end, held[3] * held[4], "settled")

    def flush(self):
        p, rows = self.p, self.second
        self.second = []
        if not rows:
            return
        ts = rows[0][0]
        self.settle(ts)
        for _, _, contract, _, price, *_ in rows:
            if contract in self.open and price >= p.take_profit:
                self.out(contract, ts, self.open[contract][3] * price * (1 - p.slippage), "sold")
        buys = []
        for r in rows:
            contract, market, signal = r[2], r[3], r[5]
            if signal and contract not in self.open and market not in self.seen:
                self.counts[contract] = self.counts.get(contract, 0) + 1
                if self.counts[contract] >= p.required:
                    buys.append(r)
            elif not signal and p.consecutive:
                self.counts.pop(contract, None)
        for _, _, contract, market, price, _, _, outcome, end in sorted(buys, key=lambda r: -r[6]):
            if market in self.seen or contract in self.open or self.cash < p.stake:
                continue
            shares = p.stake / min(0.99, max(0.001, price * (1 + p.slippage)))
            self.cash -= p.stake
            self.seen.add(market)
            self.counts.pop(contract, None)
            self.open[contract] = (market, ts, price, shares, outcome)
            if end is not None:
                heapq.heappush(self.due, (end, contract, ts))

    def done(self):
        self.flush()
        for contract in sorted(self.open):
            market, entry, price, shares, _ = self.open[contract]
            self.rows.append((market, contract, entry, None, price, shares, self.p.stake, None, "open"))
        return self.rows


def portfolio_replay(rows: DataFrame, p: PortfolioParams = PortfolioParams()) -> DataFrame:
    """One line a position: what was bought, and how it ended, or state 'open'. rows: config, id, ts, contract, market, price, signal (boolean), priority, outcome (of
    the token, null if not known), end. A contract is bought at its ``required``-th signal (in a row, if ``consecutive``), a market once."""
    columns = ["ts", "id", "contract", "market", "price", "signal", "priority", "outcome", "end"]
    return in_order(rows.where("ts is not null"), columns, ["ts", "id"], lambda _: PortfolioMachine(p), PortfolioMachine.RESULT)


def drained(positions: DataFrame, markets: DataFrame, last_prices: DataFrame, horizon: int) -> DataFrame:
    """Positions (as from ``portfolio_replay``) after the data end: open ones whose market (contract, outcome, end) ended by ``horizon`` with a known outcome are
    settled; all others are carried at the contract's last price (or their entry price), which counts as neither won nor lost."""
    m = markets.select("contract", F.col("outcome").alias("_o"), F.col("end").alias("_e"))
    x = positions.join(m, "contract", "left").join(last_prices.select("contract", F.col("price").alias("_last")), "contract", "left")
    open_ = F.col("state") == "open"
    due = open_ & F.coalesce(F.col("_e") <= horizon, F.lit(False)) & F.col("_o").isNotNull()
    state = F.when(due, "settled").when(open_, "carried").otherwise(F.col("state"))
    value = F.when(due, F.col("shares") * F.col("_o")).when(open_, F.col("shares") * F.coalesce("_last", "price")).otherwise(F.col("paid"))
    done = x.select(*(F.col(c) for c in positions.columns if c not in ("state", "paid", "exit_ts")), F.when(due, F.col("_e")).otherwise(F.col("exit_ts")).alias("exit_ts"), value.alias("value"), state.alias("state"))
    return done.withColumn("won", F.when(F.col("state") != "carried", F.col("value") > F.col("stake")))


def exits(positions: DataFrame, ticks: DataFrame, stop: float, take: float) -> DataFrame:
    """Each position's first later price at which its gain over the mean price falls under -``stop`` or rises over ``take``. positions: contract, ts, avg_price."""
    x = ticks.select("contract", F.col("ts").alias("at"), "id", F.col("price").alias("now")).join(positions.select("contract", "ts", "avg_price"), "contract").where("at > ts")
    x = x.withColumn("gain", (F.col("now") - F.col("avg_price")) / F.col("avg_price")).where((F.col("gain") < -stop) | (F.col("gain") > take))
    return x.groupBy("contract", "ts").agg(F.min_by(F.struct("id", "at", "now", "gain"), F.struct("at", "id")).alias("x")).select("contract", "ts", "x.*")
