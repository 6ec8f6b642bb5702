"""32 named indicators and the composed factor queries, as calls of the factor operators."""

from __future__ import annotations

from ..functions.factors import Book, Ex, absolute, cs_rank, grp_demean, larger, sign, ts_argmax, ts_argmin, ts_corr, ts_cov, ts_cumsum, ts_decay_linear
from ..functions.factors import ts_delay, ts_delta, ts_ewm, ts_max, ts_mean, ts_min, ts_returns, ts_slope, ts_sma_cn, ts_std, ts_sum, ts_var, where

#: Keeps quotients of ranges defined.
TINY = 1e-12


def indicators(b: Book, wanted: list[str] | None = None) -> dict[str, Ex]:
    """The indicators by lower-case name, with their usual parameters."""
    hi, lo, cl, vol, vw = b.high, b.low, b.close, b.volume, b.vwap

    def true_range() -> Ex:
        before = ts_delay(cl, 1)
        return larger(larger(hi - lo, absolute(hi - before)), absolute(lo - before))

    def typical() -> Ex:
        return (hi + lo + cl) / 3

    def flow() -> Ex:
        return ts_cumsum((((cl - lo) - (hi - cl)) / (hi - lo + TINY)) * vol)

    def band(side: float) -> Ex:
        return ts_mean(cl, 20) + side * 2 * ts_std(cl, 20)

    def gains(x: Ex, y: Ex) -> Ex:
        return 100 * x / (x + y + TINY)

    def stochastic() -> Ex:
        return 100 * (cl - ts_min(lo, 14)) / (ts_max(hi, 14) - ts_min(lo, 14) + TINY)

    def money(up: bool) -> Ex:
        turn = ts_delta(typical(), 1)
        return ts_sum(where((turn > 0) if up else (turn < 0), typical() * vol, 0.0), 14)

    def cci() -> Ex:
        off = typical() - ts_mean(typical(), 14)
        return off / (0.015 * ts_mean(absolute(off), 14) + TINY)

    def macd() -> Ex:
        return ts_ewm(cl, 12) - ts_ewm(cl, 26)

    def aroon(up: bool) -> Ex:
        return 100 * (25 - (ts_argmax(hi, 26) if up else ts_argmin(lo, 26))) / 25

    def beta() -> Ex:
        own, market = ts_returns(cl, 1), ts_returns(vw, 1)
        return ts_cov(own, market, 60) / (ts_var(market, 60) + TINY)

    made = {
        "sma": lambda: ts_mean(cl, 20),
        "ema": lambda: ts_ewm(cl, 20),
        "wma": lambda: ts_decay_linear(cl, 20),
        "rsi": lambda: gains(ts_sma_cn(larger(ts_delta(cl, 1), 0.0), 14, 1), ts_sma_cn(larger(-ts_delta(cl, 1), 0.0), 14, 1)),
        "macd": macd,
        "macd_signal": lambda: ts_ewm(macd(), 9),
        "ppo": lambda: 100 * macd() / ts_ewm(cl, 26),
        "roc": lambda: 100 * ts_returns(cl, 10),
        "mom": lambda: ts_delta(cl, 10),
        "bb_upper": lambda: band(1),
        "bb_lower": lambda: band(-1),
        "bb_percent_b": lambda: (cl - band(-1)) / (4 * ts_std(cl, 20) + TINY),
        "trange": true_range,
        "atr": lambda: ts_sma_cn(true_range(), 14, 1),
        "natr": lambda: 100 * ts_sma_cn(true_range(), 14, 1) / cl,
        "stoch_k": stochastic,
        "stoch_d": lambda: ts_mean(stochastic(), 3),
        "willr": lambda: -100 * (ts_max(hi, 14) - cl) / (ts_max(hi, 14) - ts_min(lo, 14) + TINY),
        "cci": cci,
        "mfi": lambda: gains(money(True), money(False)),
        "obv": lambda: ts_cumsum(sign(ts_delta(cl, 1)) * vol),
        "ad": flow,
        "adosc": lambda: ts_ewm(flow(), 3) - ts_ewm(flow(), 10),
        "aroon_up": lambda: aroon(True),
        "aroon_down": lambda: aroon(False),
        "aroon_osc": lambda: aroon(True) - aroon(False),
        "beta": beta,
        "correl": lambda: ts_corr(cl, vol, 30),
        "linearreg_slope": lambda: ts_slope(cl, 14),
        "stddev": lambda: ts_std(cl, 20),
        "var": lambda: ts_var(cl, 20),
        "trix": lambda: 100 * ts_returns(ts_ewm(ts_ewm(ts_ewm(cl, 15), 15), 15), 1),
    }
    return {n: made[n]() for n in (wanted or made)}


NAMES = (
    "sma ema wma rsi macd macd_signal ppo roc mom bb_upper bb_lower bb_percent_b trange atr natr stoch_k stoch_d willr cci mfi obv ad adosc "
    "aroon_up aroon_down aroon_osc beta correl linearreg_slope stddev var trix"
).split()


def composed(b: Book, name: str) -> Ex:
    """The composed factor queries."""
    cl, vol, vw = b.close, b.volume, b.vwap
    made = {
        "q1_momentum_rank": lambda: cs_rank(ts_returns(cl, 20)),
        "q2_low_volatility": lambda: -1 * cs_rank(ts_std(ts_returns(cl, 1), 60)),
        "q3_relative_volume": lambda: vol / ts_mean(vol, 10),
        "q4_momentum_and_calm": lambda: cs_rank(ts_returns(cl, 20)) + cs_rank(1 / ts_std(ts_returns(cl, 1), 20)),
        "q5_price_volume_correlation": lambda: cs_rank(ts_corr(cl, vol, 20)),
        "q6_sector_neutral_deviation": lambda: grp_demean((cl - vw) / vw),
        "q7_reversal_on_volume": lambda: where(vol > ts_mean(vol, 20), -1 * ts_returns(cl, 5), 0.0),
        "q8_days_since_high": lambda: cs_rank(ts_argmax(b.high, 10)) * sign(ts_returns(cl, 20)),
        "q9_sector_neutral_spread": lambda: grp_demean(cs_rank(ts_returns(cl, 5)) - cs_rank(ts_returns(cl, 20))),
        "q10_oversold": lambda: indicators(b, ["rsi"])["rsi"] <= 30,
    }
    return made[name]()


COMPOSED = (
    "q1_momentum_rank q2_low_volatility q3_relative_volume q4_momentum_and_calm q5_price_volume_correlation q6_sector_neutral_deviation "
    "q7_reversal_on_volume q8_days_since_high q9_sector_neutral_spread q10_oversold"
).split()
