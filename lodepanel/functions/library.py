"""Ready-made feature families as expressions over panels."""

from __future__ import annotations

import math

from .expr import Const, Expression, Var, Where, call

V = Var
OPEN, HIGH, LOW, CLOSE, VOLUME = (Var(c) for c in ("open", "high", "low", "close", "volume"))


def change(x: Expression, n: int) -> Expression:
    """x over its value n rows before, less one; NULL unless that value is positive."""
    return call("over_positive", x, call("delay", x, n)) - 1


RETURNS = change(CLOSE, 1)
LOG_RETURNS = call("ln", call("over_positive", CLOSE, call("delay", CLOSE, 1)))
DOLLARS = CLOSE * VOLUME

ALPHAS: dict[str, Expression] = {
    "alpha_001": call("rank", call("ts_argmax", call("signed_power", call("abs", RETURNS), 2.0), 5)) - 0.5,
    "alpha_002": -call("ts_corr", call("rank", call("delta", VOLUME, 2)), call("rank", (CLOSE - OPEN) / OPEN), 6),
    "alpha_006": -call("ts_corr", OPEN, VOLUME, 10),
    "alpha_012": call("sign", call("delta", VOLUME, 1)) * -call("delta", CLOSE, 1),
    "alpha_026": -call("ts_corr", call("rank", VOLUME), call("rank", HIGH), 5),
    "alpha_041": call("rank", HIGH - CLOSE) - call("rank", HIGH - OPEN),
    "alpha_101": (CLOSE - OPEN) / (HIGH - LOW + 0.001),
    "ts_zscore_close_20d": call("ts_zscore", CLOSE, 20),
    "ts_rank_volume_60d": call("ts_rank", call("abs", call("decay_linear", VOLUME, 5)), 60),
}

OPERATOR_SAMPLES: dict[str, Expression] = {
    "delta": call("delta", CLOSE, 3),
    "delay": call("delay", CLOSE, 5),
    "ts_rank": call("ts_rank", CLOSE, 10),
    "ts_zscore": call("ts_zscore", VOLUME, 20),
    "ts_corr": call("ts_corr", CLOSE, VOLUME, 20),
    "decay_linear": call("decay_linear", CLOSE, 10),
    "ts_argmax": call("ts_argmax", CLOSE, 10),
    "rank": call("rank", CLOSE),
    "zscore": call("zscore", CLOSE),
    "group_rank": call("group_rank", CLOSE, "sector"),
    "abs": call("abs", CLOSE - OPEN),
    "sign": call("sign", CLOSE - OPEN),
    "signed_power": call("signed_power", (CLOSE - OPEN) / OPEN, 2.0),
    "where_compare": Where(CLOSE > OPEN, HIGH - OPEN, Const(0.0) - LOW),
    "negative": -CLOSE,
    "arithmetic": (CLOSE + OPEN) / (HIGH - LOW) * 0.5 - VOLUME,
    "group_rolling_mean": call("ts_mean", CLOSE, 5),
    "group_rolling_std": call("ts_std", CLOSE, 5),
    "group_rolling_std0": call("ts_std0", CLOSE, 5),
    "group_rolling_sum": call("ts_sum", VOLUME, 5),
    "group_rolling_max": call("ts_max", CLOSE, 5),
    "group_rolling_min": call("ts_min", CLOSE, 5),
    "group_rolling_partial": call("part_mean", CLOSE, 5) + call("part_std", CLOSE, 5),
    "group_shift": call("lead", CLOSE, 2),
    "group_pct_change": change(CLOSE, 2),
    "rolling_cov": call("ts_cov", CLOSE, VOLUME, 10),
    "rolling_skew": call("ts_skew", CLOSE, 20),
    "rolling_kurt": call("ts_kurt", CLOSE, 20),
}

_DOWN = call("at_most", RETURNS, Const(0.0))
_YEAR_HIGH = CLOSE / call("ts_max", CLOSE, 252) - 1
_GAP = call("over_positive", OPEN, call("delay", CLOSE, 1)) - 1
PRICE_VOLUME: dict[str, dict[str, Expression]] = {
    "pv_returns": {f"ret_{n}d": change(CLOSE, n) for n in (1, 5, 10, 21, 63, 126, 252)},
    "pv_momentum": {f"mom_{m}_1": call("over_positive", call("delay", CLOSE, 21), call("delay", CLOSE, n)) - 1 for m, n in ((12, 252), (6, 126), (3, 63))},
    "pv_reversal": {f"reversal_{n}d": -change(CLOSE, n) for n in (1, 5, 21)},
    "pv_low_vol": {f"low_vol_{n}d": -call("ts_std", RETURNS, n) for n in (21, 63, 126)} | {"low_downside_vol_63d": -call("ts_std", _DOWN, 63)},
    "pv_liquidity": {
        "dollar_volume_20d": call("ts_mean", DOLLARS, 20),
        "volume_z_20d": call("ts_zscore", VOLUME, 20),
        "low_amihud_20d": -call("ts_mean", call("over_positive", call("abs", RETURNS), DOLLARS) * 1e6, 20),
    },
    "pv_range": {
        "high_low_range_1d": (HIGH - LOW) / CLOSE,
        "high_low_range_20d": call("ts_mean", (HIGH - LOW) / CLOSE, 20),
        "overnight_gap": _GAP,
        "close_to_open_return": _GAP,
        "open_to_close_return": call("over_positive", CLOSE, OPEN) - 1,
        "distance_to_52w_high": _YEAR_HIGH,
        "drawdown_from_252d_high": _YEAR_HIGH,
    },
}

SHORT, LONG = 21, 63


def _ln(a: Expression, b: Expression) -> Expression:
    return call("ln", call("over_positive", a, b))


_HL, _CO = _ln(HIGH, LOW), _ln(CLOSE, OPEN)
_RS = _ln(HIGH, CLOSE) * _ln(HIGH, OPEN) + _ln(LOW, CLOSE) * _ln(LOW, OPEN)
_ABS1, _ABS2, _ABS3 = (call("abs", LOG_RETURNS if k == 0 else call("delay", LOG_RETURNS, k)) for k in range(3))
_RV = call("ts_sum", LOG_RETURNS * LOG_RETURNS, SHORT)
_BPV = call("ts_sum", _ABS1 * _ABS2, SHORT) * (math.pi / 2)
_CLIP0 = lambda x: call("at_least", x, Const(0.0))
_COVR = call("ts_cov", RETURNS, call("delay", RETURNS, 1), SHORT)
_BETA = _HL * _HL + call("delay", _HL, 1) * call("delay", _HL, 1)
_H2, _L2 = call("ts_max", HIGH, 2), call("ts_min", LOW, 2)
_GAMMA = _ln(_H2, _L2) * _ln(_H2, _L2)
_K = 3 - 2 * math.sqrt(2)
_ALPHA = (call("sqrt", 2 * _BETA) - call("sqrt", _BETA)) / _K - call("sqrt", _GAMMA / _K)
_CS = 2 * (call("exp", _ALPHA) - 1) / (call("exp", _ALPHA) + 1)
_YZ_K = 0.34 / (1.34 + (SHORT + 1) / (SHORT - 1))
_ON = _ln(OPEN, call("delay", CLOSE, 1))
_Q = 5
_QRET = _ln(CLOSE, call("delay", CLOSE, _Q))
_MED = call("median3", _ABS1, _ABS2, _ABS3)
_MU23 = 2 ** (1 / 3) * math.gamma(5 / 6) / math.gamma(1 / 2)
MICROSTRUCTURE: dict[str, dict[str, Expression]] = {
    "ms_range_vol": {
        "parkinson_vol": call("sqrt", _CLIP0(call("ts_mean", _HL * _HL / (4 * math.log(2)), SHORT))),
        "garman_klass_vol": call("sqrt", _CLIP0(call("ts_mean", 0.5 * _HL * _HL - (2 * math.log(2) - 1) * _CO * _CO, SHORT))),
        "rogers_satchell_vol": call("sqrt", _CLIP0(call("ts_mean", _RS, SHORT))),
        "yang_zhang_vol": call("sqrt", _CLIP0(call("ts_var", _ON, SHORT) + _YZ_K * call("ts_var", _CO, SHORT) + (1 - _YZ_K) * call("ts_mean", _RS, SHORT))),
    },
    "ms_spread": {
        "close_in_range": call("ts_mean", (CLOSE - LOW) / (HIGH - LOW), SHORT),
        "roll_spread": Where(_COVR < 0, 2 * call("sqrt", -_COVR), Const(0.0) / 0),
        "corwin_schultz_spread": call("ts_mean", _CLIP0(_CS), SHORT),
        "high_low_asymmetry": (call("ts_max", HIGH, SHORT) - CLOSE) / (CLOSE - call("ts_min", LOW, SHORT)),
    },
    "ms_correlation": {
        "return_autocorr": call("ts_corr", RETURNS, call("delay", RETURNS, 1), SHORT),
        "volume_autocorr": call("ts_corr", VOLUME, call("delay", VOLUME, 1), SHORT),
        "volume_return_correlation": call("ts_corr", call("abs", RETURNS), VOLUME, SHORT),
        "range_persistence": call("ts_corr", _HL, call("delay", _HL, 1), SHORT),
    },
    "ms_moments": {
        "realized_skew": call("ts_skew", RETURNS, LONG),
        "realized_kurt": call("ts_kurt", RETURNS, LONG),
        "variance_ratio_q_1": call("ts_var", _QRET, LONG) / (_Q * call("ts_var", LOG_RETURNS, LONG)),
    },
    "ms_jumps": {
        "bipower_variation": call("ts_mean", (math.pi / 2) * _ABS1 * _ABS2, SHORT),
        "med_rv": (math.pi / (6 - 4 * math.sqrt(3) + math.pi)) * call("ts_mean", _MED * _MED, SHORT),
        "tripower_variation": _MU23**-3 * call("ts_mean", call("power", _ABS1, 2 / 3) * call("power", _ABS2, 2 / 3) * call("power", _ABS3, 2 / 3), SHORT),
        "realized_jump_intensity": call("at_most", _CLIP0((_RV - _BPV) / _RV), Const(1.0)),
    },
}


def _ttm(c: str) -> Expression:
    return call("ts_sum", V(c), 4)


def _avg4(c: str) -> Expression:
    return call("ts_mean", V(c), 4)


def _yoy(x: Expression) -> Expression:
    return x - call("delay", x, 4)


_P = lambda a, b: call("over_positive", a, b)
_REV = _ttm("revenue")
_FCF_YIELD = _P(_ttm("fcf"), V("marketcap"))
_ROE, _ROA = _P(_ttm("netinc"), _avg4("equity")), _P(_ttm("netinc"), _avg4("assets"))
_REV_G = change(V("revenue"), 4)
FUNDAMENTALS: dict[str, dict[str, Expression]] = {
    "fund_quality": {
        "roe_ttm": _ROE,
        "roa_ttm": _ROA,
        "roic_ttm": _P(_ttm("opinc"), _avg4("equity") + _avg4("debt")),
        "gross_margin": _P(V("gp"), V("revenue")),
        "operating_margin": _P(V("opinc"), V("revenue")),
        "net_margin": _P(V("netinc"), V("revenue")),
        "asset_turnover": _P(_REV, _avg4("assets")),
        "equity_multiplier": _P(V("assets"), V("equity")),
        "gross_profitability_q": _P(V("gp"), V("assets")),
        "cash_to_assets": _P(V("cashneq"), V("assets")),
    },
    "fund_growth": {
        "revenue_growth_yoy": _REV_G,
        "revenue_growth_qoq": change(V("revenue"), 1),
        "gross_profit_growth_yoy": change(V("gp"), 4),
        "operating_income_growth_yoy": change(V("opinc"), 4),
        "net_income_growth_yoy": change(V("netinc"), 4),
        "fcf_growth_yoy": change(V("fcf"), 4),
        "equity_growth_yoy": change(V("equity"), 4),
        "low_asset_growth_yoy": -change(V("assets"), 4),
    },
    "fund_acceleration": {
        "fcf_yield_ttm": _FCF_YIELD,
        "revenue_growth_accel": _REV_G - call("delay", _REV_G, 1),
        "gross_margin_delta": _yoy(_P(V("gp"), V("revenue"))),
        "operating_margin_delta": _yoy(_P(V("opinc"), V("revenue"))),
        "net_margin_delta": _yoy(_P(V("netinc"), V("revenue"))),
        "roe_delta_yoy": _yoy(_ROE),
        "roa_delta_yoy": _yoy(_ROA),
        "fcf_yield_delta": _yoy(_FCF_YIELD),
    },
    "fund_cash_flow": {
        "fcf_margin": _P(V("fcf"), V("revenue")),
        "cfo_margin": _P(V("ncfo"), V("revenue")),
        "capex_to_assets": _P(-V("capex"), V("assets")),
        "capex_to_sales": _P(-V("capex"), V("revenue")),
        "cash_conversion": _P(_ttm("ncfo"), _ttm("netinc")),
        "cfo_to_net_income": _P(_ttm("ncfo"), _ttm("netinc")),
        "fcf_to_net_income": _P(_ttm("fcf"), _ttm("netinc")),
        "low_accruals_4q": -_P(_ttm("netinc") - _ttm("ncfo"), _avg4("assets")),
    },
    "fund_value": {"book_to_price": _P(V("equity"), V("marketcap")), "earnings_to_price": _P(_ttm("netinc"), V("marketcap"))},
    "fund_leverage": {
        "low_debt_to_equity": -_P(V("debt"), V("equity")),
        "low_debt_to_assets": -_P(V("debt"), V("assets")),
        "low_net_debt_to_marketcap": -_P(V("debt") - V("cashneq"), V("marketcap")),
    },
    "fund_capital": {"dividend_yield": V("divyield"), "low_share_issuance_yoy": -change(V("sharesbas"), 4)},
}

_SMA = lambda n: call("ts_mean", CLOSE, n)
_RVOL = lambda n: call("ts_std0", LOG_RETURNS, n) * math.sqrt(252)
_MOM = lambda n: CLOSE / call("delay", CLOSE, n) - 1
CLOSE_FACTORS: dict[str, Expression] = {
    "sma_20": _SMA(20),
    "trailing_log_return": LOG_RETURNS,
    "distance_to_52w_high": (CLOSE - call("ts_max", CLOSE, 252)) / call("ts_max", CLOSE, 252),
    "trend_z_score": (CLOSE - _SMA(50)) / _SMA(50),
    "realized_vol": _RVOL(20),
    "vol_compression_ratio": Where(_RVOL(60) > 0, _RVOL(10) / _RVOL(60), Const(1.0)),
    "momentum_return": _MOM(63),
    "momentum_skip1m": call("delay", CLOSE, 21) / call("delay", CLOSE, 252) - 1,
    "short_term_reversal": -_MOM(5),
    "trend_quality": call("ts_mean", LOG_RETURNS, 63) / (call("ts_std0", LOG_RETURNS, 63) + 1e-9),
    "low_volatility": -_RVOL(63),
    "mean_reversion": -((CLOSE - _SMA(20)) / _SMA(20)),
}

_DRIFT = lambda n: call("ts_mean", LOG_RETURNS, n) / (call("ts_std0", LOG_RETURNS, n) + 1e-9)
#: The factors of the cross-sectional bundle, with the volatility forecast beside them.
STANDARD_FACTORS: dict[str, Expression] = {
    "momentum_1m": _MOM(21),
    "momentum_3m": _MOM(63),
    "momentum_12m_1m": CLOSE_FACTORS["momentum_skip1m"],
    "vol_compression": Where(_RVOL(21) > 0, _RVOL(5) / _RVOL(21), Const(1.0)),
    "short_term_reversal_5d": -_MOM(5),
    "trend_quality_63d": _DRIFT(63),
    "distance_to_52w_high": CLOSE_FACTORS["distance_to_52w_high"],
    "reversal_21d": -_MOM(21),
    "low_volatility_63d": -_RVOL(63),
    "mean_reversion_63d": -((CLOSE - _SMA(63)) / _SMA(63)),
    "realized_vol_21d": _RVOL(21),
}
