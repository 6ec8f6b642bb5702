"""The 101 published formulaic alphas (Kakushadze, 2015) as calls of the factor operators.

Fractional windows are cut to whole rows by the operators. All industry levels use ``sector``.
"""

from __future__ import annotations

from ..functions.factors import Book, Ex, absolute, cs_rank, cs_scale, grp_demean, larger, log, sign, signedpower, smaller
from ..functions.factors import ts_argmax, ts_argmin, ts_corr, ts_cov, ts_decay_linear, ts_delay, ts_delta, ts_max, ts_min, ts_product, ts_rank, ts_std, ts_sum, where


def alphas(b: Book, wanted: list[int]) -> dict[str, Ex]:
    """The wanted alphas by name (``alpha_001``)."""
    op, hi, lo, cl, vol, vw, cap, ret = b.open, b.high, b.low, b.close, b.volume, b.vwap, b.cap, b.returns
    rank, scale, neutral, delta, delay, std = cs_rank, cs_scale, grp_demean, ts_delta, ts_delay, ts_std
    corr, cov, decay, total = ts_corr, ts_cov, ts_decay_linear, ts_sum

    def adv(n: int) -> Ex:
        return b.field(f"adv{n}")

    def mix(x: Ex, y: Ex, share: float) -> Ex:
        return x * share + y * (1 - share)

    def mid() -> Ex:
        return (hi + lo) / 2

    def moved(n: int, rest: Ex) -> Ex:
        d = delta(cl, 1)
        return where(ts_min(d, n) > 0, d, where(ts_max(d, n) < 0, d, rest))

    def bend() -> Ex:
        return (delay(cl, 20) - delay(cl, 10)) / 10 - (delay(cl, 10) - cl) / 10

    def clv() -> Ex:
        return (cl - lo) - (hi - cl)

    # The published formulas.
    formulas = {
        1: lambda: rank(ts_argmax(signedpower(where(ret < 0, std(ret, 20), cl), 2.0), 5)) - 0.5,
        2: lambda: -1 * corr(rank(delta(log(vol), 2)), rank((cl - op) / op), 6),
        3: lambda: -1 * corr(rank(op), rank(vol), 10),
        4: lambda: -1 * ts_rank(rank(lo), 9),
        5: lambda: rank(op - total(vw, 10) / 10) * (-1 * absolute(rank(cl - vw))),
        6: lambda: -1 * corr(op, vol, 10),
        7: lambda: where(adv(20) < vol, (-1 * ts_rank(absolute(delta(cl, 7)), 60)) * sign(delta(cl, 7)), -1.0),
        8: lambda: -1 * rank(total(op, 5) * total(ret, 5) - delay(total(op, 5) * total(ret, 5), 10)),
        9: lambda: moved(5, -1 * delta(cl, 1)),
        10: lambda: rank(moved(4, -1 * delta(cl, 1))),
        11: lambda: (rank(ts_max(vw - cl, 3)) + rank(ts_min(vw - cl, 3))) * rank(delta(vol, 3)),
        12: lambda: sign(delta(vol, 1)) * (-1 * delta(cl, 1)),
        13: lambda: -1 * rank(cov(rank(cl), rank(vol), 5)),
        14: lambda: (-1 * rank(delta(ret, 3))) * corr(op, vol, 10),
        15: lambda: -1 * total(rank(corr(rank(hi), rank(vol), 3)), 3),
        16: lambda: -1 * rank(cov(rank(hi), rank(vol), 5)),
        17: lambda: ((-1 * rank(ts_rank(cl, 10))) * rank(delta(delta(cl, 1), 1))) * rank(ts_rank(vol / adv(20), 5)),
        18: lambda: -1 * rank((std(absolute(cl - op), 5) + (cl - op)) + corr(cl, op, 10)),
        19: lambda: (-1 * sign((cl - delay(cl, 7)) + delta(cl, 7))) * (1 + rank(1 + total(ret, 250))),
        20: lambda: ((-1 * rank(op - delay(hi, 1))) * rank(op - delay(cl, 1))) * rank(op - delay(lo, 1)),
        21: lambda: where(total(cl, 8) / 8 + std(cl, 8) < total(cl, 2) / 2, -1.0, where(total(cl, 2) / 2 < total(cl, 8) / 8 - std(cl, 8), 1.0, where((vol / adv(20) > 1) | (vol / adv(20) == 1), 1.0, -1.0))),
        22: lambda: -1 * (delta(corr(hi, vol, 5), 5) * rank(std(cl, 20))),
        23: lambda: where(total(hi, 20) / 20 < hi, -1 * delta(hi, 2), 0.0),
        24: lambda: where((delta(total(cl, 100) / 100, 100) / delay(cl, 100) < 0.05) | (delta(total(cl, 100) / 100, 100) / delay(cl, 100) == 0.05), -1 * (cl - ts_min(cl, 100)), -1 * delta(cl, 3)),
        25: lambda: rank(((-1 * ret) * adv(20)) * vw * (hi - cl)),
        26: lambda: -1 * ts_max(corr(ts_rank(vol, 5), ts_rank(hi, 5), 5), 3),
        27: lambda: where(rank(total(corr(rank(vol), rank(vw), 6), 2) / 2.0) > 0.5, -1.0, 1.0),
        28: lambda: scale((corr(adv(20), lo, 5) + mid()) - cl),
        29: lambda: ts_min(ts_product(rank(rank(scale(log(total(ts_min(rank(rank(-1 * rank(delta(cl - 1, 5)))), 2), 1))))), 1), 5) + ts_rank(delay(-1 * ret, 6), 5),
        30: lambda: ((1.0 - rank((sign(cl - delay(cl, 1)) + sign(delay(cl, 1) - delay(cl, 2))) + sign(delay(cl, 2) - delay(cl, 3)))) * total(vol, 5)) / total(vol, 20),
        31: lambda: (rank(rank(rank(decay(-1 * rank(rank(delta(cl, 10))), 10)))) + rank(-1 * delta(cl, 3))) + sign(scale(corr(adv(20), lo, 12))),
        32: lambda: scale(total(cl, 7) / 7 - cl) + 20 * scale(corr(vw, delay(cl, 5), 230)),
        33: lambda: rank(-1 * signedpower(1 - op / cl, 1.0)),
        34: lambda: rank((1 - rank(std(ret, 2) / std(ret, 5))) + (1 - rank(delta(cl, 1)))),
        35: lambda: (ts_rank(vol, 32) * (1 - ts_rank((cl + hi) - lo, 16))) * (1 - ts_rank(ret, 32)),
        36: lambda: (((2.21 * rank(corr(cl - op, delay(vol, 1), 15)) + 0.7 * rank(op - cl)) + 0.73 * rank(ts_rank(delay(-1 * ret, 6), 5))) + rank(absolute(corr(vw, adv(20), 6)))) + 0.6 * rank((total(cl, 200) / 200 - op) * (cl - op)),
        37: lambda: rank(corr(delay(op - cl, 1), cl, 200)) + rank(op - cl),
        38: lambda: (-1 * rank(ts_rank(cl, 10))) * rank(cl / op),
        39: lambda: (-1 * rank(delta(cl, 7) * (1 - rank(decay(vol / adv(20), 9))))) * (1 + rank(total(ret, 250))),
        40: lambda: (-1 * rank(std(hi, 10))) * corr(hi, vol, 10),
        41: lambda: signedpower(hi * lo, 0.5) - vw,
        42: lambda: rank(vw - cl) / rank(vw + cl),
        43: lambda: ts_rank(vol / adv(20), 20) * ts_rank(-1 * delta(cl, 7), 8),
        44: lambda: -1 * corr(hi, rank(vol), 5),
        45: lambda: -1 * ((rank(total(delay(cl, 5), 20) / 20) * corr(cl, vol, 2)) * rank(corr(total(cl, 5), total(cl, 20), 2))),
        46: lambda: where(bend() > 0.25, -1.0, where(bend() < 0, 1.0, -1 * (cl - delay(cl, 1)))),
        47: lambda: ((rank(1 / cl) * vol) / adv(20)) * ((hi * rank(hi - cl)) / (total(hi, 5) / 5)) - rank(vw - delay(vw, 5)),
        48: lambda: neutral((corr(delta(cl, 1), delta(delay(cl, 1), 1), 250) * delta(cl, 1)) / cl) / total(signedpower(delta(cl, 1) / delay(cl, 1), 2.0), 250),
        49: lambda: where(bend() < -0.1, 1.0, -1 * (cl - delay(cl, 1))),
        50: lambda: -1 * ts_max(rank(corr(rank(vol), rank(vw), 5)), 5),
        51: lambda: where(bend() < -0.05, 1.0, -1 * (cl - delay(cl, 1))),
        52: lambda: ((-1 * ts_min(lo, 5) + delay(ts_min(lo, 5), 5)) * rank((total(ret, 240) - total(ret, 20)) / 220)) * ts_rank(vol, 5),
        53: lambda: -1 * delta(clv() / (cl - lo), 9),
        54: lambda: (-1 * ((lo - cl) * signedpower(op, 5.0))) / ((lo - hi) * signedpower(cl, 5.0)),
        55: lambda: -1 * corr(rank((cl - ts_min(lo, 12)) / (ts_max(hi, 12) - ts_min(lo, 12))), rank(vol), 6),
        56: lambda: 0 - rank(total(ret, 10) / total(total(ret, 2), 3)) * rank(ret * cap),
        57: lambda: 0 - (cl - vw) / decay(rank(ts_argmax(cl, 30)), 2),
        58: lambda: -1 * ts_rank(decay(corr(neutral(vw), vol, 3.92795), 7.89291), 5.50322),
        59: lambda: -1 * ts_rank(decay(corr(neutral(mix(vw, vw, 0.728317)), vol, 4.25197), 16.2289), 8.19648),
        60: lambda: 0 - (2 * scale(rank((clv() / (hi - lo)) * vol)) - scale(rank(ts_argmax(cl, 10)))),
        61: lambda: rank(vw - ts_min(vw, 16.1219)) < rank(corr(vw, adv(180), 17.9282)),
        62: lambda: (rank(corr(vw, total(adv(20), 22.4101), 9.91009)) < rank((rank(op) + rank(op)) < (rank(mid()) + rank(hi)))) * -1,
        63: lambda: (rank(decay(delta(neutral(cl), 2.25164), 8.22237)) - rank(decay(corr(mix(vw, op, 0.318108), total(adv(180), 37.2467), 13.557), 12.2883))) * -1,
        64: lambda: (rank(corr(total(mix(op, lo, 0.178404), 12.7054), total(adv(120), 12.7054), 16.6208)) < rank(delta(mix(mid(), vw, 0.178404), 3.69741))) * -1,
        65: lambda: (rank(corr(mix(op, vw, 0.00817205), total(adv(60), 8.6911), 6.40374)) < rank(op - ts_min(op, 13.635))) * -1,
        66: lambda: (rank(decay(delta(vw, 3.51013), 7.23052)) + ts_rank(decay((mix(lo, lo, 0.96633) - vw) / (op - mid()), 11.4157), 6.72611)) * -1,
        67: lambda: signedpower(rank(hi - ts_min(hi, 2.14593)), rank(corr(neutral(vw), neutral(adv(20)), 6.02936))) * -1,
        68: lambda: (ts_rank(corr(rank(hi), rank(adv(15)), 8.91644), 13.9333) < rank(delta(mix(cl, lo, 0.518371), 1.06157))) * -1,
        69: lambda: signedpower(rank(ts_max(delta(neutral(vw), 2.72412), 4.79344)), ts_rank(corr(mix(cl, vw, 0.490655), adv(20), 4.92416), 9.0615)) * -1,
        70: lambda: signedpower(rank(delta(vw, 1.29456)), ts_rank(corr(neutral(cl), adv(50), 17.8256), 17.9171)) * -1,
        71: lambda: larger(ts_rank(decay(corr(ts_rank(cl, 3.43976), ts_rank(adv(180), 12.0647), 18.0175), 4.20501), 15.6948), ts_rank(decay(signedpower(rank((lo + op) - (vw + vw)), 2.0), 16.4662), 4.4388)),
        72: lambda: rank(decay(corr(mid(), adv(40), 8.93345), 10.1519)) / rank(decay(corr(ts_rank(vw, 3.72469), ts_rank(vol, 18.5188), 6.86671), 2.95011)),
        73: lambda: larger(rank(decay(delta(vw, 4.72775), 2.91864)), ts_rank(decay((delta(mix(op, lo, 0.147155), 2.03608) / mix(op, lo, 0.147155)) * -1, 3.33829), 16.7411)) * -1,
        74: lambda: (rank(corr(cl, total(adv(30), 37.4843), 15.1365)) < rank(corr(rank(mix(hi, vw, 0.0261661)), rank(vol), 11.4791))) * -1,
        75: lambda: rank(corr(vw, vol, 4.24304)) < rank(corr(rank(lo), rank(adv(50)), 12.4413)),
        76: lambda: larger(rank(decay(delta(vw, 1.24383), 11.8259)), ts_rank(decay(ts_rank(corr(neutral(lo), adv(81), 8.14941), 19.569), 17.1543), 19.383)) * -1,
        77: lambda: smaller(rank(decay((mid() + hi) - (vw + hi), 20.0451)), rank(decay(corr(mid(), adv(40), 3.1614), 5.64125))),
        78: lambda: signedpower(rank(corr(total(mix(lo, vw, 0.352233), 19.7428), total(adv(40), 19.7428), 6.83313)), rank(corr(rank(vw), rank(vol), 5.77492))),
        79: lambda: rank(delta(neutral(mix(cl, op, 0.60733)), 1.23438)) < rank(corr(ts_rank(vw, 3.60973), ts_rank(adv(150), 9.18637), 14.6644)),
        80: lambda: signedpower(rank(sign(delta(neutral(mix(op, hi, 0.868128)), 4.04545))), ts_rank(corr(hi, adv(10), 5.11456), 5.53756)) * -1,
        81: lambda: (rank(log(ts_product(rank(signedpower(rank(corr(vw, total(adv(10), 49.6054), 8.47743)), 4.0)), 14.9655))) < rank(corr(rank(vw), rank(vol), 5.07914))) * -1,
        82: lambda: smaller(rank(decay(delta(op, 1.46063), 14.8717)), ts_rank(decay(corr(neutral(vol), mix(op, op, 0.634196), 17.4842), 6.92131), 13.4283)) * -1,
        83: lambda: (rank(delay((hi - lo) / (total(cl, 5) / 5), 2)) * rank(rank(vol))) / (((hi - lo) / (total(cl, 5) / 5)) / (vw - cl)),
        84: lambda: signedpower(ts_rank(vw - ts_max(vw, 15.3217), 20.7127), delta(cl, 4.96796)),
        85: lambda: signedpower(rank(corr(mix(hi, cl, 0.876703), adv(30), 9.61331)), rank(corr(ts_rank(mid(), 3.70596), ts_rank(vol, 10.1595), 7.11408))),
        86: lambda: (ts_rank(corr(cl, total(adv(20), 14.7444), 6.00049), 20.4195) < rank((op + cl) - (vw + op))) * -1,
        87: lambda: larger(rank(decay(delta(mix(cl, vw, 0.369701), 1.91233), 2.65461)), ts_rank(decay(absolute(corr(neutral(adv(81)), cl, 13.4132)), 4.89768), 14.4535)) * -1,
        88: lambda: smaller(rank(decay((rank(op) + rank(lo)) - (rank(hi) + rank(cl)), 8.06882)), ts_rank(decay(corr(ts_rank(cl, 8.44728), ts_rank(adv(60), 20.6966), 8.01266), 6.65053), 2.61957)),
        89: lambda: ts_rank(decay(corr(mix(lo, lo, 0.967285), adv(10), 6.94279), 5.51607), 3.79744) - ts_rank(decay(delta(neutral(vw), 3.48158), 10.1466), 15.3012),
        90: lambda: signedpower(rank(cl - ts_max(cl, 4.66719)), ts_rank(corr(neutral(adv(40)), lo, 5.38375), 3.21856)) * -1,
        91: lambda: (ts_rank(decay(decay(corr(neutral(cl), vol, 9.74928), 16.398), 3.83219), 4.8667) - rank(decay(corr(vw, adv(30), 4.01303), 2.6809))) * -1,
        92: lambda: smaller(ts_rank(decay((mid() + cl) < (lo + op), 14.7221), 18.8683), ts_rank(decay(corr(rank(lo), rank(adv(30)), 7.58555), 6.94024), 6.80584)),
        93: lambda: ts_rank(decay(corr(neutral(vw), adv(81), 17.4193), 19.848), 7.54455) / rank(decay(delta(mix(cl, vw, 0.524434), 2.77377), 16.2664)),
        94: lambda: signedpower(rank(vw - ts_min(vw, 11.5783)), ts_rank(corr(ts_rank(vw, 19.6462), ts_rank(adv(60), 4.02992), 18.0926), 2.70756)) * -1,
        95: lambda: rank(op - ts_min(op, 12.4105)) < ts_rank(signedpower(rank(corr(total(mid(), 19.1351), total(adv(40), 19.1351), 12.8742)), 5.0), 11.7584),
        96: lambda: larger(ts_rank(decay(corr(rank(vw), rank(vol), 3.83878), 4.16783), 8.38151), ts_rank(decay(ts_argmax(corr(ts_rank(cl, 7.45404), ts_rank(adv(60), 4.13242), 3.65459), 12.6556), 14.0365), 13.4143)) * -1,
        97: lambda: (rank(decay(delta(neutral(mix(lo, vw, 0.721001)), 3.3705), 20.4523)) - ts_rank(decay(ts_rank(corr(ts_rank(lo, 7.87871), ts_rank(adv(60), 17.255), 4.97547), 18.5925), 15.7152), 6.71659)) * -1,
        98: lambda: rank(decay(corr(vw, total(adv(5), 26.4719), 4.58418), 7.18088)) - rank(decay(ts_rank(ts_argmin(corr(rank(op), rank(adv(15)), 20.8187), 8.62571), 6.95668), 8.07206)),
        99: lambda: (rank(corr(total(mid(), 19.8975), total(adv(60), 19.8975), 8.8136)) < rank(corr(lo, vol, 6.28259))) * -1,
        100: lambda: 0 - (1.5 * scale(neutral(neutral(rank((clv() / (hi - lo)) * vol)))) - scale(neutral(corr(cl, rank(adv(20)), 5) - rank(ts_argmin(cl, 30))))) * (vol / adv(20)),
        101: lambda: (cl - op) / ((hi - lo) + 0.001),
    }
    return {f"alpha_{k:03d}": formulas[k]() for k in wanted}
