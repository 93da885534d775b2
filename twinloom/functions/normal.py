"""Normal CDF, its inverse, and the log-gamma function as Spark columns and numpy.

Spark has no ``erf`` and no ``lgamma``. The published rational approximations are used:
Hart's for the CDF (as given by West, 2005), Wichura's AS241 for the inverse, and the
Lanczos series (g = 7) for log-gamma. All are accurate to about 1e-15.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions import counter
from twinloom.functions.counter import sealed
from twinloom.functions.names import quoted, ref

# Hart/West coefficients, highest power first.
CDF_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# AS241 (PPND16) coefficients, highest power first.
PPF_CENTRE_NUM = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
    1.3314166789178437745e2, 3.3871328727963666080e0,
)
PPF_CENTRE_DEN = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
    4.2313330701600911252e1, 1.0,
)
PPF_MIDDLE_NUM = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
    4.63033784615654529590e0, 1.42343711074968357734e0,
)
PPF_MIDDLE_DEN = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
    2.05319162663775882187e0, 1.0,
)
PPF_TAIL_NUM = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
    2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
    5.46378491116411436990e0, 6.65790464350110377720e0,
)
PPF_TAIL_DEN = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
    5.99832206555887937690e-1, 1.0,
)
# Lanczos series, g = 7.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
)
LOG_SQRT_2PI = 0.5 * math.log(2.0 * math.pi)
# Probabilities are kept this far from 0 and 1 before inversion (single-precision epsilon).
U_CLIP = 2.0**-23
# Segments of (0, 1) that have an expansion of the inverse CDF each, used up to this far from the middle.
SEGMENTS = 1 << 16
REACH = 2.25


def horner(coefficients, x):
    """Polynomial value, highest power first."""
    acc = coefficients[0]
    for c in coefficients[1:]:
        acc = x * acc + c
    return acc


def _horner_text(coefficients, x: str) -> str:
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({x} * {text} + {c!r}D)"
    return text


def norm_cdf(name: str) -> Column:
    """Standard normal CDF of a column, given by name.

    The formulas here are parsed from text: built operator by operator they cost more
    time on the driver than a small query takes to run.
    """
    x = quoted(name)
    a = f"abs({x})"
    e = f"exp({a} * {a} * -0.5D)"
    chain = f"({a} + 0.65D)"
    for k in (4, 3, 2, 1):
        chain = f"({a} + {k}.0D / {chain})"
    near = f"{e} * {_horner_text(CDF_NUM, a)} / {_horner_text(CDF_DEN, a)}"
    upper = (
        f"CASE WHEN {a} < 7.07106781186547D THEN {near} "
        f"WHEN {a} <= 37.0D THEN {e} / {chain} / 2.506628274631D ELSE 0.0D END"
    )
    return F.expr(f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1.0D - ({upper}) ELSE ({upper}) END")


def with_norm_ppf(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add ``out`` = inverse normal CDF of column ``source`` (values strictly in (0, 1))."""
    base = [ref(c) for c in df.columns if c != out]
    u = quoted(source)
    df = df.select(
        *base,
        F.expr(f"{u} - 0.5D").alias("__q"),
        F.expr(f"sqrt(-ln(least({u}, 1.0D - {u})))").alias("__s"),
    )
    df = df.select(
        *base,
        F.col("__q"),
        F.expr("0.180625D - __q * __q").alias("__r"),
        F.expr("__s - 1.6D").alias("__m"),
        F.expr("__s - 5.0D").alias("__t"),
    )
    centre = f"__q * {_horner_text(PPF_CENTRE_NUM, '__r')} / {_horner_text(PPF_CENTRE_DEN, '__r')}"
    middle = f"{_horner_text(PPF_MIDDLE_NUM, '__m')} / {_horner_text(PPF_MIDDLE_DEN, '__m')}"
    tail = f"{_horner_text(PPF_TAIL_NUM, '__t')} / {_horner_text(PPF_TAIL_DEN, '__t')}"
    value = (
        f"CASE WHEN abs(__q) <= 0.425D THEN {centre} "
        f"ELSE sign(__q) * (CASE WHEN __m <= 3.4D THEN {middle} ELSE {tail} END) END"
    )
    return sealed(df, base, F.expr(value), out)


def ln_gamma(name: str) -> Column:
    """log Gamma of a positive column, given by name; below 0.5 through Gamma(x) = Gamma(x+1)/x."""
    x = quoted(name)
    y = f"(CASE WHEN {x} < 0.5D THEN {x} ELSE {x} - 1.0D END)"
    series = f"{LANCZOS[0]!r}D" + "".join(
        f" + {c!r}D / ({y} + {float(i)!r}D)" for i, c in enumerate(LANCZOS[1:], start=1)
    )
    t = f"({y} + {LANCZOS_G + 0.5!r}D)"
    value = f"{LOG_SQRT_2PI!r}D + ({y} + 0.5D) * ln({t}) - {t} + ln({series})"
    return F.expr(f"{value} - (CASE WHEN {x} < 0.5D THEN ln({x}) ELSE 0.0D END)")


def np_norm_cdf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    a = np.minimum(np.abs(x), 38.0)
    e = np.exp(-0.5 * a * a)
    near = e * horner(CDF_NUM, a) / horner(CDF_DEN, a)
    chain = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        chain = a + k / chain
    upper = np.where(a < 7.07106781186547, near, e / chain / 2.506628274631)
    return np.where(x > 0, 1.0 - upper, upper)


def np_norm_ppf(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, dtype=np.float64)
    q = u - 0.5
    r = 0.180625 - q * q
    value = q * horner(PPF_CENTRE_NUM, r) / horner(PPF_CENTRE_DEN, r)
    out = np.abs(q) > 0.425
    if out.any():
        s = np.sqrt(-np.log(np.minimum(u[out], 1.0 - u[out])))
        m = s - 1.6
        t = s - 5.0
        middle = horner(PPF_MIDDLE_NUM, m) / horner(PPF_MIDDLE_DEN, m)
        tail = horner(PPF_TAIL_NUM, t) / horner(PPF_TAIL_DEN, t)
        value[out] = np.sign(q[out]) * np.where(s <= 5.0, middle, tail)
    return value


def np_normal_grid(seed: int, outer: np.ndarray, inner: np.ndarray, block: int = 16384) -> np.ndarray:
    """``np_norm_ppf(uniform_grid(seed, outer, inner))`` in 32-bit lanes, by blocks that stay in a core's cache."""
    outer, inner = np.asarray(outer, np.int64), np.asarray(inner, np.int64)
    firsts, words = _lane_parts(seed, outer, inner)
    out = np.empty((len(outer), len(inner)))
    # blocks of whole rows where rows are short, of one row's stretches where they are long
    height = max(1, block // max(len(inner), 1))
    for top in range(0, len(outer), height):
        for left in range(0, len(inner), block):
            lanes = [_folded(first[top : top + height, None] + word[None, left : left + block]) for first, word in zip(firsts, words)]
            out[top : top + height, left : left + block] = _ppf_of_centred(_centred(*lanes))
    return out


_TOP = np.uint32(0x80000000)


def _lane_parts(seed: int, outer: np.ndarray, inner: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each lane, what ``outer`` and ``inner`` add up to before the last fold."""
    firsts, words = [], []
    for lane, (_, fold) in enumerate(counter.LANES):
        word = lambda k: ((k ^ (((k >> 32) & counter.HIGH) * fold)) & counter.MASK)
        firsts.append(counter._np_round((counter.lane_start(seed, lane) + word(outer)) & counter.MASK).astype(np.uint32))
        words.append(word(inner).astype(np.uint32))
    return firsts, words


def _folded(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(counter.MULTIPLIER)
    x ^= x >> np.uint32(16)
    return x


def _centred(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The uniform less one half; all its bits fit a double. The lanes are used up."""
    upper ^= _TOP
    q = upper.view(np.int32) * 2.0**-32
    lower >>= np.uint32(12)
    low = lower.view(np.int32) * 2.0**-52
    low += 2.0**-53
    q += low
    return q


def _in_place(coefficients, x: np.ndarray) -> np.ndarray:
    acc = x * coefficients[0]
    for c in coefficients[1:-1]:
        acc += c
        acc *= x
    acc += coefficients[-1]
    return acc


def _ppf_of_centred(q: np.ndarray) -> np.ndarray:
    r = q * q
    np.subtract(0.180625, r, out=r)
    value = _in_place(PPF_CENTRE_NUM, r)
    value *= q
    value /= _in_place(PPF_CENTRE_DEN, r)
    flat, centred = value.reshape(-1), q.reshape(-1)
    far = np.flatnonzero(r.reshape(-1) < 0.180625 - 0.425 * 0.425)
    if len(far):
        flat[far] = _ppf_of_far(centred[far])
    return value


def _ppf_of_far(side: np.ndarray) -> np.ndarray:
    s = np.sqrt(-np.log(0.5 - np.abs(side)))
    m = s - 1.6
    tail = _in_place(PPF_MIDDLE_NUM, m) / _in_place(PPF_MIDDLE_DEN, m)
    beyond = np.flatnonzero(s > 5.0)
    if len(beyond):
        t = s[beyond] - 5.0
        tail[beyond] = horner(PPF_TAIL_NUM, t) / horner(PPF_TAIL_DEN, t)
    return np.copysign(tail, side)


@lru_cache(1)
def _segments() -> tuple[np.ndarray, np.ndarray, float]:
    """Inverse CDF and slope at the middle of each segment, over sqrt(2), and the slope from which they don't serve.

    A segment is cut into 2**32 steps d. With x at its middle and t = slope * d, x + t / (1 - x t / 2) is the inverse
    but for (1 + x x / 2) t^3 / 6 and smaller terms; the line closest to that term is added to the slope.
    """
    x = np_norm_ppf((np.arange(SEGMENTS) + (0.5 + 2.0**-33)) / SEGMENTS)
    slope = math.sqrt(2.0 * math.pi) * np.exp(x * x / 2.0) / SEGMENTS
    slope *= 1.0 + (1.0 + x * x / 2.0) * slope * slope / 32.0
    last = slope[np.abs(x) <= REACH].max()
    return x * math.sqrt(0.5), slope * (2.0**-32 * math.sqrt(0.5)), last * (2.0**-32 * math.sqrt(0.5))


def np_normal_products(
    seed: int, outer: np.ndarray, inner: np.ndarray, weights: np.ndarray, block: int = 32768, held: int = 1 << 18
) -> np.ndarray:
    """``np_normal_grid(seed, outer, inner) @ weights``, each normal to 1e-13 (root mean square; 3e-12 at most).

    Most normals are expanded from the middle of one of ``SEGMENTS`` segments, which takes about half the
    time; those beyond ``REACH`` are inverted. At most ``block`` normals go through a step at a time, and ``held``
    (or one row's) meet the weights.
    """
    outer, inner = np.asarray(outer, np.int64), np.asarray(inner, np.int64)
    out = np.zeros((len(outer), weights.shape[1]))
    for left in range(0, len(inner), block):
        _add_products(out, seed, outer, inner[left : left + block], weights[left : left + block], block, held)
    return out


def _add_products(out: np.ndarray, seed: int, outer: np.ndarray, inner: np.ndarray, weights: np.ndarray, block: int, held: int) -> None:
    firsts, words = _lane_parts(seed, outer, inner)
    middles, slopes, last = _segments()
    half, fold, one = np.uint32(16), np.array(counter.MULTIPLIER, np.uint32), np.array(1.0)
    n = len(inner)
    rows = max(1, min(len(outer), held // n))
    height = max(1, min(rows, block // n))
    # whole words of eight marks
    marks = np.zeros(-(-rows * n // 8) * 8, bool)
    normals = np.empty((rows, n))
    lanes, moved = np.empty((2, height * n), np.uint32), np.empty(height * n, np.uint32)
    place, step, slope = np.empty(height * n, np.intp), np.empty(height * n), np.empty(height * n)
    for top in range(0, len(outer), rows):
        stop = min(top + rows, len(outer))
        for low in range(top, stop, height):
            high = min(low + height, stop)
            size = (high - low) * n
            x, y, shift, k, d, g = lanes[0, :size], lanes[1, :size], moved[:size], place[:size], step[:size], slope[:size]
            for lane, first, word in zip((x, y), firsts, words):
                np.add(first[low:high, None], word, out=lane.reshape(-1, n))
                np.right_shift(lane, half, out=shift)
                np.bitwise_xor(lane, shift, out=lane)
                np.multiply(lane, fold, out=lane)
                np.right_shift(lane, half, out=shift)
                np.bitwise_xor(lane, shift, out=lane)
                np.multiply(lane, fold, out=lane)
            # the upper half of the first lane is the segment, its lower half and the upper one of the second are the step
            np.right_shift(x, half, out=shift)
            np.copyto(k, shift.view(np.int32))
            np.bitwise_xor(x, shift, out=x)
            np.left_shift(x, half, out=x)
            np.right_shift(y, half, out=y)
            np.bitwise_or(x, y, out=x)
            np.bitwise_xor(x, _TOP, out=x)
            np.copyto(d, x.view(np.int32))
            z = normals[low - top : high - top].reshape(-1)
            np.take(middles, k, out=z, mode="clip")
            np.take(slopes, k, out=g, mode="clip")
            np.greater(g, last, out=marks[(low - top) * n : (high - top) * n])
            np.multiply(g, d, out=g)
            np.multiply(z, g, out=d)
            np.subtract(one, d, out=d)
            np.divide(g, d, out=g)
            np.add(z, g, out=z)
        made = normals[: stop - top]
        marks[made.size :] = False
        far = _marked(marks)
        if len(far):
            row, column = np.divmod(far, n)
            ends = [_folded(first[top + row] + word[column]) for first, word in zip(firsts, words)]
            made.reshape(-1)[far] = _ppf_of_far(_centred(*ends)) * math.sqrt(0.5)
        out[top:stop] += (made @ weights) * math.sqrt(2.0)


def _marked(marks: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of few marks, whose number is a multiple of eight."""
    words = marks.view(np.uint64)
    some = np.flatnonzero(words)
    inside = np.flatnonzero(words[some].view(bool))
    return (some[inside >> 3] << 3) + (inside & 7)
