"""SQL text for the checks: the numeric recipes written for a plain SQL engine."""

from __future__ import annotations

from twinloom.functions import counter, normal
from twinloom.functions import permutation as keyed


def poly(coefficients, x: str) -> str:
    text = repr(float(coefficients[0])) + "::double"
    for c in coefficients[1:]:
        text = f"({x} * {text} + {float(c)!r}::double)"
    return text


def uniform(source: str, columns: str, out: str, seed: int, *keys: str) -> str:
    """A subquery over ``source`` with ``columns`` and the uniform ``out``."""
    m = counter.MASK
    sql = source
    state = [f"{counter.lane_start(seed, i)}::bigint" for i in range(2)]
    for key in keys:
        words = [
            f"(xor({key}::bigint, (({key}::bigint >> 32) & {counter.HIGH}) * {counter.LANES[i][1]}::bigint) & {m})"
            for i in range(2)
        ]
        sql = (
            f"(select {columns}, "
            + ", ".join(f"(({state[i]} + {words[i]}) & {m}) as lane{i}" for i in range(2))
            + f" from {sql})"
        )
        for _ in range(2):
            sql = (
                f"(select {columns}, "
                + ", ".join(
                    f"((xor(lane{i}, lane{i} >> 16) * {counter.MULTIPLIER}::bigint) & {m}) as lane{i}"
                    for i in range(2)
                )
                + f" from {sql})"
            )
        state = [f"xor(lane{i}, lane{i} >> 16)" for i in range(2)]
    bits = f"(({state[0]}) * 1048576 + (({state[1]}) >> 12))"
    return f"(select {columns}, (({bits})::double + 0.5::double) / {counter.SCALE!r}::double as {out} from {sql})"


def norm_ppf(u: str) -> str:
    q = f"({u} - 0.5::double)"
    r = f"(0.180625::double - {q} * {q})"
    s = f"sqrt(-ln(least({u}, 1.0::double - {u})))"
    mid = f"({s} - 1.6::double)"
    tail = f"({s} - 5.0::double)"
    outer = (
        f"case when {s} <= 5.0::double then {poly(normal.PPF_MIDDLE_NUM, mid)} / {poly(normal.PPF_MIDDLE_DEN, mid)} "
        f"else {poly(normal.PPF_TAIL_NUM, tail)} / {poly(normal.PPF_TAIL_DEN, tail)} end"
    )
    return (
        f"(case when abs({q}) <= 0.425::double then {q} * {poly(normal.PPF_CENTRE_NUM, r)} / "
        f"{poly(normal.PPF_CENTRE_DEN, r)} when {q} < 0 then -({outer}) else ({outer}) end)"
    )


def norm_cdf(x: str) -> str:
    a = f"abs({x})"
    e = f"exp({a} * {a} * -0.5::double)"
    chain = f"({a} + 0.65::double)"
    for k in (4, 3, 2, 1):
        chain = f"({a} + {k}.0::double / {chain})"
    upper = (
        f"case when {a} < 7.07106781186547 then {e} * {poly(normal.CDF_NUM, a)} / {poly(normal.CDF_DEN, a)} "
        f"when {a} <= 37 then {e} / {chain} / 2.506628274631::double else 0.0::double end"
    )
    return f"(case when {x} > 0 then 1.0::double - ({upper}) else ({upper}) end)"


def name_key(name: str) -> str:
    return f"('0x' || substr(md5({name}), 1, 13))::bigint"


def permutation(source: str, columns: str, stream: int) -> str:
    """One walk of ``x`` below ``a * b`` through the permutation keyed by ``seed``; ``step`` goes up by one.

    ``source`` has ``columns`` (with ``seed``), ``x``, ``n``, ``a``, ``b`` and ``step``.
    """
    held = f"{columns}, n, a, b, step"
    sql = f"(select {held}, x // b as high, x % b as low from {source})"
    for k in range(0, keyed.ROUNDS, 2):
        rolled = uniform(sql, f"{held}, high, low", "u", stream + k, "seed", "low")
        sql = f"(select {held}, (high + floor(u * a)::bigint) % a as high, low from {rolled})"
        rolled = uniform(sql, f"{held}, high, low", "u", stream + k + 1, "seed", "high")
        sql = f"(select {held}, high, (low + floor(u * b)::bigint) % b as low from {rolled})"
    return f"select {columns}, high * b + low as x, n, a, b, step + 1 from {sql}"
