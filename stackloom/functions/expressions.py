"""Scalar expressions over 64-bit integers.

All wrap at 64 bits, compare and divide without sign, and give NULL where an
operand is absent. A predicate that is NULL lets a row pass (``passes``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIGN = -(2**63)
_UNSIGNED = "decimal(20,0)"



def _c(x: Column | int | str) -> Column:
    col = F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    return col.cast("bigint")


def _power(n: int) -> Column:
    return F.lit(str(2**n)).cast(_UNSIGNED)


def number(text: str) -> Column:
    """Decimal, octal (0...) or hexadecimal (0x...) digits, TRUE or FALSE, as a
    64-bit integer that wraps."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return F.lit(int(low == "true")).cast("bigint")
    n = int(low, 16) if low.startswith("0x") else int(low, 8) if len(low) > 1 and low.startswith("0") else int(low)
    n &= 2**64 - 1
    return F.lit(n - 2**64 if n >= 2**63 else n).cast("bigint")


def passes(e: Column) -> Column:
    """True where e is NULL or not 0."""
    return F.coalesce(e.cast("bigint") != 0, F.lit(True))


def truth(e: Column) -> Column:
    return e.cast("bigint") != 0


def flag(b: Column) -> Column:
    return b.cast("bigint")


def choose(cond: Column, yes: Column, no: Column) -> Column:
    """NULL where the condition is."""
    return F.when(cond.isNull(), None).when(truth(cond), yes).otherwise(no)


def both(a: Column, b: Column) -> Column:
    return flag(truth(a) & truth(b))


def either(a: Column, b: Column) -> Column:
    return flag(truth(a) | truth(b))


def same_truth(a: Column, b: Column) -> Column:
    return flag(truth(a) == truth(b))


def other_truth(a: Column, b: Column) -> Column:
    return flag(truth(a) != truth(b))


def bit_and(a, b) -> Column:
    return _c(a).bitwiseAND(_c(b))


def bit_or(a, b) -> Column:
    return _c(a).bitwiseOR(_c(b))


def bit_xor(a, b) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def bit_not(a) -> Column:
    return F.bitwise_not(_c(a))


def equal(a, b) -> Column:
    return flag(_c(a) == _c(b))


def differs(a, b) -> Column:
    return flag(_c(a) != _c(b))


def _order(x) -> Column:
    """Signed order of this is the unsigned order of x."""
    return _c(x).bitwiseXOR(F.lit(_SIGN).cast("bigint"))


def below(a, b) -> Column:
    return flag(_order(a) < _order(b))


def above(a, b) -> Column:
    return flag(_order(a) > _order(b))


def at_most(a, b) -> Column:
    return flag(_order(a) <= _order(b))


def at_least(a, b) -> Column:
    return flag(_order(a) >= _order(b))


def shift_left(a, count) -> Column:
    return F.call_function("shiftleft", _c(a), bit_and(count, 63).cast("int"))


def shift_right(a, count) -> Column:
    """Fills with zeros."""
    return F.call_function("shiftrightunsigned", _c(a), bit_and(count, 63).cast("int"))


def _halves(x: Column) -> tuple[Column, Column]:
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    return F.call_function("shiftrightunsigned", x, F.lit(32)), x.bitwiseAND(mask)


def plus(a, b) -> Column:
    """Wraps, with ANSI mode on or off: halves of 32 bits can't overflow."""
    (ah, al), (bh, bl) = _halves(_c(a)), _halves(_c(b))
    low = al + bl
    high = (ah + bh + F.call_function("shiftrightunsigned", low, F.lit(32))).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def negative(a) -> Column:
    return plus(bit_not(a), 1)


def minus(a, b) -> Column:
    return plus(a, negative(b))


def times(a, b) -> Column:
    """Wraps: products of 16- and 32-bit parts stay below 2**63."""
    (ah, al), (bh, bl) = _halves(_c(a)), _halves(_c(b))
    m16 = F.lit(0xFFFF).cast("bigint")
    out = None
    for i in range(2):
        part = F.call_function("shiftrightunsigned", bl, F.lit(16 * i)).bitwiseAND(m16)
        term = F.call_function("shiftleft", al * part, F.lit(16 * i))
        out = term if out is None else plus(out, term)
    for i in range(2):
        low = F.call_function("shiftrightunsigned", bl, F.lit(16 * i)).bitwiseAND(m16)
        high = F.call_function("shiftrightunsigned", bh, F.lit(16 * i)).bitwiseAND(m16)
        cross = F.call_function("shiftleft", ah * low, F.lit(16 * i + 32))
        out = plus(plus(out, cross), F.call_function("shiftleft", al * high, F.lit(16 * i + 32)))
    return out


def _wide(x: Column) -> Column:
    d = x.cast(_UNSIGNED)
    return F.when(x < 0, d + _power(64)).otherwise(d)


def _narrow(d: Column) -> Column:
    return F.when(d >= _power(63), (d - _power(64)).cast("bigint")).otherwise(d.cast("bigint"))


def quotient(a, b) -> Column:
    """Without sign; 0 where the divisor is 0."""
    a, b = _c(a), _c(b)
    safe = F.when(b == 0, F.lit(1).cast("bigint")).otherwise(b)
    fast = F.call_function("div", a, safe)
    q = F.when((a >= 0) & (b > 0), fast).when(b < 0, flag(_order(a) >= _order(b))).otherwise(_narrow(F.floor(_divide(a, safe)).cast(_UNSIGNED)))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(0).cast("bigint")).otherwise(q)


def _divide(a: Column, b: Column) -> Column:
    """a as unsigned over a positive b, exactly: decimal remainders first."""
    wide, d = _wide(a), b.cast(_UNSIGNED)
    return ((wide - wide % d) / d).cast(_UNSIGNED)


def remainder(a, b) -> Column:
    """Without sign; 0 where the divisor is 0."""
    a, b = _c(a), _c(b)
    safe = F.when(b == 0, F.lit(1).cast("bigint")).otherwise(b)
    r = F.when((a >= 0) & (b > 0), a % safe).otherwise(_narrow((_wide(a) % _wide(safe)).cast(_UNSIGNED)))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(0).cast("bigint")).otherwise(r)


def negated(a) -> Column:
    """Logical: 1 for 0, else 0."""
    return flag(_c(a) == 0)


def listed(*items: Column) -> Column:
    """A list as the comma builds it: the right operand comes first."""
    return F.array(*reversed([_c(i) for i in items]))


def all_in(needles: Column, values: Column) -> Column:
    """Every element of needles is in values; none needed if there is none."""
    return flag(F.size(F.array_except(needles, values)) == 0)


def some_in(needles: Column, values: Column) -> Column:
    return flag(F.coalesce(F.arrays_overlap(needles, values), F.lit(False)))


def ordered_in(needles: Column, values: Column) -> Column:
    """needles stand in values next to each other and in order."""
    n, m = F.size(needles), F.size(values)
    starts = F.when(m >= n, F.sequence(F.lit(1), m - n + 1)).otherwise(F.array().cast("array<int>"))
    return flag((n == 0) | F.exists(starts, lambda i: F.slice(values, i, n) == needles))


def has_column(df: DataFrame, name: str) -> Column:
    return F.lit(int(name.lower() in (c.lower() for c in df.columns))).cast("bigint")


def leaf(stack: Column | str) -> Column:
    """The last function of a root-to-leaf stack; NULL if it is empty."""
    stack = F.col(stack) if isinstance(stack, str) else stack
    return F.when(F.size(stack) > 0, F.element_at(stack, -1))


def stack_list(stack: Column | str, total: Column) -> Column:
    """Leaf to root, the total last."""
    stack = F.col(stack) if isinstance(stack, str) else stack
    return F.concat(F.reverse(stack), F.array(total))


def relative_time(tstamp, start) -> Column:
    return _c(tstamp) - _c(start)


def low_time(tstamp, start, evt_time) -> Column:
    """Start of an event: a positive duration ends at its time stamp."""
    return relative_time(tstamp, start) - F.greatest(F.coalesce(_c(evt_time), F.lit(0)), F.lit(0))


def high_time(tstamp, start, evt_time) -> Column:
    """End of an event: a negative duration begins at its time stamp."""
    return relative_time(tstamp, start) - F.least(F.coalesce(_c(evt_time), F.lit(0)), F.lit(0))


def tick_usec(nticks, ptimer_usec) -> Column:
    return _c(nticks) * _c(ptimer_usec)


def freq_mhz(clock_mhz) -> Column:
    """NULL where it isn't known."""
    return F.nullif(_c(clock_mhz), F.lit(0).cast("bigint"))


def thread_handle(exp_id, jthr_id) -> Column:
    return shift_left(exp_id, 32).bitwiseOR(_c(jthr_id))


def group_handle(group_id, exp_id) -> Column:
    return shift_left(group_id, 60).bitwiseOR(shift_left(exp_id, 32))


def io_or_heap_bytes(df: DataFrame, io_col: str = "ionbyte", heap_col: str = "hsize") -> Column:
    have = [F.col(c) for c in (io_col, heap_col) if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("bigint")


def default_value(df: DataFrame, name: str, unsigned32: Iterable[str] = ()) -> Column:
    """A column in an expression: unsigned 32-bit ones without sign, NULL for
    text, fractions, and columns that don't exist."""
    kinds = dict(df.dtypes)
    if kinds.get(name) in (None, "string", "double", "float"):
        return F.lit(None).cast("bigint")
    col = F.col(name)
    if kinds[name].startswith("struct"):
        return F.xxhash64(col)
    value = col.cast("bigint")
    return value.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) if name in unsigned32 else value
