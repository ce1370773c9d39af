"""Element-wise operators: on columns, and on array columns position by position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | int | float
INT_BITS = {"u8": 8, "i32": 32, "i64": 64}


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def each(a: Column, f: Callable[[Column], Column]) -> Column:
    """Apply ``f`` to every element of an array."""
    return F.transform(a, f)


def pairwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Apply ``f`` to elements at equal places; arrays of different sizes are an error."""
    checked = F.when(F.size(a) == F.size(b), b).otherwise(F.raise_error(F.lit("arrays must have equal sizes")).cast("array<double>"))
    return F.zip_with(a, checked, f)


def divide(a: Value, b: Value) -> Column:
    """IEEE division of doubles: x / 0 is an infinity, 0 / 0 not a number."""
    x, y = col(a).cast("double"), col(b).cast("double")
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, zero).otherwise(F.try_divide(x, y))


def wrap(x: Column, kind: str) -> Column:
    """An exact integer brought into the range of u8, i32 or i64 as a register would."""
    if kind == "u8":
        return F.pmod(x.cast("bigint"), F.lit(256)).cast("smallint")
    half = 1 << (INT_BITS[kind] - 1)
    shift, full = (F.lit(str(n)).cast("decimal(20,0)") for n in (half, 2 * half))
    return (F.pmod(x.cast("decimal(38,0)") + shift, full) - shift).cast("int" if kind == "i32" else "bigint")


def wrapping(op: str, a: Value, b: Value, kind: str) -> Column:
    """Integer + - * / with the wrap-around of u8, i32 or i64; division truncates, and by zero is an error."""
    x, y = col(a), col(b)
    if op == "/":
        checked = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(y)
        quotient = F.call_function("div", x.cast("bigint"), checked)
        return quotient if kind == "i64" else wrap(quotient, kind)
    size = "bigint" if kind in ("u8", "i32") and op != "*" else "decimal(19,0)"
    x, y = x.cast(size), y.cast(size)
    return wrap({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), kind)


def log(x: Column, strict: bool = False) -> Column:
    """Natural logarithm: null for x <= 0, or with ``strict`` an error."""
    if not strict:
        return F.ln(x)
    return F.when(x > 0, F.ln(x)).otherwise(F.when(x.isNotNull(), F.raise_error(F.lit("log of a number that is not positive")).cast("double")))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def total(a: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once for a row, not again for each element of an array."""
    return F.get(F.transform(F.array(value), f), 0)


def softmax(a: Column) -> Column:
    """Softmax of an array, shifted by its largest element; within the row, so without a shuffle."""
    shifted = let(F.array_max(a).cast("double"), lambda m: F.transform(a, lambda x: F.exp(x.cast("double") - m)))
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(a: Column) -> Column:
    def shift(m: Column) -> Column:
        lse = F.ln(total(F.transform(a, lambda x: F.exp(x.cast("double") - m))))
        return let(lse, lambda s: F.transform(a, lambda x: x.cast("double") - m - s))

    return let(F.array_max(a).cast("double"), shift)


def int_sqrt(x: Column, kind: str = "int") -> Column:
    """Square root of an integer, cut off."""
    return F.floor(F.sqrt(x.cast("double"))).cast(kind)


def power(a: Value, b: Value) -> Column:
    return F.pow(col(a), col(b))


def add(a: Column, b: Value | Column, array: bool = False) -> Column:
    return _arith(a, b, array, lambda x, y: x + y)


def sub(a: Column, b: Value, array: bool = False) -> Column:
    return _arith(a, b, array, lambda x, y: x - y)


def mul(a: Column, b: Value, array: bool = False) -> Column:
    return _arith(a, b, array, lambda x, y: x * y)


def div(a: Column, b: Value, array: bool = False) -> Column:
    return _arith(a, b, array, divide)


def _arith(a: Column, b: Value, array: bool, f: Callable[[Column, Column], Column]) -> Column:
    """Scalars, an array with a scalar (``array`` and a number), or two arrays."""
    if not array:
        return f(a, col(b))
    return pairwise(a, b, f) if isinstance(b, Column) else each(a, lambda x: f(x, F.lit(b)))


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return pairwise(x, y, lambda p, q: F.lit(alpha) * p + q)


def scal(alpha: float, x: Column) -> Column:
    return each(x, lambda p: F.lit(alpha) * p)


def strided_axpy(alpha: float, x: Column, incx: int, y: Column, incy: int, n: int) -> Column:
    """y with alpha * x[i * incx] added at place i * incy, for i < n."""
    return F.transform(y, lambda v, i: F.when((i % incy == 0) & (i / incy < n), v + F.lit(alpha) * F.get(x, (i / incy * incx).cast("int"))).otherwise(v))


def strided(x: Column, inc: int, n: int) -> Column:
    """The first n elements at a stride."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(x, i * inc)) if n else F.slice(x, 1, 0)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def asum(a: Column) -> Column:
    return total(F.transform(a, lambda x: F.abs(x.cast("double"))))


def nrm2(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    norms = nrm2(a) * nrm2(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms))


def iamax(a: Column) -> Column:
    """Place (from 0) of the first element of largest absolute value; 0 on an empty array."""
    sizes = F.transform(a, lambda x: F.abs(x))
    return F.coalesce(F.array_position(sizes, F.array_max(sizes)) - 1, F.lit(0)).cast("int")
