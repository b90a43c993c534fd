"""Text helpers: times, numbers, labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One-letter type codes of class-file descriptors.
DESCRIPTOR_TYPES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void", "Z": "boolean"}


def time_ns(text: Column | str) -> Column:
    """"seconds.nanos" to nanoseconds; the digits after the point are a number
    of nanoseconds, not a fraction."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.trim(text), r"\.", 2)
    seconds, nanos = parts[0].try_cast("bigint"), F.coalesce(F.get(parts, 1).try_cast("bigint"), F.lit(0))
    return seconds * 1_000_000_000 + nanos


def c_number(text: Column | str) -> Column:
    """Signed decimal, 0x hexadecimal or 0 octal text to bigint, wrapping."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.lower(F.trim(text))
    body = F.regexp_replace(low, r"^[+-]", "")
    base10 = F.when(body.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, -10)).when(body.rlike("^0[0-7]+$"), F.conv(body, 8, -10)).when(body.rlike("^[0-9]+$"), F.conv(body, 10, -10))
    value = base10.cast("bigint")
    return F.when(low.startswith("-"), -value).otherwise(value)


def dotted_name(name: Column | str) -> Column:
    """Lpkg/Cls; to pkg.Cls; other names get dots for slashes."""
    name = F.col(name) if isinstance(name, str) else name
    return F.translate(F.regexp_replace(name, r"^L(.*);$", "$1"), "/", ".")


def parameter_list(descriptor: Column | str) -> Column:
    """(ILjava/lang/String;[D)V to (int, java.lang.String, double[]); NULL for
    what is no descriptor."""
    descriptor = F.col(descriptor) if isinstance(descriptor, str) else descriptor
    form = r"^[^()]*\(([^)]*)\)"
    inside = F.regexp_extract(descriptor, form, 1)
    items = F.regexp_extract_all(inside, F.lit(r"(\[*(?:L[^;]*;|[BCDFIJSVZ]))"), F.lit(1))
    base = lambda t: F.regexp_replace(t, r"^\[+", "")
    named = lambda t: F.coalesce(F.create_map(*[F.lit(x) for kv in DESCRIPTOR_TYPES.items() for x in kv])[base(t)], dotted_name(base(t)))
    shown = F.transform(items, lambda t: F.concat(named(t), F.repeat(F.lit("[]"), F.length(t) - F.length(base(t)))))
    sound = descriptor.rlike(form) & (F.array_join(items, "") == inside)
    return F.when(sound, F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")")))


def method_name(name: Column | str, descriptor: Column | str) -> Column:
    """A method's name with its parameters, or alone where they can't be told."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.concat(name, parameter_list(descriptor)), name)


def shown_number(value: Column | str) -> Column:
    """Three decimals; zero is "0."."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value == 0, "0.").otherwise(F.format_string("%.3f", value))


def group_label(name: str, key: Column | str) -> Column:
    """Label of a user-defined group where it has none of its own."""
    key = F.col(key) if isinstance(key, str) else key
    return F.format_string(name + " 0x%016x (%d)", key, key)
