"""Vector, bit and logit expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body or its lambdas name it."""
    return F.get(F.transform(F.array(value), body), 0)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    return let(F.greatest(norm(a), F.lit(1e-12)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: Column) -> Column:
    """Booleans to a 64-bit number, first bit highest."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1) + b.cast("bigint"))


def block_hash(block: Column) -> Column:
    """Bits above the median of all but the first of 64 coefficients (the middle one of 63)."""
    middle = F.element_at(F.array_sort(F.slice(block, 2, 63)), 32)
    return let(middle, lambda m: pack_bits(F.transform(block, lambda v: v > m)))


def argmax(logits: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    raised = lambda top: F.transform(logits, lambda x: F.exp((x.cast("double") - top) / temperature))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return let(let(F.array_max(logits).cast("double"), raised), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    total = lambda top: F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp((x.cast("double") - top) / temperature))
    each = lambda top, log: F.transform(logits, lambda x: (x.cast("double") - top) / temperature - log)
    return let(F.array_max(logits).cast("double"), lambda top: let(F.log(total(top)), lambda log: each(top, log)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax at the target; null where the target is no class of the logits."""
    return -F.get(log_softmax(logits), target)


def kl(teacher: Column, student: Column, temperature: float) -> Column:
    """KL(teacher || student) of the softened distributions."""
    p, q, r = softmax(teacher, temperature), log_softmax(teacher, temperature), log_softmax(student, temperature)
    terms = F.zip_with(p, F.zip_with(q, r, lambda a, b: a - b), lambda a, d: a * d)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and keys alone, whatever the partitioning: 52 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def gaussian(seed: int, *keys: Column) -> Column:
    """A standard normal draw by the same rule (Box-Muller)."""
    u = F.greatest(uniform(seed, F.lit("u"), *keys), F.lit(2.0**-53))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(seed, F.lit("v"), *keys))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def gamma(x: Column, g: Column) -> Column:
    """Power correction of a value in [0, 1]."""
    return F.pow(x, g)


def blend(x: Column, alpha: Column) -> Column:
    """Fog: towards white by alpha."""
    return x * (1 - alpha) + alpha
