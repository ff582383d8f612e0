"""Vector maths on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use) -> Column:
    """``use(value)`` with value computed once, as inside a lambda it would be computed per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(norm(a), lambda size: F.transform(_col(a), lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0))))


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 if one of them is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def softmax(scores) -> Column:
    powers = let(F.array_max(_col(scores)), lambda top: F.transform(_col(scores), lambda x: F.exp(x - top)))
    return let(
        powers,
        lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total)
        ),
    )


def sigmoid(scores) -> Column:
    return F.transform(_col(scores), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def argmax(scores) -> Column:
    """Zero-based place of the largest value; the first wins a tie."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def mean_pool(tokens, mask) -> Column:
    """Mean of the token vectors whose mask is 1; the weight sum is floored at 1e-9."""
    tokens, mask = _col(tokens), _col(mask)
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m), F.lit(1e-9))
    weighted = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.reduce(
        F.slice(weighted, F.lit(2), F.greatest(F.size(weighted) - 1, F.lit(0))),
        F.element_at(weighted, 1),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y),
    )
    return let(weight, lambda w: F.transform(total, lambda x: x / w))
