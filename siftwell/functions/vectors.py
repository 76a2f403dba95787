"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """A vector of length zero stays as it is."""
    v, n = a.cast("array<double>"), norm(a)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def last_token_pool(states: Column, mask: Column) -> Column:
    """The state of a text's last token: states is an array of vectors, mask has 1 for tokens and 0 for padding, on either
    side. A mask without any token gives the last state, null states or mask null."""
    tokens = F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))
    at = F.when((F.try_element_at(mask, F.lit(-1)) == 1) | (tokens == 0), -1).otherwise(tokens)
    return F.try_element_at(states, at)


def cls_pool(states: Column) -> Column:
    """The first token's state."""
    return F.try_element_at(states, F.lit(1))


def pair_score(no: Column, yes: Column, normalize: bool = True) -> Column:
    """The probability of yes against no by softmax over their logits, or the difference of the logits."""
    return 1 / (1 + F.exp(no - yes)) if normalize else yes - no
