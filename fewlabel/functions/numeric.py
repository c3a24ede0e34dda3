"""Array and scalar expressions over logits (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax(logits) -> Column:
    x = _c(logits)
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda v: v / s)


def logsumexp(logits) -> Column:
    x = _c(logits)
    m = F.array_max(x)
    return m + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda a, b: a + b))


def max_prob(logits) -> Column:
    """Largest softmax probability: 1 / sum(exp(x - max))."""
    x = _c(logits)
    m = F.array_max(x)
    return F.lit(1.0) / F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda a, b: a + b)


def argmax(logits) -> Column:
    """0-based position of the first maximum."""
    x = _c(logits)
    return (F.array_position(x, F.array_max(x)) - 1).cast("bigint")


def cross_entropy(logits, target) -> Column:
    """``logsumexp(x) - x[target]`` (target 0-based)."""
    x = _c(logits)
    return logsumexp(x) - F.element_at(x, (_c(target) + 1).cast("int"))


def tsa_threshold(step, total_steps, num_classes) -> Column:
    """Training-signal annealing threshold ``exp((t/T - 1) * 5) * (1 - 1/K) + 1/K``."""
    t, total, k = _c(step), _c(total_steps), _c(num_classes)
    inv_k = F.lit(1.0) / k
    return F.exp((t / total - F.lit(1.0)) * F.lit(5.0)) * (F.lit(1.0) - inv_k) + inv_k


def annealed_confidence(step, total_steps, num_classes) -> Column:
    """Confidence threshold that follows the annealing: the cube root of ``tsa_threshold``."""
    return F.pow(tsa_threshold(step, total_steps, num_classes), F.lit(1.0 / 3.0))


def total_steps(n_train: int, batch_size: int, accumulation: int = 1, max_epochs: int = 1,
                max_steps: int = 0) -> tuple[int, int]:
    """(max_steps, max_epochs) as the trainer derives them from the train size."""
    batches = -(-n_train // batch_size)
    per_epoch = batches // accumulation
    if max_steps > 0:
        return max_steps, max_steps // max(per_epoch, 1) + 1
    return per_epoch * max_epochs, max_epochs
