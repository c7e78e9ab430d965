"""Scalar numeric helpers: decisions, half-even rounding, intervals, logit, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Clip applied before logs (the metric library's log-loss epsilon).
LOG_EPS = 1e-15
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decide(p, t) -> Column:
    """Binary call, inclusive: ``p >= t`` as 0/1."""
    return (_c(p) >= (t if isinstance(t, Column) else F.lit(float(t)))).cast("int")


def class_name(call, pos: str = "induction", neg: str = "inhibition") -> Column:
    return F.when(_c(call) == 1, F.lit(pos)).otherwise(F.lit(neg))


def round_half_even(c, digits: int) -> Column:
    """``np.round``: half-even on the decimal value."""
    return F.bround(_c(c), digits)


def interval_text(lo, hi, digits: int = 3) -> Column:
    """``lo-hi`` with fixed decimals; rounded half-even first so the text does not
    depend on the formatter's own tie rule."""
    fmt = f"%.{digits}f-%.{digits}f"
    return F.format_string(fmt, F.bround(_c(lo), digits), F.bround(_c(hi), digits))


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def logit(p, eps: float = LOG_EPS) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def hash_unit(*parts) -> Column:
    """Deterministic uniform in [0, 1) from md5 of ``a:b:...`` (32 bits).

    The same value is reproducible in any SQL engine with md5 and hex parsing.
    """
    key = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_long(*parts) -> Column:
    """Deterministic non-negative 32-bit integer from md5 of ``a:b:...``."""
    key = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_index(*parts) -> Column:
    """Deterministic non-negative 60-bit integer from md5 of ``a:b:...`` (row draws:
    far above any row count, so ``% n`` is even)."""
    key = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def hash_key(*parts) -> Column:
    """md5 hex of ``a:b:...`` (used as a shuffle order inside strata)."""
    return F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts]))


def count_le(edges, v, strict: bool = False) -> Column:
    """How many of ``edges`` are <= v (< v when ``strict``).

    ``edges`` given as a sorted Python list becomes a binary-search CASE tree
    (about log2(n) comparisons per row, no lambda), so an expensive ``v`` is
    never re-evaluated per element.  An array column uses ``filter`` instead.
    """
    vc = _c(v)
    if isinstance(edges, (list, tuple)):
        vals = [float(e) for e in edges]

        def node(lo: int, hi: int) -> Column:
            if lo >= hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            hit = (vc > F.lit(vals[mid])) if strict else (vc >= F.lit(vals[mid]))
            return F.when(hit, node(mid + 1, hi)).otherwise(node(lo, mid))
        return F.when(vc.isNull(), F.lit(None)).otherwise(node(0, len(vals)))
    f = (lambda e: e < vc) if strict else (lambda e: e <= vc)
    return F.when(vc.isNull(), F.lit(None)).otherwise(F.size(F.filter(_c(edges), f)))
