"""Turn descriptor columns into one sentence per record, and setting <-> string."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Field labels of the reference's record sentence, in its order:
# (column, label) pairs -> "Species: x. Region: y. ... Concentration: z."
RECORD_FIELDS = (
    ("SPECIES", "Species"),
    ("REGION", "Region"),
    ("USED PART", "Part"),
    ("METABOLITE CONTENT", "Metabolites"),
    ("TESTED MICROORGANISME", "Microorganism"),
    ("EFFECTIVE CONCENTRATION", "Concentration"),
)
FIELD_SEP = ". "
SENTENCE_END = "."
# ---------------------------------------------------------------------------


def _field(col: str, label: str) -> Column:
    return F.concat(F.lit(f"{label}: "), F.col(f"`{col}`").cast("string"))


def serialize_optional(df: DataFrame, fields: Sequence[tuple[str, str]] = RECORD_FIELDS) -> Column:
    """Sentence over the fields present in ``df``; absent columns are skipped."""
    present = [(c, lab) for c, lab in fields if c in df.columns]
    if not present:
        return F.lit(SENTENCE_END)
    return F.concat(F.concat_ws(FIELD_SEP, *[_field(c, lab) for c, lab in present]),
                    F.lit(SENTENCE_END))


def serialize_required(fields: Sequence[tuple[str, str]] = RECORD_FIELDS) -> Column:
    """Sentence over a fixed field list; a missing column fails analysis."""
    return F.concat(F.concat_ws(FIELD_SEP, *[_field(c, lab) for c, lab in fields]),
                    F.lit(SENTENCE_END))


def label_suffix(name, group, tagged_group: str, suffix: str) -> Column:
    """``name (val.)``-style label for rows of one group."""
    n = F.col(name) if isinstance(name, str) else name
    g = F.col(group) if isinstance(group, str) else group
    return F.concat(n, F.when(g == F.lit(tagged_group), F.lit(suffix)).otherwise(F.lit("")))


def setting_json(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Setting -> JSON object string with keys in the given order.

    Values are rendered by the caller (already strings holding JSON scalars) so the
    text is engine-independent: ``{"C":0.001,"penalty":"l2"}``.
    """
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs])
    return F.concat(F.lit("{"), body, F.lit("}"))


def setting_field(js, key: str, as_type: str = "string") -> Column:
    """Read one field back from a setting string."""
    c = F.col(js) if isinstance(js, str) else js
    return F.get_json_object(c, f"$.{key}").cast(as_type)
