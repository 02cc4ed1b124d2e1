"""Column refinement: key -> remove -> mask -> label (PRJ-1..6).

The steps run in that order, so the labeler sees the *masked* value.  The key
column is kept as the first column of the refined frame; sinks drop it by
default (``sinks.files.write_refined``), as the reference's writers never
store the index.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.masks import apply_mask

# Name of the label column and the mock classifier's answer.
LABEL_COLUMN = "category_type"
MOCK_LABEL = "Not Implemented"


def mock_labeler(c: Column) -> Column:
    """The reference's classifier is a stub; it answers a constant."""
    return F.lit(MOCK_LABEL)


@dataclass(frozen=True)
class EtlSpec:
    key: str | None = None
    remove: Sequence[str] = field(default_factory=tuple)
    mask: str | None = None
    label: str | None = None
    mask_kind: str = "first2"
    labeler: Callable[[Column], Column] = mock_labeler


def eligible(columns: Sequence[str], key: str | None = None,
             remove: Sequence[str] = ()) -> dict[str, list[str]]:
    """Columns offered for each step: remove != key; mask/label not removed and != key."""
    rem = [c for c in columns if c != key]
    rest = [c for c in columns if c != key and c not in set(remove)]
    return {"key": list(columns), "remove": rem, "mask": rest, "label": rest}


def validate(spec: EtlSpec, columns: Sequence[str]) -> None:
    cols = list(columns)
    ok = eligible(cols, spec.key, spec.remove)
    if spec.key is not None and spec.key not in cols:
        raise ValueError(f"key column {spec.key!r} not in {cols}")
    for c in spec.remove:
        if c not in ok["remove"]:
            raise ValueError(f"cannot remove {c!r}: unknown or the key column")
    for step, c in (("mask", spec.mask), ("label", spec.label)):
        if c is not None and c not in ok[step]:
            raise ValueError(f"cannot {step} {c!r}: unknown, removed or the key column")


def refine(df: DataFrame, spec: EtlSpec) -> DataFrame:
    """Apply ``spec`` as one projection (a single codegen stage, no shuffle)."""
    validate(spec, df.columns)
    removed = set(spec.remove)
    out: list[Column] = []
    if spec.key is not None:
        out.append(F.col(spec.key))
    for c in df.columns:
        if c == spec.key or c in removed:
            continue
        if c == spec.mask:
            out.append(apply_mask(spec.mask_kind, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    refined = df.select(*out)
    if spec.label is not None:
        refined = refined.withColumn(LABEL_COLUMN, spec.labeler(F.col(spec.label)))
    return refined
