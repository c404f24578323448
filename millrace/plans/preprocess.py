"""Clean → encode → scale as one fitted object; statistics come from the fit only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..dist import nan_to_null, numeric_columns
from ..operators.clean import FittedCleaner, drop_duplicates, fit_cleaner
from ..operators.encode import Encoder, fit_encoder
from ..operators.scale import Scaler, fit_scaler
from ..session import cached

# preset → (cleaning strategy or None, encoding strategy, scaling method or None)
PRESETS = {
    "minimal": ("conservative", "label", None),
    "standard": ("auto", "auto", "standard"),
    "robust": ("auto", "auto", "robust"),
    "advanced": ("aggressive", "auto", "auto"),
}


@dataclass
class Preprocessor:
    cleaner: FittedCleaner
    encoder: Encoder
    scaler: Scaler | None

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply the fitted decisions; rows are neither dropped nor re-fitted."""
        out = self.encoder.transform(self.cleaner.transform(nan_to_null(df)))
        return self.scaler.transform(out) if self.scaler else out


def fit_preprocessor(
    df: DataFrame, target: str | None = None, preset: str = "standard", keep: Sequence[str] = ()
) -> Preprocessor:
    """`keep` names columns (row ids) that pass through as they are: no step sees them."""
    strategy, encoding, scaling = PRESETS[preset]
    with cached(drop_duplicates(nan_to_null(df))) as unique:
        seen = unique.drop(*keep)
        cleaner = fit_cleaner(seen, target, strategy)
        cleaned = cleaner.transform(seen)
        encoder = fit_encoder(cleaned, target=target, strategy=encoding)
        scaler = None
        if scaling:
            scaled = [c for c in numeric_columns(cleaned) if c != target]
            picked = cleaned.select(*scaled)
            methods = scaling if scaling == "auto" else {c: scaling for c in scaled}
            scaler = fit_scaler(picked, methods)
    return Preprocessor(cleaner, encoder, scaler)


def preprocess(df: DataFrame, target: str | None = None, preset: str = "standard", keep: Sequence[str] = ()) -> DataFrame:
    """Fit on the table without its duplicates and transform that same table."""
    return fit_preprocessor(df, target, preset, keep).transform(drop_duplicates(nan_to_null(df)))
