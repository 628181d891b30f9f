"""Run parameters with the reference defaults; fixed values, named as users of the command line know them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Tunables:
    """Lengths in micrometres, rates in micrometres per hour, areas in square micrometres."""

    NodeEndpointMergeRadius: float = 0.5
    NodeJunctionMergeRadius: float = 0.5
    NodeLookupRadius: float = 0.5
    NodeLookupCutoffRadius: float = 2.5
    NodeTrackingJunctionShiftRadius: float = 5.0
    NodeTrackingEndpointShiftRadius: float = 100.0
    CropWidth: int = 0
    CropHeight: int = 0
    BoxDetection: bool = False
    StoreImage: bool = False
    Invert: bool = False
    InvertBinarization: bool = False
    SkipBinarization: bool = False
    CleanUpGaussianSigma: float = 0.075
    CleanUpGaussianThreshold: float = 0.5
    CleanUpHoleFillSize: float = 1.0
    RemoveSmallStructuresSize: float = 10.0
    BorderArtifactRemovalBorderSize: float = 10.0
    TrackingMaximumRelativeShrinkage: float = 0.2
    TrackingMinimumTipElongationRate: float = -0.0
    TrackingMaximumTipElongationRate: float = 100.0
    TrackingMaximumCoverage: float = 0.2
    TrackingMinimumTrackedPointCount: int = 5
    TrackingMinimalMaximumLength: float = 10.0
    TrackingMinimalGrownLength: float = 5.0
    ThresholdingTechnique: str = "experimental_thresholding"
    ThresholdingParameters: str = ""

    def with_values(self, **changes) -> Tunables:
        """A copy with other values; texts are read as the default's type, unknown names raise KeyError."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        read = {}
        for name, value in changes.items():
            kind = kinds[name]
            read[name] = (value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)) if isinstance(value, str) else kind(value)
        return replace(self, **read)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def hash(self) -> str:
        return "VERSION:1:SHA256:" + hashlib.sha256(self.to_json().encode()).hexdigest()


def thresholding_parameters(text: str, defaults: dict) -> dict:
    """``name:value,name:value`` read as each default's type; an unknown name raises RuntimeError."""
    out = dict(defaults)
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, value = part.partition(":")
        if name.strip() not in defaults:
            raise RuntimeError(f"unknown thresholding parameter {name.strip()!r}")
        out[name.strip()] = type(defaults[name.strip()])(value)
    return out
