"""MS1 and MS2 spectra around the apex of each target in each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.eic import eic, labelled
from ..operators.spectra import apex_windows, spectra_in_windows
from ..operators.targets import Targets
from ..session import materialize


def apex_window_frame(
    peaks: DataFrame, targets: Targets, mslevel: str = "1", given_rt: DataFrame | None = None
) -> DataFrame:
    """Apex and window of each chromatogram, written out for the second scan."""
    scans = eic(peaks, targets, mslevel=mslevel, min_intensity=None, per_scan=True)
    return materialize(apex_windows(scans, given_rt))


def spectrum_at_apex(
    peaks: DataFrame, targets: Targets, windows: DataFrame, mslevel: str = "1"
) -> DataFrame:
    """Spectrum lines of one MS level inside the windows: mz, intensity, base_peak."""
    return labelled(spectra_in_windows(peaks, windows, mslevel), targets)
