"""Spark-native suspect screening of mass-spectrometry peak tables."""

from .operators.targets import Targets, prepare_targets, targets_of
from .plans.apex import apex_window_frame, spectrum_at_apex
from .plans.screening import (
    max_frame,
    process_screening_results,
    screen_molecules,
    screen_one_mass,
    summary_frame,
    suspect_screening,
)
from .session import local_session, materialize, recommended_conf
from .sources.manifest import manifest_from_folder, manifest_from_listing, manifest_from_paths
from .sources.peaks import read_peaks, read_samples, write_peaks

__all__ = [
    "Targets",
    "apex_window_frame",
    "local_session",
    "manifest_from_folder",
    "manifest_from_listing",
    "manifest_from_paths",
    "materialize",
    "max_frame",
    "prepare_targets",
    "process_screening_results",
    "read_peaks",
    "read_samples",
    "recommended_conf",
    "screen_molecules",
    "screen_one_mass",
    "spectrum_at_apex",
    "summary_frame",
    "suspect_screening",
    "targets_of",
    "write_peaks",
]
