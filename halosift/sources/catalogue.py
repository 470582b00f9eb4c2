"""Column catalogue, feature sets and file-text rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Texts that mean "missing" in a CSV cell (the public pandas default set).
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Label codes and their names.
LABEL_NAMES = {0: "signal", 1: "physicsBkg", 2: "beamHalo", 3: "spike"}

# Columns that identify a row or its class and are never features.
IDENTITY_COLUMNS = ["sample", "event", "object", "subcl", "label"]

# Named feature sets.
FEATURE_SETS = {
    "default": ["R9", "Sietaieta", "Smajor", "Sminor", "ecalPFClusterIsoOvPt",
                "hcalPFClusterIsoOvPt", "trkSumPtHollowConeDR03OvPt"],
    "clusterShapeOnly": ["R9", "Sietaieta", "Smajor", "Sminor"],
    "IsoOnly": ["ecalPFClusterIsoOvPt", "hcalPFClusterIsoOvPt", "trkSumPtHollowConeDR03OvPt"],
    "subclusterObs": ["R9", "eta_sig", "major_length", "minor_length", "ecalPFClusterIsoOvPt",
                      "hcalPFClusterIsoOvPt", "trkSumPtHollowConeDR03OvPt"],
    "addTimeEtaCov": ["R9", "Sietaieta", "Smajor", "Sminor", "ecalPFClusterIsoOvPt",
                      "hcalPFClusterIsoOvPt", "trkSumPtHollowConeDR03OvPt", "timeeta_cov"],
    "addTimeEtaCovEtaPhiCov": ["R9", "Sietaieta", "Smajor", "Sminor", "ecalPFClusterIsoOvPt",
                               "hcalPFClusterIsoOvPt", "trkSumPtHollowConeDR03OvPt",
                               "timeeta_cov", "etaphi_cov"],
    "detector": ["eta_sig", "phi_sig", "etaphi_cov", "timeeta_cov", "sw+", "energy"],
    "fourFeature": ["eta_sig", "phi_sig", "etaphi_cov", "timeeta_cov"],
}

FEATURE_SETS["even"] = FEATURE_SETS["detector"]

# Pixel column format of the grid tables.
GRID_FORMAT = "CNNgrid_{channel}_cell{i}_{j}"
GRID_PATTERN = re.compile(r"CNNgrid_([A-Za-z])_cell(-?\d+)_(-?\d+)")

# Columns that hold whole numbers, and real ones that are in no feature set.
WHOLE_NUMBER_COLUMNS = {"event", "object", "subcl", "label", "lead"}
CENTRE_COLUMNS = {"eta_center", "phi_center", "time_center"}
REAL_COLUMNS = CENTRE_COLUMNS.union(*FEATURE_SETS.values())


def column_kind(name: str) -> str | None:
    """``text``, ``whole`` or ``real`` for a column of the catalogue, ignoring case;
    None for any other."""
    low = name.lower()
    if low == "sample":
        return "text"
    if low in {c.lower() for c in WHOLE_NUMBER_COLUMNS}:
        return "whole"
    if low in {c.lower() for c in REAL_COLUMNS} or GRID_PATTERN.fullmatch(name):
        return "real"
    return None


def quoted(name: str) -> str:
    """A column name safe to use in an expression (``sw+``, ``cell-3_0``)."""
    return "`" + name.replace("`", "``") + "`"


def require_columns(df: DataFrame, names: list[str], purpose: str) -> None:
    """Fail with the names of the columns that ``purpose`` needs and ``df`` lacks."""
    present = {c.lower() for c in df.columns}
    absent = [n for n in names if n.lower() not in present]
    if absent:
        raise ValueError(f"{purpose} needs missing column(s): {', '.join(absent)}")
