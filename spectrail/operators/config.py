"""Search configurations: defaults and rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration that breaks a rule."""


def _need(good: bool, what: str) -> None:
    if not good:
        raise ConfigError(what)


# Names and defaults of the fields in the classes below are those of the file format.


@dataclass
class Enzyme:
    missed_cleavages: int = 2
    min_len: int = 7
    max_len: int = 50
    cleave_at: str = "KR"
    restrict: str | None = "P"
    c_terminal: bool = True

    def __post_init__(self):
        _need(self.min_len <= self.max_len, "enzyme: min_len is above max_len")


@dataclass
class Database:
    fasta: str = ""
    bucket_size: int = 32768
    enzyme: Enzyme = field(default_factory=Enzyme)
    fragment_min_mz: float = 200.0
    fragment_max_mz: float = 1700.0
    peptide_min_mass: float = 600.0
    peptide_max_mass: float = 4000.0
    ion_kinds: list[str] = field(default_factory=lambda: ["b", "y"])
    min_ion_index: int = 2
    static_mods: dict[str, float] = field(default_factory=lambda: {"C": 57.0216})
    variable_mods: dict[str, list[float]] = field(default_factory=lambda: {"M": [15.9949], "[": [42.0]})
    max_variable_mods: int = 2
    decoy_tag: str = "rev_"
    generate_decoys: bool = True

    def __post_init__(self):
        _need(self.fragment_max_mz > self.fragment_min_mz, "database: fragment_max_mz is not above fragment_min_mz")
        _need(self.peptide_max_mass > self.peptide_min_mass, "database: peptide_max_mass is not above peptide_min_mass")


@dataclass
class Tolerance:
    ppm: tuple[float, float] = (-15.0, 15.0)

    def __post_init__(self):
        _need(len(self.ppm) == 2 and self.ppm[0] < self.ppm[1], "tolerance: the lower ppm is not below the upper")


@dataclass
class SearchConfig:
    database: Database = field(default_factory=Database)
    precursor_tol: Tolerance = field(default_factory=lambda: Tolerance((-12.0, 12.0)))
    fragment_tol: Tolerance = field(default_factory=lambda: Tolerance((-15.0, 15.0)))
    isotope_errors: tuple[int, int] = (0, 3)
    deisotope: bool = True
    chimera: bool = False
    wide_window: bool = False
    predict_rt: bool = True
    min_peaks: int = 10
    max_peaks: int = 800
    min_matched_peaks: int = 4
    max_fragment_charge: int = 1
    ignore_precursor_charge: bool = False
    report_psms: int = 1
    parallel: bool = True
    mzml_paths: list[str] = field(default_factory=list)

    def __post_init__(self):
        _need(self.max_peaks >= self.min_peaks, "max_peaks is below min_peaks")
        _need(len(self.isotope_errors) == 2 and self.isotope_errors[0] <= self.isotope_errors[1], "isotope_errors: the lower is above the upper")


_NESTED = {"database": Database, "enzyme": Enzyme, "precursor_tol": Tolerance, "fragment_tol": Tolerance}


def _typed(kind: type, values: Any, at: str) -> Any:
    if not isinstance(values, dict):
        raise ConfigError(f"{at}: an object is needed")
    known = {f.name: f for f in fields(kind)}
    made = {}
    for name, value in values.items():
        if name not in known:
            continue  # other keys belong to other tools
        nested = _NESTED.get(name)
        if nested is not None and is_dataclass(nested):
            value = _typed(nested, value, f"{at}.{name}")
        else:
            default = known[name].default if known[name].default is not known[name].default_factory else None
            if isinstance(default, bool):
                ok = isinstance(value, bool)
            elif isinstance(default, int):
                ok = isinstance(value, int) and not isinstance(value, bool)
            elif isinstance(default, float):
                ok = isinstance(value, (int, float)) and not isinstance(value, bool)
            else:
                ok = True
            if not ok:
                raise ConfigError(f"{at}.{name}: {value!r} has the wrong type")
        made[name] = tuple(value) if isinstance(value, list) and name in ("ppm", "isotope_errors") else value
    return kind(**made)


def from_dict(values: dict) -> SearchConfig:
    """A configuration with defaults for what is not given; raises ConfigError where a rule is broken."""
    return _typed(SearchConfig, values, "config")


def validate_config(path: str | Path) -> SearchConfig:
    """The configuration in a JSON file."""
    return from_dict(json.loads(Path(path).read_text()))
