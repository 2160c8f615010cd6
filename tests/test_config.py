import json

import pytest

from spectrail.operators import config


def test_defaults():
    c = config.from_dict({})
    assert c.database.enzyme.max_len == 50 and c.max_peaks == 800 and c.precursor_tol.ppm == (-12.0, 12.0) and c.isotope_errors == (0, 3)


@pytest.mark.parametrize(
    "bad",
    [
        {"database": {"fragment_min_mz": 10.0, "fragment_max_mz": 10.0}},
        {"database": {"peptide_min_mass": 10.0, "peptide_max_mass": 9.0}},
        {"precursor_tol": {"ppm": [5, 5]}},
        {"min_peaks": 900},
        {"isotope_errors": [2, 1]},
        {"database": {"enzyme": {"min_len": 60}}},
        {"max_peaks": "many"},
    ],
)
def test_rules(bad, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(bad))
    with pytest.raises(config.ConfigError):
        config.validate_config(tmp_path / "c.json")
