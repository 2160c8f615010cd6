"""Schemas of the tables: search results, fragments, precursors, library, mapping and the run registry."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _F = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.FloatType()


def _struct(nullable: bool = True, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind in fields.items()])


PSMS = _struct(psm_id=_L, peptide=_S, charge=_I, proteins=_S, scannr=_S, spectrum_q=_D, peptide_q=_D, protein_q=_D)
FRAGMENTS = _struct(sage_fragment_idx=_L, psm_id=_L, fragment_mz_experimental=_F)
PRECURSORS = _struct(precursor_idx=_L, fragment_spectrum_start=_L, fragment_event_cnt=_L, charges=_L)
LIBRARY = _struct(fragment_idx=_L, mz=_F, score=_D, intensity=_L)
MAPPING = _struct(pmsms_fragment_idx=_L, sage_fragment_idx=_L, mapping_row=_L, precursor_idx=_L)
MAPPED_PRECURSORS = _struct(precursor_idx=_L, detected_charges=_L, submitted_charges=_L, mapped_idx=_L, mapped_cnt=_L)
MZ_DELTA_QUANTILES = _struct(quantile=_D, mz_delta=_F)
SUMMARY = _struct(label=_S, psm_count=_L, peptide_count=_L, ion_count=_L, protein_count=_L)
RUNS = T.StructType(
    [
        T.StructField("id", _L, False),
        *(T.StructField(c, _S, False) for c in ("pipeline_path", "run_date", "search_engine", "dataset", "cfg")),
        *(T.StructField(c, _S) for c in ("pipeline_config", "search_config", "pipeline_call", "search_tool_call")),
        *(T.StructField(c, _L) for c in ("psm_count", "peptide_count", "ion_count", "protein_count")),
        T.StructField("accepted", _I),
        T.StructField("acceptance_reason", _S),
        T.StructField("status", _S),
        T.StructField("regression", _I),
        T.StructField("message", _S),
    ]
)
SNAPSHOTS = T.StructType([T.StructField("id", _L, False), T.StructField("run_id", _L, False), *(T.StructField(c, _S, False) for c in ("repo_name", "repo_url", "commit_hash"))])
