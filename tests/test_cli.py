import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from spectrail import cli, schemas
from spectrail.plans import fixtures as fx
from spectrail.sources import tables

SF = "/root/testdata/sf0.001"
HEADER = "psm_id\tpeptide\tcharge\tproteins\tscannr\tspectrum_q\tpeptide_q\tprotein_q"


def _rows(spec):
    return HEADER + "\n" + "".join(f"{i}\t{p}\t{c}\t{x}\tprecursor_idx=1 charge={c}\t{q}\t{q}\t{q}\n" for i, (p, c, x, q) in enumerate(spec))


@pytest.fixture
def results(tmp_path):
    for name, spec in (("a b", [("P", 2, "A; B", 0.001), ("P", 3, "B", 0.001), ("Q", 2, "C", 0.5)]), ("b", [("P", 2, "A", 0.0), ("Q", 2, "C", 0.0)])):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "results.sage.tsv").write_text(_rows(spec))
    return tmp_path / "in"


def test_summary(spark, results, tmp_path, capsys):
    (tmp_path / "nothing").mkdir()
    assert cli.main(["summary", str(results), str(tmp_path / "nothing"), "--output", "json"]) == 0
    out = capsys.readouterr()
    assert json.loads(out.out) == [
        {"label": "a b/results.sage.tsv", "psm_count": 2, "peptide_count": 1, "ion_count": 2, "protein_count": 2},
        {"label": "b/results.sage.tsv", "psm_count": 2, "peptide_count": 2, "ion_count": 2, "protein_count": 2},
    ]
    assert "nothing found in" in out.err
    cli.main(["summary", str(results), "--output", "csv", "--level", "peptide"])
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "label,psm_count,peptide_count,ion_count,protein_count" and lines[1].startswith("b/")


def test_files_of_different_headers(spark, results, tmp_path):
    other = tmp_path / "other.tsv"
    head, *rows = _rows([("R", 2, "D", 0.0)]).splitlines()
    other.write_text("\n".join([head + "\tmore", *(r + "\tx" for r in rows)]) + "\n")
    (tmp_path / "empty.tsv").write_text("")
    files = [(str(results / "b" / "results.sage.tsv"), "one"), (str(other), "two"), (str(tmp_path / "empty.tsv"), "none")]
    got = tables.read_many(spark, files).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"one": 2, "two": 1}
    assert [r["psm_count"] for r in cli._counts(spark, files, 0.01, "psm")] == [2, 1, 0]
    with pytest.raises(FileNotFoundError):
        tables.read_many(spark, [(str(tmp_path / "absent.tsv"), "x")])
    assert tables.read_many(spark, []).count() == 0


def test_write(spark, results, tmp_path, capsys):
    one = str(results / "b" / "results.sage.tsv")
    cli.main(["write", one, "--output", str(tmp_path / "s.tsv")])
    assert tables.read_summary(str(tmp_path / "s.tsv")) == {"psm_count": 2, "peptide_count": 2, "ion_count": 2, "protein_count": 2}
    cli.main(["write", one, "--output", "next-to-input"])
    assert (results / "b" / "results.sage.summary.tsv").read_text() == (tmp_path / "s.tsv").read_text()
    with pytest.raises(SystemExit, match="one input"):
        cli.main(["write", one, one, "--output", "next-to-input"])
    capsys.readouterr()
    cli.main(["write", one])
    assert capsys.readouterr().out.startswith("label\t")


def test_convert_filter_summarize(spark, results, tmp_path):
    cli.main(["tsv2parquet", str(results / "a b" / "results.sage.tsv"), str(tmp_path / "p.parquet")])
    cli.main(["filter", str(tmp_path / "p.parquet"), str(tmp_path / "f.parquet")])
    assert spark.read.parquet(str(tmp_path / "f.parquet")).count() == 2
    cli.main(["summarize", str(tmp_path / "f.parquet"), str(tmp_path / "s.tsv")])
    assert tables.read_summary(str(tmp_path / "s.tsv"))["ion_count"] == 2


def test_map_and_scores(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    fx.psms(spark, SF).where("peptide_q <= 0.01").select([f.name for f in schemas.PSMS]).write.parquet(at("psms"))
    fx.fragments(spark, SF).select("psm_id", "fragment_mz_experimental").coalesce(1).write.parquet(at("fragments"))
    fx.precursors(spark, SF).write.parquet(at("precursors"))
    fx.library(spark, SF).write.parquet(at("library"))
    cli.main(["map", at("psms"), at("fragments"), at("precursors"), at("library"), at("out")])
    read = lambda name: spark.read.parquet(f"{at('out')}/{name}.parquet")
    assert read("mapping").count() == read("precursors").agg(F.sum("mapped_cnt")).first()[0] > 0
    assert read("mz_delta_quantiles").count() == 101
    (tmp_path / "c.toml").write_text('[pseudomsms]\ntofs_extraction_method = "score"\n[pseudomsms.tofs_extraction_params]\nk = 3\nmode = "x"\n')
    cli.main(["scores", at("library"), at("out/precursors.parquet"), at("out/mapping.parquet"), "--config", at("c.toml"), "-o", at("plots")])
    assert "dropped" in capsys.readouterr().out
    matched = [r[0] for r in read("mapping").join(spark.read.parquet(at("library")), F.expr("pmsms_fragment_idx = fragment_idx")).where("NOT isnan(score)").selectExpr("log10(1 + intensity)").collect()]
    for name in ("all", "q30"):
        label = json.loads((tmp_path / "plots" / name / "axes.json").read_text())["label"]
        assert label.startswith("score | k=3 | mode=x") and (">=" in label) == (name == "q30")
        plot = lambda x: spark.read.parquet(f"{at('plots')}/{name}/{x}.parquet")  # noqa: B023, E731
        total, share, other = plot("cells").agg(F.sum("matched_count"), F.sum("matched_share"), F.sum("unmatched_share")).first()
        assert total == plot("by_charge").agg(F.sum("count")).first()[0] and share == pytest.approx(1) and other in (0, pytest.approx(1))
        assert plot("contours").agg(F.sum("matched")).first()[0] == pytest.approx(1)
        drawn = {x.name: ElementTree.parse(x).getroot() for x in (tmp_path / "plots" / name).glob("*.svg")}
        assert sorted(drawn) == ["score_by_charge.svg", "score_distribution.svg", "score_vs_intensity_2d.svg", "score_vs_intensity_isoquants.svg"]
        assert f"{total:,} matched" in "".join(drawn["score_distribution.svg"].itertext())
        if name == "q30":
            assert 0.65 * len(matched) <= total < len(matched)


def test_label_without_parameters(tmp_path):
    (tmp_path / "c.toml").write_text('[pseudomsms]\ntofs_extraction_method = "other"\n[pseudomsms.tofs_extraction_params]\nk = 3\n')
    assert tables.score_label(str(tmp_path / "c.toml")) == ("other", "")


def test_record(spark, tmp_path, monkeypatch, capsys):
    with pytest.raises(SystemExit, match="set "):
        monkeypatch.delenv(cli.REGISTRY_VARIABLE, raising=False)
        cli.main(["record", "--init-db"])
    monkeypatch.setenv(cli.REGISTRY_VARIABLE, str(tmp_path / "book"))
    cli.main(["record", "--init-db"])
    (tmp_path / "cfg.toml").write_text("x = 1")
    (tmp_path / "run.json").write_text(json.dumps({"search_engine": "e", "dataset": "d", "cfg": "c", "search_config_path": str(tmp_path / "cfg.toml"), "pipeline_config_path": str(tmp_path / "absent")}))
    git = tmp_path / "git"
    git.mkdir()
    (git / "get_commits").write_text("#!/bin/sh\nprintf '# remark\\nrepo\\turl\\tcommit\\tabc\\nrepo\\turl\\ttag\\tv1\\n'\n")
    (git / "get_commits").chmod(0o755)
    for peptides in (5, 9):
        (tmp_path / "s.tsv").write_text(f"psm_count\tpeptide_count\tion_count\tprotein_count\n10\t{peptides}\t7\t3\n")
        cli.main(["record", "--run-info", str(tmp_path / "run.json"), "--summary", str(tmp_path / "s.tsv"), "--no-prompt", "--git-root", str(git), "--marker", str(tmp_path / f"m{peptides}")])
    (tmp_path / "log.txt").write_text("Final report numbers after FDR filtering: psms=4 peptides=2\n")
    cli.main(["record", "--run-info", str(tmp_path / "run.json"), "--summary", str(tmp_path / "log.txt"), "--accept-run", "--acceptance-reason", "fine", "--marker", str(tmp_path / "m")])
    capsys.readouterr()
    cli.main(["record", "--mark-bested-marker", str(tmp_path / "m9"), "--message", "better"])
    assert capsys.readouterr().out.strip() == "1"
    cli.main(["record", "--review-marker", str(tmp_path / "m9"), "--regression", "1", "--message", "seen"])
    from spectrail.operators.registry import Registry

    book = Registry(spark, str(tmp_path / "book"))
    runs = [(r["id"], r["peptide_count"], r["status"], r["regression"], r["message"], r["search_config"], r["pipeline_config"]) for r in book.runs().orderBy("id").collect()]
    assert runs == [(1, 5, "bested", 0, "better", "x = 1", None), (2, 9, "reviewed", 1, "seen", "x = 1", None), (3, 2, "reviewed", 0, "fine", "x = 1", None)]
    assert book.snapshots().count() == 2 and tables.read_marker(str(tmp_path / "m")) == 3
    for bad in (["--regression", "1"], ["--review-marker", str(tmp_path / "m")], ["--run-info", "x"], ["--run-info", str(tmp_path / "run.json"), "--summary", str(tmp_path / "s.tsv"), "--accept-run"]):
        with pytest.raises(SystemExit):
            cli.main(["record", *bad])


def test_prompt(spark, tmp_path, monkeypatch, capsys):
    """On a terminal the run is shown and may be accepted, with a reason that is asked for until it is given; no is the default."""
    import io

    from spectrail.operators.registry import Registry

    monkeypatch.setenv(cli.REGISTRY_VARIABLE, str(tmp_path / "book"))
    (tmp_path / "run.json").write_text(json.dumps({"search_engine": "e", "dataset": "d", "cfg": "c"}))
    (tmp_path / "s.tsv").write_text("psm_count\tpeptide_count\tion_count\tprotein_count\n10\t5\t7\t3\n")
    terminal = io.StringIO()
    terminal.isatty = lambda: True
    monkeypatch.setattr("sys.stdin", terminal)
    for said in (["y", "", " fine "], [""], ["n"]):
        answers = iter(said)
        monkeypatch.setattr("builtins.input", lambda _, a=answers: next(a))
        cli.main(["record", "--run-info", str(tmp_path / "run.json"), "--summary", str(tmp_path / "s.tsv")])
        assert next(answers, None) is None
    rows = [(r["id"], r["status"], r["message"]) for r in Registry(spark, str(tmp_path / "book")).runs().orderBy("id").collect()]
    assert rows == [(1, "reviewed", "fine"), (2, "unreviewed", None), (3, "unreviewed", None)]
