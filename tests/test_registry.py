import pytest

from spectrail.operators import registry as r
from spectrail.sources import tables


def _run(**x):
    return {"pipeline_path": "p", "search_engine": "e", "dataset": "d", "cfg": "c", "peptide_count": 5} | x


def test_legacy_accepted_run_becomes_reviewed(spark):
    old = spark.createDataFrame([(1, "d", 1, "known good"), (2, "d", 0, None)], "id long, dataset string, accepted int, acceptance_reason string")
    rows = {x.id: (x.status, x.regression, x.message) for x in r.migrated(r.migrated(old)).collect()}
    assert rows == {1: ("reviewed", 0, "known good"), 2: ("unreviewed", 0, None)}


def test_state_machine(spark, tmp_path):
    book = r.Registry(spark, str(tmp_path))
    book.init()
    first = book.record(_run(), [{"repo_name": "a", "repo_url": "u", "commit_hash": "h"}])
    other = book.record(_run(dataset="x"))
    done = book.record(_run(accepted=True, acceptance_reason="fine"))
    best = book.record(_run(peptide_count=9))
    assert (first, other, done, best) == (1, 2, 3, 4) and book.snapshots().count() == 1
    state = lambda: {x.id: (x.status, x.regression, x.message) for x in book.runs().collect()}
    assert state()[1] == ("unreviewed", 0, None) and state()[3] == ("reviewed", 0, "fine")
    assert book.mark_bested(best, "better") == 1
    assert state() == {1: ("bested", 0, "better"), 2: ("unreviewed", 0, None), 3: ("reviewed", 0, "fine"), 4: ("unreviewed", 0, None)}
    book.review(2, 1, "odd")
    assert state()[2] == ("reviewed", 1, "odd")
    book.review(2, 0, None)
    assert state()[2] == ("reviewed", 0, None)
    with pytest.raises(r.RegistryError):
        book.review(99, 0, "")
    with pytest.raises(r.RegistryError):
        book.mark_bested(first)
    with pytest.raises(r.RegistryError):
        book.mark_bested(book.record(_run(peptide_count=None)))


def test_commit_list():
    lines = ["# remark", "a\tu\tcommit\th", "a\tu\ttag\tv", "short\tline"]
    assert r.capture_commits(lambda: lines) == [{"repo_name": "a", "repo_url": "u", "commit_hash": "h"}]


def test_marker_and_summary(tmp_path):
    tables.write_marker(str(tmp_path / "m"), {"run_id": 7, "status": "reviewed"})
    assert tables.read_marker(str(tmp_path / "m")) == 7
    (tmp_path / "s.tsv").write_text("label\tpsm_count\nx\t3\n")
    assert tables.read_summary(str(tmp_path / "s.tsv")) == {"psm_count": 3}
    (tmp_path / "bad.tsv").write_text("psm_count\nx\n")
    with pytest.raises(ValueError):
        tables.read_summary(str(tmp_path / "bad.tsv"))


def test_log_metrics():
    text = "psms=1\nFinal report numbers after FDR filtering: psms=10 peptides=4 psms=12\n"
    assert tables.log_metrics(text) == {"ions": None, "peptides": 4, "proteins": None, "psms": 12}
    with pytest.raises(ValueError):
        tables.log_metrics("nothing")


def test_a_writer_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch):
    book = r.Registry(spark, str(tmp_path))
    book.init()
    book.record(_run(), [{"repo_name": "a", "repo_url": "u", "commit_hash": "h"}])
    written = book._written

    def broken(name, rows):
        out = written(name, rows)
        if name == "snapshots":
            raise KeyboardInterrupt
        return out

    monkeypatch.setattr(book, "_written", broken)
    with pytest.raises(KeyboardInterrupt):
        book.record(_run(), [{"repo_name": "b", "repo_url": "u", "commit_hash": "h"}])
    monkeypatch.setattr(book, "_written", written)
    monkeypatch.setattr(book.versions, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        book.record(_run(), [{"repo_name": "b", "repo_url": "u", "commit_hash": "h"}])
    again = r.Registry(spark, str(tmp_path))
    assert [x.id for x in again.runs().collect()] == [1] and [x.repo_name for x in again.snapshots().collect()] == ["a"]
    assert again.record(_run(), [{"repo_name": "c", "repo_url": "u", "commit_hash": "h"}]) == 2
    assert sorted((x.id, x.run_id, x.repo_name) for x in again.snapshots().collect()) == [(1, 1, "a"), (2, 2, "c")]


def test_two_writers_take_different_ids(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    books = [r.Registry(spark, str(tmp_path)) for _ in range(4)]
    books[0].init()
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda b: b.record(_run(), [{"repo_name": "a", "repo_url": "u", "commit_hash": "h"}]), books))
    assert sorted(ids) == [1, 2, 3, 4]
    assert sorted((x.id, x.run_id) for x in books[0].snapshots().collect()) == [(i, i) for i in range(1, 5)]


def test_the_other_writer_comes_first(spark, tmp_path, monkeypatch):
    one, two = r.Registry(spark, str(tmp_path)), r.Registry(spark, str(tmp_path))
    one.init()
    put, made = one.versions.put, []

    def late(version, content):
        if not made:
            made.append(two.record(_run(dataset="other")))
        return put(version, content)

    monkeypatch.setattr(one.versions, "put", late)
    assert one.record(_run()) == 2 and made == [1]
    assert sorted((x.id, x.dataset) for x in two.runs().collect()) == [(1, "other"), (2, "d")]


def test_versions_by_the_file_systems_rename(spark, tmp_path):
    from spectrail.sources.versions import Versions

    local = Versions(spark, str(tmp_path / "v"))
    assert local.last() == 0 and local.put(1, {"a": [1]}) and not local.put(1, {"a": [2]}) and local.read() == [{"a": [1]}]
    other = Versions(spark, f"file://{tmp_path}/w")
    other.local = None  # as if on a store
    assert other.last() == 0 and other.read() == [] and other.put(1, {"a": [1]}) and other.put(2, {"b": []})
    assert other.last() == 2 and other.read() == [{"a": [1]}, {"b": []}] and other.read(1) == [{"a": [1]}]


def test_states_of_older_versions(spark, tmp_path):
    book = r.Registry(spark, str(tmp_path))
    book.init()
    book.record(_run())
    before = book.versions.last()
    book.review(1, 1, "odd")
    assert [x.status for x in book.runs().collect()] == ["reviewed"] and [x.status for x in book.runs(before).collect()] == ["unreviewed"]
