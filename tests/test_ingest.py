"""Ingest runs that are stopped between their phases, run again, and meet changed files."""

import csv

import pytest

from caseflow.sources import ingest, packs

HEADER = ["Complaint ID", "Consumer complaint narrative", "Product", "Date received", "Timely response?"]


def write(path, rows):
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([HEADER, *rows])


def row(i, text="a text"):
    return [i, text, "Mortgage", "2024-01-02", "Yes"]


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.csv", [row("1"), row("2", "two\nlines"), row("2", "again")])
    write(tmp_path / "in/b.csv", [row("3"), row("")])
    return tmp_path


def runs(spark, place):
    return ingest.ingest(spark, str(place / "in"), str(place / "out"), lambda paths: packs.read_raw_csv(spark, "cfpb", paths), "*.csv")


def table(spark, place):
    return sorted((r.external_id, r.text) for r in ingest.loaded(spark, str(place / "out")).collect())


def test_a_second_run_loads_only_what_is_new(spark, place):
    assert runs(spark, place) == 2
    first = table(spark, place)
    assert [i for i, _ in first] == ["1", "2", "3"]
    assert runs(spark, place) == 0 and table(spark, place) == first
    write(place / "in/c.csv", [row("3", "known already"), row("4")])
    (place / "in/note.txt").write_text("no export")
    assert runs(spark, place) == 1 and table(spark, place) == [*first, ("4", "a text")]
    # A changed file is read again; its known rows stay as they are.
    write(place / "in/b.csv", [row("3", "changed"), row("5")])
    assert runs(spark, place) == 1 and table(spark, place) == [*first, ("4", "a text"), ("5", "a text")]
    seen = ingest.manifest(spark, str(place / "out")).collect()
    assert len(seen) == 4 and len({r.checksum for r in seen}) == 4 and {r.run for r in seen} == {1, 2, 3}
    assert spark.read.parquet(str(place / "out/rejects")).filter("missing = 'external_id'").count() == 1


def test_killed_between_the_phases(spark, place, monkeypatch):
    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ingest, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            runs(spark, place)
    assert (place / "out/rows/run=1").is_dir() and table(spark, place) == []  # staged, but no part of the table
    write(place / "in/b.csv", [row("9")])  # what the attempt had staged of this file is not loaded
    assert runs(spark, place) == 2
    assert [i for i, _ in table(spark, place)] == ["1", "2", "9"]
    with pytest.raises(Exception, match="already exists"):
        ingest.commit(ingest.manifest(spark, str(place / "out")), str(place / "out"), 1)
