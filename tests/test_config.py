import io
import json

import pytest

from glyphlake import cli, config
from glyphlake.sources import changes


def test_command_lines():
    o = config.AuditOptions.of(["--json", "--pages", "1,3-5", "--max-file-size-mib", "2", "--max-pages", "7", "--tiny-text-threshold-pt", "0", "in"])
    assert (o.folder, o.json, o.most_bytes, o.most_pages, o.tiny, o.page_selection) == ("in", True, 2 << 20, 7, 0.0, "1,3-5")
    for bad in ([], ["a", "b"], ["--json", "--json", "a"], ["--max-pages"], ["--max-pages", "0", "a"], ["--max-file-size-mib", "-1", "a"], ["--max-file-size-mib", str(2**60), "a"], ["--tiny-text-threshold-pt", "nan", "a"], ["--pages", "0", "a"], ["--what", "a"], ["--help", "a"]):
        with pytest.raises(ValueError):
            config.AuditOptions.of(bad)


def test_exit_codes_without_a_session():
    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["--help"], out, err) == 0 and "usage" in out.getvalue()
    assert cli.main(["--nope"], out, err) == 2 and "Unknown option" in err.getvalue()


def test_batch_options(tmp_path):
    o = config.BatchOptions.of({"report_path": "out/r.JSON", "fail_on_findings": "FALSE", "max_annotations": "0"}, tmp_path)
    assert (o.report_path, o.fail_on_findings, o.most_annotations, o.most_files) == (tmp_path / "out/r.JSON", False, 0, 50)
    for bad in ({"fail_on_findings": "yes"}, {"max_annotations": "-1"}, {"max_files": "0"}, {"report_path": "r.txt"}, {"report_path": "../r.json"}, {"report_path": "/r.json"}, {"report_path": "a\n.json"}, {"report_path": " "}):
        with pytest.raises(config.OptionError):
            config.BatchOptions.of(bad, tmp_path)


def test_paths_stay_in_the_workspace(tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.pdf").write_bytes(b"x")
    (tmp_path / "out.pdf").write_bytes(b"x")
    (tmp_path / "w/l.pdf").symlink_to(tmp_path / "out.pdf")
    (tmp_path / "w/d").symlink_to(tmp_path)
    assert config.existing_file(tmp_path / "w", "a.pdf").name == "a.pdf"
    for bad in ("l.pdf", "d/out.pdf", "none.pdf", "../out.pdf"):
        with pytest.raises(config.OptionError):
            config.existing_file(tmp_path / "w", bad)
    with pytest.raises(config.OptionError):
        config.output_path(tmp_path / "w", "d/r.json")
    target = config.output_path(tmp_path / "w", "new/r.json")
    for said in ("{}", "[]"):
        config.write_report(tmp_path / "w", target, said)
    assert target.read_text() == "[]" and [p.name for p in (tmp_path / "w/new").iterdir()] == ["r.json"] and target.stat().st_mode & 0o044


def test_events_and_lists(spark, tmp_path):
    event = tmp_path / "e.json"
    event.write_text(json.dumps({"number": 7, "pull_request": {"changed_files": 3}}))
    change = changes.read_event(event, "o/r")
    assert (change.number, change.changed_files) == (7, 3)
    for bad in ({"number": 0, "pull_request": {"changed_files": 1}}, {"number": 1}, {"number": 1, "pull_request": {"changed_files": 3001}}, {"number": True, "pull_request": {"changed_files": 1}}):
        event.write_text(json.dumps(bad))
        with pytest.raises(changes.ChangeError):
            changes.read_event(event, "o/r")
    (tmp_path / "l").mkdir()
    (tmp_path / "l/1.json").write_text(json.dumps([{"filename": "b.pdf", "status": "added"}, {"filename": "a.pdf", "status": "added"}]))
    (tmp_path / "l/2.json").write_text(json.dumps([{"filename": "c.pdf", "status": "removed"}]))
    rows = changes.read_changed_files(spark, str(tmp_path / "l"), change)
    assert [r["filename"] for r in rows.orderBy("ordinal").collect()] == ["b.pdf", "a.pdf", "c.pdf"]
    with pytest.raises(changes.ChangeError):
        changes.read_changed_files(spark, str(tmp_path / "l/1.json"), change)
    for bad in ("{", json.dumps([{"filename": "a", "status": "added"}] * 101)):
        (tmp_path / "l/3.json").write_text(bad)
        with pytest.raises(changes.ChangeError):
            changes.read_changed_files(spark, str(tmp_path / "l"))
    (tmp_path / "l/3.json").write_text("[]" + " " * (5 << 20))
    with pytest.raises(changes.ChangeError, match="bytes"):
        changes.read_changed_files(spark, str(tmp_path / "l"))
