import os

from skewlens.cli import main
from tests.conftest import stage_json, task_json, write_json


def test_cli_writes_report_for_selected_app(spark, tmp_dir, monkeypatch):
    skewed = [task_json(i, duration=10_000) for i in range(9)] + [task_json(9, duration=100_000)]
    for app in ("app-1", "app-2"):
        write_json(f"{tmp_dir}/p/stages/app_id={app}/1.json", [stage_json(1, 0, skewed)])
        write_json(f"{tmp_dir}/p/jobs/app_id={app}/jobs.json",
                   [{"jobId": 0, "name": "j", "submissionTime": "t", "completionTime": "t", "stageIds": [1]}])
    monkeypatch.setattr(spark, "stop", lambda: None)  # keep the shared test session alive
    assert main(["--payloads", f"{tmp_dir}/p", "--app-id", "app-2", "--multi-line",
                 "--out", f"{tmp_dir}/out", "--measures-out", f"{tmp_dir}/m"]) == 0
    text = "".join(open(os.path.join(f"{tmp_dir}/out", f)).read()
                   for f in sorted(os.listdir(f"{tmp_dir}/out")) if f.startswith("part-"))
    assert text.count("[Stage Id: 1, Attempt Id: 0, Job Ids: (0), Task Count: 10]") == 1
    assert [r.app_id for r in spark.read.parquet(f"{tmp_dir}/m").collect()] == ["app-2"]


def test_cli_convert_then_reuse_task_table(spark, tmp_dir, monkeypatch):
    skewed = [task_json(i, duration=10_000) for i in range(9)] + [task_json(9, duration=100_000)]
    write_json(f"{tmp_dir}/p/stages/app_id=app-1/1.json", [stage_json(1, 0, skewed),
                                                         stage_json(2, 0, [task_json(50, drop=("status",))])])
    write_json(f"{tmp_dir}/p/jobs/app_id=app-1/jobs.json",
               [{"jobId": 0, "name": "j", "submissionTime": "t", "completionTime": "t", "stageIds": [1, 2]}])
    monkeypatch.setattr(spark, "stop", lambda: None)

    def report(out):
        return "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))

    assert main(["--payloads", f"{tmp_dir}/p", "--multi-line", "--convert-to", f"{tmp_dir}/t",
                 "--out", f"{tmp_dir}/r1"]) == 0
    assert main(["--payloads", f"{tmp_dir}/p", "--multi-line", "--tasks", f"{tmp_dir}/t", "--tasks-converted",
                 "--out", f"{tmp_dir}/r2"]) == 0
    assert main(["--payloads", f"{tmp_dir}/p", "--multi-line", "--out", f"{tmp_dir}/r3"]) == 0
    assert main(["--payloads", f"{tmp_dir}/p", "--split-arrays", "--out", f"{tmp_dir}/r4"]) == 0
    assert report(f"{tmp_dir}/r1") == report(f"{tmp_dir}/r2") == report(f"{tmp_dir}/r3") == report(f"{tmp_dir}/r4")
    assert report(f"{tmp_dir}/r1").count("[Stage Id:") == 1


def test_cli_accepts_the_original_option_names():
    from skewlens.cli import parse_args
    a = parse_args(["--payloads", "/p", "-a", "app-1", "-t", "1.5", "-o", "/r"])
    b = parse_args(["--payloads", "/p", "--app-id", "app-1", "--skew-threshold", "1.5", "--out-file", "/r"])
    assert (a.app_id, a.threshold, a.out) == (b.app_id, b.threshold, b.out) == (["app-1"], 1.5, "/r")


def test_cli_reports_rejected_records_and_tasks_need_no_stages(spark, tmp_dir, monkeypatch, capsys):
    skewed = [task_json(i, duration=10_000) for i in range(9)] + [task_json(9, duration=100_000)]
    job = [{"jobId": 0, "name": "j", "submissionTime": "t", "completionTime": "t", "stageIds": [1, 2]}]
    write_json(f"{tmp_dir}/p/stages/app_id=app-1/1.json", [stage_json(1, 0, skewed),
                                                         stage_json(2, 0, [task_json(50, drop=("status",))])])
    for root in ("p", "bare"):
        write_json(f"{tmp_dir}/{root}/jobs/app_id=app-1/jobs.json", job)
    monkeypatch.setattr(spark, "stop", lambda: None)
    assert main(["--payloads", f"{tmp_dir}/p", "--multi-line", "--out", f"{tmp_dir}/r1"]) == 0
    assert "1 rejected records in stages/" in capsys.readouterr().err
    assert main(["--payloads", f"{tmp_dir}/p", "--multi-line", "--convert-to", f"{tmp_dir}/t", "--out", f"{tmp_dir}/r2"]) == 0
    assert main(["--payloads", f"{tmp_dir}/bare", "--multi-line", "--tasks", f"{tmp_dir}/t", "--tasks-converted",
                 "--out", f"{tmp_dir}/r3"]) == 0
