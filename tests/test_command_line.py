"""Commands over a small folder."""

from __future__ import annotations

import json

import pytest

from pagelathe.__main__ import main
from pagelathe.sources import files

TEXT = "Транспортная накладная\nДата 29.08.2022 № 15-А\nВодитель Петров И. И.\n" * 3


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "ann").mkdir()
    (tmp_path / "in" / "a ocred.txt").write_text(TEXT)
    (tmp_path / "ann" / "a.json").write_text(json.dumps({"documents": [{"type": "TN", "date": "2022-08-29"}]}))
    return ["--inputs", str(tmp_path / "in"), "--today", "2023-01-01"]


def test_commands(spark, tmp_path, inputs, capsys):
    def lines(*argv, code=0):
        assert main(list(argv), spark) == code
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert lines("parse", *inputs, "--output", str(tmp_path / "rows")) == [{"n_files": 1, "n_failed": 0, "n_rows": 1}]
    assert len(lines("parse", *inputs, "--output", str(tmp_path / "books"), "--workbooks")) == 1
    got = {r["field"]: r for r in lines("score", *inputs, "--expected", str(tmp_path / "ann"))}
    assert len(got) == 9 and got["date"]["n_ok"] + got["date"]["n_fail"] == 1 and got["cargo"]["n_skip"] == 1
    assert lines("update", *inputs, "--output", str(tmp_path / "held"))[0]["n"] == 8
    assert lines("verify", *inputs, "--held", str(tmp_path / "held")) == []
    (tmp_path / "in" / "a ocred.txt").write_text(TEXT.replace("29.08.2022", "28.08.2022"))
    assert [r["field"] for r in lines("verify", *inputs, "--held", str(tmp_path / "held"), code=1)] == ["date"]
    assert lines("update", *inputs, "--output", str(tmp_path / "both"), "--held", str(tmp_path / "held"))[0]["n"] == 8
    row = spark.createDataFrame([("s", "date", "a", "b", 0.5, "fix", "t", 2, "c")] * 2, files.CORRECTION)
    files.append_corrections(row, str(tmp_path / "log"))
    assert lines("stats", "--log", str(tmp_path / "log"))[0]["total"] == 2 and lines("stats", "--log", str(tmp_path / "log"), "--top", "3")[0]["n"] == 2


def test_unknown_query():
    with pytest.raises(SystemExit):
        main(["query", "none", "--tables", "x"])
