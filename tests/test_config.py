import json

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.operators import constraints, tokens
from millrace.sources import cases, config


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"config_version": "1.0.0", "max_steps": 100, "micro_batch": 4, "warmup_steps": 10}))
    found = config.load(str(path))
    assert found.capped(5) == config.TrainingConfig(5, 4, warmup_steps=5, validation_interval=5)
    for change in ({"config_version": "2"}, {"odd": 1}, {"warmup_steps": 101}, {"micro_batch": 0}, {"min_learning_rate": 1.0}, {"max_steps": True}):
        path.write_text(json.dumps({"config_version": "1.0.0", "max_steps": 100, "micro_batch": 4} | change))
        with pytest.raises(ValueError):
            config.load(str(path))


def test_pointer(tmp_path):
    (tmp_path / "run1").mkdir()
    config.point_to(str(tmp_path), "run1")
    assert config.latest(str(tmp_path)).endswith("run1")
    config.point_to(str(tmp_path), "gone")
    with pytest.raises(FileNotFoundError):
        config.latest(str(tmp_path))


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["info"])["schema_version"] == "1.0.0"
    (tmp_path / "r.txt").write_text("左叶上部见一枚实性低回声结节，良性")
    assert cli.main(["extract", f"@{tmp_path}/r.txt"], spark)["composition"] == "solid"
    assert cli.main(["qc", f"@{tmp_path}/r.txt"], spark)["findings"][0]["rule_id"] == "QC.DIAGNOSTIC_LANGUAGE"
    record = '{"nodules":[{"location":{"side":"left","segment":"upper"},"composition":"cystic"}]}'
    assert cli.main(["generate", "--record", record], spark)["report"] == "甲状腺左叶上部见一枚囊性结节。"
    assert not cli.main(["qc", "右叶实性结节", "--record", record], spark)["passed"]
    capsys.readouterr()


def test_presets_hold_the_rules(spark):
    rows = cases.presets(spark)
    assert rows.count() == 5 and rows.filter((F.size(constraints.violations()) > 0) | (F.size(cases.schema_violations()) > 0)).isEmpty()


def test_vocabulary_is_saved(spark, tmp_path):
    known = tokens.vocabulary(spark.createDataFrame([("héllo",)], "t string"), "t")
    tokens.save(known, f"{tmp_path}/v")
    assert tokens.vocabulary_hash(tokens.load(spark, f"{tmp_path}/v")).first() == tokens.vocabulary_hash(known).first()
