import json

import pytest

from weftline.sources.config import Config, intents, load_config, parse_config
from weftline.sources.files import load_results, sections, write_results


def parse(**keys):
    return parse_config(json.dumps(keys))


def test_defaults_and_unknown_keys():
    assert parse(whatever=1) == Config()
    assert Config().system_prompt == "You are a helpful AI assistant." and Config().history_limit == 10


@pytest.mark.parametrize("keys", [{"model_path": ""}, {"vocab_path": ""}, {"db_path": ""}, {"similarity_threshold": 1.1}, {"similarity_threshold": -0.1}, {"history_limit": 0}, {"api_temperature": 2.1}, {"api_max_tokens": 0}, {"intents": [{"example": "x"}]}, {"intents": [{"name": "n"}]}, {"intents": [{"name": "n", "examples": []}]}])
def test_bad_values(keys):
    with pytest.raises(ValueError):
        parse(**keys)


def test_options_of_another_type_are_passed_over():
    c = parse(api_model=5, api_endpoint=None, api_temperature="hot", api_max_tokens=5.5, intents="none")
    assert c == Config()
    with pytest.raises(TypeError):
        parse(db_path=3)


def test_intents(spark):
    c = parse(intents=[{"name": "a", "examples": ["x", "y"], "example": "z"}, {"name": "b", "example": "w"}, {"name": "a", "examples": "no list", "example": "v"}])
    assert c.intents == [("a", ["x", "y"]), ("b", ["w"]), ("a", ["v"])]
    assert [(r["reg_ord"], r["name"], r["example"]) for r in intents(spark, c).orderBy("reg_ord").collect()] == [(0, "a", "x"), (1, "a", "y"), (2, "b", "w"), (3, "a", "v")]


def test_files(tmp_path):
    with pytest.raises(RuntimeError):
        load_config(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(RuntimeError):
        load_config(str(tmp_path / "bad.json"))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16"])
def test_results_of_either_encoding(spark, tmp_path, encoding):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"config": {"threshold": 0.5}, "routing": [{"input": "é", "n": 1}, {"input": "b", "n": 2}]}, indent=2), encoding=encoding)
    parts = sections(load_results(spark, str(path)))
    assert [r["input"] for r in parts["routing"].orderBy("n").collect()] == ["é", "b"]
    write_results(parts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/routing")).count() == 2
