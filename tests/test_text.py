import pytest
from pyspark.sql import functions as F

from tessera.functions import source_code as S, text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, found", [("AI tutor for algebra", ["tutor"]), ("a tutorial", []), ("StudyAssistant", ["study_support"]), ("LessonPlanGenerator", ["lesson_planning"]), ("security assessment feedback", []), ("assessment feedback", ["grading_support"])])
def test_constructs(spark, text, found):
    assert value(spark, T.constructs(F.lit(text))) == found


def test_provider_and_family(spark):
    bases = F.array(F.lit("meta-llama/Llama-3"))
    got = value(spark, T.model_provider(F.lit("researcher/x"), bases))
    assert (got.provider, got.basis) == ("Meta", "base_model_namespace")
    none = F.array().cast("array<string>")
    assert value(spark, T.model_provider(F.lit("researcher/x"), none)).provider == "namespace:researcher"
    assert value(spark, T.model_family(F.lit("a/qwen2-7b"), none)) == "Qwen"


def test_requirements_and_json(spark):
    assert value(spark, T.requirement_packages(F.lit("﻿OpenAI>=1\n# x\n-r y\nfoo_bar.baz[x]==2"))) == ["foo-bar-baz", "openai"]
    assert value(spark, T.json_packages(F.lit('{"dependencies": {"groq": "1"}, "devDependencies": {"jest": "2"}}'))) == ["groq"]
    assert value(spark, T.json_packages(F.lit("no json"))) == []


@pytest.mark.parametrize("name, normal, kind", [("Apache 2.0", "apache-2.0", "permissive"), ("gpl3", "gpl-3.0", "copyleft"), ("llama3", "llama3", "model_specific"), ("cc-by-nc-4.0", "cc-by-nc-4.0", "restricted"), ("", "missing", "missing")])
def test_licences(spark, name, normal, kind):
    assert value(spark, T.license_name(F.lit(name))) == normal
    assert value(spark, T.license_class(T.license_name(F.lit(name)))) == kind


def test_locations_and_languages(spark):
    assert tuple(value(spark, T.location(F.lit("Berlin, Germany")))) == ("outside_asia", "DE")
    assert tuple(value(spark, T.location(F.lit("Tokyo")))) == ("unresolved", "")
    assert tuple(value(spark, T.location(F.lit(None).cast("string")))) == ("missing", "")
    assert tuple(value(spark, T.language_orientation(F.array(F.lit("language:ja"), F.lit("language:en-US")), F.array().cast("array<string>")))) == ("includes_asia_language", "en;ja")


def test_python_code_blanks_comments_and_docstrings():
    got = S.python_code('"""doc"""\nx = "# kept"  # gone\n')
    assert "doc" not in got and "gone" not in got and '"# kept"' in got and len(got) == len('"""doc"""\nx = "# kept"  # gone\n')
    assert S.python_code("def (") == "def ("


@pytest.mark.parametrize("content", ["plain é".encode(), "é–".encode("cp1252"), b"\xef\xbb\xbfx", "abc".encode("utf-16"), "abcdef".encode("utf-16-be"), "abcd".encode("utf-32-le"), b"\x81\x8d\xff", b""])
def test_decoding_is_lossless(content):
    assert S.encode(*S.decode(content)) == content


def test_client_context(spark):
    files = [("a", "app.py", "from openai import OpenAI\nOpenAI(base_url='https://openrouter.ai/api/v1')"), ("b", "app.py", "import os\nos.environ['OPENAI_API_KEY']"), ("c", "requirements.txt", "openai")]
    df = spark.createDataFrame(files, "project string, path string, text string")
    assert {(r.project, r.provider) for r in S.provider_signals(df).collect()} == {("a", "OpenRouter"), ("b", "OpenAI")}
    assert [(r.project, r.candidate_type) for r in S.unmapped_candidates(df).collect()] == [("c", "openai_compatible_provider_unresolved")]
