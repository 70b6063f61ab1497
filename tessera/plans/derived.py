"""Texts that the driver's tables don't hold, chosen by a row's key from short lists.

``SQL`` gives the same choices as DuckDB macros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRASES = ("AI quiz generator", "StudyAssistant for biology", "LessonPlanGenerator", "security assessment feedback", "assessment feedback", "a tutorial of nothing", "socratic tutor and homework_helper", "student portal")
MODELS = ("meta-llama/Llama-3-8B", "researcher/qwen2-tuned", "google/gemma-2b", "plainname", "someone/falcon-7b", "mistralai/Mixtral-8x7B", "lab/roberta-large", "lab/own_net-v2")
BASES = ("", "", "Qwen/Qwen2-7B", "", "tiiuae/falcon-7b", "", "", "someone/base-x")
LICENSES = ("Apache 2.0", "MIT License", "gpl3", "cc-by-nc-4.0", "llama3", "", "other", "apache2")
UPSTREAM = ("mit|apache2", "llama3", "none", "", "cc-by-nc-4.0|mit", "mit|other", "unknown|mit", "gpl3")
PROSE = ("see https://github.com/Alpha/tool.git.", "nothing here", "https://github.com/b/c and http://github.com/A/d)", "https://github.com/x/y, https://github.com/x/y")
TAGS = ("language:en", "language:ja", "language:ko|language:en-US", "license:mit", "language:zh-CN|language:hi")
PLACES = ("Berlin, Germany", "Tokyo", "", "Seoul, South Korea", "USA", "Singapore.", "Atlantis", "New Zealand")
REQUIREMENTS = ("openai>=1.0\n# note\nanthropic==0.3", "Google_GenAI~=1\n-r other.txt\nnumpy", "git+https://x/y\ntorch[cuda]>2 ; python_version>'3'", "transformers\nlangchain.openai")
CODE = (
    "import anthropic\nclient = 1  # OPENAI_API_KEY\n",
    "url = 'https://api.acme.io/v1/chat'\nkey = ACME_API_KEY\n",
    "from openai import OpenAI\nc = OpenAI(base_url='https://openrouter.ai/api/v1')\n",
    "x = 'https://docs.example.com/v1'\nhost = 'http://127.0.0.1:8000/v1'\n",
    "m = AutoModel.from_pretrained('lab/net-a')\nOPENAI_API_KEY\n",
)
TOMLS = ("[project]\ndependencies = ['groq>=1', 'numpy']\n[project.optional-dependencies]\ndev = ['pytest']\n", "[tool.poetry.dependencies]\npython = '^3'\ncohere = '1'\n[tool.poetry.group.test.dependencies]\nmock = '1'\n", "not toml [")


def _pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _split(key: Column, values: tuple[str, ...]) -> Column:
    return F.filter(F.split(_pick(key, values), r"\|"), lambda x: x != "")


phrase = lambda key: F.concat_ws(" ", _pick(key, PHRASES), key.cast("string"))
model = lambda key: _pick(key, MODELS)
bases = lambda key: _split(key, BASES)
license = lambda key: _pick(key, LICENSES)
upstream = lambda key: _split(key, UPSTREAM)
prose = lambda key: _pick(key, PROSE)
tags = lambda key: _split(key, TAGS)
location = lambda key: _pick(key, PLACES)
requirements = lambda key: _pick(key, REQUIREMENTS)
code = lambda key: _pick(key, CODE)
toml = lambda key: _pick(key, TOMLS)


def sql_pick(key: str, values: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST({key} % {len(values)} AS INT) + 1]"
