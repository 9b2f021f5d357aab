"""Prompt templates: small JSON files read on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BUILT_IN = Path(__file__).resolve().parent.parent / "templates"
DEFAULT = "tools"

# The prompt kinds of a route, by which of input and data are present.
PROMPT_KINDS = ["full_prompt", "input_prompt", "data_prompt", "default_prompt"]

DIMENSION = "route string, prompt_kind string, text string, response_split string"


def load_templates(name: str = "", folder: str | Path | None = None) -> dict[str, dict[str, str]]:
    """Route -> keys of one template file; a missing file is an error."""
    path = Path(folder or BUILT_IN) / f"{name or DEFAULT}.json"
    if not path.exists():
        raise ValueError(f"Can't read {path}")
    return json.loads(path.read_text(encoding="utf-8"))


def template_table(spark: SparkSession, templates: dict[str, dict[str, str]]) -> DataFrame:
    """The templates as a lookup table, one row per route and prompt kind.

    Its size is that of the template file, so it may always be broadcast.
    """
    rows = [
        (route, kind, keys[kind], keys["response_split"])
        for route, keys in templates.items()
        for kind in PROMPT_KINDS
        if kind in keys
    ]
    return spark.createDataFrame(rows, DIMENSION)
