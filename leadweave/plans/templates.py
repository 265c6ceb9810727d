"""The marts as SQL files with named parameters, run in the order of their names."""

from __future__ import annotations

import re
from datetime import timedelta
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import Outcome

FOLDER = Path(__file__).parent / "sql"


def templates(folder: Path = FOLDER) -> dict[str, str]:
    """The text of each file by its name without number and suffix, in lexical order."""
    return {re.sub(r"^\d+_", "", p.stem): p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.sql"))}


def parameters(text: str) -> set[str]:
    """The names that a template takes; comments and quoted text have none."""
    return set(re.findall(r"(?<![:\w]):([a-z_]+)", re.sub(r"--[^\n]*|'[^']*'", "", text)))


def run(spark: SparkSession, text: str, **values: Any) -> DataFrame:
    """A template with its parameters bound as values, never pasted into the text; names of tables come in by IDENTIFIER(:name).

    A parameter without a value, or a value without a parameter, is a ValueError.
    """
    wanted = parameters(text)
    if wanted != set(values):
        raise ValueError(f"a template takes {sorted(wanted)}, not {sorted(values)}")
    return spark.sql(text, args=values)


def marts(spark: SparkSession, facts: DataFrame, config: Outcome, name: str = "template_facts", least_leads: int = 50) -> dict[str, DataFrame]:
    """Every mart of the folder over a fact table, which is registered by ``name``."""
    facts.createOrReplaceTempView(name)
    values = {"facts": name, "as_of": str(config.instant), "matured_until": str(config.instant - timedelta(days=config.window_days)), "least_leads": least_leads}
    return {mart: run(spark, text, **{k: v for k, v in values.items() if k in parameters(text)}) for mart, text in templates().items()}
