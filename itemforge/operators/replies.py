"""Replies of a language model: the client is any callable; what it says is parsed here."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters that a mask need not find.
OPTIONAL_PARAMS = ["исполнение", "покрытие", "толщина_покрытия", "класс_прочности"]
IMPLICIT_COATING = "БП"


class Client(Protocol):
    """What the engine asks of a language model."""

    def complete(self, prompt: str) -> str: ...

    def health_check(self) -> bool: ...

    def get_models(self) -> list[str]: ...


def _balanced(text: str) -> Iterator[str]:
    """Balanced runs of braces or brackets, those that stand in no other one first, from left to right; then the others.

    One pass: a quote begins a string only inside of braces, and a string ends with its line at the latest.
    """
    found, open_, quoted = [], [], False
    for m in re.finditer(r"\\.|[\"{}\[\]\n]", text, re.S):
        c = m[0]
        if c == "\n":
            quoted = False
        elif c == '"':
            quoted = not quoted and bool(open_)
        elif quoted or len(c) > 1:
            continue
        elif c in "{[":
            open_.append((m.start(), c))
        elif open_ and open_[-1][1] + c in ("{}", "[]"):
            start, _ = open_.pop()
            found.append((len(open_), start, m.end()))
    inner_at = sorted(found, key=lambda f: f[1])
    last = -1
    for _, start, end in inner_at:
        if end > last:
            yield text[start:end]
            last = end
    last = -1
    for _, start, end in inner_at:
        if end <= last:
            yield text[start:end]
        last = max(last, end)


def _loaded(text: str):  # noqa: ANN202  any JSON value
    try:
        return json.loads(text)
    except ValueError:
        try:
            value = ast.literal_eval(text.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return value if isinstance(value, (dict, list)) else None


def reply_json(text: str | None):  # noqa: ANN201
    """The first JSON object or list of a reply: the whole of it, a fenced block, or the first balanced braces; None without one."""
    if not text:
        return None
    fenced = [m[1] for m in re.finditer(r"```[ \t]*(?:json|python)?[ \t]*\n?(.*?)```", text, re.S | re.I)]
    for part in (text, *fenced, *_balanced(text)):
        value = _loaded(part)
        if isinstance(value, (dict, list)):
            return value
    return None


def mask_reply(text: str | None) -> dict | None:
    """pattern, params, required of a reply that proposes a mask; None unless the pattern is anchored and compiles."""
    value = reply_json(text)
    if not isinstance(value, dict) and text:
        try:
            value = yaml.safe_load(re.sub(r"```\w*", "", text))
        except yaml.YAMLError:
            value = None
    if not isinstance(value, dict) and text:
        found = re.search(r"pattern\W+(\^.*\$)", text)
        value = {"pattern": found[1]} if found else None
    if not isinstance(value, dict) or not isinstance(value.get("pattern"), str):
        return None
    pattern = value["pattern"].strip()
    if not (pattern.startswith("^") and pattern.endswith("$")):
        return None
    try:
        groups = list(re.compile(pattern).groupindex)
    except re.error:
        return None
    names = lambda v: [str(x) for x in v if isinstance(x, (str, int, float))] if isinstance(v, (list, dict)) else []
    params = names(value.get("params")) or groups
    return {"pattern": pattern, "params": params, "required": names(value.get("required")) or [p for p in params if p not in OPTIONAL_PARAMS]}


def item_reply(text: str | None) -> dict:
    """A stored result of a reply: its object or the first of its list, with a status; error without one."""
    value = reply_json(text)
    value = value[0] if isinstance(value, list) and value else value
    if not isinstance(value, dict):
        return {"status": "error", "raw": text}
    return {"status": "completed", **value}


def coating_reply(text: str | None) -> dict[str, list[str]]:
    """material -> coatings, from a map of lists, a map of texts with commas, or a list of {material, coatings}."""
    value = reply_json(text)
    rows = value.get("rules", value) if isinstance(value, dict) else value
    plain = lambda x: isinstance(x, (str, int, float)) and not isinstance(x, bool)
    if isinstance(rows, list):
        rows = {r["material"]: r.get("coatings") for r in rows if isinstance(r, dict) and plain(r.get("material"))}
    if not isinstance(rows, dict):
        return {}
    every = lambda c: c.split(",") if isinstance(c, str) else c if isinstance(c, list) else [c]
    return {str(m): [str(x).strip() for x in every(c) if plain(x) and str(x).strip()] for m, c in rows.items() if str(m).strip()}


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A prompt with {name} replaced by values; a null value is empty."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def parsed(rows: DataFrame, column: str = "reply", kind: Callable[[str | None], object] = reply_json) -> DataFrame:
    """rows with json: what kind finds in each reply, as JSON text with sorted keys; null without anything."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (v := kind(x)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True))

    return rows.withColumn("json", read(column))


def completed(rows: DataFrame, complete: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """rows with the reply to each prompt; equal prompts are asked once, on the executors."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=[complete(p) for p in batch["_prompt"]])

    distinct = rows.select(F.col(column).alias("_prompt")).where("_prompt is not null").distinct()
    replies = distinct.mapInPandas(ask, "_prompt string, reply string")
    return rows.join(replies, F.col(column) == F.col("_prompt"), "left").drop("_prompt")


def normalised(rows: DataFrame, similar: DataFrame, complete: Callable[[str], str], template: str, top: int = 3) -> DataFrame:
    """name, params (JSON), confidence by few-shot prompts: similar has (id, example, similarity); without a coating the implicit one."""
    shots = similar.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "example"))), 1, top).alias("e"))
    prompts = rows.join(shots, rows.name == shots.id, "left").withColumn("prompt", fill(F.lit(template), {"name": F.col("name"), "examples": F.array_join(F.transform("e", lambda x: x.example), "\n")}))

    def told(text: str | None) -> dict | None:
        value = reply_json(text)
        return {"покрытие": IMPLICIT_COATING, **{k: v for k, v in value.items() if v not in (None, "")}} if isinstance(value, dict) else None

    return parsed(completed(prompts, complete), kind=told).select("name", F.col("json").alias("params"), F.when(F.col("json").isNotNull(), 0.85).otherwise(0.0).alias("confidence"))


def from_files(spark, path: str) -> DataFrame:  # noqa: ANN001  SparkSession
    """path, reply: text files, without leading lines that begin with #."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value"))
    return files.select("path", F.regexp_replace("value", r"^(?:[ \t]*#[^\n]*\n)+", "").alias("reply"))
