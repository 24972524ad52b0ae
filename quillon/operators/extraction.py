"""Declarative extraction: an ordered mapping of operations as data, run over text columns.

Each operation reads the whole text, a named context or a path of the result,
and writes a context, a path, or several paths. An unknown operation or one
without a target is a ValueError.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import latex

Config = dict[str, Any]


def get_path(data: Any, path: str) -> Any:
    """Value at a dotted path, None where a step is missing."""
    for step in path.split("."):
        data = data.get(step) if isinstance(data, dict) else None
    return data


def set_path(data: dict, path: str, value: Any) -> None:
    """Set a value at a dotted path, making the dictionaries on the way."""
    *way, last = path.split(".")
    for step in way:
        data = data.setdefault(step, {})
    data[last] = value


class Extractor:
    """Runs configurations; `patterns` names regular expressions, `configs` the configurations that recursion refers to."""

    def __init__(self, configs: dict[str, Config], patterns: dict[str, str] | None = None):
        self.configs, self.patterns = configs, patterns or {}
        self.operations: dict[str, Callable] = {n: getattr(self, f"_{n}") for n in ("set_literal", "extract_environment", "split", "parse_itemize_content", "parse_itemize_complex_markers", "recursive_parse", "extract_regex", "extract_braced_after_pattern", "to_plaintext")}

    def _pattern(self, op: Config, key: str) -> str:
        return self.patterns.get(op[key], op[key])

    def run(self, text: str, name: str) -> dict:
        context: dict[str, Any] = {}
        result: dict[str, Any] = {}
        for op in self.configs[name]["operations"].values():
            source = context.get(op["source"]) if "source" in op else get_path(result, op["source_path"]) if "source_path" in op else text
            if op["operation"] not in self.operations:
                raise ValueError(f"unknown operation {op['operation']}")
            self._write(op, self.operations[op["operation"]](op, source, context, result), context, result)
        return result

    def _write(self, op: Config, value: Any, context: dict, result: dict) -> None:
        if "output_context" in op:
            context[op["output_context"]] = value
        elif isinstance(op.get("output_paths"), list):
            values = list(value or [])
            for k, path in enumerate(op["output_paths"]):
                set_path(result, path, values[k] if k < len(values) else "")
        elif isinstance(op.get("output_paths"), dict):
            for group, path in op["output_paths"].items():
                set_path(result, path, (value or {}).get(group, ""))
        elif "output_path" in op:
            set_path(result, op["output_path"], value)
        else:
            raise ValueError("an operation needs a target")

    def _set_literal(self, op, source, context, result):
        return op["value"]

    def _extract_environment(self, op, source, context, result):
        names = op["env_name"] if isinstance(op["env_name"], list) else [op["env_name"]]
        for name in names:
            for env in latex.environments(source or "", re.escape(name), op.get("num_params", 0), op.get("num_optional_params", 0)):
                context["environment_name"] = env.name
                for path, value in zip(op.get("param_names", ()), env.params, strict=False):
                    set_path(result, path, value)
                return env.content
        raise ValueError(f"no environment {names}")

    def _split(self, op, source, context, result):
        pattern = self._pattern(op, "delimiter_pattern")
        parts = re.split(f"(?={pattern})" if op.get("keep_delimiter") else pattern, source or "")
        if "cleanup_pattern" in op:
            parts = [re.sub(self._pattern(op, "cleanup_pattern"), "", p) for p in parts]
        return [p.strip() for p in parts if p and p.strip()]

    def _parse_itemize_content(self, op, source, context, result):
        return latex.itemize_entries(source or "", self._pattern(op, "marker_pattern"))

    _parse_itemize_complex_markers = _parse_itemize_content

    def _recursive_parse(self, op, source, context, result):
        if isinstance(source, list):
            return [self.run(part, op["config_name"]) for part in source]
        found = list(latex.environments(source or "", self._pattern(op, "recursive_pattern")))
        out = [self.run(source[e.start : e.end], op["config_name"]) for e in found]
        for e in reversed(found):  # what was parsed leaves the parent's text
            source = source[: e.start] + source[e.end :]
        if "source" in op:
            context[op["source"]] = source
        return out

    def _extract_regex(self, op, source, context, result):
        found = list(re.finditer(self._pattern(op, "pattern"), source or ""))
        if "output_paths" in op:
            return found[0].groupdict(default="") if found else {}
        groups = list(re.compile(self._pattern(op, "pattern")).groupindex)
        return [m[groups[0]] for m in found] if len(groups) == 1 else [m.groupdict(default="") for m in found]

    def _extract_braced_after_pattern(self, op, source, context, result):
        found = re.search(self._pattern(op, "pattern"), source or "")
        if not found:
            raise ValueError(f"no match of {op['pattern']}")
        return latex.arguments(source, found.end(), 1)[0][0]

    def _to_plaintext(self, op, source, context, result):
        if isinstance(source, list):
            return [{"latex_raw": x, "plaintext": latex.to_plaintext(x)} for x in source]
        return latex.to_plaintext(source)

    def column(self, name: str):
        """Column function: JSON of the extraction, or {"error": ...} for a text it fails on."""

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return json.dumps(self.run(text, name), sort_keys=True, ensure_ascii=False)
            except (ValueError, KeyError) as e:
                return json.dumps({"error": str(e)})

        def run(texts: pd.Series) -> pd.Series:
            return texts.map(one)

        return F.pandas_udf(run, StringType())


def infer_section_type(content, region):
    """Column: section type by the first rule that fits."""
    has = lambda p: content.rlike(p)
    named = lambda name: has(r"\\begin\{itemize" + name + r"\}")
    holds = lambda *words: functools.reduce(lambda x, y: x & y, [F.contains(content, F.lit(w)) for w in words])
    return (
        F.when(named("ProjMain"), "projects")
        .when(named("Academic"), "work_history")
        .when(named("") & holds("University"), "education")
        .when(named("") & has(r"\\item\[") & named("LL"), "skill_categories")
        .when(holds("\\setlength", "\\baselineskip", "\\scshape"), "skill_list_caps")
        .when(holds("|"), "skill_list_pipes")
        .when((region == "left_column") & named("[A-z]*"), "personality_alias_array")
        .when(named(""), "custom_itemize")
        .when(named("[A-z]*"), "simple_list")
        .otherwise("unknown")
    )


#: Errors that do not begin with "! ", and warnings; the group is the message.
LOG_ERRORS = (r"Undefined control sequence", r"File ended while scanning use of", r"Emergency stop")
LOG_WARNINGS = (r"LaTeX Warning: (.+)", r"Package \w+ Warning: (.+)", r"Overfull \\hbox \((.+)\)", r"Underfull \\hbox \((.+)\)")


def log_messages(logs, key: str, text: str):
    """key, kind, place, message of compiler logs: marked errors in their order, the first of each other kind of error that is not among them, then warnings by kind."""
    every = lambda p: F.transform(F.regexp_extract_all(F.col(text), F.lit("(?dm)" + p), F.lit(1)), lambda m: F.regexp_replace(m, r"^\s+|\s+$", ""))
    errors = every(r"^! (.+)$")
    for p in LOG_ERRORS:
        first = F.regexp_extract(F.col(text), f"(?dm)({p}.*?)$", 1)
        errors = F.when((first != "") & ~F.array_contains(errors, first), F.array_append(errors, first)).otherwise(errors)
    lists = F.array(F.struct(F.lit("error").alias("kind"), errors.alias("m")), F.struct(F.lit("warning").alias("kind"), F.concat(*map(every, LOG_WARNINGS)).alias("m")))
    rows = logs.select(key, F.inline(lists))
    return rows.select(key, "kind", F.posexplode("m").alias("place", "message"))
