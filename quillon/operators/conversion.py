r"""Document conversion: LaTeX to nested documents and back.

A document is a dictionary of metadata and pages; a page has decorations, a
textblock kept as it is, and regions of typed sections. One parser and one
writer a section type are listed in `TYPES`, so that what one reads the other
writes. The column functions work text by text in Arrow batches: balanced
environments are beyond built-in expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import latex

Node = dict[str, Any]

#: Drawing commands and the number of their arguments.
DECORATIONS = {"leftgrad": 5, "bottombar": 4, "topgradtri": 6, "topgrad": 5}
#: List environments.
PROJECT_ENVIRONMENT, HISTORY_ENVIRONMENT, PROJECTS_ENVIRONMENT = r"itemize(?:A|Key)?Project", "itemizeAcademic", "itemizeProjMain"
CAPS_HEAD = "{ \\setlength{\\baselineskip}{10pt} \\setlength{\\parskip}{7.5pt} \\scshape"
MARKER = r"\\item[A-Za-z]*(?![A-Za-z])"
COLUMNS = ("left_column", "main_column")


def _both(raw: str) -> Node:
    return {"latex_raw": raw, "plaintext": latex.to_plaintext(raw)}


def _cut(text: str, pattern: str) -> tuple[list[latex.Environment], str]:
    """Outermost environments by name pattern, and the text without them."""
    found = list(latex.environments(text, pattern))
    for e in reversed(found):
        text = text[: e.start] + text[e.end :]
    return found, text


def _bullets(text: str) -> list[Node]:
    return latex.itemize_entries(text, MARKER)


def _written(bullets: list[Node], indent: str = "    ") -> str:
    return "".join(f"{indent}{b['marker']} {b['latex_raw']}\n\n" for b in bullets)


def _named(e: latex.Environment, fields: tuple[str, ...]) -> Node:
    return dict(zip(fields, e.params, strict=True))


# --- one reader and one writer a type; a reader gets the section's LaTeX without its heading


def read_project(text: str, count: int = 3) -> list[Node]:
    out = []
    for e in latex.environments(text, PROJECT_ENVIRONMENT, params=count):
        out.append({"type": "project", "metadata": {"environment_type": e.name} | _named(e, ("bullet_symbol", "name", "dates")), "content": {"bullets": _bullets(e.content)}})
    return out


def write_project(node: Node) -> str:
    m = node["metadata"]
    return f"\\begin{{{m['environment_type']}}}{{{m['bullet_symbol']}}}{{{m['name']}}}{{{m['dates']}}}\n\n{_written(node['content']['bullets'])}\\end{{{m['environment_type']}}}\n"


def read_experience(text: str) -> Node:
    (job,) = latex.environments(text, HISTORY_ENVIRONMENT, params=4)
    meta = _named(job, ("company", "title", "location", "dates"))
    head, mark, rest = meta["title"].partition("\\\\")
    if mark:
        meta |= {"title": head.strip(), "subtitle": rest.strip()}
    _, own = _cut(job.content, PROJECT_ENVIRONMENT)
    return {"type": "work_experience", "metadata": meta, "content": {"bullets": _bullets(own), "projects": read_project(job.content)}}


def write_experience(node: Node) -> str:
    m = node["metadata"]
    shown = m["title"] + (f" \\\\ {m['subtitle']}" if "subtitle" in m else "")
    projects = "\n".join(map(write_project, node["content"]["projects"]))
    return f"\\begin{{{HISTORY_ENVIRONMENT}}}{{{m['company']}}}{{{shown}}}{{{m['location']}}}{{{m['dates']}}}\n\n{_written(node['content']['bullets'])}{projects}\\end{{{HISTORY_ENVIRONMENT}}}\n"


def _read_history(text: str) -> Node:
    return {"subsections": [read_experience(text[e.start : e.end]) for e in latex.environments(text, HISTORY_ENVIRONMENT)]}


def _read_projects(text: str) -> Node:
    (outer,) = latex.environments(text, PROJECTS_ENVIRONMENT)
    return {"subsections": read_project(outer.content)}


def _write_projects(node: Node) -> str:
    return f"\\begin{{{PROJECTS_ENVIRONMENT}}}\n\n" + "\n".join(map(write_project, node["subsections"])) + f"\\end{{{PROJECTS_ENVIRONMENT}}}"


def _read_caps(text: str) -> Node:
    at = text.index("{", 0)
    body = text[at + 1 : latex.closing(text, at)]
    body = re.sub(r"^\s*(?:\\(?:setlength|deflen)\{[^}]*\}\{[^}]*\}\s*)*(?:\\scshape)?", "", body)
    return {"content": {"items": [_both(x.strip()) for x in re.split(r"\n\s*\n|\\par\b", body) if x.strip()]}}


def _write_caps(node: Node) -> str:
    return CAPS_HEAD + "\n" + "\n\n".join(f"    {i['latex_raw']}" for i in node["content"]["items"]) + "\n}"


def _read_pipes(text: str) -> Node:
    return {"content": {"items": [_both(x.strip()) for x in text.split("|") if x.strip()]}}


def _write_pipes(node: Node) -> str:
    return " | ".join(i["latex_raw"] for i in node["content"]["items"])


def _read_categories(text: str) -> Node:
    (outer,) = latex.environments(text, "itemize")
    lists, _ = _cut(outer.content, "itemizeLL")
    heads, at, subs = [], 0, []
    for e in lists:
        heads.append(outer.content[at : e.start])
        at = e.end
    for head, e in zip(heads, lists, strict=True):
        mark = head.index("[")
        end = latex.closing(head, mark, "[", "]")
        name = head[end + 1 :].strip()
        subs.append({"type": "skill_category", "metadata": {"marker": head[mark + 1 : end], "name_raw": name, "name": latex.to_plaintext(name)}, "content": {"bullets": _bullets(e.content)}})
    return {"subsections": subs}


def _write_categories(node: Node) -> str:
    parts = [f"    \\item[{s['metadata']['marker']}] {s['metadata']['name_raw']}\n\n    \\begin{{itemizeLL}}\n\n{_written(s['content']['bullets'])}    \\end{{itemizeLL}}\n" for s in node["subsections"]]
    return "\\begin{itemize}\n\n" + "\n".join(parts) + "\n\\end{itemize}"


def _read_education(text: str) -> Node:
    return {"metadata": {"include_dissertation": "Dissertation" in text, "include_minor": "Minor in" in text, "use_icon_bullets": "\\item[" in text}, "content": {"raw": text.strip()}}


def _read_list(text: str) -> Node:
    """One list environment with its arguments, of any itemize kind."""
    e = next(latex.environments(text, "itemize[A-Za-z]*"))
    given = re.match(r"\s*((?:\[[^\]]*\]|\{[^}]*\})*)", e.content)[1] if not e.content.lstrip().startswith("\\item") else ""
    body = e.content[e.content.index(given) + len(given) :]
    return {"metadata": {"environment": e.name, "arguments": given}, "content": {"bullets": _bullets(body)}}


def _write_list(node: Node) -> str:
    m = node["metadata"]
    return f"\\begin{{{m['environment']}}}{m['arguments']}\n\n{_written(node['content']['bullets'])}\\end{{{m['environment']}}}"


def _read_raw(text: str) -> Node:
    return {"content": {"raw": text.strip()}}


def _write_raw(node: Node) -> str:
    return node["content"]["raw"]


@dataclass(frozen=True)
class SectionType:
    """When a section is of the type (its LaTeX and region), how it is read and how it is written."""

    fits: Callable[[str, str], bool]
    read: Callable[[str], Node]
    write: Callable[[Node], str]


def _begins(pattern: str) -> Callable[[str, str], bool]:
    return lambda text, _: re.search(r"\\begin\{" + pattern + r"\}", text) is not None


#: Section types in the order in which they are tried.
TYPES: dict[str, SectionType] = {
    "projects": SectionType(_begins(PROJECTS_ENVIRONMENT), _read_projects, _write_projects),
    "work_history": SectionType(_begins(HISTORY_ENVIRONMENT), _read_history, lambda n: "\n".join(map(write_experience, n["subsections"])).rstrip("\n")),
    "education": SectionType(lambda t, r: _begins("itemize")(t, r) and "University" in t, _read_education, _write_raw),
    "skill_categories": SectionType(lambda t, r: _begins("itemize")(t, r) and "\\item[" in t and _begins("itemizeLL")(t, r), _read_categories, _write_categories),
    "skill_list_caps": SectionType(lambda t, _: all(w in t for w in ("\\setlength", "\\baselineskip", "\\scshape")), _read_caps, _write_caps),
    "skill_list_pipes": SectionType(lambda t, _: "|" in t, _read_pipes, _write_pipes),
    "personality_alias_array": SectionType(lambda t, r: r == "left_column" and _begins("itemize[A-Za-z]*")(t, r), _read_list, _write_list),
    "custom_itemize": SectionType(_begins("itemize"), _read_list, _write_list),
    "simple_list": SectionType(_begins("itemize[A-Za-z]*"), _read_list, _write_list),
    "unknown": SectionType(lambda *_: True, _read_raw, _write_raw),
}


def read_section(name: str, text: str, region: str) -> Node:
    """A typed section; one that its type's reader cannot read is kept raw, as unknown."""
    kind = next(k for k, t in TYPES.items() if t.fits(text, region))
    try:
        node = TYPES[kind].read(text)
    except (ValueError, StopIteration):
        kind, node = "unknown", _read_raw(text)
    return {"type": kind} | node | {"metadata": node.get("metadata", {}) | {"name": name, "name_plaintext": latex.to_plaintext(name)}}


def write_section(node: Node) -> str:
    return f"\\section*{{{node['metadata']['name']}}}\n\n{TYPES[node['type']].write(node)}"


def sections_of(column: str, region: str) -> list[Node]:
    r"""Sections from each \section*{..} to the next; vertical space at a section's end is kept apart."""
    heads = list(re.finditer(r"\\section\*\{", column))
    starts = [(h.start(), latex.closing(column, h.end() - 1)) for h in heads]
    out = []
    for k, (_, close) in enumerate(starts):
        body = column[close + 1 : starts[k + 1][0] if k + 1 < len(starts) else len(column)]
        space = re.search(r"\s*\\vspace\{([^}]*)\}\s*\Z", body)
        node = read_section(column[heads[k].end() : close], (body[: space.start()] if space else body).strip(), region)
        if space:
            node["metadata"]["spacing_after"] = space[1]
        out.append(node)
    return out


def take_decorations(text: str) -> tuple[list[Node], str]:
    """Drawing commands in their order with their arguments, and the text without them."""
    out, pattern = [], re.compile(r"\\(" + "|".join(sorted(DECORATIONS, key=len, reverse=True)) + r")(?=\{)")
    at = 0
    while found := pattern.search(text, at):
        try:
            args, end = latex.arguments(text, found.end(), DECORATIONS[found[1]])
        except ValueError:
            at = found.end()
            continue
        out.append({"command": found[1], "arguments": args})
        text, at = text[: found.start()] + text[end:].lstrip(" \t").removeprefix("\n"), found.start()
    return out, text


def take_textblock(text: str) -> tuple[str | None, str]:
    """The first textblock as it is (null where there is none), and the text without it."""
    found = re.search(r"(?s)\\begin\{textblock\*\}.*?\\end\{textblock\*\}", text)
    return (found[0], text[: found.start()] + text[found.end() :]) if found else (None, text)


def read_page(text: str, number: int) -> Node:
    decorations, text = take_decorations(text)
    block, text = take_textblock(text)
    text = re.sub(r"\\(?:begin|end)\{(?:paracol|document)\}(?:\{\d+\})?", "", text)
    left, mark, main = text.partition("\\switchcolumn")
    regions = {"left_column": left, "main_column": main} if mark else {"main_column": left}
    parsed = {r: {"sections": found} for r, t in regions.items() if (found := sections_of(t, r))}
    return {"page_number": number, "decorations": decorations, "textblock": block, "regions": parsed}


def write_page(page: Node) -> str:
    drawn = "".join(f"\\{d['command']}" + "".join(f"{{{a}}}" for a in d["arguments"]) + "\n" for d in page["decorations"])

    def column(region: str) -> str:
        parts = []
        for node in page["regions"].get(region, {"sections": []})["sections"]:
            space = node["metadata"].get("spacing_after")
            parts.append(write_section(node) + (f"\n\\vspace{{{space}}}" if space else ""))
        return "\n\n".join(parts)

    block = page["textblock"] + "\n" if page["textblock"] else ""
    return f"\\begin{{paracol}}{{2}}\n{drawn}{block}\n{column('left_column')}\n\n\\switchcolumn\n\n{column('main_column')}\n\n\\end{{paracol}}\n"


def read_metadata(preamble: str) -> Node:
    r"""Renewed commands (braces balanced), lengths, colours and packages of a preamble."""
    fields: Node = {}
    for found in re.finditer(r"\\renewcommand\{\\(\w+)\}(?=\{)", preamble):
        fields[found[1]] = preamble[found.end() + 1 : latex.closing(preamble, found.end())]
    lengths = {m[2]: m[3] for m in re.finditer(r"\\(setlength|deflen)\{\\?(\w+)\}\{([^{}]*)\}", preamble)}
    colors = {m[1]: [m[2], m[3]] for m in re.finditer(r"\\definecolor\{(\w+)\}\{(\w+)\}\{([^{}]*)\}", preamble)}
    packages = [[m[1] or "", m[2]] for m in re.finditer(r"\\usepackage(?:\[([^\]]*)\])?\{([^}]*)\}", preamble)]
    return {"fields": fields, "setlengths": lengths, "colors": colors, "packages": packages}


def write_metadata(m: Node) -> str:
    out = [f"\\usepackage{f'[{o}]' if o else ''}{{{p}}}" for o, p in m["packages"]]
    out += [f"\\definecolor{{{k}}}{{{model}}}{{{value}}}" for k, (model, value) in m["colors"].items()]
    out += [f"\\setlength{{\\{k}}}{{{v}}}" for k, v in m["setlengths"].items()]
    return "\n".join([*out, *(f"\\renewcommand{{\\{k}}}{{{v}}}" for k, v in m["fields"].items())])


def read_document(text: str) -> Node:
    r"""A whole document, or one work-experience environment; ValueError for anything else."""
    head, mark, body = text.partition("\\begin{document}")
    if not mark:
        if len(list(latex.environments(text, HISTORY_ENVIRONMENT))) == 1:
            return read_experience(text)
        raise ValueError("neither a document nor one work experience")
    body = body.partition("\\end{document}")[0]
    pages = [p for p in re.split(r"\\clearpage\b", body) if p.strip()]
    return {"document": {"metadata": read_metadata(head), "pages": [read_page(p, k) for k, p in enumerate(pages, 1)]}}


def write_document(node: Node) -> str:
    """LaTeX of what `read_document` gives."""
    if "document" not in node:
        return write_experience(node)
    d = node["document"]
    pages = "\n\\clearpage\n".join(map(write_page, d["pages"]))
    return f"\\documentclass{{resume}}\n{write_metadata(d['metadata'])}\n\\begin{{document}}\n{pages}\\end{{document}}\n"


def _json(node: Node) -> str:
    return json.dumps(node, ensure_ascii=False, sort_keys=True)


def _guarded(f: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return f(text)
        except (ValueError, KeyError, IndexError, TypeError) as e:
            return _json({"error": str(e)})

    return lambda s: s.map(one)


#: Column functions: LaTeX to JSON, and JSON to LaTeX; a text that cannot be read gives {"error": ...}, null gives null.
read_column = F.pandas_udf(_guarded(lambda t: _json(read_document(t))), StringType())
write_column = F.pandas_udf(_guarded(lambda t: write_document(json.loads(t))), StringType())


def round_trip(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, error, same, n_pages, n_sections: whether what is written from a parsed document parses to the same document."""
    first = docs.select(key, read_column(F.col(text)).alias("a"))
    again = first.withColumn("b", F.when(F.get_json_object("a", "$.error").isNull(), read_column(write_column("a"))))
    pages = F.from_json(F.get_json_object("a", "$.document.pages"), "array<struct<regions:map<string,struct<sections:array<string>>>>>")
    counted = F.aggregate(F.flatten(F.transform(pages, lambda p: F.transform(F.map_values(p["regions"]), lambda r: F.size(r["sections"])))), F.lit(0), lambda s, n: s + n)
    return again.select(key, F.get_json_object("a", "$.error").alias("error"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"), F.size(pages).alias("n_pages"), counted.alias("n_sections"))
