"""LaTeX text functions: a small scanner, and Arrow functions over text columns.

Balanced delimiters are beyond regular expressions, so these run in Arrow
batches; whatever is flat has a column expression in `text`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Commands unwrapped to their argument, commands dropped, symbols and escapes rewritten, each in this order.
WRAPPERS = ("textbf", "textit", "emph", "underline", "texttt", "scshape", "coloremph", "textnormal")
DROPPED = ("centering", "par", "nolinebreak", "nopagebreak")
SYMBOLS = ((r"$\to$", " to "), (r"\to", "->"), (r"\rightarrow", "->"), (r"\leftarrow", "<-"), (r"$\leftrightarrow$", "↔"), (r"\leftrightarrow", "↔"), (r"\leq", "<="), (r"\geq", ">="), (r"\neq", "!="), (r"\sim", "~"), (r"\approx", "≈"), (r"\texttimes", "×"), (r"\times", "×"), (r"\textonehalf", "half"))
ESCAPES = ((r"\%", "%"), (r"\$", "$"), (r"\&", "&"), (r"\#", "#"), (r"\_", "_"), (r"\ ", " "), (r"\;", " "), (r"\,", " "), (r"\:", " "), (r"\!", ""))


def closing(text: str, at: int, opens: str = "{", closes: str = "}") -> int:
    """Index of the delimiter that closes the one at `at`; escaped delimiters do not count. ValueError where none does."""
    if at >= len(text) or text[at] != opens:
        raise ValueError(f"no {opens} at {at}")
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == opens:
            depth += 1
        elif c == closes:
            depth -= 1
            if not depth:
                return i
        i += 1
    raise ValueError(f"unclosed {opens} at {at}")


def arguments(text: str, at: int, count: int, opens: str = "{", closes: str = "}") -> tuple[list[str], int]:
    """`count` delimited arguments from `at`, white space between them skipped, and where they end."""
    out = []
    for _ in range(count):
        while at < len(text) and text[at].isspace():
            at += 1
        end = closing(text, at, opens, closes)
        out.append(text[at + 1 : end])
        at = end + 1
    return out, at


@dataclass(frozen=True)
class Environment:
    name: str
    optional: list[str]
    params: list[str]
    content: str
    start: int
    end: int


def environments(text: str, name_pattern: str, params: int = 0, optional: int = 0) -> Iterator[Environment]:
    """Outermost environments whose name matches, in order; nested ones of the same name are balanced."""
    at = 0
    begin = re.compile(r"\\begin\{(" + name_pattern + r")\}")
    while found := begin.search(text, at):
        name, depth, end = found[1], 1, -1
        for mark in re.finditer(r"\\(begin|end)\{" + re.escape(name) + r"\}", text[found.end() :]):
            depth += 1 if mark[1] == "begin" else -1
            if not depth:
                end = found.end() + mark.start()
                break
        if end < 0:
            raise ValueError(f"unclosed environment {name}")
        given, body = [], found.end()
        for _ in range(optional):
            if body < end and text[body] == "[":
                own, body = arguments(text, body, 1, "[", "]")
                given += own
        values, body = arguments(text, body, params)
        yield Environment(name, given, values, text[body:end], found.start(), end + len(name) + 6)
        at = end + len(name) + 6


def replace_command(text: str, command: str, prefix: str = "", suffix: str = "") -> str:
    r"""\command{x} as prefix + x + suffix, nested ones too; an unclosed one stays."""
    head, at, out = re.compile(r"\\" + command + r"(?![A-Za-z])\s*(?=\{)"), 0, []
    while found := head.search(text, at):
        try:
            end = closing(text, found.end())
        except ValueError:
            break
        out += [text[at : found.start()], prefix, replace_command(text[found.end() + 1 : end], command, prefix, suffix), suffix]
        at = end + 1
    return "".join([*out, text[at:]])


def pattern_literal(pattern: str) -> str:
    """The text that a pattern of escaped characters alone stands for."""
    return re.sub(r"\\(.)", r"\1", pattern)


def strip_formatting(text: str, commands: tuple[str, ...] = WRAPPERS) -> str:
    """Without the given commands, their arguments kept."""
    for command in commands:
        text = replace_command(text, command)
    return text


def remove_at_end(text: str, command: str) -> str:
    r"""Without a \command{...} (or a bare \command) that the text ends with, white space aside."""
    found = list(re.finditer(r"\\" + command + r"(?![A-Za-z])\s*", text))
    if found:
        last = found[-1]
        try:
            end = closing(text, last.end()) + 1 if text[last.end() : last.end() + 1] == "{" else last.end()
        except ValueError:
            return text
        if not text[end:].strip():
            return text[: last.start()].rstrip()
    return text


def to_plaintext(latex: str | None, strip_params: bool = True) -> str:
    r"""Text without markup, by ordered rewriting.

    Two habits are kept: an escaped dollar sign is lost with the math signs,
    and \to eats the head of longer commands, as it is a plain replacement.
    """
    if not latex:
        return ""
    for command in WRAPPERS:
        latex = replace_command(latex, command)
    latex = re.sub(r"\\(?:text)?color\{[^}]*\}\{([^}]*)\}", r"\1", latex)
    latex = re.sub(r"\\color\{[^}]*\}", "", latex)
    latex = re.sub(r"\\(?:" + "|".join(DROPPED) + r")(?![A-Za-z])\s*", "", latex)
    latex = re.sub(r"\\[vh]space\*?\{[^}]*\}", "", latex).replace("\\\\", " ")
    for table in (SYMBOLS, ESCAPES):
        for command, to in table:
            latex = latex.replace(command, to)
    latex = latex.replace("---", "—").replace("--", "–").replace("$", "")
    latex = re.sub(r"\\[A-Za-z]+\*?\{[^{}]*\}", "", latex)
    latex = re.sub(r"\\[A-Za-z]+\*?", "", latex)
    if strip_params:
        latex = re.sub(r"\[[^\]]*=[^\]]*\]", "", latex)
    latex = re.sub(r"\\([{}])|[{}]", lambda m: m[1] or "", latex)
    return " ".join(latex.split())


def to_markdown(latex: str | None) -> str:
    """Bold, italics, code and links as markdown, the rest as plain text."""
    text = latex or ""
    for command, mark in (("textbf", "**"), ("textit", "*"), ("emph", "*"), ("texttt", "`")):
        text = replace_command(text, command, mark, mark)
    text = re.sub(r"\\href\{[^}]*\}(?=\{)", r"\\textnormal", text)
    return to_plaintext(text)


def itemize_entries(content: str, marker: str) -> list[dict[str, str]]:
    """{marker, latex_raw, plaintext} of each marked entry; a marker may carry a balanced [..] of its own."""
    found = list(re.finditer(marker, content))
    out = []
    for k, m in enumerate(found):
        start, stop = m.end(), found[k + 1].start() if k + 1 < len(found) else len(content)
        mark = m[0].strip()
        if start < stop and content[start] == "[":
            end = closing(content, start, "[", "]")
            mark, start = mark + content[start : end + 1], end + 1
        raw = content[start:stop].strip()
        out.append({"marker": mark, "latex_raw": raw, "plaintext": to_plaintext(raw)})
    return out


#: Comment classes that are whole lines, and those that end a line.
LINE_COMMENTS = {"decorative": r"^\s*%+\s*$", "section_headers": r"^\s*%%%.*%%%", "descriptive": r"^\s*%(\s+%)*\s+[^-\\]", "commented_code": r"^\s*%(\s+%)*\s*\\"}
INLINE_COMMENTS = {"inline_dates": ((r"}%\{[^}]*\}", "}"), (r"}%[^}]*\}(?=\s*$)", "}"), (r"}%[^}]+$", "}")), "inline_annotations": ((r"\s*%\s*-+\s*$", ""),), "descriptive": ((r"\s*(?<!\\)%\s*[^-].*$", ""),)}
COMMENT_CLASSES = tuple(dict.fromkeys((*LINE_COMMENTS, *INLINE_COMMENTS)))


def keeps_percent(line: str) -> bool:
    """Whether a line's percent signs are all escaped, or only suppress the white space at its end."""
    if "%" not in line.replace("\\%", ""):
        return True
    suppresses = line.strip() != "%" and re.search(r"[^%\s]\s*%\s*$", line)
    return bool(suppresses) and (not line.lstrip().startswith("%") or bool(re.match(r"^[^%]+%\s*$", line)))


def _uncommented(text: str, classes: tuple[str, ...]) -> str:
    whole = [re.compile(p) for name, p in LINE_COMMENTS.items() if name in classes]
    ends = [rule for name, rules in INLINE_COMMENTS.items() if name in classes and name != "descriptive" for rule in rules]
    out = []
    for line in text.split("\n"):
        if not keeps_percent(line):
            if any(p.search(line) for p in whole):
                continue
            for p, to in ends:
                line = re.sub(p, to, line)
            if "descriptive" in classes and re.search(r"(?<!\\)%\s*[^-\s]", line):
                for p, to in INLINE_COMMENTS["descriptive"]:
                    line = re.sub(p, to, line)
        out.append(line)
    return "\n".join(out)


def clean_comments(text: str, classes: tuple[str, ...] = COMMENT_CLASSES, preamble: tuple[str, ...] | None = None, suggestions: bool = False) -> str:
    r"""Without the comments of the given classes (of those in `preamble` up to \begin{document}, if given); with `suggestions` without \suggest{...} blocks."""
    head, mark, body = text.partition(r"\begin{document}")
    out = _uncommented(text, classes) if preamble is None or not mark else _uncommented(head + mark, preamble) + _uncommented(body, classes)
    while suggestions and (found := re.search(r"\\suggest(?=\{)", out)):
        try:
            end = closing(out, found.end())
        except ValueError:
            break
        out = out[: found.start()] + out[end + 1 :]
    return out


#: Rewriting rules, in this order: those before a textblock is moved, and those after.
RULES = (
    (r"(?s)\\phantomsection\s*\\textcolor\{black\}\{\\bfseries\s+\\large\s+Education\}\s*\\addcontentsline\{toc\}\{section\}\{Education\}\s*\\columnhrule\s*", r"\\section*{Education}\n"),
    (r"(\\switchcolumn)\n+\\vspace\{[^}]+\}\n+", r"\1\n\n"),
    (r"\n+\\vspace\{[^}]+\}\n+(\\switchcolumn)", r"\n\n\1"),
    (r"\n\n+(\\(?:renewcommand|setlength|deflen))", r"\n\1"),
    (r"(\\(?:renewcommand|setlength|deflen)\{[^}]+\}\{[^}]*\})\n\n+", r"\1\n"),
    (r"\n+(\s*\\item[^ ]*)", r"\n\n\1"),
    (r"( *\\end\{[^}]+\})\n+", r"\1\n\n\n"),
    (r"\n+( *\\end\{[^}]+\})", r"\n\n\1"),
    (r"\n+(\\section\*\{[^}]+\})", r"\n\n\n\1"),
    (r"(\\section\*\{[^}]+\})\n+", r"\1\n\n\n"),
    (r"([^\n])\n( *\\begin\{itemize[^}]*\})", r"\1\n\n\2"),
    (r"(\\begin\{itemize[^}]*\})\n+", r"\1\n\n"),
)
LATE_RULES = (
    (r"(\\item\[[^\]]*\])\s+\{", r"\1{"),
    (r"(\\item\w+)\s{2,}", r"\1 "),
    (r"(?m)\s+%\s*$", ""),
    (r"(\\end\{itemize(?:Key)?Project\})\n+\\vspace\{[^}]+\}\n+(\\begin\{itemize(?:Key)?Project\})", r"\1\n\n\n\2"),
    (r"\\\\[ \t]+", "\\\\\\\\\n"),
)
TAB = " " * 8
PAGE_SETUP = r"(?s)\\clearpage.*?(\\toggletrue\{useleftbar\}.*?\\pagestyle\{resume\})"
DECORATIONS = r"(?:\s*\\(?:leftgrad|bottombar)\{[^}]*\}(?:\{[^}]*\})*\s*)*"


def textblock_moved(text: str) -> str:
    """With the first textblock, and the decorations that follow it, right behind the page setup after a page break (where there is one)."""
    block = re.search(r"(?s)\\begin\{textblock\*\}.*?\\end\{textblock\*\}" + DECORATIONS, text)
    if not block:
        return text
    rest = text[: block.start()] + text[block.end() :]
    setup = re.search(PAGE_SETUP, rest)
    return rest if not setup else f"{rest[: setup.end(1)]}\n\n{block[0].strip()}\n{rest[setup.end(1) :]}"


def normalise(text: str, passes: int = 10) -> str:
    """Structure and white space by the ordered rules, again and again until nothing changes (at most `passes` times)."""
    for _ in range(passes):
        before = text
        text = "\n".join(line.lstrip() for line in text.replace("\t", TAB).split("\n"))
        for pattern, to in RULES:
            text = re.sub(pattern, to, text)
        text = textblock_moved(text)
        for pattern, to in LATE_RULES:
            text = re.sub(pattern, to, text)
        if text == before:
            break
    return text


def _column(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, StringType())


plaintext_column = _column(to_plaintext)
markdown_column = _column(to_markdown)
normalise_column = _column(normalise)
cleaned_column = _column(lambda text: clean_comments(text, suggestions=True))
