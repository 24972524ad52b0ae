"""Semi-structured job texts: sections, classes, metadata and identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import collapse, strip
from .windows import islands

#: Section-name patterns by archetype and their priorities; the order breaks ties.
REQUIRED = (r"you have", r"basic qualifications?", r"required qualifications?", r"minimum qualifications?", r"requirements?", r"must\-? ?have", r"required skills?", r"what you'?ll need", r"qualified candidates? will have", r"required:?", r"we're looking for", r"what we.* like you to have", r"ideally you.*have", r"what you('ll)? bring", r"what we need to see")
PREFERRED = (r"nice (?:if you )?have", r"additional qualifications?", r"preferred qualifications?", r"^preferred$", r"bonus experience", r"nice to have", r"preferred skills?", r"preferred certifications?", r"go above and beyond", r"desired:?", r"strong candidates may also", r"what would blow us away", r"ways to stand out.*", r"what we would like to see")
AMBIGUOUS = (r"ideal qualifications?",)
FALLBACK = (r"^qualifications?$",)
ARCHETYPES = {
    "required_qualifications": (5, REQUIRED),
    "preferred_qualifications": (5, PREFERRED),
    "about_role": (3, (r"(?:about )?(?:the )?(?:role|position|opportunity)", r"job (?:summary|description)", r"meaningful work")),
    "responsibilities": (4, (r"what you'?ll (?:be )?do(?:ing)?", r"responsibilities", r"basic responsibilities", r"your (?:role|responsibilities)")),
    "about_company": (2, (r"about (?:the )?(?:company|us)", r"who we are", r"our (?:company|mission|culture)")),
    "benefits": (2, (r"benefits", r"compensation", r"what we offer", r"perks")),
    "application_process": (1, (r"how to apply", r"application (?:process|instructions)", r"equal (?:opportunity|employment)", r"eeo statement", r"reasonable accommodation")),
}
#: Phrases of boilerplate section names.
BOILERPLATE = ("eeo statement", "equal opportunity employer", "equal employment opportunity", "diversity and inclusion", "reasonable accommodation", "disability accommodation", "application process", "how to apply", "privacy policy", "disclaimer", "pay range", "salary", "compensation", "benefits", "perks and benefits", "why work at", "url", "date_posted", "location", "job_id", "time type")
#: Characters rewritten after NFKC.
REPLACEMENTS = {" ": " ", " ": " ", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "•": "*", "…": "...", "·": "*"}
#: Metadata fields in their order, and the names they go by in bold.
FIELDS = ("Company", "Role", "Location", "Salary", "Work Mode", "Job ID", "Source", "URL", "Clearance", "Date Posted")
SYNONYMS = {"company": "Company", "role": "Role", "title": "Role", "position": "Role", "location": "Location", "salary": "Salary", "pay": "Salary", "compensation": "Salary", "source": "Source", "url": "URL", "link": "URL", "job id": "Job ID", "job_id": "Job ID", "requisition": "Job ID", "req id": "Job ID", "clearance": "Clearance", "security clearance": "Clearance", "work mode": "Work Mode", "remote": "Work Mode", "date posted": "Date Posted", "posted": "Date Posted"}
#: Header, salary, place, work-mode and job-id patterns.
BOLD_HEADER, HASH_HEADER = r"^\*\*([^*]+?):?\*\*", r"^#{1,4}\s+(.+?):?\s*$"
SALARY = r"(?i)\$[\d,]+(?:\s*[-–—]\s*\$[\d,]+)?(?:\s*(?:per\s+)?(?:year|yr|annually|/yr))?"
CITY_STATE = r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*),\s*([A-Z]{2})\b"
WORK_MODE = r"(?i)\b(Remote|Hybrid|On-?site|In-?office)\b"
JOB_IDS = (r"(?i)(?:Job\s*(?:ID|#|Number|Ref|Identification))\b[:\s]*([A-Z0-9_-]+)", r"(?i)(?:Position\s*(?:ID|#|Number))[:\s]*([A-Z0-9_-]+)")
#: The states a place may name in full.
US_STATES = ("Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming")
CITY_STATE_FULL = r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*),\s*(" + "|".join(US_STATES) + r")\b"
#: Identifier abbreviations.
WORDS = {"Machine Learning": "ML", "Data Science": "DataSci", "Data Scientist": "DataSci", "Artificial Intelligence": "AI", "Infrastructure": "Infra", "Operations": "Ops", "Engineering": "Eng", "Engineer": "Eng", "Scientist": "Sci", "Research": "Res", "Developer": "Dev", "Software": "Soft"}
SENIORITY = {"Senior": "Sen", "Sr.": "Sen", "Sr": "Sen", "Principal": "Prin", "Staff": "Staff", "Lead": "Lead", "Head": "Head", "Junior": "Jr", "Jr.": "Jr", "Mid": "Mid", "Chief": "Chief", "I": "I", "II": "II", "III": "III", "IV": "IV", "V": "V"}
COMPANIES = {"Booz Allen Hamilton": "BAH", "Technology": "Tech", "Technologies": "Tech"}
SUFFIXES = ("Inc", "LLC", "Corporation", "Corp")
SOURCES = {"LinkedIn": "LI", "Glassdoor": "GH"}


@F.pandas_udf(StringType())
def normalise_unicode(texts: pd.Series) -> pd.Series:
    """NFKC, then the fixed replacements (no built-in has NFKC)."""
    table = str.maketrans(REPLACEMENTS)
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(table))


def name_key(c: Column) -> Column:
    """Section name for matching: lower case, white space collapsed."""
    return collapse(F.lower(c))


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def archetype(name: Column) -> Column:
    """Archetype of the highest priority whose patterns match; the first listed wins a tie, `other` where none does."""
    key = name_key(name)
    chosen = F.lit("other")
    ranked = sorted(ARCHETYPES.items(), key=lambda kv: -kv[1][0])  # stable: the listed order breaks ties
    for kind, (_, patterns) in reversed(ranked):
        chosen = F.when(_any(key, patterns), F.lit(kind)).otherwise(chosen)
    return chosen


def is_boilerplate(name: Column) -> Column:
    """Whether the name contains a boilerplate phrase, inside words too."""
    key = name_key(name)
    return F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(key, p))


def qualification_class(sections: DataFrame, job: str, order: str, name: str) -> DataFrame:
    """sections with qualification: 'required', 'preferred' or null, in three passes a job.

    Clear names first (preferred before required); ambiguous names fill the
    empty side, else count as required; the first bare "qualifications" is
    required where nothing else is.
    """
    key = name_key(F.col(name))
    strong = F.when(_any(key, PREFERRED), "preferred").when(_any(key, REQUIRED), "required")
    rows = sections.withColumns({"_strong": strong, "_unsure": F.coalesce(strong.isNull() & _any(key, AMBIGUOUS), F.lit(False)), "_bare": _any(key, FALLBACK)})
    w = Window.partitionBy(job)
    has = lambda side: F.coalesce(F.max(F.col("_strong") == side).over(w), F.lit(False))
    rows = rows.withColumns({"_req": has("required"), "_pref": has("preferred")})
    place = F.sum(F.col("_unsure").cast("int")).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    fills = F.when(~F.col("_req") & (place == 1), "required").when(~F.col("_pref") & (place == F.when(F.col("_req"), 1).otherwise(2)), "preferred").otherwise("required")
    rows = rows.withColumn("_second", F.coalesce(F.col("_strong"), F.when(F.col("_unsure"), fills)))
    any_class = F.max(F.col("_second") == "required").over(w)
    first_bare = F.min(F.when(F.col("_bare") & F.col("_second").isNull(), F.col(order))).over(w)
    third = F.when(F.col("_second").isNull() & ~F.coalesce(any_class, F.lit(False)) & (F.col(order) == first_bare), "required")
    return rows.withColumn("qualification", F.coalesce("_second", third)).drop("_strong", "_unsure", "_bare", "_req", "_pref", "_second")


def sections(jobs: DataFrame, job: str = "job_id", text: str = "text") -> DataFrame:
    """job, ord, name, content: headed sections of a text.

    A line that starts with **Name** or is # Name opens one (what follows the
    bold name is content). Text before the first header, headers directly
    followed by headers and empty sections go; of a repeated name the last stays.
    """
    lines = jobs.select(job, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "raw")).withColumn("s", strip(F.col("raw")))
    bold, hashed = F.regexp_extract("s", BOLD_HEADER, 1), F.regexp_extract("s", HASH_HEADER, 1)
    lines = lines.withColumn("header", F.when(bold != "", strip(bold)).when(hashed != "", strip(hashed)))
    rest = F.when(bold != "", strip(F.regexp_replace("s", BOLD_HEADER, ""))).when(hashed != "", F.lit("")).otherwise(F.col("raw"))
    grouped = islands(lines.withColumn("body", rest), job, "line", F.col("header").isNotNull()).filter("island > 0")
    parts = grouped.groupBy(job, "island").agg(F.max("header").alias("name"), F.sort_array(F.collect_list(F.struct("line", "body"))).alias("b"))
    parts = parts.withColumn("content", strip(F.array_join(F.transform("b", lambda x: x["body"]), "\n"))).filter("content <> ''")
    last = parts.groupBy(job, "name").agg(F.min("island").alias("ord"), F.max_by("content", "island").alias("content"))
    return last.select(job, "ord", "name", "content")


def flatten_subheaders(text: Column) -> Column:
    """`**- Name:**` as `**Name:**`."""
    return F.regexp_replace(text, r"\*\*\s*[-•—]\s*([^*:]+):\s*\*\*", "**$1:**")


def bold_fields(text: Column) -> Column:
    """map field -> value of `**Field:** value` lines by the fixed names; the last one of a field wins."""
    pattern = r"\*\*([^*]+):\*\*\s*(.+?)(?:\n|$)"
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    named = F.filter(F.transform(pairs, lambda p: F.struct(F.try_element_at(table, F.lower(strip(p["k"]))).alias("k"), strip(p["v"]).alias("v"))), lambda p: p["k"].isNotNull())
    keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(named, lambda p: p["k"] == k), -1)["v"])))


def first_match(text: Column, patterns: tuple[str, ...], group: int = 1) -> Column:
    """First hit of the first pattern that has one, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def heading_role(text: Column) -> Column:
    """What follows `# ` on the first such line among a text's first ten, else null."""
    top = F.transform(F.slice(F.split(strip(text), "\n", -1), 1, 10), strip)
    return strip(F.substr(F.try_element_at(F.filter(top, lambda x: F.startswith(x, F.lit("# "))), F.lit(1)), F.lit(3)))


def work_mode(text: Column) -> Column:
    """Remote, Hybrid or On-site by the first word that names one, else null."""
    word = F.lower(F.regexp_extract(text, WORK_MODE, 1))
    return F.when(word.isin("remote", "hybrid"), F.initcap(word)).when(word.isin("onsite", "on-site", "inoffice", "in-office"), "On-site")


def place(text: Column) -> Column:
    """City and state, the abbreviated form before the full one, joined by a comma and a blank."""
    found = [F.concat_ws(", ", _some(F.regexp_extract(text, p, 1)), _some(F.regexp_extract(text, p, 2))) for p in (CITY_STATE, CITY_STATE_FULL)]
    return F.coalesce(*map(_some, found))


def metadata(text: Column, filename: Column | None = None) -> Column:
    """map of heuristic metadata. Later ones win: file name, first heading, bold fields, then salary, place, work mode and job id found in the text."""

    def layer(found: dict[str, Column]) -> Column:
        entries = F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)])
        return F.map_filter(entries, lambda _, v: v.isNotNull() & (v != ""))

    layers = [layer({"Role": heading_role(text)}), F.map_filter(bold_fields(text), lambda _, v: v != "")]
    layers.append(layer({"Salary": first_match(text, (SALARY,), 0), "Location": place(text), "Work Mode": work_mode(text), "Job ID": first_match(text, JOB_IDS)}))
    if filename is not None:
        hints = filename_metadata(filename)
        layers.insert(0, layer({"Company": hints["company"], "Job ID": hints["job_id"]}))
    out = layers[0]
    for top in layers[1:]:
        out = F.map_zip_with(out, top, lambda _, a, b: F.coalesce(b, a))
    return out


def metadata_section(text: Column) -> Column:
    """map field -> value of the `### Field` entries in a text's `## Metadata` section, under the fixed names whatever their case."""
    own = F.regexp_extract(F.concat(F.lit("\n"), text, F.lit("\n")), r"(?s)\n## Metadata[ \t]*\n(.*?)(?=\n## |\z)", 1)
    entry = r"(?s)(?:^|\n)### ([^\n]+)\n+(.*?)(?=\n### |\z)"
    names = {f.lower(): f for f in FIELDS}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    pairs = F.zip_with(F.regexp_extract_all(own, F.lit(entry), F.lit(1)), F.regexp_extract_all(own, F.lit(entry), F.lit(2)), lambda k, v: F.struct(F.try_element_at(table, F.lower(strip(k))).alias("k"), strip(v).alias("v")))
    known = F.filter(pairs, lambda x: x["k"].isNotNull() & (x["v"] != ""))
    keys = F.array_distinct(F.transform(known, lambda x: x["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(known, lambda x: x["k"] == k), -1)["v"])))


def title(fields: Column, text: Column) -> Column:
    """The Role, else the first line that is not blank, without its # and ** marks."""
    first = F.try_element_at(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != ""), F.lit(1))
    return F.coalesce(F.try_element_at(fields, F.lit("Role")), strip(F.regexp_replace(first, r"^#+|\*\*", "")))


def parse_job_text(jobs: DataFrame, job: str = "job_id", text: str = "text", filename: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(job, title, metadata; its sections with their archetype, boilerplate flag and qualification class) of raw texts."""
    fields = metadata(F.col(text), None if filename is None else F.col(filename))
    heads = jobs.withColumn("_m", fields).select(job, title(F.col("_m"), F.col(text)).alias("title"), F.col("_m").alias("metadata"))
    flat = sections(jobs.select(job, flatten_subheaders(F.col(text)).alias(text)), job, text)
    rows = qualification_class(flat, job, "ord", "name")
    return heads, rows.withColumns({"archetype": archetype(F.col("name")), "boilerplate": is_boilerplate(F.col("name"))})


def plain_text(rows: DataFrame, job: str, boilerplate: bool = True) -> DataFrame:
    """job, text: contents of its sections in order, a blank line between them; without boilerplate sections if asked."""
    kept = rows if boilerplate else rows.filter(~is_boilerplate(F.col("name")))
    return kept.groupBy(job).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n\n").alias("text"))


def filename_metadata(name: Column) -> Column:
    """struct(company, job_id) of Role_Company[_id][.ext], hyphens in the company as blanks; the last of three parts or more is an id if it has a digit and 4 to 30 characters."""
    parts = F.split(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=[^.])\.[^.]*$", ""), "_", -1)
    last = F.element_at(parts, -1)
    is_id = (F.size(parts) >= 3) & last.rlike(r"[0-9]") & F.char_length(last).between(4, 30)
    company = F.when(is_id, F.try_element_at(parts, F.lit(-2))).when(F.size(parts) >= 2, last)
    return F.struct(F.replace(company, F.lit("-"), F.lit(" ")).alias("company"), F.when(is_id, last).alias("job_id"))


def job_type(filename: Column) -> Column:
    """Middle parts of Res..._type_company; anything else is Unknown."""
    parts = F.split(filename, "_", -1)
    return F.when((F.size(parts) >= 3) & F.startswith(filename, F.lit("Res")), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_")).otherwise("Unknown")


def identifier(role: Column, company: Column, seniority: Column | None = None, focus: Column | None = None, source: Column | None = None, job_id: Column | None = None) -> Column:
    """Title_Seniority_Focus_Company_Source_Id without the parts that are missing; null without a role or company.

    Seniority and focus come from the role where they are not given: a known
    word at its start, and what follows its first comma or spaced dash.
    """
    level, rest = F.lit(None).cast("string"), strip(role)
    for word, short in reversed(SENIORITY.items()):
        hit = F.startswith(strip(role), F.lit(word + " ")) | F.startswith(strip(role), F.lit(word + ","))
        level, rest = F.when(hit, F.lit(short)).otherwise(level), F.when(hit, F.regexp_replace(F.substr(strip(role), F.lit(len(word) + 1)), "^[ ,]+", "")).otherwise(rest)
    halves = F.split(rest, r"\s+[-–—]\s+|,\s*", 2)
    main, own_focus = strip(F.element_at(halves, 1)), F.when(F.size(halves) == 2, strip(F.element_at(halves, -1)))
    # Of alternatives joined by slashes the first stays, with the words that follow the last.
    main = F.coalesce(F.concat(F.regexp_extract(main, "^[^/]*", 0), F.lit(" "), _some(F.regexp_extract(main, r"/[^/\s]*\s+([^/]*)$", 1))), main)
    for word, to in WORDS.items():
        main = F.replace(main, F.lit(word), F.lit(to))
    bare = F.regexp_replace(company, r"[,.\-']", "")
    for suffix in SUFFIXES:
        bare = F.regexp_replace(bare, rf"\s+{suffix}$", "")
    known, sites = (F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) for table in (COMPANIES, SOURCES))
    firm = F.coalesce(F.try_element_at(known, company), F.replace(bare, F.lit(" "), F.lit("")))
    given = lambda c: F.lit(None).cast("string") if c is None else _some(c)
    parts = [F.regexp_replace(main, "[ -]", ""), F.coalesce(given(seniority), level), F.coalesce(given(focus), _some(own_focus)), firm, F.coalesce(F.try_element_at(sites, given(source)), given(source)), given(job_id)]
    return F.when(_some(role).isNotNull() & _some(company).isNotNull(), F.concat_ws("_", *parts))


def parse_identifier(c: Column) -> Column:
    """struct(title, company, seniority, focus, source, job_id).

    The first part is the title, the last the job id; before that a known source
    and the company are peeled off the end. Between title and company, the last
    known seniority and the last other part count.
    """
    parts = F.split(c, "_", -1)
    take = lambda array, size: F.slice(array, F.lit(1), size)
    several = lambda array: F.size(array) > 1
    less = lambda array, has: F.when(has, take(array, F.size(array) - 1)).otherwise(array)
    tail = lambda array, has: F.when(has, F.element_at(array, -1)).otherwise("")
    body, job_id = less(parts, several(parts)), tail(parts, several(parts))
    is_source = several(body) & F.element_at(body, -1).isin(*SOURCES.values())
    body, source = less(body, is_source), tail(body, is_source)
    middle, company = less(body, several(body)), tail(body, several(body))
    inner = F.slice(middle, F.lit(2), F.size(middle))
    levels = F.array(*map(F.lit, dict.fromkeys(SENIORITY.values())))
    last = lambda array: F.coalesce(F.try_element_at(array, F.lit(-1)), F.lit(""))
    level, focus = last(F.filter(inner, lambda x: F.array_contains(levels, x))), last(F.filter(inner, lambda x: ~F.array_contains(levels, x)))
    return F.struct(F.element_at(parts, 1).alias("title"), company.alias("company"), level.alias("seniority"), focus.alias("focus"), source.alias("source"), job_id.alias("job_id"))


def bullets(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, position, bullet: the * and - items of a text."""
    hits = F.regexp_extract_all(F.col(content), F.lit(r"(?m)^[ \t]*[*-]\s+(.+)$"), F.lit(1))
    return rows.select(key, F.posexplode(hits).alias("position", "bullet")).withColumn("bullet", strip(F.col("bullet")))


def validation(sections_: DataFrame, job: str) -> DataFrame:
    """job, n_sections, n_lines, n_chars and warnings; needs columns content and qualification."""
    got = sections_.groupBy(job).agg(F.count("*").alias("n_sections"), F.sum(F.size(F.split("content", "\n", -1))).alias("n_lines"), F.sum(F.char_length("content")).alias("n_chars"), F.coalesce(F.bool_or(F.col("qualification") == "required"), F.lit(False)).alias("r"), F.coalesce(F.bool_or(F.col("qualification") == "preferred"), F.lit(False)).alias("p"))
    warnings = F.array_compact(F.array(F.when(~F.col("r"), "no required qualifications"), F.when(~F.col("p"), "no preferred qualifications"), F.when(F.col("n_sections") < 3, "fewer than three sections")))
    return got.withColumn("warnings", warnings).drop("r", "p")


def canonical_markdown(fields: Column, body: Column) -> Column:
    """A metadata section in the fixed field order, then the body without its own."""
    lines = [F.when(F.try_element_at(fields, F.lit(f)).isNotNull(), F.concat(F.lit(f"### {f}\n"), F.try_element_at(fields, F.lit(f)), F.lit("\n"))) for f in FIELDS]
    return F.concat_ws("\n", F.lit("## Metadata\n"), *lines, strip(F.regexp_replace(body, r"(?s)(?m)^## Metadata\s*$.*?(?=^## |\z)", "")))
