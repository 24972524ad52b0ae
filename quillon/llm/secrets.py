"""Secret scans with multipart credential linking, in DataFrame functions only (operator 6).

Three strong kinds are found by pattern alone. Weak candidates (account
identifiers, long mixed tokens, endpoints) count only in company: within a
scope (text between blank lines) the parts are laid out as intervals, and an
interval join in its as-of form, the nearest part of each other role before
and after, decides whether complementary parts lie within reach. No pairs are
made, so a scope full of parts costs its sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that end where the class ends: a length bound in the pattern equals a filter on the greedy match.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "identifier", "candidate", "endpoint")
ASSIGN_VALUE = 8
#: Weak parts. An identifier's name may end a longer one (DB_USER, dbUser). A candidate is a whole run of token characters
#: that is MIXED: it holds an upper-case letter, a lower-case one and a digit, wherever in the run.
IDENTIFIER = r"""(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:(?:client_?id|access_?key_?id|account(?:_?id)?|user(?:_?name|_?id)?|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}"
MIXED = ("[A-Z]", "[a-z]", "[0-9]")
ENDPOINT = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s\"'<>]+"
SCOPE_BREAK = r"\n[\x20\t\r]*\n"
MASK = "[SECRET]"


def _running(x: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("a"))
    return F.aggregate(x, start, lambda s, v: F.struct((s["t"] + v).alias("t"), F.concat(s["a"], F.array(s["t"] + v)).alias("a")), lambda s: s["a"])


def prefix_sums(x: Column) -> Column:
    """Inclusive prefix sums of an array of long, in blocks so that long arrays stay affordable."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 256).cast("int")), lambda b: F.slice(x, b * 256 + 1, 256))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, v: s + v))
    return F.flatten(F.zip_with(F.zip_with(blocks, _running(totals), lambda b, t: F.struct(b.alias("b"), t.alias("t"))), totals, lambda p, t: F.transform(_running(p["b"]), lambda v: v + p["t"] - t)))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end) in code points of each match: what lies between matches gives the offsets."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    length = F.zip_with(between, matches, lambda a, b: (F.char_length(a) + F.char_length(b)).cast("long"))
    made = F.zip_with(prefix_sums(length), matches, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
    return F.when(F.size(matches) > 0, made).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def _mixed(run: Column) -> Column:
    upper, lower, digit = (run.rlike(p) for p in MIXED)
    return upper & lower & digit


def _candidates(text: Column, matches: Column) -> Column:
    """Spans of the runs of CANDIDATE that are mixed."""
    both = F.zip_with(_spans(text, matches, CANDIDATE, 4), matches, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    return F.transform(F.filter(both, lambda x: _mixed(x["m"])), lambda x: x["s"])


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with column base: the strong spans, by start and kind."""
    found = docs.withColumns({f"_m{k}": _matches(F.col(text), p) for k, p in enumerate((ASSIGN, ACCESS, HEX))} | {"_v": F.regexp_extract_all(F.col(text), F.lit(ASSIGN), F.lit(2))})
    found = found.withColumns({f"_s{k}": _spans(F.col(text), F.col(f"_m{k}"), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX))})
    long = F.transform(F.filter(F.zip_with("_s0", "_v", lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: F.char_length(x["v"]) >= ASSIGN_VALUE), lambda x: x["s"])
    found = found.withColumn("base", F.array_sort(F.concat(long, "_s1", "_s2")))
    return found.drop(*[f"_{a}{k}" for a in "ms" for k in range(3)], "_v")


def linked_spans(docs: DataFrame, key: list[str], text: str, reach: int | None = None) -> DataFrame:
    """key and weak: the weak spans that complementary parts confirm (documents without any are absent).

    `reach` is the most code points between two parts of one credential (null: any
    distance within the scope). An identifier needs a secret within reach, a secret candidate an identifier
    or endpoint, an endpoint an identifier and a secret. Strong spans count as
    company: access ids as identifiers, assignments as secrets.
    """
    t = F.col(text)
    candidate = t.rlike(CANDIDATE) & F.exists(_matches(t, CANDIDATE), _mixed)
    assigned = t.rlike(ASSIGN) & (t.rlike(IDENTIFIER) | (t.rlike(ACCESS) & t.rlike(ENDPOINT)))
    # No narrower than the rule below: whatever `confirmed` holds for passes.
    weak = docs.select(*key, text).filter(((t.rlike(IDENTIFIER) | t.rlike(ENDPOINT) | t.rlike(ACCESS)) & candidate) | assigned)
    scopes = weak.withColumn("_b", _matches(t, SCOPE_BREAK)).withColumn("_e", F.transform(_spans(t, F.col("_b"), SCOPE_BREAK, 0), lambda s: s["end"]))
    scopes = scopes.select(*key, "_e", F.posexplode(F.split(t, SCOPE_BREAK, -1)).alias("scope", "part"))
    scopes = scopes.withColumn("base_at", F.when(F.col("scope") > 0, F.element_at("_e", F.greatest(F.col("scope"), F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    parts = base_spans(scopes.select(*key, "scope", "base_at", "part"), "part")
    part = F.col("part")
    parts = parts.withColumns({f"_w{k}": _matches(part, p) for k, p in ((3, IDENTIFIER), (4, CANDIDATE), (5, ENDPOINT))})
    found = [_spans(part, F.col("_w3"), IDENTIFIER, 3), _candidates(part, F.col("_w4")), _spans(part, F.col("_w5"), ENDPOINT, 5)]
    rows = parts.select(*key, "scope", "base_at", F.inline(F.concat("base", *found)))
    role = {"identifier": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 4), "endpoint": F.col("kind") == 5}
    ahead = Window.partitionBy(*key, "scope").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*key, "scope").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for name, has in role.items():
        before = F.col("start") - F.max(F.when(has, F.col("end"))).over(ahead)
        after = F.min(F.when(has, F.col("start"))).over(behind) - F.col("end")
        nearest = F.least(before, after)
        near[f"_{name}"] = nearest.isNotNull() if reach is None else F.coalesce(nearest <= reach, F.lit(False))
    joined = rows.withColumns(near)
    confirmed = ((F.col("kind") == 3) & F.col("_secret")) | ((F.col("kind") == 4) & (F.col("_identifier") | F.col("_endpoint"))) | ((F.col("kind") == 5) & F.col("_identifier") & F.col("_secret"))
    span = F.struct((F.col("start") + F.col("base_at")).alias("start"), "kind", (F.col("end") + F.col("base_at")).alias("end"))
    return joined.filter(confirmed).groupBy(*key).agg(F.collect_set(span).alias("weak"))


def _scanned(docs: DataFrame, text: str, key: str, keep: list[str], reach: int | None = None) -> DataFrame:
    """_k, base, spans, and the columns of `keep` as _keep0, _keep1 ..."""
    own = docs.select(docs[key].alias("_k"), F.coalesce(docs[text], F.lit("")).alias("_t"), *[docs[c].alias(f"_keep{n}") for n, c in enumerate(keep)]).withColumn("_h", F.xxhash64("_t"))
    strong = base_spans(own, "_t").drop("_t")
    weak = linked_spans(own, ["_k", "_h"], "_t", reach).withColumnsRenamed({"_k": "_k2", "_h": "_h2"})
    both = strong.join(weak, (F.col("_h") == F.col("_h2")) & F.col("_k").eqNullSafe(F.col("_k2")), "left")
    fresh = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    spans = F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", fresh)))
    return both.select("_k", "base", spans.alias("spans"), *[f"_keep{n}" for n in range(len(keep))])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int | None = None) -> DataFrame:
    """key, base, spans (arrays of start, kind, end) of every document.

    Null text counts as empty. A weak span that overlaps a strong one of the
    same document is left out, as that secret is already reported. Rows that
    repeat a key with other text are told apart; identical rows get equal
    results. An empty table gives an empty result; extra columns are dropped.
    """
    return _scanned(docs, text, key, [], reach).withColumnRenamed("_k", key)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """`docs` with every reported span replaced by MASK (and `length`, where there is such a column, counted again).

    Overlapping spans become one. Texts without spans, null ones included, stay as they are.
    """
    columns = docs.columns
    found = _scanned(docs, text, key, columns)
    t = F.col(f"_keep{columns.index(text)}")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(t, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        grown = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(gap, F.lit(MASK)))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), grown.alias("out"))

    rebuilt = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, (s["at"] + 1).cast("int"), F.lit(2147483647))))
    new = found.withColumn("_new", F.when(F.size("spans") > 0, rebuilt).otherwise(t))
    out = []
    for n, c in enumerate(columns):
        own = F.col(f"_keep{n}")
        if c == text:
            own = F.col("_new")
        elif c == length:
            own = F.when(F.size("spans") > 0, F.char_length("_new").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return new.select(*out)


def _is(kind: int):
    return lambda k: k == kind


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
