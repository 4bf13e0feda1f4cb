"""Secret scan over a trigram inverted index.

Each rule is a regular expression.  Its parse tree yields a Boolean query over
trigrams (lower case) that every match must contain: a set of clauses, each a
set of trigrams, of which one must be present as a whole.  The index holds,
for each trigram that some rule asks for, the texts with it.  Postings of a
clause's trigrams are intersected by counting them per text, which gives the
candidates of each rule; only those are verified with the regular expression.
A rule without mandatory trigrams is verified on every text.

Everything on the way is a DataFrame expression: no Python runs on the
executors.  Starts and ends come from the texts between the matches (``split``)
and the matches (``regexp_extract_all``): their lengths are summed up by a
window over the matches of one document.

Scale: the index carries 128-bit text hashes, not texts, and copies of a text
share their postings.  Texts are scanned in place; candidates reach them by a
broadcast while there are at most ``BROADCAST_CANDIDATES``, counted on the
staged table; beyond that they are chosen by position, and only they are shuffled.

Defined results: null counts as empty and holds nothing; repeated rows and
null ids are kept; an empty table gives an empty result; other columns are
ignored (``redacted`` keeps them).  Positions are code points.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as tokens
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import named, staged, table, text_keys
from tallyframe.llm.positions import POSITION, inside, outside, positioned

BROADCAST_CANDIDATES = 500_000
MOST_STRINGS = 64  # exact strings that one part of an expression may stand for
PLACEHOLDER = "[secret]"
STRETCH = 128  # values of an array that are summed up together
BLOCK = 4096  # code points of a text that are cut out together


class Rule(NamedTuple):
    kind: str
    regex: str
    group: int = 0  # whose length must be at least
    least: int = 1


BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule(  # to the END line; without one, to the end of the base64 lines
        "pem",
        r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
        r"(?:[\x20\t\r\n\\nr]*(?:Proc-Type|DEK-Info):[^\r\n\\]*){0,8}"
        r"""(?:[A-Za-z0-9+/=\x20\t\r\n\\"',;>#*|]*-----END [A-Z ]{0,30}PRIVATE KEY-----"""
        r"|[\x20\t\r\n\\]*[A-Za-z0-9+/=]{24,}[A-Za-z0-9+/=\r\n\\]*)?",
    ),
    Rule("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z]{2,12}://[A-Za-z0-9._~-]{1,64}:[^\x00-\x20@/:]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

Query = frozenset  # of clauses, each a frozenset of trigrams
ANY: Query = frozenset([frozenset()])


def absorbed(clauses) -> Query:
    """Without clauses that contain another."""
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def both(a: Query, b: Query) -> Query:
    return absorbed({x | y for x, y in product(a, b)})


def of_strings(strings: frozenset[str]) -> Query:
    """Some of the strings occurs: all its trigrams are present."""
    return absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def analysed(node) -> tuple[frozenset[str] | None, Query]:
    """(all strings the node stands for, if few, else None; its trigram query)."""
    op, value = node
    if op is tokens.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if op is tokens.IN and all(kind is tokens.LITERAL for kind, _ in value):
        return frozenset(chr(code).lower() for _, code in value), ANY
    if op is tokens.SUBPATTERN:
        return sequence(value[-1])
    if op is tokens.BRANCH:
        parts = [sequence(part) for part in value[1]]
        if all(exact is not None for exact, _ in parts):
            return frozenset().union(*(exact for exact, _ in parts)), ANY
        needs = [query if exact is None else of_strings(exact) for exact, query in parts]
        return None, absorbed(frozenset().union(*needs))
    if op in (tokens.MAX_REPEAT, tokens.MIN_REPEAT):
        low, high, inner = value
        exact, query = sequence(inner)
        if low == 0:
            return (exact | {""} if exact is not None and high == 1 else None), ANY
        if exact is not None and len(exact) ** low <= MOST_STRINGS:
            repeated = frozenset("".join(parts) for parts in product(exact, repeat=low))
            return (repeated, ANY) if low == high else (None, of_strings(repeated))
        return None, query
    return None, ANY


def sequence(nodes) -> tuple[frozenset[str] | None, Query]:
    run, query, whole = frozenset([""]), ANY, True
    for node in nodes:
        exact, needs = analysed(node)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        query, whole = both(query, both(of_strings(run), needs)), False
        run = exact if exact is not None else frozenset([""])
    return (run, query) if whole else (None, both(query, of_strings(run)))


def trigram_query(regex: str) -> Query:
    """Clauses of trigrams; the one empty clause means that none is mandatory."""
    exact, query = sequence(parser.parse(regex))
    return query if exact is None else of_strings(exact)


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Staged postings (trigram, k1, k2) of the texts' hashes for the given trigrams."""
    # One pass over a text whatever the number of trigrams: an empty match before each of them.
    after: dict[str, list[str]] = {}
    for trigram in trigrams:
        after.setdefault(trigram[0], []).append(re.escape(trigram[1:]))
    starts = "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in after.items())
    present = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({starts}))"), F.lit(1)))
    postings = texts.select(*text_keys(F.col("text")), F.explode(present).alias("trigram"))
    return staged(postings.distinct(), "secret-postings")


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Staged (k1, k2, kinds): the indexed rules that each text has to be verified for."""
    clauses = [
        (rule.kind, number, trigram, len(clause))
        for rule in rules
        for number, clause in enumerate(sorted(map(sorted, trigram_query(rule.regex))))
        for trigram in clause
    ]
    spark = texts.sparkSession
    wanted = spark.createDataFrame(clauses, "kind string, clause int, trigram string, size int")
    postings = trigram_index(texts, sorted({clause[2] for clause in clauses}))
    met = (
        postings.join(F.broadcast(wanted), "trigram")  # one row per rule, clause and trigram
        .groupBy("k1", "k2", "kind", "clause", "size")
        .agg(F.count("*").alias("n"))
        .filter("n = size")
    )
    return staged(met.groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds")), "secret-candidates")


def with_kinds(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (with a column text) and the indexed kinds to verify."""
    found = candidates(rows.select("text"), rules)
    if found.count() <= BROADCAST_CANDIDATES:
        keyed = rows.select("*", *text_keys(F.col("text")))
        return keyed.join(F.broadcast(found), ["k1", "k2"], "left").drop("k1", "k2")
    # Only candidates are shuffled, chosen by their positions.
    placed = positioned(rows)
    keys = text_keys(F.col("row.text"))
    marks = placed.select(*POSITION, *keys).join(found, ["k1", "k2"], "left_semi")
    few = inside(placed, marks).select("row", *keys).join(found, ["k1", "k2"]).select("row.*", "kinds")
    return few.unionByName(outside(placed, marks).select("row.*"), allowMissingColumns=True)


def verified(rule: Rule, text: Column) -> Column:
    """Whether the rule's expression has to be run in full on the text, and matches."""
    matches = F.rlike(text, F.lit(rule.regex))
    if trigram_query(rule.regex) == ANY:
        return matches
    return F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & matches


def parts(rule: Rule, text: Column) -> Column:
    """Array of (gap, hit, checked): text before a match, the match, the group whose length counts."""
    regex = F.lit(rule.regex)
    return F.arrays_zip(
        F.split(text, rule.regex, -1).alias("gap"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("checked"),
    )


def secret_spans(
    documents: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row with its spans: (doc_id, found), an array of (start, rule number, kind, end)
    in order of start and rule."""
    rows = named(documents, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")

    def sizes(number: int, rule: Rule) -> Column:
        found = F.transform(
            parts(rule, text),
            lambda p: F.struct(
                F.lit(number).alias("rule"),
                F.length(p["gap"]).alias("gap"),
                F.length(p["hit"]).alias("hit"),
                F.length(p["checked"]).alias("checked"),
            ),
        )
        return F.when(verified(rule, text), found)

    hits = F.flatten(F.array_compact(F.array(*[sizes(i, rule) for i, rule in enumerate(rules)])))
    scanned = staged(
        with_kinds(rows, rules).select(F.monotonically_increasing_id().alias("row"), "doc_id", hits.alias("hits")),
        "secret-hits",
    )
    each = scanned.select("row", F.posexplode("hits").alias("place", "_")).select("row", "place", "_.*")
    before = Window.partitionBy("row", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(rule.least) for rule in rules]), F.col("rule") + 1)
    kind = F.element_at(F.array(*[F.lit(rule.kind) for rule in rules]), F.col("rule") + 1)
    spans = (
        each.withColumn("end", F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(before))
        .filter(F.col("checked") >= least)  # the part after the last match has no hit
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(F.struct((F.col("end") - F.col("hit")).alias("start"), "rule", kind.alias("kind"), "end"))
            ).alias("found")
        )
    )
    return scanned.select("row", "doc_id").join(spans, "row", "left").select("doc_id", "found")


def with_running(df: DataFrame, values: str, name: str, combine) -> DataFrame:
    """``df`` with the column ``name``: the values of an array of longs combined from the first one up to each.

    Arrays are immutable, so one grown step by step costs its length's square: it is done within
    stretches of ``STRETCH`` values, and for the stretches' totals.
    """

    def grown(array: Column) -> Column:
        def longer(out: Column, v: Column) -> Column:
            return F.concat(out, F.array(F.coalesce(combine(F.try_element_at(out, F.lit(-1)), v), v)))

        return F.aggregate(array, F.array().cast("array<long>"), longer)

    size = F.size(values)
    firsts = F.sequence(F.lit(0), F.floor((size - 1) / STRETCH).cast("int"))
    stretches = F.transform(firsts, lambda i: grown(F.slice(values, i * STRETCH + 1, STRETCH)))
    df = df.withColumn("_part", F.when(size > 0, stretches).otherwise(F.array().cast("array<array<long>>")))
    totals = grown(F.transform("_part", lambda part: F.try_element_at(part, F.lit(-1))))
    df = df.withColumn("_before", F.slice(F.concat(F.array(F.lit(None).cast("long")), totals), 1, F.size("_part")))
    whole = F.transform(
        F.arrays_zip("_part", "_before"),
        lambda z: F.transform(z["_part"], lambda v: F.coalesce(combine(z["_before"], v), v)),
    )
    return df.withColumn(name, F.flatten(whole)).drop("_part", "_before")


def stretch_of(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that is cut into blocks of ``BLOCK``."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    skip, rest = (start % BLOCK).cast("int"), (end % BLOCK).cast("int")
    at = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    within = F.substring(at(first), skip + 1, (end - start).cast("int"))
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(at(first), skip + 1, F.lit(BLOCK)), middle, F.substring(at(last), F.lit(1), rest))
    return F.when(first == last, within).otherwise(across)


def redacted(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``documents`` with every secret in its text replaced by ``PLACEHOLDER``.

    Spans are those of the original text; overlapping ones are replaced as one.
    A null text stays null.  The time is about in proportion to a text's length and
    its number of secrets.
    """
    names = documents.columns
    rows = documents.select(
        F.struct(*[documents[f"`{c}`"] for c in names]).alias("row"), documents[f"`{text_col}`"].alias("text")
    )
    text = F.col("text")

    def placed(rule: Rule) -> Column:
        """(size of gap and hit, hit, whether it is a secret) of the rule's matches.  They cover the text, so one more
        of minus its length takes a running sum back to zero."""

        def sizes(p: Column) -> Column:
            hit = F.coalesce(F.length(p["hit"]), F.lit(0))
            secret = F.coalesce(F.length(p["checked"]) >= rule.least, F.lit(False))
            return F.struct((F.length(p["gap"]) + hit).cast("long").alias("size"), hit.alias("hit"), secret.alias("secret"))

        back = F.struct((-F.length(text)).cast("long").alias("size"), F.lit(0).alias("hit"), F.lit(False).alias("secret"))
        return F.when(verified(rule, text), F.concat(F.transform(parts(rule, text), sizes), F.array(back)))

    found = F.flatten(F.array_compact(F.array(*[placed(rule) for rule in rules])))
    out = with_kinds(rows, rules).select("row", "text", found.alias("found")).withColumn("size", F.col("found.size"))
    out = with_running(out, "size", "end", lambda a, b: a + b)
    spans = F.transform(
        F.filter(F.arrays_zip("found", "end"), lambda z: z["found"]["secret"]),
        lambda z: F.struct((z["end"] - z["found"]["hit"]).alias("start"), z["end"].alias("end")),
    )
    out = out.select("row", "text", F.array_sort(spans).alias("spans")).withColumn("end", F.col("spans.end"))
    # Null before the first.
    out = with_running(out, "end", "reached", lambda a, b: F.greatest(a, b) + a * 0)
    starts = F.slice(F.concat(F.array(F.lit(0).cast("long")), "reached"), 1, F.size("spans"))
    heads = F.filter(F.arrays_zip(F.col("spans").alias("span"), starts.alias("at")), lambda z: z["span"]["start"] >= z["at"])
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    out = out.select(
        "row", "text", "reached", F.when(F.size("spans") > 0, heads).alias("heads"), F.when(F.size("spans") > 0, blocks).alias("blocks"),
    )
    block = F.col("blocks")
    pieces = F.transform("heads", lambda z: F.concat(stretch_of(block, z["at"], z["span"]["start"]), F.lit(PLACEHOLDER)))
    rest = stretch_of(block, F.try_element_at("reached", F.lit(-1)), F.length("text").cast("long"))
    covered = F.when(F.col("heads").isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return out.select(*[covered.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their secrets' spans."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    spans = F.coalesce("found", F.array().cast("array<struct<start: long, rule: int, kind: string, end: long>>"))
    base = F.filter(spans, lambda s: s["rule"] < len(BASE_RULES))

    def listed(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(rule.kind) for rule in BASE_RULES],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def oracle_sql() -> str:
    """Every rule in full over every text, in DuckDB SQL (RE2 knows the same syntax)."""
    quoted = [(rule, rule.regex.replace("'", "''")) for rule in RULES]
    scans = " UNION ALL ".join(
        f"SELECT r, {i} AS rule, '{rule.kind}' AS kind, {rule.least} AS least,"
        f" regexp_split_to_array(text, '{regex}') AS gap, regexp_extract_all(text, '{regex}', 0) AS hit,"
        f" regexp_extract_all(text, '{regex}', {rule.group}) AS checked FROM doc WHERE regexp_matches(text, '{regex}')"
        for i, (rule, regex) in enumerate(quoted)
    )
    counts = ", ".join(
        f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE_RULES
    )
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
scan AS ({scans}),
each AS (
  SELECT r, rule, kind, least, i, length(gap[i]) AS gap, length(hit[i]) AS hit, length(checked[i]) AS checked
  FROM (SELECT *, unnest(generate_series(1, len(hit))) AS i FROM scan)),
placed AS (SELECT *, sum(gap + hit) OVER (PARTITION BY r, rule ORDER BY i) AS stop FROM each),
span AS (
  SELECT r, rule, kind, stop - hit AS start, kind || ':' || CAST(stop - hit AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said
  FROM placed WHERE checked >= least),
found AS (
  SELECT r, {counts}, string_agg(said, ',' ORDER BY start, rule) FILTER (rule < {len(BASE_RULES)}) AS base,
         string_agg(said, ',' ORDER BY start, rule) AS spans
  FROM span GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN found USING (r)
"""


OP5_SQL = oracle_sql()
