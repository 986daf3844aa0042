"""Text as Column expressions: tokens, similarity, handles, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of labels of options, of descriptions compared by words, of fork labels, and of spans.
STOP = tuple("the a an of to in on for with and or as at by from is are was were be this that it its into per than then so such which each every all run runs analysis model data set".split())
WORD_STOP = tuple("a an the of to in on for by with and or at as is are be into from that this these those it its use used using which what how do does done than then when where each per via over under between within not no if".split())
FORK_STOP = tuple("how is are the a an of to into for from in on at by with and or what which used use does do this that it its as been was were if then than when where who whom whose there their they them".split())
SPAN_STOP = tuple("a an the and or of to in on for with from by as is are be was were this that these those it its at into over under then than so if when which what how use using apply applied set sets compute computed calculate calculated data value values column columns row rows".split())


def tokens(text: Column, stop: tuple[str, ...] = STOP, longest_dropped: int = 2) -> Column:
    """Distinct lower-case letter runs, without stop words and words of `longest_dropped` letters or fewer."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)")))
    return F.filter(found, lambda t: (F.length(t) > longest_dropped) & ~t.isin(*stop))


def words(text: Column, stop: tuple[str, ...] = WORD_STOP) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9.]+)"))), lambda t: ~t.isin(*stop))


def grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text with white space made single."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.length(t) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """The larger of the overlaps of words and of character 3-grams."""
    return F.greatest(jaccard(words(a), words(b)), jaccard(grams(a), grams(b)))


#: Spellings of one target that differ by these are one.
PREFIXES = ("df", "data", "the")
SUFFIXES = ("avg", "mean", "cat", "bin", "std", "log", "col", "var", "idx")


def norm_target(name: Column) -> Column:
    """A variable's name without marks and case, then without these prefixes and suffixes where three letters or more are left; `unknown`
    if nothing is left."""
    out = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    for p in PREFIXES:
        out = F.regexp_replace(out, f"^{p}(?=.{{3}})", "")
    for s in SUFFIXES:
        out = F.regexp_replace(out, f"^(.{{3,}}){s}$", "$1")
    return F.when(out == "", "unknown").otherwise(out)


def tag_norm(tag: Column) -> Column:
    """A rationale tag in lower case, with letters, digits and spaces only."""
    return F.trim(F.regexp_replace(F.lower(tag), "[^a-z0-9 ]", ""))


def fork_handle(fork: Column) -> Column:
    return F.concat(F.lit("fork:"), F.substring(F.sha1(fork.cast("binary")), 1, 8))


def option_handle(fork: Column, option: Column) -> Column:
    return F.concat(F.lit("option:"), F.substring(F.sha1(F.concat(fork, F.lit("|"), option).cast("binary")), 1, 8))


#: Fixed patterns: what negates an action, joins clauses, lists choices or concedes agreement; comparison words and descriptive contexts.
NEGATION = r"\b(?:do|does|did|is|are|was|were|has|have|had|can|could|would|should)\s+not\b|\bnot\s+(?:be|been|being|applied|used|performed|adjusted|clustered)\b|\bnever\b|\bwithout\s+\w+ing\b|n't\b"
CLAUSE = r"(\b(?:and|then|while|after|before)\b|[,;]|\bwith\b)"
DISJUNCTION = r"\s/\s|\bor\b|\([^)]*/[^)]*\)"
CONCESSION = r"(?<!in)\bconsistent\b|\baligned?\b|\bmatch(?:es|ing)?\b|\bthe same\b|\bno (?:material )?(?:difference|discrepancy|disagreement)\b|\bagree(?:s|ment)?\b"
COMPARISON = r"(>=|<=|>|<|=|at|above|below|cutoff|cut-off|threshold|thresholded)\s*(\d+(?:\.\d+)?)"
DESCRIPTIVE = r"(?i)\b(?:95|99|90)\s*%|\b1\.96\b|\bp\s*<\s*0?\.0\d\b|\balpha\b|\bn\s*=\s*\d|\bsample size\b|\bcount(?:s)? of\b"


def negated(text: Column) -> Column:
    """Whether the text negates its own action; leaving something out is an action."""
    return F.lower(text).rlike(NEGATION)


def clauses(text: Column) -> Column:
    """One more than the number of places at which a label goes on; three or more make it compound."""
    return F.regexp_count(text, F.lit(CLAUSE)) + 1


def disjunctive(text: Column) -> Column:
    """Whether a label lists several choices."""
    return text.rlike(DISJUNCTION)


def concedes(note: Column) -> Column:
    """Whether a note on a disagreement says that the two agree."""
    return F.lower(note).rlike(CONCESSION)


def thresholds(text: Column) -> Column:
    """Sorted distinct cut-offs: numbers behind a comparison, unless the 24 characters before to the 8 behind describe (confidence levels,
    sample sizes, counts). On whole numbers `> v` is v + 1 and `< v` is v - 1."""
    ahead = COMPARISON.replace("(>=", "(?:>=").replace(r"(\d", r"(?:\d")  # looked for first, since the text before is costly to find at every place
    pattern = F.lit(rf"(?i)(?={ahead})(?<=((?s:^.{{0,24}}|.{{24}}))){COMPARISON}(?=((?s:.{{0,8}})))")
    part = lambda i: F.regexp_extract_all(text, pattern, F.lit(i))
    found = F.arrays_zip(part(1).alias("before"), part(0).alias("own"), part(2).alias("op"), part(3).alias("number"), part(4).alias("behind"))
    chosen = F.filter(found, lambda m: ~F.concat(m["before"], m["own"], m["behind"]).rlike(DESCRIPTIVE))

    def value(m: Column) -> Column:
        v = m["number"].cast("double")
        whole = v == F.floor(v)
        return F.when(whole & (m["op"] == ">"), v + 1).when(whole & (m["op"] == "<"), v - 1).otherwise(v)

    return F.array_sort(F.array_distinct(F.transform(chosen, value)))


def idf(n: Column, df: Column, kind: str) -> Column:
    """A word's weight among n items of which df have it: binary, ln(n/df), ln(1 + n/df) or 1/df."""
    return {"binary": F.lit(1.0), "idf": F.ln(n / df), "smooth": F.ln(1 + n / df), "inverse": 1 / df}[kind]


def clipped(text: Column, width: int) -> Column:
    """The text, or as many whole words of it as fit, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, width), r"\s+\S*$", "")
    return F.when(F.length(text) <= width, text).otherwise(F.concat(cut, F.lit("…")))


def answers(sheet: Column) -> Column:
    """Number -> answer of a sheet whose lines read `12. answer: same` (or with a bold number)."""
    numbers = F.regexp_extract_all(sheet, F.lit(r"(?m)^\**(\d+)[.)]\**\s*answer:\s*(\w+)"), F.lit(1))
    return F.map_from_arrays(numbers, F.regexp_extract_all(sheet, F.lit(r"(?m)^\**(\d+)[.)]\**\s*answer:\s*(\w+)"), F.lit(2)))


def has_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object's text has all keys, none of them null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.get_json_object(json, f"$.{k}").isNotNull()
    return F.coalesce(out, F.lit(False))


def json_value(reply: Column) -> Column:
    """The text of the first whole JSON object or array of a reply, which may stand in a fence, behind prose, or before anything else; null
    without one, and where it is cut off. An automaton over the characters counts brackets and knows strings and escapes, so brackets in
    strings and behind the value don't count. Whether the value is well-formed, json_fault() says."""
    return _found(reply)["value"]


def json_fault(reply: Column) -> Column:
    """What is wrong with a reply: `no JSON`, `cut off` (it ends within the value), `malformed`; null if json_value() is fine."""
    found = _found(reply)
    return F.when(~found["some"], "no JSON").when(found["value"].isNull(), "cut off").when(F.try_parse_json(found["value"]).isNull(), "malformed")


def _found(reply: Column) -> Column:
    """Of a reply: whether it has a bracket at all, and the first JSON value. Lengths are code points."""
    t = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+", "")
    inside = F.regexp_replace(F.element_at(F.split(t, "```"), 2), r"(?i)^\s*json", "")
    t = F.when(t.startswith("```"), inside).otherwise(t)
    rest = F.regexp_replace(t, r"^[^{\[]+", "")
    state = lambda depth, quoted, escaped, at, end: F.struct(depth.cast("int").alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), at.cast("int").alias("at"), end.cast("int").alias("end"))
    no = F.lit(False)

    def step(s: Column, c: Column) -> Column:
        opens, closes = c.isin("{", "["), c.isin("}", "]")
        depth = F.when(s["quoted"], s["depth"]).when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"])
        quoted = F.when(s["quoted"], s["escaped"] | (c != '"')).otherwise(c == '"')
        escaped = s["quoted"] & ~s["escaped"] & (c == "\\")
        end = F.when(~s["quoted"] & closes & (s["depth"] == 1), s["at"] + 1).otherwise(F.lit(0))
        return F.when(s["end"] > 0, s).otherwise(state(depth, quoted, escaped, s["at"] + 1, end))

    last = F.aggregate(F.split(rest, ""), state(F.lit(0), no, no, F.lit(0), F.lit(0)), step)
    found = F.array(F.struct(last["end"].alias("end"), rest.alias("rest")))
    return F.transform(found, lambda x: F.struct((F.length(x["rest"]) > 0).alias("some"), F.when(x["end"] > 0, F.substring(x["rest"], F.lit(1), x["end"])).alias("value")))[0]


def front_matter(sheet: Column) -> Column:
    """The `key: value` lines between a sheet's first line `---` and the next one, as a map; an empty map without them. Of a key that comes
    twice the last counts."""
    block = F.regexp_extract(F.coalesce(sheet, F.lit("")), r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n?---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*[^:#\s][^:]*:")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^([\x22\x27])(.*)\1$", "$2").alias("value")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["key"]), F.create_map(x["key"], x["value"])))


def without_front_matter(sheet: Column) -> Column:
    return F.regexp_replace(sheet, r"\A---[ \t]*\r?\n[\s\S]*?---[ \t]*(?:\r?\n|\z)", "")
