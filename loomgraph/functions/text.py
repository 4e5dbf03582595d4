"""Text functions over titles, wikitext and HTML, as column expressions.

The one exception is template stripping, whose nesting no regular expression follows; it is an Arrow function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that define the results: category prefixes and parts of upkeep, headings, template names.
MAINTENANCE_PREFIXES = (
    "Articles ", "All articles", "Wikipedia ", "CS1 ", "Webarchive", "Pages ", "All pages", "Use dmy dates", "Use mdy dates", "Short description", "Commons category",
    "Coordinates ", "Official website", "Good articles", "Featured articles", "Redirects ", "All redirects", "Template ", "Interlanguage ", "Harv and Sfn", "AC with ", "Vague or ambiguous",
)
MAINTENANCE_PARTS = ("maint:", "errors", "stub", "with unsourced", "needing", "lacking", "from ", "dead external links", "unreferenced", "cleanup")
CITATION_HEADINGS = ("references", "external links", "further reading", "notes", "bibliography", "sources", "citations", "footnotes")
DISAMBIGUATION_TEMPLATES = ("disambiguation", "disambig", "disamb", "dab", "dmbox", "hndis", "geodis")
FEATURED_TEMPLATES, GOOD_TEMPLATES = ("featured article", "featured list"), ("good article", "ga icon")
VACUOUS_PARTS = ("of birth missing", "of death missing", "of birth unknown", "of death unknown", "of birth uncertain", "of death uncertain")
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def _let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return _sub(c, r"(?U)^\s+|\s+$", "")


def ucfirst(c: Column) -> Column:
    """First letter to upper case where that is one letter."""
    h = F.substring(c, 1, 1)
    return F.when(h.rlike(r"^\p{javaLowerCase}") & (F.length(F.upper(h)) == 1), F.concat(F.upper(h), F.substring(c, 2, 2147483647))).otherwise(c)


def normalize_title(c: Column) -> Column:
    """Canonical title of a link target: no leading colons, no fragment, blanks for underscores, first letter raised; null if empty."""
    x = strip(c)
    x = _sub(x, r"(?U)^(?::\s*)+", "")
    x = strip(_sub(x, r"(?s)#.*\z", ""))
    x = _sub(_sub(x, r"(?U)[\s_]+", " "), r"^ | $", "")
    return F.when(x != "", ucfirst(x))


def normalize_dump_title(c: Column) -> Column:
    """Titles of page-view dumps: blanks for underscores, trimmed, first letter raised."""
    return ucfirst(F.trim(F.translate(c, "_", " ")))


def prefix_of(c: Column) -> Column:
    """What stands before the first colon, trimmed, lower case; null without a colon."""
    return F.when(F.instr(c, ":") > 0, F.lower(strip(F.substring_index(c, ":", 1))))


def is_foreign(c: Column, namespaces: list[str]) -> Column:
    """Whether a raw target names another namespace. A leading colon means an empty prefix, which is not foreign."""
    names = sorted({n.lower() for n in namespaces} | {n.lower().replace(" ", "_") for n in namespaces})
    return F.coalesce(prefix_of(c).isin(names), F.lit(False))


def category_name(c: Column) -> Column:
    """The category that a raw target names, or null."""
    rest = F.substring_index(F.substring(c, F.instr(c, ":") + 1, F.length(c)), "|", 1)
    return F.when(prefix_of(c) == "category", normalize_title(rest))


def is_maintenance(c: Column) -> Column:
    """Whether a category only serves upkeep: case-sensitive prefixes or lower-case parts."""
    starts = F.lit(False)
    for p in MAINTENANCE_PREFIXES:
        starts = starts | F.startswith(c, F.lit(p))
    low = F.lower(c)
    for p in MAINTENANCE_PARTS:
        starts = starts | F.contains(low, F.lit(p))
    return starts


def strip_comments(c: Column) -> Column:
    return _sub(c, r"(?s)<!--.*?(?:-->|\z)", "")


def strip_element(c: Column, tag: str) -> Column:
    """Without elements of that name, self-closing ones too; one left open takes the rest."""
    return _sub(c, r"(?is)<" + tag + r"(?=[ \t\n\f\r>/])(?:[^>]*/[ \t\n\f\r]*>|[^>]*>.*?</" + tag + r"[^>]*>|.*\z)", "")


def cut_citations(c: Column) -> Column:
    """Up to the first citation heading of level two or more."""
    return _sub(c, r"(?mids)^[ \t]*={2,}[ \t]*(?:" + "|".join(CITATION_HEADINGS) + r")[ \t]*={2,}[ \t]*$.*", "")


def _without_templates(s: pd.Series) -> pd.Series:

    def one(t: str | None) -> str | None:
        if t is None or "{{" not in t:
            return t
        out, depth, at = [], 0, 0
        while at < len(t):
            two = t[at : at + 2]
            if two == "{{":
                depth, at = depth + 1, at + 2
            elif two == "}}" and depth:
                depth, at = depth - 1, at + 2
            else:
                if not depth:
                    out.append(t[at])
                at += 1
        return "".join(out)

    return s.map(one, na_action="ignore")


def strip_templates(c: Column) -> Column:
    """Without nested {{...}}; tables {|...|} stay; an unclosed opening takes the rest."""
    return F.pandas_udf(_without_templates, StringType())(c)


def clean(c: Column, references: bool = True, templates: bool = False, citations: bool = True) -> Column:
    """Wikitext for link extraction: comments, nowiki, then by option references, templates, citation sections go."""
    x = strip_element(strip_comments(c), "nowiki")
    x = strip_element(x, "ref") if references else x
    x = strip_templates(x) if templates else x
    return cut_citations(x) if citations else x


def links(c: Column) -> Column:
    """Targets of [[target|label]] in order; an inner [[ restarts, an unclosed link ends there, empty targets go."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)(?:\[\[)++((?:(?!\[\[|\]\]).)*+)\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda v: F.substring_index(v, "|", 1)), lambda v: v != "")


def hrefs(c: Column) -> Column:
    """Targets of anchors in HTML, in order."""
    return F.regexp_extract_all(c, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def template_names(c: Column) -> Column:
    """Names of templates, lower case, of 1 to 64 bytes, nested ones too."""
    found = F.regexp_extract_all(c, F.lit(r"\{\{(?=([^|}]*+)[|}])"), F.lit(1))
    return F.filter(F.transform(F.filter(found, lambda v: F.octet_length(v).between(1, 64)), lambda v: F.lower(strip(v))), lambda v: v != "")


def cut_bytes(c: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes that ends at a character."""
    n = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: F.octet_length(F.substring(c, F.lit(1), i)) <= most))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substring(c, F.lit(1), n))


def short_description(c: Column) -> Column:
    """The first short description that isn't "none", of at most 160 bytes."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)\{\{\s*(?:short description|shortdesc|short desc)\s*\|([^|}]*)"), F.lit(1))
    ok = F.filter(F.transform(found, strip), lambda v: (v != "") & (F.lower(v) != "none"))
    return cut_bytes(F.get(ok, F.lit(0)), 160)


def infobox_kind(c: Column) -> Column:
    """What follows "infobox" in the first such template's name, at most 40 bytes; null if nothing does."""
    names = F.filter(F.transform(F.filter(template_names(c), lambda v: F.startswith(v, F.lit("infobox"))), lambda v: strip(F.substring(v, 8, 100))), lambda v: v != "")
    return cut_bytes(F.get(names, F.lit(0)), 40)


def flags(text: Column, title: Column) -> Column:
    """1 disambiguation, 2 featured, 4 good."""
    names = template_names(text)
    dis = F.endswith(title, F.lit(" (disambiguation)")) | F.exists(names, lambda v: v.isin(list(DISAMBIGUATION_TEMPLATES)) | F.endswith(v, F.lit("disambiguation")))
    return F.when(dis, 1).otherwise(0) + F.when(F.arrays_overlap(names, F.array(*map(F.lit, FEATURED_TEMPLATES))), 2).otherwise(0) + F.when(F.arrays_overlap(names, F.array(*map(F.lit, GOOD_TEMPLATES))), 4).otherwise(0)


def coordinates(c: Column) -> Column:
    """(lat, lon) of the coordinates template: decimal, or degrees, minutes, seconds with a letter; one shown with the
    title wins over earlier ones; out of range is null."""
    body = F.regexp_extract_all(c, F.lit(r"(?is)\{\{\s*(?:coord|coor)\s*\|([^{}]*)\}\}"), F.lit(1))

    def parse(b: Column) -> Column:
        plain = F.transform(F.split(b, r"\|"), strip)
        args = F.filter(plain, lambda v: ~F.contains(v, F.lit("=")))
        ns = F.array_position(F.transform(args, lambda v: F.upper(v).isin("N", "S")), F.lit(True)).cast("int")
        ew = F.array_position(F.transform(args, lambda v: F.upper(v).isin("E", "W")), F.lit(True)).cast("int")

        def degrees(parts: Column, minus: Column) -> Column:
            n = F.transform(parts, lambda v: F.expr("1") * F.try_to_number(v, F.lit("S99999999.99999999")).cast("double"))
            worth = F.get(n, F.lit(0)) + F.coalesce(F.get(n, F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get(n, F.lit(2)), F.lit(0.0)) / 3600
            return F.when((F.size(parts) >= 1) & (F.size(parts) <= 3), F.when(minus, -worth).otherwise(worth))

        dms = (ns > 1) & (ew > ns + 1)
        lat = F.when(dms, degrees(F.slice(args, 1, F.greatest(ns - 1, F.lit(0))), F.upper(F.get(args, ns - 1)) == "S")).otherwise(_number(F.get(args, F.lit(0))))
        lon = F.when(dms, degrees(F.slice(args, ns + 1, F.greatest(ew - ns - 1, F.lit(0))), F.upper(F.get(args, ew - 1)) == "W")).otherwise(_number(F.get(args, F.lit(1))))
        ok = lat.between(-90, 90) & lon.between(-180, 180)
        shown = F.exists(plain, lambda v: F.replace(F.lower(v), F.lit(" "), F.lit("")).rlike(r"^display=.*\bt(itle)?\b"))
        return F.when(ok, F.struct(lat.cast("float").alias("lat"), lon.cast("float").alias("lon"), shown.alias("shown")))

    found = F.filter(F.transform(body, parse), lambda v: v.isNotNull())
    best = F.coalesce(F.get(F.filter(found, lambda v: v["shown"]), F.lit(0)), F.get(found, F.lit(0)))
    return F.when(best.isNotNull(), F.struct(best["lat"].alias("lat"), best["lon"].alias("lon")))


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), c.cast("double"))


def decode_entities(c: Column) -> Column:
    """Predefined entities; others stay. The ampersand comes last, so nothing is decoded twice."""
    for name, sign in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return c


def _reference(name: Column) -> Column:
    """The character of a reference without & and ;, null if it is unknown."""
    digits = F.when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, 2, 7))
    n = digits.cast("int")
    valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    found = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    for word, sign in ENTITIES.items():
        found = F.when(name == word, F.lit(sign)).otherwise(found)
    return found


def decode_references(c: Column) -> Column:
    """struct(text, unresolved): predefined, decimal and hexadecimal references decoded once; others stay and count."""
    parts = F.split(c, "(?=&)")
    name = lambda x: F.regexp_extract(x, "^&([^&;]{1,32});", 1)
    said = F.transform(parts, lambda x: F.when(name(x) == "", x).otherwise(F.coalesce(F.concat(_reference(name(x)), F.substring(x, F.length(name(x)) + 3, F.length(x))), x)))
    lost = F.filter(parts, lambda x: (name(x) != "") & _reference(name(x)).isNull())
    return F.struct(F.concat_ws("", said).alias("text"), F.size(lost).alias("unresolved"))


def search_score(lower: Column, q: str, degree: Column) -> Column:
    """2^60 if equal, else (degree + 1) x 100 for a prefix, 30 for a word's prefix, 1 for a part; null otherwise."""
    words = F.exists(F.split(lower, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.startswith(w, F.lit(q)))
    d = degree.cast("bigint") + 1
    return F.when(lower == q, F.lit(1 << 60)).when(F.startswith(lower, F.lit(q)), d * 100).when(words, d * 30).when(F.contains(lower, F.lit(q)), d)


def is_vacuous(c: Column) -> Column:
    """Region names that say nothing: living people, missing dates, deaths by year, births and deaths of a year."""

    def says(x: Column) -> Column:
        low = F.lower(x)
        found = low.isin("living people", "possibly living people") | F.endswith(low, F.lit("(living people)"))
        found = found | low.rlike("|".join(VACUOUS_PARTS)) | low.rlike(r"^(?:(?!deaths in ).)*deaths in [0-9]")
        return found | (low.rlike(r" (births|deaths)$") & x.rlike("^[0-9]{3}"))

    return _let(strip(c), says)


def clean_label(c: Column) -> Column:
    """A label without a last bracket that says nothing; null if nothing is left."""
    inside = lambda x: F.regexp_extract(x, r"(?s)\(([^(]*)\)$", 1)
    short = _let(strip(c), lambda x: F.when(F.endswith(x, F.lit(")")) & is_vacuous(inside(x)), strip(_sub(x, r"(?s)\([^(]*\)$", ""))).otherwise(x))
    return _let(short, lambda x: F.when((x != "") & ~is_vacuous(x), x))


def nickname(c: Column) -> Column:
    """Without control characters, 20 characters at most, trimmed; "anonymous" if empty."""
    x = F.trim(F.left(F.trim(_sub(c, r"\p{Cntrl}", "")), F.lit(20)))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("anonymous"))


def board_key(number: Column, difficulty: Column) -> Column:
    """v2:daily:number:difficulty, or v2:free:difficulty without a number."""
    return F.when(number.isNotNull(), F.concat_ws(":", F.lit("v2:daily"), number.cast("string"), difficulty)).otherwise(F.concat(F.lit("v2:free:"), difficulty))


def verdict(clicks: Column, par: Column) -> Column:
    over = clicks - par
    return F.when(over <= 0, "par").when(over == 1, "bogey").when(over == 2, "double bogey").otherwise(F.concat(F.lit("+"), over.cast("string")))


def compass_charges(par: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(4), par - 2))


def least_ms(clicks: Column) -> Column:
    """The least time that a run of so many clicks can take."""
    return F.lit(400) + F.lit(250) * clicks


def day_number(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


def rounded_day(ts: Column) -> Column:
    """The day number of a time taken to its nearest second, halves to the even one; so the last half second of a day
    is the next day's. Seconds are divided towards 1970, so the day before it has number 0."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts)
    whole = day_number(ts).cast("bigint") * 86400 + F.bround(second, 0).cast("bigint")
    return F.call_function("div", whole, F.lit(86400).cast("bigint"))


def delta_encode(ids: Column) -> Column:
    """Ascending ids as differences to the one before, the first as it is."""
    s = F.sort_array(ids)
    return F.transform(s, lambda x, i: x - F.coalesce(F.get(s, i - 1), F.lit(0)))


def delta_decode(deltas: Column) -> Column:
    return F.aggregate(deltas, F.array().cast("array<bigint>"), lambda a, d: F.concat(a, F.array(d + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))


def race_link(start: Column, goal: Column, difficulty: Column, ban: Column, dataset: Column) -> Column:
    """Query string of a race between two titles; parts are URL-encoded, no ban is "none"."""
    e = lambda c: F.url_encode(c.cast("string"))
    return F.concat(F.lit("?dataset="), e(dataset), F.lit("&from="), e(start), F.lit("&to="), e(goal), F.lit("&difficulty="), e(F.coalesce(difficulty, F.lit("custom"))), F.lit("&ban="), e(F.coalesce(ban.cast("string"), F.lit("none"))))


def parse_race_link(c: Column, dataset: str) -> Column:
    """(mode, from, to, number, holes, difficulty, ban) of a link; null if malformed or of another dataset."""
    part = lambda k: F.url_decode(F.nullif(F.regexp_extract(c, rf"[?&]{k}=([^&#]*)", 1), F.lit("")))
    number = lambda k: F.when(part(k).rlike("^[1-9][0-9]{0,14}$"), part(k).cast("bigint"))
    has = lambda k: part(k).isNotNull()
    difficulty = F.coalesce(part("difficulty"), F.lit("medium"))
    holes = F.when(has("holes"), number("holes")).otherwise(3)
    none = F.lit(None)

    def out(mode: str, a=none, b=none, n=none, h=none, ban=none) -> Column:
        return F.struct(F.lit(mode).alias("mode"), a.cast("string").alias("start"), b.cast("string").alias("goal"), n.cast("bigint").alias("number"), h.cast("bigint").alias("holes"), difficulty.alias("difficulty"), ban.cast("string").alias("ban"))

    foreign = has("dataset") & (part("dataset") != dataset)
    bad_ban = has("ban") & ~part("ban").rlike("^(none|[0-9]{1,15})$")
    return (
        F.when(foreign, none)
        .when(has("round"), F.when(number("round").isNotNull() & holes.isin(3, 9), out("round", n=number("round"), h=holes)))
        .when(has("daily"), F.when(number("daily").isNotNull() & difficulty.isin("easy", "medium", "hard"), out("daily", n=number("daily"))))
        .when(has("from") | has("to"), F.when(has("from") & has("to") & ~bad_ban, out("pair", part("from"), part("to"), ban=part("ban"))))
        .otherwise(out("daily"))
    )
