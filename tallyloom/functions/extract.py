"""Field extraction from résumé and page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.dictionaries import COMPANY_MARKS, DROPPED_TAGS, EXPERIENCE_LEVELS, RAW_TAGS, RELEVANCE_TERMS, SECTION_HEADERS
from tallyloom.functions.text import any_of, bound, char_prefix, collapse, count_of, strip

EMAIL = "[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+"
PHONE = "\\+?[0-9][0-9 \\t\\n\\r\\f\\x0B\\-().]{7,}[0-9]"
DATE = "\\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\.?[ \\t\\n\\r\\f\\x0B]+[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}"
YEAR = "[12][0-9]{3}"
EXPERIENCE_SECTION = "(?is)(?:EXPERIENCE|WORK EXPERIENCE)[:\\s]*\\n(.*?)(?=\\n\\s*(?:EDUCATION|SKILLS|CERTIFICATIONS|PROJECTS|$))"
JOB = "(?im)^([A-Za-z\\s]+?)\\n([A-Za-z0-9\\s,.&\\-]+?)\\n([^\\n]*?[12][0-9]{3}[^\\n]*)"


def email(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, EMAIL, 0), F.lit(""))


def phone(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, PHONE, 0), F.lit(""))


def dates(x: Column, most: int = 10) -> Column:
    """Distinct date mentions in sorted order (the order is ours), the first ``most``."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(DATE), 0))), 1, most)


def year_range(x: Column, as_of_year: int) -> Column:
    """struct(duration_years, start_year, end_year) of a date range; an open range ends in ``as_of_year``."""
    years = F.transform(F.regexp_extract_all(x, F.lit(YEAR), 0), lambda y: y.cast("int"))
    first, last = F.array_min(years), F.array_max(years)
    is_open = (F.size(years) == 1) & F.lower(x).rlike("present|current")
    none = F.lit(None).cast("int")
    return (
        F.when(F.size(years) >= 2, F.struct((last - first).alias("duration_years"), first.alias("start_year"), last.alias("end_year")))
        .when(is_open, F.struct((F.lit(as_of_year) - first).alias("duration_years"), first.alias("start_year"), F.lit(as_of_year).alias("end_year")))
        .otherwise(F.struct(F.lit(0).alias("duration_years"), none.alias("start_year"), none.alias("end_year")))
    )


def entities(x: Column) -> Column:
    """struct(names, organizations, dates, locations); only dates are ever found."""
    none = F.array().cast("array<string>")
    return F.struct(none.alias("names"), none.alias("organizations"), dates(x).alias("dates"), none.alias("locations"))


def section_of(line: Column) -> Column:
    """The section that a line heads, or null."""
    upper = strip(F.upper(line))
    out = None
    for name, heads in SECTION_HEADERS.items():
        hit = upper.rlike("|".join(heads))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


_EVERY_HEAD = [p for heads in SECTION_HEADERS.values() for p in heads]
#: Those that hold no other one: a line that has any of all has one of these.
_HEADS = "|".join(p for p in _EVERY_HEAD if not any(q in p for q in _EVERY_HEAD if q != p)).replace("\\s", "[^\\S\\n]")
#: The start of a line that heads a section.
HEADER_LINE = f"(?imd)^(?=[^\\n]*?(?:{_HEADS}))"
#: Letters whose upper case holds ASCII letters; texts with these are looked at line by line.
ODD_CASE = "[\u0131\u017f\u0149\u01f0\u1e96-\u1e9a\ufb00-\ufb06\x01]"
_CUT = "\x01"


def sections(x: Column) -> Column:
    """map(section, text): header lines drop out, other non-blank lines go to the section above, at first ``other``.

    The text is cut before its header lines by one pattern, and only those
    lines are asked which section they head.
    """
    parts = F.split(F.regexp_replace(x, HEADER_LINE, _CUT), _CUT)
    fast = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, "other").otherwise(section_of(F.substring_index(p, "\n", 1))).alias("head"), _full_lines(F.when(i == 0, p).otherwise(F.regexp_replace(p, "^[^\n]*\n?", ""))).alias("text")))
    return F.when(x.isNotNull(), bound(F.when(x.rlike(ODD_CASE), _parts_by_line(x)).otherwise(fast), _together))


def _full_lines(x: Column) -> Column:
    """Lines that are not blank, each with its end."""
    return F.regexp_replace(F.concat(x, F.lit("\n")), "(?:^|(?<=\n))[ \t\r\f\x0B]*\n", "")


def _together(parts: Column) -> Column:
    names = [*SECTION_HEADERS, "other"]
    each = [F.array_join(F.transform(F.filter(parts, lambda p: p["head"] == n), lambda p: p["text"]), "") for n in names]
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*each))


def _parts_by_line(x: Column) -> Column:
    """array(struct(head, text)), every line asked; the work is linear in the number of lines."""
    lines = F.transform(F.split(x, "\n"), lambda s: F.struct(section_of(s).alias("head"), (strip(s) != "").alias("full"), F.concat(s, F.lit("\n")).alias("line")))

    def headers(all_lines: Column) -> Column:
        found = F.filter(F.transform(all_lines, lambda e, i: F.struct(i.alias("at"), e["head"].alias("head"))), lambda h: h["head"].isNotNull())
        return F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("other").alias("head"))), found)

    def body(all_lines: Column, heads: Column, h: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1)["at"], F.size(all_lines))
        own = F.filter(F.slice(all_lines, h["at"] + 2, end - h["at"] - 1), lambda e: e["full"])
        return F.struct(h["head"].alias("head"), F.array_join(F.transform(own, lambda e: e["line"]), "").alias("text"))

    return bound(lines, lambda all_lines: bound(headers(all_lines), lambda heads: F.transform(heads, lambda h, k: body(all_lines, heads, h, k))))


def primary_focus(x: Column) -> Column:
    """The first two bullet lines, else the first two longer lines, of a job's context."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != "")
    bullets = F.filter(lines, lambda s: s.rlike("^[-•*]"))
    chosen = F.when(F.size(bullets) > 0, bullets).otherwise(F.filter(lines, lambda s: F.length(s) > 10))
    joined = F.regexp_replace(F.array_join(F.slice(chosen, 1, 2), " "), "^[-•*]\\s*", "")
    return F.when(F.size(chosen) > 0, char_prefix(joined, 150)).otherwise("Not specified")


def job_experiences(x: Column, as_of_year: int) -> Column:
    """array(struct(title, company, date_range, duration_years, start_year, end_year, primary_focus)) of a résumé with lines."""
    section = F.regexp_extract(x, EXPERIENCE_SECTION, 1)
    heads = F.regexp_extract_all(section, F.lit(JOB), 0)
    # What follows each head: the section behind its end, found from the end of the one before.
    spans = F.aggregate(
        heads,
        F.struct(section.alias("rest"), F.array().cast("array<struct<head:string,context:string>>").alias("jobs")),
        lambda s, h: F.struct(
            _behind(s["rest"], h).alias("rest"),
            F.concat(s["jobs"], F.array(F.struct(h.alias("head"), char_prefix(_behind(s["rest"], h), 400).alias("context")))).alias("jobs"),
        ),
    )["jobs"]
    jobs = F.transform(spans, lambda s: _job(s, as_of_year))
    marks = "|".join(COMPANY_MARKS)
    return F.filter(jobs, lambda j: (F.length(j["title"]) >= 3) & ~F.lower(j["title"]).rlike(marks) & (j["duration_years"] > 0))


def _behind(x: Column, part: Column) -> Column:
    return F.substr(x, F.position(part, x) + F.length(part))


def _job(span: Column, as_of_year: int) -> Column:
    def group(n: int) -> Column:
        return strip(F.regexp_extract(span["head"], JOB, n))

    years = year_range(group(3), as_of_year)
    return F.struct(
        group(1).alias("title"),
        group(2).alias("company"),
        group(3).alias("date_range"),
        years["duration_years"].alias("duration_years"),
        years["start_year"].alias("start_year"),
        years["end_year"].alias("end_year"),
        primary_focus(span["context"]).alias("primary_focus"),
    )


def experience_level(years: Column) -> Column:
    out = None
    for name, low, high in EXPERIENCE_LEVELS:
        hit = (years >= low) & (years < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


def total_experience(jobs: Column) -> Column:
    """struct(years, level): last end less first start over the jobs, gaps and overlaps ignored."""
    first = F.array_min(F.transform(jobs, lambda j: j["start_year"]))
    last = F.array_max(F.transform(jobs, lambda j: j["end_year"]))
    known = first.isNotNull() & last.isNotNull()
    years = F.when(known, last - first).otherwise(0)
    return F.struct(years.alias("years"), F.when(known, experience_level(years)).otherwise("Unknown").alias("level"))


def without_furniture(html: Column) -> Column:
    """A page without comments, scripts, styles and page furniture.

    What comes first counts: a comment in a script is script, a tag in a
    comment is comment; unclosed ones reach to the end.  Furniture elements
    nest: one ends with the end tag that balances the tags of its own name
    since its start, or with the page.  The page is cut at furniture tags and
    the pieces are folded, so the work follows the number of such tags.
    """
    raw = "|".join(["<!--.*?(?:-->|\\z)", *[f"<{t}(?:\\s[^>]*)?>.*?(?:</{t}\\s*>|\\z)" for t in RAW_TAGS]])
    names = "|".join(t for t in DROPPED_TAGS if t not in RAW_TAGS)
    bare = F.regexp_replace(F.translate(html, _CUT, ""), f"(?is){raw}", "")
    pieces = F.split(F.regexp_replace(bare, f"(?i)(</?(?:{names})[\\s/>])", f"{_CUT}$1"), _CUT)
    start = F.struct(F.lit("").alias("inside"), F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(state: Column, piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, f"(?i)^</?({names})[\\s/>]", 1))
        ends = F.startswith(piece, F.lit("</"))
        opens = (name != "") & ~ends & ~piece.rlike("^<[^>]*/>")
        outside = state["depth"] == 0
        depth = F.when(outside, F.when(opens, 1).otherwise(0)).when(name != state["inside"], state["depth"]).when(ends, state["depth"] - 1).when(opens, state["depth"] + 1).otherwise(state["depth"])
        inside = F.when(outside, name).otherwise(state["inside"])
        # Behind the tag that ends the furniture the page goes on.
        text = F.when(depth > 0, state["text"]).otherwise(F.concat(state["text"], F.when(name != "", F.regexp_replace(piece, "^<[^>]*>?", " ")).otherwise(piece)))
        return F.struct(inside.alias("inside"), depth.alias("depth"), text.alias("text"))

    return F.aggregate(pieces, start, step)["text"]


def html_paragraphs(html: Column) -> Column:
    """Text of the paragraphs outside scripts, styles and page furniture, as one line.

    A paragraph runs to its end tag or to the next start tag of one.
    """
    parts = F.slice(F.split(without_furniture(html), "(?i)<p(?:\\s[^>]*)?>"), 2, 100_000_000)
    bodies = F.transform(parts, lambda p: F.element_at(F.split(p, "(?i)</p>", 2), 1))
    text = F.regexp_replace(F.array_join(bodies, " "), "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def is_relevant(x: Column) -> Column:
    """Two or more of the subject terms occur."""
    return count_of(F.lower(x), RELEVANCE_TERMS) >= 2


def page_text(html: Column, least: int = 300, most: int = 4000, need_relevance: bool = True) -> Column:
    """Paragraph text, empty if short or off the subject, cut to ``most`` characters."""
    text = html_paragraphs(html)
    good = F.length(text) >= least
    if need_relevance:
        good = good & is_relevant(text)
    return F.when(good, char_prefix(text, most)).otherwise("")


def url_allowed(url: Column, domains: list[str]) -> Column:
    return any_of(F.lower(url), domains)


def url_blocked(url: Column, words: list[str]) -> Column:
    return any_of(F.lower(url), words)
