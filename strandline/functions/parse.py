"""Column functions on names, lines and bodies of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import profile as pf
from strandline.functions.profile import DEFAULT, CorpusProfile


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    """What a group of the pattern matched; null where the pattern has no match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def doc_code(path: Column, profile: CorpusProfile = DEFAULT) -> Column:
    """The document code the file name begins with, in the modern or else the early form; '' for none."""
    return F.coalesce(_found(basename(path), f"^{profile.any_code}"), F.when(path.isNotNull(), F.lit("")))


def revision(path: Column, profile: CorpusProfile = DEFAULT) -> Column:
    """The revision letter after the code, with its number if one follows ("C", "C Rev.1"); '' for none."""
    name, stem = basename(path), f"{profile.any_code}([A-Z])"
    letter = profile.any_code.count("(") + 1  # the group after those of the code
    first = F.regexp_extract(name, stem, letter)
    number = F.regexp_extract(name, rf"{stem}([-_ ]?Rev\.?\s?([0-9]+))?", letter + 2)
    return F.when(~name.rlike(stem), "").when(number != "", F.concat(first, F.lit(" Rev."), number)).otherwise(first)


def authority(code: Column, given: Column, source_class: Column, profile: CorpusProfile = DEFAULT) -> tuple[Column, Column]:
    """(authority, source class): documents of an informative kind loaded as standards are informative handbooks."""
    never = (source_class == "standard") & code.rlike("|".join(f"-{k}-" for k in profile.informative))
    return F.when(never, "informative").otherwise(given), F.when(never, "handbook").otherwise(source_class)


def clause_of(line: Column, heading: Column | bool = False) -> Column:
    """The clause number a line declares; null for none. A bare number counts in a heading only."""
    heading = heading if isinstance(heading, Column) else F.lit(heading)
    return F.coalesce(_found(line, pf.CLAUSE_DOTTED, 1), F.when(heading, _found(line, pf.CLAUSE_BARE, 1)))


def clause_of_heading(line: Column) -> Column:
    """The label a heading sets: its number, an annex number, an annex letter; null where it inherits."""
    return F.coalesce(clause_of(line, True), _found(line, pf.ANNEX_NUMBER, 1), F.upper(_found(line, pf.ANNEX_LETTER, 1)))


def is_boundary(line: Column, profile: CorpusProfile = DEFAULT) -> Column:
    """Whether a line begins a requirement unit: a dotted clause, a lettered item or a requirement id."""
    return line.rlike(pf.CLAUSE_DOTTED) | line.rlike(pf.LETTERED) | F.trim(line).rlike("^" + profile.requirement.removeprefix(r"\b"))


def crumb(code: Column, rev: Column, clause: Column, section: Column) -> Column:
    """"CODE REV | clause | h1 > h2": parts that are empty or null are left out, a missing section is "(document)"."""
    head = F.concat_ws(" ", F.nullif(code, F.lit("")), F.nullif(rev, F.lit("")))
    return F.concat(head, F.lit(" | "), F.when(F.coalesce(clause, F.lit("")) != "", F.concat(clause, F.lit(" | "))).otherwise(""), F.coalesce(F.nullif(section, F.lit("")), F.lit("(document)")))


def display(crumb_: Column, body: Column) -> Column:
    return F.concat(F.lit("SECTION: "), crumb_, F.lit("\n"), body)


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def refs(body: Column, own: Column, profile: CorpusProfile = DEFAULT) -> Column:
    """The codes a body names other than its own, distinct and sorted."""
    found = F.array_distinct(_all(body, profile.code))
    return F.array_sort(F.filter(found, lambda x: ~x.eqNullSafe(own)))


def requirement_ids(body: Column, profile: CorpusProfile = DEFAULT) -> Column:
    return F.array_sort(F.array_distinct(_all(body, profile.requirement)))


def modals(body: Column) -> Column:
    """The modal verbs of a body in lower case, distinct and sorted."""
    return F.array_sort(F.array_distinct(_all(F.lower(body), pf.MODAL)))


def dehyphenate(text: Column, profile: CorpusProfile = DEFAULT) -> Column:
    """Codes broken after a hyphen, before two digits, joined again."""
    return F.regexp_replace(text, rf"({profile.code})-[ \t\n]+([0-9]{{2}})", "$1-$4")


def usable_caption(c: Column, profile: CorpusProfile = DEFAULT) -> Column:
    """The trimmed caption, or null if it is empty, says that there is no figure, or is too short to describe one."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = F.lower(F.regexp_replace(t, "^[ .\\t\\n\"']+|[ .\\t\\n\"']+$", ""))
    return F.when((t != "") & ~bare.isin(list(pf.NO_CAPTION)) & ~F.lower(t).rlike(pf.NO_FIGURE) & (F.length(t) >= profile.min_caption), t)


def populated(c: Column, kind: str) -> Column:
    """Whether a value carries something; numbers do, zero included, empty strings and collections do not."""
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind.startswith(("array", "map")):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def collapsed(c: Column) -> Column:
    """One blank for each run of white space, trimmed, in lower case: the form in which texts are searched; null is ''."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x0B\x85\p{Z}]+", " ")))


def anchor_parts(anchor: Column) -> tuple[Column, Column]:
    """(document, clause) of "DOC CLAUSE"; what is missing is ''."""
    pieces = F.split(F.regexp_replace(F.coalesce(anchor, F.lit("")), r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$", ""), r"[\s\x0B\x85\p{Z}]+")
    return F.coalesce(F.get(pieces, F.lit(0)), F.lit("")), F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))


def verdict(reply: Column) -> Column:
    """The first YES or NO that stands as a word, as a boolean; null where neither does."""
    first = F.upper(F.regexp_extract(reply, r"(?i)\b(yes|no)\b", 1))
    return F.when(first == "YES", True).when(first == "NO", False)


def after_thinking(reply: Column) -> Column:
    """What follows the last closing tag of the model's thoughts."""
    return F.trim(F.element_at(F.split(reply, "</think>"), -1))


def fmt_duration(seconds: Column) -> Column:
    """"1h 02m", "2m 03s", "4.0s"."""
    s = F.floor(seconds)
    hours = F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))
    return F.when(seconds >= 3600, hours).when(seconds >= 60, F.format_string("%dm %02ds", F.floor(s / 60), F.pmod(s, F.lit(60)))).otherwise(F.format_string("%.1fs", seconds))
