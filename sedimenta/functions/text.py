"""Column functions over slugs, paths, headings and facts. All of them are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder names and the page type they stand for (fixed values).
FOLDER_TYPES = {
    "project": "project", "projects": "project", "area": "area", "areas": "area", "resource": "resource", "resources": "resource",
    "archive": "archive", "archives": "archive", "journal": "journal", "journals": "journal", "people": "person", "companies": "company", "orgs": "company",
}
#: Named-entity verbs: predicate, pattern with subject and object groups (fixed values).
_NAME = r"[A-Z][A-Za-z0-9'&-]*(?: [A-Z][A-Za-z0-9'&-]*)*"
#: A match begins at the beginning of a word.
_START = r"(?:^|[^A-Za-z0-9_])"
ASSERTION_PATTERNS = {
    "works_at": rf"{_START}({_NAME}) works at ({_NAME})",
    "is_a": rf"{_START}({_NAME}) is an? ([A-Za-z][A-Za-z0-9'&-]*(?: [A-Za-z][A-Za-z0-9'&-]*)*)",
    "founded": rf"{_START}({_NAME}) founded ({_NAME})",
}
_SUBJECT, _OBJECT = r"[A-Z][A-Za-z0-9_'-]*(?:\s+[A-Z][A-Za-z0-9_'-]*)*", r"[A-Z][A-Za-z0-9_'&-]*(?:\s+[A-Z][A-Za-z0-9_'&-]*)*"
ENTITY_PATTERNS = {
    "works_at": rf"{_START}({_SUBJECT})\s+works\s+at\s+({_OBJECT})",
    "founded": rf"{_START}({_SUBJECT})\s+founded\s+({_OBJECT})",
    "invested_in": rf"{_START}({_OBJECT})\s+invested\s+in\s+({_OBJECT})",
    "acquired": rf"{_START}({_OBJECT})\s+acquired\s+({_OBJECT})",
    "leads": rf"{_START}({_SUBJECT})\s+leads\s+({_OBJECT})",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def resolve_slug(c: Column) -> Column:
    """Trimmed, lower case, blanks as hyphens, no slashes at the ends and none doubled."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("-")), "^/+|/+$", ""), "/+", "/")


def derive_wing(slug: Column) -> Column:
    return F.when(F.instr(slug, "/") > 1, F.substring_index(slug, "/", 1)).otherwise("general")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def derive_room(text: Column) -> Column:
    """The first level-2 heading in kebab case, '' if there is none."""
    heads = F.filter(_lines(text), lambda x: x.startswith("## ") & (strip(F.substring(x, 4, 1_000_000)) != ""))
    first = F.coalesce(F.try_element_at(heads, F.lit(1)), F.lit(""))
    return F.regexp_replace(F.replace(F.lower(strip(F.substring(first, 4, 1_000_000))), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")


def extract_summary(text: Column, most: int = 200) -> Column:
    """The first paragraph that is no heading, in one line of at most `most` characters; else the first line with text."""
    flat = F.array_join(F.transform(_lines(text), strip), "\n")
    para = F.replace(F.regexp_extract(flat, r"(?:^|\n)([^#\n][^\n]*(?:\n[^#\n][^\n]*)*)", 1), F.lit("\n"), F.lit(" "))
    line = F.regexp_extract(flat, r"(?:^|\n)([^\n]+)", 1)
    return F.substring(F.when(para != "", para).otherwise(line), 1, most)


def slug_from_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/])\.[^./]*$", "$1")


def strip_numeric_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^[0-9]+[._-]\s*", "")


def type_from_folder(path: Column) -> Column:
    folder = F.lower(strip_numeric_prefix(F.substring_index(path, "/", 1)))
    pairs = [F.lit(x) for kv in FOLDER_TYPES.items() for x in kv]
    return F.when(F.instr(path, "/") > 0, F.try_element_at(F.create_map(*pairs), folder))


def namespace_ok(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_.-]{1,128}$")


def namespace_from_path(path: Column) -> Column:
    ns = F.regexp_extract(path, r"^([^/]+)/extracted/", 1)
    return F.when(namespace_ok(ns), ns).otherwise("")


def collection_name_ok(c: Column) -> Column:
    return (F.length(c) > 0) & ~c.contains("::")


def relative_path_ok(c: Column) -> Column:
    """No empty path or segment, no NUL, no root, drive letter or step upward."""
    bad = r"(^$)|(\x00)|(^[/\\])|(^[A-Za-z]:)|(//)|(/$)|((^|[/\\])\.\.([/\\]|$))"
    return ~c.rlike(bad)


def words_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-case words; 1 if both are empty."""
    x, y = words_set(a), words_set(b)
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / n)


def normalise_evidence(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"[.!?;:]+$", ""))


def object_ok(c: Column) -> Column:
    return F.octet_length(strip(c)) >= 6


def role_folder(role: Column) -> Column:
    return F.when(role == "person", "people").when(role == "company", "companies").when(role == "team", "teams").otherwise(F.concat(role, F.lit("s")))


def conflict_description(subject: Column, predicate: Column, a: Column, b: Column) -> Column:
    return F.concat(subject, F.lit(" has conflicting "), predicate, F.lit(" assertions: "), F.least(a, b), F.lit(" vs "), F.greatest(a, b))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", "fact").otherwise(s)


def fact_signature(kind: Column, *fields: Column) -> Column:
    return F.concat_ws("|", kind, *(F.coalesce(f, F.lit("")) for f in fields))


def fact_slug(key: Column, signature: Column) -> Column:
    return F.concat(slugify(key), F.lit("-"), F.substring(F.sha2(signature, 256), 1, 4))


def whitespace_key(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def backoff_seconds(attempts: Column) -> Column:
    """0 for none, then 1, 2, 4, 8 and 16."""
    return F.when(attempts <= 0, 0).otherwise(F.expr("1").cast("int") * F.pow(F.lit(2), F.least(attempts - 1, F.lit(4))).cast("int"))


def date_of(c: Column) -> Column:
    d = F.substring(c, 1, 10)
    return F.when(d.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), d)


def conversation_path(namespace: Column, date: Column, session: Column) -> Column:
    return F.concat(F.when(namespace == "", "").otherwise(F.concat(namespace, F.lit("/"))), F.lit("conversations/"), date, F.lit("/"), session, F.lit(".md"))


def queue_key(namespace: Column, session: Column) -> Column:
    return F.when(namespace == "", session).otherwise(F.concat(namespace, F.lit("::"), session))


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def tags(frontmatter: Column) -> Column:
    """Tags as a list, from a JSON list or a comma-separated string; trimmed, without empty ones."""
    raw = F.get_json_object(frontmatter, "$.tags")
    listed = F.from_json(raw, "array<string>")
    return F.filter(F.transform(F.when(raw.startswith("["), listed).otherwise(F.split(raw, ",")), lambda x: F.trim(x)), lambda x: x != "")


def wikilinks(text: Column) -> Column:
    """The targets of [[...]] in order, as slugs."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)), resolve_slug)


def blocklist(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[\n,]"), strip), lambda x: x != "")
