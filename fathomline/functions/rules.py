"""What a rule's metadata says, as column expressions (PRJ-08..10, PRJ-12..13, FLT-02)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.scalars import cwe_number


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def posix_path(path: Column, root: str | None = None) -> Column:
    """PRJ-08, PRJ-49: forward slashes, no empty and `.` components; relative to `root` when inside it; blank for null."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(_blank(path), F.lit("\\"), F.lit("/")), "/(\\./)*/*", "/"), "^(\\./)+", "")
    plain = F.when(plain == "/", plain).otherwise(F.regexp_replace(plain, "(/\\.)*/*$", ""))
    if root is None:
        return plain
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(top)), F.substr(plain, F.lit(len(top) + 1))).when(plain == top[:-1], ".").otherwise(plain)


def source_label(source: Column) -> Column:
    """PRJ-09: confirmed, rule-only or llm-only; other names stay as they are, null is blank."""
    low = F.lower(_blank(source))
    return (
        F.when(low.isin("confirmed", "corroborated"), "confirmed")
        .when(low.isin("semgrep", "rule-only", "rule_only", "rule"), "rule-only")
        .when(low.isin("llm", "llm-only", "llm_only"), "llm-only")
        .otherwise(_blank(source))
    )


def first_cwe(entries: Column) -> Column:
    """PRJ-12: the number of the first entry that names a CWE, else blank."""
    named = F.filter(F.coalesce(entries, F.array().cast("array<string>")), lambda e: F.rlike(e, F.lit("CWE-[0-9]+")))
    return F.regexp_extract(_blank(F.get(named, F.lit(0))), "CWE-([0-9]+)", 1)


def preferred_owasp(entries: Column) -> Column:
    """PRJ-13: the first entry of the 2021 edition that has a code, else the first of 2021, else the first, else blank."""
    entries = F.coalesce(entries, F.array().cast("array<string>"))
    newest = F.filter(entries, lambda e: F.contains(e, F.lit("2021")))
    coded = F.filter(newest, lambda e: F.contains(e, F.lit("A0")))
    return F.coalesce(F.get(coded, F.lit(0)), F.get(newest, F.lit(0)), F.get(entries, F.lit(0)), F.lit(""))


def rule_type(cwe: Column, check_id: Column) -> Column:
    """PRJ-10: a rule's type by its CWE number, else as a pinned rule, else by the words of its last part, else of its whole id; null if none fits."""

    def named(key: Column, names: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)

    def worded(text: Column) -> Column:
        first = reduce(lambda tests, w: tests.when(F.contains(text, F.lit(w[0])), w[1]), fixed.RULE_WORDS[1:], F.when(F.contains(text, F.lit(fixed.RULE_WORDS[0][0])), fixed.RULE_WORDS[0][1]))
        return first

    check_id = _blank(check_id)
    tail = F.substring_index(check_id, ".", -1)
    return F.coalesce(named(cwe_number(cwe), fixed.CWE_TYPES), named(check_id, fixed.RULE_TYPES), named(tail, fixed.RULE_TYPES), worded(F.lower(tail)), worded(F.lower(check_id)))


def reliable(rule_ids: Column, severity: Column, cwe: Column, kind: Column, context: Column, description: Column) -> Column:
    """FLT-02: a severe finding of a named rule that is not generic.

    rule_ids: the rule's id and the ids merged into it; nulls and blanks do not count.
    """
    ids = F.filter(F.transform(F.coalesce(rule_ids, F.array().cast("array<string>")), lambda r: F.lower(F.trim(r))), lambda r: r != "")
    generic = F.exists(ids, lambda r: reduce(lambda a, w: a | F.contains(r, F.lit(w)), fixed.GENERIC_WORDS, F.lit(False)))
    joins_paths = F.contains(F.lower(F.concat_ws("\n", context, description)), F.lit("os.path.join"))
    generic_kind = cwe_number(cwe).isin(*fixed.GENERIC_CWES) | _blank(kind).isin(*fixed.GENERIC_TYPES)
    return (F.size(ids) > 0) & _blank(severity).isin("CRITICAL", "HIGH") & ~generic_kind & ~generic & ~joins_paths
