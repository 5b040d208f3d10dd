"""Scalar operators on findings and files, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions import fixed

# Case is folded and white space taken by Unicode, as in the scanner's own expressions.
_FOLD = "(?iu)"


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


#: Words of which each match of a signal's pattern holds one, in lower case; a plain search spares most expressions.
SIGNAL_WORDS = {
    "process execution": ("subprocess", "os.system", "os.popen"),
    "dynamic evaluation": ("eval", "exec", "compile"),
    "deserialization": ("pickle", "marshal", "yaml.load", "shelve"),
    "database access": (".execute", "raw", "cursor", "select", "insert"),
    "http route": ("@",),
    "user input": ("request.",),
    "secrets": ("password", "secret", "token", "api_key", "credential"),
    "authn/authz": ("auth", "login", "permission", "is_admin", "session"),
    "file access": ("open", "path", "send_file", "sendfile"),
    "outbound http": ("requests.", "urllib", "httpx", "aiohttp"),
    "crypto/random": ("hashlib", "crypt", "cipher", "random."),
    "template injection": ("render_template_string", ".innerhtml", "mark_safe", "safe"),
    "security config": ("permission", "cors", "allow_origins"),
    "html component output": ("html", "render_output", "<div"),
    "custom deserialization": (".loads", ".unserialize", ".unpickle", ".decode_payload", "serial", "pcrypt"),
    "ldap/xpath query": ("ldap", "search_s", "xpath"),
    "cookie security": ("set_cookie", "set-cookie", "secure"),
}


def _signals(content: Column, signals) -> list[tuple[Column, int, str]]:
    text = F.coalesce(content, F.lit(""))
    # the long s and the Kelvin sign fold to s and k, but lower() leaves the one as it is
    low = F.translate(F.lower(text), "\u017f\u212a", "sk")
    out = []
    for pattern, weight, name in signals:
        test = F.rlike(text, F.lit(_FOLD + pattern))
        if name in SIGNAL_WORDS:
            test = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in SIGNAL_WORDS[name]]) & test
        out.append((test, weight, name))
    return out


def risk_score(content: Column, signals=fixed.RISK_SIGNALS) -> Column:
    """PRJ-01: the summed weights of the signals that occur."""
    return reduce(lambda a, b: a + b, [F.when(test, F.lit(w)).otherwise(F.lit(0)) for test, w, _ in _signals(content, signals)])


def risk_reasons(content: Column, signals=fixed.RISK_SIGNALS) -> Column:
    """PRJ-01: the names of the signals that occur, in their order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in _signals(content, signals)]))


def risk_signal_counts(content: Column, signals=fixed.RISK_SIGNALS) -> list[Column]:
    """PRJ-01: aggregates, one for each signal: in how many texts it occurs.  They stay inside generated code, unlike an explode of names."""
    return [F.count_if(test).alias(name) for test, _, name in _signals(content, signals)]


def cwe_marks(cwe: Column, exact: bool = False) -> Column:
    """FLT-13 as an array: two CWEs match where they share an element; nothing for a missing number."""
    number = cwe_number(cwe)
    classes = [] if exact else [F.when(number.isin(*c), F.lit(f"class {k}")) for k, c in enumerate(fixed.CWE_CLASSES)]
    return F.when(number != "", F.array_compact(F.array(number, *classes)))


def severity_rank(severity: Column) -> Column:
    """PRJ-31: 0 for CRITICAL to 4 for INFO, else null."""
    at = F.array_position(_literal(fixed.SEVERITIES), F.upper(severity))
    return F.when(at > 0, (at - 1).cast("int"))


def severity_weight(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(w)) for s, w in fixed.SEVERITY_WEIGHTS.items()], F.lit(0))


def fingerprint(path: Column, kind: Column, snippet: Column, line: Column) -> Column:
    """PRJ-02: 16 hex digits over path, type and the snippet with its white space collapsed.

    Without a snippet, or with a placeholder for one, the line stands in.
    """
    collapsed = F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"(?U)\s+", " "))
    bare = collapsed.isin("") | F.lower(collapsed).isin("requires login", "requires_login", "...")
    told = F.when(bare, F.concat(F.lit("L"), line.cast("string"))).otherwise(collapsed)
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(path, F.lit("")), kind, told), 256), 1, 16)


def _clamped(word: Column, most: float) -> Column:
    number = word.try_cast("double")  # least and greatest pass over nulls, so those are kept apart
    return F.when(number.isNotNull() & ~F.isnan(number), F.round(F.greatest(F.lit(0.0), F.least(F.lit(most), number)), 2))


def coerce_confidence(value: Column) -> Column:
    """PRJ-03: labels to scores; numbers clamped to [0, 1] with two places; else one half."""
    word = F.lower(F.trim(value.cast("string")))
    named = F.when(word.isin("high", "h", "critical", "very high"), 0.9).when(word.isin("medium", "med", "m", "moderate"), 0.6).when(word.isin("low", "l"), 0.3)
    return F.coalesce(named, _clamped(word, 1.0), F.lit(0.5))


def coerce_cvss(value: Column) -> Column:
    """PRJ-04: labels to scores; numbers clamped to [0, 10] with two places; else 5."""
    word = F.lower(F.trim(value.cast("string")))
    named = F.when(word.isin("critical", "crit"), 9.5).when(word.isin("high", "h"), 8.0).when(word.isin("medium", "med", "m"), 5.5).when(word.isin("low", "l"), 3.0)
    return F.coalesce(named, _clamped(word, 10.0), F.lit(5.0))


def normalize_cwe(cwe: Column) -> Column:
    """PRJ-05: `CWE-<number>`, or CWE-Unknown where blank."""
    bare = F.trim(F.coalesce(cwe.cast("string"), F.lit("")))
    return F.when(bare == "", "CWE-Unknown").when(F.startswith(F.upper(bare), F.lit("CWE-")), bare).otherwise(F.concat(F.lit("CWE-"), bare))


def cwe_number(cwe: Column) -> Column:
    return F.regexp_extract(F.coalesce(cwe.cast("string"), F.lit("")), "([0-9]+)", 1)


def cwe_matches(a: Column, b: Column, exact: bool = False) -> Column:
    """FLT-13: equal numbers, or both of one class; a missing number never matches."""
    a, b = cwe_number(a), cwe_number(b)
    same = a == b
    if not exact:
        same = reduce(lambda x, c: x | (a.isin(*c) & b.isin(*c)), fixed.CWE_CLASSES, same)
    return (a != "") & (b != "") & same


def types_agree(a: Column, b: Column, cwe_a: Column, cwe_b: Column) -> Column:
    """FLT-15: equal, in one alias group, or of equal CWE number; not transitive."""
    same = reduce(lambda x, g: x | (a.isin(*g) & b.isin(*g)), fixed.TYPE_ALIASES, a == b)
    return same | ((cwe_number(cwe_a) != "") & (cwe_number(cwe_a) == cwe_number(cwe_b)))


def line_distance(start_a: Column, end_a: Column, start_b: Column, end_b: Column, most: int = fixed.FUSION_LINES) -> Column:
    """JON-01: 0 where spans overlap, else the gap; null beyond `most` lines."""
    end_a, end_b = F.greatest(F.coalesce(end_a, start_a), start_a), F.greatest(F.coalesce(end_b, start_b), start_b)
    gap = F.greatest(F.lit(0), F.greatest(start_a, start_b) - F.least(end_a, end_b))
    return F.when(gap <= most, gap)


def plain_path(path: Column) -> Column:
    """FLT-14: forward slashes, no leading dots and slashes, lower case; blank stands for any file."""
    return F.lower(F.regexp_replace(F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), r"^[./]+", ""))


def cache_key(content: Column, *settings: str) -> Column:
    """PRJ-47: sha256 over the settings and the content."""
    return F.sha2(F.concat_ws("\u0000", *[F.lit(s) for s in settings], F.coalesce(content, F.lit(""))), 256)


def lines_of(content: Column) -> Column:
    """PRJ-23, SRC-07: the lines, cut at every newline."""
    return F.split(F.coalesce(content, F.lit("")), "\n")


def component_excluded(path: Column, patterns=fixed.DEFAULT_EXCLUDES) -> Column:
    """SRC-03: a component of the path, or all of it, matches one of the globs."""

    def regex(glob: str) -> str:
        out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".\\+^$(){}|[]" else c for c in glob)
        return f"^(?:{out})$"

    tests = [regex(g) for g in patterns]
    return F.exists(F.split(path, "/"), lambda p: reduce(lambda a, b: a | b, [F.rlike(p, F.lit(t)) for t in tests])) | reduce(lambda a, b: a | b, [F.rlike(path, F.lit(t)) for t in tests])
