"""Rules, symbols, imports and backward slices over syntax rows, as joins (section 2.11, DF-04..15, JON-16..18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.sources.shared import stored

# The pinned rules, as (rule, severity, CWE, names of calls).
CALL_RULES = (
    ("python-insecure-eval", "ERROR", "94", ("eval", "exec")),
    ("python-flask-render-template-string", "ERROR", "79", ("render_template_string",)),
    ("python-insecure-deserialization", "ERROR", "502", ("pickle.loads", "pickle.load", "_pickle.loads", "_pickle.load", "yaml.unsafe_load", "jsonpickle.decode", "marshal.loads", "marshal.load", "shelve.open")),
    ("python-xml-external-entity", "WARNING", "611", ("lxml.etree.parse", "lxml.etree.fromstring", "xml.sax.parse", "xml.dom.minidom.parse", "xml.dom.minidom.parseString", "xml.etree.ElementTree.parse", "xml.etree.ElementTree.fromstring")),
    ("python-insecure-randomness", "WARNING", "330", ("random.random", "random.randint", "random.choice", "random.randrange", "random.sample", "random.getrandbits")),
    ("python-weak-hashing", "WARNING", "328", ("hashlib.md5", "hashlib.sha1", "Crypto.Hash.MD5.new", "Crypto.Hash.SHA.new")),
    ("python-open-redirect", "WARNING", "601", ("flask.redirect", "redirect", "django.shortcuts.redirect", "HttpResponseRedirect", "HttpResponsePermanentRedirect")),
    ("python-ssrf-requests", "WARNING", "918", ("requests.get", "requests.post", "requests.put", "requests.delete", "requests.head", "requests.patch", "requests.request", "urllib.request.urlopen", "urllib.request.Request", "httpx.get", "httpx.post", "httpx.request", "aiohttp.ClientSession.get", "aiohttp.ClientSession.post")),
)
SHELL_CALLS = ("subprocess.call", "subprocess.check_output", "subprocess.run", "subprocess.Popen")
LDAP_METHODS = ("search", "search_s", "search_st", "search_ext", "search_ext_s")
XPATH_METHODS = ("xpath", "find", "findall")


def _method(*names: str) -> Column:
    return F.contains("call", F.lit(".")) & F.substring_index("call", ".", -1).isin(*names)


def _has(argument: str) -> Column:
    return F.array_contains("args", argument)


def resolved_calls(rows: DataFrame) -> DataFrame:
    """Calls with their name spelled out through the file's imports (`from subprocess import run` makes run subprocess.run)."""
    calls = rows.where("kind = 'call'").select("path", "scope", F.col("name").alias("written"), "line", "end_line", "args", "names", F.col("level").alias("n_positional"))
    full = F.when(F.col("names").isNotNull(), F.concat_ws(".", F.when(F.col("name") != "", F.col("name")), F.element_at("names", 1))).when(F.col("target") != F.col("name"), F.col("name"))
    alias = rows.where("kind = 'import' and level = 0").select("path", F.col("target").alias("head"), full.alias("full")).where("full is not null").groupBy("path", "head").agg(F.min("full").alias("full"))
    calls = calls.withColumn("head", F.substring_index("written", ".", 1))
    out = calls.join(alias, ["path", "head"], "left")
    spelled = F.concat("full", F.substring(F.col("written"), F.length("head") + 1, F.length("written")))
    return out.withColumn("call", F.coalesce(spelled, "written")).drop("head", "full")


def rule_hits(calls: DataFrame) -> DataFrame:
    """Section 2.11: (path, line, end_line, call, rule_id, severity, cwe) of the 14 pinned rules, by resolved or written name."""
    named = lambda names: F.col("call").isin(*names) | F.col("written").isin(*names)
    first = F.coalesce(F.try_element_at("args", F.lit(1)), F.lit(""))
    set_cookie = F.substring_index("written", ".", -1) == "set_cookie"
    tests = [(rule, severity, cwe, named(names)) for rule, severity, cwe, names in CALL_RULES]
    tests += [
        ("python-insecure-subprocess-shell", "ERROR", "78", named(SHELL_CALLS) & _has("shell=True")),
        ("python-sql-injection", "ERROR", "89", _method("execute") & first.isin("f-string", "+", "%", ".format")),
        ("python-path-traversal-open", "WARNING", "22", named(("open",)) & (F.col("n_positional") >= 1)),
        ("python-insecure-deserialization", "ERROR", "502", named(("yaml.load",)) & _has("Loader=yaml.Loader")),
        ("python-ldap-injection", "ERROR", "90", named(("ldap.search", "ldap.search_s")) | (_method(*LDAP_METHODS) & (F.size("args") >= 1))),
        ("python-xpath-injection", "ERROR", "643", named(("etree.XPath", "lxml.etree.XPath")) | _method(*XPATH_METHODS)),
        ("python-weak-hashing", "WARNING", "328", named(("hashlib.new",)) & first.isin("'md5'", "'sha1'", "'MD5'", "'SHA1'")),
        ("python-insecure-cookie", "WARNING", "614", set_cookie & (_has("secure=False") | _has("httponly=False") | ((F.size("args") == 2) & (F.col("n_positional") == 2)))),
    ]
    one = [F.when(test, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("cwe"))) for r, s, c, test in tests]
    return calls.select("path", "scope", "line", "end_line", "call", "names", F.explode(F.array_distinct(F.array_compact(F.array(*one)))).alias("hit")).select("path", "scope", "line", "end_line", "call", "names", "hit.*")


def enclosing_scopes(rows: DataFrame, places: DataFrame) -> DataFrame:
    """DF-15: for each (path, line) the innermost function around it, else class."""
    spans = rows.where("kind in ('function', 'class')").select("path", "kind", "name", F.col("line").alias("from"), F.col("end_line").alias("to"))
    inside = places.join(spans, "path").where("line between `from` and `to`")
    best = F.max_by("name", F.struct((F.col("kind") == "function").cast("int"), "from"))
    return inside.groupBy("path", "line").agg(best.alias("scope"))


def wrappers(rows: DataFrame, hits: DataFrame, rounds: int = 5) -> DataFrame:
    """DF-04: (path, function) that pass a parameter of theirs on to a dangerous call, directly or through such functions."""
    functions = rows.where("kind = 'function'").select("path", F.col("name").alias("scope"), F.col("target").alias("function"), F.col("args").alias("params"))
    uses = rows.where("kind = 'call'").select("path", "scope", F.substring_index("name", ".", -1).alias("callee"), "names").join(functions, ["path", "scope"]).where(F.arrays_overlap("names", "params"))
    uses = stored(uses.select("path", "callee", "function").distinct())
    new = found = stored(hits.select("path", "scope", "names").join(functions, ["path", "scope"]).where(F.arrays_overlap("names", "params")).select("path", "function").distinct())
    for _ in range(rounds):
        more = uses.join(new.withColumnRenamed("function", "callee"), ["path", "callee"], "left_semi").select("path", "function").distinct()
        new = stored(more.join(found, ["path", "function"], "left_anti"))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def _definitions_reaching(rows: DataFrame) -> DataFrame:
    """DF-05: for each read of a name, the statements of its scope whose binding may still hold there.

    A binding on another arm of a branch around the read does not reach it.  The
    last binding that surely runs before the read (its branch holds the read, or
    each arm of an if with an else binds the name) hides those before it; bindings
    on branches after it all reach.  In a scope with loops those further down reach too.
    """
    s = rows.where("kind = 'statement'").select("path", "scope", "line", F.coalesce("target", F.lit("")).alias("branch"), F.col("args").alias("binds"), F.col("names").alias("reads"))
    params = rows.where("kind = 'function'").select("path", F.col("name").alias("scope"), "line", F.lit("").alias("branch"), F.explode("args").alias("name"))
    binds = s.select("path", "scope", "line", "branch", F.explode("binds").alias("name")).unionByName(params)
    # an if of which each arm binds the name binds it as a whole, at its own line
    arm = F.regexp_extract("branch", r"^((?:[^/]*/)*?)(\d+):(\d+):2/$", 2)
    whole = binds.where(arm != "").select("path", "scope", "name", arm.try_cast("int").alias("line"), F.regexp_extract("branch", r"^(.*?)\d+:\d+:2/$", 1).alias("branch"), F.regexp_extract("branch", r"(\d+):2/$", 1).alias("arm"))
    whole = whole.groupBy("path", "scope", "name", "line", "branch").agg(F.count_distinct("arm").alias("arms")).where("arms = 2").select("path", "scope", "line", "branch", "name", F.lit(True).alias("whole"))
    made = binds.withColumn("whole", F.lit(False)).unionByName(whole).select("path", "scope", "name", F.col("line").alias("bound"), F.col("branch").alias("b_branch"), "whole")
    reads = s.select("path", "scope", "line", "branch", F.explode("reads").alias("name"))
    both = reads.join(made, ["path", "scope", "name"])
    # another arm: the branches part at one compound statement, in different arms of it
    steps, others = F.split("branch", "/"), F.split("b_branch", "/")

    def met(z: Column) -> Column:
        r, b = F.coalesce(z["r"], F.lit("")), F.coalesce(z["b"], F.lit(""))
        return (r != "") & (b != "") & (r != b) & (F.substring_index(r, ":", 1) == F.substring_index(b, ":", 1))

    parted = F.exists(F.arrays_zip(steps.alias("r"), others.alias("b")), met)
    before = both.where((F.col("bound") < F.col("line")) & ~parted)
    sure = F.startswith("branch", F.col("b_branch"))
    keys = ["path", "scope", "line", "name"]
    # the rows already lie together by name, so the last one is found where they are
    last = F.max(F.when(sure, F.col("bound"))).over(Window.partitionBy("path", "scope", "name", "line"))
    reach = before.withColumn("last", last).where("not whole and (last is null or bound >= last)").select(*keys, "bound")
    # what a loop binds further down may also reach an earlier read; only scopes with a loop are asked again
    loops = rows.where("kind = 'statement' and name in ('For', 'While', 'AsyncFor')").select("path", "scope").distinct()
    looped = reads.select(*keys).join(loops, ["path", "scope"], "left_semi")
    around = looped.join(made.where("not whole"), ["path", "scope", "name"]).where("bound >= line").select(*keys, "bound")
    return reach.unionByName(around)


def backward_slices(rows: DataFrame, sinks: DataFrame, rounds: int | None = None) -> DataFrame:
    """DF-06, DF-07: (path, sink_line, line, partial): lines whose values or conditions reach a sink's line, within its scope.

    Each round follows every read one definition back, for all sinks at once,
    until nothing is new.  `rounds` bounds them; partial then tells the slices that
    would go on.
    """
    edges = stored(_definitions_reaching(rows).select("path", "scope", "line", "bound").distinct())
    keys = ["path", "scope", "sink_line"]
    new = found = stored(sinks.select("path", "scope", F.col("line").alias("sink_line"), "line").distinct())
    done = 0
    while not new.isEmpty() and (rounds is None or done <= rounds):
        back = new.join(edges, ["path", "scope", "line"]).select(*keys, F.col("bound").alias("line")).distinct()
        new = stored(back.join(found, [*keys, "line"], "left_anti"))
        if rounds is None or done < rounds:
            found = found.unionByName(new)
        done += 1
    # with a bound the last round only asks what it would have found
    cut = new.select(*keys).distinct().withColumn("partial", F.lit(True))
    return found.join(cut, keys, "left").select("path", "sink_line", "line", F.coalesce("partial", F.lit(False)).alias("partial"))


def module_names(paths: DataFrame) -> DataFrame:
    """JON-18: path and the dotted module that it is."""
    bare = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", "")
    return paths.select("path", F.replace(bare, F.lit("/"), F.lit(".")).alias("module"))


def import_edges(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, imported): which file a file's imports lead to, relative levels counted from its package."""
    mods = module_names(paths)
    imports = rows.where("kind = 'import'").select("path", "name", "names", "level")
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - F.col("level"), F.lit(0))), ".")
    base = F.when(F.col("level") > 0, F.concat_ws(".", F.when(folder != "", folder), F.when(F.col("name") != "", F.col("name")))).otherwise(F.col("name"))
    wanted = imports.withColumn("base", base)
    # `from p import m` may name a module m of p, or something in p
    tries = wanted.select("path", F.explode(F.array_compact(F.array("base", F.when(F.col("names").isNotNull(), F.concat_ws(".", F.when(F.col("base") != "", F.col("base")), F.element_at("names", 1)))))).alias("module"))
    return tries.join(mods.withColumnRenamed("path", "imported"), "module").select("path", "imported").where("path <> imported").distinct()


def importers(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """JON-16: the files that import a seed (path), up to `most` by path."""
    out = edges.join(seeds.select(F.col("path").alias("imported")), "imported", "left_semi").select("path").distinct().join(seeds, "path", "left_anti")
    return out if most is None else out.orderBy("path").limit(most)


def resolve_symbols(rows: DataFrame, paths: DataFrame, wanted: DataFrame, depth: int = 10) -> DataFrame:
    """JON-17: for wanted (path, symbol), the file and line that define it, following imports and re-exports up to `depth`.

    Each round joins the open requests with definitions and imports; a request
    that comes back to a file it has been to is dropped, so cycles end.
    """
    defined = rows.where("kind in ('function', 'class') and scope = ''").select("path", F.col("target").alias("symbol"), "line")
    assigned = rows.where("kind = 'statement' and scope = ''").select("path", F.explode("args").alias("symbol"), "line")
    defined = stored(defined.unionByName(assigned).groupBy("path", "symbol").agg(F.min("line").alias("line")))
    mods = module_names(paths)
    froms = rows.where("kind = 'import' and names is not null and level = 0").select("path", F.col("name").alias("module"), F.col("target").alias("symbol"), F.element_at("names", 1).alias("there")).join(mods.withColumnRenamed("path", "next"), "module")
    froms = stored(froms)
    open_ = wanted.select(F.col("path").alias("asked"), F.col("symbol").alias("wanted"), "path", "symbol", F.array("path").alias("seen"))
    hits = []
    for step in range(depth + 1):
        hits.append(open_.join(defined, ["path", "symbol"]).select("asked", "wanted", "path", "line", F.lit(step).alias("hops")))
        left = stored(open_.join(defined, ["path", "symbol"], "left_anti"))
        if left.isEmpty():
            break
        named = left.join(froms, ["path", "symbol"]).select("asked", "wanted", F.col("next").alias("path"), F.col("there").alias("symbol"), "seen")
        star = left.join(froms.where("there = '*'").drop("symbol"), "path").select("asked", "wanted", F.col("next").alias("path"), "symbol", "seen")
        open_ = named.unionByName(star).where(~F.array_contains("seen", F.col("path"))).withColumn("seen", F.array_append("seen", F.col("path")))
    every = reduce(lambda a, b: a.unionByName(b), hits)
    return every.groupBy("asked", "wanted").agg(F.min(F.struct("hops", "path", "line")).alias("d")).select("asked", "wanted", "d.*")
