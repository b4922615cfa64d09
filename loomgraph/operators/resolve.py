"""Resolution passes: from extraction rows to edges.

Inputs are flat tables, one row per extracted thing, with ``path`` and ``ordinal`` (order within the file):
definitions (name, kind, start_line, end_line, is_exported, is_default, decorators, extends_clause, implements),
calls (callee, line, is_async, is_new, url, http_method), imports (source, name, original, is_type_only),
routes (method, route_path, handler). Every pass is a composition of equi joins; where several candidates fit, the first by
a stated order is taken by a combined minimum, not by sorting a group.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "go", "rs"]
CALLABLE = ["Function", "Method", "Class"]
TEST_FILE = r"(\.(test|spec)|_test|_spec)\.[^.]+$"
WILDCARD = r"^(:\w+|\{[^}]+\}|\$\{[^}]+\})$"
# Confidences by tier of call resolution, and by kind of route match.
TIERS = {"import": 0.95, "same_file": 0.85, "unique_name": 0.80, "class": 0.65}
ROUTE_LITERAL, ROUTE_TEMPLATE = 0.95, 0.80
HEURISTIC_BASE, HEURISTIC_STEP, HEURISTIC_CAP = 0.3, 0.1, 0.5


def without_extension(path) -> Column:
    return F.regexp_replace(path, r"\.[^.]+$", "")


def file_qn(project: str, path) -> Column:
    """Qualified name of a file: project and path with dots, without the extension."""
    return F.concat(F.lit(project + "."), F.regexp_replace(F.regexp_replace(path, "/", "."), r"\.[^.]+$", ""))


def symbols(definitions: DataFrame, project: str) -> DataFrame:
    """definitions with ``file_id`` and ``id``."""
    qn = file_qn(project, F.col("path"))
    return definitions.withColumn("file_id", qn).withColumn("id", F.concat(qn, F.lit("."), F.col("name")))


def _blocks(start, end) -> Column:
    """The aligned blocks (k, at), 2 ** k lines each, that make up the lines ``start`` to ``end``: at most two of a size."""
    def of(k):
        lo, hi = F.call_function("shiftright", start - 1, k) + 1, F.call_function("shiftright", end + 1, k)
        left, right = F.struct(k.alias("k"), lo.alias("at")), F.struct(k.alias("k"), (hi - 1).alias("at"))
        return F.array(F.when((lo < hi) & (lo % 2 != 0), left), F.when((lo < hi) & (hi % 2 != 0), right))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(end - start + 1)) - 1), of)))


def enclosing(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """``calls`` with ``caller`` and ``caller_name``: the first function or method, in file order, whose lines hold the call.

    An interval join by equal keys: lines of a function are dealt into aligned blocks, the first function of each block is
    kept, and a line looks up the blocks that hold it. So calls never meet all functions of their file. Calls outside every
    function are left out.
    """
    fun = definitions.where(F.col("kind").isin("Function", "Method") & (F.col("start_line") <= F.col("end_line")))
    first = F.struct(F.col("ordinal").alias("_o"), F.col("id").alias("_id"), F.col("name").alias("_name"))
    spans = fun.groupBy("path", F.col("start_line").cast("long").alias("_a"), F.col("end_line").cast("long").alias("_b")).agg(F.min(first).alias("_f"))
    spans = spans.select("path", "_f", F.explode(_blocks(F.col("_a"), F.col("_b"))).alias("_s"))
    spans = spans.groupBy("path", F.col("_s.k").alias("_k"), F.col("_s.at").alias("_at")).agg(F.min("_f").alias("_f"))
    tops = spans.groupBy("path").agg(F.max("_k").alias("_top"))
    lines = calls.select("path", "line").distinct().join(tops, "path").select("path", "line", F.explode(F.sequence(F.lit(0), "_top")).alias("_k"))
    lines = lines.withColumn("_at", F.call_function("shiftright", F.col("line").cast("long"), F.col("_k")))
    held = lines.join(spans, ["path", "_k", "_at"]).groupBy("path", "line").agg(F.min("_f").alias("_f"))
    return calls.join(held, ["path", "line"]).select(*calls.columns, F.col("_f._id").alias("caller"), F.col("_f._name").alias("caller_name"))


#: Up to this number of words of a key, texts meet each of them; beyond it they look up their own substrings.
FEW_WORDS = 256


def containing(texts: DataFrame, words: DataFrame, few: int = FEW_WORDS) -> DataFrame:
    """_key, _text, _word: once each, the words that a text of the same key contains. ``texts``: _key, _text; ``words``: _key, _word.

    A text meets at most ``few`` words. Of a key with more, the substrings of the text that are as long as some word are
    looked up by equality, so the work does not grow with texts times words.
    """
    texts, words = texts.distinct(), words.where("_word IS NOT NULL").distinct()
    sizes = words.groupBy("_key").agg(F.count(F.lit(1)).alias("_c"), F.collect_set(F.length("_word")).alias("_sizes"))
    sized = texts.where("_text IS NOT NULL").join(sizes, "_key")
    met = sized.where(F.col("_c") <= few).join(words, "_key").where(F.contains("_text", "_word")).select("_key", "_text", "_word")
    fitting = F.filter("_sizes", lambda n: n <= F.length("_text"))
    own = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda i: F.substring("_text", i, n))))
    looked = sized.where(F.col("_c") > few).select("_key", "_text", F.explode(F.array_distinct(own)).alias("_word"))
    return met.unionByName(looked.join(words, ["_key", "_word"], "left_semi").select("_key", "_text", "_word"))


def imported_symbols(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """path, name, target: what an imported name means: the only symbol of that name, else the first in the module's path.

    Type-only imports resolve nothing.
    """
    used = imports.where(~F.coalesce("is_type_only", F.lit(False)))
    dotted = F.regexp_replace(F.regexp_replace("source", r"^(\.{1,2}/)+|^@?/", ""), "/", ".")
    used = used.groupBy("path", "name", F.coalesce("original", "name").alias("_n"), dotted.alias("_d")).agg(F.min("ordinal").alias("_i"))
    # Equal symbols and equal imports meet once, however often they stand.
    named = definitions.where(F.col("kind").isin(CALLABLE)).select(F.col("name").alias("_n"), F.col("id").alias("_id")).distinct()
    only = named.groupBy("_n").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_k"))
    sure = used.join(only.where("_k = 1"), "_n").select("path", "name", "_i", "_id")
    several = named.join(only.where("_k > 1").select("_n"), "_n", "left_semi")
    held = containing(several.select(F.col("_n").alias("_key"), F.col("_id").alias("_text")), used.select(F.col("_n").alias("_key"), F.col("_d").alias("_word")))
    held = held.groupBy(F.col("_key").alias("_n"), F.col("_word").alias("_d")).agg(F.min("_text").alias("_id"))
    found = sure.unionByName(used.join(held, ["_n", "_d"]).select("path", "name", "_i", "_id"))
    best = found.groupBy("path", "name").agg(F.min(F.struct("_i", "_id")).alias("_f"))
    return best.select("path", "name", F.col("_f._id").alias("target"))


def resolve_calls(calls: DataFrame, imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """source_id, target_id, type, confidence, resolution_method: each call's best tier, no call of itself.

    Tiers: imported name, definition in the same file, only symbol of that name, class behind ``new``. Of calls with equal
    ends and type the first counts.
    """
    made = enclosing(calls, definitions)
    named = definitions.where(F.col("kind").isin(CALLABLE))
    same = named.groupBy("path", F.col("name").alias("callee")).agg(F.min(F.struct("ordinal", "id")).alias("_s")).select("path", "callee", F.col("_s.id").alias("_same"))
    unique = named.groupBy(F.col("name").alias("callee")).agg(F.min("id").alias("_unique"), F.max("id").alias("_last")).where("_unique = _last").drop("_last")
    classes = named.where("kind = 'Class'").groupBy(F.col("name").alias("callee")).agg(F.min("id").alias("_class"))
    by_import = imported_symbols(imports, definitions).select("path", F.col("name").alias("callee"), F.col("target").alias("_import"))
    out = made.join(by_import, ["path", "callee"], "left").join(same, ["path", "callee"], "left").join(unique, "callee", "left").join(classes, "callee", "left")
    tiers = [("import", F.col("_import")), ("same_file", F.col("_same")), ("unique_name", F.col("_unique")), ("class", F.when(F.coalesce("is_new", F.lit(False)), F.col("_class")))]
    pick = lambda value: F.coalesce(*[F.when(c.isNotNull(), value(t, c)) for t, c in tiers])
    out = out.select(
        "path", "ordinal", F.col("caller").alias("source_id"), pick(lambda t, c: c).alias("target_id"), F.when(F.coalesce("is_async", F.lit(False)), "ASYNC_CALLS").otherwise("CALLS").alias("type"),
        pick(lambda t, c: F.lit(TIERS[t])).alias("confidence"), pick(lambda t, c: F.lit(t)).alias("resolution_method"),
    ).where("target_id IS NOT NULL AND target_id <> source_id")
    first = out.groupBy("source_id", "target_id", "type").agg(F.min(F.struct("path", "ordinal", "confidence", "resolution_method")).alias("_f"))
    return first.select("source_id", "target_id", "type", F.col("_f.confidence").alias("confidence"), F.col("_f.resolution_method").alias("resolution_method"))


def segments(path) -> Column:
    """Lower-case segments of a URL or route without query and fragment; parameters become ``*``."""
    plain = F.regexp_replace(path, r"[?#].*$", "")
    parts = F.filter(F.split(plain, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(WILDCARD), "*").otherwise(F.lower(s)))


def match_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """``requests`` (request_id, url, method) with route_id, confidence, resolution_method of their best route.

    Equal numbers of segments are an equi join; segments match where equal or where either is a parameter. A literal match
    goes before a template, then the first route. ``routes``: route_id, route_path, method, ordinal.
    """
    left = requests.select("request_id", "url", F.upper("method").alias("_m"), segments(F.col("url")).alias("_u")).withColumn("_n", F.size("_u"))
    right = routes.select("route_id", F.col("ordinal").alias("_o"), F.upper("method").alias("_rm"), segments(F.col("route_path")).alias("_r")).withColumn("_n", F.size("_r"))
    # The first literal segments agree in most matches, but a parameter may stand anywhere: only the count is a safe key.
    fits = F.forall(F.zip_with("_u", "_r", lambda u, r: (u == r) | (u == "*") | (r == "*")), lambda x: x)
    literal = F.forall(F.zip_with("_u", "_r", lambda u, r: (u != "*") & (r != "*")), lambda x: x)
    hit = left.join(right, "_n").where(((F.col("_rm") == "*") | (F.col("_rm") == F.col("_m"))) & fits)
    hit = hit.withColumn("_c", F.when(literal, ROUTE_LITERAL).otherwise(ROUTE_TEMPLATE))
    best = hit.groupBy("request_id").agg(F.min(F.struct((-F.col("_c")).alias("c"), "_o", "route_id")).alias("_b"))
    return best.select("request_id", F.col("_b.route_id").alias("route_id"), (-F.col("_b.c")).alias("confidence"), F.when(F.col("_b.c") == -ROUTE_LITERAL, "url_literal").otherwise("url_template").alias("resolution_method"))


def guess_routes(callers: DataFrame, routes: DataFrame) -> DataFrame:
    """Callers without a static URL (request_id, caller_name, method) with the route whose words their name holds most.

    A score starts at 0.3, gains 0.1 for each literal segment that the name contains and stops at 0.5; methods must agree
    where the caller's is not ``*``. The method is the join key; callers of any method meet every route.
    """
    words = F.filter(F.split(F.lower("route_path"), "/"), lambda s: (s != "") & ~s.rlike(WILDCARD) & ~s.startswith(":"))
    right = routes.select("route_id", F.col("ordinal").alias("_o"), words.alias("_w"), F.explode(F.array_distinct(F.array(F.upper("method"), F.lit("*")))).alias("_m"))
    left = callers.select("request_id", F.lower("caller_name").alias("_c"), F.upper("method").alias("_m"))
    held = F.size(F.filter("_w", lambda w: F.contains(F.col("_c"), w)))
    scored = left.join(right, "_m").withColumn("_s", F.least(F.lit(HEURISTIC_BASE) + HEURISTIC_STEP * held, F.lit(HEURISTIC_CAP)))
    best = scored.groupBy("request_id").agg(F.min(F.struct((-F.col("_s")).alias("s"), "_o", "route_id")).alias("_b"))
    return best.select("request_id", F.col("_b.route_id").alias("route_id"), F.round(-F.col("_b.s"), 6).alias("confidence"), F.lit("heuristic").alias("resolution_method"))


def subject_path(path) -> Column:
    """The file that a test file is about."""
    return F.regexp_replace(F.regexp_replace(path, r"\.(test|spec)\.([^.]+)$", ".$2"), r"(_test|_spec)\.([^.]+)$", ".$2")


def test_edges(definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """source_id, target_id of TESTS edges: functions named in a test's name, and functions a test file imports from its subject."""
    tests = definitions.where(F.col("path").rlike(TEST_FILE) & F.col("kind").isin("Function", "Test"))
    tests = tests.select(F.col("path").alias("_test_path"), subject_path(F.col("path")).alias("path"), F.col("id").alias("source_id"), F.lower("name").alias("_t")).distinct()
    functions = definitions.where(F.col("kind").isin("Function", "Method")).select("path", F.col("id").alias("target_id"), "name").distinct()
    named = functions.select("path", F.lower("name").alias("_word"), "target_id")
    held = containing(tests.select(F.col("path").alias("_key"), F.col("_t").alias("_text")), named.select(F.col("path").alias("_key"), "_word"))
    held = held.select(F.col("_key").alias("path"), F.col("_text").alias("_t"), "_word")
    by_name = tests.join(held, ["path", "_t"]).join(named, ["path", "_word"]).select("source_id", "target_id")
    used = imports.select(F.col("path").alias("_test_path"), "source", F.coalesce("original", "name").alias("name"))
    subject = tests.join(used, "_test_path").where(F.contains("source", F.element_at(F.split(without_extension(F.col("path")), "/"), -1)))
    candidates = subject.join(functions.withColumnRenamed("path", "_own"), "name")
    best = candidates.groupBy("source_id", "name").agg(F.min(F.struct((F.col("_own") != F.col("path")).alias("far"), "target_id")).alias("_b"))
    return by_name.unionByName(best.select("source_id", F.col("_b.target_id").alias("target_id"))).where("source_id <> target_id").distinct()


def heritage(definitions: DataFrame) -> DataFrame:
    """source_id, target_id, type: EXTENDS and IMPLEMENTS edges to the first class or interface of the name."""
    bases = definitions.where(F.col("kind").isin("Class", "Interface"))
    first = bases.groupBy(F.col("name").alias("_n")).agg(F.min(F.struct("path", "ordinal", "id")).alias("_f")).select("_n", F.col("_f.id").alias("target_id"))
    up = bases.where("extends_clause IS NOT NULL").select(F.col("id").alias("source_id"), F.col("extends_clause").alias("_n"), F.lit("EXTENDS").alias("type"))
    up = up.unionByName(bases.select(F.col("id").alias("source_id"), F.explode("implements").alias("_n"), F.lit("IMPLEMENTS").alias("type")))
    return up.join(first, "_n").where("source_id <> target_id").select("source_id", "target_id", "type").distinct()


def joined_path(folder, source) -> Column:
    """A relative import joined to its folder, with ``.`` and ``..`` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", folder, source), "/"), lambda s: (s != "") & (s != "."))
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when((s == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_join(walk, "/")


def import_edges(imports: DataFrame, files: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(edges, packages): IMPORTS edges of files, to files for relative sources and to package nodes for others.

    A file answers to its path, its path without extension and, as an index file, to its folder. ``files``: path.
    """
    bare = without_extension(F.col("path"))
    keys = F.array(F.col("path"), bare, F.when(F.col("path").rlike(r"/index\.[^.]+$"), F.regexp_replace("path", r"/index\.[^.]+$", "")))
    known = files.select(F.posexplode(keys).alias("_p", "_key"), file_qn(project, F.col("path")).alias("_target")).where("_key IS NOT NULL")
    known = known.groupBy("_key").agg(F.min(F.struct("_p", "_target")).alias("_f")).select("_key", F.col("_f._target").alias("target_id"))
    rows = imports.select("path", "source").distinct().withColumn("source_id", file_qn(project, F.col("path")))
    near = rows.where(F.col("source").startswith("."))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    at = joined_path(folder, F.col("source"))
    tries = F.array(at, F.concat(at, F.lit("/index")), *[F.concat(at, F.lit("." + e)) for e in EXTENSIONS])
    found = near.select("source_id", "source", F.posexplode(tries).alias("_p", "_key")).join(known, "_key")
    best = found.groupBy("source_id", "source").agg(F.min(F.struct("_p", "target_id")).alias("_f")).select("source_id", F.col("_f.target_id").alias("target_id"))
    name = F.when(F.col("source").startswith("@"), F.array_join(F.slice(F.split("source", "/"), 1, 2), "/")).otherwise(F.element_at(F.split("source", "/"), 1))
    far = rows.where(~F.col("source").startswith(".")).select("source_id", name.alias("name"), F.concat(F.lit(f"{project}.__pkg_"), F.regexp_replace(name, "[^a-zA-Z0-9]", "_")).alias("target_id"))
    packages = far.select(F.col("target_id").alias("id"), "name").distinct()
    return best.unionByName(far.select("source_id", "target_id")).distinct().withColumn("type", F.lit("IMPORTS")), packages


def typeof_edges(sites: DataFrame, definitions: DataFrame, project: str) -> DataFrame:
    """source_id, target_id, pattern, patterns, line, context: every symbol a typeof site may mean, merged per pair.

    The first site gives pattern, line and context; patterns are distinct. ``sites``: path, ordinal, symbol, pattern, line, context.
    """
    named = definitions.select(F.col("name").alias("symbol"), F.col("id").alias("target_id")).distinct()
    rows = sites.withColumn("source_id", file_qn(project, F.col("path"))).join(named, "symbol")
    merged = rows.groupBy("source_id", "target_id").agg(F.min(F.struct("line", "ordinal", "pattern", "context")).alias("_f"), F.array_sort(F.collect_set("pattern")).alias("patterns"))
    return merged.select("source_id", "target_id", F.col("_f.pattern").alias("pattern"), "patterns", F.col("_f.line").alias("line"), F.col("_f.context").alias("context"))


def alias_closure(exports: DataFrame, most: int = 20) -> DataFrame:
    """name, origin: re-exported names followed to where they are declared. ``exports``: name, target.

    Names double their distance each round, so chains of ``2 ** most`` are followed; cycles give nothing.
    """
    from loomgraph.operators.paths import saved

    now = saved(exports.select("name", F.col("target").alias("origin")).distinct())
    for _ in range(most):
        next_ = now.select(F.col("name").alias("origin"), F.col("origin").alias("_on"))
        now_, moved = now, now.join(next_.select("origin"), "origin", "left_semi")
        if moved.isEmpty():
            break
        now = saved(now_.join(next_, "origin", "left").select("name", F.coalesce("_on", "origin").alias("origin")).where("name <> origin").distinct())
    return now.join(now.select(F.col("name").alias("origin")).distinct(), "origin", "left_anti").select("name", "origin")


def reference_edges(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """source_id, target_id of REFERENCES edges from functions to the types, decorators and tags they name, once a pair.

    ``references``: path, ordinal, line, symbol. Names resolve to the only symbol of the name.
    """
    held = enclosing(references, definitions)
    unique = definitions.groupBy(F.col("name").alias("symbol")).agg(F.min("id").alias("target_id"), F.max("id").alias("_l")).where("target_id = _l")
    return held.join(unique, "symbol").select(F.col("caller").alias("source_id"), "target_id").where("source_id <> target_id").distinct()


# Decorators that mark an entry point when it is defined, and when it is enriched.
DEFINED_ENTRY = ["Get", "Post", "Put", "Delete", "Patch", "Controller", "Injectable", "Component", "Module", "Resolver", "Middleware"]
ENRICHED_ENTRY = [
    "Get", "Post", "Put", "Delete", "Patch", "Controller", "Injectable", "Module", "Component", "Directive", "Pipe", "app.get", "app.post",
    "route", "before_request", "after_request", "api_view", "main", "cli", "command",
]


def entry_point(name="name", path="path", decorators="decorators", is_default="is_default", is_exported="is_exported") -> Column:
    """Whether a function is an entry point: by name, decorator, test file or index file."""
    index = F.col(path).rlike(r"/index\.[^.]+$")
    marked = F.arrays_overlap(decorators, F.array(*[F.lit(x) for x in dict.fromkeys(DEFINED_ENTRY + ENRICHED_ENTRY)]))
    off = F.lit(False)
    return (F.col(name) == "main") | F.coalesce(marked, off) | F.col(path).rlike(r"\.(test|spec)\.[^.]+$") | (index & (F.coalesce(is_default, off) | F.coalesce(is_exported, off)))


# Files that may well have no symbols.
SUPPRESSED = [
    r"\.config\.[cm]?[jt]s$", r"(?:^|[\\/])\.dependency-cruiser\.[cm]?[jt]s$", r"(?:^|[\\/])vitest\.config\.[cm]?[jt]s$", r"(?:^|[\\/])jest\.config\.[cm]?[jt]s$",
    r"(?:^|[\\/])hooks[\\/][^/\\]+\.[cm]?js$", r"(?:^|[\\/])(?:sw|service-?[Ww]orker)\.js$", r"\.(?:data|constants)\.[cm]?[jt]s$",
]


def parse_anomalies(files: DataFrame) -> DataFrame:
    """metric, n, files: files with parse errors, and files that ought to have symbols but have none.

    ``files``: path, line_count, has_error, definitions, exports, imports, calls (the last four are counts).
    """
    calm = F.lit(False)
    for p in SUPPRESSED:
        calm = calm | F.col("path").rlike(p)
    silent = (F.col("definitions") == 0) & (F.col("line_count") > 30) & (F.col("exports") == 0) & (F.col("calls") + F.col("imports") > 0) & ~calm
    metric = F.when(F.col("has_error"), "parse_errors").when(silent, "files_without_symbols")
    return files.withColumn("metric", metric).where("metric IS NOT NULL").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("files"))


def folders(files: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(folders, edges): every ancestor folder of every file once, CONTAINS_FOLDER and CONTAINS_FILE edges."""
    parts = F.split("path", "/")
    own = files.select("path", parts.alias("_p")).withColumn("_n", F.size("_p"))
    up = F.transform(F.when(F.col("_n") > 1, F.sequence(F.lit(1), F.col("_n") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("_p", 1, i), "/"))
    found = own.select(F.explode(up).alias("path")).distinct()
    qn = lambda p: F.when(p == "", F.lit(project)).otherwise(F.concat(F.lit(f"{project}.folder."), p))
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    down = found.select(qn(parent).alias("source_id"), qn(F.col("path")).alias("target_id"), F.lit("CONTAINS_FOLDER").alias("type"))
    held = files.select(qn(parent).alias("source_id"), file_qn(project, F.col("path")).alias("target_id"), F.lit("CONTAINS_FILE").alias("type"))
    return found.select(qn(F.col("path")).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "path"), down.unionByName(held)
