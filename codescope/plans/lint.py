"""Rules over a source tree: facts once, then one declarative branch per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codescope import functions as fn
from codescope import shared
from codescope.operators import rules, search, tables
from codescope.plans import report
from codescope.sources import code, imports, python_facts, token_facts, token_imports, tree

#: Limits and severities of the rules, called, short and builtin names that say nothing.
DEFAULTS: dict[str, dict] = {
    "structural.complexity.cyclomatic": {"enabled": True, "severity": "error", "threshold": 10},
    "structural.complexity.cognitive": {"enabled": True, "severity": "error", "threshold": 15},
    "structural.complexity.npath": {"enabled": True, "severity": "error", "threshold": 400},
    "structural.class.complexity": {"enabled": True, "severity": "error", "threshold": 40},
    "structural.class.coupling": {"enabled": True, "severity": "error", "threshold": 8},
    "structural.class.inheritance.depth": {"enabled": True, "severity": "error", "threshold": 4},
    "structural.class.inheritance.children": {"enabled": True, "severity": "error", "threshold": 10},
    "structural.packages": {"enabled": True, "severity": "warning", "threshold": 0.7, "fail_on_zone": ["pain"]},
    "structural.deps": {"enabled": True, "severity": "error", "threshold": 0},
    "structural.local_imports": {"enabled": True, "severity": "warning", "threshold": 0},
    "structural.redundancy": {"enabled": True, "severity": "warning", "min_shared": 3, "threshold": 0.5},
    "structural.types.sentinels": {"enabled": True, "severity": "warning", "threshold": 8},
    "structural.types.hidden_mutators": {"enabled": True, "severity": "warning", "threshold": 1},
    "structural.types.escape_hatches": {"enabled": True, "severity": "warning", "threshold": 0.30, "min_annotations": 5},
    "structural.duplication": {"enabled": True, "severity": "warning", "threshold": 0.05, "min_leaf_nodes": 10, "min_cluster_size": 2},
    "structural.hotspots": {"enabled": True, "severity": "error", "since": "14 days ago", "min_commits": 2, "fail_on_quadrant": ["hotspot"]},
    "structural.god_module": {"enabled": True, "severity": "warning", "threshold": 20},
    "structural.orphans": {"enabled": False, "severity": "warning", "threshold": 0, "min_confidence": "high"},
    "information.volume": {"enabled": True, "severity": "error", "threshold": 1500, "alpha": 0.0},
    "information.difficulty": {"enabled": True, "severity": "error", "threshold": 30},
    "information.magic_literals": {"enabled": True, "severity": "warning", "threshold": 3},
    "information.section_comments": {"enabled": True, "severity": "warning", "threshold": 2},
    "lexical.stutter": {"enabled": True, "severity": "warning", "threshold": 2},
    "lexical.verbosity": {"enabled": True, "severity": "warning", "threshold": 3.0, "min_identifiers": 5},
    "lexical.tersity": {"enabled": True, "severity": "warning", "threshold": 0.50, "max_len": 2, "min_identifiers": 5},
}
#: By language, a type that says nothing, and any type.
HATCHES = {
    "python": (r"\bAny\b", r"(?:->|:\s)[A-Za-z_\[\]|, ]+"),
    "typescript": (r":\s*any\b", r":\s*[A-Za-z_][A-Za-z0-9_\[\]|<>, ]*"),
    "javascript": (r"@type\s*\{any\}", r"@type\s*\{[^\}]+\}"),
    "go": (r"(?:interface\{\}|\bany\b)", r"(?:func\b|var\b|\btype\b|\bmap\[)"),
    "rust": (r"dyn\s+Any\b", r"(?:fn\s+\w+\s*\(|:\s*(?:Box|Vec|Arc|Rc|Option|Result)<)"),
    "java": (r"\bObject\b(?:\s*[,\)]|\s*\{|\s*throws)", r"(?:public|private|protected|static)\s+\w+\s+\w+\s*\("),
    "c_sharp": (r"\b(?:object|dynamic)\b", r"(?:public|private|protected|internal|static)\s+(?:\w+[\[\]?]*\s+){1,3}\w+\s*[({]"),
    "julia": (r"::\s*Any\b", r"::[A-Za-z_]\w*"),
    "c": (r"\bvoid\s*\*", r"(?:^|[\s,(])(?:const\s+|register\s+|volatile\s+|restrict\s+|static\s+|extern\s+|inline\s+|auto\s+)*(?:unsigned\s+|signed\s+)?(?:int|char|float|double|long|short|void|size_t|ssize_t|int\d{1,2}_t|uint\d{1,2}_t|ptrdiff_t|struct\s+\w+|enum\s+\w+|union\s+\w+|[A-Z]\w*_t|[A-Z]\w*)\s*\*?\s*\w+\s*[,;()=\[]"),
    "cpp": (r"\bvoid\s*\*|\bstd::any\b", r"(?:^|[\s,(])(?:const\s+|volatile\s+|static\s+|extern\s+|inline\s+|constexpr\s+|consteval\s+|mutable\s+|register\s+|restrict\s+|auto\s+)*(?:unsigned\s+|signed\s+)?(?:int|char|float|double|long|short|void|bool|size_t|ssize_t|int\d{1,2}_t|uint\d{1,2}_t|ptrdiff_t|struct\s+\w+|enum\s+\w+|union\s+\w+|class\s+\w+|[A-Z]\w*_t|std::\w+(?:<[^>]*>)?|[A-Z]\w*(?:<[^>]*>)?)\s*[*&]?\s*\w+\s*[,;()=\[{]"),
}
#: Above them a class is spoken of, whatever the rules' limits are.
CLASS_LIMITS = {"cbo": 8, "dit": 3, "noc": 10, "wmc": 50}
#: Languages whose sources are read.
LANGUAGES = ["python", *token_facts.LANGUAGES]
SHORT_NAMES = ["i", "j", "k", "x", "y", "z", "ok", "n"]
#: Total orders of reports, falling with a minus, and nulls last.
ORDERS = {
    "complexity": ["-ccx", "-cog", "file", "line"], "npath": ["-npath", "file", "line"], "halstead": ["-volume", "file", "line"], "classes": ["-cbo", "-wmc", "name", "file", "line"],
    "packages": ["-distance", "node", "lang"], "clones": ["-size", "file", "line"], "hotspots": ["-score", "-sum_ccx", "-loc_delta", "file"],
}
#: Members of a clone cluster that its metadata names.
NAMED = 10
#: Languages whose classes may be declared in several places; whose anonymous functions count among all.
OPEN = ["ruby"]
VALUES_COUNT = ["javascript", "typescript", "cpp", "ruby"]
#: Languages whose packages the rule looks at unless others are named.
PACKAGED = ["go", "python", "java", "c_sharp", "typescript", "javascript", "rust"]
COMMON_NAMES = "run main setup init start stop get set update create delete load save process execute handle build parse check validate".split()
#: By language, callees that say nothing about a function; other languages have none.
STOPS: dict[str, list[str]] = {
    "python": [
        "print", "len", "range", "sorted", "reversed", "enumerate", "zip", "map", "filter", "any", "all", "sum", "min", "max", "abs", "round", "list", "dict", "set", "tuple", "str", "int", "float", "bool", "isinstance",
        "issubclass", "type", "id", "hash", "repr", "getattr", "setattr", "hasattr", "delattr", "callable", "iter", "next", "open", "input", "super", "vars", "dir", "locals", "globals", "staticmethod", "classmethod", "property",
        "Exception", "ValueError", "TypeError", "KeyError", "IndexError", "AttributeError", "RuntimeError", "StopIteration", "NotImplementedError", "True", "False", "None",
    ],
    "c": [
        "malloc", "calloc", "realloc", "free", "alloca", "memcpy", "memmove", "memset", "memcmp", "strlen", "strcpy", "strncpy", "strcat", "strncat", "strcmp", "strncmp", "strdup", "strchr", "strrchr", "strstr", "strtok", "strerror",
        "printf", "fprintf", "sprintf", "snprintf", "vprintf", "scanf", "fscanf", "sscanf", "fopen", "fclose", "fread", "fwrite", "fseek", "ftell", "fgets", "fputs", "fgetc", "fputc", "feof", "fflush", "ferror",
        "atoi", "atol", "atoll", "atof", "abort", "exit", "_exit", "atexit", "getenv", "setenv", "unsetenv", "assert", "perror", "errno",
    ],
    "ruby": [
        "puts", "print", "pp", "raise", "require", "require_relative", "load", "attr_reader", "attr_writer", "attr_accessor", "include", "extend", "prepend", "lambda", "proc", "new", "to_s", "to_i", "to_a", "to_h", "to_sym",
        "inspect", "send", "public_send", "freeze", "dup", "clone", "kind_of?", "is_a?", "respond_to?", "nil?", "empty?", "each", "map", "select", "reject", "reduce", "inject", "find", "any?", "all?", "none?", "first", "last",
        "size", "length", "count", "include?", "<<", "push", "pop", "shift", "unshift", "sort", "sort_by", "uniq", "flatten", "keys", "values", "fetch",
    ],
}
#: C++ has those of C, too.
STOPS["cpp"] = STOPS["c"] + [
    "make_unique", "make_shared", "move", "forward", "begin", "end", "cbegin", "cend", "rbegin", "rend", "size", "empty", "front", "back", "push_back", "pop_back", "emplace", "emplace_back", "insert", "erase", "find", "count",
    "data", "clear", "reserve", "resize", "to_string", "stoi", "stol", "stof", "stod", "min", "max", "swap", "abs", "get", "set",
]
#: Rules that look at all languages whatever is set.
EVERY_LANGUAGE = frozenset(["structural.deps", "structural.local_imports", "structural.hotspots"])


def once(make):
    """A table of :class:`Metrics` that several rules read: made and kept on first use."""

    def get(self) -> DataFrame:
        if make.__name__ not in self.kept:
            self.kept[make.__name__] = make(self).persist()
        return self.kept[make.__name__]

    get.__doc__ = make.__doc__
    return get


class Metrics:
    """Tables of one source tree and its exported log; facts are parsed once and kept until :meth:`close`."""

    def __init__(self, spark: SparkSession, files: DataFrame, log: str | None = None, now: str | None = None, places: DataFrame | None = None, languages: list[str] | None = None) -> None:
        self.spark, self.files, self.log, self.now = spark, files, log, now
        # where paths are enough, no content is read
        self.places = files.drop("content") if places is None else places
        self.kept: dict[str, DataFrame] = {}
        shared.checkpoints(spark)
        self.kept["facts"] = self.facts = python_facts.facts(files).persist()
        # what the language setting leaves; imports and history are those of all files
        self.languages = languages or LANGUAGES
        self.spoken = self.facts if languages is None else self.facts.filter(F.col("lang").isin(languages))
        self.functions = self.spoken.filter("kind = 'function'")
        self.classes = self.spoken.filter("kind = 'class'")

    def close(self) -> None:
        for table in self.kept.values():
            table.unpersist()
        self.kept.clear()

    @once
    def class_metrics(self) -> DataFrame:
        """CBO, DIT, NOC and WMC of each class.

        Where classes are open (``OPEN``), declarations of one name are one class:
        WMC and methods add up, the largest CBO counts, what they inherit from is
        joined, and the first one, by file and line, gives the place. Depths and
        children are those of merged classes.
        """
        c = self.classes.select("file", "lang", "name", "line", "end_line", "bases", "used", F.col("definitions").alias("method_count"))
        names = c.select(F.col("name").alias("known")).distinct()
        uses = c.select("file", "name", "line", F.explode(F.array_union("bases", "used")).alias("known")).distinct()
        cbo = uses.join(names, "known").filter("known <> name").groupBy("file", "name", "line").agg(F.count("*").alias("cbo"))
        f = self.functions.select("file", F.col("line").alias("at"), "ccx", F.col("name").alias("fn"), "owner")
        inside = f.join(c.select("file", "name", "line", "end_line"), "file").filter("at between line and end_line")
        best = inside.groupBy("file", "at", "fn", "ccx").agg(F.min(F.struct((F.col("end_line") - F.col("line")).alias("w"), "line", "name")).alias("b")).select("file", F.col("b.name").alias("name"), F.col("b.line").alias("line"), "ccx")
        # a method outside of its class: of the classes with its owner's name the one in the same file, else the first
        out = f.filter("owner is not null").join(c.select("file", F.col("line").alias("start"), "end_line"), "file", "left")
        out = out.groupBy("file", "at", "fn", "ccx", "owner").agg(F.count_if(F.expr("at between start and end_line")).alias("n")).filter("n = 0")
        named = c.select(F.col("name").alias("owner"), F.col("line").alias("start"), F.col("file").alias("home"))
        first = named.groupBy("owner").agg(F.min(F.struct("home", "start")).alias("any"))
        near = named.groupBy("owner", F.col("home").alias("file")).agg(F.min("start").alias("near"))
        out = out.join(first, "owner").join(near, ["owner", "file"], "left")
        out = out.select(F.when(F.col("near").isNotNull(), F.col("file")).otherwise(F.col("any.home")).alias("file"), F.col("owner").alias("name"), F.coalesce("near", "any.start").alias("line"), "ccx")
        wmc = best.unionByName(out).groupBy("file", "name", "line").agg(F.sum("ccx").alias("wmc"))
        key = ["file", "name", "line"]
        declared = c.drop("used").join(cbo, key, "left").join(wmc, key, "left").na.fill(0, ["cbo", "wmc"])
        is_open = F.col("lang").isin(OPEN)
        one = tables.merged(declared.filter(is_open), ["lang", "name"], ["file", "line"], ["wmc", "method_count"], ["cbo"], ["bases"], ["end_line"])
        whole = declared.filter(~is_open).unionByName(one.select(declared.columns))
        noc = whole.select(F.explode("bases").alias("name")).groupBy("name").agg(F.count("*").alias("noc"))
        parent = whole.select("name", F.explode_outer(F.array_remove("bases", F.col("name"))).alias("parent")).join(names.withColumnRenamed("known", "parent").withColumn("here", F.lit(True)), "parent", "left")
        parent = parent.groupBy(F.col("name").alias("id")).agg(F.min(F.when(F.col("here"), F.col("parent"))).alias("parent"))
        dit = tables.depth(parent).select(F.col("id").alias("name"), F.col("depth").alias("dit"))
        rows = whole.join(noc, "name", "left").join(dit, "name", "left").na.fill(0, ["noc", "dit"])
        return rows.withColumn("interpretation", report.exceeded({c: (F.col(c), limit) for c, limit in CLASS_LIMITS.items()}))

    def text_imports(self) -> DataFrame:
        """Imports by lines, of files that couldn't be read and of languages that have no syntax for them here."""
        bad = self.facts.filter("kind = 'error'").select(F.col("file").alias("path")).distinct()
        return imports.text_imports(self.files.filter(~F.col("lang").isin("python", *token_imports.LANGUAGES)).unionByName(self.files.filter(F.col("lang").isin(list(token_imports.LANGUAGES))).join(bad, "path", "left_semi").select(self.files.columns)))

    @once
    def imports(self) -> DataFrame:
        """``src``, ``line``, ``module`` of all imports, by syntax and else by lines; Python's relative ones have no name to look for."""
        parsed = self.facts.filter("kind = 'import' and not (lang = 'python' and startswith(name, '.'))").select(F.col("file").alias("src"), "line", F.col("name").alias("module"))
        return parsed.unionByName(self.text_imports().select(F.col("file").alias("src"), "line", "module"))

    @once
    def import_edges(self) -> DataFrame:
        """Distinct file-to-file edges; see :func:`codescope.sources.imports.resolved`."""
        return imports.resolved(self.imports().select("src", "module"), self.places.filter("lang is not null"))

    def file_deps(self, target: str | None = None, most: int | None = None) -> DataFrame:
        """Language, imports in their order, Ca, Ce and instability of each file, most depended upon first; of one file with ``target``.

        Who imports a file is in :meth:`import_edges`.
        """
        made = self.imports().groupBy(F.col("src").alias("path")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line", "module"))), lambda x: x["module"])).alias("imports"))
        rows = self.places.filter("lang is not null").select("path", "lang").join(made, "path", "left").join(tables.degrees(self.import_edges()).withColumnRenamed("node", "path"), "path", "left")
        rows = rows.na.fill(0, ["ca", "ce"]).withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
        if target is not None:
            rows = rows.filter(F.col("path") == target)
        return tables.capped(rows, [F.desc("ca"), F.asc("path")], most)

    def cycles(self, target: str | None = None) -> DataFrame:
        """``node`` and ``component`` of import cycles; with ``target`` of those that hold this file."""
        found = tables.cycles(self.import_edges())
        return found if target is None else found.join(found.filter(F.col("node") == target).select("component"), "component", "left_semi").select("node", "component")

    def unused_modules(self, least_length: int = 4, most: int = 0) -> DataFrame:
        """Files whose name at most ``most`` lines of other files hold as a word, with the confidence that they are dead."""
        stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"(?<=.)\.[^.]+$", "")
        stems = self.places.filter("lang is not null").select(F.col("path").alias("file"), stem.alias("symbol")).filter(F.length("symbol") >= least_length)
        rows = search.word_references(stems, imports.lines(self.files.filter("lang is not null")).withColumnRenamed("file", "path"), "file", "symbol", "path", "text")
        return rows.filter(F.col("refs") <= most).withColumn("confidence", fn.confidence(F.col("symbol"), F.lit(False), F.col("symbol").isin(COMMON_NAMES)))

    def packages(self, languages: list[str] | None = None, most: int | None = None, mains: bool = False) -> DataFrame:
        """Files, coupling, abstractness, distance and zone of each package, the most distant first; one row for each language of a directory.

        Python's packages are directories with an ``__init__.py``, those of the
        other languages all that hold files of theirs. Go's ``main`` packages are
        out unless ``mains``. Imports between languages don't count. Types are
        those that the sources declare (:mod:`codescope.sources.inventory`); a
        package without any has no abstractness and is of unknown zone.
        """
        parent = F.regexp_replace("path", "/?[^/]+$", "")
        place = F.when(parent == "", ".").otherwise(parent)
        every = self.places.filter(F.col("lang").isin([x for x in languages or LANGUAGES if x in self.languages])).select("path", "lang", place.alias("node"))
        homes = every.filter((F.col("lang") != "python") | F.col("path").rlike(r"(^|/)__init__\.py$")).select("lang", "node").distinct()
        if not mains:
            heads = self.lines().filter((F.col("lang") == "go") & (F.col("at") <= 20) & F.col("text").rlike(r"^\s*package\s+main\b")).select(F.col("file").alias("path")).distinct()
            homes = homes.join(every.join(heads, "path").select("lang", "node").distinct(), ["lang", "node"], "left_anti")
        of = every.join(homes, ["lang", "node"])
        a = of.select(F.col("path").alias("src"), F.col("lang").alias("la"), F.col("node").alias("a"))
        b = of.select(F.col("path").alias("dst"), F.col("lang").alias("lb"), F.col("node").alias("b"))
        edges = self.import_edges().join(a, "src").join(b, "dst").filter("la = lb and a <> b")
        degrees = tables.degrees(edges.select(F.struct(F.col("la").alias("lang"), F.col("a").alias("node")).alias("src"), F.struct(F.col("lb").alias("lang"), F.col("b").alias("node")).alias("dst")))
        kinds = self.facts.filter("kind = 'type'").join(of.select(F.col("path").alias("file"), "node"), "file").groupBy("lang", "node").agg(F.count_if("abstract").alias("na"), F.count_if(~F.col("abstract")).alias("nc"))
        m = of.groupBy("lang", "node").agg(F.count("*").alias("files")).join(degrees.select("node.*", "ca", "ce"), ["lang", "node"], "left").join(kinds, ["lang", "node"], "left").na.fill(0, ["ca", "ce", "na", "nc"])
        i, ab = fn.instability(F.col("ca"), F.col("ce")), fn.abstractness(F.col("na"), F.col("nc"))
        d = F.abs(ab + i - 1)
        rows = m.withColumns({"instability": i, "abstractness": ab, "distance": d, "zone": fn.package_zone(i, ab, d)})
        return rows if most is None else tables.capped(rows, [F.desc_nulls_last("distance"), F.asc("node"), F.asc("lang")], most)

    @once
    def halstead(self) -> DataFrame:
        f = self.functions.filter((F.size("operators") > 0) | (F.size("operands") > 0))
        tokens = F.col("identifiers")
        mean = F.try_divide(F.aggregate(F.transform(tokens, lambda t: F.greatest(F.lit(1), F.size(fn.split_identifier(t)))), F.lit(0), lambda a, b: a + b).cast("double"), F.size(tokens))
        return tables.halstead(f.withColumn("mean", F.coalesce(mean, F.lit(2.0))), F.col("operators"), F.col("operands"), ["file", "name", "line", "end_line", "mean"])

    def hotspots(self, since: str, min_commits: int, prefix: str = "") -> DataFrame:
        """Complexity and churn of each file, with the reason why it is out, or its score and quadrant."""
        ccx = self.facts.filter("kind = 'function'").groupBy("file").agg(F.sum("ccx").alias("sum_ccx"), F.max("ccx").alias("max_ccx"))
        commits, churn = code.commits(self.spark, self.log)
        churn = churn.join(commits.filter("parent_count <= 1").select("commit"), "commit", "left_semi")  # no merges
        start = code.since(since, self.now)
        if start is not None:
            churn = churn.filter(F.col("at") >= start)
        if prefix:
            churn = churn.filter((F.col("file") == prefix) | F.col("file").startswith(prefix.rstrip("/") + "/"))
        churned = tables.churn(churn, "file", F.col("insertions"), F.col("deletions"), "at")
        rows = tables.hotspot_join(ccx.filter("sum_ccx > 0"), churned, "file", min_commits)
        here = self.places.select(F.col("path").alias("file"), F.lit(True).alias("here"), F.col("lang").isin(LANGUAGES).alias("parsed"))
        rows = rows.join(here, "file", "left").withColumn("reject", F.when(F.col("here").isNull(), "not_on_disk").when(F.col("sum_ccx").isNull() & ~F.coalesce("parsed", F.lit(False)), "unsupported_language").otherwise(F.col("reject")))
        kept = rows.filter("reject is null").withColumn("loc_delta", F.col("insertions") - F.col("deletions"))
        kept = kept.withColumn("score", (F.col("sum_ccx") * F.greatest(F.lit(0), "loc_delta")).cast("double"))
        return tables.quadrants(kept, "sum_ccx", "loc_delta").drop("here", "parsed", "reject")

    def ranked(self, kind: str, most: int | None = None) -> DataFrame:
        """The first ``most`` rows of a kind (see ``ORDERS``) in its total order, with ``total`` and ``truncated``; all without ``most``."""
        made = {
            "complexity": lambda: self.functions.select("file", "name", "line", "end_line", "ccx", "cog", fn.complexity_zone(F.col("ccx")).alias("zone")),
            "npath": lambda: self.functions.select("file", "name", "line", "end_line", "lang", "npath"),
            "halstead": self.halstead,
            "classes": self.class_metrics,
            "packages": self.packages,
            "clones": lambda: clones(self, DEFAULTS["structural.duplication"]["min_leaf_nodes"]).filter("fp is not null").groupBy("fp").agg(F.count("*").alias("size"), F.min("at").alias("first")).filter("size >= 2").select("fp", "size", "first.*"),
            "hotspots": lambda: self.hotspots(DEFAULTS["structural.hotspots"]["since"], DEFAULTS["structural.hotspots"]["min_commits"]),
        }[kind]()
        return tables.capped(made, [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[kind]], most)

    def usages(self, symbol: str, definitions: bool = True, most: int | None = None) -> DataFrame:
        """Lines of all files that hold ``symbol`` anywhere: ``kind`` (definition or reference), ``file``, ``line``, ``content`` and, of a definition, ``symbol_type``."""
        hits = search.search(self.files.select("path", "content"), "path", "content", [symbol], mode="fixed", case="sensitive").select(F.col("path").alias("file"), "line", "content")
        at = self.facts.filter(F.col("kind").isin("function", "class", "type") & (F.col("name") == symbol)).groupBy("file", F.col("line").cast("long").alias("line")).agg(F.min("kind").alias("symbol_type"))
        rows = hits.join(at, ["file", "line"], "left") if definitions else hits.withColumn("symbol_type", F.lit(None).cast("string"))
        rows = rows.select(F.when(F.col("symbol_type").isNull(), "reference").otherwise("definition").alias("kind"), "file", "line", "content", "symbol_type")
        return tables.capped(rows, [F.asc("file"), F.asc("line")], most)

    def complexity_of_files(self, most: int | None = None) -> DataFrame:
        """Functions, sums and largest values of the files of the first ``most`` functions: what a capped report sums up is what it shows."""
        rows = self.ranked("complexity", most).groupBy("file").agg(F.count("*").alias("functions"), F.sum("ccx").alias("sum_ccx"), F.max("ccx").alias("max_ccx"), F.max("cog").alias("max_cog"))
        return rows.orderBy(F.desc("max_ccx"), "file")

    def lines(self) -> DataFrame:
        return imports.lines(self.files.filter(F.col("lang").isin(self.languages))).withColumnRenamed("line", "at")


class Run:
    """What a run found, and the status of each rule; a context that lets the tables go."""

    def __init__(self, metrics: Metrics, found: DataFrame, per_rule: DataFrame, skipped: int) -> None:
        self.metrics, self.found, self.per_rule, self.skipped = metrics, found, per_rule, skipped

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_) -> None:
        self.found.unpersist()
        self.metrics.close()


def run(spark: SparkSession, root: str, config: dict[str, dict], waivers: list[dict] | None = None, today: str = "0001-01-01", log: str | None = None, excludes: list[str] | None = None, now: str | None = None, languages: list[str] | None = None) -> Run:
    """Run the rules of ``config`` that are enabled, over all languages or those named (but for ``EVERY_LANGUAGE``).

    A rule that fails is an error of its own and leaves the others alone. Rules
    over history need ``log``, an exported log; without one they are skipped.
    """
    places = code.places(spark, root, excludes=excludes)
    m = Metrics(spark, tree.contents(places, root), log, now, places, languages)
    on = {name: c for name, c in config.items() if c["enabled"] and c["severity"] != "off" and (log or name not in NEED_LOG)}
    out, errors = _empty(spark), {}
    for name, c in on.items():
        try:
            rows = BRANCHES[name](m, c, name).persist()
            rows.count()  # an error shows here, not in the report
            m.kept[name] = rows
            out = out.unionByName(rows)
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    found = rules.recorded(rules.waived(out, waivers or [], today), waivers or []).persist()
    files, every = (m.places.filter(F.col("lang").isin(names)).count() for names in (m.languages, LANGUAGES))
    units = {name: every if name in EVERY_LANGUAGE else files for name in on} | dict.fromkeys((n for n in on if n.startswith(("structural.complexity", "information.", "lexical."))), m.functions.count()) | dict.fromkeys((n for n in on if n.startswith("structural.class")), m.classes.count())
    return Run(m, found, report.statuses(found, on, errors, units), len(config) - len(on))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rule string, file string, line long, symbol string, severity string, value double, threshold double, metadata variant")


def lint(spark: SparkSession, root: str, config: dict[str, dict] | None = None, waivers: list[dict] | None = None, today: str = "0001-01-01", log: str | None = None) -> DataFrame:
    """All violations of a tree with the waiver of each; columns of :mod:`codescope.operators.rules`."""
    done = run(spark, root, rules.effective(DEFAULTS, config or {}), waivers, today, log)
    if bad := done.per_rule.filter("status = 'error'").select("rule", "error").collect():
        raise RuntimeError("; ".join(f"{r['rule']}: {r['error']}" for r in bad))
    return done.found


def _rule(df: DataFrame, name: str, c: dict, value, inclusive: bool = False, file="file", line="line", symbol="name", **facts) -> DataFrame:
    """Violations with what the rule knows besides: columns by their names in the metadata; True stands for the column of that name."""
    col = lambda x: None if x is None else F.col(x)
    held = {k: F.col(k) if v is True else F.col(v) if isinstance(v, str) else v for k, v in facts.items()}
    return rules.violations(df, name, F.col(file), value, c["threshold"], c["severity"], col(line), col(symbol), inclusive, held)


def _redundancy(m: Metrics, c: dict, name: str) -> DataFrame:
    stops = F.create_map(*[x for lang, names in STOPS.items() for x in (F.lit(lang), F.array(*map(F.lit, names)))])
    none = F.array().cast("array<string>")
    f = m.functions.filter("top and name <> '<lambda>'").withColumn("use", F.filter(F.array_except("callees", F.coalesce(stops[F.col("lang")], none)), lambda x: (F.length(x) >= 3) & ~x.rlike("^__.*__$")))
    uses = f.select("file", F.col("line").alias("unit"), F.explode("use").alias("item"))
    pairs = tables.sibling_overlap(uses, "file", "unit", "item", c["min_shared"], c["threshold"])
    for side in "ab":
        pairs = pairs.join(f.select("file", F.col("line").alias(f"unit_{side}"), F.col("name").alias(f"fn_{side}"), F.col("use").alias(f"use_{side}")), ["file", f"unit_{side}"])
    shared = F.sort_array(F.array_intersect("use_a", "use_b"))
    return _rule(pairs, name, c, F.col("score"), True, line="unit_a", symbol="fn_a", fn_a=True, fn_b=True, fn_a_line="unit_a", fn_b_line="unit_b", shared_callees=shared, score=True)


def _sentinels(m: Metrics, c: dict, name: str) -> DataFrame:
    params = m.functions.select("file", "name", "line", F.explode("sentinels").alias("p"))
    if c.get("require_str_annotation", True):
        params = params.filter("p.annotated")
    # every callee of a line is paired with the literals that follow it
    callees = m.lines().filter(~F.col("text").rlike(r"^\s*(async\s+)?def\s")).select("text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("name"))
    after = F.substring_index(F.regexp_replace(F.col("text"), F.concat(F.lit(r"^.*?\b"), F.col("name"), F.lit(r"\s*\(")), F.lit("")), "\n", 1)
    uses = callees.join(params.select("name").distinct(), "name", "left_semi").select("name", F.regexp_extract_all(after, F.lit(r"""["']([^"']{1,50})["']"""), F.lit(1)).alias("l")).filter(F.size("l") > 0)
    sites = uses.groupBy("name").agg(F.count("*").alias("sites"))
    literals = uses.select("name", F.explode("l").alias("literal")).distinct().groupBy("name").agg(F.count("*").alias("n"))
    # the literals themselves only where they are few enough to be reported
    few = uses.select("name", F.explode("l").alias("literal")).distinct().join(literals.filter(F.col("n") <= c["threshold"]), "name").groupBy("name").agg(F.sort_array(F.collect_list("literal")).alias("literals"))
    rows = params.join(literals, "name", "left").join(sites, "name", "left").join(few, "name", "left").na.fill(0, ["n", "sites"]).filter(F.col("n") <= c["threshold"])
    rows = _rule(rows, name, {**c, "threshold": -1}, F.col("n"), param_name=F.col("p.param"), annotated=F.col("p.annotated"), call_site_literals=F.coalesce("literals", F.array().cast("array<string>")), call_site_count="sites")
    return rows.withColumn("threshold", F.lit(float(c["threshold"])))


def _hatches(m: Metrics, c: dict, name: str) -> DataFrame:
    escape, any_type = (F.create_map(*[F.lit(x) for lang, pair in HATCHES.items() for x in (lang, pair[k])])[F.col("lang")] for k in (0, 1))
    rows = m.lines().filter(F.col("lang").isin(list(HATCHES))).select("file", "lang", "text", escape.alias("escape"), any_type.alias("any_type"))
    per = rows.groupBy("file", "lang").agg(F.count_if(F.expr("text rlike escape")).alias("a"), F.count_if(F.expr("text rlike any_type")).alias("n"))
    share = F.round(F.col("a") / F.col("n"), 4)
    return _rule(per.filter(F.col("n") >= c["min_annotations"]), name, c, share, line=None, symbol=None, language="lang", escape_count="a", total_count="n", density=share)


def _sections(m: Metrics, c: dict, name: str) -> DataFrame:
    marks = m.lines().filter(F.col("text").rlike(r"^\s*(?:#|//)\s?[-=*~+_#]{3,}")).select("file", "at")
    hits = m.functions.select("file", "lang", "name", "line", "end_line").join(marks, "file").filter("at between line and end_line")
    per = hits.groupBy("file", "lang", "name", "line").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("at")).alias("marks"))  # lines of one function
    return _rule(per, name, c, F.col("count"), divider_lines="marks", language="lang")


def _cycles(m: Metrics, c: dict, name: str) -> DataFrame:
    found = m.cycles().groupBy(F.col("component").alias("file")).agg(F.count("*").alias("count"), F.sort_array(F.collect_list("node")).alias("cycle"))  # one list of files for each cycle, as it is reported
    return _rule(found, name, c, F.col("count"), line=None, symbol=None, cycle=True)


def clones(m: Metrics, min_leaf_nodes: int) -> DataFrame:
    """``fp`` (null for small functions) and ``at`` (file, line, name) of every function that counts."""
    counted = m.functions.filter((F.col("name") != "<lambda>") | F.col("lang").isin(VALUES_COUNT))
    return counted.select(F.when(F.size("shape") >= min_leaf_nodes, fn.fingerprint(F.array_join("shape", ","))).alias("fp"), F.struct("file", "line", "name").alias("at"))


def _clones(m: Metrics, c: dict, name: str) -> DataFrame:
    """One row for the share of functions that have a twin among all, if it is over the limit, and one for each cluster; small functions have none.

    A cluster's metadata names its first ``NAMED`` members; all are in :func:`clones`.
    """
    shaped = clones(m, c["min_leaf_nodes"])
    twins = shaped.filter("fp is not null")
    sizes = twins.groupBy("fp").agg(F.count("*").alias("size"), F.min("at").alias("first")).filter("size >= 2")
    nth = F.row_number().over(Window.partitionBy("fp").orderBy("at"))
    named = twins.withColumn("nth", nth).filter(F.col("nth") <= NAMED).groupBy("fp").agg(F.sort_array(F.collect_list("at")).alias("members"))
    per = sizes.filter(F.col("size") >= c["min_cluster_size"]).join(named, "fp")
    rows = _rule(per.select("*", "first.*"), name, {**c, "threshold": c["min_cluster_size"]}, F.col("size"), True, fingerprint="fp", clone_count="size", members=True)
    total = shaped.agg(F.count("*").alias("every")).crossJoin(sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("cloned"), F.count("*").alias("groups")))  # one row each
    share = F.round(F.try_divide(F.col("cloned"), F.col("every")), 6)
    return _rule(total.withColumn("file", F.lit(".")), name, c, share, line=None, symbol=None, functions_analyzed="every", clone_fraction=share, cluster_count="groups").unionByName(rows)


def _hotspots(m: Metrics, c: dict, name: str) -> DataFrame:
    bad = m.hotspots(c["since"], c["min_commits"]).filter(F.col("quadrant").isin(c["fail_on_quadrant"]))
    rows = _rule(bad.withColumn("value", F.col("score")), name, {**c, "threshold": -1}, F.col("value"), line=None, symbol=None, quadrant=True, sum_ccx=True, loc_delta=True, commit_count=True, last_seen=F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.withColumn("threshold", F.lit(None).cast("double"))


def _literals(m: Metrics, c: dict, name: str) -> DataFrame:
    own = F.array_distinct(F.filter("literals", lambda x: ~fn.is_trivial_number(x)))
    return _rule(m.functions, name, c, F.size(own), language="lang", literals=F.sort_array(own), distinct_count=F.size(own))


def _local(m: Metrics, c: dict, name: str) -> DataFrame:
    rows = m.facts.filter("kind = 'import' and owner is not null").select("file", "line", "owner", F.col("name").alias("module"), "lang")
    spans = m.facts.filter("kind = 'function'").select("file", "lang", F.monotonically_increasing_id().alias("f"), F.col("line").alias("start"), "end_line", F.col("name").alias("owner"))
    texts = m.text_imports().groupBy("file", "line").agg(F.min("module").alias("module"))
    found = texts.join(spans, "file").filter("line > start and line <= end_line")
    found = found.groupBy("file", "line", "module", "lang").agg(F.min(F.struct(F.col("end_line") - F.col("start"), "f", "owner")).alias("b")).select("file", "line", F.col("b.owner").alias("owner"), "module", "lang")
    rows = rows.unionByName(found)
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    return _rule(rows.join(counts, "file"), name, c, F.col("n"), symbol="owner", module=True, language="lang", function="owner")


def _verbosity(m: Metrics, c: dict, name: str) -> DataFrame:
    n = F.size("identifiers")
    total = F.aggregate(F.transform("identifiers", lambda t: F.greatest(F.lit(1), F.size(fn.split_identifier(t)))), F.lit(0), lambda a, b: a + b)
    return _rule(m.functions.filter(n >= c["min_identifiers"]), name, c, F.round(total / n, 3), total_identifiers=n, total_tokens=total, end_line=True, language="lang")


def _tersity(m: Metrics, c: dict, name: str) -> DataFrame:
    n = F.size("identifiers")
    short = F.filter("identifiers", lambda t: (F.length(t) <= c["max_len"]) & ~t.isin(SHORT_NAMES))
    share = F.round(F.size(short) / n, 4)
    return _rule(m.functions.filter(n >= c["min_identifiers"]), name, c, share, short_identifiers=F.array_sort(F.array_distinct(short)), short_count=F.size(short), total_identifiers=n, density=share)


def _packages(m: Metrics, c: dict, name: str) -> DataFrame:
    bad = m.packages(c.get("languages") or PACKAGED).filter((F.col("distance") > c["threshold"]) | F.col("zone").isin(c["fail_on_zone"]))
    # a package of unknown distance is out by its zone alone, and has no value
    far = float("inf")
    rows = _rule(bad, name, {**c, "threshold": -1}, F.coalesce("distance", F.lit(far)), file="node", line=None, symbol=None, zone=True, instability=True, abstractness=True, ca=True, ce=True, language="lang")
    return rows.withColumn("value", F.when(F.col("value") != far, F.col("value"))).withColumn("threshold", F.lit(float(c["threshold"])))


def _stutter(m: Metrics, c: dict, name: str) -> DataFrame:
    """Identifiers that share tokens with their nearest scope that they share two with; one row for each name and function."""
    words = m.functions.select("file", "line", "scopes", F.explode(F.array_distinct("identifiers")).alias("name")).filter(~F.col("name").rlike("^_(?!_)"))
    own = fn.split_identifier(F.col("name"))
    last = F.size("scopes") - 1
    shared = F.reverse(F.transform("scopes", lambda s, i: F.struct(s.alias("scope"), F.when(i == 0, "module").when(i == last, "function").otherwise("enclosing").alias("type"), F.array_intersect(fn.split_identifier(s), own).alias("overlap"))))
    nearest = F.get(F.filter(shared, lambda x: F.size(x["overlap"]) >= 2), F.lit(0))
    found = words.withColumn("s", nearest).filter("s is not null")
    return _rule(found, name, c, F.size("s.overlap"), True, scope_name=F.col("s.scope"), scope_type=F.col("s.type"), overlap=F.col("s.overlap"), identifier_tokens=own)


def _orphans(m: Metrics, c: dict, name: str) -> DataFrame:
    """Symbols that lines of other files don't hold, not even inside a word."""
    symbols = m.spoken.filter("kind = 'class' or (kind = 'function' and name <> '<lambda>')").filter(F.length("name") >= 4).groupBy("file", "name").agg(F.min(F.struct("line", "kind", "lang")).alias("f")).select("file", "name", "f.*")
    rows = search.substring_references(symbols, m.files.filter(F.col("lang").isin(m.languages)).select(F.col("path").alias("place"), "content"), "file", "name", "place", "content")
    common = F.col("name").isin(COMMON_NAMES)
    rows = rows.withColumn("confidence", fn.confidence(F.col("name"), F.lit(True), common))
    levels = ["low", "medium", "high"]
    rows = rows.filter(F.col("confidence").isin(levels[levels.index(c["min_confidence"]) :]) & (F.col("refs") <= c["threshold"]))
    caveats = F.array_compact(F.array(F.when(common, "a name that many share"), F.when(F.length("name") <= 7, "a short name"), F.when(F.col("name").rlike("^__.*__$"), "a name that the language calls"), F.lit("calls by name at run time aren't seen")))
    return _rule(rows, name, {**c, "threshold": -1}, F.col("refs"), symbol_type="kind", confidence=True, caveats=caveats).withColumn("threshold", F.lit(float(c["threshold"])))


def _volume(m: Metrics, c: dict, name: str) -> DataFrame:
    penalty = fn.terse_penalty(F.col("mean"), c["alpha"])
    return _rule(m.halstead(), name, c, F.round(F.col("volume") * penalty, 2), raw_volume="volume", penalty=penalty, difficulty=True, effort=True, vocabulary=True, length=True, end_line=True)


def _mutators(m: Metrics, c: dict, name: str) -> DataFrame:
    return _rule(m.functions, name, c, F.size("mutations"), True, language="lang", mutations=True, mutated_params=F.array_distinct(F.col("mutations.param")), methods=F.array_distinct(F.col("mutations.method")))


def _class(column: str, **facts):
    return lambda m, c, name: _rule(m.class_metrics(), name, c, F.col(column), kind=F.lit("class"), **facts)


BRANCHES = {
    "structural.complexity.cyclomatic": lambda m, c, name: _rule(m.functions, name, c, F.col("ccx"), zone=fn.complexity_zone(F.col("ccx")), cog=True, end_line=True),
    "structural.complexity.cognitive": lambda m, c, name: _rule(m.functions, name, c, F.col("cog"), zone=fn.complexity_zone(F.col("ccx")), ccx=True, end_line=True),
    "structural.complexity.npath": lambda m, c, name: _rule(m.functions, name, c, F.col("npath"), end_line=True, language="lang"),
    "structural.class.complexity": _class("wmc", method_count=True, cbo=True),
    "structural.class.coupling": _class("cbo", dit=True, noc=True, wmc=True),
    "structural.class.inheritance.depth": _class("dit", superclasses="bases"),
    "structural.class.inheritance.children": _class("noc"),
    "structural.packages": _packages,
    "structural.deps": _cycles,
    "structural.local_imports": _local,
    "structural.redundancy": _redundancy,
    "structural.types.sentinels": _sentinels,
    "structural.types.hidden_mutators": _mutators,
    "structural.types.escape_hatches": _hatches,
    "structural.duplication": _clones,
    "structural.hotspots": _hotspots,
    "structural.god_module": lambda m, c, name: _rule(m.spoken.filter("kind = 'module'"), name, c, F.col("definitions"), line=None, symbol=None, language="lang", loc=True),
    "structural.orphans": _orphans,
    "information.volume": _volume,
    "information.difficulty": lambda m, c, name: _rule(m.halstead(), name, c, F.round("difficulty", 2), volume=True, effort=True, vocabulary=True, length=True, end_line=True),
    "information.magic_literals": _literals,
    "information.section_comments": _sections,
    "lexical.stutter": _stutter,
    "lexical.verbosity": _verbosity,
    "lexical.tersity": _tersity,
}
#: Rules that read the exported log.
NEED_LOG = frozenset(["structural.hotspots"])
