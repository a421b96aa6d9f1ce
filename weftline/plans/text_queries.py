"""Queries over texts, paths, trees and the dataflow driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import paths, text
from weftline.operators import provenance, rules, tree
from weftline.plans.registry import Book
from weftline.shared import written
from weftline.sources import adapters as a
from weftline.sources.tables import table
from weftline.streaming import fixpoint as fx

book = Book()
S = SparkSession
_WS = "regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+\\z', '', 'g')"


# Texts. Long results come out as their MD5.


def _docs(s: S, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


@book(f"SELECT doc_id, md5({_WS.format('text')}) AS digest FROM documents")
def trim_ws(s: S, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.md5(text.trim_ws(F.col("text"))).alias("digest"))


@book("SELECT doc_id, md5(regexp_replace(text, '[ \\t]{2,}', ' ', 'g')) AS digest FROM documents")
def regex_replace(s: S, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.md5(text.regex_replace_until_stable(F.col("text"), r"[ \t]{2}", " ")).alias("digest"))


@book("SELECT doc_id, md5(replace(text, 'said ', 'the ')) AS digest FROM documents")
def literal_replace(s: S, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.md5(text.literal_replace(F.col("text"), "said ", "the ")).alias("digest"))


@book("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n FROM documents")
def newline_count(s: S, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", text.newline_count(F.col("text")).alias("n"))


@book("SELECT doc_id, strpos(text, '.') - 1 AS n FROM documents")
def locate_sep(s: S, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", text.locate_sep(F.col("text"), ".").alias("n"))


@book(
    "SELECT doc_id, CAST(coalesce(pos, -1) AS INT) AS n FROM documents LEFT JOIN (SELECT doc_id, min(pos) AS pos FROM depth WHERE open = 0 GROUP BY 1) USING (doc_id)",
    """chars AS (SELECT doc_id, unnest(l) AS c, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents)),
opened AS (SELECT doc_id, min(pos) AS first FROM chars WHERE c = '(' GROUP BY 1),
depth AS (SELECT doc_id, pos, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS open FROM chars JOIN opened USING (doc_id) WHERE pos >= first AND c IN ('(', ')'))""",
)
def locate_closing(s: S, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", text.locate_closing(F.col("text")).alias("n"))


@book("""SELECT doc_id, md5(CASE WHEN p > 0 THEN array_to_string(l[1:p-1] || ['<inserted>'] || l[p:], chr(10)) ELSE text END) AS digest
FROM (SELECT *, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '^(CLAIMS|Claims:)\\z')), true), 0) AS p FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents))""")
def insert_before_first_match(s: S, d: str) -> DataFrame:
    lines = text.insert_before_first_match(F.col("text"), r"^(CLAIMS|Claims:)\z", "<inserted>")
    return _docs(s, d).select("doc_id", F.md5(F.array_join(lines, "\n")).alias("digest"))


@book("""SELECT doc_id, md5(array_to_string(list_transform(range(1, len(l) + 1), lambda i: l[i] || CASE WHEN i = len(l) THEN '' WHEN i % 3 = 0 THEN chr(10) || '> ' WHEN i % 3 = 1 THEN '*' || chr(10) ELSE '' END), '')) AS digest
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def apply_edits(s: S, d: str) -> DataFrame:
    """An edit at every line break of every text: something put behind it, something put before it, or the break taken out, in turn."""
    sizes = F.transform(F.split("text", "\n"), F.length)
    breaks = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), F.array().cast("array<int>"), lambda a, n: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0)) + n))

    def edit(at: Column, i: Column) -> Column:
        k = (i + 1) % 3
        return F.struct(at.alias("start"), F.when(k == 1, at).otherwise(at + 1).alias("end"), F.when(k == 0, F.lit("\n> ")).when(k == 1, F.lit("*")).otherwise(F.lit("")).alias("text"))

    edits = _docs(s, d).withColumn("edits", F.transform(breaks, edit))
    return edits.select("doc_id", F.md5(text.apply_edits(F.col("text"), F.col("edits"))).alias("digest"))


_HEAD = r"^(CLAIMS|Claims:)\z"


@book("""SELECT doc_id AS file_id, i AS line, CASE WHEN i <= p THEN i ELSE i - 1 END AS original_line FROM (
  SELECT doc_id, len(l) AS n, list_position(list_transform(l, lambda x: regexp_matches(x, '^(CLAIMS|Claims:)\\z')), true) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  unnest(range(1, n + 2)) t(i) WHERE p > 0""")
def insert_shift(s: S, d: str) -> DataFrame:
    """Where the lines of each text come from after a line was put before its claims."""
    texts = _docs(s, d).withColumnRenamed("doc_id", "file_id")
    none = s.createDataFrame([], "file_id long, line int, original_line int")
    return provenance.header_inserted(texts, none, _HEAD).select("file_id", F.col("line").cast("long").alias("line"), F.col("original_line").cast("long").alias("original_line"))


@book("""SELECT id, regexp_replace(regexp_replace(regexp_replace(command, '[ \\t]*\\bc\\b[ \\t]*', ' ', 'g'), '[ \\t]*\\bo\\b[ \\t]*', ' ', 'g'), '^ +| +\\z', '', 'g') AS rest
FROM compile_commands WHERE regexp_full_match(command, '[\\x00-\\x7f]*')""")
def without_words(s: S, d: str) -> DataFrame:
    """Commands without two letters where they stand alone; commands beyond ASCII are left out, as the two engines tell words differently there."""
    commands = table(s, d, "compile_commands").where(F.col("command").rlike(r"^[\x00-\x7f]*\z"))
    return commands.select("id", text.without_words(F.col("command"), "c", "o").alias("rest"))


@book("""SELECT event_id, CAST(CASE WHEN ms >= 1000 THEN ms // 1000 ELSE ms END AS VARCHAR) || CASE WHEN ms >= 1000 THEN ' second' ELSE ' millisecond' END
  || CASE WHEN (CASE WHEN ms >= 1000 THEN ms // 1000 ELSE ms END) > 1 THEN 's' ELSE '' END AS took FROM (SELECT event_id, CAST(floor(value * 37) AS BIGINT) AS ms FROM events)""")
def format_duration(s: S, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", text.format_duration(F.floor(F.col("value") * 37)).alias("took"))


@book("SELECT id, (start_line, lines_replaced) < (comes_from_start_line, lines_in_replacement) AS earlier, start_line = comes_from_start_line AND lines_replaced = lines_in_replacement AS same FROM replacements")
def position_compare(s: S, d: str) -> DataFrame:
    p, q = (F.col("start_line"), F.col("lines_replaced")), (F.col("comes_from_start_line"), F.col("lines_in_replacement"))
    return table(s, d, "replacements").select("id", text.position_less(p, q).alias("earlier"), ((p[0] == q[0]) & (p[1] == q[1])).alias("same"))


@book("SELECT id, CASE WHEN len(args) > 0 THEN ' ' || array_to_string(args, ' ') ELSE '' END AS line FROM cmd")
def cmd_line_concat(s: S, d: str) -> DataFrame:
    return a.arguments(s, d).select("id", text.cmd_line_concat(F.col("args")).alias("line"))


@book("""SELECT id, array_to_string(list_transform(args, lambda x: CASE WHEN starts_with(x, '-I/srv/build/') THEN '-I/dst/' || substr(x, 14)
  WHEN starts_with(x, '/srv/build/') AND x = file THEN '/dst/' || substr(x, 12) ELSE x END), ' ') AS line FROM cmd""")
def rewrite_args(s: S, d: str) -> DataFrame:
    new = text.rewrite_args(F.col("args"), "/srv/build/", "/dst/", F.array("file"))
    return a.arguments(s, d).select("id", F.array_join(new, " ").alias("line"))


# Edits as intervals within a file.

_INTERVALS = "iv AS (SELECT id, file_id, start_line AS start, start_line + lines_replaced AS stop, replacement_text AS text FROM replacements)"


def _intervals(s: S, d: str) -> DataFrame:
    end = F.col("start_line") + F.col("lines_replaced")
    return table(s, d, "replacements").select("id", "file_id", F.col("start_line").alias("start"), end.alias("end"), F.col("replacement_text").alias("text"))


@book("SELECT i.id, coalesce(i.start >= 0 AND i.stop >= i.start AND i.stop <= f.number_of_lines, false) AS valid FROM iv i LEFT JOIN file f ON f.id = i.file_id", _INTERVALS)
def edit_bounds(s: S, d: str) -> DataFrame:
    lengths = a.files(s, d).select(F.col("id").alias("file_id"), F.col("number_of_lines").alias("length"))
    return text.edit_bounds(_intervals(s, d), lengths)


@book(
    "SELECT id FROM (SELECT id, start, max(stop) OVER (PARTITION BY file_id ORDER BY start, stop, text, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv) WHERE start < reach",
    _INTERVALS,
)
def edit_overlap(s: S, d: str) -> DataFrame:
    return text.edit_overlap(_intervals(s, d))


@book("SELECT id, file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY start, stop, text, id) AS INT) AS place FROM iv", _INTERVALS)
def interval_order(s: S, d: str) -> DataFrame:
    return text.interval_places(_intervals(s, d))


@book("SELECT id, file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY start_line, start_line + lines_replaced, replacement_text DESC, id) AS INT) AS place FROM replacements")
def edit_order(s: S, d: str) -> DataFrame:
    return text.edit_order(table(s, d, "replacements"))


@book("SELECT file_id, CAST(sum(length(text) - (stop - start)) AS BIGINT) AS delta FROM iv GROUP BY 1", _INTERVALS)
def edit_size_delta(s: S, d: str) -> DataFrame:
    return text.edit_size_delta(_intervals(s, d))


# Paths.


def _paths(s: S, d: str) -> DataFrame:
    return table(s, d, "files").select("path").distinct()


_P = "p AS (SELECT DISTINCT path FROM files)"
_ABS = "regexp_matches({}, '^([/\\\\]|[A-Za-z]:)')"
_DIR = "regexp_matches({}, '(^|[/\\\\])\\.{{0,2}}\\z')"


_NORMAL = f"""norm AS (SELECT path, regexp_replace(CASE WHEN len(k) = 0 THEN '.' ELSE array_to_string(k, '/') END || CASE WHEN folder THEN '/' ELSE '' END, '/+', '/', 'g') AS normal FROM (
  SELECT path, {_DIR.format('q')} AS folder, list_reduce([CAST([] AS VARCHAR[])] || list_transform(list_filter(string_split(regexp_replace(q, '/\\z', ''), '/'), lambda t: t <> '.'), lambda t: [t]),
    lambda done, t: CASE WHEN t[1] <> '..' THEN done || t WHEN len(done) > 0 AND done[-1] <> '..' THEN done[1:len(done) - 1] WHEN len(done) = 0 THEN ['.', '..'] ELSE done || t END) AS k
  FROM (SELECT path, replace({_WS.format('path')}, chr(92), '/') AS q FROM p)))"""


@book("SELECT path, normal FROM norm", f"{_P}, {_NORMAL}")
def path_normalize(s: S, d: str) -> DataFrame:
    return _paths(s, d).select("path", paths.normalize(F.col("path")).alias("normal"))


@book("SELECT DISTINCT normal AS path FROM norm", f"{_P}, {_NORMAL}")
def unique_sources(s: S, d: str) -> DataFrame:
    return paths.unique_sources(_paths(s, d))


@book(f"SELECT path, CASE WHEN {_ABS.format('path')} THEN path ELSE '/home/ci/' || regexp_replace(path, '^\\./', '') END AS absolute FROM p", _P)
def path_absolute(s: S, d: str) -> DataFrame:
    return _paths(s, d).select("path", paths.make_absolute(F.col("path"), "/home/ci/").alias("absolute"))


@book("SELECT path, regexp_replace(path, '/[^/]+\\z', '/') AS last_dir, regexp_replace(path, '/[^/]+/?\\z', '/') AS up FROM p", _P)
def path_parent(s: S, d: str) -> DataFrame:
    return _paths(s, d).select("path", paths.last_dir(F.col("path")).alias("last_dir"), paths.one_step_up(F.col("path")).alias("up"))


@book(f"""SELECT path, CASE WHEN {_ABS.format('t')} OR starts_with(t, './') THEN t ELSE './' || t END AS parsed, {_DIR.format('t')} AS is_dir, {_ABS.format('t')} AS is_abs
FROM (SELECT path, {_WS.format('path')} AS t FROM p)""", _P)  # fmt: skip
def path_parse(s: S, d: str) -> DataFrame:
    return _paths(s, d).select("path", *[c.alias(k) for k, c in paths.parse(F.col("path")).items()])


@book(f"SELECT path, CAST(row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]+\\z', '/') ORDER BY {_DIR.format('path')}, {_ABS.format('path')}, path) AS INT) AS place FROM p", _P)
def path_order(s: S, d: str) -> DataFrame:
    return paths.path_order(_paths(s, d))


@book("""SELECT directory, substr(a, 1, coalesce((SELECT min(i) FROM range(1, 4000) t(i) WHERE i <= least(length(a), length(b)) AND substr(a, i, 1) <> substr(b, i, 1)) - 1, least(length(a), length(b)))) AS prefix
FROM (SELECT directory, min(file) AS a, max(file) AS b FROM compile_commands GROUP BY 1)""")
def common_prefix(s: S, d: str) -> DataFrame:
    return paths.common_prefix(table(s, d, "compile_commands"), "file", ["directory"])


@book("SELECT path, CASE WHEN starts_with(path, '/srv/build/') THEN '/dst/' || substr(path, 12) ELSE path END AS moved FROM p", _P)
def prefix_rewrite(s: S, d: str) -> DataFrame:
    return _paths(s, d).select("path", paths.replace_prefix(F.col("path"), "/srv/build/", "/dst/").alias("moved"))


@book("SELECT path, starts_with(path, '/opt/') AS begins, ends_with(path, '.h') AS ends FROM p", _P)
def affix_test(s: S, d: str) -> DataFrame:
    return _paths(s, d).select("path", F.col("path").startswith("/opt/").alias("begins"), F.col("path").endswith(".h").alias("ends"))


@book("SELECT path, len(t) AS n, array_to_string(t, '|') AS tokens FROM (SELECT path, CASE WHEN l[-1] = '' THEN l[1:len(l)-1] ELSE l END AS t FROM (SELECT path, string_split(path, '/') AS l FROM p))", _P)
def split_tokens(s: S, d: str) -> DataFrame:
    t = text.split_tokens(F.col("path"), "/")
    return _paths(s, d).select("path", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


@book(
    """SELECT p.path, x.prefix, x.replacement || substr(p.path, length(x.prefix) + 1) AS moved FROM p LEFT JOIN (
  SELECT path, prefix, replacement FROM p JOIN pre ON starts_with(path, prefix) QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC) = 1) x USING (path)""",
    _P + ", pre AS (SELECT DISTINCT regexp_extract(path, '^/[^/]+/[^/]+/') AS prefix, '/moved' || regexp_extract(path, '^/[^/]+/[^/]+/') AS replacement FROM p WHERE regexp_matches(path, '^/[^/]+/[^/]+/') UNION ALL SELECT '/srv/', '/s/')",
)
def prefix_join(s: S, d: str) -> DataFrame:
    """The longest of many prefixes of each path."""
    p = _paths(s, d)
    folder = F.regexp_extract("path", "^/[^/]+/[^/]+/", 0)
    many = p.where(folder != "").select(folder.alias("prefix"), F.concat(F.lit("/moved"), folder).alias("replacement")).distinct()
    return paths.matching_prefixes(p, many.unionByName(s.createDataFrame([("/srv/", "/s/")], many.schema)))


# Tree patterns.

_URGENT = tree.kind("order", "name = '1-URGENT'")
_RETURNED = tree.kind("line", "name = 'R'")
_CUSTOMERS = tree.kind("customer")


def _tree(s: S, d: str) -> DataFrame:
    """The node table, written once, as patterns read it several times."""
    return written(a.tree(s, d), "nodes")


@book("SELECT id FROM node WHERE kind = 'order' AND name = '1-URGENT'")
def tree_kind(s: S, d: str) -> DataFrame:
    return _URGENT(a.tree(s, d))


@book("SELECT id FROM node WHERE id IN (SELECT parent FROM node WHERE kind = 'order' AND name = '1-URGENT')")
def tree_has_child(s: S, d: str) -> DataFrame:
    return tree.has_child(_URGENT)(_tree(s, d))


@book("SELECT id FROM node WHERE parent IN (SELECT id FROM node WHERE kind = 'order' AND name = '1-URGENT')")
def tree_has_parent(s: S, d: str) -> DataFrame:
    return tree.has_parent(_URGENT)(_tree(s, d))


@book(
    "SELECT id FROM node WHERE id IN (SELECT id FROM up)",
    "up AS (SELECT parent AS id FROM node WHERE kind = 'line' AND name = 'R' UNION SELECT n.parent FROM up JOIN node n ON n.id = up.id WHERE n.parent IS NOT NULL)",
)
def tree_has_descendant(s: S, d: str) -> DataFrame:
    return tree.has_descendant(_RETURNED)(_tree(s, d))


@book(
    "SELECT id FROM node WHERE id IN (SELECT id FROM down)",
    "down AS (SELECT id FROM node WHERE parent IN (SELECT id FROM node WHERE kind = 'region' AND name = 'ASIA') UNION SELECT n.id FROM down JOIN node n ON n.parent = down.id)",
)
def tree_has_ancestor(s: S, d: str) -> DataFrame:
    return tree.has_ancestor(tree.kind("region", "name = 'ASIA'"))(_tree(s, d))


@book("SELECT id FROM node WHERE kind = 'customer' AND id NOT IN (SELECT parent FROM node WHERE kind = 'order' AND name = '1-URGENT')")
def tree_unless(s: S, d: str) -> DataFrame:
    return tree.unless(tree.has_child(_URGENT), _CUSTOMERS)(_tree(s, d))


@book("SELECT id FROM node WHERE (kind = 'order' AND name = '1-URGENT') OR (kind = 'customer' AND id IN (SELECT parent FROM node WHERE kind = 'order' AND name = '1-URGENT'))")
def tree_any_of(s: S, d: str) -> DataFrame:
    return tree.any_of(_URGENT, tree.all_of(_CUSTOMERS, tree.has_child(_URGENT)))(_tree(s, d))


@book("SELECT p.id, c.id AS child FROM node c JOIN node p ON p.id = c.parent WHERE c.kind = 'order' AND c.name = '1-URGENT' AND p.kind = 'customer'")
def tree_bind_pair(s: S, d: str) -> DataFrame:
    return tree.bind_pair(_tree(s, d), _CUSTOMERS, _URGENT)


def _placed(s: S, d: str) -> DataFrame:
    """Customers and orders as nodes of the customer's file, written once for all rules."""
    n = a.tree(s, d).where("kind IN ('customer', 'order')")
    placed = n.select("id", "parent", "kind", "name", F.when(F.col("kind") == "order", F.col("parent")).otherwise(F.col("id")).alias("file"), F.lit(0).alias("start"), F.length("name").alias("end"))
    return written(placed, "nodes")


def _rules() -> dict[str, list[rules.Rule]]:
    return {
        "multiple-transforms": [rules.Rule("urgent", _URGENT, lambda: F.upper("name")), rules.Rule("bare", tree.unless(tree.has_child(_URGENT), _CUSTOMERS))],
        "replace-lambda": [rules.Rule("machinery", tree.kind("order", "name = '5-LOW'"), lambda: F.concat(F.lit("<"), "name", F.lit(">")))],
    }


@book("""SELECT DISTINCT transform, path FROM (
SELECT 'multiple-transforms' AS transform, parent AS path FROM node WHERE kind = 'order' AND name = '1-URGENT'
UNION ALL SELECT 'multiple-transforms', id FROM node WHERE kind = 'customer' AND id NOT IN (SELECT parent FROM node WHERE kind = 'order' AND name = '1-URGENT')
UNION ALL SELECT 'replace-lambda', parent FROM node WHERE kind = 'order' AND name = '5-LOW')""")
def find_features(s: S, d: str) -> DataFrame:
    return rules.find_features(_rules(), _placed(s, d))


@book("""SELECT DISTINCT parent AS file, 0 AS start, length(name) AS end, CASE name WHEN '5-LOW' THEN '<5-LOW>' ELSE name END AS text, CASE name WHEN '5-LOW' THEN 'machinery' ELSE 'urgent' END AS rule
FROM node WHERE kind = 'order' AND name IN ('1-URGENT', '5-LOW')""")
def rule_edits(s: S, d: str) -> DataFrame:
    """All edits of a run of the driver: the finder tags files, then each transform rewrites its own."""
    nodes = _placed(s, d)
    paths_ = nodes.select(F.lit(rules.FINDER).alias("transform"), F.col("file").alias("path"))
    edits, _ = fx.run_to_fixpoint(rules.registry_of(_rules(), nodes), paths_)
    return edits.distinct()


_CHAIN = """walk AS (SELECT id, id AS at, parent AS next, 0 AS steps, id AS path FROM node WHERE kind = 'order'
  UNION ALL SELECT w.id, n.id, n.parent, w.steps + 1, w.path || '>' || n.id FROM walk w JOIN node n ON n.id = w.next)"""


@book("SELECT walk.id, walk.at AS root, steps, path FROM walk WHERE next IS NULL", _CHAIN)
def chain_walk(s: S, d: str) -> DataFrame:
    return tree.chain_walk(_tree(s, d), tree.kind("order"))


@book("SELECT c.id, r.name || '::' || n.name || '::' || o.name AS qualified FROM node c JOIN node o ON o.id = c.id JOIN node k ON k.id = o.parent JOIN node n ON n.id = k.parent JOIN node r ON r.id = n.parent WHERE c.kind = 'order'")
def qualified_name(s: S, d: str) -> DataFrame:
    return tree.qualified_name(_tree(s, d), tree.kind("order"), ["customer"])


@book("SELECT w.id, w.at AS ancestor, w.steps AS depth FROM walk w JOIN node n ON n.id = w.at WHERE n.kind = 'nation'", _CHAIN)
def nearest_ancestor(s: S, d: str) -> DataFrame:
    return tree.nearest_ancestor(_tree(s, d), tree.kind("order"), "nation")


@book("SELECT DISTINCT file_id AS file, start_line AS line, lines_replaced AS col, 'unnamed_' || file_id || '_' || start_line || '_' || lines_replaced AS generated FROM replacements")
def unique_name(s: S, d: str) -> DataFrame:
    return tree.unique_name(table(s, d, "replacements").select(F.col("file_id").alias("file"), F.col("start_line").alias("line"), F.col("lines_replaced").alias("col")))


# The driver.


def _transforms(s: S, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg((F.count(F.lit(1)) % 7).alias("priority"))


@book("SELECT name, priority, CAST(row_number() OVER (ORDER BY priority DESC, name) AS INT) AS place FROM (SELECT event_type AS name, count(*) % 7 AS priority FROM events GROUP BY 1)")
def transform_order(s: S, d: str) -> DataFrame:
    return fx.transform_order(_transforms(s, d))


_VERSIONS = [("clang", "3.6"), ("clang", "3.10"), ("gcc", "4"), ("gcc", "4.8"), ("icc", "x.y")]


@book("""SELECT t.transform, bool_and(CASE c.compiler WHEN 'clang' THEN (3, 6) >= (3, t.n) WHEN 'gcc' THEN (4, 0) >= (3, t.n) ELSE true END) AS supported
FROM (SELECT event_type AS transform, count(*) % 12 AS n FROM events GROUP BY 1) t, (VALUES ('clang'), ('gcc'), ('icc')) c(compiler) GROUP BY 1""")
def version_filter(s: S, d: str) -> DataFrame:
    need = table(s, d, "events").groupBy(F.col("event_type").alias("transform")).agg(F.concat(F.lit("3."), (F.count(F.lit(1)) % 12).cast("string")).alias("version"))
    required = need.select("transform", F.explode(F.array(*[F.lit(c) for c in ("clang", "gcc", "icc")])).alias("compiler"), "version")
    return fx.version_filter(required, s.createDataFrame(_VERSIONS, "compiler string, version string"))


@book("SELECT t.name AS transform, f.path FROM (SELECT DISTINCT event_type AS name FROM events) t, (SELECT DISTINCT path FROM files) f")
def seed_queue(s: S, d: str) -> DataFrame:
    return fx.seed_queue(_transforms(s, d), table(s, d, "files"))


@book(
    "SELECT 'halve' AS transform, CAST(pass AS INT) AS pass, count(DISTINCT n) AS n_paths FROM h GROUP BY pass UNION ALL SELECT 'find', 1, count(DISTINCT user_id) FROM events",
    "h AS (SELECT DISTINCT user_id AS n, 1 AS pass FROM events WHERE user_id > 0 UNION SELECT n // 2, pass + 1 FROM h WHERE n // 2 > 0)",
)
def fixpoint(s: S, d: str) -> DataFrame:
    """Passes of a finder that hands its paths on, and of a transform that asks for half of each path until nothing is left."""
    none = s.createDataFrame([], "path long, edit string")
    registry = fx.Registry()
    registry.add(fx.Transform("find", 99, lambda q: (none, q.where("path > 0").select(F.lit("halve").alias("transform"), "path"))))
    half = (F.col("path") / 2).cast("long")
    registry.add(
        fx.Transform("halve", 10, lambda q: (q.select("path", F.lit("halved").alias("edit")), q.where(half > 0).select(F.lit("halve").alias("transform"), half.alias("path"))))
    )
    users = table(s, d, "events").select(F.lit("find").alias("transform"), F.col("user_id").alias("path"))
    _, log = fx.run_to_fixpoint(registry, users)
    return s.createDataFrame(log, "transform string, pass int, n_paths long")


@book("SELECT count(*) FILTER (event_type <> 'error') AS n_passed, count(*) FILTER (event_type = 'error') AS n_failed FROM events")
def check_summary(s: S, d: str) -> DataFrame:
    return fx.check_summary(table(s, d, "events").select((F.col("event_type") != "error").alias("passed")))


@book("SELECT path, count(*) FILTER (id IS NULL OR id % 4 = 0) AS n_failed FROM (SELECT DISTINCT path FROM file) f LEFT JOIN compile_commands c ON c.file = f.path GROUP BY 1 HAVING count(*) FILTER (id IS NULL OR id % 4 = 0) > 0")
def failed_files(s: S, d: str) -> DataFrame:
    """Files of which a command failed, or that have none."""
    runs = table(s, d, "compile_commands").select(F.col("file").alias("path"), (F.col("id") % 4 != 0).alias("passed"))
    return fx.failed_paths(a.files(s, d).select("path").distinct().join(runs, "path", "left"))


_LINKS = """link AS (SELECT id, up AS target FROM (SELECT id, CASE WHEN id % 7 <> 0 THEN id - 1 - id % 3 END AS up FROM file) WHERE up IN (SELECT id FROM file)),
follow AS (SELECT id, target, 1 AS steps, CASE WHEN id % 2 = 0 THEN ['$1', 'c' || id] ELSE ['$2', '$1'] END AS args FROM link
  UNION ALL SELECT f.id, l.target, steps + 1, list_transform(CASE WHEN l.id % 2 = 0 THEN ['$1', 'c' || l.id] ELSE ['$2', '$1'] END, lambda x: CASE x WHEN '$1' THEN args[1] WHEN '$2' THEN args[2] ELSE x END)
  FROM follow f JOIN link l ON l.id = f.target)"""


@book("SELECT id, target, array_to_string(args, ',') AS arguments, steps FROM follow QUALIFY row_number() OVER (PARTITION BY id ORDER BY steps DESC) = 1 UNION ALL SELECT id, id, NULL, 0 FROM file WHERE id NOT IN (SELECT id FROM link)", _LINKS)
def chain_arguments(s: S, d: str) -> DataFrame:
    """Files as calls that hand on to another file, with the arguments of the last call in terms of the first one's."""
    f = a.files(s, d).select("id")
    up = f.select("id", F.when(F.col("id") % 7 != 0, F.col("id") - 1 - F.col("id") % 3).alias("target"))
    given = F.when(F.col("id") % 2 == 0, F.array(F.lit("$1"), F.concat(F.lit("c"), "id"))).otherwise(F.array(F.lit("$2"), F.lit("$1")))
    links = up.join(f.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target", given.alias("arguments"))
    found = tree.substituted_chain(links, f)
    return found.select("id", "target", F.array_join("arguments", ",").alias("arguments"), "steps")


@book(
    """SELECT id, text FROM (SELECT o.o_orderkey AS id, 'O<' || o_orderstatus || ',' || (SELECT string_agg('L_' || name, ',' ORDER BY k) FROM kids WHERE kids.parent = o.o_orderkey) || '>' AS text FROM orders o
  WHERE o.o_orderkey IN (SELECT parent FROM kids) UNION ALL SELECT -(parent * 8 + k), 'L_' || name FROM kids UNION ALL SELECT o_orderkey, 'O<' || o_orderstatus || '>' FROM orders WHERE o_orderkey NOT IN (SELECT parent FROM kids))""",
    "kids AS (SELECT l_orderkey AS parent, l_linenumber AS k, min(l_returnflag) AS name FROM lineitem GROUP BY 1, 2)",
)
def type_rewrite(s: S, d: str) -> DataFrame:
    """Orders as types whose parts are their lines, written with new names from the lines upwards."""
    kids = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("k")).agg(F.min("l_returnflag").alias("name"))
    lines = kids.select((-(F.col("parent") * 8 + F.col("k"))).alias("id"), "parent", F.col("k").alias("place"), F.col("name").alias("kind"), F.lit("{name}").alias("pattern"))
    places = kids.groupBy(F.col("parent").alias("o_orderkey")).agg(F.array_sort(F.collect_list("k")).alias("ks"))
    holes = F.concat_ws(",", F.array(F.lit("{name}")), F.transform("ks", lambda k: F.concat(F.lit("{"), k.cast("string"), F.lit("}"))))
    orders = table(s, d, "orders").join(places, "o_orderkey", "left")
    tops = orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("place"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("O<"), F.coalesce(holes, F.lit("{name}")), F.lit(">")).alias("pattern"))
    flags = kids.select(F.col("name").alias("kind"), F.concat(F.lit("L_"), "name").alias("name")).distinct()
    own = orders.select(F.col("o_orderstatus").alias("kind"), F.col("o_orderstatus").alias("name")).distinct().join(flags, "kind", "left_anti")
    return tree.rewritten(tops.unionByName(lines), flags.unionByName(own))


QUERIES, SQL = book.queries, book.sql
