"""Queries of the operators that keep a structure: reach sizes, cycles, upkeep, postings, nesting, intervals, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, intervals, names, nearest, nesting, postings, reach
from ..storage import durable
from .registry import _CLOSURE, _EDGES, Query, _edges, _table

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# reach: G3, G7, C2

_RANKED = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0"


@_query(f"""WITH RECURSIVE {_EDGES}, {_CLOSURE}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
above AS (SELECT b AS node, a AS other FROM closure UNION SELECT node, node FROM nodes),
numbered AS (SELECT node, {_RANKED.format('other')} AS r, row_number() OVER (PARTITION BY node ORDER BY {_RANKED.format('other')}) AS k FROM above)
SELECT node, CASE WHEN count(*) < 32 THEN CAST(count(*) AS DOUBLE) ELSE 31.0 / max(r) END - 1 AS n FROM numbered WHERE k <= 32 GROUP BY node""")
def reach_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated sizes of what reaches each supplier, from 32 ranks a node."""
    return reach.estimated_sizes(durable(_edges(spark, sf_dir), "edges"), 32)


_COMPONENTS = """links AS (SELECT src, dst FROM edges), root AS (
  SELECT c.a AS node, min(c.b) AS root, count(*) AS size FROM closure c JOIN closure d ON d.a = c.b AND d.b = c.a GROUP BY c.a
), inside AS (
  SELECT DISTINCT e.src, e.dst FROM edges e JOIN root x ON x.node = e.src JOIN root y ON y.node = e.dst WHERE x.root = y.root AND e.src <> e.dst
), depths(node, depth) AS (
  SELECT DISTINCT root, 0 FROM root UNION SELECT i.dst, d.depth + 1 FROM depths d JOIN inside i ON i.src = d.node JOIN root r ON r.node = i.dst WHERE d.depth < r.size
), least AS (SELECT node, min(depth) AS depth FROM depths GROUP BY node),
levels AS (SELECT i.src, i.dst, a.depth AS a, b.depth AS b FROM inside i JOIN least a ON a.node = i.src JOIN least b ON b.node = i.dst),
tree AS (SELECT dst AS child, min(src) AS parent FROM levels WHERE b = a + 1 GROUP BY dst),
walks(src, dst, ends, rest, files) AS (
  SELECT src, dst, src, a - b, [src, dst] FROM levels WHERE b <= a
  UNION ALL SELECT w.src, w.dst, t.parent, w.rest - 1, list_prepend(t.parent, w.files) FROM walks w JOIN tree t ON t.child = w.ends WHERE w.rest > 0
)"""


@_query(f"""WITH RECURSIVE {_EDGES}, {_CLOSURE}, {_COMPONENTS}
SELECT src, dst, array_to_string(files, '>') AS files, CASE WHEN len(files) > 4 THEN 'high' ELSE 'medium' END AS severity FROM walks WHERE rest = 0 AND ends = dst
UNION ALL SELECT DISTINCT src, dst, src || '>' || dst, 'medium' FROM edges WHERE src = dst""")
def shortest_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shortest cycle for each edge that closes one."""
    return reach.shortest_cycles(durable(_edges(spark, sf_dir), "edges")).withColumn("files", F.array_join("files", ">"))


_CHANGED = """removed AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 2000), added AS (
  SELECT a.s_suppkey AS src, min(b.s_suppkey) AS dst FROM supplier a JOIN supplier b ON b.s_nationkey = (a.s_nationkey + 1) % 25
  WHERE a.s_acctbal >= 9000 AND b.s_acctbal >= 2000 GROUP BY a.s_suppkey
), later AS (
  SELECT src, dst FROM edges WHERE src NOT IN (SELECT node FROM removed) AND dst NOT IN (SELECT node FROM removed) UNION SELECT src, dst FROM added
), seed AS (SELECT min(s_suppkey) AS node FROM supplier WHERE s_acctbal >= 2000)"""


@_query(f"""WITH RECURSIVE {_EDGES}, {_CHANGED}, depths(node, depth) AS (
  SELECT node, 0 FROM seed UNION SELECT l.dst, d.depth + 1 FROM depths d JOIN later l ON l.src = d.node WHERE d.depth < 100
) SELECT node, CAST(min(depth) AS INT) AS depth FROM depths GROUP BY node""")
def refreshed_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a supplier reaches after suppliers of little balance have gone and others have new links, from what it reached."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    edges = durable(_edges(spark, sf_dir), "edges")
    seed = s.filter("s_acctbal >= 2000").agg(F.min("s_suppkey").alias("node"))
    known = durable(graph.reachable(edges, seed), "known")
    removed = s.filter("s_acctbal < 2000").select(F.col("s_suppkey").alias("node"))
    to = s.filter("s_acctbal >= 2000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_suppkey").alias("dst"))
    added = s.filter("s_acctbal >= 9000").join(to, (F.col("s_nationkey") + 1) % 25 == F.col("nation")).select(F.col("s_suppkey").alias("src"), "dst")
    return reach.refreshed(known, edges, graph.touching(edges, removed), added, seed)


# reference index: X11, A10

_TOKENS = ("the", "that", "Nicht", "token", "password", "eau", "you")


@_query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}_$][\\p{{L}}\\p{{N}}_$]*') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS i FROM t)
SELECT doc_id, token, CAST(count(*) AS INT) AS n, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last FROM x WHERE token IN ({', '.join(f"'{t}'" for t in _TOKENS)}) GROUP BY doc_id, token""")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to a few names in all documents, from an index of all names."""
    index = postings.Postings.build(postings.postings(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    found = index.lookup(*_TOKENS)
    return found.select(F.col("key").alias("doc_id"), "token", F.size("positions").alias("n"), F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))


# nesting: X14, W3

_HTML = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][a-z0-9]*\b[^>]*>|<![^>]*>|[^<]+|<"
_TREE = rf"""pieces AS (
  SELECT page_id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT page_id, regexp_extract_all(html, '{_HTML}') AS p FROM pages)
), placed AS (
  SELECT page_id, i, piece, sum(length(piece)) OVER (PARTITION BY page_id ORDER BY i) AS z, lower(regexp_extract(piece, '^</?([A-Za-z][A-Za-z0-9]*)\b', 1)) AS tag FROM pieces
), marks AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k, CAST(z - length(piece) AS INT) AS a, CAST(z AS INT) AS z, tag,
         CASE WHEN tag NOT IN ('script', 'style') AND starts_with(piece, '</') THEN 'close'
              WHEN tag IN ('script', 'style', {', '.join(f"'{v}'" for v in nesting.VOID)}) OR ends_with(piece, '/>') THEN 'leaf' ELSE 'open' END AS kind
  FROM placed WHERE tag <> ''
), steps(page_id, k, before, stack) AS (
  SELECT DISTINCT page_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(k BIGINT, tag VARCHAR)[]), CAST([] AS STRUCT(k BIGINT, tag VARCHAR)[]) FROM marks
  UNION ALL
  SELECT s.page_id, m.k, s.stack,
    CASE WHEN m.kind = 'open' THEN list_append(s.stack, struct_pack(k := m.k, tag := m.tag))
         WHEN m.kind = 'close' AND len(list_filter(s.stack, lambda x: x.tag = m.tag)) > 0
           THEN list_slice(s.stack, 1, len(s.stack) - list_position(list_transform(list_reverse(s.stack), lambda x: x.tag), m.tag))
         ELSE s.stack END
  FROM steps s JOIN marks m ON m.page_id = s.page_id AND m.k = s.k + 1
), popped AS (
  SELECT s.page_id, unnest(s.before[len(s.stack) + 1:]).k AS k, unnest(range(len(s.before) - len(s.stack))) AS nth, m.a, m.z FROM steps s JOIN marks m USING (page_id, k) WHERE len(s.before) > len(s.stack)
), nodes AS (
  SELECT m.page_id, m.k, m.tag, m.a AS start, CASE WHEN m.kind = 'leaf' THEN m.z WHEN p.k IS NULL THEN CAST(length(g.html) AS INT) WHEN p.nth = 0 THEN p.z ELSE p.a END AS "end", s.before[-1].k AS parent
  FROM marks m JOIN steps s USING (page_id, k) JOIN pages g USING (page_id) LEFT JOIN popped p ON p.page_id = m.page_id AND p.k = m.k WHERE m.kind <> 'close'
)"""


@_query(f"""WITH RECURSIVE {_TREE}, inside AS (
  SELECT n.*, n.start >= length(g.html) // 4 AND n."end" <= 3 * length(g.html) // 4 AS within FROM nodes n JOIN pages g USING (page_id)
) SELECT n.page_id, n.tag, n.start, n."end" FROM inside n LEFT JOIN inside p ON p.page_id = n.page_id AND p.k = n.parent WHERE n.within AND NOT coalesce(p.within, false)""")
def elements_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of the middle half of each page that no other element of it holds."""
    pages = _table(spark, sf_dir, "pages")
    size = pages.select("page_id", F.length("html").alias("size"))
    nodes = nesting.elements(pages, "page_id", "html").join(size, "page_id")
    return nesting.maximal(nodes, F.expr("size div 4"), F.expr("3 * size div 4")).select("page_id", "tag", "start", "end")


@_query(f"""WITH RECURSIVE {_TREE} SELECT n.tag, p.tag AS parent, count(*) AS n, CAST(sum(n."end" - n.start) AS BIGINT) AS chars FROM nodes n LEFT JOIN nodes p ON p.page_id = n.page_id AND p.k = n.parent GROUP BY ALL""")
def element_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by their tag and their parent's."""
    nodes = durable(nesting.elements(_table(spark, sf_dir, "pages"), "page_id", "html"), "elements")
    above = nodes.select("page_id", F.col("node").alias("parent"), F.col("tag").alias("above"))
    return nodes.join(above, ["page_id", "parent"], "left").groupBy("tag", F.col("above").alias("parent")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("chars"))


@_query("""WITH m AS (SELECT page_id, unnest(x) AS x, unnest(range(len(x))) AS i FROM (SELECT page_id, regexp_extract_all(html, '[<>]') AS x FROM pages)),
d AS (SELECT page_id, i, sum(CASE x WHEN '<' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM m)
SELECT page_id, count(*) AS n, CAST(min(depth) AS BIGINT) AS least, CAST(max(depth) AS BIGINT) AS greatest, CAST(arg_max(depth, i) AS BIGINT) AS final, count(*) FILTER (depth = 0) AS n_outside FROM d GROUP BY page_id""")
def running_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of angle brackets along each page, scanned in chunks of 500 characters."""
    d = nesting.depths(_table(spark, sf_dir, "pages"), "page_id", "html", chunk=500)
    return d.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("least"), F.max("depth").alias("greatest"), F.max_by("depth", F.struct("chunk", "at")).alias("final"), F.count_if(F.col("depth") == 0).alias("n_outside"))


# containment: J6

_SPANS = """outers AS (
  SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 60000000) * 60 AS BIGINT) AS z FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, -1, min(epoch_us(ts)), max(epoch_us(ts)) + 864000000000 FROM events GROUP BY user_id
), inners AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS z FROM events)"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hours that follow from a purchase's value, and for each user all time; and minutes of every event."""
    e = _table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    length = F.floor(F.col("value") * 60000000).cast("long")
    bought = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("us").alias("start"), (F.col("us") + length * 60).alias("end"))
    every = e.groupBy("user_id").agg(F.min("us").alias("start"), (F.max("us") + 864000000000).alias("end")).select("user_id", F.lit(-1).cast("long").alias("event_id"), "start", "end")
    return bought.unionByName(every), e.select("user_id", F.col("us").alias("start"), (F.col("us") + length).alias("end"))


@_query(f"WITH {_SPANS} SELECT o.user_id, o.event_id, count(*) AS n, CAST(max(i.z - i.a) AS BIGINT) AS longest FROM outers o JOIN inners i ON i.user_id = o.user_id AND i.a >= o.a AND i.z <= o.z GROUP BY o.user_id, o.event_id")
def contained_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that lie wholly within the time after each purchase of their user, and within all time."""
    outer, inner = _spans(spark, sf_dir)
    pairs = intervals.contained(durable(outer, "outer"), inner, ["user_id"])
    return pairs.groupBy("user_id", F.col("outer.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("inner.end") - F.col("inner.start")).alias("longest"))


@_query(f"WITH {_SPANS}, wide AS (SELECT event_id, a, z FROM outers WHERE event_id >= 0 UNION ALL SELECT -1, min(a), max(z) FROM outers) SELECT o.event_id, (SELECT count(*) FROM inners i WHERE i.a >= o.a AND i.a <= o.z) AS n FROM wide o")
def points_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users' events in the time after each purchase, and in an interval over everything."""
    outer, inner = _spans(spark, sf_dir)
    one = F.lit(1).alias("g")
    wide = outer.filter("event_id >= 0").select(one, "event_id", "start", "end").unionByName(outer.agg(F.min("start").alias("start"), F.max("end").alias("end")).select(one, F.lit(-1).cast("long").alias("event_id"), "start", "end"))
    return intervals.points_inside(durable(wide, "outer"), inner.select(one, F.col("start").alias("at")), ["g"]).select("event_id", "n")


# nearest definition: J13, O4

_PLACES = r"""place AS (
  SELECT page_id, url, regexp_extract(url, '^https?://[^/]*?([a-z0-9-]+\.[a-z]+)(/|$)', 1) AS name,
         '/' || array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.')), '/') || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS file FROM pages
), folders AS (SELECT *, string_split(regexp_replace(file, '/[^/]*$', ''), '/') AS parts FROM place)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = F.regexp_extract("url", r"^https?://([^/?#]*)", 1), F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    file = F.concat(F.lit("/"), F.array_join(F.reverse(F.split(host, r"\.")), "/"), path)
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://[^/]*?([a-z0-9-]+\.[a-z]+)(/|$)", 1).alias("name"), file.alias("file"))


@_query(f"""WITH {_PLACES}, pairs AS (
  SELECT r.page_id, r.name, d.file, d.page_id AS ord, r.parts AS a, d.parts AS b, len(list_filter(range(1, least(len(r.parts), len(d.parts)) + 1), lambda i: r.parts[1:i] = d.parts[1:i])) AS same
  FROM folders r JOIN folders d ON d.name = r.name WHERE starts_with(r.url, 'http:') AND starts_with(d.url, 'https:')
), far AS (SELECT page_id, name, file, ord, CAST(CASE WHEN len(a) > same THEN 100 * (len(a) - same) ELSE len(b) - same END AS INT) AS distance FROM pairs)
SELECT page_id, name, file, distance FROM far QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY distance, ord, file) = 1""")
def nearest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each http page the nearest https page of its domain; a domain has many pages of both."""
    places = durable(_places(spark, sf_dir), "places")
    asked = places.filter("url LIKE 'http:%'").select("page_id", "name", F.regexp_replace("file", "/[^/]*$", "").alias("folder"))
    known = places.filter("url LIKE 'https:%'").select("name", "file", F.col("page_id").alias("ord"))
    return nearest.nearest(asked, known).select("page_id", "name", "file", "distance")


# many names: X15


@_query(r"""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS name FROM benchmark),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM documents)
SELECT doc_id, name, CAST(count(*) AS INT) AS n FROM t JOIN names USING (name) GROUP BY doc_id, name""")
def names_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of benchmark items in all documents, as whole words."""
    wanted = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("name"))
    return names.found(_table(spark, sf_dir, "documents"), wanted, "doc_id", "text").select("doc_id", "name", "n")


@_query(r"""WITH names AS (SELECT DISTINCT trim(unnest(regexp_extract_all(text, '[^.\n]+'))) AS name FROM benchmark)
SELECT doc_id, name, CAST(instr(text, name) - 1 AS INT) AS first FROM documents JOIN names ON contains(text, name) WHERE length(name) >= 20""")
def sentences_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of benchmark items in all documents, and where each first stands."""
    wanted = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^.\n]+"), F.lit(0))).alias("name")).select(F.trim("name").alias("name")).filter("length(name) >= 20")
    return names.found(_table(spark, sf_dir, "documents"), wanted, "doc_id", "text", whole=False).select("doc_id", "name", "first")
