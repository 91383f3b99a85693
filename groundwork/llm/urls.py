"""URL filters: rules first, then a path-template tree for each host.

A path is split into segments; digits, long hexadecimal names and very long names become wildcards
of their kind. From the root down, a host's tree keeps a segment as it is only if it is common below
its parent (``SUPPORT`` pages) and the share of good labels below
it differs from that of its siblings by more than ``Z`` standard errors; all other siblings are
merged into ``*``. What a path is turned into is its template. A template is rejected if its labelled
purity, smoothed towards that of its host, which is smoothed towards that of all, is under
``PURITY``.

The tree grows over counts of distinct shapes, so a host with a third of all pages is a few rows; its
pages find their template by a join whose hot keys Spark splits. All of it is built of Spark's own
functions.

Labels say whether the page of that id is good (``labels.quality``); pages without one count for
support only. The test tables label documents, and pages share their ids; nothing better is at hand.

Defined cases: a null url, or one without ``://``, has empty host and path, and no template but the
root's; the longest rule wins and the earlier of equal ones; repeated labels count each, a label
other than 0 or 1 is ignored; without labels nothing is rejected; repeated rows and a null id are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import cut, discard, id_text, table

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SUPPORT, Z = 20, 2.58
SMOOTH, PURITY = 10.0, 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. A rule's host covers its subdomains."""
    rule = verdict = F
    for what, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = rule.when(fits, rule_host + rule_path), verdict.when(fits, what)
    return (F.lit(None).cast("string"),) * 2 if rule is F else (rule, verdict)


def shape_of(path: Column) -> Column:
    """array<string>: the path's segments, with variable parts replaced."""

    def kind(s: Column) -> Column:
        low = F.lower(s)
        return (
            F.when(low.rlike("^[0-9a-f-]{16,}$"), F.lit("{hex}"))
            .when(F.length(s) > 40, F.lit("{long}"))
            .otherwise(F.regexp_replace(low, "[0-9]+", "#"))
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind)


def _differs(good: Column, n: Column, good_all: Column, n_all: Column) -> Column:
    """Whether a child's share of good labels is unlike that of its siblings (two-proportion test)."""
    rest = n_all - n
    share = good_all / n_all
    error = F.sqrt(share * (1 - share) * (F.lit(1.0) / n + F.lit(1.0) / rest))
    z = F.abs(good / n - (good_all - good) / rest) / F.when(error > 0, error)
    return F.coalesce(F.when((n > 0) & (rest > 0), z > Z), F.lit(False))


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of every distinct shape; pages (id, host, shape), labels (id, good 0/1)."""
    counts = (
        labels.where(F.col("good").isin(0, 1) & F.col("id").isNotNull())
        .groupBy(F.col("id").alias("_id"))
        .agg(F.count(F.lit(1)).alias("known"), F.sum(F.col("good").cast("long")).alias("good"))
    )
    tree = cut(
        pages.select("id", "host", "shape")
        .join(counts, F.col("id") == F.col("_id"), "left")
        .groupBy("host", "shape")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("known"), F.lit(0)).alias("known"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        )
        .withColumn("template", F.lit("")),
        "url-0",
    )
    depth = 0
    while True:
        inner = tree.where(F.size("shape") > depth).withColumn("child", F.get("shape", F.lit(depth)))
        if inner.groupBy("host", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT).isEmpty():
            break  # no branch can be kept from here on
        child = inner.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("good").alias("good"))
        parent = inner.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(
            F.sum("n").alias("n_all"), F.sum("known").alias("known_all"), F.sum("good").alias("good_all")
        )
        literal = (
            child.join(parent, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
            .where(F.col("n") >= SUPPORT)
            .where(_differs(F.col("good"), F.col("known"), F.col("good_all"), F.col("known_all")))
            .select("_h", "_t", F.col("child").alias("_c"))
        )
        here = F.get("shape", F.lit(depth))
        new = cut(
            tree.join(literal, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (here == F.col("_c")), "left")
            .withColumn(
                "template",
                F.when(here.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("_c", F.lit("*")))),
            )
            .drop("_h", "_t", "_c"),
            f"url-{depth + 1}",
        )
        discard(tree)
        tree, depth = new, depth + 1
    rest = F.repeat(F.lit("/*"), F.greatest(F.size("shape") - depth, F.lit(0)))
    tree = tree.withColumn("template", F.concat("template", rest))
    all_ = tree.agg(F.sum("known").alias("k"), F.sum("good").alias("g")).first()
    base = (all_["g"] or 0) / all_["k"] if all_["k"] else 1.0
    hosts = tree.groupBy(F.col("host").alias("_h")).agg(
        ((F.sum("good") + SMOOTH * base) / (F.sum("known") + SMOOTH)).alias("host_purity")
    )
    leaf = tree.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("good").alias("good"))
    leaf = leaf.join(hosts, F.col("host") == F.col("_h")).select(
        F.col("host").alias("_lh"),
        F.col("template").alias("_lt"),
        ((F.col("good") + SMOOTH * F.col("host_purity")) / (F.col("known") + SMOOTH)).alias("purity"),
    )
    return tree.join(leaf, (F.col("host") == F.col("_lh")) & (F.col("template") == F.col("_lt"))).select(
        "host", "shape", "template", "purity"
    )


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row; labels are (id, good)."""
    rows = id_text(pages, id_col, url_col).select("id", host_of(F.col("text")).alias("host"), path_of(F.col("text")).alias("path"))
    rows = rows.withColumn("shape", shape_of(F.col("path")))
    found = cut(templates(rows, labels), "url-templates").select(
        F.col("host").alias("_h"), F.col("shape").alias("_s"), "template", "purity"
    )
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    return rows.join(found, (F.col("host") == F.col("_h")) & (F.col("shape") == F.col("_s")), "left").select(
        "id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("good"))
    return filter_urls(table(spark, sf_dir, "pages"), labels).withColumnRenamed("id", "page_id")


def oracle(levels: int = 8, rules=RULES) -> str:
    """The same as :func:`query` in SQL; a tree keeps segments as they are down to ``levels``, as SQL has no such loop."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = f"coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    kind = """CASE WHEN regexp_matches(lower(s), '^[0-9a-f-]{16,}$') THEN '{hex}' WHEN length(s) > 40 THEN '{long}'
  ELSE regexp_replace(lower(s), '[0-9]+', '#', 'g') END"""
    fits = [
        (f"(s.host = '{h}' OR ends_with(s.host, '.{h}')) AND starts_with(path, '{p}')", h + p, what)
        for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END" if fits else "NULL::VARCHAR"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{w}'" for f, _, w in fits) + " END" if fits else "NULL::VARCHAR"
    parts = [
        f"u AS (SELECT page_id, {host} AS host, {path} AS path FROM pages)",
        f"s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {kind}) AS shape FROM u)",
        "lab AS (SELECT doc_id, count(*) AS known, sum(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id)",
        """t0 AS (SELECT host, shape, count(*) AS n, coalesce(sum(known), 0)::DOUBLE AS known, coalesce(sum(good), 0)::DOUBLE AS good, '' AS template
  FROM s LEFT JOIN lab ON page_id = doc_id GROUP BY host, shape)""",
    ]
    for d in range(levels):
        sums = "sum(n) AS n, sum(known) AS known, sum(good) AS good"
        share = "(p.good / nullif(p.known, 0))"
        rest = "nullif(p.known - c.known, 0)"
        error = f"nullif(sqrt({share} * (1 - {share}) * (1 / nullif(c.known, 0) + 1 / {rest})), 0)"
        parts += [
            f"c{d} AS (SELECT host, template, shape[{d + 1}] AS child, {sums} FROM t{d} WHERE len(shape) > {d} GROUP BY ALL)",
            f"p{d} AS (SELECT host, template, {sums} FROM t{d} WHERE len(shape) > {d} GROUP BY ALL)",
            f"""l{d} AS (SELECT c.host, c.template, child FROM c{d} c JOIN p{d} p ON c.host = p.host AND c.template = p.template
  WHERE c.n >= {SUPPORT} AND abs(c.good / nullif(c.known, 0) - (p.good - c.good) / {rest}) / {error} > {Z})""",
            f"""t{d + 1} AS (SELECT t.host, shape, n, known, good,
  CASE WHEN len(shape) > {d} THEN t.template || '/' || coalesce(child, '*') ELSE t.template END AS template
  FROM t{d} t LEFT JOIN l{d} l ON t.host = l.host AND t.template = l.template AND shape[{d + 1}] = child)""",
        ]
    parts += [
        f"t AS (SELECT * REPLACE (template || repeat('/*', greatest(len(shape) - {levels}, 0)) AS template) FROM t{levels})",
        "b AS (SELECT coalesce(sum(good) / nullif(sum(known), 0), 1.0) AS base FROM t)",
        f"h AS (SELECT host, (sum(good) + {SMOOTH} * any_value(base)) / (sum(known) + {SMOOTH}) AS host_purity FROM t, b GROUP BY host)",
        f"""f AS (SELECT t.host, template, (sum(good) + {SMOOTH} * any_value(host_purity)) / (sum(known) + {SMOOTH}) AS purity
  FROM t JOIN h ON t.host = h.host GROUP BY t.host, template)""",
    ]
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT page_id, s.host, path, {rule} AS rule,
  coalesce({verdict}, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity
FROM s JOIN t ON s.host = t.host AND s.shape = t.shape JOIN f ON t.host = f.host AND t.template = f.template"""
    )
