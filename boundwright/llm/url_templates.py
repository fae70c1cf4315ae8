"""URL filter: host and path rules first, then a tree of path templates for each host.

A path's segments are first reduced to their shape (runs of digits to `{n}`, long hexadecimal runs to
`{h}`), and pages are added up by host and shape, so what follows works on shapes, not on pages.

* Generalise, from the root down: a segment stays as it is if it has at least LITERAL of its parent's
  pages, or PRIOR labelled pages that are good more or less often than those of its siblings (as below); else it becomes `*`.
  Where only one shape of a host goes on below a segment, the rest of its path stays as it is, so rounds end where paths part for the last time.
* Merge, from the leaves up: a branch whose labelled pages are good about as often as those of its
  siblings taken together (a z-score within SIMILAR, or too few labels to tell) becomes `*` too.
* Judge: a template's purity is its share of good labelled pages, smoothed by PRIOR pages of the share of
  all; below LEAST the template is rejected.

Everything is DataFrame operations. Sums by host and shape are combined before they are shuffled, so of a host with a
third of all pages those of one shape are a row; paths of words without digits are as many shapes as pages, dealt out by
their segments.

Defined results: a null url, or one without `://`, has an empty host and path and the template of such
pages; a null page_id has no label; labels other than 0 and 1 do not count; several labels of a page count once, as the least;
repeated pages each get a row and count each; of rules of equal length that fit, which can be only one host and path given twice, the
later counts; paths of any depth and length keep all their segments, and branches that part at any depth are told apart; an empty table gives an empty one; columns other
than page_id and url are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import table, written

LITERAL, SIMILAR, PRIOR, LEAST = 0.02, 2.0, 10.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. rules: a short list, it becomes one expression."""
    found = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.lit(f"{verdict} {h}{p}")).otherwise(found)
    return F.substring_index(found, " ", -1), F.substring_index(found, " ", 1)


def shape(path: Column) -> Column:
    """The segments of a path, with digits and long hexadecimal runs replaced."""
    plain = F.regexp_replace(F.regexp_replace(path, "(?i)[0-9a-f]{16,}", "{h}"), "[0-9]+", "{n}")
    return F.filter(F.split(plain, "/"), lambda x: x != "")


def told_apart() -> Column:
    """Whether g good of k labelled pages differ from the others among all_g of all_k: a z-score over SIMILAR. False where there are too few labels to tell."""
    others_k, others_g = F.col("all_k") - F.col("k"), F.col("all_g") - F.col("g")
    share = F.try_divide("all_g", "all_k")
    by = F.abs(F.try_divide("g", "k") - F.try_divide(others_g, others_k))
    z = F.try_divide(by, F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), "k") + F.try_divide(F.lit(1.0), others_k))))
    return F.coalesce(z > SIMILAR, F.lit(False)) & (share > 0) & (share < 1)


def generalised(shapes: DataFrame) -> tuple[DataFrame, int]:
    """shapes (host, shape, n, labelled, good) with `template`, an array as long as shape; and the last level at which paths part.

    A round is a level. Paths that end, and those that go on alone from their node (they would stay as they are), leave the rounds.
    """
    names = ["host", "shape", "n", "labelled", "good", "template"]
    left, done, level = shapes.withColumn("template", F.expr("CAST(array() AS array<string>)")), [], 0
    while True:
        level += 1
        own = F.try_element_at("shape", F.lit(level))
        children = left.filter(own.isNotNull()).groupBy("host", "template", own.alias("segment")).agg(F.sum("n").alias("m"), F.sum("labelled").alias("k"), F.sum("good").alias("g"), F.count("*").alias("shapes"))
        parents = children.groupBy("host", "template").agg(F.sum("m").alias("all"), F.sum("k").alias("all_k"), F.sum("g").alias("all_g"), F.sum("shapes").alias("all_shapes"))
        evident = (F.col("k") >= PRIOR) & told_apart()
        kept = children.join(parents, ["host", "template"])
        kept = kept.select("host", "template", "segment", F.coalesce((F.col("m") >= LITERAL * F.col("all")) | evident, F.lit(False)).alias("kept"), (F.col("all_shapes") == 1).alias("alone"))
        met = left.withColumn("segment", own).join(kept, ["host", "template", "segment"], "left")
        added = F.when(F.col("alone"), F.slice("shape", F.lit(level), F.size("shape"))).otherwise(F.array(F.when(F.col("kept"), F.col("segment")).otherwise("*")))
        template = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", added))
        is_open = F.col("segment").isNotNull() & ~F.coalesce("alone", F.lit(True))
        met = written(met.select(*names[:-1], template.alias("template"), is_open.alias("open")), f"level-{level}")
        done.append(met.filter("NOT open").select(names))
        left = met.filter("open").select(names)
        if left.isEmpty():
            return reduce(DataFrame.union, done), level


def merged(shapes: DataFrame, levels: int) -> DataFrame:
    """shapes with templates, each segment of which became `*` where the labels of its branch are like its siblings'. Below the last level no branch has siblings."""
    out = shapes
    for level in range(levels, 0, -1):
        own = F.try_element_at("template", F.lit(level))
        rest = F.slice("template", F.lit(level + 1), F.size("template"))
        branch = out.filter(own.isNotNull()).groupBy("host", F.slice("template", 1, level - 1).alias("parent"), own.alias("segment"), rest.alias("rest")).agg(F.sum("labelled").alias("k"), F.sum("good").alias("g"))
        siblings = branch.groupBy("host", "parent", "rest").agg(F.sum("k").alias("all_k"), F.sum("g").alias("all_g"), F.count("*").alias("branches"))
        apart = branch.join(siblings, ["host", "parent", "rest"]).filter(told_apart() | (F.col("branches") == 1)).select("host", "parent", "segment", "rest", F.lit(True).alias("apart"))
        out = out.withColumns({"parent": F.slice("template", 1, level - 1), "segment": own, "rest": rest}).join(apart, ["host", "parent", "segment", "rest"], "left")
        name = F.when(F.coalesce("apart", F.lit(False)), F.col("segment")).otherwise(F.lit("*"))
        out = out.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("parent", F.array(name), "rest"))).drop("parent", "segment", "rest", "apart")
        out = written(out, f"merged-{level}")
    return out


def templates(pages: DataFrame) -> DataFrame:
    """pages (host, shape, label) to (host, shape, template, purity, rejected)."""
    good = F.when(F.col("label").isin(0, 1), F.col("label"))
    shapes = written(pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(good).alias("labelled"), F.coalesce(F.sum(good), F.lit(0)).alias("good")), "shapes")
    whole = shapes.agg(F.sum("labelled").alias("k"), F.sum("good").alias("g")).first()
    prior = (whole.g + 1) / (whole.k + 2) if whole.k is not None else 0.5
    tree = merged(*generalised(shapes))
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("k"), F.sum("good").alias("g"))
    judged = sums.withColumn("purity", (F.col("g") + F.lit(PRIOR * prior)) / (F.col("k") + F.lit(PRIOR))).withColumn("rejected", F.col("purity") < LEAST)
    return tree.select("host", "shape", "template").join(judged.drop("k", "g"), ["host", "template"]).select("host", "shape", "template", "purity", "rejected")


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of pages (page_id, url). labels: (page_id, label), 1: good."""
    host, path = host_and_path("url")
    known = labels.groupBy("page_id").agg(F.min("label").alias("label"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", shape(F.col("path")))
    parsed = written(parsed.join(known, "page_id", "left"), "parsed")
    tree = written(templates(parsed), "templates")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("rejected"), "block").otherwise("allow")
    return parsed.join(tree, ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_tree).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("purity", 9).alias("purity")
    )


def op9_path_templates(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict. A page is labelled by the document whose id its path names last: good, if of quality and not toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = F.regexp_extract(host_and_path("url")[1], "([0-9]{1,18})[^0-9]*$", 1)
    documents = pages.select("page_id", F.when(named != "", named.cast("long")).alias("doc_id"))
    marks = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("label"))
    return judged(pages, documents.join(marks, "doc_id").select("page_id", "label"))


QUERIES = {"op9_path_templates": op9_path_templates}


def oracle() -> str:
    """The same in DuckDB's SQL: one recursion down the paths, one up."""
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(h, p, v)}'" for h, p, v in rules) + " END"
    parts = [
        "_u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"_h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM _u)",
        "_n AS (SELECT *, TRY_CAST(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT) AS doc_id FROM _h)",
        "_y AS (SELECT page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS label FROM _n JOIN labels ON labels.doc_id = _n.doc_id GROUP BY page_id)",
        "_s AS (SELECT page_id, host, path, list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{16,}', '{h}', 'g'), '[0-9]+', '{n}', 'g'), '/'), lambda x: x <> '') AS segs FROM _n)",
        "_p AS (SELECT _s.page_id, host, path, label, segs AS shape FROM _s LEFT JOIN _y ON _y.page_id = _s.page_id)",
        "_g0 AS (SELECT host, shape, count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0) AS good, CAST([] AS VARCHAR[]) AS template FROM _p GROUP BY host, shape)",
        "_prior AS (SELECT (sum(good) + 1) / (sum(labelled) + 2) AS prior, max(len(shape)) AS deepest FROM _g0)",
    ]
    differs = f"CASE WHEN ag > 0 AND ag < ak AND k > 0 AND k < ak THEN abs(g / k - (ag - g) / (ak - k)) / sqrt(ag / ak * (1 - ag / ak) * (1.0 / k + 1.0 / (ak - k))) > {SIMILAR} ELSE false END"
    sums = "sum(labelled) OVER c AS k, sum(good) OVER c AS g, sum(labelled) OVER w AS ak, sum(good) OVER w AS ag"
    windows = "WINDOW c AS (PARTITION BY host, {0}, segment), w AS (PARTITION BY host, {0}, segment IS NULL)"
    parts += [
        "_g AS (SELECT 0 AS level, host, shape, n, labelled, good, template FROM _g0 UNION ALL"
        f" SELECT level + 1, host, shape, n, labelled, good, CASE WHEN segment IS NULL THEN template ELSE list_append(template, CASE WHEN m >= {LITERAL} * of_all OR (k >= {PRIOR} AND {differs}) THEN segment ELSE '*' END) END"
        f" FROM (SELECT *, sum(n) OVER c AS m, sum(n) OVER w AS of_all, {sums} FROM (SELECT _g.*, shape[level + 1] AS segment FROM _g, _prior WHERE level < deepest) {windows.format('template')}))",
        "_m AS (SELECT level, host, shape, n, labelled, good, template FROM _g, _prior WHERE level = deepest UNION ALL"
        f" SELECT level - 1, host, shape, n, labelled, good, CASE WHEN segment IS NULL THEN template ELSE list_concat(list_append(parent, CASE WHEN lone OR {differs} THEN segment ELSE '*' END), rest) END"
        f" FROM (SELECT *, min(segment) OVER w = max(segment) OVER w AS lone, {sums} FROM (SELECT *, template[1:level - 1] AS parent, template[level] AS segment, template[level + 1:] AS rest FROM _m WHERE level > 0) {windows.format('parent, rest')}))",
        "_l AS (SELECT * FROM _m WHERE level = 0)",
    ]
    parts += [
        f"_t AS (SELECT host, template, (sum(good) + {PRIOR} * any_value(prior)) / (sum(labelled) + {PRIOR}) AS purity FROM _l, _prior GROUP BY host, template)",
        "_j AS (SELECT m.host, m.shape, m.template, purity FROM _l m JOIN _t ON _t.host = m.host AND _t.template = m.template)",
    ]
    return (
        f"WITH RECURSIVE {', '.join(parts)} SELECT page_id, _p.host, path, {case(lambda h, p, v: h + p).replace('host', '_p.host')} AS rule,"
        f" coalesce({case(lambda h, p, v: v).replace('host', '_p.host')}, CASE WHEN purity < {LEAST} THEN 'block' ELSE 'allow' END) AS verdict,"
        " concat('/', array_to_string(template, '/')) AS template, round(purity, 9) AS purity FROM _p JOIN _j ON _j.host = _p.host AND _j.shape = _p.shape"
    )


ORACLE_SQL = {"op9_path_templates": oracle()}
