"""URL filters by link-graph propagation.

Rules come first: a rule (host, path) fits its host and all subdomains when the url's path starts with the rule's path; the
longest rule wins. Every other page gets its host's verdict. Host edges are the links of all pages to
other hosts. Trust is a personalised PageRank that restarts at hosts with an allowed page and follows links;
distrust restarts at hosts with a blocked page and follows links backwards: who links to blocked
hosts is blamed. Restart weights of each walk add up to 1, and so do its scores: what reaches hosts without links goes back to the seeds.
The walks go on until no round changes either by more than TOLERANCE in all.

A host's scores are held against what one seed gets by restart alone if all seeds are alike (1 / seeds): so they mean the same
however many seeds there are. A host is blocked when its distrust is at least MIN_DISTRUST of that, and more of it than its trust is.

Both walks run in one frame of (direction, host) rows, written to the shared folder now and
then. Links are counted per pair of hosts before anything is joined; only hosts with a score have rows, and the joins' hot
hosts are split by adaptive execution.

Defined results: null urls and urls without ``://`` have empty host and path, no rule, and are allowed;
repeated rows are judged each and their links count each; a null html has no links; an empty table gives no
rows; texts are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.session import materialise

#: Fixed values: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DAMPING = 0.85
#: Change of a walk's scores in a round, all hosts together, at which it ends; ROUNDS bounds a walk that stays above.
TOLERANCE = 1e-3
ROUNDS = 60
WRITE_EVERY = 4
#: Least distrust of a blocked host, as a share of a seed's restart weight.
MIN_DISTRUST = 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
#: Rules up to this number are one expression; more are joined by host suffix.
INLINE_RULES = 200


def url_parts(url: Column) -> dict[str, Column]:
    """host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return {
        "host": F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit("")),
    }


def rule_columns(rules: list[tuple[str, str, str]] = RULES) -> dict[str, Column]:
    """rule and its verdict for columns host and path: the longest that fits, else null."""
    rule = verdict = None
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return {"rule": rule if rules else F.lit(None).cast("string"), "ruled": verdict if rules else F.lit(None).cast("string")}


def joined_rules(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (host, path and others) with rule and ruled, by a join of every suffix of the host with the rules' hosts."""
    table = rows.sparkSession.createDataFrame([(h, p, v) for v, h, p in rules], "rule_host string, rule_path string, what string")
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "ruled")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = rows.select("__row", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = met.groupBy("__row").agg(F.min(F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), F.col("what").alias("ruled"))).alias("x"))
    return rows.join(best.select("__row", "x.rule", "x.ruled"), "__row", "left").drop("__row")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts. Columns host, html."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> '' and dst <> src")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """way, host, score (adds up to 1 for each way), relative (score times the way's seeds). Edges (src, dst, n) carry trust
    forwards (way 1) and distrust backwards (way -1) from seeds (way, host)."""
    both = edges.select(F.lit(1).alias("way"), "src", "dst", "n").union(edges.select(F.lit(-1), F.col("dst"), F.col("src"), "n"))
    out = both.groupBy("way", "src").agg(F.sum("n").alias("total"))
    flow = materialise(both.join(out, ["way", "src"]).select("way", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")), "flow")
    seeds = seeds.select(F.col("way"), "host").distinct()
    # One row for each of the two ways.
    sizes = F.broadcast(seeds.groupBy("way").agg(F.count("*").alias("seeds")))
    restart = materialise(seeds.join(sizes, "way").select("way", "host", "seeds", (1 / F.col("seeds")).alias("start")), "seeds")
    scores = restart.select("way", "host", F.col("start").alias("score"))
    for i in range(1, rounds + 1):
        last = scores
        moved = last.join(flow, ["way", "host"]).groupBy("way", F.col("dst").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("score"))
        kept = F.broadcast(moved.groupBy("way").agg(F.sum("score").alias("kept")))
        back = restart.join(kept, "way", "left").select("way", "host", ((1 - F.coalesce("kept", F.lit(0.0))) * F.col("start")).alias("score"))
        # Scores are not rounded: multiplied by the seeds, that would make equal trust and distrust differ.
        scores = moved.union(back).groupBy("way", "host").agg(F.sum("score").alias("score"))
        if i % WRITE_EVERY == 1:
            scores = materialise(scores, "scores")
            before = last.select("way", "host", F.col("score").alias("before"))
            change = scores.join(before, ["way", "host"], "full").groupBy("way").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("x"))
            if all(r["x"] <= tolerance for r in change.collect()):
                break
    return scores.join(F.broadcast(restart.groupBy("way").agg(F.count("*").alias("seeds"))), "way").select("way", "host", "score", (F.col("score") * F.col("seeds")).alias("relative"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (both in restart weights of a seed) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parted = rows.withColumns(url_parts(F.col("url")))
    told = parted.drop("html")
    ruled = told.withColumns(rule_columns(rules)) if len(rules) <= INLINE_RULES else joined_rules(told, rules)
    seeds = ruled.where("ruled is not null").select(F.when(F.col("ruled") == "allow", 1).otherwise(-1).alias("way"), "host")
    scores = propagate(host_edges(parted), seeds)
    score = lambda way: F.sum(F.when(F.col("way") == way, F.col("relative")).otherwise(0.0))
    hosts = scores.groupBy("host").agg(score(1).alias("trust"), score(-1).alias("distrust"))
    joined = ruled.join(hosts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    bad = (F.col("distrust") >= MIN_DISTRUST) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce(F.col("ruled"), F.when(bad, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def url_digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict")


def url_sql(rules: list[tuple[str, str, str]] = RULES, rounds: int = 24) -> str:
    """The same in DuckDB SQL, one common table for each of ``rounds`` rounds."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered)) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered)) + " END"
    link = LINK.replace("'", "''")
    steps = ",\n".join(
        f"""m{i} AS MATERIALIZED (SELECT s.way, f.dst AS host, sum(s.score * f.share) * {DAMPING} AS score FROM s{i - 1} s JOIN flow f ON f.way = s.way AND f.host = s.host GROUP BY ALL),
s{i} AS MATERIALIZED (SELECT way, host, sum(score) AS score FROM (SELECT * FROM m{i} UNION ALL SELECT way, host, (1 - coalesce((SELECT sum(score) FROM m{i} WHERE m{i}.way = z.way), 0)) * score FROM s0 z) GROUP BY ALL)"""
        for i in range(1, rounds + 1)
    )
    return f"""
WITH r AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
u AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM p),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM p),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND src <> dst GROUP BY ALL),
b AS (SELECT 1 AS way, src, dst, n FROM e UNION ALL SELECT -1, dst, src, n FROM e),
flow AS MATERIALIZED (SELECT way, src AS host, dst, n / sum(n) OVER (PARTITION BY way, src) AS share FROM b),
s0 AS MATERIALIZED (SELECT way, host, 1 / count(*) OVER (PARTITION BY way) AS score FROM (SELECT DISTINCT CASE WHEN ruled = 'allow' THEN 1 ELSE -1 END AS way, host FROM u WHERE ruled IS NOT NULL)),
{steps},
h AS (SELECT host, sum(CASE WHEN way = 1 THEN score * n ELSE 0 END) AS trust, sum(CASE WHEN way = -1 THEN score * n ELSE 0 END) AS distrust
    FROM s{rounds} JOIN (SELECT way, count(*) AS n FROM s0 GROUP BY way) USING (way) GROUP BY host)
SELECT page_id, u.host, path, rule, coalesce(ruled, CASE WHEN distrust >= {MIN_DISTRUST} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN h ON h.host = u.host"""
