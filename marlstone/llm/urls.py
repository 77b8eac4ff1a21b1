"""URL filters: pattern rules indexed by their rarest literal token.

A rule is text as in public ad-filter lists: `||host^` matches a host and its subdomains, `|` at either end
is an anchor, `^` a separator or the end, `*` anything; `@@` in front makes an exception; `/.../` holds a bare
regular expression. A literal token of a rule is a run of ASCII letters and digits that any matching URL has as a
whole token. How many distinct URLs hold each rule token is counted over the whole table, and each rule
is filed under its rarest. A URL's own tokens fetch candidate rules, and only those run their regular
expression, compiled once a task. Rules without a token (as bare expressions) run on every URL. Options (`$third-party`), element rules (`##`), comments and empty rules are
refused. Of equally rare tokens the longest, then the first in the alphabet is taken, which changes nothing in the result.

A URL is blocked if a blocking rule matches and no exception does. Defined cases: a null URL is allowed with no
rules; an empty URL has no tokens, so only token-free rules can match it. Equal URLs are decided once and every row that
has one gets the same decision, with its own id, null or repeated. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
RULES = (
    "||spam-farm.example.org^",
    "||cheap-pills.example.com^",
    "||spam-farm.example.com^",
    "||cheap-pills.example.net^",
    "||casino-royal.example.net^",
    "||tracker.example.com^",
    "||adserver.example.org^",
    "||blog.ththth.example.org^",
    "://m.*/es/*#top|",
    "||blog.*.example.com/fr/*.html|",
    "?utm_source=feed|",
    "/de/666^",
    "/en/13^",
    "&ref=x|",
    "|http://www.*.example.org/es/",
    "/banner/*",
    "/popunder.",
    "/affiliate/*/click^",
    "/login?next=",
    "/wp-admin/",
    "@@||thther.example.org^",
    "@@||spam-farm.example.org/en/appeal^",
    "@@/en/*?page=2&ref=x|",
    "@@||blog.ththth.example.org/de/",
    "/^https?:[/][/][^/]*[0-9]{3}[^/]*[/]/",
    "/[/](en|de)[/][0-9]*77[0-9]*([^0-9]|$)/",
)


def compile_rule(rule: str) -> tuple[str, bool, list[str]]:
    """(regular expression on the lower-case URL, whether it blocks, its literal tokens)."""
    if not rule.strip() or rule.startswith("!") or "##" in rule or "#@#" in rule or (not rule.endswith("/") and re.search(r"[$]~?[a-z][a-z0-9~,=|_.-]*$", rule)):
        raise ValueError(f"not a rule for URLs: {rule!r}")
    blocks = not rule.startswith("@@")
    body = (rule if blocks else rule[2:]).lower()
    if len(body) > 2 and body[0] == body[-1] == "/" and re.search(r"[\\\[\](){}+$]", body):
        return body[1:-1], blocks, []
    head, tail = "", ""
    fixed_start, fixed_end = False, False
    if body.startswith("||"):
        head, body, fixed_start = "^[a-z][a-z0-9+.-]*://([^/?#]*[.])?", body[2:], True
    elif body.startswith("|"):
        head, body, fixed_start = "^", body[1:], True
    if body.endswith("|"):
        tail, body, fixed_end = "$", body[:-1], True
    pattern = "".join({"*": ".*", "^": "([^a-z0-9_.%-]|$)"}.get(c, c if c.isalnum() or not c.isascii() or c in "/:=&_-#" else f"[{c}]" if c in ".?+$(){}|*" else "\\" + c) for c in body)
    tokens = []
    for m in re.finditer(TOKEN, body):
        left = fixed_start if m.start() == 0 else body[m.start() - 1] != "*"
        right = fixed_end if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            tokens.append(m.group())
    return head + pattern + tail, blocks, sorted(set(tokens))


def filter_urls(pages: DataFrame, rules: Sequence[str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, verdict, rules): verdict is 'block' or 'allow', rules the numbers of all rules that match, in order, joined by commas."""
    spark = pages.sparkSession
    compiled = [(k, *compile_rule(r)) for k, r in enumerate(rules)]
    book = F.broadcast(spark.createDataFrame([(k, b) for k, _, b, _ in compiled], "rule int, blocks boolean"))
    words = spark.createDataFrame([(k, t) for k, _, _, ts in compiled for t in ts], "rule int, token string")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = rows.where("url is not null").select("url").distinct()
    tokens = urls.select("url", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    held = tokens.join(words.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rank = Window.partitionBy("rule").orderBy(F.coalesce("urls", F.lit(0)), F.length("token").desc(), "token")
    index = words.join(held, "token", "left").withColumn("rank", F.row_number().over(rank)).where("rank = 1").select("rule", "token")
    patterns = {k: p for k, p, _, _ in compiled}
    always = [k for k, _, _, ts in compiled if not ts]

    def matched(batches):
        """Of rows (url, its lower case, rule) those that match; a null rule stands for all rules without a token."""
        run = {k: re.compile(p).search for k, p in patterns.items()}
        for b in batches:
            hits = [(i, k) for i, (x, rule) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) for k in (always if rule is None else (rule,)) if run[k](x)]
            yield pa.record_batch([b.column(0).take(pa.array([i for i, _ in hits], pa.int64())), pa.array([k for _, k in hits], pa.int32())], names=["url", "rule"])

    fetched = tokens.join(F.broadcast(index), "token").select("url", F.lower("url").alias("x"), "rule")
    if always:
        fetched = fetched.union(urls.select("url", F.lower("url").alias("x"), F.lit(None).cast("int").alias("rule")))
    hits = fetched.mapInArrow(matched, "url string, rule int").join(book, "rule")
    found = hits.groupBy("url").agg(
        F.array_sort(F.collect_set("rule")).alias("rules"),
        F.bool_or("blocks").alias("blocked"),
        F.bool_or(~F.col("blocks")).alias("excepted"),
    )
    verdict = F.when(F.col("blocked") & ~F.col("excepted"), "block").otherwise("allow")
    return rows.join(found, "url", "left").select("page_id", "url", verdict.alias("verdict"), F.array_join(F.coalesce("rules", F.array().cast("array<int>")), ",").alias("rules"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(p)}, {str(b).lower()})" for k, (p, b, _) in enumerate(map(compile_rule, RULES)))
    return f"""
WITH rules(rule, pattern, blocks) AS (VALUES {values}),
u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL),
h AS (SELECT url, string_agg(CAST(rule AS VARCHAR), ',' ORDER BY rule) AS rules, bool_or(blocks) AND NOT bool_or(NOT blocks) AS blocked
      FROM u, rules WHERE regexp_matches(lower(url), pattern) GROUP BY url)
SELECT page_id, p.url, CASE WHEN blocked THEN 'block' ELSE 'allow' END AS verdict, coalesce(rules, '') AS rules
FROM pages p LEFT JOIN h ON p.url = h.url
"""


SQL = _sql()
