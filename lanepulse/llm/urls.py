"""URL filters: host rules, then a blocked Bloom filter before an exact join.

A list of canonical URLs can be as large as the pages themselves, so pages are not joined
with it outright. Its keys are first folded into a blocked Bloom filter: one block of eight
32-bit words per key, one bit in each word. The filter has at most `max_blocks` blocks, which
bounds what is broadcast (40 bytes a block); a longer list only makes it fuller. Pages that
hit the filter go on to an exact join with the list, which removes every false positive, so
the filter decides the work and never the result. All expressions are built in.

Defined results: a null URL or one without `://` has an empty host and path, no canonical
form and no rule, and is allowed. Repeated pages are each judged; repeated list entries count
once. Null list entries are ignored. Empty tables give empty results. Page columns pass
through; columns this operator adds replace equally named ones.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.llm.bloom import MAX_BLOCKS, with_hits
from lanepulse.llm.stored import held

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host rules as (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", F.coalesce(url, F.lit(""))) > 0, F.substr(url, F.locate("://", url) + F.lit(3)))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without `www.` and default port, path without last slashes, sorted parameters
    without tracking ones; scheme and fragment dropped. Null where there is no `://`."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]*|ref)="))
    return F.when(
        _rest(url).isNotNull(), F.concat(host, path, F.lit("?"), F.array_join(F.array_sort(kept), "&"))
    )


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    rule_host, _, rest = rule.partition("/")
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one. `rules` is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        fits = rule_fits(host, path, text)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """Pages with host, path, canonical, rule and verdict. `listed` has the listed URLs in
    column `url`, in any form. A rule decides where one fits, else pages on the list are
    blocked."""
    added = ("host", "path", "canonical", "rule", "verdict")
    keys = held(listed.select(canonical_url(F.col(f"`{url}`")).alias("listed_url")).where("listed_url IS NOT NULL").distinct())

    source = F.col(f"_page.`{url}`")
    page = pages.select(F.struct("*").alias("_page"))
    page = page.select("_page", url_host(source).alias("_host"), url_path(source).alias("_path"),
                       canonical_url(source).alias("_key"))
    rule, verdict = longest_rule(F.col("_host"), F.col("_path"), rules)
    page = page.select("*", rule.alias("_rule"), verdict.alias("_ruled"))
    probed = with_hits(page, ["_key"], keys, ["listed_url"], max_blocks)
    open_hit = F.col("_hit") & F.col("_ruled").isNull()
    columns = ["_page", "_host", "_path", "_key", "_rule"]
    decided = probed.where(~open_hit).select(*columns, F.coalesce("_ruled", F.lit("allow")).alias("_verdict"))
    asked = probed.where(open_hit).select(*columns).join(keys, F.col("_key") == F.col("listed_url"), "left")
    asked = asked.select(*columns, F.when(F.col("listed_url").isNull(), "allow").otherwise("block").alias("_verdict"))
    kept = [F.col(f"_page.`{c}`").alias(c) for c in pages.columns if c not in added]
    return decided.unionByName(asked).select(
        *kept, *[F.col(f"_{n}").alias(a) for n, a in zip(("host", "path", "key", "rule", "verdict"), added, strict=True)]
    )
