"""URL filtering by site rules and mined association rules, all in Spark SQL.

URLs become sets of tokens. FP-growth mines token combinations from labelled
URLs together with the label; combinations that reach a support and a
confidence become block rules. Rules are looked up through an inverted index
from one of their tokens (the rarest) to the rules, held as a literal map, or,
beyond ``LITERAL_RULES`` rules, as one value that is sent to the tasks; judging
takes no join and no shuffle.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

MIN_SUPPORT = 0.002
MIN_ROWS = 20
MIN_CONFIDENCE = 0.6
LITERAL_RULES = 500  # more of them are not written into the plan
BLOCK_ITEM = "label=block"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SiteRule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TokenRule:
    """Block URLs that have all these tokens; the first is the index key."""

    tokens: tuple[str, ...]
    confidence: float
    support: int


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(_u, locate('://', _u) + 3)")).otherwise(F.lit(""))


def with_parts(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path`` of a URL; both are empty for
    null or a text without ``://``."""
    rest = rows.withColumn("_u", F.coalesce(F.col(url_col).cast("string"), F.lit(""))).withColumn("_r", _after_scheme(F.col("_u")))
    raw = F.regexp_extract("_r", r"^([^/?#]*)", 1)
    rest = rest.withColumn("_h", raw)
    path = F.regexp_extract(F.expr("substring(_r, length(_h) + 1)"), r"^([^?#]*)", 1)
    return rest.withColumn("path", path).withColumn("host", F.translate("_h", UPPER, LOWER)).drop("_u", "_r", "_h")


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def site_rule(rules: list[SiteRule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict); null if none does."""
    by_host: dict[str, list[SiteRule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,path:string>")
    index = F.create_map(
        *(
            x
            for h, own in by_host.items()
            for x in (
                F.lit(h),
                F.array(
                    *(
                        F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))
                        for r in own
                    )
                ),
            )
        )
    )
    found = F.flatten(F.transform(host_suffixes(host), lambda s: F.coalesce(F.try_element_at(index, s), F.array())))
    return F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: host labels, whole domain, path segments
    without plain numbers, the path's file ending, query names, fragment flag."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.translate(path, UPPER, LOWER), "/"), lambda s: (F.length(s) > 0) & ~s.rlike(r"^[0-9]+(\.[a-z0-9]+)?$"))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda q: F.regexp_extract(q, r"^([^=]*)", 1)), lambda n: F.length(n) > 0)
    tokens = F.concat(
        F.transform(F.filter(labels, lambda x: F.length(x) > 0), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), x)),
        F.filter(F.array(F.concat(F.lit("ending:"), ending)), lambda x: x != "ending:"),
        F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
        F.filter(F.array(F.when(F.locate("#", url) > 0, F.lit("fragment"))), lambda x: x.isNotNull()),
    )
    return F.array_distinct(tokens)


def mine_rules(
    labelled: DataFrame,
    tokens_col: str = "tokens",
    block_col: str = "block",
    min_support: float = MIN_SUPPORT,
    min_rows: int = MIN_ROWS,
    min_confidence: float = MIN_CONFIDENCE,
) -> list[TokenRule]:
    """Block rules from rows with a token array and a boolean label.

    FP-growth over all tokens of all labelled rows. Tokens that are in the same
    rows (those of a template) are mined as one and stand for each other in the
    rules, so that only tokens that vary multiply the combinations. A rule needs ``min_rows`` rows and
    ``min_support`` of all rows (blocked ones with all its tokens) and
    ``min_confidence``. A rule is dropped if a part of it is already a rule of
    no lower confidence; all others are kept. No labelled row, or no combination
    that qualifies: no rules.
    """
    baskets = labelled.filter(F.col(block_col).isNotNull() & F.col(tokens_col).isNotNull())
    baskets = materialize(baskets.select(F.array_sort(F.array_distinct(tokens_col)).alias("tokens"), F.col(block_col).alias("block")), "baskets")
    total = baskets.count()
    if total < max(1, min_rows):
        return []
    support = min(1.0, max(min_support, min_rows / total))
    alike = _alike(baskets, math.ceil(support * total))
    if not alike:
        return []
    label = F.when(F.col("block"), F.array(F.lit(BLOCK_ITEM))).otherwise(F.array().cast("array<string>"))
    items = F.concat(F.filter("tokens", lambda t: t.isin(list(alike))), label)
    found = FPGrowth(itemsCol="items", minSupport=support).fit(baskets.select(items.alias("items")))
    sets = materialize(found.freqItemsets.select(F.array_sort("items").alias("tokens"), "freq"), "itemsets")
    blocked = sets.filter(F.array_contains("tokens", BLOCK_ITEM) & (F.size("tokens") > 1))
    blocked = blocked.select(F.array_remove("tokens", BLOCK_ITEM).alias("tokens"), F.col("freq").alias("support"))
    rules = blocked.join(sets, "tokens").select("tokens", "support", (F.col("support") / F.col("freq")).alias("confidence"))
    often = {r["tokens"][0]: r["freq"] for r in sets.filter(F.size("tokens") == 1).collect()}
    found = []
    for r in _irredundant(rules, min_confidence):
        first = sorted(r["tokens"], key=lambda t: (often[t], t))
        found += [TokenRule(tokens, r["confidence"], r["support"]) for tokens in product(*(alike[t] for t in first))]
    return sorted(found, key=lambda r: (-r.confidence, -r.support, len(r.tokens), sorted(r.tokens)))


def _alike(baskets: DataFrame, rows: int) -> dict[str, list[str]]:
    """The tokens of at least ``rows`` baskets, by the first of those that are in
    the same baskets. A basket has its share of ``rows``, so they are few."""
    wide = "decimal(20,0)"
    marks = [F.xxhash64(F.lit(i), "tokens").cast(wide).alias(f"h{i}") for i in range(2)]
    each = baskets.select(F.explode("tokens").alias("token"), *marks)
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h0").alias("s0"), F.sum("h1").alias("s1")).filter(F.col("n") >= rows)
    groups = often.groupBy("n", "s0", "s1").agg(F.array_sort(F.collect_list("token")).alias("own")).collect()
    return {r["own"][0]: r["own"] for r in groups}


def _irredundant(rules: DataFrame, min_confidence: float) -> list:
    """The rules of ``min_confidence`` without a part of no lower confidence, of
    (tokens, support, confidence) rows that have all parts of each row's tokens.
    From single tokens on, each row takes the best confidence of a rule among its
    parts from the parts that lack one token."""
    rules = materialize(rules, "rules")
    longest = rules.filter(F.col("confidence") >= min_confidence).agg(F.max(F.size("tokens"))).first()[0] or 0
    kept, below = [], None
    for size in range(1, longest + 1):
        level = rules.filter(F.size("tokens") == size)
        if below is None:
            level = level.withColumn("part_best", F.lit(0.0))
        else:
            part = F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part")
            parts = level.select("tokens", part).join(below.select(F.col("tokens").alias("part"), "best"), "part")
            level = level.join(parts.groupBy("tokens").agg(F.max("best").alias("part_best")), "tokens")
        own = F.when(F.col("confidence") >= min_confidence, F.col("confidence")).otherwise(F.lit(0.0))
        level = materialize(level.withColumn("best", F.greatest(own, "part_best")), "rules-level")
        kept += level.filter((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("part_best"))).collect()
        if below is not None:
            drop_table(below)
        below = level
    return kept


def matches(rules: list[TokenRule], tokens: Column) -> Column:
    """Whether any rule has all its tokens among ``tokens``."""
    if not rules:
        return F.lit(False)
    by_key: dict[str, list[TokenRule]] = {}
    for r in rules:
        by_key.setdefault(r.tokens[0], []).append(r)
    if len(rules) <= LITERAL_RULES:
        index = F.create_map(*(x for t, own in by_key.items() for x in (F.lit(t), F.array(*(F.array(*map(F.lit, r.tokens)) for r in own)))))
        found = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(index, t), F.array()))
    else:
        places: list[list[list[str]]] = [[] for _ in by_key]
        for t, own in by_key.items():
            places[zlib.crc32(t.encode()) % len(places)] += [list(r.tokens) for r in own]
        # the planner reads this once; written as arrays, each rule would be a part of the plan
        index = F.from_json(F.lit(json.dumps(places)), "array<array<array<string>>>")
        found = F.transform(tokens, lambda t: F.get(index, (F.crc32(t.cast("binary")) % len(places)).cast("int")))
    return F.exists(F.flatten(found), lambda need: F.size(F.array_except(need, tokens)) == 0)


def label_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", label_id: str = "doc_id", url_col: str = "url") -> DataFrame:
    """Tokens of the labelled URLs, with ``block``: low quality or toxic. Rows
    whose labels are both null, and ids without a label, are left out; an id
    with several labels blocks if any of them does."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    known = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    known = known.groupBy(F.col(label_id).alias("_id")).agg(F.max(bad).alias("_bad"))
    parts = with_parts(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url")
    tokens = url_tokens(F.col("host"), F.col("path"), F.coalesce("_url", F.lit("")))
    return parts.join(known, "_id").select(tokens.alias("tokens"), (F.col("_bad") == 1).alias("block"))


def judge(pages: DataFrame, site_rules: list[SiteRule], token_rules: list[TokenRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: the id, host, path, rule (the site rule that
    decides, or null), verdict (allow or block), token_match.

    The longest fitting site rule decides; without one, a matching token rule
    blocks and anything else is allowed. Null URLs have empty parts and are
    allowed. No shuffle.
    """
    parts = with_parts(pages.select(F.col(id_col), F.col(url_col).alias("_url")), "_url")
    host, path = F.col("host"), F.col("path")
    told = parts.withColumn("_site", site_rule(site_rules, host, path))
    told = told.withColumn("_tokens", url_tokens(host, path, F.coalesce("_url", F.lit(""))))
    told = told.withColumn("token_match", matches(token_rules, F.col("_tokens")))
    own = F.when(F.col("token_match"), F.lit("block")).otherwise(F.lit("allow"))
    return told.select(id_col, "host", "path", F.col("_site.rule").alias("rule"), F.coalesce("_site.verdict", own).alias("verdict"), "token_match")
