"""Stand-in inputs built from the driver's test tables.

The production inputs (delivery logs, scores, dimensions) are catalog tables
that are not available here, so they are derived from ``lineitem`` and
``orders`` by one SQL text per table. The same text runs in Spark (the test
tables are passed in as DataFrames) and, as a ``WITH`` prelude, in DuckDB for
the oracle, so both engines see identical rows.

Serve-key types follow the inferred production schema (``CreativeVersion``
int, ``TimeUsec`` bigint, ``Product`` string); each is a one-to-one image of
its source column, so the set of matching click/impression pairs is the same
as with the raw values.

What the stand-ins contain on purpose: users without an id in the targeting
map, NULL match keys, duplicate clicks, impressions without clicks, exact
duplicate score rows, NULL scores and deciles, several scores for one
(user, day, model) and sparse decile combinations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftlens.constants import USER_ID_KEY
from liftlens.session import path_exists
from liftlens.sources.catalog import Tables

# Dialect-specific map literals, keyed by token.
_MAP_TOKENS = {
    "spark": {
        "{MAP_X}": "map('other', 'x')",
        "{MAP_XID}": f"map('{USER_ID_KEY}', concat('x', o.o_custkey))",
    },
    "duckdb": {
        "{MAP_X}": "MAP {'other': 'x'}",
        "{MAP_XID}": f"MAP {{'{USER_ID_KEY}': concat('x', o.o_custkey)}}",
    },
}

# Stand-in definitions in dependency order. ``{name}`` refers to a test table
# or to an earlier stand-in.
STANDIN_SQL: dict[str, str] = {
    "imps": """
        select cast(o.o_orderdate as date) as logdate,
               l.l_suppkey % 100 as OrderId,
               l.l_partkey % 20 as LineItemId,
               l.l_linenumber as CreativeId,
               cast(l.l_quantity as int) as CreativeVersion,
               l.l_linestatus as CreativeSize,
               l.l_orderkey as AdUnitId,
               nullif(cast(round(l.l_tax * 100) as int), 0) as CityId,
               l.l_shipdate as Time,
               cast(round(l.l_extendedprice * 100) as bigint) as TimeUsec,
               cast(cast(round(l.l_discount * 100) as int) as varchar(8)) as Product,
               o.o_orderstatus as AdvertiserId,
               l.l_returnflag as flag,
               case when o.o_custkey % 11 = 0 then {MAP_X} else {MAP_XID} end as CustomTargeting
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    "clks": """
        select * from {imps} where flag = 'R' and AdUnitId % 97 <> 0
        union all
        select * from {imps} where flag = 'R' and AdUnitId % 50 = 0""",
    "base_scores": """
        select concat('x', o_custkey) as xid,
               cast(o_orderdate as date) as date,
               o_orderpriority as tid,
               case when o_orderkey % 41 = 0 then null else o_totalprice end as score,
               case when o_orderkey % 41 = 0 then null
                    else cast(10 - floor(least(o_totalprice, 499999.0) / 50000) as int) end as decile,
               o_orderkey % 20 = 0 as dup
        from {orders}""",
    "scores": """
        select xid, date, tid, score, decile from {base_scores}
        union all
        select xid, date, tid, score, decile from {base_scores} where dup""",
    "line_items": """
        select o_custkey % 100 as orderId,
               concat(o_orderpriority, '-', o_orderkey) as orderName,
               case when o_orderkey % 41 = 0 then null else o_orderdate end as creationDateTime
        from {orders}""",
    "segment_trait": """
        select distinct o_orderpriority as trait_id,
               concat('Segment > ', o_orderpriority) as segment_name
        from {orders}""",
}

BASE_TABLES = ("lineitem", "orders")


def _dialect(text: str, dialect: str) -> str:
    for token, literal in _MAP_TOKENS[dialect].items():
        text = text.replace(token, literal)
    return text


def standin_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All stand-ins as lazy Spark DataFrames over ``sf_dir``'s Parquet files."""
    frames: dict[str, DataFrame] = {
        name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name in BASE_TABLES
    }
    for name, body in STANDIN_SQL.items():
        text = _dialect(body, "spark")
        refs = {ref: frames[ref] for ref in frames if "{" + ref + "}" in text}
        frames[name] = spark.sql(text, **refs)
    return frames


def standin_tables(spark: SparkSession, sf_dir: str) -> Tables:
    f = standin_frames(spark, sf_dir)
    return Tables(
        impressions=f["imps"],
        clicks=f["clks"],
        scores=f["scores"],
        line_items=f["line_items"],
        segment_trait=f["segment_trait"],
        together="AdUnitId",  # the order key, by which both logs are joined
    )


def duckdb_prelude() -> str:
    """``WITH`` clause defining every stand-in for DuckDB, where the test
    tables are registered views. The caller appends more CTEs after a comma
    or a final ``select``."""
    ctes = []
    for name, body in STANDIN_SQL.items():
        text = _dialect(body, "duckdb")
        for ref in (*BASE_TABLES, *STANDIN_SQL):
            text = text.replace("{" + ref + "}", ref)
        ctes.append(f"{name} as ({text}\n)")
    return "with " + ",\n".join(ctes)


# Columns each stand-in is clustered on when written out (production layout:
# logs by log date, scores by model and date).
_CLUSTER_COLUMNS = {
    "imps": ("logdate",),
    "clks": ("logdate",),
    "scores": ("tid", "date"),
    "line_items": ("orderId",),
    "segment_trait": ("trait_id",),
}


def write_standins(spark: SparkSession, sf_dir: str, root: str, files_per_table: int | None = None) -> Tables:
    """Write the stand-ins once as Parquet tables under ``root`` (a shared
    folder) and return them read back, laid out like production tables: each
    file holds a contiguous range of the clustering columns (the log date for
    the logs, model and date for the scores), so window and model predicates
    skip files and row groups by their statistics, and scans run one task per
    file.

    ``root`` is reused when it already holds a complete copy (a ``_SUCCESS``
    marker per table); name it after the stand-in definitions and the input.
    """
    frames = standin_frames(spark, sf_dir)
    n = files_per_table or spark.sparkContext.defaultParallelism
    out = {}
    for name, cols in _CLUSTER_COLUMNS.items():
        path = f"{root.rstrip('/')}/{name}"
        df = frames[name].drop("flag") if name in ("imps", "clks") else frames[name]
        if not path_exists(spark, f"{path}/_SUCCESS"):
            df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)
        out[name] = spark.read.schema(df.schema).parquet(path)
    return Tables(
        impressions=out["imps"],
        clicks=out["clks"],
        scores=out["scores"],
        line_items=out["line_items"],
        segment_trait=out["segment_trait"],
    )


def standin_fingerprint(sf_dir: str) -> str:
    """Short digest of the stand-in definitions and the input files, for
    naming a written copy."""
    import hashlib
    import os

    h = hashlib.sha256()
    for name, body in STANDIN_SQL.items():
        h.update(name.encode() + body.encode())
    h.update(repr(sorted(_CLUSTER_COLUMNS.items())).encode())
    for name in BASE_TABLES:
        st = os.stat(f"{sf_dir.rstrip('/')}/{name}.parquet")
        h.update(f"{name}:{st.st_size}:{int(st.st_mtime)}".encode())
    return h.hexdigest()[:12]
