"""DuckDB oracle texts, one per registered query.

Each text is self-contained: the stand-in prelude, then a deliberately naive
formulation written the way the analysed notebook computes it (a literal left
join of impressions with clicks and its pair rows, one left join per model, two
grouped frames joined on the user id for the overlap), so the oracle checks the
rewritten Spark plans rather than repeating them.

Dialect rules: integer sums are cast back to ``bigint`` (DuckDB widens them),
Spark's half-up ``round`` of a double is reproduced through its decimal text,
NULLs sort first where order matters, and ``erfc`` is its power series.
"""

from __future__ import annotations

from liftlens.constants import (
    ALPHA_TEXT,
    BAND_HIGH,
    BAND_LOW,
    BAND_MEDIUM,
    BAND_UNSCORED,
    CORRELATION_TEXT,
    CTR_PERCENT_COLUMN,
    HIGH_MAX_DECILE,
    LOW_MIN_DECILE,
    MEDIUM_MAX_DECILE,
    MEDIUM_MIN_DECILE,
    MODEL_TITLE_PREFIX,
    ORDER_NAME_COLUMN,
    P_VALUE_TEXT,
    SERVE_KEYS,
    USER_ID_KEY,
    VERDICT_NOT_REJECTED,
    VERDICT_REJECTED,
)
from liftlens.params import Params
from liftlens.plans.queries import ALL_MODELS, DEFAULT_PARAMS, FIXTURE_PARAMS, LINE_ITEM_IDS, STAT_DIGITS
from liftlens.sources.standins import duckdb_prelude


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def _in(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def _round(expr: str, digits: int) -> str:
    """Spark's half-up rounding of a double (it rounds the decimal text)."""
    return f"cast(round(cast(cast(({expr}) as varchar) as decimal(38, 20)), {digits}) as double)"


def _band(col: str) -> str:
    return (
        f"case when {col} <= {HIGH_MAX_DECILE} then '{BAND_HIGH}' "
        f"when {col} between {MEDIUM_MIN_DECILE} and {MEDIUM_MAX_DECILE} then '{BAND_MEDIUM}' "
        f"when {col} >= {LOW_MIN_DECILE} then '{BAND_LOW}' else '{BAND_UNSCORED}' end"
    )


def _erfc(x: str) -> str:
    """erfc(x) = 1 - exp(-x^2) * sum_n x^(2n+1) / Gamma(n + 3/2), x >= 0."""
    return (
        f"(1 - list_sum([exp((2 * n + 1) * ln(greatest({x}, 1e-300)) - ({x}) * ({x}) - lgamma(n + 1.5)) "
        f"for n in range(0, 200)]))"
    )


def _log_ctes(p: Params) -> str:
    keys = ", ".join(SERVE_KEYS)
    xid = f"CustomTargeting['{USER_ID_KEY}']"
    where = (
        f"OrderId in {_in(p.order_ids)} and logdate between date '{p.start_date}' and date '{p.end_date}' "
        f"and {xid} is not null"
    )
    if p.line_item_ids:
        where += f" and LineItemId in {_in(p.line_item_ids)}"
    match = " and ".join(f"i.{k} = c.{k}" for k in SERVE_KEYS) + " and i.xid_imp = c.xid"
    return f""",
fi as (select {keys}, logdate as date, {xid} as xid_imp, 1 as impressions from imps where {where}),
fc as (select {keys}, logdate, {xid} as xid, 1 as clicks from clks where {where}),
pairs_ic as (select i.xid_imp, i.date, i.impressions, coalesce(c.clicks, 0) as clicks
             from fi i left join fc c on {match}),
ud as (select xid_imp, date, cast(sum(impressions) as bigint) as impressions,
              cast(sum(clicks) as bigint) as clicks from pairs_ic group by xid_imp, date)"""


def _score_ctes(p: Params) -> str:
    window = f"date between date '{p.start_date}' and date '{p.end_date}'"
    parts = [
        f""",
sw as (select * from scores where {window})"""
    ]
    for i, m in enumerate(p.models, start=1):
        parts.append(
            f""",
sd{i} as (select distinct * from scores where {window} and tid = {_lit(m)}),
dec{i} as (select s.tid, s.decile, cast(sum(u.impressions) as bigint) as impressions,
                  cast(sum(u.clicks) as bigint) as clicks
           from ud u left join sd{i} s on u.date = s.date and u.xid_imp = s.xid
           group by s.tid, s.decile),
band{i} as (select tid, {_band('decile')} as DecileGroup, cast(sum(impressions) as bigint) as impressions,
                   cast(sum(clicks) as bigint) as clicks from dec{i} group by all),
best{i} as (select xid, min(decile) as tid{i}Decile, max(score) as tid{i}Score
            from sw where tid = {_lit(m)} group by xid)"""
        )
    union_dec = " union all ".join(
        f"select {_lit(m)} as model, * from dec{i}" for i, m in enumerate(p.models, start=1)
    )
    union_band = " union all ".join(
        f"select {_lit(m)} as model, * from band{i}" for i, m in enumerate(p.models, start=1)
    )
    parts.append(
        f""",
dec_all as ({union_dec}),
band_all as ({union_band}),
pairs as (select b1.xid, tid1Decile, tid1Score, tid2Decile, tid2Score from best1 b1 join best2 b2 on b1.xid = b2.xid),
cells as (select tid1Decile, tid2Decile, count(*) as n from pairs group by all),
band_cells as (select {_band('b1.tid1Decile')} as DecileGroup1, {_band('b2.tid2Decile')} as DecileGroup2,
                      count(*) as n from best1 b1 join best2 b2 on b1.xid = b2.xid group by all)"""
    )
    return "".join(parts)


def _prelude(p: Params) -> str:
    return duckdb_prelude() + _log_ctes(p) + _score_ctes(p)


def _ctr(clicks: str, impressions: str) -> str:
    return _round(f"{clicks} / nullif({impressions}, 0) * 100", 2)


def _matrix(cells: str, row: str, col: str, axis_sql: str, axis_type: str) -> str:
    return f"""
select s.{row}, s.{col}, s.n, s.n / nullif(t.total, 0) as pct,
       format('{{:,}}', s.n) as n_label,
       format('{{:.0f}}', s.n / nullif(t.total, 0) * 100) || '%' as pct_label,
       s.{row} = s.{col} as is_diagonal
from (select a.v as {row}, b.v as {col}, cast(coalesce(c.n, 0) as bigint) as n
      from (select cast(v as {axis_type}) as v from {axis_sql}) a
      cross join (select cast(v as {axis_type}) as v from {axis_sql}) b
      left join {cells} c on c.{row} = a.v and c.{col} = b.v) s
join (select {col}, cast(sum(n) as bigint) as total from (
        select b.v as {col}, coalesce(c.n, 0) as n
        from (select cast(v as {axis_type}) as v from {axis_sql}) a
        cross join (select cast(v as {axis_type}) as v from {axis_sql}) b
        left join {cells} c on c.{row} = a.v and c.{col} = b.v) group by all) t
  on t.{col} = s.{col}"""


CAMPAIGN = (
    "impressions_filtered",
    "clicks_filtered",
    "clicks_impressions_by_user_day",
    "ctr_by_decile_models",
    "user_best_scores",
    "order_names",
)


def oracle_sql() -> dict[str, str]:
    """All registered queries: the whole tables, and the narrower campaign."""
    campaign = queries_sql(FIXTURE_PARAMS)
    return queries_sql(DEFAULT_PARAMS) | {f"{name}_campaign": campaign[name] for name in CAMPAIGN}


def queries_sql(p: Params) -> dict[str, str]:
    pre = _prelude(p)
    pre_li = _prelude(p.with_line_items(LINE_ITEM_IDS))
    pre_all = _prelude(Params(p.start_date, p.end_date, p.order_ids, ALL_MODELS, p.line_item_ids, p.alpha))
    m1, m2 = p.model1, p.model2
    window = f"date between date '{p.start_date}' and date '{p.end_date}'"
    deciles = "range(1, 11) r(v)"
    bands = f"(values ('{BAND_HIGH}'), ('{BAND_MEDIUM}'), ('{BAND_LOW}')) r(v)"
    models_values = "(values " + ", ".join(f"({_lit(m)})" for m in dict.fromkeys(p.models)) + ") m(model)"
    ctr_cols = f"tid, decile, impressions, clicks, {_ctr('clicks', 'impressions')} as ctr"
    band_cols = f"tid, DecileGroup, impressions, clicks, {_ctr('clicks', 'impressions')} as ctr"
    number = "case model " + " ".join(f"when {_lit(m)} then {n}" for n, m in enumerate(dict.fromkeys(p.models), start=1)) + " end as model_no"
    z = (
        "(c1 * 1.0 / n1 - c2 * 1.0 / n2) / nullif(sqrt(((c1 + c2) * 1.0 / (n1 + n2)) * "
        "(1 - (c1 + c2) * 1.0 / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)), 0)"
    )
    def h(i):
        return f"(select {{c}} from band{i} where DecileGroup = '{BAND_HIGH}' and tid is not null)"

    z_test = f"""{pre},
hc as (select {h(1).format(c='clicks')} as c1, {h(1).format(c='impressions')} as n1,
              {h(2).format(c='clicks')} as c2, {h(2).format(c='impressions')} as n2),
zs as (select *, {z} as zv from hc),
ps as (select *, {_erfc('abs(zv) / sqrt(2)')} as pv from zs)"""
    verdict = f"case when pv < {p.alpha} then '{VERDICT_REJECTED}' else '{VERDICT_NOT_REJECTED}' end"
    both_scores = "(select *, coalesce(tid1Score, 0) as a, coalesce(tid2Score, 0) as b from pairs)"
    correlation = _round("covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)", STAT_DIGITS)

    q = {
        "impressions_filtered": f"{pre}\nselect * from fi",
        "impressions_line_items": f"{pre_li}\nselect * from fi",
        "clicks_filtered": f"{pre}\nselect * from fc",
        "clicks_impressions_by_user_day": f"{pre}\nselect * from ud",
        "clicks_impressions_by_user_day_line_items": f"{pre_li}\nselect * from ud",
        "order_names": f"""{pre},
ids as (select cast(v as bigint) as orderId from (select unnest({[int(x) for x in p.order_ids]}) as v)),
ranked as (select orderId, orderName, row_number() over (
             partition by orderId order by creationDateTime asc nulls first, orderName) as rn
           from line_items where orderId in {_in(p.order_ids)})
select ids.orderId, r.orderName as {ORDER_NAME_COLUMN}
from ids left join ranked r on r.orderId = ids.orderId and r.rn = 1""",
        "segment_names": f"""{pre},
m as (select cast(model_no as int) as model_no, trait_id from (values (1, {_lit(m1)}), (2, {_lit(m2)})) v(model_no, trait_id)),
nm as (select trait_id, min(segment_name) as segment_name from segment_trait
       where trait_id in {_in([m1, m2])} group by trait_id)
select m.model_no, m.trait_id, nm.segment_name,
       '{MODEL_TITLE_PREFIX}' || m.model_no || ': ' || nm.segment_name as title
from m left join nm on nm.trait_id = m.trait_id""",
        "scores_preview": f"""{pre}
select * from scores order by xid nulls first, date nulls first, tid nulls first,
                              score nulls first, decile nulls first limit 100""",
        "scores_dedup": f"{pre}\nselect distinct * from scores where {window} and tid in {_in(p.models)}",
        "ctr_by_decile": f"{pre}\nselect {ctr_cols} from dec1",
        "ctr_by_decile_model2": f"{pre}\nselect {ctr_cols} from dec2",
        "ctr_by_decile_models": f"{pre}\nselect model, {ctr_cols} from dec_all",
        "ctr_by_decile_models_materialized": f"{pre}\nselect model, {ctr_cols} from dec_all",
        "ctr_by_decile_all_models": f"{pre_all}\nselect model, {ctr_cols} from dec_all",
        "ctr_by_band_all_models": f"{pre_all}\nselect model, {band_cols} from band_all",
        "ctr_by_decile_dense": f"""{pre}
select m.model, cast(r.v as int) as decile, cast(coalesce(x.impressions, 0) as bigint) as impressions,
       cast(coalesce(x.clicks, 0) as bigint) as clicks, {_ctr('x.clicks', 'x.impressions')} as ctr,
       format('{{:.2g}}', {_ctr('x.clicks', 'x.impressions')}) || ' %' as ctr_label
from {models_values} cross join {deciles}
left join dec_all x on x.model = m.model and x.decile = r.v and x.tid is not null""",
        "ctr_by_decile_report": f"""{pre}
select {number}, model, decile, format('{{:,}}', impressions) as impressions, format('{{:,}}', clicks) as clicks,
       {_ctr('clicks', 'impressions')} as "{CTR_PERCENT_COLUMN}" from dec_all""",
        "ctr_by_band": f"{pre}\nselect {band_cols} from band1",
        "ctr_by_band_model2": f"{pre}\nselect {band_cols} from band2",
        "ctr_by_band_models": f"{pre}\nselect model, {band_cols} from band_all",
        "ctr_by_band_dense": f"""{pre}
select m.model, r.v as DecileGroup, cast(coalesce(x.impressions, 0) as bigint) as impressions,
       cast(coalesce(x.clicks, 0) as bigint) as clicks, {_ctr('x.clicks', 'x.impressions')} as ctr,
       format('{{:.2g}}', {_ctr('x.clicks', 'x.impressions')}) || ' %' as ctr_label
from {models_values} cross join {bands}
left join band_all x on x.model = m.model and x.DecileGroup = r.v and x.tid is not null""",
        "ctr_by_band_report": f"""{pre}
select {number}, model, DecileGroup, format('{{:,}}', impressions) as impressions, format('{{:,}}', clicks) as clicks,
       {_ctr('clicks', 'impressions')} as "{CTR_PERCENT_COLUMN}" from band_all""",
        "z_test_high_band": f"""{z_test}
select {_lit(m1)} as model_1, {_lit(m2)} as model_2,
       cast(c1 as bigint) as clicks_1, cast(n1 as bigint) as impressions_1,
       cast(c2 as bigint) as clicks_2, cast(n2 as bigint) as impressions_2,
       {_round('zv', STAT_DIGITS)} as z, cast({p.alpha} as double) as alpha,
       {_round('pv', STAT_DIGITS)} as p_value,
       coalesce(pv < {p.alpha}, false) as significant, {verdict} as verdict
from ps""",
        "z_test_sentences": f"""{z_test}
select '{P_VALUE_TEXT}' || coalesce(cast({_round('pv', STAT_DIGITS)} as varchar), 'nan') as p_value_text,
       '{ALPHA_TEXT}' || cast(cast({p.alpha} as double) as varchar) as alpha_text, {verdict} as verdict
from ps""",
        "user_best_scores": f"""{pre}
select tid, xid, min(decile) as best_decile, max(score) as best_score
from sw where tid in {_in(p.models)} group by tid, xid""",
        "overlap_by_decile": f'{pre}\nselect tid1Decile, tid2Decile, n as "count" from cells',
        "overlap_by_band": f'{pre}\nselect DecileGroup1, DecileGroup2, n as "count" from band_cells',
        "overlap_decile_matrix": pre + _matrix("cells", "tid1Decile", "tid2Decile", deciles, "int"),
        "overlap_band_matrix": pre + _matrix("band_cells", "DecileGroup1", "DecileGroup2", bands, "varchar"),
        "overlap_decile_wide": f"""{pre}
select cast(r.v as int) as tid1Decile,
       {", ".join(f'cast(coalesce(sum(case when c.tid2Decile = {d} then c.n end), 0) as bigint) as "{d}"' for d in range(1, 11))}
from {deciles} left join cells c on c.tid1Decile = r.v
group by r.v""",
        "score_correlation": f"{pre}\nselect count(*) as n_users, {correlation} as correlation from {both_scores}",
        "score_correlation_sentence": f"""{pre}
select '{CORRELATION_TEXT}' || coalesce(cast({correlation} as varchar), 'nan') as correlation_text from {both_scores}""",
        "overlap_state": f"""{pre}
select tid1Decile, tid2Decile, count(*) as "count", min(a) as least1, max(a) as most1, min(b) as least2, max(b) as most2,
       {_round('avg(a)', 4)} as mean1, {_round('avg(b)', 4)} as mean2,
       {_round('stddev_pop(a)', 3)} as deviation1, {_round('stddev_pop(b)', 3)} as deviation2,
       {_round('covar_pop(a, b) / 1e6', 3)} as covariance
from {both_scores} group by all""",
    }
    return q
