"""Queries over point-in-time panels, cross-sections and information coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ic, pit, xsec
from tessera.operators import windows as W
from tessera.plans.registry import query
from tessera.plans.windows import FWD, sql_frame
from tessera.sources import panels as P
from tessera.sources.scratch import written

FACTORS = ["mom20", "vol20", "f_liquidity"]
LEAST = 5


def scored(spark: SparkSession, d: str) -> DataFrame:
    return W.factor_scores(W.with_forward(P.bars(spark, d)), "fwd_1", "fwd_5", "fwd_20")


def scores_long(spark: SparkSession, d: str, label: str = "fwd_1") -> DataFrame:
    """(date, symbol, factor, value, label): factors and forward returns come from windows on the same key over one panel."""
    x = scored(spark, d)
    return xsec.melt(x.withColumn("label", F.col(label)), ["date", "symbol", "label"], FACTORS)


LONG = FWD + f""",
sc as (select symbol, date, avg(change_pct) {sql_frame(20)} as mom20, sqrt(greatest(avg(change_pct * change_pct) {sql_frame(20)} - (avg(change_pct) {sql_frame(20)}) * (avg(change_pct) {sql_frame(20)}), 0)) as vol20, turnover as f_liquidity from bars),
long as (select s.date, s.symbol, u.factor, u.value, fwd_1 as label, fwd_5, fwd_20 from sc s join fwd using (symbol, date),
    lateral (values ('mom20', mom20), ('vol20', case when mom20 is not null then vol20 end), ('f_liquidity', f_liquidity)) u(factor, value))"""

IC = LONG + """,
rk as (select date, factor, rank() over (partition by date, factor order by value) + (count(*) over (partition by date, factor, value) - 1) / 2.0e0 as a,
    rank() over (partition by date, factor order by label) + (count(*) over (partition by date, factor, label) - 1) / 2.0e0 as b from long where value is not null and label is not null),
ics as (select date, factor, count(*) as n, case when count(*) < 5 then 'insufficient_pairs' when stddev_pop(a) < 1e-12 or stddev_pop(b) < 1e-12 then 'constant_rank' else 'settled' end as status, corr(a, b) as ic0 from rk group by 1, 2),
ic as (select date, factor, n, status, case when status = 'settled' then ic0 end as ic from ics)"""


def daily_ics(spark, d):
    return ic.rank_ic(scores_long(spark, d), ["date", "factor"], least=LEAST)


@query("w21_rank_ic", "date:d factor n status ic:8", "bars", IC, "select * from ic")
def _(spark, d):
    return daily_ics(spark, d)


@query("w22_pearson_ic", "date:d factor n ic:8", "bars", LONG, "select date, factor, count(*) as n, case when not (stddev_pop(value) < 1e-12 or stddev_pop(label) < 1e-12) then corr(value, label) end as ic from long where value is not null and label is not null group by 1, 2")
def _(spark, d):
    return ic.pearson_ic(scores_long(spark, d), ["date", "factor"])


SUMMARY = "select factor, count(*) as days, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, avg(cast(ic > 0 as double)) as win_rate, avg(ic) / stddev_samp(ic) as icir, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) as t_value from {} where ic is not null group by factor"


@query("ic_summary", "factor days ic_mean:8 ic_std:8 win_rate:8 icir:7 t_value:6", "bars", IC, SUMMARY.format("ic"))
def _(spark, d):
    return ic.ic_summary(daily_ics(spark, d), ["factor"])


@query("w23_latest_ic", "factor days ic_mean:8 ic_std_pop:8", "bars", IC + ", l as (select * from ic where ic is not null qualify row_number() over (partition by factor order by date desc) <= 20)", "select factor, count(*) as days, avg(ic) as ic_mean, stddev_pop(ic) as ic_std_pop from l group by factor")
def _(spark, d):
    x = ic.latest(daily_ics(spark, d).where("ic is not null"), ["factor"], 20)
    return x.groupBy("factor").agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std_pop"))


@query(
    "w24_rolling_ic", "factor date:d ic_mean:8 icir:7", "bars",
    IC + ", r as (select factor, date, row_number() over w as k, avg(ic) over (w rows between 29 preceding and current row) as ic_mean, stddev_samp(ic) over (w rows between 29 preceding and current row) as s from ic where ic is not null window w as (partition by factor order by date))",
    "select factor, date, ic_mean, ic_mean / s as icir from r where k >= 30 and (k - 30) % 10 = 0",
)
def _(spark, d):
    return ic.rolling_ic(daily_ics(spark, d), ["factor"], 30, 10)


@query(
    "w25_ic_decay", "factor horizon days ic_mean:8", "bars",
    LONG + """, h as (select date, factor, value, u.horizon, u.y from long, lateral (values ('fwd_1', label), ('fwd_5', fwd_5), ('fwd_20', fwd_20)) u(horizon, y) where value is not null and u.y is not null),
k as (select date, factor, horizon, rank() over (partition by date, factor, horizon order by value) + (count(*) over (partition by date, factor, horizon, value) - 1) / 2.0e0 as a,
    rank() over (partition by date, factor, horizon order by y) + (count(*) over (partition by date, factor, horizon, y) - 1) / 2.0e0 as b from h),
c as (select date, factor, horizon, count(*) as n, case when stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12 then corr(a, b) end as ic from k group by all)""",
    "select factor, horizon, count(ic) as days, avg(ic) as ic_mean from c where n >= 5 and ic is not null group by 1, 2",
)
def _(spark, d):
    x = xsec.melt(scored(spark, d), ["date", "symbol", "fwd_1", "fwd_5", "fwd_20"], FACTORS)
    x = xsec.melt(x, ["date", "symbol", "factor", "value"], ["fwd_1", "fwd_5", "fwd_20"], "horizon", "label")
    return ic.rank_ic(x, ["date", "factor", "horizon"], least=LEAST).where("ic is not null").groupBy("factor", "horizon").agg(F.count("ic").alias("days"), F.avg("ic").alias("ic_mean"))


SPREAD = LONG + """, p as (select date, factor, label, count(*) over (partition by date, factor) as n, row_number() over (partition by date, factor order by value desc, symbol) as t,
    row_number() over (partition by date, factor order by value, symbol) as l from long where value is not null and label is not null),
ls as (select date, factor, avg(label) filter (t <= greatest(floor(n * 0.2e0), 1)) as top, avg(label) filter (l <= greatest(floor(n * 0.2e0), 1)) as bottom from p where n >= 5 group by 1, 2)"""


@query("w26_long_short", "date:d factor top:8 bottom:8 spread:8", "bars", SPREAD, "select *, top - bottom as spread from ls")
def _(spark, d):
    return ic.long_short(scores_long(spark, d), ["date", "factor"], least=LEAST)


@query("w26_long_short_summary", "factor days spread_mean:8 annual:6 t_value:6", "bars", SPREAD, "select factor, count(*) as days, avg(top - bottom) as spread_mean, avg(top - bottom) * 242 as annual, avg(top - bottom) / (stddev_samp(top - bottom) / sqrt(count(*))) as t_value from ls group by factor")
def _(spark, d):
    return ic.spread_summary(ic.long_short(scores_long(spark, d), ["date", "factor"], least=LEAST), ["factor"])


@query("w27_signed_long_short", "date:d factor spread:8", "bars", SPREAD, "select date, factor, (top - bottom) * case factor when 'mom20' then -1 else 1 end as spread from ls")
def _(spark, d):
    return ic.long_short(scores_long(spark, d), ["date", "factor"], least=LEAST, direction=F.when(F.col("factor") == "mom20", -1).otherwise(1))


@query(
    "w28_group_turnover", "date:d factor turnover:8", "bars",
    LONG + """, q as (select date, factor, symbol, row_number() over (partition by date, factor order by value desc, symbol) as r, count(*) over (partition by date, factor) as n from long where value is not null),
t as (select date, factor, list(symbol) as s from q where r <= greatest(floor(n * 0.2e0), 1) group by 1, 2), u as (select *, lag(s) over (partition by factor order by date) as p from t)""",
    "select date, factor, 1 - len(list_intersect(s, p)) / cast(len(s) + len(p) - len(list_intersect(s, p)) as double) as turnover from u where p is not null",
)
def _(spark, d):
    return ic.group_turnover(scores_long(spark, d), "value", keys=["factor"])


@query(
    "w29_ic_diagnostic", "factor days overall:8 early:8 middle:8 late:8 recent:8 icir_annual:6 flipped decayed", "bars",
    IC + """, i as (select *, row_number() over (partition by factor order by date) - 1 as i, count(*) over (partition by factor) as m from ic where ic is not null),
s as (select factor, count(*) as days, avg(ic) as overall, avg(ic) filter (floor(i * 3 / cast(m as double)) = 0) as early, avg(ic) filter (floor(i * 3 / cast(m as double)) = 1) as middle,
    avg(ic) filter (floor(i * 3 / cast(m as double)) = 2) as late, avg(ic) filter (i >= m - 20) as recent, avg(ic) / stddev_samp(ic) * sqrt(252) as icir_annual from i group by factor)""",
    "select *, sign(recent) * sign(overall) < 0 as flipped, abs(late) < abs(early) / 2 and not sign(recent) * sign(overall) < 0 as decayed from s",
)
def _(spark, d):
    return ic.ic_diagnostic(daily_ics(spark, d), ["factor"])


@query(
    "w43_factor_drift", "factor long_mean:8 short_mean:8 drift:8 flipped weakened unstable", "bars",
    IC + """, k as (select *, row_number() over (partition by factor order by date desc) as k from ic where ic is not null),
m as (select factor, avg(ic) as lm, avg(ic) filter (k <= 20) as sm from k where k <= 121 group by factor),
f as (select *, factor = 'mom20' and abs(lm) >= 0.02 as rev, factor = 'mom20' and abs(lm) >= 0.02 and sm > 0 and abs(sm) >= greatest(0.01, abs(lm) * 0.3) as flipped from m),
w as (select *, rev and not flipped and abs(sm) < greatest(abs(lm) * 0.7, 0.02) as weakened from f)""",
    "select factor, lm as long_mean, sm as short_mean, abs(sm - lm) as drift, flipped, weakened, case when rev then flipped or weakened else abs(sm - lm) > 0.05 end as unstable from w",
)
def _(spark, d):
    return ic.factor_drift(daily_ics(spark, d), ["factor"], reversal=["mom20"])


PIT = """st as (select symbol, period, case month(period) when 12 then make_date(year(period) + 1, 4, 30) when 3 then make_date(year(period), 4, 30) when 6 then make_date(year(period), 8, 31) when 9 then make_date(year(period), 10, 31) else make_date(year(period), 12, 31) end as avail,
    roe, bvps, ocf_ps, revenue, profit, year(period) * 4 + month(period) // 3 - 1 as q from fin),
fy as (select a.*, a.roe - b.roe as roe_yy_chg, a.revenue - b.revenue as rev_yoy, a.profit - b.profit as np_yoy from st a left join st b on a.symbol = b.symbol and a.q = b.q + 4),
kk as (select b.symbol, b.date, max(struct_pack(a := f.avail, p := f.period)) as k from bars b left join fy f on f.symbol = b.symbol and f.avail <= b.date group by 1, 2),
pit0 as (select b.symbol, b.date, b.close, f.period, f.roe, f.bvps, f.ocf_ps, f.roe_yy_chg, f.rev_yoy, f.np_yoy, d.industry, d.float_shares from bars b join dim d using (symbol)
    left join kk on kk.symbol = b.symbol and kk.date = b.date left join fy f on f.symbol = b.symbol and f.period = kk.k.p),
pit as (select *, ln(close * float_shares) as ln_size, case when bvps > 0 then 1 / (close / bvps) end as pb_inv, case when roe * bvps > 0 then roe * bvps / 100 / close end as ep from pit0)"""


def pit_panel(spark: SparkSession, d: str) -> DataFrame:
    """Bars with the reports known on each date, the dimension and the value factors."""
    fin = pit.year_ago(P.financials(spark, d), {"roe": "roe_yy_chg", "revenue": "rev_yoy", "profit": "np_yoy"}).withColumn("avail", S.available_on("period"))
    x = pit.asof(P.bars(spark, d).select("symbol", "date", "close"), fin, "symbol", "date", "avail", ["period"], ["period", "roe", "bvps", "ocf_ps", "roe_yy_chg", "rev_yoy", "np_yoy"])
    x = x.join(P.dimension(spark, d).select("symbol", "industry", "float_shares"), "symbol")
    return x.withColumns(
        {
            "ln_size": F.log(F.col("close") * F.col("float_shares")),
            "pb_inv": F.when(F.col("bvps") > 0, 1 / (F.col("close") / F.col("bvps"))),
            "ep": F.when(F.col("roe") * F.col("bvps") > 0, F.col("roe") * F.col("bvps") / 100 / F.col("close")),
        }
    )


@query("j04_pit_join", "symbol date:d period:d roe:6 bvps:6 ocf_ps:6 roe_yy_chg:6 ln_size:6 pb_inv:6 ep:8", "bars fin dim", PIT, "select * from pit")
def _(spark, d):
    return pit_panel(spark, d)


@query("j11_year_ago", "symbol period:d roe:6 roe_yy_chg:6", "fin bars dim", PIT, "select symbol, period, roe, roe_yy_chg from fy")
def _(spark, d):
    return pit.year_ago(P.financials(spark, d), {"roe": "roe_yy_chg"})


@query("f05_available_on", "symbol period:d avail:d q", "fin bars dim", PIT, "select symbol, period, avail, cast(q as integer) as q from st")
def _(spark, d):
    return P.financials(spark, d).select("symbol", "period", S.available_on("period").alias("avail"), S.quarter_index("period").alias("q"))


def z_sql(f: str, prev: str) -> str:
    """CTEs that add z_<f> to the panel ``prev``."""
    return f"""{f}1 as (select *, case when {f} is not null and ln_size is not null then {f} end as y0, case when {f} is not null and ln_size is not null then ln_size end as x0 from {prev}),
{f}q as (select date, quantile_cont(y0, 0.01) as lo, quantile_cont(y0, 0.99) as hi from {f}1 group by date),
{f}2 as (select a.*, case when y0 is not null then least(greatest(y0, lo), hi) end as y1 from {f}1 a join {f}q q on a.date = q.date),
{f}3 as (select *, y1 - avg(y1) over (partition by date, industry) as yd, x0 - avg(x0) over (partition by date, industry) as xd from {f}2),
{f}4 as (select *, yd - case when sum(xd * xd) over w > 1e-12 then sum(xd * yd) over w / sum(xd * xd) over w else 0 end * xd as r from {f}3 window w as (partition by date)),
{f}5 as (select * exclude (y0, x0, y1, yd, xd, r), case when count(r) over w >= 5 and stddev_pop(r) over w > 1e-12 then (r - avg(r) over w) / stddev_pop(r) over w end as z_{f} from {f}4 window w as (partition by date))"""


FUSION = {"pb_inv": 0.73, "ep": 0.7456, "ocf_ps": 0.546, "roe_yy_chg": 1.0618}
NEUTRAL = PIT + ",\n" + ",\n".join([z_sql("pb_inv", "pit"), z_sql("ep", "pb_inv5"), z_sql("ocf_ps", "ep5"), z_sql("roe_yy_chg", "ocf_ps5")])


def neutral_panel(spark, d):
    return xsec.neutralize(pit_panel(spark, d), list(FUSION), least=LEAST)


@query("w35_neutralize", "symbol date:d z_pb_inv:5 z_ep:5 z_ocf_ps:5 z_roe_yy_chg:5", "bars fin dim", NEUTRAL, "select * from roe_yy_chg5")
def _(spark, d):
    return neutral_panel(spark, d)


_TOTAL = " + ".join(f"coalesce(z_{f} * {w}e0, 0)" for f, w in FUSION.items())
_HAVE = " + ".join(f"case when z_{f} is not null then {w}e0 else 0 end" for f, w in FUSION.items())
COMPOSITE = NEUTRAL + f""", cr as (select *, case when {_HAVE} > 0 then ({_TOTAL}) / ({_HAVE}) end as raw from roe_yy_chg5),
cs as (select symbol, date, close, ln_size, industry, case when count(raw) over w >= 5 then case when raw is null then null when stddev_pop(raw) over w > 1e-12 then (raw - avg(raw) over w) / stddev_pop(raw) over w else 0 end end as score from cr window w as (partition by date))"""


def composite_panel(spark, d):
    return xsec.composite(neutral_panel(spark, d), FUSION, dict.fromkeys(FUSION, 1), least=LEAST)


@query("w36_composite", "symbol date:d score:5", "bars fin dim", COMPOSITE, "select * from cs")
def _(spark, d):
    return composite_panel(spark, d)


WATCH = ["rev_yoy", "np_yoy", "roe_yy_chg", "roe", "bvps"]
WATCHED = PIT + ",\n" + ",\n".join(z_sql(f, p) for f, p in zip(WATCH, ["pit", *[f"{x}5" for x in WATCH[:-1]]]))
WATCH_SCORE = """select symbol, date, case when z_bvps is null or z_rev_yoy is null or z_np_yoy is null or z_roe_yy_chg is null or z_roe is null then 'missing' when round(z_bvps, 9) < 0 then 'bvps_neg' when abs(z_roe) + sqrt(round(z_bvps, 9)) < 1e-9 then 'div_nonfinite' end as reason,
    case when round(z_bvps, 9) >= 0 and abs(z_roe) + sqrt(greatest(round(z_bvps, 9), 0)) >= 1e-9 then (abs(z_rev_yoy) - (z_np_yoy + z_roe_yy_chg)) / (abs(z_roe) + sqrt(greatest(round(z_bvps, 9), 0))) end as watch from bvps5"""


@query("w37_watch_score", "symbol date:d reason watch:4", "bars fin dim", WATCHED, WATCH_SCORE)
def _(spark, d):
    return xsec.watch_score(xsec.neutralize(pit_panel(spark, d), WATCH, least=LEAST))


@query(
    "b13_daily_validation", "date:d n ic:8 r_size:7 coverage:8", "bars fin dim",
    COMPOSITE + ",\n" + FWD + """, j as (select cs.*, fwd_1 from cs left join fwd using (symbol, date)),
k as (select date, rank() over (partition by date order by score) + (count(*) over (partition by date, score) - 1) / 2.0e0 as a, rank() over (partition by date order by fwd_1) + (count(*) over (partition by date, fwd_1) - 1) / 2.0e0 as b from j where score is not null and fwd_1 is not null),
c as (select date, count(*) as n, case when count(*) >= 5 and stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12 then corr(a, b) end as ic from k group by date)""",
    "select o.date, c.n, c.ic, o.r_size, o.coverage from (select date, case when stddev_pop(case when score is not null then ln_size end) > 1e-9 and stddev_pop(score) > 1e-9 then corr(score, ln_size) end as r_size, count(score) / cast(count(*) as double) as coverage from j group by date) o left join c on c.date = o.date",
)
def _(spark, d):
    x = composite_panel(spark, d)
    y = x.join(W.forward_returns(P.bars(spark, d)), ["symbol", "date"], "left")
    c = ic.rank_ic(y.select("date", F.col("score").alias("value"), F.col("fwd_1").alias("label")), ["date"], least=LEAST).select("date", "n", "ic")
    o = y.groupBy("date").agg(S.correlation("score", "ln_size", 1e-9).alias("r_size"), (F.count("score") / F.count(F.lit(1))).alias("coverage"))
    return o.join(c, "date", "left")


@query(
    "a16_quantile_means", "bucket mean_return:8 days", "bars",
    FWD + """, x as (select b.date, b.turnover, fwd_1 from bars b join fwd using (symbol, date) where fwd_1 is not null),
c as (select date, quantile_cont(turnover, [0.2, 0.4, 0.6, 0.8]) as q from x group by date),
m as (select x.date, cast(len(list_filter(q, lambda a: a < turnover)) + 1 as integer) as bucket, avg(fwd_1) as m from x join c on c.date = x.date group by 1, 2)""",
    "select bucket, avg(m) as mean_return, count(*) as days from (select *, count(*) over (partition by date) as f from m) where f = 5 group by bucket",
)
def _(spark, d):
    b = P.bars(spark, d)
    return xsec.quantile_means(b.select("symbol", "date", "turnover").join(W.forward_returns(b), ["symbol", "date"]), "turnover", "fwd_1")


@query(
    "a17_order_buckets", "date:d bucket n mean_return:8", "bars",
    FWD + ", x as (select b.date, fwd_1, cast(floor((row_number() over (partition by b.date order by turnover, symbol) - 1) * 5 / cast(count(*) over (partition by b.date) as double)) as integer) as bucket from bars b join fwd using (symbol, date) where fwd_1 is not null)",
    "select date, bucket, count(*) as n, avg(fwd_1) as mean_return from x group by 1, 2",
)
def _(spark, d):
    b = P.bars(spark, d)
    x = b.select("symbol", "date", "turnover").join(W.forward_returns(b), ["symbol", "date"]).where("fwd_1 is not null")
    return x.withColumn("bucket", xsec.order_bucket("turnover", 5, "date")).groupBy("date", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_1").alias("mean_return"))


@query(
    "a18_decile_spread", "date:d n spread:8", "bars",
    FWD + ", x as (select b.date, fwd_1, count(*) over (partition by b.date) as n, row_number() over (partition by b.date order by turnover desc, symbol) as t, row_number() over (partition by b.date order by turnover, symbol) as l from bars b join fwd using (symbol, date) where fwd_1 is not null)",
    "select date, any_value(n) as n, avg(fwd_1) filter (t <= ceil(n * 0.1e0)) - avg(fwd_1) filter (l <= ceil(n * 0.1e0)) as spread from x where n >= 10 group by date",
)
def _(spark, d):
    b = P.bars(spark, d)
    return xsec.decile_spread(b.select("symbol", "date", "turnover").join(W.forward_returns(b), ["symbol", "date"]), "turnover", "fwd_1")


@query("p10_trim_top", "symbol date:d kept:5", "bars", "q as (select date, quantile_cont(change_pct, 0.95) as q from bars group by date)", "select symbol, b.date, case when change_pct <= q then change_pct end as kept from bars b join q using (date)")
def _(spark, d):
    return P.bars(spark, d).select("symbol", "date", xsec.trim_top("change_pct", 0.05, "date").alias("kept"))


CORR = LONG + """, cmp as (select *, count(*) over (partition by date, symbol) as k from long where value is not null),
cr as (select date, symbol, factor, rank() over (partition by date, factor order by value) + (count(*) over (partition by date, factor, value) - 1) / 2.0e0 as r from cmp where k = 3),
pr as (select a.date, a.factor, b.factor as other, count(*) as n, corr(a.r, b.r) as c from cr a join cr b on a.date = b.date and a.symbol = b.symbol and a.factor < b.factor group by 1, 2, 3)"""


@query("b03_factor_correlation", "factor other corr:7 days", "bars", CORR, "select factor, other, avg(c) as corr, count(c) as days from pr where n >= 5 and not isnan(c) group by 1, 2")
def _(spark, d):
    return ic.factor_correlation(written(scores_long(spark, d)), LEAST)


@query(
    "b04_redundant_pairs", "factor other corr:7 keep", "bars",
    IC + CORR.removeprefix(LONG) + ", s as (select factor, abs(avg(ic)) as score from ic where ic is not null group by factor), m as (select factor, other, avg(c) as corr from pr where n >= 5 and not isnan(c) group by 1, 2)",
    "select m.factor, m.other, corr, case when a.score >= b.score then m.factor else m.other end as keep from m join s a on a.factor = m.factor join s b on b.factor = m.other where abs(corr) >= 0.05",
)
def _(spark, d):
    x = written(scores_long(spark, d))
    scores = ic.ic_summary(ic.rank_ic(x, ["date", "factor"], least=LEAST), ["factor"]).select("factor", F.abs("ic_mean").alias("score"))
    return ic.redundant_pairs(ic.factor_correlation(x, LEAST), scores, 0.05)


@query(
    "b05_factor_weights", "factor weight:8", "bars",
    IC + """, l as (select * from ic where ic is not null qualify row_number() over (partition by factor order by date desc) <= 60),
r as (select factor, greatest(case when count(*) >= 10 then coalesce(avg(ic) / stddev_samp(ic), 0) else 0 end, 0) as raw from l group by factor)""",
    "select factor, case when sum(raw) over () > 0 then raw / sum(raw) over () else 1.0e0 / count(*) over () end as weight from r",
)
def _(spark, d):
    return ic.factor_weights(daily_ics(spark, d))


@query(
    "b06_adaptive_weights", "factor raw:8 share:8 weight:8", "bars",
    IC + """, k as (select *, row_number() over (partition by factor order by date desc) as k from ic where ic is not null),
s as (select factor, avg(ic) as lm, stddev_samp(ic) as ls, avg(ic) filter (k <= 20) as sm, stddev_samp(ic) filter (k <= 20) as ss, case factor when 'mom20' then -1 else 1 end as dir from k where k <= 120 group by factor),
r as (select *, case when sm * dir < -0.02 then 0.02 else greatest((0.6e0 * coalesce(sm / ss, 0) + 0.4e0 * coalesce(lm / ls, 0)) * dir, 0.02) end as raw from s),
h as (select *, raw / sum(raw) over () as share from r), c as (select *, least(share, 0.55) as capped from h),
w as (select *, sum(case when share < 0.55 then share else 0 end) over () as room, 1 - sum(capped) over () as free from c)""",
    "select factor, raw, share, case when share < 0.55 and room > 0 then capped + free * share / room else capped end * dir as weight from w",
)
def _(spark, d):
    base = spark.createDataFrame([("mom20", -0.4), ("vol20", 0.3), ("f_liquidity", 0.3)], "factor string, base_weight double")
    return ic.adaptive_weights(daily_ics(spark, d), base)


@query("b01_factor_report", "factor days ic_mean:8 icir:7 t_value:6 win_rate:8 spread_mean:8 q1:8 q5:8 monotone turnover:8 passed verdict",
    "bars",
    SPREAD.replace("n >= 5", "n >= 5") + IC.removeprefix(LONG) + f""", sm as ({SUMMARY.format("ic")}), lsm as (select factor, avg(top - bottom) as spread_mean from ls group by factor),
qc as (select date, factor, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) as q from long where value is not null and label is not null group by 1, 2),
qm as (select l.date, l.factor, len(list_filter(q, lambda a: a < value)) + 1 as b, avg(label) as m from long l join qc on qc.date = l.date and qc.factor = l.factor where value is not null and label is not null group by 1, 2, 3),
qf as (select *, count(*) over (partition by date, factor) as f from qm),
qq as (select factor, avg(m) filter (b = 1) as q1, avg(m) filter (b = 2) as q2, avg(m) filter (b = 3) as q3, avg(m) filter (b = 4) as q4, avg(m) filter (b = 5) as q5 from qf where f = 5 group by factor),
tq as (select date, factor, symbol, row_number() over (partition by date, factor order by value desc, symbol) as r, count(*) over (partition by date, factor) as n from long where value is not null),
tt as (select date, factor, list(symbol) as s from tq where r <= greatest(floor(n * 0.2e0), 1) group by 1, 2), tu as (select *, lag(s) over (partition by factor order by date) as p from tt),
tv as (select factor, avg(1 - len(list_intersect(s, p)) / cast(len(s) + len(p) - len(list_intersect(s, p)) as double)) as turnover from tu where p is not null group by factor),
al as (select sm.*, spread_mean, q1, q5, (q1 <= q2 and q2 <= q3 and q3 <= q4 and q4 <= q5) or (q1 >= q2 and q2 >= q3 and q3 >= q4 and q4 >= q5) as monotone, turnover from sm left join lsm using (factor) left join qq using (factor) left join tv using (factor)),
ps as (select *, cast(abs(ic_mean) >= 0.02 as int) + cast(abs(icir) >= 0.3 as int) + cast(abs(t_value) >= 2 as int) + cast(greatest(win_rate, 1 - win_rate) >= 0.55 as int) + cast(abs(spread_mean) > 0 as int) + cast(coalesce(monotone, false) as int) + cast(turnover <= 0.8 as int) as passed from al)""",
    "select *, case when passed >= 4 then 'ADOPT' when passed >= 2 then 'WATCH' else 'REJECT' end as verdict from ps",
)
def _(spark, d):
    return ic.factor_report(scores_long(spark, d), LEAST, LEAST)


@query("j03_adjust_prices", "symbol date:d factor:6 adj_close:3", "bars",
    """f as (select symbol, date as ex_date, sum(1 + volume / 1e5) over (partition by symbol order by date) as factor from bars where month(date) = 6),
x as (select b.symbol, b.date, close, coalesce(f.factor, 1) as factor from bars b asof left join f on f.symbol = b.symbol and f.ex_date <= b.date)""",
    "select symbol, date, factor, close * factor / max(factor) over (partition by symbol) as adj_close from x")
def _(spark, d):
    b = P.bars(spark, d)
    f = b.where("month(date) = 6").select("symbol", F.col("date").alias("ex_date"), F.sum(1 + F.col("volume") / 1e5).over(W.sym()).alias("factor"))
    x = pit.adjust(b.select("symbol", "date", "close"), f)
    return x.withColumn("adj_close", F.col("close") * F.col("factor") / F.max("factor").over(W.Window.partitionBy("symbol")))
