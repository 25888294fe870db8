"""Queries over line-spectral curves. Their SQL needs no roots: the curve of a filter's frequencies is one over the filter's own magnitude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.signal import lit
from lapwing.operators import line_spectra
from lapwing.operators.scan import worked_out
from lapwing.plans.vector_queries import _B, _BARK, _frames

QUERIES: dict = {}
ORACLE: dict = {}
RATE, SIZE, ORDERS, TARGET_DB, PRICE = 44_100.0, 64, range(2, 17), 12.0, 3.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TOP = _BARK.format("22050.0e0")
_CURVES = f"""{_B}, places as (select k, least(floor(({_BARK.format("44100.0e0 * k / 128")}) * 64 / ({_TOP})), 63)::int as place from range(64) r(k)),
held as (select m, (select max(place) from places where place <= m) as place from range(64) r(m)),
logs as (select frame, k, abs(x) + 1e-6 as v, ln(abs(x) + 1e-6) - min(ln(abs(x) + 1e-6)) over (partition by frame) + 1e-3 as up from b),
power as (select frame, place, avg(up * up) as p from logs join places using (k) group by frame, place),
grid as (select m, held.place, pi() * m / 64 as angle, case when m = 63 then pi() else pi() * (m + 0.5e0) / 64 end - case when m = 0 then 0 else pi() * (m - 0.5e0) / 64 end as width from held),
lags as (select frame, lag, sum(p * cos(lag * angle) * width) / pi() * case when lag = 0 then 1 + 1e-9 else 1 end as r from power join grid using (place), range(17) l(lag) group by frame, lag),
rs as (select frame, list(r order by lag) as r from lags group by frame),
filters as (select frame, r, 0 as n, []::double[] as a, r[1] as err from rs
  union all select frame, r, n + 1, list_append([a[j] + c * a[n + 1 - j] for j in range(1, n + 1)], c), err * (1 - c * c)
  from (select *, -(r[n + 2] + coalesce(list_sum([a[j] * r[n + 2 - j] for j in range(1, n + 1)]), 0)) / err as c from filters where n < 16 and err > 0)),
shapes as (select frame, n, place, 1 / sqrt(pow(1 + list_sum([a[j] * cos(j * pi() * place / 64) for j in range(1, n + 1)]), 2) + pow(list_sum([a[j] * sin(j * pi() * place / 64) for j in range(1, n + 1)]), 2)) as g
  from filters, (select distinct place from places) where n >= 2 and err > 0),
fits as (select frame, n, greatest(1, least(63, round(sum(g * (ln(v) + 0.11512925e0 * 32) / (0.11512925e0 * 32 / 63)) / sum(g * g))))::int as amplitude from shapes join places using (place) join logs using (frame, k) group by frame, n),
curves as (select frame, n, k, v, amplitude, exp(0.11512925e0 * 32 / 63 * amplitude * g - 0.11512925e0 * 32) as c from shapes join places using (place) join logs using (frame, k) join fits using (frame, n)),
scores as (select frame, n::int as n, amplitude, 10 * log10(sum(ln(v) * ln(v)) / sum(pow(ln(v) - ln(c), 2))) as snr, sum(pow(ln(v) - ln(c), 2)) as error, avg(c) as mean, max(c) as peak from curves group by frame, n, amplitude)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    envelopes = _frames(spark, sf_dir).select("frame", F.transform("x", lambda v: F.abs(v) + lit(1e-6)).alias("envelope"))
    of = line_spectra.fitted_curves(envelopes, ["frame"], 64, RATE, SIZE, ORDERS)
    of = worked_out(of, "e", line_spectra.log_error(F.col("envelope"), F.col("curve")))
    return of.withColumn("snr", lit(10) * F.log10(F.col("e.signal") / F.col("e.error")))


@query(f"with recursive {_CURVES} select frame, n as \"order\", amplitude, round(mean, 5) as mean, round(peak, 5) as peak, round(snr, 4) as snr_db from scores")
def curve_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's envelope as a line-spectral curve of orders 2 to 16: amplitude, and the rendered curve's mean, peak and fit."""
    mean = F.aggregate("curve", lit(0), lambda s, c: s + c) / lit(64)
    return _scored(spark, sf_dir).select("frame", "order", "amplitude", F.round(mean, 5).alias("mean"), F.round(F.array_max("curve"), 5).alias("peak"), F.round("snr", 4).alias("snr_db"))


@query(f"""with recursive {_CURVES}, chosen as (select frame, coalesce(min(n) filter (snr >= {TARGET_DB}), arg_max(n, (round(snr, 6), n))) as n from scores group by frame),
priced as (select frame, arg_min(n, (round(error + {PRICE} * n, 6), n)) as n from scores group by frame)
select frame, chosen.n as "order", round(scores.snr, 4) as snr_db, priced.n as priced_order from chosen join priced using (frame) join scores on scores.frame = chosen.frame and scores.n = chosen.n""")
def curve_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least order of each frame that reaches 12 dB, or else the best one; and the order of least error and price."""
    scored = _scored(spark, sf_dir).select("frame", "order", "snr", F.col("e.error").alias("error"))
    best = F.max_by("order", F.struct(F.round("snr", 6), "order"))
    of = scored.groupBy("frame").agg(
        F.coalesce(F.min(F.when(F.col("snr") >= TARGET_DB, F.col("order"))), best).alias("o"),
        F.min_by("order", F.struct(F.round(F.col("error") + lit(PRICE) * F.col("order"), 6), "order")).alias("priced_order"),
        F.map_from_entries(F.collect_list(F.struct("order", "snr"))).alias("all"),  # one entry for each order
    )
    return of.select("frame", F.col("o").alias("order"), F.round(F.element_at("all", F.col("o")), 4).alias("snr_db"), "priced_order")
