"""Queries on epoched signals: X1-X17 and the operators they are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evoq.functions import kernels
from evoq.functions.arrays import Axis
from evoq.functions.numbers import band_label, capped_high, percent_change, resultant_length
from evoq.operators import channels, complexity, erp, phase, spectral, summaries, trials
from evoq.plans import extraction, features
from evoq.sources import labels as label_source
from evoq.sources import signals
from testbed import inputs as I
from testbed import registry
from testbed.registry import query, rnd, rounded

SPEC = I.SPEC
W = SPEC.windows


def between(name, t="t"):
    low, high = W[name]
    return f"{t} BETWEEN {low}::DOUBLE AND {high}::DOUBLE"


# ------------------------------------------------------------------ peaks

PEAKS_SQL = f"""base AS (SELECT epoch, avg(v) AS b FROM smp WHERE {between('baseline')} GROUP BY epoch),
n2 AS (SELECT epoch, v, t FROM smp WHERE {between('n2')} QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY v, t) = 1),
p2 AS (SELECT epoch, v, t FROM smp WHERE {between('p2')} QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY v DESC, t) = 1),
pk AS (SELECT ep.dataset, ep.subject, ep.epoch, n2.v - b AS n2_amp, n2.t AS n2_lat, p2.v - b AS p2_amp, p2.t AS p2_lat,
    (p2.v - b) - (n2.v - b) AS n2p2_amp FROM ep JOIN base USING (epoch) JOIN n2 USING (epoch) JOIN p2 USING (epoch))"""
PEAK_COLUMNS = ", ".join(f"{rnd(c)} AS {c}" for c in features.ERP)


@query("X1_n2_p2_peaks", f"SELECT dataset, subject, epoch, {PEAK_COLUMNS} FROM pk", (I.EPOCHS_SQL, PEAKS_SQL))
def x1(spark, sf):
    return rounded(erp.with_peaks(I.epochs(spark, sf), SPEC).select("dataset", "subject", "epoch", *features.ERP))


@query("X1_peaks_with_rating", f"""SELECT pk.dataset, pk.subject, pk.epoch, {rnd('n2p2_amp')} AS n2p2_amp,
    {rnd('rating')} AS rating, laser_power FROM pk LEFT JOIN lab ON pk.dataset = lab.dataset AND pk.subject = lab.subject
    AND pk.epoch = lab.epoch""", (I.EPOCHS_SQL, PEAKS_SQL, I.EPOCH_LABELS_SQL))
def peaks_with_rating(spark, sf):
    peaks = erp.with_peaks(channels.vertex_epochs(I.epochs(spark, sf), SPEC.vertex_priority), SPEC)
    return rounded(trials.attach_labels(peaks.select("dataset", "subject", "epoch", "n2p2_amp"), I.epoch_labels(spark, sf)))


@query("A15_arg_extremes_earliest_tie", f"""SELECT epoch, lo.i AS at_min, hi.i AS at_max FROM
    (SELECT epoch, i FROM qs QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY v, i) = 1) lo JOIN
    (SELECT epoch, i FROM qs QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY v DESC, i) = 1) hi USING (epoch)""",
       (I.EPOCHS_SQL, "qs AS (SELECT epoch, i::INT AS i, round(v * 10) + 0.0 AS v FROM smp)"))
def a15(spark, sf):
    from evoq.functions.arrays import first_extreme
    coarse = I.epochs(spark, sf).withColumn("signal", F.transform("signal", lambda v: F.round(v * 10)))
    return coarse.select("epoch", first_extreme(F.col("signal"), False).alias("at_min"),
                         first_extreme(F.col("signal"), True).alias("at_max"))


@query("A16_mean_without_nan", f"SELECT epoch, {rnd('avg(v) FILTER (WHERE v <= 0.2)')} AS mean FROM smp GROUP BY epoch",
       (I.EPOCHS_SQL,))
def a16(spark, sf):
    from evoq.functions.arrays import NAN, mean_of
    holes = F.transform("signal", lambda v: F.when(v > 0.2, F.lit(NAN)).otherwise(v))
    return rounded(I.epochs(spark, sf).select("epoch", mean_of(holes).alias("mean")))


@query("P11_window_mask", "SELECT epoch, i, t, v FROM smp WHERE " + between("n2"), (I.EPOCHS_SQL.replace("i - 1 AS i", "(i - 1)::INT AS i"),))
def p11(spark, sf):
    e = erp.with_windows(I.epochs(spark, sf), SPEC, "n2")
    return e.select("epoch", "sfreq", "t0", "_n2_first", F.posexplode(erp.samples("n2")).alias("k", "v")) \
        .withColumn("i", F.col("_n2_first") + F.col("k")).select("epoch", "i", F.expr(Axis().time("i")).alias("t"), "v")


@query("P12_minimum_length", """SELECT epoch, CASE WHEN count(*) >= 8 THEN count(*)::INT END AS n_samples
    FROM smp WHERE t BETWEEN 0.5 - (epoch % 10) * 0.02 AND 0.6 GROUP BY epoch""", (I.EPOCHS_SQL,))
def p12(spark, sf):
    """Ten windows of growing length, of which an epoch takes one."""
    spans = {f"w{k}": (round(0.5 - k * 0.02, 2), 0.6) for k in range(10)}
    e = Axis().with_bounds(I.epochs(spark, sf), spans)
    own = lambda value: F.coalesce(*[F.when(F.col("epoch") % 10 == k, value(f"w{k}")) for k in range(10)])
    return e.where(own(lambda w: F.col(f"_{w}_count")) > 0).select("epoch", F.size(own(lambda w: erp.enough(w, SPEC.min_samples))).alias("n_samples"))


@query("P17_baseline_subtraction", f"SELECT epoch, i::INT AS i, {rnd('v - b')} AS v FROM smp JOIN base USING (epoch)",
       (I.EPOCHS_SQL, f"base AS (SELECT epoch, avg(v) AS b FROM smp WHERE {between('baseline')} GROUP BY epoch)"))
def p17(spark, sf):
    return rounded(signals.to_samples(erp.subtract_baseline(I.epochs(spark, sf), SPEC), "epoch"))


@query("P18_unit_scaling", f"SELECT epoch, i::INT AS i, {rnd('v * 1e6', 3)} AS v, (t * 1000) / 1000.0 AS t FROM smp", (I.EPOCHS_SQL,))
def p18(spark, sf):
    rows = signals.to_samples(signals.scale(I.epochs(spark, sf), 1e6), "epoch", "t0", "sfreq")
    ms = (F.col("t0") + F.col("i") / F.col("sfreq")) * 1000
    return rounded(rows.select("epoch", "i", "v", (ms / 1000.0).alias("t")), 3, "v")


@query("P19_band_cap_label", """SELECT epoch, least(27.0, 64.0 / 2 - 5 - epoch % 7)::DOUBLE AS high,
    printf('%.1f-%.1f', 20.0, least(27.0, 64.0 / 2 - 5 - epoch % 7)::DOUBLE) AS band FROM ep""", (I.EPOCHS_SQL,))
def p19(spark, sf):
    low, high = SPEC.bands["gamma"]
    e = I.epochs(spark, sf).withColumn("high", capped_high(high, F.col("sfreq") - (F.col("epoch") % 7) * 2, SPEC.nyquist_margin))
    return e.select("epoch", "high", band_label(low, F.col("high")).alias("band"))


@query("P20_preview_cut", f"SELECT epoch, i::INT AS i, i / 64.0 AS t, {rnd('v * 1e6', 3)} AS value FROM smp WHERE i < 32", (I.EPOCHS_SQL,))
def p20(spark, sf):
    return rounded(signals.preview(I.epochs(spark, sf), seconds=0.5).select("epoch", "i", "t", "value"), 3, "value")


@query("P21_time_axis", """SELECT vec_id AS epoch, (i - 1)::INT AS i, CASE WHEN vec_id % 3 = 0 THEN (label + i - 1) / 1000.0
    ELSE -0.5::DOUBLE + (i - 1) / CASE WHEN vec_id % 3 = 2 THEN 1000.0 ELSE 64.0 END END AS t FROM embeddings, range(1, 65) r(i)""")
def p21(spark, sf):
    e = I.table(spark, sf, "embeddings")
    kind = F.col("vec_id") % 3
    files = e.select(F.col("vec_id").alias("epoch"), F.when(kind == 0, F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("label") + i).cast("double"))).alias("times_ms"),
        F.lit(-0.5).alias("xmin"), F.when(kind != 2, F.lit(64.0)).alias("srate"), F.size("embedding").alias("pnts"))
    return signals.with_times(files).select("epoch", F.posexplode("times").alias("i", "t"))


# ------------------------------------------------------------------ spectra

def psd_sql(tag, window, segment, source="smp"):
    """Welch by joins: samples to half-overlapping segments, segment means, Fourier sums over a basis, mean power."""
    return f"""{tag}_w AS (SELECT epoch, v, row_number() OVER (PARTITION BY epoch ORDER BY i) - 1 AS j,
    count(*) OVER (PARTITION BY epoch) AS len FROM {source} WHERE {between(window)}),
{tag}_l AS (SELECT *, least(len, {segment}) AS n FROM {tag}_w),
{tag}_g AS (SELECT epoch, n, s, j - s * (n - n // 2) AS j, v FROM (SELECT *, unnest(range(0, (len - n // 2) // (n - n // 2))) AS s FROM {tag}_l)
    WHERE j >= s * (n - n // 2) AND j < s * (n - n // 2) + n),
{tag}_d AS (SELECT epoch, n, s, j, (v - avg(v) OVER (PARTITION BY epoch, s)) * (0.5 - 0.5 * cos(2 * pi() * j / n)) AS x,
    (0.5 - 0.5 * cos(2 * pi() * j / n)) AS h FROM {tag}_g),
{tag}_c AS (SELECT epoch, s, n, k, sum(x * cos(2 * pi() * j * k / n)) AS re, sum(x * sin(2 * pi() * j * k / n)) AS im, sum(h * h) AS hh
    FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM {tag}_d) GROUP BY epoch, s, n, k),
{tag} AS (SELECT epoch, n, k, k * (1.0::DOUBLE / (n * (1.0::DOUBLE / 64.0::DOUBLE))) AS f,
    avg((re * re + im * im) / (64.0 * hh)) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS p FROM {tag}_c GROUP BY epoch, n, k)"""


def band_sql(tag, low, high):
    """Trapezoid over the bins of a band as a scalar subquery per epoch."""
    return (f"(SELECT CASE WHEN count(*) > 0 THEN (64.0 / any_value(n)) * (sum(p) - (arg_min(p, k) + arg_max(p, k)) / 2) END "
            f"FROM {tag} WHERE {tag}.epoch = ep.epoch AND f BETWEEN {low} AND {high})")


PSD = psd_sql("psd", "psd", SPEC.psd_segment)
CAP = 27.0


@query("X2_welch_psd", f"SELECT epoch, k::INT AS k, {rnd('p', 12)} AS p FROM psd", (I.EPOCHS_SQL, PSD))
def x2(spark, sf):
    return rounded(spectral.with_psd(I.epochs(spark, sf), SPEC).select("epoch", F.posexplode("_psd_psd").alias("k", "p")), 12)


@query("W4_overlapping_segments", f"SELECT epoch, s::INT AS s, count(*) AS n, {rnd('sum(v)')} AS total FROM psd_g GROUP BY epoch, s",
       (I.EPOCHS_SQL, PSD))
def w4(spark, sf):
    return rounded(spectral.segment_rows(I.epochs(spark, sf), SPEC).groupBy("epoch", "s").agg(F.count("v").alias("n"), F.sum("v").alias("total")))


@query("X3_band_power", f"SELECT epoch, {rnd(band_sql('psd', 8, 13), 12)} AS power FROM ep", (I.EPOCHS_SQL, PSD))
def x3(spark, sf):
    e = spectral.with_powers(spectral.with_psd(I.epochs(spark, sf), SPEC), {"power": ("psd", 8.0, "13D")})
    return rounded(e.select("epoch", "power"), 12)


@query("P13_band_mask_empty_is_null", f"""SELECT epoch, {rnd(band_sql('psd', 6.5, 7.5), 12)} AS none, {rnd(band_sql('psd', 7.5, 8.5), 12)} AS one,
    {rnd(band_sql('psd', 7.5, 10.5), 12)} AS two FROM ep""", (I.EPOCHS_SQL, PSD))
def p13(spark, sf):
    bands = {"none": ("psd", 6.5, "7.5D"), "one": ("psd", 7.5, "8.5D"), "two": ("psd", 7.5, "10.5D")}
    return rounded(spectral.with_powers(spectral.with_psd(I.epochs(spark, sf), SPEC), bands).select("epoch", *bands), 12)


@query("A17_trapezoid", f"""SELECT epoch, {rnd('sum(area)', 12)} AS area FROM (SELECT epoch,
    (p + lead(p) OVER (PARTITION BY epoch ORDER BY k)) / 2 * 2.0 AS area FROM psd) GROUP BY epoch""", (I.EPOCHS_SQL, PSD))
def a17(spark, sf):
    e = spectral.with_powers(spectral.with_psd(I.epochs(spark, sf), SPEC), {"area": ("psd", 0.0, "32D")})
    return rounded(e.select("epoch", "area"), 12)


BANDS_SQL = ", ".join(f"{rnd(band_sql('psd', lo, min(hi, CAP)), 12)} AS psd_{b}" for b, (lo, hi) in SPEC.bands.items())


@query("X4_psd_bands", f"SELECT epoch, {BANDS_SQL} FROM ep", (I.EPOCHS_SQL, PSD))
def x4(spark, sf):
    e = spectral.with_band_powers(I.epochs(spark, sf), SPEC)
    return rounded(e.select("epoch", *[f"psd_{b}" for b in SPEC.bands]), 12)


GAMMA = psd_sql("gam", "gamma", SPEC.psd_segment)


@query("X5_gamma_power", f"SELECT epoch, {rnd(band_sql('gam', 20, 27), 12)} AS gamma_power, '20.0-27.0' AS gamma_band_hz FROM ep",
       (I.EPOCHS_SQL, GAMMA))
def x5(spark, sf):
    return rounded(spectral.with_gamma(I.epochs(spark, sf), SPEC).select("epoch", "gamma_power", "gamma_band_hz"), 12)


ERD = [psd_sql("pb", "baseline", SPEC.erd_segment), psd_sql("pt", "erd_task", SPEC.erd_segment)]


def erd_sql(low, high):
    b, t = band_sql("pb", low, high), band_sql("pt", low, high)
    return rnd(f"(({b} - {t}) / nullif({b}, 0) * 100)", 6)


@query("X6_erd", f"SELECT epoch, {erd_sql(8, 13)} AS alpha_erd_pct, {erd_sql(13, 30)} AS beta_erd_pct FROM ep", (I.EPOCHS_SQL, *ERD))
def x6(spark, sf):
    return rounded(spectral.with_erd(I.epochs(spark, sf), SPEC).select("epoch", "alpha_erd_pct", "beta_erd_pct"), 6)


@query("F9_percent_change", f"""SELECT l_orderkey, l_linenumber, l_partkey, {rnd('(l_discount - l_tax) / nullif(l_discount, 0) * 100', 6)} AS pct FROM lineitem""")
def f9(spark, sf):
    return rounded(I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                   percent_change(F.col("l_discount"), F.col("l_tax")).alias("pct")), 6)


# ------------------------------------------------------------------ phase

def filter_sql():
    """Both passes of the band-pass as recursions over samples prolonged by 27 on either side; ``bp`` (epoch, s)."""
    b, a = kernels.butterworth_band(SPEC.filter_order, SPEC.plv_band[0] / (I.RATE / 2), SPEC.plv_band[1] / (I.RATE / 2))
    start = [float(v) for v in kernels._steady_state(b, a)]
    b, a, last = [float(v) for v in b], [float(v) for v in a], len(b) - 1
    line = ", ".join((f"z[{k + 1}] + " if k < last else "") + f"({b[k]!r})::DOUBLE * xi - ({a[k]!r})::DOUBLE * yi" for k in range(1, last + 1))

    def run(tag, source, signal):
        return f"""{tag} AS (SELECT epoch, 0 AS i, {signal} AS x, list_transform({start}::DOUBLE[], lambda q: q * {signal}[1]) AS z, []::DOUBLE[] AS y FROM {source}
    UNION ALL SELECT epoch, i + 1, x, [{line}], list_append(y, yi) FROM
    (SELECT *, x[i + 1] AS xi, ({b[0]!r})::DOUBLE * x[i + 1] + z[1] AS yi FROM {tag} WHERE i < 118))"""

    return f"""pad AS (SELECT epoch, list_concat(list_concat(list_transform(range(27, 0, -1), lambda j: 2 * s[1] - s[1 + j]), s),
    list_transform(range(1, 28), lambda j: 2 * s[64] - s[64 - j])) AS x FROM ep),
{run('fw', 'pad', 'x')},
back AS (SELECT epoch, list_reverse(y) AS x FROM fw WHERE i = 118),
{run('bw', 'back', 'x')},
bp AS (SELECT epoch, list_reverse(y)[28:91] AS s FROM bw WHERE i = 118)"""


FILTER = filter_sql()


@query("X7_zero_phase_band_pass", f"SELECT epoch, (i - 1)::INT AS i, {rnd('s[i]', 7)} AS v FROM bp, range(1, 65) r(i)", (I.EPOCHS_SQL, FILTER))
def x7(spark, sf):
    return rounded(phase.with_filtered(I.epochs(spark, sf), SPEC).select("epoch", F.posexplode("signal").alias("i", "v")), 7)


def hilbert_sql(source):
    """Analytic phase by Fourier sums over the locking window of ``source`` (epoch, name, s)."""
    low, high = W["plv"]
    return f"""hw AS (SELECT epoch, name, i - 1 AS i, s[i] AS v FROM {source}, range(1, 65) r(i)
    WHERE {I.T0}::DOUBLE + (i - 1) / 64.0 BETWEEN {low} AND {high}),
hj AS (SELECT epoch, name, i - min(i) OVER (PARTITION BY epoch, name) AS j, v, count(*) OVER (PARTITION BY epoch, name) AS n FROM hw),
hc AS (SELECT epoch, name, n, k, sum(v * cos(2 * pi() * j * k / n)) AS re, -sum(v * sin(2 * pi() * j * k / n)) AS im
    FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM hj) GROUP BY epoch, name, n, k),
hz AS (SELECT epoch, name, j, sum(c * (re * cos(2 * pi() * j * k / n) - im * sin(2 * pi() * j * k / n))) AS re,
    sum(c * (re * sin(2 * pi() * j * k / n) + im * cos(2 * pi() * j * k / n))) AS im
    FROM (SELECT *, unnest(range(0, n)) AS j, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS c FROM hc) GROUP BY epoch, name, j),
hp AS (SELECT epoch, name, j, cos(atan2(im, re)) AS c, sin(atan2(im, re)) AS s FROM hz)"""


@query("X8_analytic_phase", f"SELECT epoch, j::INT AS j, {rnd('c', 6)} AS c, {rnd('s', 6)} AS s FROM hp",
       (I.EPOCHS_SQL, "one AS (SELECT epoch, 'Cz' AS name, s FROM ep)", hilbert_sql("one")))
def x8(spark, sf):
    z = phase.phasors(I.epochs(spark, sf), SPEC, filtered=False)
    return rounded(z.select("epoch", F.posexplode(F.arrays_zip(F.col("z.cos").alias("c"), F.col("z.sin").alias("s"))).alias("j", "p"))
                   .select("epoch", "j", F.col("p.c").alias("c"), F.col("p.s").alias("s")), 6)


PLV_NAMES = [f"plv_{a}-{b}" for a, b in SPEC.pairs]


def plv_sql(a, b):
    return (f"""(SELECT {rnd('sqrt(pow(avg(x.c * y.c + x.s * y.s), 2) + pow(avg(x.s * y.c - x.c * y.s), 2))', 7)} FROM hp x JOIN hp y """
            f"ON x.epoch = y.epoch AND x.j = y.j WHERE x.name = '{a.lower()}' AND y.name = '{b.lower()}' AND x.epoch = me.epoch) AS \"plv_{a}-{b}\"")


@query("A18_resultant_length", "SELECT epoch, " + ", ".join(plv_sql(a, b) for a, b in SPEC.pairs) + " FROM (SELECT DISTINCT epoch FROM mont) me",
       (I.MONTAGE_SQL, "low AS (SELECT epoch, lower(channel) AS name, s FROM mont WHERE lower(channel) <> 'oz')", hilbert_sql("low")))
def a18(spark, sf):
    """Phase locking of the unfiltered signals, which SQL can repeat."""
    return rounded(phase.phase_locking(I.montage(spark, sf), SPEC, filtered=False).select("epoch", *[F.col(f"`{n}`") for n in PLV_NAMES]), 7)


MONTAGE_BP = "low AS (SELECT mont.epoch, lower(channel) AS name, bp.s FROM mont JOIN bp ON bp.epoch = mont.epoch + channel_idx WHERE lower(channel) <> 'oz')"
PLV = [I.EPOCHS_SQL, FILTER, I.MONTAGE_SQL, MONTAGE_BP, hilbert_sql("low"),
       "plv AS (SELECT epoch, " + ", ".join(plv_sql(a, b).replace(", 8)", ", 6)").replace(", 7)", ", 6)") for a, b in SPEC.pairs) + " FROM (SELECT DISTINCT epoch FROM mont) me)"]


@query("X9_phase_locking", "SELECT dataset, subject, epoch, " + ", ".join(f'"{n}"' for n in PLV_NAMES) + " FROM plv JOIN ep USING (epoch)", tuple(PLV))
def x9(spark, sf):
    return rounded(phase.phase_locking(I.montage(spark, sf), SPEC), 6)


@query("F8_complex_and_logs", f"""SELECT epoch, i::INT AS i, {rnd('cos(v)')} AS c, {rnd('sin(v)')} AS s, {rnd('atan2(v, 1 + v)')} AS a,
    {rnd('sqrt(pow(cos(v), 2) + pow(sin(v), 2))')} AS r, {rnd('CASE WHEN v > 0 THEN ln(v) END', 6)} AS l,
    {rnd('CASE WHEN v > 0 THEN log2(v) END', 6)} AS l2 FROM smp""", (I.EPOCHS_SQL,))
def f8(spark, sf):
    v = F.col("v")
    return rounded(rounded(signals.to_samples(I.epochs(spark, sf), "epoch").select(
        "epoch", "i", F.cos(v).alias("c"), F.sin(v).alias("s"), F.atan2(v, 1 + v).alias("a"),
        resultant_length(F.cos(v), F.sin(v)).alias("r"), F.ln(F.when(v > 0, v)).alias("l"), F.log2(F.when(v > 0, v)).alias("l2")),
        9, "c", "s", "a", "r"), 6, "l", "l2")


# ------------------------------------------------------------------ complexity

LAG = f"""sg AS (SELECT epoch, v, row_number() OVER (PARTITION BY epoch ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY epoch) AS n
    FROM smp WHERE {between('psd')}),
lg AS (SELECT epoch, n, i, v AS a, lead(v) OVER w AS b, lead(v, 2) OVER w AS c FROM sg WINDOW w AS (PARTITION BY epoch ORDER BY i))"""


@query("X10_permutation_entropy", f"""SELECT epoch, {rnd('-sum(p * log2(p)) / log2(6)')} AS perm_entropy FROM (
    SELECT epoch, count(*) / sum(count(*)) OVER (PARTITION BY epoch) AS p FROM (SELECT epoch,
    list_sort([{{'v': a, 'k': 0}}, {{'v': b, 'k': 1}}, {{'v': c, 'k': 2}}]) AS o FROM lg WHERE c IS NOT NULL)
    GROUP BY epoch, o[1].k, o[2].k, o[3].k) GROUP BY epoch""", (I.EPOCHS_SQL, LAG))
def x10(spark, sf):
    return rounded(complexity.neighbour_features(I.epochs(spark, sf), SPEC).select("epoch", "perm_entropy"))


@query("X11_spectral_entropy", f"""SELECT epoch, {rnd('-sum(q * log2(q)) / log2(count(*))')} AS spectral_entropy FROM
    (SELECT epoch, p / sum(p) OVER (PARTITION BY epoch) AS q FROM psd) GROUP BY epoch""", (I.EPOCHS_SQL, PSD))
def x11(spark, sf):
    return rounded(spectral.with_spectral_entropy(I.epochs(spark, sf), SPEC).select("epoch", "spectral_entropy"))


@query("X12_sample_entropy", f"""SELECT ep.epoch, {rnd('CASE WHEN long > 0 THEN -ln(long / short) END')} AS sample_entropy FROM ep LEFT JOIN
    (SELECT x.epoch, count(*) FILTER (WHERE abs(x.a - y.a) < r AND abs(x.b - y.b) < r) AS short,
    count(*) FILTER (WHERE abs(x.a - y.a) < r AND abs(x.b - y.b) < r AND abs(x.c - y.c) < r) AS long
    FROM lg x JOIN lg y ON x.epoch = y.epoch AND x.i < y.i AND x.c IS NOT NULL AND y.c IS NOT NULL
    JOIN (SELECT epoch, 0.2 * stddev_pop(v) AS r FROM sg GROUP BY epoch) q ON q.epoch = x.epoch GROUP BY x.epoch) m
    ON m.epoch = ep.epoch""", (I.EPOCHS_SQL, LAG))
def x12(spark, sf):
    return rounded(complexity.with_sample_entropy(I.epochs(spark, sf), SPEC).select("epoch", "sample_entropy"))


@query("J11_template_matches", """SELECT ep.epoch, coalesce(short, 0) AS short, coalesce(long, 0) AS long FROM ep LEFT JOIN
    (SELECT x.epoch, count(*) FILTER (WHERE abs(x.a - y.a) < r AND abs(x.b - y.b) < r) AS short,
    count(*) FILTER (WHERE abs(x.a - y.a) < r AND abs(x.b - y.b) < r AND abs(x.c - y.c) < r) AS long
    FROM lg x JOIN lg y ON x.epoch = y.epoch AND x.i < y.i AND x.c IS NOT NULL AND y.c IS NOT NULL
    JOIN (SELECT epoch, 0.2 * stddev_pop(v) AS r FROM sg GROUP BY epoch) q ON q.epoch = x.epoch GROUP BY x.epoch) m
    ON m.epoch = ep.epoch""", (I.EPOCHS_SQL, LAG))
def j11(spark, sf):
    e = I.epochs(spark, sf)
    counts = kernels.match_counts(erp.samples("psd"), SPEC.entropy_tolerance)
    return erp.with_windows(e, SPEC, "psd").withColumn("m", counts).select("epoch", "m.short", "m.long")


@query("J11_range_join", registry.SQL["J11_template_matches"])
def j11_range(spark, sf):
    return complexity.template_pairs(I.epochs(spark, sf), SPEC).select("epoch", "short", "long")


@query("X13_higuchi", f"""SELECT epoch, {rnd('regr_slope(ln(len), ln(1.0 / k))')} AS higuchi_fd FROM (SELECT epoch, k,
    sum(abs(v2 - v) * (n - 1) / (most * k * k * k)) AS len FROM (SELECT x.epoch, x.n, k, x.v, y.v AS v2, (x.n - x.i % k - 1) // k AS most, x.i
    FROM (SELECT *, unnest(range(1, 11)) AS k FROM sg) x JOIN sg y ON y.epoch = x.epoch AND y.i = x.i + x.k)
    WHERE i // k + 1 < most GROUP BY epoch, k) GROUP BY epoch""", (I.EPOCHS_SQL, LAG))
def x13(spark, sf):
    return rounded(complexity.neighbour_features(I.epochs(spark, sf), SPEC).select("epoch", "higuchi_fd"))


WALK = """wk AS (SELECT epoch, i, n, sum(v - m) OVER (PARTITION BY epoch ORDER BY i) AS y FROM
    (SELECT epoch, i, n, v, avg(v) OVER (PARTITION BY epoch) AS m FROM sg))"""


@query("X14_dfa", f"""SELECT epoch, {rnd('regr_slope(ln(f), ln(z))')} AS dfa FROM (SELECT epoch, z, sqrt(avg(ss / z)) AS f FROM
    (SELECT epoch, z, i // z AS box, regr_syy(y, i) - pow(regr_sxy(y, i), 2) / regr_sxx(y, i) AS ss FROM
    (SELECT *, unnest({list(SPEC.dfa_sizes)}) AS z FROM wk) WHERE i < n // z * z GROUP BY epoch, z, i // z) GROUP BY epoch, z) GROUP BY epoch""",
       (I.EPOCHS_SQL, LAG, WALK))
def x14(spark, sf):
    return rounded(complexity.with_dfa(I.epochs(spark, sf), SPEC).select("epoch", "dfa"))


@query("W6_cumulative_profile", f"SELECT epoch, i::INT AS i, {rnd('y')} AS y FROM wk", (I.EPOCHS_SQL, LAG, WALK))
def w6(spark, sf):
    return rounded(complexity.cumulative_profile(I.epochs(spark, sf), SPEC).select("epoch", "i", "y"))


@query("X15_hjorth", f"""SELECT epoch, {rnd('sqrt(v1 / v0)')} AS hjorth_mobility, {rnd('sqrt(v2 / v1) / sqrt(v1 / v0)')} AS hjorth_complexity FROM
    (SELECT epoch, var_pop(a) AS v0, var_pop(b - a) AS v1, var_pop(c - 2 * b + a) AS v2 FROM lg GROUP BY epoch)""", (I.EPOCHS_SQL, LAG))
def x15(spark, sf):
    return rounded(complexity.neighbour_features(I.epochs(spark, sf), SPEC).select("epoch", "hjorth_mobility", "hjorth_complexity"))


@query("W5_lagged_embedding", "SELECT epoch, i::INT AS i, a AS x0, b AS x1, c AS x2 FROM lg", (I.EPOCHS_SQL, LAG))
def w5(spark, sf):
    return complexity.lagged_rows(I.epochs(spark, sf), SPEC, 2).select("epoch", "i", "x0", "x1", "x2")


@query("J12_basis_join", f"""SELECT epoch, k::INT AS k, {rnd('sum(v * cos(2 * pi() * i * k / 64))')} AS re, {rnd('sum(v * sin(2 * pi() * i * k / 64))')} AS im
    FROM smp, range(0, 33) r(k) GROUP BY epoch, k""", (I.EPOCHS_SQL,))
def j12(spark, sf):
    return rounded(spectral.basis_sums(signals.to_samples(I.epochs(spark, sf), "epoch"), ["epoch"], 64))


# ------------------------------------------------------------------ assembly

def piece(name):
    """The final SELECT of an earlier query, whose inputs are among those of the assembly."""
    return registry.SQL[name].split(registry.SPLIT, 1)[1]


X16 = f"""SELECT ep.dataset, ep.subject, ep.epoch, CASE WHEN ep.epoch % 5 = 3 THEN 'cz' ELSE 'Cz' END AS vertex_channel, 64.0::DOUBLE AS sfreq,
    {', '.join(rnd('pk.' + c) + ' AS ' + c for c in features.ERP)}, gamma_power, gamma_band_hz, alpha_erd_pct, beta_erd_pct,
    {', '.join('psd_' + b for b in SPEC.bands)}, {', '.join(f'"{n}"' for n in PLV_NAMES)},
    {', '.join(features.COMPLEXITY)}, {rnd('rating')} AS rating, laser_power
    FROM ep JOIN pk USING (epoch) JOIN plv USING (epoch) LEFT JOIN lab ON ep.dataset = lab.dataset AND ep.subject = lab.subject AND ep.epoch = lab.epoch
    {' '.join(f'JOIN ({piece(q)}) q{i} ON q{i}.epoch = ep.epoch' for i, q in enumerate((
        "X5_gamma_power", "X6_erd", "X4_psd_bands", "X10_permutation_entropy", "X11_spectral_entropy", "X12_sample_entropy",
        "X13_higuchi", "X14_dfa", "X15_hjorth")))}"""


@query("X16_feature_rows", X16, (*PLV, PEAKS_SQL, I.EPOCH_LABELS_SQL, PSD, GAMMA, *ERD, LAG, WALK))
def x16(spark, sf):
    """Every feature of every epoch with its label."""
    table = features.feature_table(I.montage(spark, sf), I.epoch_labels(spark, sf), SPEC)
    table = rounded(table, 6, *PLV_NAMES, "alpha_erd_pct", "beta_erd_pct")
    table = rounded(table, 12, "gamma_power", *[f"psd_{b}" for b in SPEC.bands])
    return rounded(table, 9, *features.ERP, *features.COMPLEXITY, "rating")


X17 = f"""SELECT f.dataset, f.subject, f.file, f.epoch::INT AS epoch, CASE WHEN b % 5 = 3 THEN 'cz' ELSE 'Cz' END AS vertex_channel, 64.0::DOUBLE AS sfreq,
    {', '.join(rnd('pk.' + c) + ' AS ' + c for c in features.ERP)}, gamma_power, gamma_band_hz, alpha_erd_pct, beta_erd_pct,
    {', '.join('psd_' + b for b in SPEC.bands)}, {', '.join(f'"{n}"' for n in PLV_NAMES[:3])}, CASE WHEN b % 5 <> 4 THEN "{PLV_NAMES[3]}" END AS "{PLV_NAMES[3]}",
    {', '.join(features.COMPLEXITY)}, {rnd('rating')} AS rating, laser_power, NULL::VARCHAR AS stage, NULL::VARCHAR AS reason
    FROM (SELECT *, unnest(range(0, {I.PER_FILE})) AS epoch FROM fb WHERE reason IS NULL) f JOIN ep ON ep.epoch = {I.PER_FILE} * b + f.epoch
    JOIN pk ON pk.epoch = ep.epoch JOIN plv ON plv.epoch = ep.epoch LEFT JOIN lab ON lab.epoch = ep.epoch
    {' '.join(f'JOIN ({piece(q)}) q{i} ON q{i}.epoch = ep.epoch' for i, q in enumerate((
        "X5_gamma_power", "X6_erd", "X4_psd_bands", "X10_permutation_entropy", "X11_spectral_entropy", "X12_sample_entropy",
        "X13_higuchi", "X14_dfa", "X15_hjorth")))}
    UNION ALL SELECT dataset, subject, file, NULL, NULL, NULL, {', '.join(['NULL'] * len(features.feature_columns(SPEC)))}, NULL, NULL, stage, reason
    FROM fb WHERE reason IS NOT NULL"""


# In the files it is the file, not the epoch, that may lack a CPz.
@query("X17_extract_with_rejects", X17, (*[p.replace("WHEN epoch % 5 = 4 AND name = 'CPz' THEN 'Oz' ", "") for p in PLV], PEAKS_SQL, I.EPOCH_LABELS_SQL, PSD, GAMMA, *ERD, LAG, WALK, I.FILES_SQL))
def x17(spark, sf):
    """From manifest, headers and blocks to the features of every epoch of every sound file, and a reject per other file."""
    table, rejects = extraction.extract_files(*I.stored_files(spark, sf), I.file_labels(spark, sf), SPEC)
    out = rounded(extraction.extraction(table, rejects), 6, *PLV_NAMES, "alpha_erd_pct", "beta_erd_pct")
    out = rounded(out, 12, "gamma_power", *[f"psd_{b}" for b in SPEC.bands])
    return rounded(out, 9, *features.ERP, *features.COMPLEXITY, "rating")


@query("A22_rejects_of_shapes", """SELECT dataset, reason, count(*) AS n FROM (SELECT dataset, subject,
    CASE WHEN count(DISTINCT channel_idx) <> CASE WHEN dataset = 'ds002' THEN 8 ELSE 7 END THEN 'channel count differs from names'
    WHEN dataset = 'ds003' THEN 'sample count differs from time axis' END AS reason FROM mont GROUP BY dataset, subject)
    WHERE reason IS NOT NULL GROUP BY dataset, reason""", (I.MONTAGE_SQL,))
def reject_counts(spark, sf):
    """Files whose declared shape is wrong are counted by reason instead of failing the run."""
    _, rejects = features.extract(I.montage(spark, sf), declared(spark, sf), None, SPEC)
    return features.reject_counts(rejects)


def declared(spark, sf):
    ds = F.col("dataset")
    return I.montage(spark, sf).select("dataset", "subject").distinct().select(
        "dataset", "subject", F.when(ds == "ds002", 8).otherwise(7).alias("n_channels"),
        F.when(ds == "ds003", 65).otherwise(64).alias("n_times"), F.lit(3).alias("ndim"))


@query("P9_shape_validation", """SELECT dataset, subject, count(*) AS n_rows FROM mont WHERE dataset NOT IN ('ds002', 'ds003')
    GROUP BY dataset, subject HAVING count(DISTINCT channel_idx) = 7""", (I.MONTAGE_SQL,))
def p9(spark, sf):
    good, _ = signals.check_shapes(I.montage(spark, sf), declared(spark, sf))
    return good.groupBy("dataset", "subject").agg(F.count(F.lit(1)).alias("n_rows"))


@query("A22_rejects_by_reason", """SELECT CASE label WHEN 9 THEN 'block size' ELSE 'block shape' END AS stage, count(*) AS n FROM embeddings
    WHERE label IN (8, 9) GROUP BY 1 UNION ALL SELECT 'labels', count(*) FROM orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT 'times', count(*) FROM orders WHERE o_orderkey % 2 = 0""")
def a22(spark, sf):
    """Blocks with a wrong shape or none, label files without an event, files without a time axis."""
    o = I.table(spark, sf, "orders").select(F.lit("ds1").alias("dataset"), F.col("o_orderkey").cast("string").alias("subject"), "o_orderkey")
    event = F.struct(F.lit("1").alias("epoch"))
    files = o.select("*", F.when(F.col("o_orderkey") % 3 == 0, F.array(event)).when(F.col("o_orderkey") % 3 == 1, F.array().cast("array<struct<epoch: string>>")).alias("events"),
                     F.lit(None).cast("struct<epoch: string>").alias("event"))
    times = signals.with_times(o.select("*", F.lit(None).cast("array<double>").alias("times_ms"), F.lit(100.0).alias("srate"), F.lit(3).alias("pnts"),
                                        F.when(F.col("o_orderkey") % 2 == 1, 0.5).alias("xmin")))
    stages = [signals.block_rejects(I.float_blocks(spark, sf)), label_source.event_rejects(files), signals.time_rejects(times)]
    return reduce(lambda a, b: a.unionAll(b), [s.select("stage") for s in stages]).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("P10_axis_orientation", """SELECT 'ds' || (vec_id % 2) AS dataset, vec_id::VARCHAR AS subject, (u // 32)::INT AS epoch, CASE WHEN vec_id % 2 = 0
    THEN u // 8 % 4 ELSE u % 4 END::INT AS channel_idx, CASE WHEN vec_id % 2 = 0 THEN u % 8 ELSE u // 4 % 8 END::INT AS i,
    embedding[u + 1]::DOUBLE AS v FROM embeddings, range(0, 64) r(u)""")
def p10(spark, sf):
    """Vectors as 2 x 4 x 8 tensors, half of them with channels and samples swapped; both come out alike."""
    e = I.table(spark, sf, "embeddings")
    even = F.col("vec_id") % 2 == 0
    tensors = e.select(F.concat(F.lit("ds"), (F.col("vec_id") % 2).cast("string")).alias("dataset"), F.col("vec_id").cast("string").alias("subject"),
                       F.col("embedding").alias("data"), F.when(even, F.array(*map(F.lit, (2, 4, 8)))).otherwise(F.array(*map(F.lit, (2, 8, 4)))).alias("dims"),
                       F.lit(4).alias("nbchan"), F.lit(8).alias("pnts"))
    return signals.to_samples(signals.turn_tensors(tensors, ["dataset", "subject"]), "dataset", "subject", "epoch", "channel_idx")


@query("P10_axes_of_cells", """SELECT 'ds' || (vec_id % 2) AS dataset, vec_id::VARCHAR AS subject, (u // 32)::INT AS epoch, CASE WHEN vec_id % 2 = 0
    THEN u // 8 % 4 ELSE u % 4 END::INT AS channel_idx, CASE WHEN vec_id % 2 = 0 THEN u % 8 ELSE u // 4 % 8 END::INT AS i,
    embedding[u + 1]::DOUBLE AS v FROM embeddings, range(0, 64) r(u)""")
def p10_cells(spark, sf):
    """The same tensors stored cell by cell."""
    e = I.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("u", "v"))
    even, u = F.col("vec_id") % 2 == 0, F.col("u")
    cells = e.select(F.concat(F.lit("ds"), (F.col("vec_id") % 2).cast("string")).alias("dataset"), F.col("vec_id").cast("string").alias("subject"),
                     F.expr("cast(u div 32 as int)").alias("a0"),
                     F.when(even, F.expr("u div 8 % 4")).otherwise(F.expr("u div 4 % 8")).cast("int").alias("a1"),
                     F.when(even, u % 8).otherwise(u % 4).cast("int").alias("a2"), F.col("v").cast("double").alias("v"),
                     F.lit(4).alias("n_channels"), F.lit(8).alias("n_times"))
    return signals.to_samples(signals.orient(cells), "dataset", "subject", "epoch", "channel_idx")


@query("S8_float_block_decode", """SELECT 'b/' || vec_id AS path, (u // 16)::INT AS epoch, (u % 4)::INT AS channel_idx, (u // 4 % 4)::INT AS i,
    embedding[u + 1]::DOUBLE AS v FROM embeddings, range(0, 64) r(u) WHERE label NOT IN (8, 9)""")
def s8(spark, sf):
    return signals.to_samples(signals.decode_float_blocks(I.float_blocks(spark, sf)), "path", "epoch", "channel_idx")


@query("S8_blocks_of_all_sizes", """WITH v AS (SELECT embedding AS x, CASE WHEN vec_id // 16 % 2 = 0 THEN 'L' || vec_id // 16 ELSE 'S' || vec_id // 4 END AS path,
    row_number() OVER (PARTITION BY path ORDER BY vec_id) - 1 AS epoch, vec_id // 16 % 10 = 4 AS bad FROM embeddings)
    SELECT path, NULL AS stage, epoch::INT AS epoch, (u % 4)::INT AS channel_idx, (u // 4)::INT AS i, x[u + 1]::DOUBLE AS v FROM v, range(0, 64) r(u)
    WHERE NOT bad AND u % 4 IN (1, 3) UNION ALL SELECT DISTINCT path, 'block size', NULL, NULL, NULL, NULL FROM v WHERE bad""")
def s8_all(spark, sf):
    """Files of four and of sixteen epochs, written and read back; those over 2,000 bytes are read by ranges of three epochs."""
    blocks, folder = I.block_files(spark, sf)
    found = signals.read_float_blocks(spark, folder, blocks)
    rows = found.select("*", F.array(F.lit(1), F.lit(3)).alias("wanted"))
    good = signals.to_samples(signals.stored_signals(rows, wanted="wanted", limit=2000, range_bytes=800), "path", "epoch", "channel_idx")
    both = good.withColumn("stage", F.lit(None).cast("string")).unionByName(signals.block_rejects(found).select("path", "stage"), allowMissingColumns=True)
    return both.withColumn("path", F.regexp_extract("path", "([^/]*)[.]fdt$", 1))


@query("S9_epoch_store", """SELECT dataset, subject, epoch, channel, len(s)::INT AS n_times, round(list_sum(s), 9) + 0.0::DOUBLE AS total FROM mont
    WHERE lower(channel) IN ('cz', 'pz')""", (I.MONTAGE_SQL,))
def s9(spark, sf):
    """Signals written to the shared folder in channel order and read back; the filter skips row groups by channel."""
    from evoq.functions.arrays import total
    from evoq.session import scratch_path
    path = scratch_path(spark, "epochs")
    signals.write_epochs(I.montage(spark, sf), path)
    rows = signals.read_epochs(spark, path).where(F.col("channel_key").isin("cz", "pz"))
    return rounded(rows.select("dataset", "subject", "epoch", "channel", F.size("signal").alias("n_times"), total(F.col("signal")).alias("total")))


# ------------------------------------------------------------------ channels and labels

@query("J7_priority_channel", """SELECT dataset, subject, channel_idx, channel AS vertex_channel FROM ch
    WHERE lower(channel) IN ('cz', 'cpz', 'fcz', 'fz', 'pz') QUALIFY row_number() OVER (PARTITION BY dataset, subject
    ORDER BY list_position(['cz', 'cpz', 'fcz', 'fz', 'pz'], lower(channel)), channel_idx DESC) = 1""",
       (I.MONTAGE_SQL, "ch AS (SELECT DISTINCT dataset, subject, channel_idx, channel FROM mont)"))
def j7(spark, sf):
    return channels.pick_vertex(channels.channel_table(I.montage(spark, sf)))


@query("J8_pair_resolution", """SELECT a.dataset, a.subject, pair, a.channel_idx AS idx_a, b.channel_idx AS idx_b FROM
    (VALUES ('Fz-Cz', 'fz', 'cz'), ('Cz-Pz', 'cz', 'pz'), ('C3-C4', 'c3', 'c4'), ('FCz-CPz', 'fcz', 'cpz')) p(pair, na, nb)
    JOIN ch a ON lower(a.channel) = na JOIN ch b ON lower(b.channel) = nb AND a.dataset = b.dataset AND a.subject = b.subject""",
       (I.MONTAGE_SQL, "ch AS (SELECT DISTINCT dataset, subject, channel_idx, channel FROM mont)"))
def j8(spark, sf):
    return channels.resolve_pairs(channels.channel_table(I.montage(spark, sf)))


@query("J9_channel_presence", "SELECT dataset, subject FROM mont WHERE channel = 'Cz' GROUP BY dataset, subject", (I.MONTAGE_SQL,))
def j9(spark, sf):
    listed = channels.channel_table(I.montage(spark, sf))
    return channels.files_with(listed, listed.select("dataset", "subject").distinct())


@query("A26_channels_and_rate", """SELECT dataset, subject, count(DISTINCT channel) AS n_channels, 64.0::DOUBLE AS sfreq FROM mont
    GROUP BY dataset, subject""", (I.MONTAGE_SQL,))
def a26(spark, sf):
    return summaries.montage_summary(I.montage(spark, sf))


@query("J1_features_with_labels", f"""SELECT ep.dataset, ep.subject, ep.epoch, {rnd('rating')} AS rating, laser_power FROM ep LEFT JOIN lab
    ON ep.dataset = lab.dataset AND ep.subject = lab.subject AND ep.epoch = lab.epoch""", (I.EPOCHS_SQL, I.EPOCH_LABELS_SQL))
def j1(spark, sf):
    return rounded(trials.attach_labels(I.epochs(spark, sf).select("dataset", "subject", "epoch"), I.epoch_labels(spark, sf)))


FIRST_SQL = """fe AS (SELECT dataset, subject, (epoch - 1)::INT AS epoch, rating, laser_power FROM lb WHERE epoch IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY dataset, subject, epoch ORDER BY event_pos, rating NULLS FIRST, laser_power NULLS FIRST) = 1)"""


@query("W1_first_event_per_epoch", "SELECT * FROM fe", (I.LABELS_SQL, FIRST_SQL))
def w1(spark, sf):
    return trials.first_event_per_epoch(I.labels(spark, sf))


@query("J2_spine_reindex", """SELECT f.dataset, f.subject, e::INT AS epoch, rating, laser_power FROM (SELECT DISTINCT dataset, subject FROM lb) f
    CROSS JOIN range(0, 8) r(e) LEFT JOIN fe ON fe.dataset = f.dataset AND fe.subject = f.subject AND fe.epoch = e""", (I.LABELS_SQL, FIRST_SQL))
def j2(spark, sf):
    rows = I.labels(spark, sf)
    files = rows.select("dataset", "subject").distinct().withColumn("n_epochs", F.lit(8))
    return trials.reindex(trials.first_event_per_epoch(rows), files)


