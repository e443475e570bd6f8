"""Signal queries: values of users' events in order of time are the signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import signal as S
from quern.plans.common import rounded, table

FS, WIDTH, STRIDE, FILTERS = 50.0, 16, 8, 6


def signals(spark, sf):
    """A signal (id, x) for each user; a user's events are one bounded group of the table."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return e.select(F.col("user_id").alias("id"), F.transform("e", lambda v: v["value"]).alias("x"))


def _frames(spark, sf):
    return signals(spark, sf).select("id", F.posexplode(S.to_frames(F.col("x"), WIDTH, STRIDE)).alias("frame", "x"))


def _long(df, array, key=("id",), digits=5):
    return df.select(*key, F.posexplode(array).alias("k", "v")).select(*key, "k", rounded("v", digits).alias("v"))


def _frame_rows(spark, sf):
    return _frames(spark, sf).select("id", "frame", F.size("x").alias("n"), rounded(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


def _preemphasis(spark, sf):
    return _long(signals(spark, sf), S.preemphasis(F.col("x"), 0.95))


def _autocorrelation(spark, sf):
    return _long(_frames(spark, sf), S.autocorrelate(F.col("x")), ("id", "frame"), 4)


def _dct(orthonormal):
    return lambda spark, sf: _long(_frames(spark, sf), S.dct(F.col("x"), orthonormal), ("id", "frame"))


def _dft(spark, sf):
    d = _frames(spark, sf).select("id", "frame", F.posexplode(S.dft(F.col("x"))).alias("k", "c"))
    return d.select("id", "frame", "k", rounded("c.re", 5).alias("re"), rounded("c.im", 5).alias("im"))


def _spectrum(make):
    return lambda spark, sf: _long(_frames(spark, sf), make(S.dft(F.col("x"))), ("id", "frame"), 4)


def _constant(array, digits=6):
    return lambda spark, sf: spark.range(1).select(F.posexplode(array()).alias("k", "v")).select("k", rounded("v", digits).alias("v"))


def _mel_scale(spark, sf):
    return signals(spark, sf).select(F.explode("x").alias("v")).agg(
        rounded(F.sum(S.hz2mel(F.abs("v"))), 3).alias("mel"), rounded(F.sum(S.mel2hz(F.abs("v") * 10)), 3).alias("hz"), rounded(F.max(F.abs(S.mel2hz(S.hz2mel(F.abs("v"))) - F.abs("v"))), 6).alias("error")
    )


def _filterbank(spark, sf):
    rows = [(i, k, round(v, 6)) for i, f in enumerate(S.mel_filterbank(WIDTH, FILTERS, FS)) for k, v in enumerate(f)]
    return spark.createDataFrame(rows, "filter int, k int, v double")


def _energies(spark, sf):
    f = signals(spark, sf).select("id", F.posexplode(S.to_frames(S.preemphasis(F.col("x"), 0.95), WIDTH, STRIDE)).alias("frame", "x"))
    return f.select("id", "frame", S.mel_energies(F.col("x"), WIDTH, FILTERS, FS, "hamming").alias("e"))


def _mel_spectrogram(spark, sf):
    return _long(_energies(spark, sf), F.transform("e", lambda v: F.log(v)), ("id", "frame"), 4)


def _mfcc(spark, sf):
    return _long(_energies(spark, sf), S.mfcc(F.col("e"), 4, 22), ("id", "frame"), 3)


def _lifter(spark, sf):
    return _long(_frames(spark, sf), S.cepstral_lifter(F.col("x"), 22), ("id", "frame"))


def _resample_nearest(spark, sf):
    """Every signal at 20 evenly spaced places."""
    s = signals(spark, sf).select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    return s.select("id", "k", rounded(S.nearest_1d(F.col("x"), F.col("k") * (F.size("x") - 1) / 19.0), 5).alias("v"))


def _images(spark, sf):
    """Embeddings as 8 x 8 images in long form (id, row, col, v)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"))
    return e.select("id", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).cast("int").alias("col"), "v")


def _resample_bilinear(spark, sf):
    """Images at 5 x 5 places: four pixels of each place by an equi-join, weighted."""
    place = F.sequence(F.lit(0), F.lit(4))
    grid = spark.range(1).select(F.explode(place).alias("i")).select("i", F.explode(place).alias("j"))
    r0, r1, wr = S.bilinear_1d_weights(F.col("i") * 7 / 4.0, F.lit(8))
    c0, c1, wc = S.bilinear_1d_weights(F.col("j") * 7 / 4.0, F.lit(8))
    corners = F.array(*(F.struct(r.alias("row"), c.alias("col"), w.alias("w")) for r, c, w in ((r0, c0, (1 - wr) * (1 - wc)), (r0, c1, (1 - wr) * wc), (r1, c0, wr * (1 - wc)), (r1, c1, wr * wc))))
    weights = grid.select("i", "j", F.explode(corners).alias("x")).select("i", "j", "x.*")  # 100 rows
    out = _images(spark, sf).join(F.broadcast(weights), ["row", "col"]).groupBy("id", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("id", "i", "j", rounded("v", 5).alias("v"))


def _resample_nearest_2d(spark, sf):
    place = F.sequence(F.lit(0), F.lit(4))
    grid = spark.range(1).select(F.explode(place).alias("i")).select("i", F.explode(place).alias("j"))
    near = lambda c: F.bround(F.col(c) * 7 / 4.0).cast("int")
    grid = grid.select("i", "j", near("i").alias("row"), near("j").alias("col"))
    return _images(spark, sf).join(F.broadcast(grid), ["row", "col"]).select("id", "i", "j", rounded("v", 5).alias("v"))


SIG = "s as (select user_id as id, list(value order by ts, event_id) as x from events group by 1)"
FR = f"{SIG}, f0 as (select id, unnest(range(0, (len(x) - {WIDTH}) // {STRIDE} + 1)) as frame, x from s where len(x) >= {WIDTH}), f as (select id, frame::int as frame, x[frame*{STRIDE}+1:frame*{STRIDE}+{WIDTH}] as x from f0)"
K = f"k as (select unnest(range(0, {WIDTH})) as k)"
KH = f"k as (select unnest(range(0, {WIDTH // 2 + 1})) as k)"
_R = "round({}, {}) + 0.0"
_DCT = f"2 * list_sum([x[n+1] * cos(pi() * k * (2*n+1) / {2 * WIDTH}) for n in range(0, {WIDTH})])"
_RE = f"list_sum([x[n+1] * cos(-2 * pi() * k * n / {WIDTH}) for n in range(0, {WIDTH})])"
_IM = f"list_sum([x[n+1] * sin(-2 * pi() * k * n / {WIDTH}) for n in range(0, {WIDTH})])"


def _cosine_sql(n: int, a: tuple[float, ...], span: int) -> str:
    value = " + ".join(f"({(-1) ** k * v})::double * cos(2 * pi() * {k} * k / {span})" for k, v in enumerate(a))
    return f"select k::int as k, round({value}, 6) + 0.0 as v from (select unnest(range(0, {n})) as k)"


_BANK = f"""edge as (select i, 700 * (pow(10, (2595 * log10(1 + {FS / 2} / 700) * i / {FILTERS + 1}) / 2595) - 1) as e from (select unnest(range(0, {FILTERS + 2})) as i)),
 bank as (select a.i::int as filter, k::int as k, greatest(0, least((k * {FS} / {WIDTH} - a.e) / (b.e - a.e), (c.e - k * {FS} / {WIDTH}) / (c.e - b.e))) * 2 / (c.e - a.e) as v
 from edge a join edge b on b.i = a.i + 1 join edge c on c.i = a.i + 2, (select unnest(range(0, {WIDTH // 2 + 1})) as k))"""
_ENERGY = f"""{SIG}, s2 as (select id, [x[i] - 0.95 * (case when i = 1 then 0 else x[i-1] end) for i in range(1, len(x) + 1)] as x from s),
 f0 as (select id, unnest(range(0, (len(x) - {WIDTH}) // {STRIDE} + 1)) as frame, x from s2 where len(x) >= {WIDTH}),
 f as (select id, frame::int as frame, [x[frame*{STRIDE}+n+1] * (0.54 - 0.46 * cos(2 * pi() * n / {WIDTH})) for n in range(0, {WIDTH})] as x from f0), {KH}, {_BANK},
 p as (select id, frame, k, (pow({_RE}, 2) + pow({_IM}, 2)) / {WIDTH // 2 + 1} as p from f, k),
 e as (select id, frame, filter, greatest(sum(p * v), {S.EPS}) as e from p join bank using (k) group by 1, 2, 3)"""
_PIX = "px as (select vec_id as id, p // 8 as row, p % 8 as col, embedding[p+1]::double as v from embeddings, (select unnest(range(0, 64)) as p))"
_GRID = "g as (select i, j from (select unnest(range(0, 5)) as i), (select unnest(range(0, 5)) as j))"

QUERIES = {
    "signal_frames": _frame_rows,
    "signal_preemphasis": _preemphasis,
    "signal_autocorrelation": _autocorrelation,
    "signal_dct": _dct(True),
    "signal_dct_raw": _dct(False),
    "signal_dft": _dft,
    "signal_dft_bins": _constant(lambda: S.dft_bins(WIDTH, FS, False)),
    "signal_magnitude": _spectrum(S.magnitude),
    "signal_power": _spectrum(lambda c: S.power(c, True)),
    "window_hamming": _constant(lambda: S.window("hamming", 33)),
    "window_hann": _constant(lambda: S.window("hann", 33, True)),
    "window_blackman_harris": _constant(lambda: S.window("blackman_harris", 33)),
    "window_generalized_cosine": _constant(lambda: S.generalized_cosine(20, (0.4, 0.5, 0.1), True)),
    "mel_scale": _mel_scale,
    "mel_filterbank": _filterbank,
    "mel_spectrogram": _mel_spectrogram,
    "mfcc": _mfcc,
    "cepstral_lifter": _lifter,
    "interpolate_nearest_1d": _resample_nearest,
    "resample_bilinear": _resample_bilinear,
    "resample_nearest": _resample_nearest_2d,
}
ORACLES = {
    "signal_frames": f"with {FR} select id, frame, len(x)::int as n, round(list_sum(x), 5) + 0.0 as total from f",
    "signal_preemphasis": f"with {SIG}, i as (select id, x, unnest(range(1, len(x) + 1)) as i from s) select id, (i - 1)::int as k, round(x[i] - 0.95 * (case when i = 1 then 0 else x[i-1] end), 5) + 0.0 as v from i",
    "signal_autocorrelation": f"with {FR}, {K} select id, frame, k::int as k, round(list_sum([x[n+k+1] * x[n+1] for n in range(0, {WIDTH} - k)]), 4) + 0.0 as v from f, k",
    "signal_dct": f"with {FR}, {K} select id, frame, k::int as k, round({_DCT} * (case when k = 0 then sqrt(1.0 / {4 * WIDTH}) else sqrt(1.0 / {2 * WIDTH}) end), 5) + 0.0 as v from f, k",
    "signal_dct_raw": f"with {FR}, {K} select id, frame, k::int as k, round({_DCT}, 5) + 0.0 as v from f, k",
    "signal_dft": f"with {FR}, {KH} select id, frame, k::int as k, round({_RE}, 5) + 0.0 as re, round({_IM}, 5) + 0.0 as im from f, k",
    "signal_dft_bins": f"with {K} select k::int as k, round((case when k < {WIDTH // 2} then k else k - {WIDTH} end) * {FS} / {WIDTH}, 6) + 0.0::double as v from k",
    "signal_magnitude": f"with {FR}, {KH} select id, frame, k::int as k, round(sqrt(pow({_RE}, 2) + pow({_IM}, 2)), 4) + 0.0 as v from f, k",
    "signal_power": f"with {FR}, {KH} select id, frame, k::int as k, round((pow({_RE}, 2) + pow({_IM}, 2)) / {WIDTH // 2 + 1}, 4) + 0.0 as v from f, k",
    "window_hamming": _cosine_sql(33, S.WINDOWS["hamming"], 33),
    "window_hann": _cosine_sql(33, S.WINDOWS["hann"], 32),
    "window_blackman_harris": _cosine_sql(33, S.WINDOWS["blackman_harris"], 33),
    "window_generalized_cosine": _cosine_sql(20, (0.4, 0.5, 0.1), 19),
    "mel_scale": "select round(sum(2595 * log10(1 + abs(value) / 700)), 3) as mel, round(sum(700 * (pow(10, abs(value) * 10 / 2595) - 1)), 3) as hz, 0.0::double as error from events",
    "mel_filterbank": f"with {_BANK} select filter, k, round(v, 6) as v from bank",
    "mel_spectrogram": f"with {_ENERGY} select id, frame, filter as k, round(ln(e), 4) + 0.0 as v from e",
    "mfcc": f"""with {_ENERGY}, l as (select id, frame, list(10 * log10(e) order by filter) as x from e group by 1, 2), c as (select unnest(range(0, 4)) as k)
 select id, frame, k::int as k, round(2 * list_sum([x[n+1] * cos(pi() * k * (2*n+1) / {2 * FILTERS}) for n in range(0, {FILTERS})])
 * (case when k = 0 then sqrt(1.0 / {4 * FILTERS}) else sqrt(1.0 / {2 * FILTERS}) end) * (1 + 11 * sin(pi() * k / 22)), 3) + 0.0 as v from l, c""",
    "cepstral_lifter": f"with {FR}, {K} select id, frame, k::int as k, round(x[k+1] * (1 + 11 * sin(pi() * k / 22)), 5) + 0.0 as v from f, k",
    "interpolate_nearest_1d": f"with {SIG}, k as (select unnest(range(0, 20)) as k) select id, k::int as k, round(x[(round_even(k * (len(x) - 1) / 19.0::double, 0) + 1)::int], 5) + 0.0 as v from s, k",
    "resample_bilinear": f"""with {_PIX}, {_GRID}, w as (select i, j, least(floor(i * 7 / 4.0), 6)::int as r, i * 7 / 4.0::double - least(floor(i * 7 / 4.0), 6) as wr, least(floor(j * 7 / 4.0), 6)::int as c,
 j * 7 / 4.0::double - least(floor(j * 7 / 4.0), 6) as wc from g)
 select id, i::int as i, j::int as j, round(sum(v * (case when row = r then 1 - wr else wr end) * (case when col = c then 1 - wc else wc end)), 5) + 0.0 as v
 from px, w where row in (r, r + 1) and col in (c, c + 1) group by 1, 2, 3""",
    "resample_nearest": f"with {_PIX}, {_GRID} select id, i::int as i, j::int as j, round(v, 5) + 0.0 as v from px join g on row = round_even(i * 7 / 4.0, 0)::int and col = round_even(j * 7 / 4.0, 0)::int",
}
