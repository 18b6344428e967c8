"""From ink signals to answers: block statistics, weighted votes and review flags.

Signals are a row for each item (form_id, bloque, num) with densities and strokes
of its two cells. All windows are on (form_id, bloque), so one shuffle serves them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["form_id", "bloque"]
# Thresholds of the classification.
MIN_T, MAX_T, CLEAR_P25, EMPTY_P75, RESIDUAL = 0.005, 0.020, 0.040, 0.020, 0.05
CENTER_FACTOR, STROKE_MIN, ARTEFACT, HIGH, VERY_LOW, OUTLIER = 0.25, 0.10, 0.22, 0.060, 0.005, 4.0
EXPECTED = 118


def _block():
    return Window.partitionBy(*BLOCK)


def _rows():
    return _block().orderBy("num")


def _max() -> Column:
    return F.greatest("dens_no", "dens_si")


def cell_marked(df: DataFrame, density: str = "dens_total", area: str = "area_max", pixels: str = "n_pixels") -> DataFrame:
    """Adds `marcada`: density of 0.020, or a contour of 2.5 % of the cell and 20 pixels."""
    return df.withColumn("marcada", (F.col(density) >= 0.020) | ((F.col(area) >= 0.025 * F.col(pixels)) & (F.col(area) >= 20)))


def classify_simple(df: DataFrame) -> DataFrame:
    """Adds opcion, puntaje, confianza from marca_no, marca_si, dens_no, dens_si."""
    no, si, dn, ds = (F.col(c) for c in ("marca_no", "marca_si", "dens_no", "dens_si"))
    apart = F.abs(ds - dn) >= 0.005
    option = (
        F.when(si & ~no, "si").when(no & ~si, "no").when(~no & ~si, "vacio").when(ds > dn * 1.5, "si").when(dn > ds * 1.5, "no").when(apart & (ds > dn), "si").when(apart, "no").otherwise("ambos")
    )
    trust = F.when(no != si, "alta").when(~no & ~si, "alta").when(option == "ambos", "baja").otherwise("media")
    return df.withColumn("opcion", option).withColumn("puntaje", F.when(option.isin("si", "ambos"), 1).otherwise(0)).withColumn("confianza", trust)


def _regime(n: Column, p25: Column, p75: Column, top: Column) -> tuple[Column, Column]:
    clamp = lambda v: F.greatest(F.lit(MIN_T), F.least(F.lit(MAX_T), v))
    empty = (n < 5) | (top < EMPTY_P75)
    kind = F.when(empty, "vacio").when(p25 > CLEAR_P25, "marcado").otherwise("mixto")
    threshold = F.when(empty, 0.0).when(p25 > CLEAR_P25, clamp(p25 * 0.4)).when(p75 < EMPTY_P75, MIN_T).otherwise(clamp((p25 + p75) / 2))
    return kind, threshold


def block_regime(signals: DataFrame) -> DataFrame:
    """Per block: n, quartiles and maximum of the darker cell of each item, its kind and threshold."""
    q = F.percentile(_max(), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    b = signals.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.max(_max()).alias("max_d"))
    b = b.select(*BLOCK, "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max_d")
    kind, threshold = _regime(F.col("n"), F.col("p25"), F.col("p75"), F.col("max_d"))
    return b.withColumn("regimen", kind).withColumn("umbral", threshold)


def residual_blocks(signals: DataFrame) -> DataFrame:
    """Per block: the median of the paler cells, and whether it is a residual grid."""
    m = signals.groupBy(*BLOCK).agg(F.percentile(F.least("dens_no", "dens_si"), F.lit(0.5)).alias("mediana_min"))
    return m.withColumn("residual", F.col("mediana_min") > RESIDUAL)


def is_real_mark(df: DataFrame, dens: str, centro: str, stroke: str, umbral: str = "umbral", median: str = "mediana") -> DataFrame:
    """Adds `real`: over the threshold with centre and stroke to match; below it, far over the block's median, or dense with a clear stroke."""
    d, c, s, t, m = (F.col(x) for x in (dens, centro, stroke, umbral, median))
    above = (c >= t * CENTER_FACTOR) & (s >= STROKE_MIN)
    rescue = ((m > 0.001) & (d > m * 2.5) & ((c > 0.005) | (s > 0.25))) | ((d > 0.025) & (s > 0.15))
    return df.withColumn("real", F.when(d >= t, above).otherwise(F.coalesce(rescue, F.lit(False))))


def classify_vote(df: DataFrame, umbral: str = "umbral") -> DataFrame:
    """Adds opcion, puntaje, confianza, revisar, motivo by a weighted vote of the signals of both cells."""
    t = F.col(umbral)

    def cell(side: str) -> dict[str, Column]:
        blot = F.col(f"centro_{side}") > ARTEFACT
        value = lambda c: F.when(blot, 0.0).otherwise(F.coalesce(F.col(f"{c}_{side}"), F.lit(0.0)))
        d, c, s, x = value("dens"), value("centro"), value("stroke"), value("dt")
        vote = lambda test, weight: F.when(test, weight).otherwise(0)
        score = vote(d >= t, 2) + vote(c >= t * CENTER_FACTOR, 4) + vote((s >= STROKE_MIN) & (d > t * 0.5), 2) + vote(x >= 0.25, 2)
        return {f"__d_{side}": d, f"__c_{side}": c, f"__s_{side}": score}

    out = df.withColumns(cell("no") | cell("si"))
    dn, ds, cn, cs, sn, ss = (F.col(f"__{k}_{side}") for k in "dcs" for side in ("no", "si"))
    yn, ys = F.coalesce(F.col("sym_no"), F.lit(0.0)), F.coalesce(F.col("sym_si"), F.lit(0.0))
    diff = F.abs(sn - ss)
    verdict = lambda option, trust, why=None: F.struct(F.lit(option).alias("opcion"), F.lit(trust).alias("confianza"), F.lit(why).cast("string").alias("motivo"))
    result = (
        F.when((sn < 3) & (ss < 3), verdict("vacio", "alta"))
        .when((diff >= 5) & (ss > sn), verdict("si", "alta"))
        .when(diff >= 5, verdict("no", "alta"))
        .when((diff >= 3) & (ss > sn), verdict("si", "media"))
        .when(diff >= 3, verdict("no", "media"))
        .when((diff > 0) & (ds > dn), verdict("si", "media"))
        .when((diff > 0) & (dn > ds), verdict("no", "media"))
        .when((F.abs(cs - cn) > 0.003) & (cs > cn), verdict("si", "media"))
        .when(F.abs(cs - cn) > 0.003, verdict("no", "media"))
        .when((ys > yn) & (ys >= 0.5), verdict("si", "media"))
        .when((yn > ys) & (yn >= 0.5), verdict("no", "media"))
        .when((sn >= 5) & (ss >= 5), verdict("ambos", "baja", "empate de score con ambos altos"))
        .otherwise(verdict("vacio", "baja", "empate de score con ambos bajos"))
    )
    out = out.withColumn("__v", result).drop(*(f"__{k}_{side}" for k in "dcs" for side in ("no", "si")))
    out = out.withColumns({c: F.col(f"__v.{c}") for c in ("opcion", "confianza", "motivo")}).drop("__v")
    return out.withColumn("puntaje", F.when(F.col("opcion").isin("si", "ambos"), 1).otherwise(0)).withColumn("revisar", F.col("motivo").isNotNull())


def _enough() -> Column:
    return F.count(F.lit(1)).over(_block()) >= 5


def _exact(density: str) -> Column:
    """A density as a decimal of 12 places: sums of these are the same in any order, so equal sides are a tie, never chance. What isn't a number is left out."""
    return F.col(density).try_cast("decimal(26,12)")


def low_stroke() -> Column:
    """Dense, but one of the strokes is thin."""
    return _enough() & (_max() > HIGH) & (F.least("stroke_no", "stroke_si") < 0.12)


def neighbors() -> Column:
    """Over four times the median of the two items before and the two after."""
    at = lambda k: F.lag(_max(), k).over(_rows())
    near = F.array_sort(F.array_compact(F.array(at(2), at(1), at(-1), at(-2))))
    n = F.size(near)
    median = F.when(n > 0, (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2)
    return _enough() & F.coalesce((median > 0.001) & (_max() > median * OUTLIER), F.lit(False))


def inversion(weight: Callable[[str], Column] = F.col) -> Column:
    """Against a block that leans three to one to the other column. weight: how a density is summed."""
    no, si = F.sum(weight("dens_no")).over(_block()), F.sum(weight("dens_si")).over(_block())
    dn, ds = F.col("dens_no"), F.col("dens_si")
    return _enough() & (((no > si * 3) & (no > 0.5) & (ds > HIGH) & (dn < VERY_LOW)) | ((si > no * 3) & (si > 0.5) & (dn > HIGH) & (ds < VERY_LOW)))


def incoherent() -> Column:
    """One of the first two items, clearly marked against the block's trend. Equal sums of both columns lean to si."""
    trend = F.sum(_exact("dens_no")).over(_block()) > F.sum(_exact("dens_si")).over(_block())
    return (_max() >= 0.05) & ((F.col("dens_no") > F.col("dens_si")) != trend) & (F.row_number().over(_rows()) <= 2)


def _swap(weight: Callable[[str], Column]) -> Column:
    """The first two items, if they look exchanged: the first goes against the trend of the rest, the next two follow it, and their densities are alike. `__at` numbers the items of the block."""
    w = _block()
    rest = lambda c: F.sum(F.when(F.col("__at") > 1, weight(c)).otherwise(0)).over(w)
    pick = lambda k, v: F.max(F.when(F.col("__at") == k, v)).over(w)
    way = F.when(_max() >= 0.030, F.when(F.col("dens_no") > F.col("dens_si"), "no").otherwise("si"))
    no, si = rest("dens_no"), rest("dens_si")
    trend = F.when(no > si * 3, "no").when(si > no * 3, "si")
    other = F.when(trend == "no", "si").when(trend == "si", "no")
    d0, d1 = pick(1, _max()), pick(2, _max())
    alike = F.greatest(d0, d1) / F.greatest(F.least(d0, d1), F.lit(0.001)) <= 3.0
    found = (F.count(F.lit(1)).over(w) >= 4) & (pick(1, way) == other) & (pick(2, way) == trend) & (pick(3, way) == trend) & (d0 >= 0.030) & (d1 >= 0.030) & alike
    return F.coalesce(found & (F.col("__at") <= 2), F.lit(False))


def flag(signals: DataFrame, name: str, weight: Callable[[str], Column] = F.col) -> DataFrame:
    """Adds one flag: low_stroke, neighbors, inversion, incoherent or swap. weight: how inversion and swap sum a density."""
    if name == "swap":
        return signals.withColumn("__at", F.row_number().over(_rows())).withColumn("swap", _swap(weight)).drop("__at")
    return signals.withColumn(name, {"low_stroke": low_stroke, "neighbors": neighbors, "inversion": lambda: inversion(weight), "incoherent": incoherent}[name]())


FLAGS = ("low_stroke", "neighbors", "inversion", "incoherent", "swap")


def with_flags(signals: DataFrame) -> DataFrame:
    """All flags, every sum of them exact."""
    return reduce(lambda df, name: flag(df, name, _exact), FLAGS, signals)


def merge_review(df: DataFrame) -> DataFrame:
    """revisar and motivo from those of the vote and the flags: the vote's motive stays, an outlier fills blanks, a swap overrides."""
    outlier = F.col("low_stroke") | F.col("neighbors") | F.col("inversion") | F.col("incoherent")
    why = F.when(F.col("swap"), "posible swap de filas").otherwise(F.coalesce(F.col("motivo"), F.when(outlier, "outlier del bloque")))
    return df.withColumn("motivo", why).withColumn("revisar", F.col("revisar") | outlier | F.col("swap"))


def review_list(df: DataFrame) -> DataFrame:
    """Per form the sorted items to review."""
    return df.where("revisar").groupBy("form_id").agg(F.array_sort(F.collect_set("item")).alias("items_revisar"))


def classify_forms(signals: DataFrame) -> DataFrame:
    """The two-pass classifier: block statistics by windows, then the vote and the flags. Empty and residual blocks are vacio throughout."""
    w = _block()
    q = lambda p: F.percentile(_max(), F.lit(p)).over(w)
    s = signals.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("p25", q(0.25)).withColumn("p75", q(0.75)).withColumn("max_d", F.max(_max()).over(w))
    s = s.withColumn("residual", F.percentile(F.least("dens_no", "dens_si"), F.lit(0.5)).over(w) > RESIDUAL)
    kind, threshold = _regime(F.col("n"), F.col("p25"), F.col("p75"), F.col("max_d"))
    s = s.withColumn("regimen", kind).withColumn("umbral", threshold)
    c = merge_review(with_flags(classify_vote(s)))
    off = F.col("residual") | (F.col("regimen") == "vacio")
    out = c.withColumns({
        "opcion": F.when(off, "vacio").otherwise(F.col("opcion")), "puntaje": F.when(off, 0).otherwise(F.col("puntaje")), "confianza": F.when(off, "alta").otherwise(F.col("confianza")),
        "motivo": F.when(F.col("residual"), "cuadrícula residual en el bloque").when(off, None).otherwise(F.col("motivo")), "revisar": F.when(off, False).otherwise(F.col("revisar")),
    })
    return out.withColumn("item", F.concat("bloque", F.col("num").cast("string"))).select("form_id", "bloque", "num", "item", "opcion", "puntaje", "confianza", "revisar", "motivo")


def form_outcome(items: DataFrame, problems: DataFrame | None = None, expected: int = EXPECTED) -> DataFrame:
    """Per form: procesados, vacios, ambos, a_revisar, estado: ok, warn (93 % of the items) or fail. problems: form_id, n_problemas."""
    counts = items.groupBy("form_id").agg(
        F.count(F.lit(1)).alias("procesados"), F.count_if(F.col("opcion") == "vacio").alias("vacios"), F.count_if(F.col("opcion") == "ambos").alias("ambos"), F.count_if("revisar").alias("a_revisar")
    )
    bad = F.lit(0)
    if problems is not None:
        counts, bad = counts.join(problems, "form_id", "left"), F.coalesce("n_problemas", F.lit(0))
    state = F.when((F.col("procesados") >= expected) & (bad == 0), "ok").when(F.col("procesados") >= int(expected * 0.93), "warn").otherwise("fail")
    return counts.withColumn("estado", state).select("form_id", "procesados", "vacios", "ambos", "a_revisar", "estado")
