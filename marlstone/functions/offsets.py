"""Quantiser offsets and classes of cells, from what was measured in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# chroma's part in a cell's activity, and the second moment that energy roots are corrected to.
CHROMA_PART, SECOND_MOMENT = 0.35, 11.0
# Bounds of the region classes.
BOUNDS = {
    "flat_var": 12, "flat_edge": 13, "grad_edge": 26, "edge_dense": 38, "text_edge": 64, "dir_dominant": 128,
    "axis_aligned": 160, "low_entropy": 110, "high_entropy": 150, "texture_var": 64, "noise_hi": 7, "chroma_hi": 96,
}
# Samples of chroma in a block of 256, by format.
CHROMA_WEIGHTS = {"gray": 0.0, "420": 64.0, "422": 128.0, "444": 256.0}
# Presets by name: mode, strength, clamp.
PRESETS = {
    "off": ("off", 0.0, 2),
    "legacy-shrink": ("legacy_shrink", 0.0, 8),
    "legacy": ("legacy_shrink", 0.0, 8),
    "perceptual-mild": ("perceptual", 0.20, 2),
    "perceptual": ("perceptual", 0.35, 2),
    "perceptual-chroma-mild": ("perceptual_chroma", 0.20, 2),
    "perceptual-chroma": ("perceptual_chroma", 0.35, 2),
    "auto-variance": ("auto_variance", 1.0, 6),
    "autovar": ("auto_variance", 1.0, 6),
    "auto-variance-biased": ("auto_variance_biased", 1.0, 6),
    "autovar-biased": ("auto_variance_biased", 1.0, 6),
    "psnr-probe": ("psnr_probe", 0.35, 2),
    "psnr": ("psnr_probe", 0.35, 2),
    "positive-probe": ("positive_probe", 0.35, 2),
    "positive": ("positive_probe", 0.35, 2),
    "two-pass": ("two_pass_measured", 1.0, 4),
    "twopass": ("two_pass_measured", 1.0, 4),
}


def activity(variance: Column, chroma: Column) -> Column:
    return F.log2(F.lit(1.0) + variance) + F.lit(CHROMA_PART) * F.log2(F.lit(1.0) + chroma)


def around(raw: Column, clamp: int) -> Column:
    """Rounded half away from zero (a billionth off is a half too) and clamped on both sides."""
    return F.greatest(F.least(F.round(F.round(raw, 9)), F.lit(float(clamp))), F.lit(float(-clamp))).cast("int")


def by_rank(log_variance: Column, low: Column, high: Column, clamp: int) -> Column:
    """+1 to +8 by the place between the picture's least and greatest log variance."""
    span = high - low
    rank = F.when(span <= 1.1920929e-07, F.lit(0.0)).otherwise(F.greatest(F.least((log_variance - low) / span, F.lit(1.0)), F.lit(0.0)))
    return F.greatest(F.least(F.round(F.round(F.lit(1.0) + rank * 7, 9)), F.lit(float(max(clamp, 1)))), F.lit(1.0)).cast("int")


def energy_root(variance: Column, chroma: Column, weight: float | Column) -> Column:
    """The tenth root of a 16x16 block's energy."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return F.pow(variance * F.lit(256.0) + chroma * weight + F.lit(1.0), F.lit(0.1))


def chroma_weight(fmt: Column) -> Column:
    """The weight of chroma in ``energy_root`` by the picture's format; unknown formats have the most."""
    out = F.lit(CHROMA_WEIGHTS["444"])
    for name, weight in CHROMA_WEIGHTS.items():
        out = F.when(fmt == name, F.lit(weight)).otherwise(out)
    return out


def by_energy(adj: Column, avg: Column, final: Column, strength: float, biased: bool, clamp: int) -> Column:
    raw = F.lit(strength) * avg * (adj - final)
    if biased:
        raw = raw + F.lit(strength) * (F.lit(1.0) - F.lit(SECOND_MOMENT) / (adj * adj))
    return F.when((avg <= 0) | (adj <= 0), F.lit(0)).otherwise(around(raw, clamp))


def map_offset(raw: Column, shift: int, clamp: int) -> Column:
    """As the map files have it: rounded half to even, shifted, then clamped."""
    return F.greatest(F.least(F.bround(raw).cast("int") + shift, F.lit(clamp)), F.lit(-clamp))


def two_pass_signal(signal: str, energy: Column, bits: Column, sse: Column, qp: int) -> Column:
    """What a second pass steers by: rd, bits, sse, bits_per_sse, or else the coded energy."""
    made = {"rd": sse + F.lit(0.57 * 2 ** ((qp - 12) / 3)) * bits, "bits": bits, "sse": sse, "bits_per_sse": bits / (F.lit(1.0) + sse)}
    return made.get(signal.strip().lower(), energy)


def importance(edge: Column, global_contrast: Column, surround: Column, noise: Column, region: Column) -> Column:
    """0 to 256: half the edge density, the stronger contrast, a bonus of the class, less a fine for noise."""
    bonus = F.when(region.isin("directional_edge", "text_like"), 96).when(region == "texture", 32).otherwise(0)
    fine = F.when(noise >= BOUNDS["noise_hi"], 96).otherwise(0)
    return F.greatest(F.least(F.floor(edge / 2) + F.greatest(global_contrast, surround) + bonus - fine, F.lit(256)), F.lit(0)).cast("int")


def region_class(variance: Column, edge: Column, entropy: Column, dominance: Column, aligned: Column, noise: Column, chroma: Column) -> Column:
    """One of seven classes, the first rule that holds."""
    b = BOUNDS
    return (
        F.when((edge >= b["text_edge"]) & (entropy < b["low_entropy"]) & (aligned >= b["axis_aligned"]) & (noise < b["noise_hi"]), "text_like")
        .when((edge >= b["edge_dense"]) & (dominance >= b["dir_dominant"]), "directional_edge")
        .when((noise >= b["noise_hi"]) & (variance < b["texture_var"]), "noisy")
        .when((variance >= b["texture_var"]) & (entropy >= b["high_entropy"]), "texture")
        .when((variance < b["flat_var"]) & (edge < b["flat_edge"]), "flat")
        .when(edge < b["grad_edge"], "gradient")
        .when(chroma >= b["chroma_hi"], "chroma_critical")
        .otherwise("texture")
    )


# Fixed values in decision_class: eleven bounds.
def decision_class(pu_per_ctu: Column, angular_pct: Column, tu4_pct: Column, mean_log2: Column, nz_per_px: Column, energy_per_px: Column) -> Column:
    """How an encoder treated a unit: smooth up to two points of eleven, texture from six."""
    points = [pu_per_ctu > 8, pu_per_ctu > 16, angular_pct > 60, tu4_pct > 20, tu4_pct > 40, mean_log2 < 3.4, mean_log2 < 3.0, nz_per_px > 0.08, nz_per_px > 0.22, energy_per_px > 80, energy_per_px > 300]
    score = F.lit(0)
    for p in points:
        score = score + F.coalesce(p, F.lit(False)).cast("int")
    return F.when(score <= 2, "smooth").when(score >= 6, "texture").otherwise("mid")


def signal_offset(source: Column, decision: Column) -> Column:
    """Two steps by the source's class and one by the decisions'."""
    two = F.when(source == "smooth", -2).when(source == "textured", 2).otherwise(0)
    one = F.when(decision == "smooth", -1).when(decision == "texture", 1).otherwise(0)
    return F.greatest(F.least(two + one, F.lit(4)), F.lit(-4))


def container(asked: Column, output: Column) -> Column:
    """'heic' or 'bpg': as asked, or for 'auto' by the output's extension."""
    return F.when(asked != "auto", asked).when(F.lower(output).rlike(r"[^/]\.hei[cf]$"), "heic").otherwise("bpg")


def preset_of(name: Column) -> Column:
    """(mode, strength, clamp) of a preset by its name, in any case; null for an unknown one."""
    rows = F.create_map(*[x for n, (mode, strength, clamp) in PRESETS.items() for x in (F.lit(n), F.struct(F.lit(mode).alias("mode"), F.lit(strength).alias("strength"), F.lit(clamp).alias("clamp")))])
    return F.element_at(rows, F.lower(name))


def presets(spark: SparkSession) -> DataFrame:
    """The named presets: name, mode, strength, clamp."""
    return spark.createDataFrame([(n, *p) for n, p in PRESETS.items()], "name string, mode string, strength double, clamp int")
