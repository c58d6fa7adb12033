"""Names of variants as settings: a small language, read by column functions.

    name[+qg16]                        an offset map of that kind
    cli:preset[+qg16]                  a preset of the encoder
    psy:rd[:rdoq][:aq=preset][+qg16]   psychovisual strengths, and a preset beside them

Assignments ``KEY=VALUE,KEY=VALUE`` set one key after another; the last one holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a group of 16 samples is asked for by, and the groups' edges without and with it.
SMALL_GROUPS, USUAL_EDGE, SMALL_EDGE = "+qg16", 32, 16
NAMED, PRESET, PSYCHOVISUAL = "map", "cli", "psy"


def variant(token: Column) -> Column:
    """The settings of one token: kind, map, preset, psy_rd, psy_rdoq, group_edge, and fault.

    ``fault`` is null, or the place (from 1) of the first part of the token that is no
    number where one must stand, or is empty; a token with a fault has no settings.
    """
    text = F.replace(token, F.lit(SMALL_GROUPS), F.lit(""))
    edge = F.when(F.contains(token, F.lit(SMALL_GROUPS)), SMALL_EDGE).otherwise(USUAL_EDGE)
    kind = F.when(text.startswith("psy:"), PSYCHOVISUAL).when(text.startswith("cli:"), PRESET).otherwise(NAMED)
    parts = F.split(F.substring(text, 5, 1 << 20), ":")
    second = F.get(parts, F.lit(1))
    own = F.when(~second.startswith("aq="), second)
    preset = F.get(F.filter(F.slice(parts, 2, 1 << 20), lambda p: p.startswith("aq=")), F.lit(0))
    rd, rdoq = F.get(parts, F.lit(0)).try_cast("double"), own.try_cast("double")
    is_psy, is_cli = kind == PSYCHOVISUAL, kind == PRESET
    fault = (
        F.when(is_psy & rd.isNull(), 5)
        .when(is_psy & own.isNotNull() & rdoq.isNull(), 6 + F.char_length(F.get(parts, F.lit(0))))
        .when(is_cli & (F.char_length(text) == 4), 5)
        .when(text == "", 1)
    )
    set_if = lambda condition, value: F.when(fault.isNull() & condition, value)
    return F.struct(
        F.when(fault.isNull(), kind).alias("kind"), set_if(kind == NAMED, text).alias("map"),
        F.coalesce(set_if(is_cli, F.substring(text, 5, 1 << 20)), set_if(is_psy, F.substring(preset, 4, 1 << 20))).alias("preset"),
        set_if(is_psy, rd).alias("psy_rd"), set_if(is_psy, F.coalesce(rdoq, F.lit(0.0))).alias("psy_rdoq"), F.when(fault.isNull(), edge).alias("group_edge"), fault.alias("fault"),
    )


def variant_name(token: Column) -> Column:
    """What results are filed under: a psychovisual token without ``:`` and ``=``, a preset without its mark."""
    return F.when(token.startswith("psy:"), F.replace(F.replace(token, F.lit(":"), F.lit("_")), F.lit("="), F.lit(""))).when(token.startswith("cli:"), F.replace(token, F.lit("cli:"), F.lit(""))).otherwise(token)


def expand_variants(tokens: DataFrame, token: str, strengths: Sequence[float] = (), strength: float = 1.0) -> DataFrame:
    """``tokens`` with variant, strength and the settings of ``variant``, a row for each strength.

    With several strengths names end in ``_s`` and the strength in hundredths; a single
    one, the default, leaves names as they are.
    """
    value = F.col("strength")
    many = tokens.withColumn("strength", F.explode(F.array(*map(F.lit, map(float, strengths))))) if strengths else tokens.withColumn("strength", F.lit(float(strength)))
    suffix = F.concat(F.lit("_s"), F.lpad(F.bround(value * 100).cast("int").cast("string"), 3, "0")) if strengths else F.lit("")
    named = many.withColumns({"variant": variant_name(F.concat(F.col(token), suffix)), "_v": variant(F.col(token))})
    return named.select(*tokens.columns, "variant", "strength", "_v.*")


def assignments(text: Column) -> Column:
    """(settings: a map, fault): ``KEY=VALUE`` parts, parted by commas and trimmed; of a key that repeats the last value holds.

    ``fault`` is null, or the number (from 1) of the first part without ``=`` or with an
    empty key; there are no settings then.  Values may hold ``=``.
    """
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    bad = F.transform(parts, lambda p: ~F.contains(p, F.lit("=")) | (F.trim(F.substring_index(p, "=", 1)) == ""))
    place = F.array_position(bad, True)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.lit(1 << 20)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    fault = F.when(place > 0, place)
    return F.struct(F.when(fault.isNull(), F.map_from_entries(last)).alias("settings"), fault.alias("fault"))
