"""Consistency rules of synthetic records: an ordered array of the ids of those that a record breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.vocab import LIMITED_FLOW, LIMITED_FOCI, SOFT_MARGINS, SOFT_SHAPES


def rules() -> list[tuple[str, Column]]:
    composition, echo, shape = F.col("composition"), F.col("echogenicity"), F.col("shape")
    dims = F.col("dims")
    soft = {"echogenic_foci": LIMITED_FOCI, "vascularity": LIMITED_FLOW, "shape": SOFT_SHAPES, "margin": SOFT_MARGINS}
    out = [(f"{name}.not_applicable", F.coalesce(F.col(column) == "not_applicable", F.lit(False))) for name, column in (("dimensions", "dims_state"), ("echogenicity", "echogenicity"), ("echogenic_foci", "echogenic_foci"), ("vascularity", "vascularity"))]

    def outside(group: str, condition: Column) -> list[tuple[str, Column]]:
        return [(f"{group}_{field}", condition & ~F.col(field).isin(list(codes))) for field, codes in soft.items()]

    out.append(("composition.non_cystic_anechoic", composition.isin("solid", "mixed_cystic_solid") & echo.isin("anechoic", "not_applicable")))
    out.append(("composition.cystic_echogenicity", (composition == "cystic") & ~echo.isin("anechoic", "not_mentioned", "unknown")))
    out += outside("composition.cystic", composition == "cystic")
    out.append(("composition.spongiform_echogenicity", (composition == "spongiform") & echo.isin("anechoic", "very_hypoechoic", "not_applicable")))
    out += outside("composition.spongiform", composition == "spongiform")
    out += outside("echogenicity.anechoic", echo == "anechoic")
    measured = dims.isNotNull()
    width, depth = F.try_element_at(dims, F.lit(1)), F.try_element_at(dims, F.lit(2))
    out.append(("dimensions.below_synthetic_minimum", measured & (F.array_min(dims) < 3)))
    out.append(("dimensions.extreme_ratio", measured & (F.array_max(dims) > 3 * F.array_min(dims))))
    out.append(("shape.wider_than_tall_mismatch", measured & (shape == "wider_than_tall") & (depth > width)))
    out.append(("shape.taller_than_wide_mismatch", measured & (shape == "taller_than_wide") & (depth <= width)))
    return out


def violations() -> Column:
    """Ids of broken rules, in the rules' order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules()]))


def checked(column: Column, broken: Column) -> Column:
    """The column, or an error that names the broken rules."""
    return F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit("constraints broken: "), F.array_join(broken, ", "))).cast("string")).otherwise(column)
