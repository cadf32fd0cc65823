"""Area units per state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadaspark.functions.numeric import fixed, rnd

# Square metres per plot by state; 648 everywhere else.
PLOT_SQM = {
    "Lagos": 648.0, "Ogun": 648.0, "Oyo": 648.0, "Osun": 648.0, "Ondo": 648.0, "Ekiti": 648.0,
    "FCT": 900.0, "Abuja": 900.0,
    "Rivers": 465.0, "Delta": 648.0, "Edo": 648.0, "Bayelsa": 465.0, "Cross River": 648.0, "Akwa Ibom": 648.0,
    "Anambra": 465.0, "Enugu": 465.0, "Imo": 465.0, "Abia": 465.0, "Ebonyi": 465.0,
    "Kogi": 648.0, "Benue": 648.0, "Niger": 648.0, "Kwara": 648.0, "Nassarawa": 648.0, "Plateau": 648.0,
    "Kano": 900.0, "Kaduna": 648.0, "Katsina": 900.0, "Sokoto": 900.0, "Zamfara": 900.0, "Kebbi": 900.0,
    "Jigawa": 900.0,
    "Borno": 900.0, "Yobe": 900.0, "Adamawa": 648.0, "Gombe": 648.0, "Bauchi": 648.0, "Taraba": 648.0,
}
DEFAULT_PLOT_SQM = 648.0


def state_key(state: Column) -> Column:
    """Lower-case lookup key: " State" suffix, case, hyphen and underscore do not matter."""
    return F.lower(F.translate(F.replace(F.trim(state), F.lit(" State"), F.lit("")), "-_", "  "))


def plot_standard(state: Column) -> tuple[Column, Column]:
    """(square metres per plot, label); a map literal, so no join is needed for 38 entries."""
    entries = [(name.lower(), name, sqm) for name, sqm in PLOT_SQM.items()]
    sizes = F.create_map(*[x for k, _, s in entries for x in (F.lit(k), F.lit(s))])
    labels = F.create_map(*[x for k, n, _ in entries for x in (F.lit(k), F.lit(n))])
    key = state_key(state)
    return (
        F.coalesce(F.try_element_at(sizes, key), F.lit(DEFAULT_PLOT_SQM)),
        F.coalesce(F.try_element_at(labels, key), F.lit("Std.")),
    )


def area_display(area_ha: Column, plot_sqm: Column, label: Column) -> dict[str, Column]:
    sqm = area_ha * 10000.0
    plots = sqm / plot_sqm
    tag = F.when(label == "Std.", "(Std.)").otherwise(F.concat(F.lit("("), label, F.lit(" std.)")))
    whole = F.format_number(F.floor(sqm + 0.5), 0)
    about = F.concat(F.lit("≈ "), fixed(plots, 1), F.lit(" plots"))
    gap = F.lit("  ·  ")
    return {
        "sqm": F.floor(sqm + 0.5),
        "plots": rnd(plots, 1),
        "ha": rnd(area_ha, 4),
        "display_simple": F.concat(whole, F.lit(" sqm"), gap, about, gap, fixed(area_ha, 2), F.lit(" ha")),
        "display_expert": F.concat(
            whole, F.lit(" sqm"), gap, about, F.lit(" "), tag, gap, fixed(area_ha, 4), F.lit(" ha")
        ),
        "display_plots_only": about,
    }
