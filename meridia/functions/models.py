"""A registry of propagation models as column expressions: what a model refuses, and the loss it predicts otherwise.

A model takes columns by name and returns columns, so any number of models is one projection; a user adds one by
``register(Model(...))`` and it takes part in every comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import rf, weather

#: What a model may ask for, and what stands for it where the table has no such column.
INPUTS = {
    "distance_m": "double", "ghz": "double", "walls": "long", "los": "string", "transmitter_m": "double", "receiver_m": "double", "edge_loss_db": "double", "kelvin": "double", "pressure_hpa": "double", "vapour_g_m3": "double", "directionality": "string",
    "rain_known": "boolean", "rain_mm_h": "double", "fog_known": "boolean", "fog_g_m3": "double", "morphology": "string", "rooftop": "string", "los_source": "string", "morphology_source": "string", "rooftop_source": "string",
}
Links = Mapping[str, Column]


@dataclass(frozen=True)
class Model:
    """``refusal`` gives a reason or null, ``loss`` dB; ``statuses`` says what a reason means, ``status`` what all others mean; only
    calibrated models may be fitted."""

    id: str
    refusal: Callable[[Links], Column]
    loss: Callable[[Links], Column]
    status: str = "inapplicable"
    calibrated: bool = True
    statuses: Mapping[str, str] = field(default_factory=dict)


_MODELS: dict[str, Model] = {}


def register(model: Model) -> Model:
    if model.id in _MODELS:
        raise ValueError(f"model {model.id} is registered twice")
    _MODELS[model.id] = model
    return model


def by_id(name: str) -> Model:
    """The model of this name, whatever its case and blanks."""
    found = _MODELS.get(name.strip().lower())
    if found is None:
        raise KeyError(f"no model {name}")
    return found


def ids() -> list[str]:
    return sorted(_MODELS)


def _slant(c: Links) -> Column:
    return rf.slant_m(c["distance_m"], c["transmitter_m"], c["receiver_m"])


def free_space_exact(metres: Column, ghz: Column) -> Column:
    """Free-space loss from the speed of light, without a rounded constant."""
    return 20 * F.log10(4 * F.pi() * metres * ghz * 1e9 / 299_792_458.0)


#: What a street model may be told of the surroundings, and the words for not knowing.
MORPHOLOGIES = {"p1411_below_rooftop_los_v1": ("urban_high_rise", "urban_low_rise", "suburban"), "p1411_urban_highrise_nlos_v1": ("urban_high_rise",), "p1411_urban_lowrise_nlos_v1": ("urban_low_rise", "suburban")}
BELOW, UNKNOWN = "both_below_rooftop", ("", "unknown")


def _street(row: tuple) -> Model:
    """A street-level model of the fixed table: it needs labels of sight, surroundings and rooftops, each with a source."""
    name, los, f0, f1, d0, d1, alpha, beta, gamma, _ = row
    labels = ("los", "morphology", "rooftop", "los_source", "morphology_source", "rooftop_source")

    def refusal(c: Links) -> Column:
        unlabelled = reduce(or_, (F.coalesce(c[x].isin(*UNKNOWN), F.lit(True)) for x in labels))
        in_band = c["ghz"].between(f0, f1)
        reach = weather.street_reach(F.lit(name), c["ghz"], F.lit(d1))
        other_roofs = c["rooftop"] != BELOW
        reasons = F.array(
            F.when(~in_band, "frequency_out_of_range"), F.when(in_band & ~c["distance_m"].between(F.lit(d0), reach), "distance_out_of_range"), F.when(~c["morphology"].isin(*MORPHOLOGIES[name]), "morphology_mismatch"),
            F.when(other_roofs, "rooftop_relation_mismatch"), F.when(other_roofs, "unsupported_geometry"), F.when(c["los"] != los, "los_state_mismatch"),
        )
        against = F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ",")
        return F.when(unlabelled, "labels_required").when(against != "", against)

    return Model(name, refusal, lambda c: 10 * alpha * F.log10(c["distance_m"]) + beta + 10 * gamma * F.log10(c["ghz"]), statuses={"labels_required": "ambiguous"})


def _air(c: Links) -> tuple[Column, ...]:
    """Rain and fog of a link that says that there is some (an amount not given is 0)."""
    amount = lambda known, x: F.when(c[known], F.coalesce(c[x], F.lit(0.0)))
    return amount("rain_known", "rain_mm_h"), amount("fog_known", "fog_g_m3")


def _air_refusal(c: Links) -> Column:
    rain, fog = _air(c)
    outside = weather.ledger_refusal(c["ghz"], c["distance_m"], c["kelvin"], c["pressure_hpa"], c["vapour_g_m3"], rain, fog)
    return F.when(c["kelvin"].isNull() | c["pressure_hpa"].isNull() | c["vapour_g_m3"].isNull(), "weather_required").when(c["rain_known"].isNull() | c["fog_known"].isNull(), "weather_flags_required").otherwise(outside)


def _air_loss(c: Links) -> Column:
    height = F.abs(F.coalesce(c["transmitter_m"] - c["receiver_m"], F.lit(0.0)))
    return weather.ledger(c["ghz"], c["distance_m"], height, c["kelvin"], c["pressure_hpa"], c["vapour_g_m3"], *_air(c))["total"]


register(Model("legacy_fspl_walls", lambda c: F.when(c["ghz"] > 300, "frequency_out_of_range").when(c["walls"].isNull(), "wall_events_required"), lambda c: rf.free_space_loss(_slant(c), c["ghz"]) + c["walls"] * rf.wall_loss(c["ghz"]), statuses={"wall_events_required": "ambiguous"}))
register(Model("urban_short_range", lambda c: rf.urban_refusal(c["distance_m"], c["ghz"], c["transmitter_m"], c["receiver_m"], F.lit(True), F.lit(True), c["los"]), lambda c: rf.urban_loss(c["distance_m"], _slant(c), c["ghz"], c["transmitter_m"], c["receiver_m"], c["los"] == "los")))
register(Model("p525_fspl", lambda c: F.lit(None).cast("string"), lambda c: free_space_exact(c["distance_m"], c["ghz"])))
register(Model("research_sub_thz", lambda c: F.when(c["walls"].isNull(), "wall_events_required").when(F.abs(c["ghz"] - 140) > 1e-9, "frequency_out_of_range"), lambda c: free_space_exact(c["distance_m"], c["ghz"]) + 80.0 * c["walls"], calibrated=False, statuses={"wall_events_required": "ambiguous"}))
register(Model("single_edge_diffraction", lambda c: F.when(c["edge_loss_db"].isNull(), "edge_loss_required"), lambda c: free_space_exact(c["distance_m"], c["ghz"]) + c["edge_loss_db"], "unsupported", calibrated=False))
register(Model("atmospheric", _air_refusal, _air_loss, "unsupported", statuses={"weather_required": "ambiguous", "weather_flags_required": "ambiguous"}))
for _row in weather.STREET:
    register(_street(_row))


def predictions(links: DataFrame, names: list[str] | None = None) -> DataFrame:
    """links with one row for each model: model, calibrated, status, reason, predicted_db. One projection and an explode, no join. A
    name that no model has is unsupported.

    Before any model's own rules: a directional measurement is no match for an isotropic model, and a link needs a frequency
    and a distance (both ambiguous).
    """
    c = {k: F.col(k) if k in links.columns else F.lit(None).cast(t) for k, t in INPUTS.items()}
    directional = ~F.coalesce(c["directionality"].isin("synthesized_omni", "unknown", "", "isotropic"), F.lit(True))

    nowhere = ~F.coalesce((c["distance_m"] > 0) & (c["ghz"] > 0), F.lit(False))

    def one(m: Model) -> Column:
        reason = F.when(directional, "directional_measurement").when(nowhere, "frequency_and_distance_required").otherwise(m.refusal(c))
        named = reduce(lambda otherwise, r: F.when(reason == r[0], r[1]).otherwise(otherwise), m.statuses.items(), F.lit(m.status))
        status = F.when(directional | nowhere, "ambiguous").when(reason.isNotNull(), named).otherwise("applicable")
        return F.struct(F.lit(m.id).alias("model"), F.lit(m.calibrated).alias("calibrated"), status.alias("status"), reason.alias("reason"), F.when(reason.isNull(), m.loss(c)).alias("predicted_db"))

    nothing = lambda n: Model(n, lambda c: F.lit("no_adapter_registered"), lambda c: F.lit(None).cast("double"), "unsupported")
    known = [_MODELS.get(n.strip().lower()) or nothing(n) for n in names or ids()]
    return links.withColumn("_m", F.explode(F.array(*map(one, known)))).select(*links.columns, "_m.*")


def receiver_threshold(mode: Column, manual_dbm: Column, bandwidth_hz: Column, figure_db: Column, snr_db: Column, margin_db: Column) -> Column:
    """(sensitivity_dbm, problem): a set threshold, or thermal noise with figure, required ratio and margin."""
    derived = F.coalesce(mode, F.lit("manual")) == "derived"
    inside = lambda x, low, high: F.coalesce(x.between(low, high), F.lit(False))
    problem = (
        F.when(~F.coalesce(mode, F.lit("manual")).isin("manual", "derived"), "mode").when(~derived & ~inside(manual_dbm, -180.0, -20.0), "sensitivity")
        .when(derived & ~inside(bandwidth_hz, 1.0, 2e9), "bandwidth").when(derived & ~inside(figure_db, 0.0, 20.0), "figure").when(derived & ~inside(snr_db, -100.0, 100.0), "snr").when(derived & ~inside(margin_db, -100.0, 100.0), "margin")
    )
    value = F.when(derived, rf.thermal_noise(bandwidth_hz, figure_db) + snr_db + margin_db).otherwise(manual_dbm)
    return F.struct(F.when(problem.isNull(), value).alias("sensitivity_dbm"), problem.alias("problem"))


def tie_breaker(metres: Column, radius_m: Column, most_m: float = 500.0, per_ray: float = 100.0) -> Column:
    """Of two rays that cover as much, the one that goes farther: up to ``per_ray`` at the radius, or at ``most_m``."""
    limit = F.when(F.least(radius_m, F.lit(most_m)) > 0, F.least(radius_m, F.lit(most_m))).otherwise(F.lit(most_m))
    return F.greatest(F.lit(0.0), F.least(metres, limit)) / limit * per_ray


def reanchored(tx_lon: Column, tx_lat: Column, tx_m: Column, rx_lon: Column, rx_lat: Column, rx_m: Column, slant: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a receiver due east or west of the transmitter, at a measured slant distance."""
    ground = slant * slant - (rx_m - tx_m) * (rx_m - tx_m)
    lon = tx_lon + F.when(rx_lon < tx_lon, -1.0).otherwise(1.0) * F.sqrt(ground) / (111_320.0 * F.greatest(F.lit(0.1), F.cos(F.radians(tx_lat))))
    return F.when(ground > 0, lon).otherwise(rx_lon), F.when(ground > 0, tx_lat).otherwise(rx_lat)
