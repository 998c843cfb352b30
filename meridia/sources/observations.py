"""Measurement campaigns as a Spark data source: ``spark.read.format("observations").load(path)``.

A file holds a campaign, a list of campaigns, or (``lines``) a campaign a line; a row comes out for each measurement, with what
the record, its site and its campaign say side by side. Files of lines are cut into parts of ``part_bytes``, each a task that
begins at the first line after its first byte; other files are a task each. What can't be read is a row too, with a ``problem``.

``normalised`` then decides, as column expressions, what holds for a measurement: the record's word before the site's before the
campaign's, and one path loss in dB from whichever quantity was measured, or the reason why there is none.
"""

from __future__ import annotations

import io
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_BYTES = 32 << 20
#: Rows of an Arrow batch.
ROWS = 10_000
#: Columns: from the campaign (c), the site (s) or the record (r), where there, and of what type.
FIELDS = {
    "campaign_id": ("c", "campaign_id", "string"), "c_ghz_min": ("c", "frequency_range_ghz.min_ghz", "double"), "c_ghz_max": ("c", "frequency_range_ghz.max_ghz", "double"),
    "c_los": ("c", "environment.los_state", "string"), "c_los_source": ("c", "environment.los_source", "string"), "c_morphology": ("c", "environment.morphology", "string"), "c_morphology_source": ("c", "environment.morphology_source", "string"),
    "c_rooftop": ("c", "environment.rooftop_relation", "string"), "c_rooftop_source": ("c", "environment.rooftop_source", "string"), "c_directionality": ("c", "antenna_setup.directionality", "string"), "c_basis": ("c", "antenna_setup.comparison_basis", "string"),
    "c_tx_gain": ("c", "antenna_setup.tx_gain_dbi", "double"), "c_rx_gain": ("c", "antenna_setup.rx_gain_dbi", "double"), "c_power": ("c", "calibration.conducted_tx_power_dbm", "double"), "c_tx_cable": ("c", "calibration.tx_cable_loss_db", "double"),
    "c_rx_cable": ("c", "calibration.rx_cable_loss_db", "double"), "c_calibrated": ("c", "calibration.receiver_calibration_applied", "boolean"), "c_kelvin": ("c", "weather.temperature_k", "double"), "c_pressure_hpa": ("c", "weather.pressure_hpa", "double"),
    "c_vapour_g_m3": ("c", "weather.water_vapour_density_g_m3", "double"), "c_rain_known": ("c", "weather.rain_known", "boolean"), "c_rain_mm_h": ("c", "weather.rain_rate_mm_h", "double"), "c_fog_known": ("c", "weather.fog_known", "boolean"), "c_fog_g_m3": ("c", "weather.fog_liquid_water_density_g_m3", "double"),
    "s_morphology": ("s", "morphology", "string"), "s_morphology_source": ("s", "morphology_source", "string"), "s_rooftop": ("s", "rooftop_relation", "string"), "s_rooftop_source": ("s", "rooftop_source", "string"),
    "measurement_id": ("r", "measurement_id", "string"), "site_id": ("r", "site_id", "string"), "tx_lon": ("r", "tx.lon", "double"), "tx_lat": ("r", "tx.lat", "double"), "tx_m": ("r", "tx.height_m", "double"), "rx_lon": ("r", "rx.lon", "double"), "rx_lat": ("r", "rx.lat", "double"), "rx_m": ("r", "rx.height_m", "double"),
    "ghz": ("r", "frequency_ghz", "double"), "quantity": ("r", "measurement_quantity", "string"), "received_dbm": ("r", "measured_received_power_dbm", "double"), "loss_db": ("r", "measured_path_loss_db", "double"), "gain_db": ("r", "measured_path_gain_db", "double"),
    "gain_embedded": ("r", "antenna_gain_embedded", "boolean"), "cable_embedded": ("r", "cable_loss_embedded", "boolean"), "calibrated": ("r", "calibration_applied", "boolean"), "power": ("r", "tx_conducted_power_dbm", "double"), "tx_gain": ("r", "tx_gain_dbi", "double"), "rx_gain": ("r", "rx_gain_dbi", "double"),
    "tx_cable": ("r", "tx_cable_loss_db", "double"), "rx_cable": ("r", "rx_cable_loss_db", "double"), "directionality": ("r", "directionality", "string"), "basis": ("r", "antenna_comparison_basis", "string"), "los": ("r", "labels.los_nlos", "string"), "los_source": ("r", "labels.los_nlos_source", "string"),
    "morphology": ("r", "labels.morphology", "string"), "morphology_source": ("r", "labels.morphology_source", "string"), "rooftop": ("r", "labels.rooftop_relation", "string"), "rooftop_source": ("r", "labels.rooftop_relation_source", "string"), "has_weather": ("r", "weather", "exists"),
    "kelvin": ("r", "weather.temperature_k", "double"), "pressure_hpa": ("r", "weather.pressure_hpa", "double"), "vapour_g_m3": ("r", "weather.water_vapour_density_g_m3", "double"), "rain_known": ("r", "weather.rain_known", "boolean"), "rain_mm_h": ("r", "weather.rain_rate_mm_h", "double"),
    "fog_known": ("r", "weather.fog_known", "boolean"), "fog_g_m3": ("r", "weather.fog_liquid_water_density_g_m3", "double"), "slant_m": ("r", "geometry.direct_3d_distance_m", "double"), "walls": ("r", "geometry.wall_event_count", "long"), "edge_loss_db": ("r", "geometry.diffraction_loss_db", "double"),
}
_KINDS = {"string": (str, pa.string()), "double": ((int, float), pa.float64()), "long": (int, pa.int64()), "boolean": (bool, pa.bool_()), "exists": (None, pa.bool_())}
_DDL = "file string, problem string, " + ", ".join(f"{n} {'boolean' if t == 'exists' else t}" for n, (_, _, t) in FIELDS.items())
_ARROW = pa.schema([("file", pa.string()), ("problem", pa.string()), *((n, _KINDS[t][1]) for n, (_, _, t) in FIELDS.items())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _picked(part, where: str, kind: str):
    """The value at a dotted place of a JSON object; null where it is not there or of another kind."""
    for name in where.split("."):
        part = part.get(name) if isinstance(part, dict) else None
    types = _KINDS[kind][0]
    if types is None:
        return isinstance(part, dict)
    if part is None or not isinstance(part, types) or (isinstance(part, bool) and kind != "boolean"):
        return None
    return float(part) if kind == "double" else part


def flattened(campaign, file: str) -> Iterator[dict]:
    """A row for each measurement of a campaign; a campaign that can't be one is a row with a problem."""
    if not isinstance(campaign, dict):
        yield {"file": file, "problem": "invalid_campaign"}
        return
    own = {n: _picked(campaign, w, t) for n, (of, w, t) in FIELDS.items() if of == "c"}
    if not own["campaign_id"]:
        yield {"file": file, "problem": "campaign_id_missing"}
        return
    sites = {s.get("site_id"): s for s in reversed(campaign.get("sites") or []) if isinstance(s, dict)}
    seen = set()
    for record in campaign.get("measurements") or []:
        row = {"file": file, "problem": None} | own
        row |= {n: _picked(record, w, t) for n, (of, w, t) in FIELDS.items() if of == "r"}
        site = sites.get(row["site_id"] or "")
        row |= {n: _picked(site, w, t) for n, (of, w, t) in FIELDS.items() if of == "s"}
        if not row["measurement_id"]:
            row["problem"] = "measurement_id_missing"
        elif row["measurement_id"] in seen:
            row["problem"] = "duplicate_measurement_id"
        seen.add(row["measurement_id"])
        yield row


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None):
        self.path, self.begin, self.end = path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.lines = str(options.get("lines", "false")).lower() == "true"
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[_Part]:
        store, at = _store(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        prefix = self.path[: self.path.find("://") + 3] if "://" in self.path and not self.path.startswith("file:") else ""
        parts = []
        for f in files:
            name = prefix + f.path
            if self.lines:
                parts += [_Part(name, b, min(f.size, b + self.part_bytes)) for b in range(0, f.size, self.part_bytes)]
            else:
                parts.append(_Part(name, 0, None))
        return parts

    def _campaigns(self, part: _Part) -> Iterator:
        store, at = _store(part.path)
        with store.open_input_file(at) as raw, io.BufferedReader(raw) as source:
            if part.end is None:
                try:
                    found = json.loads(source.read())
                except ValueError:
                    found = ValueError
                many = found if isinstance(found, list) else found.get("campaigns") if isinstance(found, dict) and isinstance(found.get("campaigns"), list) else [found]
                yield from many
                return
            at = part.begin
            if at:  # the line that goes on here belongs to the part before
                source.seek(at - 1)
                at += len(source.readline()) - 1
            else:
                source.seek(0)
            while at < part.end and (line := source.readline()):
                at += len(line)
                if line.strip():
                    try:
                        yield json.loads(line)
                    except ValueError:
                        yield ValueError

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for campaign in self._campaigns(partition):
            rows = [{"file": partition.path, "problem": "invalid_json"}] if campaign is ValueError else flattened(campaign, partition.path)
            for row in rows:
                held.append(row)
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class Observations(DataSource):
    """Options: ``lines`` (a campaign a line), ``part_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Observations)


#: Words for sight, surroundings and rooftops that mean the same; other words stay as they are.
LOS_WORDS = {"los": "los", "line_of_sight": "los", "line-of-sight": "los", "nlos": "nlos", "non_line_of_sight": "nlos", "non-line-of-sight": "nlos", "unknown": "unknown"}
MORPHOLOGY_WORDS = {
    "urban_high_rise": "urban_high_rise", "urban-high-rise": "urban_high_rise", "highrise": "urban_high_rise", "urban high-rise": "urban_high_rise", "urban_low_rise": "urban_low_rise", "urban-low-rise": "urban_low_rise", "lowrise": "urban_low_rise", "urban low-rise": "urban_low_rise",
    "suburban": "suburban", "unknown": "unknown",
}
ROOFTOP_WORDS = {"both_below_rooftop": "both_below_rooftop", "both-below-rooftop": "both_below_rooftop", "below_rooftop": "both_below_rooftop", "one_above_one_below": "one_above_one_below", "one-above-one-below": "one_above_one_below", "both_above_rooftop": "both_above_rooftop", "both-above-rooftop": "both_above_rooftop", "unknown": "unknown"}
#: Bases and directions that compare with an isotropic model, and those that do not.
BASES = ("isotropic_equivalent_path_loss", "synthesized_omnidirectional_path_loss")
OMNI, DIRECTIONAL = ("synthesized_omnidirectional", "isotropic"), ("best_directional", "arbitrary_directional")
LOSSES = ("path_loss", "de_embedded_path_loss", "directional_path_loss", "omnidirectional_equivalent_path_loss")


def _said(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _word(x: Column, words: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(v) for pair in words.items() for v in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(x))), x)


def _label(name: str, words: dict[str, str], levels: tuple[str, ...]) -> dict[str, Column]:
    """A label and its source, both of the first level that has the label."""
    of = lambda level: _said(F.col(f"{level}{name}"))
    source = F.coalesce(*(F.when(of(level).isNotNull(), F.coalesce(_said(F.col(f"{level}{name}_source")), F.lit(""))) for level in levels))
    return {name: _word(F.coalesce(*map(of, levels)), words), f"{name}_source": _said(source)}


def normalised(rows: DataFrame) -> DataFrame:
    """Rows of the data source as measurements: what the models of ``functions.models`` ask for, with ``measured_db``, or ``reason`` why not
    (a ``problem`` of the reader is one). Frequency falls back to a campaign of one frequency, weather to the campaign's as a whole."""
    c = F.col
    basis, direction = F.coalesce(_said(c("basis")), c("c_basis"), F.lit("")), F.coalesce(_said(c("directionality")), c("c_directionality"), F.lit(""))
    own = lambda name: F.coalesce(c(name), c(f"c_{name}"))
    flags = c("gain_embedded").isNull() | c("cable_embedded").isNull() | c("calibrated").isNull()
    power = ("power", "tx_gain", "rx_gain", "tx_cable", "rx_cable", "calibrated")
    missing = F.lit(False)
    for name in power:
        missing |= own(name).isNull()
    other_basis = ~basis.isin(*BASES)
    loss = F.when(c("loss_db").isNull(), "path_loss_missing").when((c("quantity") == "directional_path_loss") | direction.isin(*DIRECTIONAL), "directional").when(flags, "flags_missing").when(other_basis, "basis").when(~direction.isin(*OMNI), "directionality_missing")
    gain = F.when(c("gain_db").isNull(), "path_gain_missing").when(flags, "flags_missing").when(other_basis, "basis")
    received = F.when(c("received_dbm").isNull(), "received_power_missing").when(missing, "calibration_missing").when(~own("calibrated"), "not_calibrated").when(other_basis, "basis").when(direction.isin(*DIRECTIONAL, "unknown", ""), "directionality_missing")
    reason = F.when(c("problem").isNotNull(), c("problem")).when(c("quantity").isin(*LOSSES), loss).when(c("quantity") == "path_gain", gain).when(c("quantity") == "received_power", received).otherwise("quantity")
    value = F.when(c("quantity") == "path_gain", -c("gain_db")).when(c("quantity") == "received_power", own("power") + own("tx_gain") + own("rx_gain") - own("tx_cable") - own("rx_cable") - c("received_dbm")).otherwise(c("loss_db"))
    ghz = F.coalesce(c("ghz"), F.when(c("c_ghz_min") == c("c_ghz_max"), c("c_ghz_min")))
    air = lambda name: F.when(F.coalesce(c("has_weather"), F.lit(False)), c(name)).when(c("c_kelvin").isNotNull(), c(f"c_{name}")).alias(name)
    labels = _label("los", LOS_WORDS, ("", "c_")) | _label("morphology", MORPHOLOGY_WORDS, ("", "s_", "c_")) | _label("rooftop", ROOFTOP_WORDS, ("", "s_", "c_"))
    return rows.select(
        "file", "campaign_id", "measurement_id", "site_id", ghz.alias("ghz"), "quantity", direction.alias("directionality"), basis.alias("basis"), *(v.alias(k) for k, v in labels.items()), c("tx_m").alias("transmitter_m"), c("rx_m").alias("receiver_m"),
        "tx_lon", "tx_lat", "rx_lon", "rx_lat", "slant_m", "walls", "edge_loss_db", *(air(n) for n in ("kelvin", "pressure_hpa", "vapour_g_m3", "rain_known", "rain_mm_h", "fog_known", "fog_g_m3")), F.when(reason.isNull(), value).alias("measured_db"), reason.alias("reason"),
    )
